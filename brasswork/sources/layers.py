"""Layer tables: Bronze, Silver and Gold rows, stored between the layers as the pipeline stores them."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_stored: dict[tuple[str, str, str, str], str] = {}
_sessions: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or one of our own where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), f"brasswork-layers-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    return own


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Names, sizes and times of the input's tables: a layer of another state isn't used again."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/*.parquet")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return repr(sorted((s.getPath().getName(), files.getContentSummary(s.getPath()).getLength(), s.getModificationTime()) for s in files.globStatus(place) or []))


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    path = _stored.get((spark.sparkContext.applicationId, sf_dir, name, _state(spark, sf_dir)))
    return None if path is None else spark.read.parquet(path)


def store(df: DataFrame, sf_dir: str, name: str) -> DataFrame:
    """Write a layer and read it back: regular expressions run once, and later filters work on plain columns."""
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, sf_dir))
    path = f"{folder(spark)}/brasswork-layer-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored[key], _sessions[key[0]] = path, spark
    return spark.read.parquet(path)


@atexit.register
def _clean() -> None:
    for (app, *_), path in _stored.items():
        try:
            context = _sessions[app].sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session is gone; the folder's owner clears it
            return
