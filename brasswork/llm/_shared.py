"""Session helpers of the training-data operators: shared folder, written tables, code shipping."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_written: list[tuple[SparkSession, str]] = []
_shipped: dict[str, str] = {}

#: Bytes of a side that may be broadcast.
SMALL = 24 << 20
#: Bytes of a batch of rows that goes to Python at once, where the session leaves Spark's default.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT = "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or one of our own where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), f"brasswork-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; removed when the application ends."""
    path = f"{shared_dir(spark)}/brasswork-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made(since: int = 0) -> list[tuple[SparkSession, str]]:
    """Paths made so far, from the given number on."""
    return _written[since:]


def drop(paths: list[tuple[SparkSession, str]]) -> None:
    """Remove tables that nothing reads any more."""
    release(paths[0][0] if paths else None)
    for entry in paths:
        if entry in _written:
            _written.remove(entry)
        spark, path = entry
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clean() -> None:
    try:
        drop(list(_written))
    except Exception:  # the session is gone; the folder's owner clears it
        return


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors once per application; bound batches by bytes where the session doesn't."""
    if spark.conf.get(_BATCH, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="brasswork-code-"), "brasswork_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)
    _shipped[app] = target


def release(spark: SparkSession | None = None) -> None:
    """Give freed memory back to the system; with a session, its JVM's too, which also lets Spark remove shuffle files that nothing reads."""
    gc.collect()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, which gives freed memory back to the system at its end: workers are used again by other tasks."""

    @functools.wraps(run)
    def frugally(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return frugally


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """A batch as pandas, whose long columns with nulls are of pandas' own Int64: as floats they would lose bits."""
    out = batch.to_pandas()
    for name, column in zip(batch.schema.names, batch.columns):
        if column.null_count and pa.types.is_int64(column.type):
            out[name] = column.to_pandas(types_mapper=lambda _: pd.Int64Dtype())
    return out


def in_pandas(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """`mapInPandas` that keeps all 64 bits of a long beside nulls, in what `run` gets and in what it gives."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(_frame(b) for b in batches):
            yield pa.RecordBatch.from_pandas(out, schema=kinds, preserve_index=False)

    return df.mapInArrow(frugal(exactly), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def take(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to the given types: other columns, clashing names included, never matter."""
    return df.select(*[df[k].cast(v).alias(k) for k, v in kinds.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that `df` doesn't have."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def _width(df: DataFrame) -> Column:
    """Bytes of a row, about."""
    total = F.lit(16)
    for name, kind in df.dtypes:
        own = F.octet_length(name) if kind in ("string", "binary") else F.size(name) * 8 if kind.startswith("array") else F.lit(8)
        total = total + F.coalesce(own, F.lit(0)).cast("long")
    return total


def is_small(df: DataFrame, most_bytes: int = SMALL) -> bool:
    """Whether all rows of `df` together take at most so many bytes."""
    return (df.agg(F.sum(_width(df)).alias("n")).first()["n"] or 0) <= most_bytes


def with_small(df: DataFrame, small: DataFrame, on: list[str], most_bytes: int = SMALL, how: str = "inner") -> DataFrame:
    """Join with a side that is broadcast only if its size in bytes proves small; a shuffled join otherwise."""
    return df.join(F.broadcast(small) if is_small(small, most_bytes) else small, on, how)


def left_join(df: DataFrame, side: DataFrame, key: str, rows: str, most: int = 1000) -> DataFrame:
    """Left join with the columns of `side`, whose column `rows` says how many rows of `df` its key has.

    A small side is broadcast whole. Else its keys with more than `most` rows are (at most one for each `most` rows of
    `df`, and fewer as long as they aren't small), and the others are joined by a shuffle, which no key can burden.
    """
    names = [c for c in side.columns if c not in (key, rows)]
    if is_small(side):
        return df.join(F.broadcast(side.drop(rows)), key, "left")
    while not is_small(many := side.where(F.col(rows) > most).select(key, *names)):
        most *= 2
    (met,) = fresh(df, "_met")
    told = df.join(F.broadcast(many.withColumn(met, F.lit(True))), key, "left")
    few = told.where(F.col(met).isNull()).drop(met, *names).join(side.where(F.col(rows) <= most).drop(rows), key, "left")
    return told.where(met).drop(met).unionByName(few)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
