"""JSON artifacts as tables: strict scans for the pipeline, tolerant ones for evaluation."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import listing

BAD = "_bad_json"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", False)
    if not path.endswith(".json"):
        reader = reader.option("pathGlobFilter", "*.json")
    files = reader.text(path, wholetext=True).select("value", F.try_parse_json("value").isNull().alias(BAD), F.input_file_name().alias("source_file"))
    empty = listing(spark, path, ".json").where("length = 0")  # Spark's readers leave these out; they are no JSON either
    files = files.unionByName(empty.select(F.lit("").alias("value"), F.lit(True).alias(BAD), F.col("path").alias("source_file")))
    return files.withColumn("v", F.from_json("value", schema)).select("v.*", "source_file", BAD)


def scan(spark: SparkSession, schema: str, folder: str | None = None, file: str | None = None) -> DataFrame:
    """Artifacts of one file (which wins) or of a folder's own `*.json` files; none, or one that isn't JSON, is an error."""
    path = file or folder
    if not path:
        raise ValueError("a folder or a file is needed")
    try:
        rows = _read(spark, path, schema)
        bad = rows.agg(F.count("*").alias("n"), F.min(F.when(F.col(BAD), F.col("source_file"))).alias("bad")).first()
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    if not bad["n"]:
        raise FileNotFoundError(f"no JSON artifact in {path}")
    if bad["bad"]:
        raise ValueError(f"not JSON: {bad['bad']}")
    return rows.drop(BAD)


def tolerant(spark: SparkSession, schema: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Readable artifacts of a folder, and the files that were skipped because they aren't JSON."""
    rows = _read(spark, folder, schema)
    return rows.where(~F.col(BAD)).drop(BAD), rows.where(BAD).select("source_file")
