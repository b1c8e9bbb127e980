"""Bronze: admission of files, metadata, hash, parse outcome, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.dialect import Dialect
from ..sources.files import listing


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length and content of the files of a folder (not of folders inside it), empty ones too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    empty = listing(spark, path).where("length = 0")  # Spark's readers leave these out
    return files.unionByName(empty.withColumn("content", F.lit(b"")))


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def admitted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with a known extension, and the rest with a reason."""
    with_ext = files.withColumn("file_extension", _extension(F.col("path")))
    known = F.col("file_extension").isin(*V.EXTENSIONS)
    return with_ext.where(known), with_ext.where(~known).select("path", F.concat(F.lit("unsupported extension "), "file_extension").alias("reason"))


def _uuid(*parts: Column) -> Column:
    """A deterministic identifier in the usual five groups."""
    h = F.sha2(F.concat_ws("\u001f", *parts).cast("binary"), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def bronze(files: DataFrame, run_id: str, hint: str | None = None, source_system: str | None = None, ingested_by: str | None = None) -> DataFrame:
    """Bronze records of admitted files. Text files are read as UTF-8 (bad bytes become U+FFFD, line ends \\n).

    Other formats need a remote parser that isn't there: their rows are failed, with a reason; none is dropped.
    """
    path, ext = F.col("path"), F.col("file_extension")
    text = F.regexp_replace(F.expr("make_valid_utf8(cast(content AS string))"), "\r\n?", "\n")
    parsed = F.when(ext.isin(*V.TEXT_EXTENSIONS), text)
    mime = F.coalesce(*[F.when(ext == k, F.lit(v)) for k, v in V.EXTENSIONS.items()], F.lit("application/octet-stream"))
    rows = files.withColumn("parsed_text", parsed)
    size = F.length("parsed_text").cast("long")
    return rows.select(
        _uuid(F.lit("document"), path).alias("document_id"),
        _uuid(F.lit("bronze"), F.lit(run_id), path).alias("bronze_record_id"),
        path.alias("source_path"),
        F.regexp_extract(path, "[^/]+$", 0).alias("file_name"),
        ext.alias("file_extension"),
        F.col("length").alias("file_size_bytes"),
        F.sha2("content", 256).alias("file_hash"),
        mime.alias("mime_type"),
        F.current_timestamp().alias("ingested_at"),
        F.when(F.col("parsed_text").isNull(), F.lit("failed")).when(size == 0, F.lit("partial")).otherwise(F.lit("success")).alias("parse_status"),
        F.when(F.col("parsed_text").isNull(), F.concat(F.lit("no local parser for "), ext)).alias("parse_failure_reason"),
        "parsed_text",
        F.lit(None).cast("int").alias("page_count"),
        size.alias("char_count"),
        F.when(F.col("parsed_text").isNull(), F.lit("unknown")).otherwise(F.lit(V.PARSER)).alias("parse_model"),
        F.lit(run_id).alias("pipeline_run_id"),
        F.lit(V.SCHEMA_VERSION).alias("schema_version"),
        F.lit(hint).cast("string").alias("document_class_hint"),
        F.lit(source_system).cast("string").alias("source_system"),
        F.lit(ingested_by).cast("string").alias("ingested_by"),
    )


def constraints(d: Dialect) -> dict[str, str]:
    """Names of the rules that a Bronze record breaks."""
    cases = [
        (f"NOT {d.isin("coalesce(lower(file_extension), '')", V.EXTENSIONS)}", "'extension'"),
        (f"NOT coalesce({d.has('lower(file_hash)', '^[0-9a-f]{64}$', '')}, false)", "'file_hash'"),
        (f"NOT {d.isin("coalesce(parse_status, '')", V.PARSE_STATUSES)}", "'parse_status'"),
        ("parse_status = 'failed' AND (parse_failure_reason IS NULL OR parsed_text IS NOT NULL)", "'failed_shape'"),
        ("parse_status IN ('success', 'partial') AND char_count IS NULL", "'char_count'"),
        ("coalesce(file_size_bytes <= 0, true)", "'file_size_bytes'"),
    ]
    return {"constraint_violations": d.compact(*cases)}


def violations(rows: DataFrame) -> DataFrame:
    """`constraints` of a DataFrame."""
    from ..plans.relation import Relation

    return Relation().add(constraints).on(rows)
