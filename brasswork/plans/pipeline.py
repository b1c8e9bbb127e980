"""The record pipeline over a folder of files, as batch (and its SQL form over stored layers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bronze as bronze_layer
from ..operators.gold import gold
from ..operators.silver import silver


def run(spark: SparkSession, landing: str, out: str, run_id: str, hint: str | None = None) -> dict[str, DataFrame]:
    """Files to Bronze, Silver and Gold tables under `out` (appended, a folder per run); returns the layers as read back."""
    files, rejected = bronze_layer.admitted(bronze_layer.scan_files(spark, landing))
    layers: dict[str, DataFrame] = {"rejected": rejected}

    def store(name: str, df: DataFrame) -> DataFrame:
        path = f"{out}/{name}/run={run_id}"
        df.write.mode("overwrite").parquet(path)
        layers[name] = spark.read.parquet(path)
        return layers[name]

    b = store("bronze", bronze_layer.bronze(files, run_id, hint))
    s = store("silver", silver(b, run_id))
    store("gold", gold(s, b, run_id))
    return layers


LINEAGE = """
SELECT b.document_id, b.file_name, s.document_id IS NOT NULL AS silver_exists, g.document_id IS NOT NULL AS gold_exists,
       g.routing_label, g.export_ready,
       CASE WHEN s.document_id IS NOT NULL AND g.document_id IS NOT NULL THEN 'complete' ELSE 'incomplete' END AS lineage
FROM {bronze} b LEFT JOIN {silver} s USING (document_id) LEFT JOIN {gold} g USING (document_id)
ORDER BY b.file_name
"""


def lineage(spark: SparkSession, layers: dict[str, DataFrame]) -> DataFrame:
    """Which layers each document reached, in SQL over the three layers."""
    return spark.sql(LINEAGE, bronze=layers["bronze"], silver=layers["silver"], gold=layers["gold"])


def outcomes(layers: dict[str, DataFrame]) -> DataFrame:
    return layers["gold"].groupBy("outcome_category", "outcome_reason", "routing_label").agg(F.count("*").alias("n"))
