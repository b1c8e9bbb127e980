"""Governance and delivery validation of stored artifacts: texts are read by tasks, results written as pairs of files.

A row is a pass (or a delivery); any number of them go through at once, and none passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import delivery, governance
from ..sources import files
from .relation import Relation


def passes(given: DataFrame) -> DataFrame:
    """Needs report_id, generated_at, environment and a path for each of the four artifacts (null: not given); a file that isn't there counts as absent."""
    for kind in governance.INPUTS:
        given = files.texts(given, f"{kind}_path", f"{kind}_text")
    return governance.governed(Relation()).on(given)


def govern(given: DataFrame, out: str) -> DataFrame:
    """Write each pass's report pair into a folder; gives the reports."""
    found = passes(given)
    files.write(governance.files_of(found), out)
    return governance.reports(found)


def deliveries(given: DataFrame) -> DataFrame:
    """Needs validation_run_id, validated_at, pipeline_run_id, expected_event_id, workspace_mode, event_path and manifest_path; looks whether the bundles that events name are there."""
    texts = files.texts(files.texts(given, "event_path", "event_text"), "manifest_path", "manifest_text").withColumn("_bundle", F.expr("try_variant_get(try_parse_json(event_text), '$.bundle_artifact_path', 'string')"))
    lost = files.missing(texts.where("coalesce(_bundle, '') <> ''").select("_bundle").distinct(), "_bundle").withColumn("_lost", F.lit(True))
    whole = texts.join(lost, "_bundle", "left").withColumn("bundle_exists", F.expr("coalesce(_bundle, '') <> '' AND _lost IS NULL")).drop("_bundle", "_lost")
    return delivery.validated(Relation()).on(whole)


def validate(given: DataFrame, share: str, shared_as: str, out: str) -> DataFrame:
    """Write each delivery's result pair into a folder; gives the results."""
    found = delivery.results(deliveries(given), share, shared_as)
    files.write(delivery.files_of(found), out)
    return found
