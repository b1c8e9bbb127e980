"""Review decisions and reprocessing requests: what is wrong with them, and requests from decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import vocab as V
from ..functions.dialect import Dialect


def _needed(d: Dialect, *names: str) -> list[tuple[str, str]]:
    return [(f"coalesce({n}, '') = ''", d.text(f"{n} is required.")) for n in names]


def decision_checks(d: Dialect) -> dict[str, str]:
    """Errors of a decision in their order, whether it asks for an action, and whether it ends the matter.

    Null and empty columns are missing; a missing decision is an unknown one, shown as None.
    """
    named = _needed(d, "decision_id", "queue_entry_id", "document_id", "pipeline_run_id", "decided_at")
    known = d.isin("coalesce(decision, '')", V.DECISIONS)
    opened, closed = d.text("decision '"), d.text(f"' is not a valid review decision. Must be one of: {V.DECISIONS}.")
    shown = f"concat({opened}, coalesce(decision, 'None'), {closed})"
    cases = [
        *named,
        ("coalesce(decision_rationale, '') = ''", d.text("decision_rationale is required and must not be empty.")),
        (f"NOT {known}", shown),
        (f"decision = '{V.REPROCESS}' AND coalesce(reprocessing_request_id, '') = ''", d.text(f"reprocessing_request_id is required when decision == '{V.REPROCESS}'.")),
    ]
    return {"decision_errors": d.compact(*cases), "is_actionable": d.isin("coalesce(decision, '')", V.ACTIONABLE), "is_terminal": d.isin("coalesce(decision, '')", V.TERMINAL)}


def request_checks(d: Dialect) -> dict[str, str]:
    """Errors of a reprocessing request in their order."""
    first = _needed(d, "reprocessing_request_id", "document_id", "original_pipeline_run_id")
    rest = _needed(d, "linked_queue_entry_id", "linked_decision_id", "requested_at")
    return {"request_errors": d.compact(*first, ("coalesce(reprocessing_reason, '') = ''", d.text("reprocessing_reason is required and must not be empty.")), *rest)}


def requested(decisions, queue):
    """Reprocessing requests of decisions without errors that ask for one; the record comes from the queue's entry."""
    asked = decisions.add(decision_checks).where(lambda d: f"decision = '{V.REPROCESS}' AND {d.size('decision_errors')} = 0")
    own = queue.select(lambda d: {"queue_entry_id": "queue_entry_id", "gold_record_id": "gold_record_id", "review_reason_category": "review_reason_category"})
    taken = {
        "reprocessing_request_id": "reprocessing_request_id", "document_id": "document_id", "gold_record_id": "gold_record_id", "original_pipeline_run_id": "pipeline_run_id", "review_reason_category": "review_reason_category",
        "reprocessing_reason": "decision_rationale", "linked_queue_entry_id": "queue_entry_id", "linked_decision_id": "decision_id", "requested_at": "decided_at",
    }
    return asked.join(own, "inner", ("queue_entry_id",)).select(lambda d: taken)


def checked(decisions: DataFrame) -> DataFrame:
    """`decision_checks` of a DataFrame."""
    from ..plans.relation import Relation

    return Relation().add(decision_checks).on(decisions)
