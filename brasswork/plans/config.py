"""Environments: database, table and experiment names."""

from __future__ import annotations

import os
from dataclasses import dataclass

from ..functions.vocab import ENVIRONMENTS

VARIABLE = "BRASSWORK_ENV"


@dataclass(frozen=True)
class Environment:
    name: str
    base: str = "documents"

    @property
    def catalog(self) -> str:
        return f"{self.base}_{self.name}"

    def database(self, layer: str) -> str:
        return f"{self.catalog}_{layer}"

    def table(self, layer: str) -> str:
        names = {"bronze": "parsed_documents", "silver": "extracted_records", "gold": "ai_ready_assets", "delivery": "delivery_events"}
        return f"{self.database('gold' if layer == 'delivery' else layer)}.{names[layer]}"

    def experiment(self, stage: str, root: str | None = None, tracked_remotely: bool = False) -> str:
        if tracked_remotely and not (root or "").startswith("/"):
            raise ValueError("a remote tracker needs an absolute root for experiment names")
        return "/".join(x for x in ((root or "").rstrip("/"), self.name, stage) if x) if not (root or "").startswith("/") else f"{root.rstrip('/')}/{self.name}/{stage}"


def environment(name: str | None = None) -> Environment:
    """The named environment; else the one in the variable; else dev. Case doesn't matter."""
    found = (name or os.environ.get(VARIABLE) or "dev").strip().lower()
    if found not in ENVIRONMENTS:
        raise ValueError(f"unknown environment {found!r}; one of {', '.join(ENVIRONMENTS)}")
    return Environment(found)
