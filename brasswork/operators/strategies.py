"""Parsers, extractors and classifiers by name: local rules as columns, and remote ones that can't run here."""

from __future__ import annotations

import os.path
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions import registry
from ..functions import vocab as V


class RemoteOnly(NotImplementedError):
    """This needs a service that only a hosted runtime offers."""


@dataclass(frozen=True)
class Strategy:
    """`kind` is parser, extractor or classifier, `model` the identifier that its records carry."""

    kind: str
    model: str
    domain: str | None = None
    remote: bool = False

    def apply(self, rows: DataFrame) -> DataFrame:
        """Parsed text of files, fields of parsed text, or label and confidence of Silver rows of the strategy's domain."""
        from ..plans.relation import Relation
        from . import bronze, extract, gold

        if self.remote:
            raise RemoteOnly(f"{self.model} runs on a hosted runtime only; no {self.kind} of this name runs here")
        if self.kind == "parser":
            return bronze.bronze(rows, "local")
        if self.kind == "extractor":
            return extract.with_fields(Relation(), self.domain).on(rows)
        return Relation().add(lambda d: gold.signals(d, self.domain)).add(lambda d: gold.classified(d, self.domain)).on(rows)


LOCAL_PARSER = Strategy("parser", V.PARSER)
REMOTE_PARSER = Strategy("parser", "ai_parse_document/v1", remote=True)
REMOTE_EXTRACTOR = Strategy("extractor", "ai_extract/v1", remote=True)
REMOTE_CLASSIFIER = Strategy("classifier", "ai_classify/v1", remote=True)


def parser(path: str) -> Strategy:
    """The parser of a file by its extension, whose case doesn't matter: text has a local one."""
    return LOCAL_PARSER if os.path.splitext(path)[1].lower() in V.TEXT_EXTENSIONS else REMOTE_PARSER


def extractor(hint: str | None, remote: bool = False) -> Strategy:
    """The extractor of a class hint (none: letters); an unknown domain or a planned one raises."""
    key = registry.require_active(V.LETTER if hint is None else hint, "extraction").key
    return REMOTE_EXTRACTOR if remote else Strategy("extractor", V.EXTRACTOR, key)


def classifier(hint: str | None, remote: bool = False) -> Strategy:
    """The classifier of a class hint (none: letters); an unknown domain or a planned one raises."""
    key = registry.require_active(V.LETTER if hint is None else hint, "classification").key
    return REMOTE_CLASSIFIER if remote else Strategy("classifier", V.CLASSIFIER, key)
