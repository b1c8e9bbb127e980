"""Connected components over links, in Spark: least neighbours and pointer jumping, cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared


def components(links: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, label) for the nodes of `links` (a, b): label is the least node of the component.

    Each round, a node takes the least label among itself and its neighbours, and then that label's own label; the
    number of rounds grows with the logarithm of a component's width. Labels move as (node, label) rows only.
    """
    links = links.where("a <> b").select("a", "b")
    edges = _shared.written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = _shared.written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        new = step.join(up, "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("label"), F.col("label").alias("old"))
        new = _shared.written(new, "labels")
        moved = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
