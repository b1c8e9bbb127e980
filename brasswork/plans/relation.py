"""A relation: a source and steps. Spark runs it as a DataFrame; the same steps render as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Dialect, Duck, Spark
from ..sources import layers

Expressions = Callable[[Dialect], dict[str, str]]

SPARK, DUCK = Spark(), Duck()


@dataclass(frozen=True)
class Relation:
    """`table` names a stored table, `values` gives rows as SQL; steps follow in order."""

    table: str = ""
    values: str = ""
    steps: tuple = field(default=())

    def _then(self, *step) -> "Relation":
        return Relation(self.table, self.values, (*self.steps, step))

    def add(self, make: Expressions) -> "Relation":
        return self._then("add", make)

    def select(self, make: Expressions) -> "Relation":
        return self._then("select", make)

    def where(self, make: Callable[[Dialect], str]) -> "Relation":
        return self._then("where", make)

    def agg(self, keys: tuple[str, ...], make: Expressions) -> "Relation":
        return self._then("agg", keys, make)

    def explode(self, column: str, into: str) -> "Relation":
        return self._then("explode", column, into)

    def union(self, *others: "Relation") -> "Relation":
        return self._then("union", others)

    def join(self, other: "Relation", how: str, on: tuple[str, ...]) -> "Relation":
        return self._then("join", other, how, on)

    def top(self, order: str, n: int) -> "Relation":
        """The first n rows of an order that leaves no ties."""
        return self._then("top", order, n)

    def layer(self, name: str) -> "Relation":
        """A layer boundary: Spark stores the rows as a table once per session and input, and goes on from there."""
        return self._then("layer", name)

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        # What was stored before for this session and input needn't be planned again.
        for i in range(len(self.steps) - 1, -1, -1):
            if self.steps[i][0] == "layer" and (held := layers.stored(spark, sf_dir, self.steps[i][1])) is not None:
                return Relation(steps=self.steps[i + 1 :]).on(held, lambda r: r.frame(spark, sf_dir), sf_dir)
        df = spark.sql(f"SELECT * FROM VALUES {self.values}") if self.values else spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        return self.on(df, lambda r: r.frame(spark, sf_dir), sf_dir)

    def on(self, df: DataFrame, other: Callable[["Relation"], DataFrame] | None = None, sf_dir: str | None = None) -> DataFrame:
        """The steps applied to a given DataFrame; layers are stored only where the input has a name."""
        for kind, *args in self.steps:
            if kind == "add":
                df = df.withColumns({k: F.expr(v) for k, v in args[0](SPARK).items()})
            elif kind == "select":
                df = df.select(*[F.expr(v).alias(k) for k, v in args[0](SPARK).items()])
            elif kind == "where":
                df = df.where(args[0](SPARK))
            elif kind == "agg":
                df = df.groupBy(*args[0]).agg(*[F.expr(v).alias(k) for k, v in args[1](SPARK).items()])
            elif kind == "explode":
                df = df.withColumn(args[1], F.explode(args[0]))
            elif kind == "top":
                df = df.orderBy(*[F.expr(o.removesuffix(" DESC")).desc() if o.endswith(" DESC") else F.expr(o) for o in args[0].split(", ")]).limit(args[1])
            elif kind == "layer" and sf_dir is not None:
                df = layers.store(df, sf_dir, args[0])
            elif kind == "union":
                for r in args[0]:
                    df = df.unionByName(other(r))
            elif kind == "join":
                df = df.join(other(args[0]), list(args[2]), {"left": "left", "anti": "left_anti", "semi": "left_semi", "inner": "inner"}[args[1]])
        return df

    def sql(self) -> str:
        """The relation in DuckDB SQL."""
        out = f"SELECT * FROM (VALUES {self.values.replace(' AS t(', ') AS t(', 1)}" if self.values else f"SELECT * FROM {self.table}"
        for kind, *args in self.steps:
            if kind == "add":
                out = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in args[0](DUCK).items())} FROM ({out})"
            elif kind == "select":
                out = f"SELECT {', '.join(f'{v} AS {k}' for k, v in args[0](DUCK).items())} FROM ({out})"
            elif kind == "where":
                out = f"SELECT * FROM ({out}) WHERE {args[0](DUCK)}"
            elif kind == "agg":
                keys = "".join(f"{k}, " for k in args[0])
                out = f"SELECT {keys}{', '.join(f'{v} AS {k}' for k, v in args[1](DUCK).items())} FROM ({out})" + (f" GROUP BY {', '.join(args[0])}" if args[0] else "")
            elif kind == "explode":
                out = f"SELECT *, unnest({args[0]}) AS {args[1]} FROM ({out})"
            elif kind == "top":
                out = f"SELECT * FROM ({out}) ORDER BY {args[0]} LIMIT {args[1]}"
            elif kind == "union":
                out = " UNION ALL BY NAME ".join(f"(SELECT * FROM ({x}))" for x in [out, *[r.sql() for r in args[0]]])
            elif kind == "join":
                how = {"left": "LEFT", "anti": "ANTI", "semi": "SEMI", "inner": "INNER"}[args[1]]
                out = f"SELECT * FROM ({out}) a {how} JOIN ({args[0].sql()}) b USING ({', '.join(args[2])})"
        return out
