"""Fits that grow with their table: what was learnt is kept in a form that can be merged.

A state is five stored tables: the columns' measures, their distinct values (or
HyperLogLog sketches), the counted values of numbers (or KLL sketches), the counted texts
and the sums of score products. New rows are read once, into a state of their own; two
states are merged by sums, unions and sketch merges, and a model is made from a state
without reading a row of the table again.

Scores are ranks, which move with every new row. The sums therefore refer to the scores of
the first rows, whose model is kept as the ``scorer``: dependence is measured on one scale
for all rows. The kinds of the columns, and which columns' nulls are counted together, are those of
the first rows too.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.nested import column
from facsimile.operators.kinds import UNCOUNTED, column_profile, decisive_columns, distinct_sketches, distinct_values, kind_sql, type_class
from facsimile.operators.model import (
    CATEGORIES_DDL, KNOTS, SUMS_DDL, Model, added_sums, byte_counts, copula_columns, correlation_of, counted_texts, counted_values, grid_sketches,
    intervals_of, literal_entries, normal_scores, null_blocks, numeric_views, pair_sums, pattern_cells, patterns_of, ranked_grid, sketch_knots,
    text_cells,
)
from facsimile.session import scratch_path, settle

SUMMED = ("rows", "nulls", "cells", "empty", "minus", "plus")


@dataclass
class FitState:
    """Where the tables are, and what all states of one table share."""

    spark: SparkSession
    path: str
    schema: T.StructType
    exact: bool
    overrides: dict[str, str]
    kinds: dict[str, str]
    blocks: list[list[str]]  # columns whose nulls are counted together
    scorer: Model | None

    def part(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _save(self) -> FitState:
        facts = {"schema": self.schema.jsonValue(), "exact": self.exact, "overrides": self.overrides, "kinds": self.kinds, "blocks": self.blocks, "scorer": self.scorer is not None}
        self.spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").json(f"{self.path}/facts")
        if self.scorer is not None:
            self.scorer.save(f"{self.path}/scorer")
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FitState:
        facts = json.loads(spark.read.schema("facts string").json(f"{path}/facts").first()["facts"])
        scorer = Model.load(spark, f"{path}/scorer") if facts["scorer"] else None
        return cls(spark, path, T.StructType.fromJson(facts["schema"]), facts["exact"], facts["overrides"], facts["kinds"], facts["blocks"], scorer)

    def _found_kinds(self) -> dict[str, str]:
        distinct = self.part("distinct")
        if self.exact:
            counted = distinct.groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
        else:
            counted = distinct.selectExpr("column", "hll_sketch_estimate(sketch) AS distinct")
        profile = self.part("profile").drop("distinct").join(F.broadcast(counted), "column", "left")  # a row per column
        profile = profile.withColumn("distinct", F.coalesce("distinct", F.lit(0).cast("long")))
        found = profile.withColumn("kind", F.expr(kind_sql(self.overrides, self.exact))).orderBy("position").collect()
        self._profile = [r.asDict() for r in found]
        return {r["column"]: r["kind"] for r in found}

    def _specs(self) -> list[dict[str, Any]]:
        types = {f.name: f.dataType for f in self.schema.fields}
        specs = [dict(s, kind=self.kinds[s["column"]], marginal="ecdf", entries=0, total=0) for s in self._profile]
        for s in specs:
            s["type_json"] = json.dumps(T.StructType([T.StructField("v", types[s["column"]])]).jsonValue())
        return specs

    def model(self, knots: int = KNOTS, path: str | None = None) -> Model:
        """The model of all rows that were observed; ``path`` stores it."""
        found = self._found_kinds()
        moved = {c: (self.kinds[c], k) for c, k in found.items() if k != self.kinds[c]}
        if moved:
            told = ", ".join(f"{c} from {a} to {b}" for c, (a, b) in moved.items())
            raise ValueError(f"the kind of a column has changed ({told}): learn the whole table anew, or fix the kind by an override")
        specs = self._specs()
        if specs[0]["rows"] == 0:
            raise ValueError("no rows to learn from")
        grids = ranked_grid(self.part("grids"), knots) if self.exact else sketch_knots(self.part("grids"), knots)
        quantiles = {r["column"]: [float(x) for x in r["knots"]] for r in grids.collect() if r["knots"]}
        target = f"{path}/categories" if path else scratch_path(self.spark, "categories")
        categories = intervals_of(self.part("frequencies"), None, target)
        patterns = patterns_of(self.blocks)
        by_name = {s["column"]: s for s in [*specs, *patterns]}
        for r in categories.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.max("hi").alias("total")).collect():
            by_name[r["column"]].update(entries=r["n"], total=r["total"])
        model = Model(self.spark, specs, quantiles, categories, literal_entries(categories, [*specs, *patterns]), patterns=patterns)
        if self.scorer is not None:
            scored = copula_columns(self.scorer)
            if len(scored) > 1:
                model.correlation = correlation_of(self.part("pairs"), scored)
        if path:
            model.save_parameters(path)
        return model

    def append(self, new: DataFrame, path: str) -> FitState:
        """The state of the rows so far and ``new`` ones, which alone are read. ``path`` differs from this state's."""
        if path.rstrip("/") == self.path.rstrip("/"):
            raise ValueError("a state is not merged into its own folder")
        if [(f.name, f.dataType) for f in new.schema.fields] != [(f.name, f.dataType) for f in self.schema.fields]:
            raise ValueError("new rows must have the columns and types of those before")
        other = _observe(new, scratch_path(self.spark, "state"), self.exact, self.overrides, self)
        both = {name: self.part(name).unionByName(other.part(name)) for name in ("distinct", "grids", "frequencies", "pairs")}
        if self.exact:
            both["distinct"] = both["distinct"].distinct()
            both["grids"] = both["grids"].groupBy("column", "value").agg(F.sum("count").alias("count"))
        else:
            both["distinct"] = both["distinct"].groupBy("column").agg(F.expr("hll_union_agg(sketch)").alias("sketch"))
            filled = F.expr("kll_sketch_get_n_double(sketch) > 0")
            both["grids"] = both["grids"].filter(filled).groupBy("column").agg(F.expr("kll_merge_agg_double(sketch)").alias("sketch"))
        both["frequencies"] = both["frequencies"].groupBy("column", "value").agg(F.sum("count").alias("count"))
        both["pairs"] = added_sums(both["pairs"])
        both["profile"] = _merged_profile(self.part("profile"), other.part("profile"))
        for name, table in both.items():
            settle(table, name, f"{path}/{name}")
        return FitState(self.spark, path, self.schema, self.exact, self.overrides, self.kinds, self.blocks, self.scorer)._save()


def _merged_profile(one: DataFrame, two: DataFrame) -> DataFrame:
    """Sums, extremes, and the mean and spread of both groups of rows."""
    a, b = one.alias("a"), two.alias("b")

    def part(side: str, name: str):
        return F.col(f"{side}.{name}")

    def filled(side: str):
        return (part(side, "rows") - part(side, "nulls") - part(side, "minus") - part(side, "plus")).cast("double")

    na, nb = filled("a"), filled("b")
    mean_a, mean_b = (F.coalesce(part(s, "mean"), F.lit(0.0)) for s in "ab")
    apart = F.when((na > 0) & (nb > 0), mean_b - mean_a).otherwise(0.0)
    squares = sum((F.coalesce(part(s, "std") * part(s, "std") * (n - 1), F.lit(0.0)) for s, n in (("a", na), ("b", nb))), F.lit(0.0))
    squares = squares + apart * apart * F.when(na + nb > 0, na * nb / (na + nb)).otherwise(0.0)
    merged = {s: part("a", s) + part("b", s) for s in SUMMED}
    merged |= {
        "min": F.least(part("a", "min"), part("b", "min")),
        "max": F.greatest(part("a", "max"), part("b", "max")),
        "mean": F.when(part("a", "mean").isNull() & part("b", "mean").isNull(), F.lit(None)).otherwise((mean_a * na + mean_b * nb) / (na + nb)),
        "std": F.when(part("a", "mean").isNotNull() | part("b", "mean").isNotNull(), F.when(na + nb > 1, F.sqrt(squares / (na + nb - 1)))),
        "max_length": F.greatest(part("a", "max_length"), part("b", "max_length")),
        "spaced": part("a", "spaced") | part("b", "spaced"),
        "digits": F.when(part("a", "rows") == 0, part("b", "digits"))
        .when(part("b", "rows") == 0, part("a", "digits"))
        .when(part("a", "digits").isNotNull() & part("b", "digits").isNotNull(), F.greatest(part("a", "digits"), part("b", "digits"))),
    }
    return a.join(b, F.col("a.column") == F.col("b.column")).select(
        *[merged[c].alias(c) if c in merged else part("a", c) for c in one.columns]
    )


def _observe(flat: DataFrame, path: str, exact: bool, overrides: dict[str, str], like: FitState | None, independent: bool = False) -> FitState:
    spark, fields = flat.sparkSession, flat.schema.fields
    state = FitState(spark, path, flat.schema, exact, overrides, like.kinds if like else {}, like.blocks if like else [], like.scorer if like else None)
    settle(column_profile(flat, counts=set()), "profile", f"{path}/profile")
    if exact:
        counted = [f for f in fields if type_class(f.dataType) not in UNCOUNTED]
        distinct = distinct_values(flat.select(*[column(f.name) for f in counted])) if counted else spark.createDataFrame([], "column string, value string")
    else:
        names = decisive_columns(fields)
        decisive = [f for f in fields if f.name in names]
        distinct = distinct_sketches(flat, decisive) if decisive else spark.createDataFrame([], "column string, sketch binary")
    settle(distinct, "distinct", f"{path}/distinct")
    found = state._found_kinds()
    state.kinds = state.kinds or found
    specs = state._specs()
    views = numeric_views(flat, specs)
    if exact:
        grids = counted_values(flat, views) if views else spark.createDataFrame([], "column string, value double, count bigint")
    else:
        grids = grid_sketches(flat, views) if views else spark.createDataFrame([], "column string, sketch binary")
    settle(grids, "grids", f"{path}/grids")
    state.blocks = like.blocks if like else null_blocks(specs)
    cells, binary = text_cells(specs) | pattern_cells(flat, patterns_of(state.blocks)), [s["column"] for s in specs if s["kind"] == "bytes"]
    texts = [counted_texts(flat, cells)] if cells else []
    texts += [byte_counts(flat, binary)] if binary else []
    counts = reduce(DataFrame.unionByName, texts) if texts else spark.createDataFrame([], CATEGORIES_DDL).select("column", "value", "count")
    settle(counts, "frequencies", f"{path}/frequencies")
    if like is None and not independent and specs[0]["rows"]:
        state.scorer = state.model()
    names = copula_columns(state.scorer) if state.scorer is not None else []
    sums = pair_sums(normal_scores(flat, state.scorer, names, unseen=True), len(names)) if len(names) > 1 else spark.createDataFrame([], SUMS_DDL)
    settle(sums, "pairs", f"{path}/pairs")
    return state


def learn_state(
    flat: DataFrame, path: str, exact: bool = False, overrides: dict[str, str] | None = None, independent: bool = False
) -> FitState:
    """Observe the first rows of a flat table; ``exact`` and ``independent`` as in :func:`facsimile.operators.model.fit`."""
    return _observe(flat, path, exact, overrides or {}, None, independent)._save()
