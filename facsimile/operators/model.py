"""Fitting: marginals, category frequencies and a Gaussian copula, as small tables."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from statistics import NormalDist
from typing import Any, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.epoch import as_number_sql
from facsimile.functions.nested import quoted
from facsimile.functions.normal import normal_quantile
from facsimile.functions.search import LITERAL_LIMIT, array_sql, count_at_most_sql, doubles_sql, sql_string
from facsimile.functions.text import shape_sql
from facsimile.operators.kinds import BLOCK, ID_LENGTH, absent_sql, detect_kinds
from facsimile.operators.lookup import lookup_join
from facsimile.operators.ranks import SLOT_ROWS, running_totals
from facsimile.operators.sketches import merged
from facsimile.session import scratch_path, settle

KNOTS = 1001
SKETCH_SIZE = 4096  # KLL quantile sketch: rank error below 0.1 %
BLANKS = r"\s+"
MARGINALS = ("ecdf", "norm")
CONSTANT = 1e-10  # share of the second moment below which a variance is rounding
SUM_ROWS = 64  # rows of a block of sums
SUM_COLUMNS = 256  # columns of one, and of a block of columns that a task reads with another
RIDGE_STEPS = (0.0, 1e-8, 1e-6, 1e-4, 1e-2, 1e-1)

COLUMNS_DDL = (
    "column string, position int, kind string, type string, type_json string, rows bigint, nulls bigint, "
    "cells bigint, empty bigint, minus bigint, plus bigint, min double, max double, mean double, std double, distinct bigint, "
    "max_length int, digits int, marginal string, entries bigint, total bigint"
)
QUANTILES_DDL = "column string, knots array<double>"
CATEGORIES_DDL = "column string, value string, count bigint, lo bigint, hi bigint"
CORRELATION_DDL = "position int, column string, r array<double>"
PATTERNS_DDL = "pattern string, position int, bit int, column string, entries bigint, total bigint"
MISSING_MODES = ("patterns", "independent")
PATTERN = "._nulls"  # with a number, the name of a block of columns in the table of categories
PATTERN_COLUMNS = 16  # of a block: it has at most 65,536 patterns, however many rows there are
PATTERN_POSITION = 1 << 20  # beyond the positions of columns, which the draws are told apart by


@dataclass
class Model:
    """Five small tables; ``categories`` stays a DataFrame, as it may be large."""

    spark: SparkSession
    columns: list[dict[str, Any]]
    quantiles: dict[str, list[float]]
    categories: DataFrame
    literals: dict[str, list[tuple[str, int]]]  # (value, hi) of columns with few categories
    correlation: Mapping = field(default_factory=dict)
    patterns: list[dict[str, Any]] = field(default_factory=list)  # blocks of columns that are null together: a spec and ``members``

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(s["column"], type_of(s)) for s in self.columns])

    def columns_table(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(s[f.name] for f in _schema(COLUMNS_DDL)) for s in self.columns], COLUMNS_DDL)

    def quantiles_table(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.quantiles.items()), QUANTILES_DDL)

    def correlation_table(self) -> DataFrame:
        return self.correlation.table(self.spark) if self.correlation else self.spark.createDataFrame([], CORRELATION_DDL)

    def patterns_table(self) -> DataFrame:
        rows = [(p["column"], p["position"], i, name, p["entries"], p["total"]) for p in self.patterns for i, name in enumerate(p["members"])]
        return self.spark.createDataFrame(rows, PATTERNS_DDL)

    def save_parameters(self, path: str) -> None:
        self.patterns_table().coalesce(1).write.mode("overwrite").parquet(f"{path}/patterns")
        self.columns_table().coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
        self.quantiles_table().coalesce(1).write.mode("overwrite").parquet(f"{path}/quantiles")
        self.correlation_table().coalesce(1).write.mode("overwrite").parquet(f"{path}/correlation")

    def save(self, path: str) -> None:
        self.save_parameters(path)
        self.categories.write.mode("overwrite").parquet(f"{path}/categories")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Model":
        specs = spark.read.schema(COLUMNS_DDL).parquet(f"{path}/columns").orderBy("position").collect()
        quantiles = spark.read.schema(QUANTILES_DDL).parquet(f"{path}/quantiles").collect()
        pairs = Correlation.of_table(spark.read.schema(CORRELATION_DDL).parquet(f"{path}/correlation"))
        columns = [r.asDict() for r in specs]
        patterns: dict[str, dict[str, Any]] = {}
        for r in spark.read.schema(PATTERNS_DDL).parquet(f"{path}/patterns").orderBy("position", "bit").collect():
            empty = {"column": r["pattern"], "position": r["position"], "entries": r["entries"], "total": r["total"], "members": []}
            patterns.setdefault(r["pattern"], empty)["members"].append(r["column"])
        categories = spark.read.schema(CATEGORIES_DDL).parquet(f"{path}/categories")
        return cls(
            spark, columns, {r["column"]: list(r["knots"]) for r in quantiles}, categories,
            literal_entries(categories, [*columns, *patterns.values()]), pairs,
            list(patterns.values()),
        )


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def type_of(spec: dict[str, Any]) -> T.DataType:
    return T.StructType.fromJson(json.loads(spec["type_json"])).fields[0].dataType


def wants_words(spec: dict[str, Any]) -> bool:
    """Long texts are modelled by word counts and word lengths, short ones by shapes."""
    return spec["kind"] == "text" and (spec["max_length"] or 0) > ID_LENGTH


def words_sql(c: str) -> str:
    return f"split(trim({c}), {sql_string(BLANKS)})"


# --- marginals of numbers and times -------------------------------------------------


def numeric_views(flat: DataFrame, specs: list[dict[str, Any]]) -> dict[str, str]:
    types = {f.name: f.dataType for f in flat.schema.fields}
    views = {}
    for s in specs:
        name = quoted(s["column"])
        if s["kind"] in ("numeric", "datetime"):
            views[s["column"]] = as_number_sql(name, types[s["column"]])
        elif wants_words(s):
            views[s["column"]] = f"double(size({words_sql(name)}))"
        elif s["kind"] == "bytes":
            views[s["column"]] = f"double(octet_length({name}))"
    return views


def quantile_grid(flat: DataFrame, views: dict[str, str], knots: int = KNOTS, exact: bool = False) -> DataFrame:
    """``(column, knots)``: values at ``knots`` evenly spaced ranks, first and last included.

    ``views`` maps a name to a SQL expression. The default takes one pass with
    mergeable KLL sketches, which vary a little from run to run; the first and
    the last value are exact. ``exact`` counts distinct values first, ranks them
    in slices and picks the values at the grid ranks.
    """
    if exact:
        return _exact_grid(flat, views, knots)
    return sketch_knots(grid_sketches(flat, views), knots)


def grid_sketches(flat: DataFrame, views: dict[str, str]) -> DataFrame:
    """``(column, sketch)``: KLL sketches of the views, which can be merged."""
    names = list(views)
    blocks = []
    for start in range(0, len(names), BLOCK):
        part = names[start : start + BLOCK]
        columns = [f"v{i}" for i in range(len(part))]
        base = flat.selectExpr(*[f"{views[n]} AS {c}" for n, c in zip(part, columns)])
        sketches = merged(base, f"kll_sketch_agg_double({{}}, {SKETCH_SIZE})", "kll_merge_agg_double({})", columns)
        rows = [f"named_struct('column', {sql_string(n)}, 'sketch', {c})" for n, c in zip(part, columns)]
        blocks.append(sketches.selectExpr(f"inline(array({', '.join(rows)}))"))
    return reduce(DataFrame.unionByName, blocks)


def sketch_knots(sketches: DataFrame, knots: int) -> DataFrame:
    grid = doubles_sql([i / (knots - 1) for i in range(knots)])
    some = "kll_sketch_get_n_double(sketch) > 0"
    return sketches.selectExpr("column", f"if({some}, kll_sketch_get_quantile_double(sketch, {grid}), NULL) AS knots")


def counted_values(flat: DataFrame, views: dict[str, str]) -> DataFrame:
    cells = [f"named_struct('column', {sql_string(n)}, 'value', double({v}))" for n, v in views.items()]
    long = flat.selectExpr(f"inline(array({', '.join(cells)}))").where("value IS NOT NULL")
    return settle(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")), "values")


def value_ranks(flat: DataFrame, views: dict[str, str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``(column, value, count, lo, hi)``: how many rows lie below and up to each value."""
    return running_totals(counted_values(flat, views), ["column"], ["value"], "count", slot_rows=slot_rows)


def _exact_grid(flat: DataFrame, views: dict[str, str], knots: int) -> DataFrame:
    return ranked_grid(counted_values(flat, views), knots)


def ranked_grid(counted: DataFrame, knots: int) -> DataFrame:
    """``(column, knots)`` of a stored table ``(column, value, count)`` with each value of a column once."""
    ranked = running_totals(counted, ["column"], ["value"], "count")
    totals = counted.groupBy("column").agg(F.sum("count").alias("n"))
    points = (
        lookup_join(ranked, totals, "column", ["value"], "inner")
        .selectExpr(
            "column", "value", f"if(lo = 0, 0, lo * {knots - 1} div n + 1) AS a", f"hi * {knots - 1} div n AS b"
        )
        .where("a <= b")
        .selectExpr("column", "value", "explode(sequence(a, b)) AS i")
    )
    # One array per column holds exactly ``knots`` entries.
    ordered = points.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("points"))
    return ordered.selectExpr("column", "transform(points, p -> p.value) AS knots")


# --- category frequencies -----------------------------------------------------------


def byte_counts(flat: DataFrame, names: list[str]) -> DataFrame:
    """``(column, value, count)`` of the bytes of binary columns, a byte as two hex digits; a task sends 256 sums per column."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(names), 256), np.int64)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                _, offsets, data = column.cast(pa.large_binary()).buffers()
                if data is not None:
                    ends = np.frombuffer(offsets, np.int64)[[column.offset, column.offset + len(column)]]
                    totals[i] += np.bincount(np.frombuffer(data, np.uint8)[ends[0] : ends[1]], minlength=256)
        at, byte = np.nonzero(totals)
        yield pa.RecordBatch.from_pydict(
            {"column": [names[i] for i in at], "value": [f"{b:02X}" for b in byte], "count": totals[at, byte]},
            schema=pa.schema([("column", pa.string()), ("value", pa.string()), ("count", pa.int64())]),
        )

    filled = flat.select(*[F.coalesce(F.col(quoted(n)), F.lit(b"")).alias(f"b{i}") for i, n in enumerate(names)])
    counted = filled.mapInArrow(emit, "column string, value string, count bigint")
    return counted.groupBy("column", "value").agg(F.sum("count").alias("count"))


def category_intervals(
    flat: DataFrame, cells: dict[str, str], bound: int | None = None, path: str | None = None, more: DataFrame | None = None
) -> DataFrame:
    """``(column, value, count, lo, hi)``, the most frequent value first in each column.

    ``cells`` maps a name to the SQL expression of the text to count, or of an
    array of texts; ``more`` holds values that are counted already. ``bound``, if
    known, is an upper limit of the result rows.
    """
    counted = [] if more is None else [more]
    if cells:
        counted.append(counted_texts(flat, cells))
    return intervals_of(reduce(DataFrame.unionByName, counted), bound, path)


def intervals_of(counts: DataFrame, bound: int | None = None, path: str | None = None) -> DataFrame:
    """Intervals of ``counts(column, value, count)``."""
    if bound is None or bound >= SLOT_ROWS:
        counts, bound = settle(counts, "frequencies"), None
    ranked = running_totals(counts.withColumn("rarity", -F.col("count")), ["column"], ["rarity", "value"], "count", bound)
    return settle(ranked.select("column", "value", "count", "lo", "hi"), "categories", path)


def counted_texts(flat: DataFrame, cells: dict[str, str]) -> DataFrame:
    base = flat.selectExpr(*[f"{sql} AS v{i}" for i, sql in enumerate(cells.values())])
    tagged = []
    for i, (name, f) in enumerate(zip(cells, base.schema.fields)):
        entry = f"named_struct('column', {sql_string(name)}, 'value', string({{}}))"
        if isinstance(f.dataType, T.ArrayType):
            tagged.append(f"coalesce(transform(v{i}, x -> {entry.format('x')}), array())")
        else:
            tagged.append(f"array({entry.format(f'v{i}')})")
    long = base.selectExpr(f"inline(concat({', '.join(tagged)}))")
    return long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def literal_entries(categories: DataFrame, specs: list[dict[str, Any]]) -> dict[str, list[tuple[str, int]]]:
    """Categories of the columns that have at most ``LITERAL_LIMIT`` of them."""
    small = [s["column"] for s in specs if s["entries"] and s["entries"] <= LITERAL_LIMIT]
    out: dict[str, list[tuple[str, int]]] = {n: [] for n in small}
    if small:
        rows = categories.where(F.col("column").isin(small)).select("column", "value", "hi").orderBy("column", "hi")
        for r in rows.collect():  # at most LITERAL_LIMIT per column
            out[r["column"]].append((r["value"], r["hi"]))
    return out


# --- dependence ---------------------------------------------------------------------


def knot_scores(knots: list[float]) -> tuple[list[float], list[float], list[float]]:
    """Distinct knots, the normal score at each of them, and the scores between them.

    Mid-ranks: u = (knots below + knots up to) / 2 / K. ``between[j]`` belongs to
    values with j distinct knots below them.
    """
    total, normal = len(knots), NormalDist()
    values = np.sort(np.asarray(knots, dtype=float))
    distinct = np.unique(values)
    ends = np.searchsorted(values, distinct, side="right")
    starts = np.searchsorted(values, distinct, side="left")
    at = [normal.inv_cdf((a + b) / 2 / total) for a, b in zip(starts, ends)]
    gaps = [min(max(float(e), 0.5), total - 0.5) for e in (0, *ends)]
    return distinct.tolist(), at, [normal.inv_cdf(g / total) for g in gaps]


def normal_scores(flat: DataFrame, model: Model, names: list[str], unseen: bool = False) -> DataFrame:
    """Columns ``z0, z1, …``: the normal score of each modelled column, null where it is null.

    Spark brings each column to a number (a value, the place of a category, or a
    score already); the tables of scores are looked up per Arrow batch. ``unseen``: rows
    may hold categories that the model has not seen; these have no score.
    """
    specs = {s["column"]: s for s in model.columns}
    types = {f.name: f.dataType for f in flat.schema.fields}
    prepared, large, tables = [], [], {}
    for i, name in enumerate(names):
        spec, sql = specs[name], quoted(name)
        if spec["marginal"] == "norm":
            number = as_number_sql(sql, types[name])
            prepared.append(f"({number} - {spec['mean']!r}D) / {spec['std']!r}D AS x{i}")
        elif name in model.quantiles:
            prepared.append(f"{as_number_sql(sql, types[name])} AS x{i}")
            tables[i] = tuple(np.asarray(a) for a in knot_scores(model.quantiles[name]))
        elif name in model.literals:
            scores = _category_scores(model.literals[name])
            ordered = sorted(scores)
            place = count_at_most_sql(array_sql(ordered, "string"), len(ordered), f"string({sql})")
            absent = f"coalesce(get({array_sql(ordered, 'string')}, {place} - 1), '') <> string({sql}) OR {sql} IS NULL" if unseen else f"{sql} IS NULL"
            prepared.append(f"if({absent}, NULL, double({place} - 1)) AS x{i}")
            at = np.asarray([scores[v] for v in ordered])
            tables[i] = (np.arange(len(ordered), dtype=float), at, np.append(at, at[-1]))
        else:
            prepared.append(f"string({sql}) AS k{i}")
            large.append((i, name))
    base = flat.selectExpr(*prepared)
    spread_by = base.columns
    for i, name in large:
        base = lookup_join(base, _large_scores(model, specs[name], f"k{i}", f"x{i}"), f"k{i}", spread_by)
    size = len(names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(size):
                column = batch.column(i)
                if i not in tables:
                    out.append(column)
                    continue
                values, at, between = tables[i]
                x = column.to_numpy(zero_copy_only=False)
                below = np.searchsorted(values, x, side="right")
                last = np.maximum(below - 1, 0)
                z = np.where((below > 0) & (values[last] == x), at[last], between[np.minimum(below, len(values))])
                out.append(pa.array(z, mask=np.isnan(x)))
            yield pa.RecordBatch.from_arrays(out, names=[f"z{i}" for i in range(size)])

    numbers = base.select(*[f"x{i}" for i in range(size)])
    return numbers.mapInArrow(score, ", ".join(f"z{i} double" for i in range(size)))


def _category_scores(entries: list[tuple[str, int]]) -> dict[str, float]:
    total, normal, below, out = entries[-1][1], NormalDist(), 0, {}
    for value, hi in entries:
        out[value] = normal.inv_cdf((below + hi) / 2 / total)
        below = hi
    return out


def _large_scores(model: Model, spec: dict[str, Any], key: str, score: str) -> DataFrame:
    mine = model.categories.where(F.col("column") == spec["column"])
    u = (F.col("lo") + F.col("hi")) / F.lit(2.0) / F.lit(float(spec["total"]))
    return mine.select(F.col("value").alias(key), u.alias("u")).select(key, normal_quantile("u").alias(score))


class Correlation(Mapping):
    """Correlations by pair of names, the later column first, over one matrix; pairs without a correlation are absent."""

    def __init__(self, names: list[str], matrix: np.ndarray):
        self.names, self.matrix = list(names), matrix  # NaN where there is none; the lower half counts
        self.place = {n: i for i, n in enumerate(self.names)}

    def __getitem__(self, pair: tuple[str, str]) -> float:
        i, j = self.place.get(pair[0], -1), self.place.get(pair[1], -1)
        if not i > j >= 0 or np.isnan(self.matrix[i, j]):
            raise KeyError(pair)
        return float(self.matrix[i, j])

    def __iter__(self) -> Iterator[tuple[str, str]]:
        return ((a, self.names[j]) for i, a in enumerate(self.names) for j in np.flatnonzero(~np.isnan(self.matrix[i, :i])).tolist())

    def __len__(self) -> int:
        return int(np.count_nonzero(np.tril(~np.isnan(self.matrix), -1)))

    def among(self, names: list[str]) -> np.ndarray:
        """The full matrix of some columns, 0 where there is no correlation."""
        known = [n for n in names if n in self.place]
        at = [self.place[n] for n in known]
        lower = np.tril(np.nan_to_num(self.matrix), -1)
        some = (lower + lower.T)[np.ix_(at, at)]
        out, to = np.eye(len(names)), [names.index(n) for n in known]
        out[np.ix_(to, to)] += some
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """A row per column, with its correlations to the columns before it."""
        lists = [self.matrix[i, :i] for i in range(len(self.names))]
        until = np.concatenate([[0], np.cumsum([len(r) for r in lists])]).astype(np.int32)
        rows = pa.ListArray.from_arrays(pa.array(until), pa.array(np.concatenate([np.zeros(0), *lists])))
        places = pa.array(np.arange(len(self.names), dtype=np.int32))
        return spark.createDataFrame(pa.Table.from_arrays([places, pa.array(self.names, pa.string()), rows], names=["position", "column", "r"]))

    @classmethod
    def of_table(cls, table: DataFrame) -> Correlation:
        rows = table.orderBy("position").toArrow()
        names, matrix = rows.column("column").to_pylist(), np.full((len(rows), len(rows)), np.nan)
        for i, row in enumerate(rows.column("r").combine_chunks() if len(rows) else ()):
            matrix[i, :i] = row.values.to_numpy() if i else ()
        return cls(names, matrix)


def correlation(scores: DataFrame, names: list[str]) -> Correlation:
    """Correlation of every pair of score columns ``z0, z1, …`` over the rows where both are set.

    A pair of which one column is constant where the other is set has none.
    """
    if len(names) < 2:
        return Correlation(names, np.full((len(names), len(names)), np.nan))
    return correlation_of(pair_sums(scores, len(names)), names)


SUMS_DDL = "row int, col int, part int, sums binary"


def pair_sums(scores: DataFrame, size: int) -> DataFrame:
    """(row, col, part, sums): what correlations are made of, in blocks of ``SUM_ROWS`` by ``SUM_COLUMNS`` pairs of columns.

    With p = "is set", six matrices of sums over rows: z·z', z·p', z²·p', p·z', p·z'² and p·p'.
    Columns are taken by pairs of blocks, and a task reads and sums the columns of one
    pair, so that its memory does not grow with their number. Sums of tasks meet in two
    steps, each as a stream that keeps one running sum. Sums of further rows can be added
    by ``added_sums``.
    """
    firsts = range(0, size, SUM_COLUMNS)
    pairs = [(a, b) for a in firsts for b in firsts if b <= a]
    if len(pairs) > 1:  # read once per pair of blocks
        scores = settle(scores, "scores")

    def summed(a: int, b: int) -> DataFrame:
        left, right = ([*range(first, min(first + SUM_COLUMNS, size))] for first in (a, b))

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros((6, len(left), len(right)))
            for batch in batches:
                z = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                p = ~np.isnan(z)
                z, p = np.where(p, z, 0.0), p.astype(float)
                zl, pl, zr, pr = z[:, : len(left)], p[:, : len(left)], z[:, -len(right) :], p[:, -len(right) :]
                total += np.stack([zl.T @ zr, zl.T @ pr, (zl * zl).T @ pr, pl.T @ zr, pl.T @ (zr * zr), pl.T @ pr])
            for first in range(0, len(left), SUM_ROWS):
                part = np.ascontiguousarray(total[:, first : first + SUM_ROWS])
                yield _sum_block(a + first, b, TaskContext.get().partitionId(), part)

        columns = left if a == b else left + right
        return scores.select(*[f"z{i}" for i in columns]).mapInArrow(emit, SUMS_DDL)

    made = reduce(DataFrame.unionByName, [summed(a, b) for a, b in pairs])
    met = made.withColumn("part", F.floor(F.sqrt("part")).cast("int")).repartition("part", "row", "col").mapInArrow(_add, SUMS_DDL)
    return added_sums(met)


def added_sums(sums: DataFrame) -> DataFrame:
    """One row per block, of the sums of all rows."""
    return sums.withColumn("part", F.lit(0)).repartition("row", "col").mapInArrow(_add, SUMS_DDL)


def _sum_block(row: int, col: int, part: int, values: np.ndarray) -> pa.RecordBatch:
    schema = pa.schema([("row", pa.int32()), ("col", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])
    return pa.RecordBatch.from_pydict({"row": [row], "col": [col], "part": [part], "sums": [values.tobytes()]}, schema=schema)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[tuple[int, int, int], np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            key, values = (r["row"], r["col"], r["part"]), np.frombuffer(r["sums"])
            totals[key] = totals[key] + values if key in totals else values
    for key, values in totals.items():
        yield _sum_block(*key, values)


def correlation_of(sums: DataFrame, names: list[str]) -> Correlation:
    """Correlations from sums, block by block; the driver gets one number per pair."""
    size = len(names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                columns = min(SUM_COLUMNS, size - r["col"])
                zz, zi, qi, zj, qj, n = np.frombuffer(r["sums"]).reshape(6, -1, columns)
                vi, vj = n * qi - zi * zi, n * qj - zj * zj
                real = (vi > CONSTANT * n * qi) & (vj > CONSTANT * n * qj)
                found = np.where(real, n * zz - zi * zj, np.nan) / np.sqrt(np.where(real, vi * vj, 1.0))
                yield _sum_block(r["row"], r["col"], 0, np.clip(found, -1.0, 1.0))

    matrix = np.full((size, size), np.nan)
    for r in sums.mapInArrow(emit, SUMS_DDL).toLocalIterator():
        columns = min(SUM_COLUMNS, size - r["col"])
        block = np.frombuffer(r["sums"]).reshape(-1, columns)
        matrix[r["row"] : r["row"] + len(block), r["col"] : r["col"] + columns] = block
    return Correlation(names, np.where(np.tri(size, k=-1, dtype=bool), matrix, np.nan))


def cholesky(names: list[str], pairs: Mapping) -> np.ndarray:
    """Lower factor of the correlation matrix; a ridge repairs a matrix that has none."""
    if isinstance(pairs, Correlation):
        matrix = pairs.among(names)
    else:
        place = {n: i for i, n in enumerate(names)}
        matrix = np.eye(len(names))
        for (a, b), r in pairs.items():
            if a in place and b in place:
                matrix[place[a], place[b]] = matrix[place[b], place[a]] = min(max(r, -1.0), 1.0)
    for ridge in RIDGE_STEPS:
        try:
            return np.linalg.cholesky((matrix + ridge * np.eye(len(names))) / (1.0 + ridge))
        except np.linalg.LinAlgError:
            continue
    values, vectors = np.linalg.eigh(matrix)
    repaired = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
    scale = 1.0 / np.sqrt(np.diag(repaired))
    return np.linalg.cholesky(repaired * np.outer(scale, scale) + 1e-9 * np.eye(len(names)))


# --- fit ----------------------------------------------------------------------------


def fit(
    flat: DataFrame,
    kinds: DataFrame | None = None,
    marginal: str = "ecdf",
    independent: bool = False,
    knots: int = KNOTS,
    exact: bool = False,
    overrides: dict[str, str] | None = None,
    present: dict[str, str] | None = None,
    path: str | None = None,
    missing: str = "patterns",
) -> Model:
    """Learn the columns of ``flat``. Every statistic is an aggregate over all rows.

    ``missing="patterns"`` learns which columns are null together, for columns whose cells
    exist in every row; ``independent`` takes each column's share of nulls alone. ``marginal``: ``ecdf`` keeps a quantile grid, ``norm`` mean and spread.
    ``exact`` replaces sketches by exact counts. ``path`` stores the model tables.
    """
    if marginal not in MARGINALS:
        raise ValueError(f"marginal must be one of {MARGINALS}")
    if knots < 2:
        raise ValueError("knots must be at least 2")
    if missing not in MISSING_MODES:
        raise ValueError(f"missing must be one of {MISSING_MODES}")
    spark = flat.sparkSession
    if kinds is None:
        kinds = detect_kinds(flat, overrides, exact, present)
    types = {f.name: f.dataType for f in flat.schema.fields}
    if present:
        flat = _existing_flags(flat, present)
    specs = [r.asDict() for r in kinds.orderBy("position").collect()]  # one row per column
    if not specs or specs[0]["rows"] == 0:
        raise ValueError("no rows to learn from")
    for s in specs:
        s["type_json"] = json.dumps(T.StructType([T.StructField("v", types[s["column"]])]).jsonValue())
        constant = not s["std"] or not math.isfinite(s["std"])
        s["marginal"] = "norm" if s["kind"] in ("numeric", "datetime") and marginal == "norm" and not constant else "ecdf"
        s["entries"] = s["total"] = 0

    by_name = {s["column"]: s for s in specs}
    views = {n: v for n, v in numeric_views(flat, specs).items() if by_name[n]["marginal"] != "norm"}
    grids = quantile_grid(flat, views, knots, exact).collect() if views else []
    quantiles = {r["column"]: [float(x) for x in r["knots"]] for r in grids if r["knots"]}

    cells = text_cells(specs)
    patterns = patterns_of(null_blocks(specs)) if missing == "patterns" else []
    cells |= pattern_cells(flat, patterns)
    binary = [s["column"] for s in specs if s["kind"] == "bytes"]
    target = f"{path}/categories" if path else scratch_path(spark, "categories")
    if cells or binary:
        plain = all(
            s["kind"] == "boolean" or s["kind"] == "categorical" and s["distinct"] for s in specs if s["column"] in cells
        )
        bound = sum(2 * s["distinct"] + 100 for s in specs if s["column"] in cells) + 256 * len(binary) if plain else None
        bound = bound and bound + sum(1 << len(p["members"]) for p in patterns)
        categories = category_intervals(flat, cells, bound, target, byte_counts(flat, binary) if binary else None)
        sizes = categories.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.max("hi").alias("total")).collect()
        by_name |= {p["column"]: p for p in patterns}
        for r in sizes:
            by_name[r["column"]].update(entries=r["n"], total=r["total"])
    else:
        categories = settle(spark.createDataFrame([], CATEGORIES_DDL), "categories", target)

    model = Model(spark, specs, quantiles, categories, literal_entries(categories, [*specs, *patterns]), patterns=patterns)
    if not independent:
        names = copula_columns(model)
        if len(names) > 1:
            model.correlation = correlation(normal_scores(flat, model, names), names)
    if path:
        model.save_parameters(path)
    return model


def null_blocks(specs: list[dict[str, Any]]) -> list[list[str]]:
    """Blocks of columns with nulls; columns with equal numbers of nulls, which may be null together, are neighbours."""
    some = [s for s in specs if s["empty"] and s["cells"] == s["rows"] and s["kind"] != "carried"]
    names = [s["column"] for s in sorted(some, key=lambda s: (s["empty"], s["position"]))]
    blocks = [names[i : i + PATTERN_COLUMNS] for i in range(0, len(names), PATTERN_COLUMNS)]
    return [b for b in blocks if len(b) > 1]  # the pattern of one column is its share of nulls


def patterns_of(blocks: list[list[str]]) -> list[dict[str, Any]]:
    return [{"column": f"{PATTERN}{i}", "position": PATTERN_POSITION + i, "entries": 0, "total": 0, "members": b} for i, b in enumerate(blocks)]


def pattern_cells(flat: DataFrame, patterns: list[dict[str, Any]]) -> dict[str, str]:
    """The pattern of a row: a digit per column of the block, 1 where it is null."""
    fields = {f.name: f for f in flat.schema.fields}
    return {p["column"]: "concat(" + ", ".join(f"if({absent_sql(fields[n])}, '1', '0')" for n in p["members"]) + ")" for p in patterns}


def text_cells(specs: list[dict[str, Any]]) -> dict[str, str]:
    """What is counted of each column that has frequencies: values, word lengths or shapes."""
    cells: dict[str, str] = {}
    for s in specs:
        name, sql = s["column"], quoted(s["column"])
        if s["kind"] in ("categorical", "boolean"):
            cells[name] = f"string({sql})"
        elif wants_words(s):
            cells[name] = f"transform({words_sql(sql)}, w -> length(w))"
        elif s["kind"] == "text" or (s["kind"] == "id" and isinstance(type_of(s), T.StringType)):
            cells[name] = shape_sql(sql)
    return cells


def _existing_flags(flat: DataFrame, present: dict[str, str]) -> DataFrame:
    """``flat`` with flags set to null where there is no cell: an absent element is no null element."""
    chosen = []
    for f in flat.schema.fields:
        name = quoted(f.name)
        masked = isinstance(f.dataType, T.BooleanType) and f.name in present
        chosen.append(f"if({present[f.name]}, {name}, NULL) AS {name}" if masked else name)
    return flat.selectExpr(*chosen)


def copula_columns(model: Model) -> list[str]:
    """Columns that take part in the dependence: numbers, times, categories, flags; no constants."""
    out = []
    for s in model.columns:
        name = s["column"]
        if s["kind"] in ("numeric", "datetime"):
            grid = model.quantiles.get(name)
            if s["marginal"] == "norm" or (grid and grid[0] < grid[-1]):
                out.append(name)
        elif s["kind"] in ("categorical", "boolean") and s["entries"] > 1:
            out.append(name)
    return out
