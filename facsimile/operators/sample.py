"""Sampling: any number of rows from a fitted model, row by row, without a shuffle.

Every cell is a function of (row number, column, seed), so a lost task is redone
with the same result, and the sample does not depend on the cluster's size.
"""

from __future__ import annotations

from typing import Any, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.draws import make_draws
from facsimile.functions.epoch import from_number
from facsimile.functions.normal import cdf_array, normal_draw_sql
from facsimile.functions.search import array_sql, count_at_most_sql, doubles_sql, longs_sql, sql_string
from facsimile.functions.text import fill_shape_sql, invented_digits_sql, invented_word_sql, letters_sql, numbered_shape_sql
from facsimile.operators.frequencies import Frequencies
from facsimile.operators.kinds import to_digits_sql
from facsimile.operators.lookup import fits_broadcast
from facsimile.operators.model import Model, cholesky, copula_columns, type_of, wants_words

ROWS_PER_TASK = 1_000_000
CASE_ENTRIES = 16  # categories that are told apart by a CASE; more are found by binary search
APART = 8  # columns that one generated method may hold
BUCKET_ROWS = 64  # categories per bucket of the interval join
SEGMENTS = 1000  # at most, of a category table
# Draw streams of a column, counted from position * STREAMS.
STREAMS, VALUE, MISSING, TEXT, SECOND, ENDLESS = 8, 0, 1, 2, 3, 4


def _stream(spec: dict[str, Any], purpose: int) -> int:
    return spec["position"] * STREAMS + purpose


def apart(columns: list[Column]) -> list[Column]:
    """The same columns, compiled one by one where they are many.

    Whole-stage code is one method for all columns of a projection, and the JIT compiler leaves
    methods beyond 8000 bytes (about 30 draws) interpreted. A projection with a lambda stays out of
    it; one stands in every ``APART``-th column, so that it is also there when some are not read.
    """
    return [F.transform(F.array(c), lambda held: held)[0] if i % APART == APART - 1 else c for i, c in enumerate(columns)]


def _uniforms(model: Model, base: DataFrame, draws, joint: list[str]) -> DataFrame:
    """Adds ``u<position>`` per column, or ``n<position>`` for columns with a normal marginal.

    Columns that depend on others start from independent normals, which the
    Cholesky factor mixes. All other columns are drawn directly.
    """
    spec = {s["column"]: s for s in model.columns}
    factor = cholesky(joint, model.correlation) if joint else np.eye(0)
    off = factor - np.diag(np.diag(factor))
    linked = [i for i in range(len(joint)) if off[i].any() or off[:, i].any()]
    mixed_specs = [spec[joint[i]] for i in linked]
    rows = _mixed(base.select("row"), mixed_specs, factor[np.ix_(linked, linked)], draws) if linked else base
    keyed = rows.withColumn("key", F.expr(draws.key_sql("row")))  # many draws read it, so it stays a column and is made once
    done = {s["position"] for s in mixed_specs}
    drawn = []
    for s in model.columns:
        p, u = s["position"], draws.uniform_of_key_sql("key", _stream(s, VALUE))
        if p in done:
            drawn.append((_score_name(s), _score_name(s)))
        elif s["marginal"] == "norm":
            drawn.append((normal_draw_sql(u, draws.uniform_of_key_sql("key", _stream(s, SECOND))), f"n{p}"))
        else:
            drawn.append((u, f"u{p}"))
    drawn += [(draws.uniform_of_key_sql("key", _stream(p, VALUE)), f"u{p['position']}") for p in model.patterns]
    made = apart([F.expr(sql) for sql, _ in drawn])
    return keyed.select("row", *[c.alias(name) for c, (_, name) in zip(made, drawn)])


def _score_name(spec: dict[str, Any]) -> str:
    return f"{'n' if spec['marginal'] == 'norm' else 'u'}{spec['position']}"


def _mixed(base: DataFrame, specs: list[dict[str, Any]], factor: np.ndarray, draws) -> DataFrame:
    """Correlated scores of ``specs``: draws made by Spark, one matrix product per batch.

    As generated code the product grows with the square of the columns and leaves
    the JIT compiler behind at about ten columns.
    """
    names, size = [_score_name(s) for s in specs], len(specs)
    normal = np.array([s["marginal"] == "norm" for s in specs])
    pairs = base.withColumn("key", F.expr(draws.key_sql("row"))).selectExpr(
        "row",
        *[f"{draws.uniform_of_key_sql('key', _stream(s, VALUE))} AS a{i}" for i, s in enumerate(specs)],
        *[f"{draws.uniform_of_key_sql('key', _stream(s, SECOND))} AS b{i}" for i, s in enumerate(specs)],
    )

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            first, second = np.column_stack(columns[1 : size + 1]), np.column_stack(columns[size + 1 :])
            scores = (np.sqrt(-2.0 * np.log(first)) * np.cos(2.0 * np.pi * second)) @ factor.T
            out = np.where(normal, scores, cdf_array(scores))
            arrays = [batch.column(0), *(pa.array(np.ascontiguousarray(out[:, i])) for i in range(size))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", *names])

    return pairs.mapInArrow(mix, ", ".join(["row bigint", *(f"{n} double" for n in names)]))


def _between_knots_sql(u: str, knots: list[float], smooth: bool) -> str:
    """Inverse of the quantile grid at ``u``: the knot below, or a point between two knots."""
    grid, last = doubles_sql(knots), len(knots) - 1
    if not smooth:
        return f"get({grid}, int(least(floor({u} * {len(knots)}D), {last})))"
    at = f"({u} * {last}D)"
    i = f"int(least(floor({at}), {last - 1}))"
    low, high = f"get({grid}, {i})", f"get({grid}, {i} + 1)"
    return f"({low} + ({at} - {i}) * ({high} - {low}))"


def _number_sql(spec: dict[str, Any], model: Model) -> str:
    u, grid = f"u{spec['position']}", model.quantiles.get(spec["column"])
    if spec["marginal"] == "norm":
        value = f"({spec['mean']!r}D + {spec['std']!r}D * n{spec['position']})"
    elif not grid:
        return "double(NULL)"
    elif grid[0] == grid[-1]:
        value = f"{grid[0]!r}D"
    else:
        value = _between_knots_sql(u, grid, smooth=len(set(grid)) > len(grid) // 2)
    if spec["digits"] is not None:
        value = to_digits_sql(value, spec["digits"])
    if spec["min"] is None or wants_words(spec):
        return value
    return f"greatest(least({value}, {spec['max']!r}D), {spec['min']!r}D)"


def _entry_sql(u: str, entries: list[tuple[str, int]]) -> str:
    """The category whose interval holds ``floor(u * total)``."""
    total = entries[-1][1]
    if len(entries) <= CASE_ENTRIES:  # below a whole number is where the floor is
        steps = [f"WHEN {u} * {float(total)!r}D < {float(hi)!r}D THEN {i}" for i, (_, hi) in enumerate(entries[:-1])]
        found = f"CASE {' '.join(steps)} ELSE {len(steps)} END" if steps else "0"
        return f"get({array_sql([v for v, _ in entries], 'string')}, {found})"
    point = f"least(floor({u} * {float(total)!r}D), {total - 1}L)"
    place = count_at_most_sql(longs_sql([hi for _, hi in entries]), len(entries), "point")
    return f"transform(array({point}), point -> get({array_sql([v for v, _ in entries], 'string')}, {place}))[0]"  # drawn once, not per step


def _buckets(mine: DataFrame, entries: int) -> tuple[list[int], list[int]]:
    """Where segments of about equally many entries begin, and the bucket width in each.

    Frequent categories come first, so a bucket of a fixed width would hold ever more
    entries towards the rare end. Within a segment the counts are alike.
    """
    segments = max(1, min(SEGMENTS, entries // BUCKET_ROWS))
    shares = [i / segments for i in range(segments)]
    cuts = mine.agg(F.percentile_approx("lo", shares, 10 * SEGMENTS).alias("lo"), F.max("hi").alias("total")).first()
    starts = sorted({0, *cuts["lo"]})
    ends = [*starts[1:], cuts["total"]]
    per_segment = max(1, entries // len(starts))
    return starts, [max(1, (end - start) * BUCKET_ROWS // max(per_segment, BUCKET_ROWS)) for start, end in zip(starts, ends)]


def _bucket_sql(point: str, starts: list[int], widths: list[int], segment: str | None = None) -> tuple[str, str]:
    """Segment of a position, and its bucket within the segment (a column, if ``segment`` names one that holds it).

    Neither is ever null: a join's filter for nulls would redo the search, with the draw in each of its steps.
    """
    found = f"coalesce({count_at_most_sql(longs_sql(starts), len(starts), point)} - 1, 0)"
    at = segment or found
    return found, f"coalesce(({point} - get({longs_sql(starts)}, {at})) div get({longs_sql(widths)}, {at}), 0L)"


def _join_entries(sample: DataFrame, model: Model, spec: dict[str, Any], out: str) -> DataFrame:
    """Adds ``out``: the category of each row, by an interval join for large category tables.

    Positions and intervals are cut into buckets that hold about ``BUCKET_ROWS`` entries;
    a frequent category spreads over many buckets, and no interval leaves its segment.
    """
    total = spec["total"]
    mine = model.categories.where(F.col("column") == spec["column"]).select(F.col("value").alias(out), "lo", "hi")
    starts, widths = _buckets(mine, spec["entries"])
    point = F.least(F.floor(F.col(f"u{spec['position']}") * F.lit(float(total))), F.lit(total - 1)).cast("long")
    segment, bucket = _bucket_sql("point", starts, widths, "segment")
    placed = sample.withColumn("point", point).withColumn("segment", F.expr(segment)).withColumn("bucket", F.expr(bucket))
    segment, first = _bucket_sql("lo", starts, widths, "segment")
    _, last = _bucket_sql("hi - 1", starts, widths, "segment")
    intervals = mine.withColumn("segment", F.expr(segment)).withColumn("bucket", F.expr(f"explode(sequence({first}, {last}))"))
    if fits_broadcast(mine):  # at most one extra row per BUCKET_ROWS categories
        intervals = F.broadcast(intervals)
    hit = (F.col("lo") <= F.col("point")) & (F.col("point") < F.col("hi"))
    same = (F.col("s.segment") == F.col("i.segment")) & (F.col("s.bucket") == F.col("i.bucket"))
    return placed.alias("s").join(intervals.alias("i"), same & hit).select(*[F.col(f"s.{c}") for c in sample.columns], out)


def _points_sql(count: str, total: int, draws, stream: int) -> str:
    """An array of ``count`` positions below ``total``; the row's part of the draws is made once, not once per place."""
    draw = draws.uniform_of_key_sql("key", f"(bigint(i) * {STREAMS * 1009}L + {stream}L)")
    points = f"transform(sequence(1, {count}), i -> least(floor({draw} * {float(total)!r}D), {total - 1}L))"
    return f"transform(array({draws.key_sql('row')}), key -> {points})[0]"


def _invented_text_sql(spec: dict[str, Any], model: Model, lengths: list[tuple[str, int]], draws) -> str:
    stream, total = _stream(spec, TEXT), lengths[-1][1]
    count = f"greatest(int(round({_number_sql(spec, model)})), 1)"
    place = count_at_most_sql(longs_sql([hi for _, hi in lengths]), len(lengths), "point")
    # In steps, so that each word's draw is made and its length searched once, and letters are put in for the whole text.
    sizes = f"transform({_points_sql(count, total, draws, stream)}, point -> get({longs_sql([int(v) for v, _ in lengths])}, {place}))"
    words = f"transform({sizes}, (size, i) -> {invented_digits_sql('row', 'i', 'size', stream, draws.seed)})"
    return letters_sql(f"array_join({words}, ' ')")


def _bytes_sql(spec: dict[str, Any], model: Model, draws) -> str:
    """As many bytes as the length says, each drawn by the frequency of its value."""
    entries, total = model.literals[spec["column"]], spec["total"]
    points = _points_sql("size", total, draws, _stream(spec, TEXT))
    place = count_at_most_sql(longs_sql([hi for _, hi in entries]), len(entries), "point")
    texts = f"transform({points}, point -> get({array_sql([v for v, _ in entries], 'string')}, {place}))"
    size = f"int(round({_number_sql(spec, model)}))"
    return f"transform(array({size}), size -> if(size < 1, X'', unhex(array_join({texts}, ''))))[0]"


def _join_words(sample: DataFrame, model: Model, spec: dict[str, Any], out: str, draws) -> DataFrame:
    """Adds ``out``: the text of each row, for columns of more word lengths than a literal holds.

    The same draws as ``_invented_text_sql``, word by word in an exploded table: lengths
    are joined by their intervals, and the words regrouped by row.
    """
    stream = _stream(spec, TEXT)
    count = f"greatest(int(round({_number_sql(spec, model)})), 1)"
    draw = draws.uniform_sql("row", f"(bigint(place) * {STREAMS * 1009}L + {stream}L)")
    places = sample.select("row", F.expr(f"explode(sequence(1, {count}))").alias("place"), F.lit(spec["column"]).alias("label"))
    mine = model.categories.where(F.col("column") == spec["column"]).select(F.col("column").alias("label"), F.col("value").alias("text"), "lo", "hi")
    sized = Frequencies.of(mine).draw(places, draw)
    word = F.expr(invented_word_sql("row", "place - 1", "int(text)", stream, draws.seed))
    listed = sized.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", word.alias("word")))).alias("words"))
    texts = listed.select("row", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias(out))
    return sample.join(texts, "row", "left")


def sample_rows(
    model: Model, rows: DataFrame, seed: int = 0, rng: str = "hash", keep_row: bool = False, row_name: str = "row"
) -> DataFrame:
    """One synthetic row per value of ``rows.row`` (a bigint, each value once); ``keep_row`` returns it as ``row_name``."""
    draws = make_draws(rng, seed)
    joint = copula_columns(model) if model.correlation else []
    uniforms = _uniforms(model, rows.select(F.col("row").cast("long")), draws, joint)
    large = [
        s for s in model.columns
        if s["entries"] and s["column"] not in model.literals and not wants_words(s)
    ]
    large += [p for p in model.patterns if p["column"] not in model.literals]
    for s in large:
        uniforms = _join_entries(uniforms, model, s, f"v{s['position']}")
    worded = [s for s in model.columns if s["entries"] and wants_words(s) and s["column"] not in model.literals]
    for s in worded:
        uniforms = _join_words(uniforms, model, s, f"v{s['position']}", draws)
    joined = {s["column"] for s in (*large, *worded)}
    nulls: dict[str, str] = {}  # column: SQL of whether the row's pattern has it null
    for p in model.patterns:
        mask = f"v{p['position']}" if p["column"] in joined else _entry_sql(f"u{p['position']}", model.literals[p["column"]])
        uniforms = uniforms.withColumn(f"nulls{p['position']}", F.expr(mask))
        nulls |= {name: f"substring(nulls{p['position']}, {i + 1}, 1) = '1'" for i, name in enumerate(p["members"])}

    def text(spec: dict[str, Any]) -> str:
        name, p = spec["column"], spec["position"]
        return f"v{p}" if name in joined else _entry_sql(f"u{p}", model.literals[name])

    def value(spec: dict[str, Any], dtype: T.DataType) -> Column:
        name, kind = spec["column"], spec["kind"]
        if kind in ("numeric", "datetime"):
            return _with_infinities(from_number(F.expr(_number_sql(spec, model)), dtype), spec, dtype, draws)
        if kind in ("categorical", "boolean") and spec["entries"]:
            return F.expr(text(spec))
        if kind == "id" and isinstance(dtype, T.StringType) and spec["entries"]:
            return F.expr(numbered_shape_sql(text(spec), "row"))
        if kind == "id":
            return F.expr(f"cast({int(spec['min'] or 0)} as decimal(20,0)) + cast(row as decimal(19,0))").try_cast(dtype)
        if kind == "bytes":
            return F.expr(_bytes_sql(spec, model, draws)) if spec["entries"] else F.lit(b"")
        if kind == "text" and wants_words(spec) and spec["entries"]:
            return F.col(f"v{spec['position']}") if name in joined else F.expr(_invented_text_sql(spec, model, model.literals[name], draws))
        if kind == "text" and spec["entries"]:
            return F.expr(fill_shape_sql(text(spec), "row", draws, _stream(spec, TEXT)))
        return F.lit(None)

    def cell(spec: dict[str, Any]) -> Column:
        dtype = type_of(spec)
        made = value(spec, dtype)
        rate = spec["empty"] / spec["cells"] if spec["cells"] else 1.0
        if spec["column"] in nulls:
            made = F.when(~F.expr(nulls[spec["column"]]), made)
        elif rate > 0 and spec["kind"] != "carried":
            made = F.when(F.expr(f"{draws.uniform_sql('row', _stream(spec, MISSING))} >= {rate!r}D"), made)
        return made.cast(dtype)

    chosen = [c.alias(s["column"]) for c, s in zip(apart([cell(s) for s in model.columns]), model.columns)]
    return uniforms.select(F.col("row").alias(row_name), *chosen) if keep_row else uniforms.select(*chosen)


def _with_infinities(value: Column, spec: dict[str, Any], dtype: T.DataType, draws) -> Column:
    """The infinities keep their shares of the filled cells, drawn apart from the finite values."""
    filled = spec["cells"] - spec["empty"]
    if not filled or not (spec["minus"] or spec["plus"]):
        return value
    u = F.expr(draws.uniform_sql("row", _stream(spec, ENDLESS)))
    minus, plus = spec["minus"] / filled, spec["plus"] / filled
    below, above = F.lit(float("-inf")).cast(dtype), F.lit(float("inf")).cast(dtype)
    return F.when(u < minus, below).when(u < minus + plus, above).otherwise(value)


def sample(model: Model | None, n: int, seed: int = 0, rng: str = "hash") -> DataFrame:
    """``n`` synthetic flat rows with the columns and types the model was fitted on."""
    if model is None:
        raise RuntimeError("no fitted model; call fit first")
    if n <= 0:
        raise ValueError("the number of rows must be positive")
    spark = model.spark
    return sample_rows(model, numbered_rows(spark, n), seed, rng)


def numbered_rows(spark, n: int) -> DataFrame:
    """``row`` from 0 on, dealt over enough tasks."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK))
    return spark.range(0, n, 1, tasks).select(F.col("id").alias("row"))
