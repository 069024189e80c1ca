"""Sampling. As many rows as the table that was learnt from; draws that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.draws import PowerDraws
from facsimile.functions.normal import cdf_sql
from facsimile.functions.text import HEX, HEX_AS_LETTERS, STRIDE, fill_shape_sql, shape_sql
from facsimile.functions.epoch import epoch_micros
from facsimile.operators.model import PATTERN_POSITION, fit
from facsimile.operators.sample import MISSING, SECOND, STREAMS, TEXT, VALUE, numbered_rows, sample, sample_rows
from facsimile.operators.synthesize import ROW, Synthesizer, conform_sample
from facsimile.session import settle
from workloads.common import draws_sql, millionths, millionths_sql, order_nested, read
from workloads.model import CHARGED, knots_sql, score_sql

KNOTS = 1001


def _sample(spark, df, **options):
    """A power-draw sample with its row numbers, as many rows as ``df`` has."""
    model = fit(df, exact=True, independent=True, **options)
    return sample_rows(model, numbered_rows(spark, df.count()), rng="power", keep_row=True)


def sample_category(spark, sf_dir):
    return _sample(spark, read(spark, sf_dir, "customer").select("c_mktsegment"))


def sample_many_categories(spark, sf_dir):
    """More categories than fit a literal: the interval join."""
    parts = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("part"))
    return _sample(spark, parts, overrides={"part": "categorical"})


def sample_numeric(spark, sf_dir):
    out = _sample(spark, read(spark, sf_dir, "lineitem").select("l_extendedprice"))
    return out.select("row", millionths(F.col("l_extendedprice")).alias("price_e6"))


def sample_steps(spark, sf_dir):
    """Few distinct values: only observed ones come back."""
    out = _sample(spark, read(spark, sf_dir, "lineitem").select("l_linenumber", "l_discount"))
    return out.select("row", "l_linenumber", millionths(F.col("l_discount")).alias("discount_e6"))


def sample_datetime(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderdate")
    out = _sample(spark, orders)
    return out.select("row", epoch_micros("o_orderdate", out.schema["o_orderdate"].dataType).alias("us"))


def sample_bounds(spark, sf_dir):
    """A normal marginal reaches beyond the data; the sample does not."""
    out = _sample(spark, read(spark, sf_dir, "lineitem").select("l_quantity"), marginal="norm")
    return out.select("row", F.col("l_quantity").cast("long").alias("quantity"))


def sample_nulls(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    gaps = orders.select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("priority"))
    return _sample(spark, gaps)


def sample_null_patterns(spark, sf_dir):
    """Columns that are null together are so in the sample: the row's pattern is drawn first."""
    key = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders").select(
        F.when(key % 5 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when((key % 5 != 0) & (key % 3 != 0), F.col("o_orderstatus")).alias("status"),
        F.when(key % 7 != 0, (key % 4).cast("string")).alias("part"),
    )
    return _sample(spark, orders)


def sample_ids(spark, sf_dir):
    return _sample(spark, read(spark, sf_dir, "customer").select("c_custkey", "c_name"))


def sample_pair(spark, sf_dir):
    """Two dependent columns through the copula, draw by draw."""
    lines = read(spark, sf_dir, "lineitem").select(
        "l_quantity", (F.col("l_quantity") * (1 + F.col("l_tax") * 10)).alias("charge")
    )
    model = fit(lines, exact=True)
    out = sample_rows(model, spark.range(lines.count()).select(F.col("id").alias("row")), rng="power", keep_row=True)
    return out.select("row", F.col("l_quantity").cast("long").alias("quantity"), millionths(F.col("charge")).alias("charge_e6"))


def sample_joint(spark, sf_dir):
    """Correlated columns; the dependence is tested against tolerances in the tests."""
    lines = read(spark, sf_dir, "lineitem")
    lines = lines.withColumn("charge", F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    return sample(fit(lines), lines.count(), seed=7)


def sample_documents(spark, sf_dir):
    """Long texts as invented words, short ones as categories."""
    docs = read(spark, sf_dir, "documents")
    out = sample(fit(docs), docs.count(), seed=7)
    return out.select("doc_id", "lang", "source", F.length("text").alias("length"), F.md5("text").alias("text_md5"))


def sample_texts(spark, sf_dir):
    """Invented words: their number and lengths follow the texts, draw by draw."""
    out = _sample(spark, read(spark, sf_dir, "documents").select("text"), overrides={"text": "text"})
    return out.select("row", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("length"))


def synthesize_nested(spark, sf_dir):
    """Flatten, fit, sample, unflatten: nested orders in, nested orders out, row by row."""
    df = order_nested(spark, sf_dir)
    maker = Synthesizer(exact=True, independent=True).fit(df)
    made = maker.sample_rows(numbered_rows(spark, df.count()), rng="power")
    item = lambda x: F.when(x.isNull(), "-").otherwise(F.concat_ws(":", x["line"], x["part"], millionths(x["price"])))
    return made.select(
        F.col(f"`{ROW}`").alias("row"), "o_orderkey", F.col("head.o_orderstatus").alias("status"), millionths(F.col("head.total")).alias("total_e6"),
        F.array_join("head.tags", "|").alias("tags"), F.array_join(F.transform("items", item), "|").alias("items"),
    )


def synthesize_facts(spark, sf_dir):
    """What holds of every synthesis of the nested orders, however it was drawn; shares to two points in a hundred."""
    df = order_nested(spark, sf_dir).withColumn("odd", F.when(F.col("o_orderkey") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("head.total")))
    rows = df.count()
    made = settle(Synthesizer().fit(df).sample(rows, seed=11), "made")  # drawn once; each fact reads its columns
    known = df.select("head.o_orderstatus").distinct()
    bounds = df.agg(F.min("head.total").alias("low"), F.max("head.total").alias("high"))
    strange = made.select("head.o_orderstatus").distinct().join(known, "o_orderstatus", "left_anti").count()
    outside = made.join(bounds).filter("head.total < low OR head.total > high").count()
    alike = ("items IS NULL", "size(items) = 0", "odd = double('Infinity')", "get(items, 0) IS NULL AND size(items) > 0", "size(items) > 3")
    shares = lambda t, *more: t.agg(*[F.avg(F.expr(c).cast("int")) for c in alike], *more).first()
    *of_made, drawn, longest = shares(made, F.count(F.lit(1)), F.max(F.size("items")))
    of_df = shares(df)
    facts = {
        "schema": made.schema.simpleString() == df.schema.simpleString(),
        "rows": drawn == rows,
        "keys": made.select("o_orderkey").distinct().count() == rows,
        "states": strange == 0,
        "totals": outside == 0,
        "longest": longest <= 5,
    }
    facts |= {c: abs(a - b) < 0.02 for c, a, b in zip(alike, of_made, of_df)}
    return spark.createDataFrame(list(facts.items()), "fact string, holds boolean").crossJoin(made.agg(F.count(F.lit(1)).alias("rows")))


def synthesize_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html", F.split("url", "/").alias("parts"))
    return Synthesizer(marginal="ecdf").fit(pages).sample(pages.count(), seed=7)


def document_shapes(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.md5(F.expr(shape_sql("text"))).alias("shape"), F.length("text").cast("long").alias("length")
    )


def text_mask(spark, sf_dir):
    """Addresses with every letter and digit replaced; punctuation stays."""
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", F.expr(fill_shape_sql(shape_sql("url"), "page_id", PowerDraws(), 5)).alias("url"))


def conform_types(spark, sf_dir):
    """Sampled text columns back to the types of the fitted table."""
    orders = read(spark, sf_dir, "orders")
    loose = orders.select(
        F.concat(F.lit("x"), "o_orderkey").alias("o_orderstatus"),
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("?")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
    )
    schema = T.StructType.fromDDL(
        "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string, o_comment string"
    )
    lenient = conform_sample(loose, schema)
    strict = conform_sample(loose, schema, widen=True, on_failure="string")
    return lenient.select(
        "o_orderkey", "o_custkey", millionths(F.col("o_totalprice")).alias("price_e6"), "o_orderstatus", "o_comment"
    ).join(
        strict.select(
            "o_orderkey", F.typeof("o_custkey").alias("custkey_type"), F.typeof("o_totalprice").alias("price_type")
        ),
        "o_orderkey",
    )


QUERIES = {f.__name__: f for f in (
    sample_category, sample_many_categories, sample_numeric, sample_steps, sample_datetime, sample_bounds, sample_nulls, sample_null_patterns,
    sample_ids, sample_pair, sample_joint, sample_documents, sample_texts, synthesize_nested, synthesize_facts, synthesize_pages, document_shapes, text_mask, conform_types,
)}


# --- checks -------------------------------------------------------------------------


def _rows(table: str) -> str:
    return f"(SELECT unnest(range(count(*))) AS row FROM {table})"


def _category_sql(table: str, value: str, name: str, extra: str = "TRUE", null_rate: str = "0.0") -> str:
    drawn = draws_sql(_rows(table), "row", {"u": VALUE, "m": MISSING}, "row")
    return f"""
        WITH f AS (SELECT {value} AS v, count(*) AS c FROM {table} WHERE {extra} GROUP BY 1),
        k AS (SELECT v, c, sum(c) OVER (ORDER BY c DESC, v) AS hi, sum(c) OVER () AS total FROM f),
        d AS (SELECT row, u, m, (SELECT any_value(total) FROM k) AS total FROM {drawn})
        SELECT row, CASE WHEN m >= {null_rate} THEN v END AS {name}
        FROM (SELECT row, m, least(floor(u * total), total - 1)::BIGINT AS p FROM d) JOIN k ON hi - c <= p AND p < hi"""


def _grid_sql(column: str, table: str) -> str:
    return f"(SELECT array_agg(value ORDER BY i) AS g, min(value) AS lo, max(value) AS hi FROM ({knots_sql(column, table, KNOTS)}))"


def _smooth_sql(column: str, table: str, digits: int | None = None) -> str:
    drawn = draws_sql(_rows(table), "row", {"u": VALUE}, "row")
    last = KNOTS - 1
    value = "g[i + 1] + (spot - i) * (g[i + 2] - g[i + 1])"
    value = f"round_even(({value}) * 1e{digits}, 0) / 1e{digits}" if digits is not None else value
    return f"""
        SELECT row, greatest(least({value}, hi), lo) AS v FROM
        (SELECT *, least(floor(spot), {last - 1})::BIGINT AS i FROM (SELECT row, u * {last}.0::DOUBLE AS spot FROM {drawn})),
        {_grid_sql(column, table)}"""


def _pattern_value_sql(name: str, position: int) -> str:
    drawn = draws_sql(_rows("orders"), "row", {"u": position * STREAMS + VALUE}, "row")
    return f"""
        SELECT row, v AS {name} FROM (SELECT row, least(floor(u * total), total - 1)::BIGINT AS p FROM {drawn}, (SELECT count({name}) AS total FROM o))
        JOIN (SELECT v, c, sum(c) OVER (ORDER BY c DESC, v) AS hi FROM (SELECT {name} AS v, count(*) AS c FROM o WHERE {name} IS NOT NULL GROUP BY 1))
        ON hi - c <= p AND p < hi"""


STEP_DRAWS = draws_sql(_rows("lineitem"), "row", {"u0": VALUE, "u1": STREAMS + VALUE}, "row")
PAIR_DRAWS = draws_sql(
    _rows("lineitem"), "row", {"a0": VALUE, "b0": SECOND, "a1": STREAMS + VALUE, "b1": STREAMS + SECOND}, "row"
)
NORMAL_DRAWS = draws_sql(_rows("lineitem"), "row", {"a": VALUE, "b": SECOND}, "row")
MASK_DRAWS = draws_sql("chars", "page_id", {"u": f"(i * {STRIDE} + 5)"}, "page_id, i, ch")


def _step(u: str, grid: str) -> str:
    return f"{grid}[least(floor({u} * {KNOTS}.0::DOUBLE), {KNOTS - 1})::BIGINT + 1]"


class _FlatSql:
    """Common tables that draw the flat columns of a fit: position by position, like the model."""

    def __init__(self, table: str, source: str):
        self.table, self.source, self.tables, self.positions = table, source, [], []

    def category(self, position: int, value: str, where: str = "true") -> None:
        p = position
        self.positions.append(p)
        self.tables.append(f"""
        f{p} AS (SELECT v, c, sum(c) OVER (ORDER BY c DESC, v) AS hi FROM (SELECT {value} AS v, count(*) AS c FROM o WHERE {where} GROUP BY 1)),
        v{p} AS MATERIALIZED (SELECT row, v AS x{p} FROM (SELECT row, least(floor(u{p} * t), t - 1)::BIGINT AS q FROM d, (SELECT max(hi) AS t FROM f{p})) JOIN f{p} ON hi - c <= q AND q < hi)""")

    def number(self, position: int, value: str, where: str = "true", whole: bool = False) -> None:
        p, last = position, KNOTS - 1
        self.positions.append(p)
        low = f"least(floor(u{p} * {last}.0::DOUBLE), {last - 1})::BIGINT"
        between = f"g[{low} + 1] + (u{p} * {last}.0::DOUBLE - {low}) * (g[{low} + 2] - g[{low} + 1])"
        drawn = f"CASE WHEN smooth THEN {between} ELSE {_step(f'u{p}', 'g')} END"
        digits = "any_value(NULL::INTEGER)" if whole else "CASE " + " ".join(f"WHEN bool_and(round_even(w * 1e{s}, 0) / 1e{s} = w) THEN {s}" for s in range(5)) + " END"
        cut = f"CASE WHEN digits IS NULL THEN {drawn} ELSE round_even(({drawn}) * 10.0::DOUBLE ** digits, 0) / 10.0::DOUBLE ** digits END"
        self.tables.append(f"""
        n{p} AS MATERIALIZED (SELECT ({value})::DOUBLE AS w FROM o WHERE {where}),
        g{p} AS MATERIALIZED (SELECT g, smooth, lo, hi, digits FROM
                 (SELECT array_agg(value ORDER BY i) AS g, count(DISTINCT value) > {KNOTS // 2} AS smooth, min(value) AS lo, max(value) AS hi FROM ({knots_sql("w", f"n{p}", KNOTS)})),
                 (SELECT {digits} AS digits FROM n{p})),
        v{p} AS MATERIALIZED (SELECT row, {'round(' if whole else ''}greatest(least({cut}, hi), lo){')::BIGINT' if whole else ''} AS x{p} FROM d, g{p})""")

    def sql(self, chosen: str) -> str:
        drawn = draws_sql(_rows(self.table), "row", {f"u{p}": p * STREAMS + VALUE for p in self.positions}, "row")
        first, *rest = self.positions
        joined = f"v{first} " + " ".join(f"JOIN v{p} USING (row)" for p in rest)
        return f"WITH o AS MATERIALIZED ({self.source}), d AS MATERIALIZED (SELECT * FROM {drawn}),{','.join(self.tables)} SELECT {chosen} FROM {joined}"


def _nested_sql() -> str:
    flat = _FlatSql("orders", """
        SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS total, o_custkey AS c, regexp_split_to_array(o_orderpriority, '[- ]') AS tags FROM orders""")
    flat.category(1, "status")
    flat.number(2, "total")
    flat.category(3, "(k % 5 = 0)::VARCHAR")
    flat.number(4, "len(tags)", "k % 5 <> 0", whole=True)
    for i in range(3):
        flat.category(5 + i, f"tags[{i + 1}]", f"k % 5 <> 0 AND len(tags) > {i}")
    flat.category(8, "(k % 7 = 0)::VARCHAR")
    flat.number(9, "k % 6", "k % 7 <> 0", whole=True)
    items = []
    for i in range(5):
        p, there, filled = 10 + 4 * i, f"k % 7 <> 0 AND k % 6 > {i}", "true" if i else "k % 11 <> 0"
        flat.category(p, f"(NOT ({filled}))::VARCHAR", there)
        flat.number(p + 1, str(i + 1), f"{there} AND {filled}", whole=True)
        flat.number(p + 2, f"(c + k * {i + 1}) % 1000", f"{there} AND {filled}", whole=True)
        flat.number(p + 3, f"total * {i + 1}", f"{there} AND {filled}")
        made = f"x{p + 1} || ':' || x{p + 2} || ':' || {millionths_sql(f'x{p + 3}')}"
        items.append(f"CASE WHEN x9 > {i} THEN CASE WHEN x{p} = 'true' THEN '-' ELSE {made} END END")
    return flat.sql(f"""
        row, row + (SELECT min(k) FROM o) AS o_orderkey, x1 AS status, {millionths_sql('x2')} AS total_e6,
        CASE WHEN x3 = 'false' THEN concat_ws('|', {', '.join(f'CASE WHEN x4 > {i} THEN x{5 + i} END' for i in range(3))}) END AS tags,
        CASE WHEN x8 = 'false' THEN concat_ws('|', {', '.join(items)}) END AS items""")


WORDS = r"(SELECT len(regexp_split_to_array(trim(text), '\s+')) AS w FROM documents)"
COUNT_DRAWS = draws_sql(_rows("documents"), "row", {"u": VALUE}, "row")
WORD_DRAWS = draws_sql("places", "row", {"u": f"(i * {STREAMS * 1009} + {TEXT})"}, "row, i")

UPPER, LOWER, DIGITS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'", "'0123456789'"

ORACLES = {
    "sample_category": _category_sql("customer", "c_mktsegment", "c_mktsegment"),
    "sample_many_categories": _category_sql("lineitem", "'P' || l_partkey", "part"),
    "sample_numeric": f"SELECT row, {millionths_sql('v')} AS price_e6 FROM ({_smooth_sql('l_extendedprice', 'lineitem', 2)})",
    "sample_steps": f"""
        SELECT row, {_step('u0', 'a.g')}::INTEGER AS l_linenumber, {millionths_sql(_step('u1', 'b.g'))} AS discount_e6
        FROM {STEP_DRAWS}, {_grid_sql('l_linenumber', 'lineitem')} a, {_grid_sql('l_discount', 'lineitem')} b""",
    "sample_datetime": f"SELECT row, round(v)::BIGINT AS us FROM "
    f"({_smooth_sql('us', '(SELECT epoch_us(o_orderdate) AS us FROM orders)')})",
    "sample_bounds": f"""
        SELECT row, greatest(least(round_even(mean + std * sqrt(-2.0 * ln(a)) * cos(6.283185307179586 * b), 0), hi), lo)::BIGINT AS quantity
        FROM {NORMAL_DRAWS},
        (SELECT avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)""",
    "sample_pair": f"""
        WITH r AS (SELECT corr(a.z, b.z) AS r FROM {CHARGED} l JOIN ({score_sql('l_quantity', KNOTS)}) a ON a.v = l.l_quantity
                   JOIN ({score_sql('charge', KNOTS)}) b ON b.v = l.charge),
        z AS (SELECT row, sqrt(-2.0 * ln(a0)) * cos(6.283185307179586 * b0) AS z0,
                     sqrt(-2.0 * ln(a1)) * cos(6.283185307179586 * b1) AS z1 FROM {PAIR_DRAWS}),
        c AS (SELECT row, z0 AS c0, r * z0 + sqrt(1 - r * r) * z1 AS c1 FROM z, r),
        u AS (SELECT row, {cdf_sql('c0')} AS u0, {cdf_sql('c1')} AS u1 FROM c)
        SELECT row, {_step('u0', 'a.g')}::BIGINT AS quantity, {millionths_sql(_step('u1', 'b.g'))} AS charge_e6
        FROM u, {_grid_sql('l_quantity', 'lineitem')} a, {_grid_sql('charge', CHARGED)} b""",
    "synthesize_nested": _nested_sql(),
    "synthesize_facts": """
        SELECT f AS fact, true AS holds, (SELECT count(*) FROM orders) AS rows
        FROM (VALUES ('schema'), ('rows'), ('keys'), ('states'), ('totals'), ('longest'), ('items IS NULL'), ('size(items) = 0'),
                     ('odd = double(''Infinity'')'), ('get(items, 0) IS NULL AND size(items) > 0'), ('size(items) > 3')) AS v(f)""",
    "sample_nulls": _category_sql(
        "orders", "o_orderpriority", "priority", "o_orderkey % 5 <> 0",
        "(SELECT count_if(o_orderkey % 5 = 0)::DOUBLE / count(*) FROM orders)"),
    "sample_null_patterns": f"""
        WITH o AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority,
                          CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 THEN o_orderstatus END AS status,
                          CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 4)::VARCHAR END AS part FROM orders),
        n AS (SELECT name, place FROM (SELECT name, row_number() OVER (ORDER BY nulls, i) AS place FROM (
              SELECT 'priority' AS name, 0 AS i, count_if(priority IS NULL) AS nulls FROM o UNION ALL
              SELECT 'status', 1, count_if(status IS NULL) FROM o UNION ALL SELECT 'part', 2, count_if(part IS NULL) FROM o))),
        p AS (SELECT array_to_string(list_sort([(SELECT place FROM n WHERE name = 'priority') * 10 + (priority IS NULL)::INT,
              (SELECT place FROM n WHERE name = 'status') * 10 + (status IS NULL)::INT,
              (SELECT place FROM n WHERE name = 'part') * 10 + (part IS NULL)::INT]), ',') AS coded FROM o),
        f AS (SELECT coded[2:2] || coded[5:5] || coded[8:8] AS v, count(*) AS c FROM p GROUP BY 1),
        k AS (SELECT v, c, sum(c) OVER (ORDER BY c DESC, v) AS hi, sum(c) OVER () AS total FROM f),
        d AS (SELECT row, u FROM {draws_sql(_rows("orders"), "row", {"u": f"{PATTERN_POSITION * STREAMS + VALUE}::BIGINT"}, "row")}),
        m AS (SELECT row, v FROM (SELECT row, least(floor(u * total), total - 1)::BIGINT AS p FROM d, (SELECT any_value(total) AS total FROM k))
              JOIN k ON hi - c <= p AND p < hi),
        a AS ({_pattern_value_sql("priority", 0)}), b AS ({_pattern_value_sql("status", 1)}), e AS ({_pattern_value_sql("part", 2)})
        SELECT m.row, {", ".join(f"CASE WHEN substr(m.v, (SELECT place FROM n WHERE name = '{c}'), 1) = '0' THEN {t}.{c} END AS {c}" for c, t in (("priority", "a"), ("status", "b"), ("part", "e")))}
        FROM m JOIN a ON a.row = m.row JOIN b ON b.row = m.row JOIN e ON e.row = m.row""",
    "sample_ids": f"SELECT row, row + (SELECT min(c_custkey) FROM customer) AS c_custkey, "
    f"'Aaaaaaaa#' || lpad(row::VARCHAR, 9, '0') AS c_name FROM {_rows('customer')}",
    "sample_texts": f"""
        WITH grid AS (SELECT array_agg(value ORDER BY i) AS g, count(DISTINCT value) > {KNOTS // 2} AS smooth
                      FROM ({knots_sql('w', WORDS, KNOTS)})),
        spots AS (SELECT row, u, u * {KNOTS - 1}.0::DOUBLE AS spot FROM {COUNT_DRAWS}),
        counts AS (SELECT row, greatest(round(CASE WHEN smooth THEN g[i + 1] + (spot - i) * (g[i + 2] - g[i + 1])
                                              ELSE {_step('u', 'g')} END)::INTEGER, 1) AS n
                   FROM (SELECT *, least(floor(spot), {KNOTS - 2})::BIGINT AS i FROM spots), grid),
        places AS (SELECT row, unnest(range(1, n + 1)) AS i FROM counts),
        lengths AS (SELECT length(w) AS size, count(*) AS c
                    FROM (SELECT unnest(regexp_split_to_array(trim(text), '\\s+')) AS w FROM documents) GROUP BY 1),
        ends AS (SELECT size, c, sum(c) OVER (ORDER BY c DESC, size::VARCHAR) AS hi, sum(c) OVER () AS total FROM lengths),
        drawn AS (SELECT row, i, least(floor(u * total), total - 1)::BIGINT AS p
                  FROM {WORD_DRAWS}, (SELECT any_value(total) AS total FROM ends)),
        made AS (SELECT row, i, translate(substr(repeat(md5(row || ':' || (i - 1) || ':{TEXT}:0'), ceil(size / 32.0)::INTEGER), 1, size),
                                          '{HEX}', '{HEX_AS_LETTERS}') AS word
                 FROM drawn JOIN ends ON hi - c <= p AND p < hi),
        texts AS (SELECT row, string_agg(word, ' ' ORDER BY i) AS t FROM made GROUP BY row)
        SELECT row, md5(t) AS text_md5, length(t) AS length FROM texts""",
    "document_shapes": r"""
        SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\p{Lu}', 'A', 'g'), '[^\P{L}A]', 'a', 'g'), '\p{Nd}', '9', 'g')) AS shape,
               length(text) AS length FROM documents""",
    "text_mask": f"""
        WITH chars AS (SELECT page_id, unnest(range(length(url))) AS i, substr(url, unnest(range(length(url)))::BIGINT + 1, 1) AS ch FROM pages),
        d AS (SELECT * FROM {MASK_DRAWS}),
        r AS (SELECT page_id, i, CASE
            WHEN regexp_full_match(ch, '\\p{{Lu}}') THEN substr({UPPER}, 1 + floor(u * 26)::INTEGER, 1)
            WHEN regexp_full_match(ch, '\\p{{L}}') THEN substr({LOWER}, 1 + floor(u * 26)::INTEGER, 1)
            WHEN regexp_full_match(ch, '\\p{{Nd}}') THEN substr({DIGITS}, 1 + floor(u * 10)::INTEGER, 1)
            ELSE ch END AS ch FROM d)
        SELECT page_id, string_agg(ch, '' ORDER BY i) AS url FROM r GROUP BY page_id""",
    "conform_types": f"""
        SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS o_custkey,
               CASE WHEN o_orderkey % 9 <> 0 THEN {millionths_sql('o_totalprice')} END AS price_e6,
               'x' || o_orderkey AS o_orderstatus, NULL::VARCHAR AS o_comment, 'double' AS custkey_type, 'string' AS price_type
        FROM orders""",
}
