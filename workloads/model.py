"""Column kinds, profiles, marginals and dependence. Exact variants, as the checks are exact."""

from __future__ import annotations

from pyspark.sql import functions as F

from facsimile.functions.normal import quantile_sql
from facsimile.operators.kinds import column_profile, detect_kinds
from facsimile.operators.model import (
    category_intervals, correlation, fit, normal_scores, quantile_grid, value_ranks, words_sql,
)
from workloads.common import millionths, millionths_sql, order_nested, read
from facsimile.operators.flatten import flatten
from facsimile.operators.state import learn_state
from facsimile.plans.shape import infer_plan
from facsimile.session import scratch_path


def _kinds(df):
    return detect_kinds(df, exact=True).select("column", "kind", "rows", "nulls", "distinct")


def kinds_customer(spark, sf_dir):
    return _kinds(read(spark, sf_dir, "customer"))


def kinds_lineitem(spark, sf_dir):
    return _kinds(read(spark, sf_dir, "lineitem"))


def kinds_documents(spark, sf_dir):
    return _kinds(read(spark, sf_dir, "documents"))


def kinds_sketched(spark, sf_dir):
    """The default, sketched detection; only the kinds are compared."""
    return detect_kinds(read(spark, sf_dir, "orders")).select("column", "kind")


def profile_part(spark, sf_dir):
    return _profile(read(spark, sf_dir, "part"))


def profile_lineitem(spark, sf_dir):
    return _profile(read(spark, sf_dir, "lineitem"))


def profile_flat_orders(spark, sf_dir):
    """Profile of flattened data: nulls that only stand for absent list places are told apart."""
    df = order_nested(spark, sf_dir)
    flat = flatten(df, infer_plan(df, deep=True), lengths=True)
    profile = column_profile(flat)
    return profile.where(F.col("column").rlike(r"^items")).select("column", "rows", "nulls")


def _profile(df):
    """Mean and spread of times in thousands of seconds, so that engines agree on the last digit."""
    unit = F.when(F.col("class") == "time", 1e9).otherwise(1.0)
    return column_profile(df).select(
        "column", "rows", "nulls", "min", "max", F.floor(F.col("mean") / unit * 1e3 + 0.5).alias("mean_e3"),
        F.floor(F.col("std") / unit * 1e3 + 0.5).alias("std_e3"), "max_length", "spaced", "digits",
    )


def category_frequencies(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    cells = {"status": "o_orderstatus", "priority": "o_orderpriority", "customer": "o_custkey"}
    return category_intervals(orders, cells)


def word_lengths(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return category_intervals(docs, {"text": f"transform({words_sql('text')}, w -> length(w))"})


PRICES = ("l_extendedprice", "l_quantity", "l_discount")
KNOTS = 101


def quantile_knots(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    grid = quantile_grid(df, {c: c for c in PRICES}, KNOTS, exact=True)
    return grid.select("column", F.posexplode("knots").alias("i", "value"))


def price_ranks(spark, sf_dir):
    """Exact ranks over all distinct prices, cut into slices."""
    df = read(spark, sf_dir, "lineitem")
    return value_ranks(df, {"l_extendedprice": "l_extendedprice", "l_tax": "l_tax"}, slot_rows=10_000)


SCORED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _scored(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(*SCORED, (F.col("l_quantity") * (1 + F.col("l_tax") * 10)).alias("charge"))
    model = fit(df, exact=True, independent=True, knots=KNOTS)
    return df, model, [*SCORED, "charge"]


def scores(spark, sf_dir):
    df, model, names = _scored(spark, sf_dir)
    z = normal_scores(df, model, names)
    return z.select(*[millionths(F.col(f"z{i}")).alias(n) for i, n in enumerate(names)])


def score_correlation(spark, sf_dir):
    df, model, names = _scored(spark, sf_dir)
    found = correlation(normal_scores(df, model, names), names)
    rows = [(a, b, r) for (a, b), r in found.items()]
    return spark.createDataFrame(rows, "a string, b string, r double").select("a", "b", millionths(F.col("r")).alias("r_e6"))


def correlation_with_gaps(spark, sf_dir):
    """Six columns, some cells null: pairs count where both are set."""
    df = read(spark, sf_dir, "lineitem")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"]
    z = df.select(
        *[
            F.when(F.col("l_orderkey") % (i + 2) != 0, F.col(c).cast("double")).alias(f"z{i}")
            for i, c in enumerate(columns)
        ]
    )
    rows = [(a, b, r) for (a, b), r in correlation(z, columns).items()]
    return spark.createDataFrame(rows, "a string, b string, r double").select("a", "b", millionths(F.col("r")).alias("r_e6"))


def refit_append(spark, sf_dir):
    """Two thirds of the rows are learnt, the rest is appended to what was kept of them: the model of all rows."""
    lines = read(spark, sf_dir, "lineitem")
    columns = ["l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
    old, new = (lines.filter(cut).select(*columns) for cut in ("l_orderkey % 3 <> 0", "l_orderkey % 3 = 0"))
    state = learn_state(old, scratch_path(spark, "state"), exact=True, independent=True)
    model = state.append(new, scratch_path(spark, "state")).model(KNOTS)
    grids = model.quantiles_table().select("column", F.posexplode("knots").alias("place", "number"))
    texts = model.categories.select("column", F.col("lo").cast("int").alias("place"), "value", "hi")
    return grids.unionByName(texts, allowMissingColumns=True).select("column", "place", millionths(F.col("number")).alias("number_e6"), "value", "hi")


QUERIES = {f.__name__: f for f in (
    kinds_customer, kinds_lineitem, kinds_documents, kinds_sketched, profile_part, profile_lineitem, profile_flat_orders,
    category_frequencies, word_lengths, quantile_knots, price_ranks, scores, score_correlation, correlation_with_gaps, refit_append,
)}


# --- checks -------------------------------------------------------------------------


def kinds_sql(table: str, columns: dict[str, str], keep: str = "*") -> str:
    parts = []
    for c, group in columns.items():
        length = f"max(length({c}))" if group == "string" else "0"
        spaced = f"bool_or(contains({c}, ' '))" if group == "string" else "false"
        parts.append(
            f"SELECT '{c}' AS col, '{group}' AS grp, count(*) AS rows, count(*) - count({c}) AS nulls, "
            f"count(DISTINCT {c}) AS dist, {length} AS len, {spaced} AS sp FROM {table}"
        )
    return f"""
        SELECT {keep} FROM (SELECT col AS "column", CASE
            WHEN rows = nulls THEN 'carried' WHEN grp = 'time' THEN 'datetime'
            WHEN grp = 'int' AND nulls = 0 AND dist = rows AND regexp_matches(lower(col), '(id|key)$') THEN 'id'
            WHEN grp IN ('int', 'number') THEN 'numeric'
            WHEN dist = rows - nulls AND len <= 64 AND NOT sp THEN 'id'
            WHEN dist = rows - nulls OR len > 256 THEN 'text'
            WHEN dist <= 1000 OR dist <= rows / 2 THEN 'categorical' ELSE 'text' END AS kind,
            rows, nulls, dist AS "distinct" FROM ({' UNION ALL '.join(parts)}))"""


LINEITEM = {
    "l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "number",
    "l_extendedprice": "number", "l_discount": "number", "l_tax": "number", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "time",
}
CUSTOMER = {"c_custkey": "int", "c_name": "string", "c_nationkey": "int", "c_acctbal": "number", "c_mktsegment": "string"}
DOCUMENTS = {"doc_id": "int", "text": "string", "lang": "string", "source": "string", "n_chars": "int"}
ORDERS = {
    "o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "number", "o_orderdate": "time",
    "o_orderpriority": "string",
}


def profile_sql(table: str, columns: dict[str, str]) -> str:
    parts = []
    for c, group in columns.items():
        number, text = group in ("int", "number"), group == "string"
        if group == "time":
            parts.append(
                f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, "
                f"epoch_us(min({c}))::DOUBLE AS min, epoch_us(max({c}))::DOUBLE AS max, floor(avg(epoch_us({c})) / 1e9 * 1e3 + 0.5)::BIGINT AS mean_e3, "
                f"floor(stddev_samp(epoch_us({c})) / 1e9 * 1e3 + 0.5)::BIGINT AS std_e3, "
                f"NULL::INTEGER AS max_length, false AS spaced, NULL::INTEGER AS digits FROM {table}"
            )
            continue
        digits = "NULL::INTEGER"
        if group == "number":
            tests = " ".join(f"WHEN bool_and(round({c}, {s}) = {c}) THEN {s}" for s in range(5))
            digits = f"(CASE {tests} END)::INTEGER"
        parts.append(
            f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, "
            + (f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, floor(avg({c}) * 1e3 + 0.5)::BIGINT AS mean_e3, "
               f"floor(stddev_samp({c}) * 1e3 + 0.5)::BIGINT AS std_e3, " if number
               else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::BIGINT AS mean_e3, NULL::BIGINT AS std_e3, ")
            + (f"max(length({c}))::INTEGER AS max_length, bool_or(contains({c}, ' ')) AS spaced, " if text
               else "NULL::INTEGER AS max_length, false AS spaced, ")
            + f"{digits} AS digits FROM {table}"
        )
    return " UNION ALL ".join(parts)


def knots_sql(column: str, table: str, knots: int) -> str:
    """Rows (i, value): the value at rank max(1, ceil(i * n / (knots - 1)))."""
    return (
        f"SELECT g.i::INTEGER AS i, r.v AS value FROM range(0, {knots}) AS g(i) "
        f"JOIN (SELECT {column}::DOUBLE AS v, row_number() OVER (ORDER BY {column}) AS rn, count(*) OVER () AS n FROM {table}) r "
        f"ON r.rn = greatest(1, (g.i * r.n + {knots - 2}) // {knots - 1})"
    )


CHARGED = "(SELECT *, l_quantity * (1 + l_tax * 10) AS charge FROM lineitem)"


def score_sql(column: str, knots: int = KNOTS) -> str:
    """Rows (v, z) over the distinct values of a column."""
    return (
        f"SELECT v, {quantile_sql('u')} AS z FROM (SELECT v, greatest(least((a + b) / 2e0, {knots} - 0.5), 0.5) / {knots}::DOUBLE AS u FROM "
        f"(SELECT d.v, count_if(k.value < d.v) AS a, count_if(k.value <= d.v) AS b FROM "
        f"(SELECT DISTINCT {column}::DOUBLE AS v FROM {CHARGED}) d, ({knots_sql(column, CHARGED, knots)}) k GROUP BY d.v))"
    )


NAMES = (*SCORED, "charge")
SCORES_SQL = (
    "SELECT " + ", ".join(f"z_{n}.z AS {n}" for n in NAMES) + f" FROM {CHARGED} l "
    + " ".join(f"JOIN ({score_sql(n)}) z_{n} ON z_{n}.v = l.{n}" for n in NAMES)
)
GAPPED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"]


def _interval_sql(table: str, cells: dict[str, str]) -> str:
    long = " UNION ALL ".join(f"SELECT '{n}' AS \"column\", {c} AS value FROM {table}" for n, c in cells.items())
    return (
        'SELECT "column", value, c AS count, (hi - c)::BIGINT AS lo, hi::BIGINT AS hi FROM ('
        'SELECT "column", value, c, sum(c) OVER (PARTITION BY "column" ORDER BY c DESC, value) AS hi FROM ('
        f'SELECT "column", value, count(*) AS c FROM ({long}) GROUP BY 1, 2))'
    )


ORACLES = {
    "kinds_customer": kinds_sql("customer", CUSTOMER),
    "kinds_lineitem": kinds_sql("lineitem", LINEITEM),
    "kinds_documents": kinds_sql("documents", DOCUMENTS),
    "kinds_sketched": kinds_sql("orders", ORDERS, '"column", kind'),
    "profile_part": profile_sql("part", {
        "p_partkey": "int", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "number"}),
    "profile_lineitem": profile_sql("lineitem", LINEITEM),
    "profile_flat_orders": """
        WITH o AS (SELECT o_orderkey % 7 = 0 AS gone, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 6 END AS n,
                          o_orderkey % 11 = 0 AS hole FROM orders),
        c AS (SELECT i, part, gone, n, hole FROM o, range(0, 5) AS r(i), (VALUES ('._is_null'), ('.line'), ('.part'), ('.price')) AS p(part))
        SELECT 'items._is_null' AS "column", count(*) AS rows, 0::BIGINT AS nulls FROM o
        UNION ALL SELECT 'items._len', count(*), count_if(gone) FROM o
        UNION ALL SELECT 'items__' || i || part, count(*),
                         CASE WHEN part = '._is_null' THEN 0 ELSE count_if(gone OR n <= i OR (i = 0 AND hole)) END
        FROM c GROUP BY i, part""",
    "category_frequencies": _interval_sql("orders", {
        "status": "o_orderstatus", "priority": "o_orderpriority", "customer": "o_custkey::VARCHAR"}),
    "word_lengths": _interval_sql(
        r"(SELECT unnest(regexp_split_to_array(trim(text), '\s+')) AS w FROM documents)", {"text": "length(w)::VARCHAR"}),
    "quantile_knots": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", i, value FROM ({knots_sql(c, 'lineitem', KNOTS)})" for c in PRICES),
    "price_ranks": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, c AS count, (hi - c)::BIGINT AS lo, hi::BIGINT AS hi FROM "
        f"(SELECT {c}, c, sum(c) OVER (ORDER BY {c}) AS hi FROM (SELECT {c}, count(*) AS c FROM lineitem GROUP BY 1))"
        for c in ("l_extendedprice", "l_tax")),
    "scores": "SELECT " + ", ".join(f"{millionths_sql(n)} AS {n}" for n in NAMES) + f" FROM ({SCORES_SQL})",
    "score_correlation": " UNION ALL ".join(
        f"SELECT '{NAMES[i]}' AS a, '{NAMES[j]}' AS b, {millionths_sql(f'corr({NAMES[i]}, {NAMES[j]})')} AS r_e6 FROM s"
        for i in range(len(NAMES)) for j in range(i)),
    "correlation_with_gaps": " UNION ALL ".join(
        f"SELECT '{GAPPED[i]}' AS a, '{GAPPED[j]}' AS b, "
        f"{millionths_sql(f'corr({GAPPED[i]}::DOUBLE, {GAPPED[j]}::DOUBLE)')} AS r_e6 FROM lineitem "
        f"WHERE l_orderkey % {i + 2} <> 0 AND l_orderkey % {j + 2} <> 0"
        for i in range(len(GAPPED)) for j in range(i)),
}
ORACLES["refit_append"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", i AS place, {millionths_sql('value')} AS number_e6, NULL AS value, NULL AS hi FROM ({knots_sql(c, 'lineitem', KNOTS)})"
    for c in PRICES
) + f' UNION ALL SELECT "column", lo::INTEGER, NULL, value, hi FROM ({_interval_sql("lineitem", {c: c for c in ("l_returnflag", "l_linestatus")})})'
ORACLES["score_correlation"] = f"WITH s AS MATERIALIZED ({SCORES_SQL}) " + ORACLES["score_correlation"]
