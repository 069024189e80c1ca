"""Flatten and unflatten."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.nested import column, reproject
from facsimile.operators.flatten import flatten
from facsimile.operators.unflatten import unflatten
from facsimile.plans.shape import Plan, infer_plan, plan_from_names
from workloads.common import (
    CUSTOMER_NESTED_SQL, ORDER_ITEMS_SQL, customer_nested, order_nested, page_nested, read,
)


def shape_infer(spark, sf_dir):
    return infer_plan(order_nested(spark, sf_dir)).rows(spark)


def shape_infer_pages(spark, sf_dir):
    return infer_plan(page_nested(spark, sf_dir)).rows(spark)


def flatten_struct(spark, sf_dir):
    df = customer_nested(spark, sf_dir)
    flat = flatten(df, infer_plan(df))
    return flat.select(
        "c_custkey", column("nation._is_null").alias("absent"), column("nation.name").alias("n_name"),
        column("nation.region.name").alias("r_name"),
    )


def _flat_orders(spark, sf_dir, **options):
    df = order_nested(spark, sf_dir)
    plan = infer_plan(df, deep=options.pop("deep", False))
    return flatten(df, plan, **options), plan


def flatten_array(spark, sf_dir):
    flat, _ = _flat_orders(spark, sf_dir)
    parts = [
        F.struct(F.lit(i).alias("i"), column(f"items__{i}").alias("item")) for i in range(5)
    ]
    return flat.select("o_orderkey", F.explode(F.array(*parts)).alias("p")).select(
        "o_orderkey", "p.i", "p.item.line", "p.item.part", F.col("p.item").isNull().alias("empty")
    )


def flatten_null_flag(spark, sf_dir):
    flat, _ = _flat_orders(spark, sf_dir, lengths=True, index_style="[i]")
    return flat.select(
        "o_orderkey", column("items._is_null").alias("no_items"), column("items._len").alias("n"),
        column("head.tags._is_null").alias("no_tags"), column("head.tags[1]").alias("second_tag"),
        column("head.o_orderstatus").alias("status"),
    )


def flatten_deep(spark, sf_dir):
    flat, _ = _flat_orders(spark, sf_dir, deep=True)
    parts = [
        F.struct(F.lit(i).alias("i"), column(f"items__{i}.part").alias("part"), column(f"items__{i}._is_null").alias("missing"))
        for i in range(5)
    ]
    return flat.select("o_orderkey", F.explode(F.array(*parts)).alias("p")).select("o_orderkey", "p.*")


def flatten_pages(spark, sf_dir):
    df = page_nested(spark, sf_dir)
    flat = flatten(df, infer_plan(df, deep=True))
    names = [c for c in flat.columns if c.startswith("address.segments__") or c.startswith("address.params__") and c.endswith(".value")]
    cells = F.array(*[F.struct(F.lit(c).alias("cell"), column(c).alias("value")) for c in names])
    return flat.select("page_id", column("address.host").alias("host"), F.explode(cells).alias("c")).select(
        "page_id", "host", "c.*"
    ).where("value is not null")


def flatten_vector(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings")
    flat = flatten(df, infer_plan(df))
    return flat.select(
        "vec_id", "label", *[column(f"embedding__{i}").cast("double").alias(f"e{i}") for i in range(64)]
    )


def flatten_ts_text(spark, sf_dir):
    df = read(spark, sf_dir, "events").select(
        "event_id", F.struct("ts", "event_type").alias("event"), F.array("ts", F.date_trunc("day", "ts").cast("timestamp_ntz")).alias("times")
    )
    flat = flatten(df, infer_plan(df), timestamps="string")
    return flat.select(
        "event_id", column("event.ts").alias("ts"), column("times__0").alias("t0"), column("times__1").alias("t1")
    )


def unflatten_by_names(spark, sf_dir):
    """Flat orders without their plan: groups of array columns come from the names."""
    flat, _ = _flat_orders(spark, sf_dir)
    plan = plan_from_names(flat.schema)
    return unflatten(flat, plan).select(
        "o_orderkey", F.size("items").alias("n"), F.col("head.o_orderstatus").alias("status"),
        F.array_join("head.tags", "|").alias("tags"),
    )


def _items_of(df):
    return df.select("o_orderkey", F.posexplode("items").alias("i", "item")).select(
        "o_orderkey", "i", F.col("item").isNull().alias("empty"), "item.part", "item.line"
    )


def unflatten_pad(spark, sf_dir):
    flat, plan = _flat_orders(spark, sf_dir)
    return _items_of(unflatten(flat, plan, arrays="pad"))


def unflatten_compact(spark, sf_dir):
    flat, plan = _flat_orders(spark, sf_dir, deep=True)
    plan.extents["items"] = plan.extent("items")._replace(null_items=False)
    return _items_of(unflatten(flat, plan, arrays="compact"))


def unflatten_length(spark, sf_dir):
    """Flatten with lengths, save and load the plan, unflatten: the input again."""
    flat, plan = _flat_orders(spark, sf_dir, lengths=True, deep=True)
    back = unflatten(flat, Plan.from_json(plan.to_json()), arrays="length")
    return back.select(
        "o_orderkey", F.col("items").isNull().alias("null_list"), F.coalesce(F.size("items"), F.lit(-1)).alias("n"),
        F.coalesce(F.size(F.filter("items", lambda x: x.isNull())), F.lit(-1)).alias("null_items"),
        F.aggregate(F.coalesce("items", F.array()), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["part"], F.lit(0))).alias("parts"),
    )


def unflatten_struct(spark, sf_dir):
    df = customer_nested(spark, sf_dir)
    plan = infer_plan(df)
    flat = flatten(df, plan)
    kept, expanded = unflatten(flat, plan), unflatten(flat, plan, null_structs="expand")
    both = kept.select("c_custkey", F.lit("keep").alias("mode"), F.col("nation")).union(
        expanded.select("c_custkey", F.lit("expand"), F.col("nation"))
    )
    return both.select(
        "c_custkey", "mode", F.col("nation").isNull().alias("absent"), F.col("nation.region.name").alias("r_name")
    )


def reproject_items(spark, sf_dir):
    df = order_nested(spark, sf_dir)
    target = T.ArrayType(T.StructType.fromDDL("part int, line string, colour string"))
    items = reproject(F.col("items"), df.schema["items"].dataType, target)
    return df.select("o_orderkey", F.explode(items).alias("x")).select("o_orderkey", "x.part", "x.line", "x.colour")


QUERIES = {f.__name__: f for f in (
    shape_infer, shape_infer_pages, flatten_struct, flatten_array, flatten_null_flag, flatten_deep, flatten_pages,
    flatten_vector, flatten_ts_text, unflatten_by_names, unflatten_pad, unflatten_compact, unflatten_length,
    unflatten_struct, reproject_items,
)}

ITEMS = f"({ORDER_ITEMS_SQL})"
SHAPE_ROW = "SELECT '{0}' AS path, '{1}' AS kind, '{2}' AS label, {3} AS max_elements, {4} AS nullable_array, {5} AS nullable_elements, {6} AS nullable_struct"
NO = ("0", "false", "false", "false")


def _shape(rows: list[tuple], source: str) -> str:
    return " UNION ALL ".join(SHAPE_ROW.format(*r) + f" FROM {source}" for r in rows)


ORACLES = {
    "shape_infer": "WITH s AS (SELECT max(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 6 ELSE 0 END)::INTEGER AS w, "
    "bool_or(o_orderkey % 7 = 0) AS nl, bool_or(o_orderkey % 7 <> 0 AND o_orderkey % 6 > 0 AND o_orderkey % 11 = 0) AS ne, "
    "bool_or(o_orderkey % 5 = 0) AS nt, "
    "max(CASE WHEN o_orderkey % 5 <> 0 THEN len(regexp_split_to_array(o_orderpriority, '[- ]')) END)::INTEGER AS tw FROM orders) "
    + _shape([
        ("o_orderkey", "scalar", "int64", *NO),
        ("head", "struct", "object", *NO),
        ("head.o_orderstatus", "scalar", "object", *NO),
        ("head.total", "scalar", "float64", *NO),
        ("head.tags", "array", "object", "tw", "nt", "false", "false"),
        ("head.tags._item", "scalar", "object", *NO),
        ("items", "array", "object", "w", "nl", "ne", "false"),
        ("items._item", "struct", "object", "0", "false", "false", "ne"),
        ("items._item.line", "scalar", "int64", *NO),
        ("items._item.part", "scalar", "int64", *NO),
        ("items._item.price", "scalar", "float64", *NO),
    ], "s"),
    "shape_infer_pages": r"""
        WITH p AS (SELECT regexp_extract(url, '^\w+://[^/]*/([^?]*)', 1) AS path, regexp_extract(url, '\?(.*)$', 1) AS q FROM pages),
        s AS (SELECT max(len(string_split(path, '/')))::INTEGER AS w,
                     coalesce(max(CASE WHEN q <> '' THEN len([x for x in string_split(q, '&') if x <> '']) END), 0)::INTEGER AS pw,
                     bool_or(len([x for x in string_split(q, '&') if x <> '']) = 0) AS np FROM p) """
    + _shape([
        ("page_id", "scalar", "int64", *NO),
        ("address", "struct", "object", *NO),
        ("address.host", "scalar", "object", *NO),
        ("address.segments", "array", "object", "w", "false", "false", "false"),
        ("address.segments._item", "scalar", "object", *NO),
        ("address.params", "array", "object", "pw", "np", "false", "false"),
        ("address.params._item", "struct", "object", *NO),
        ("address.params._item.key", "scalar", "object", *NO),
        ("address.params._item.value", "scalar", "object", *NO),
    ], "s"),
    "flatten_struct": f"SELECT c_custkey, absent, CASE WHEN NOT absent THEN n_name END AS n_name, "
    f"CASE WHEN NOT absent THEN r_name END AS r_name FROM ({CUSTOMER_NESTED_SQL})",
    "flatten_array": f"SELECT o_orderkey, (i - 1)::INTEGER AS i, CASE WHEN filled THEN i::INTEGER END AS line, "
    f"CASE WHEN filled THEN part END AS part, NOT filled AS empty FROM {ITEMS}",
    "flatten_null_flag": """
        SELECT o_orderkey, o_orderkey % 7 = 0 AS no_items, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 6)::INTEGER END AS n,
               o_orderkey % 5 = 0 AS no_tags,
               CASE WHEN o_orderkey % 5 <> 0 THEN list_extract(regexp_split_to_array(o_orderpriority, '[- ]'), 2) END AS second_tag,
               o_orderstatus AS status FROM orders""",
    "flatten_deep": f"SELECT o_orderkey, (i - 1)::INTEGER AS i, CASE WHEN filled THEN part END AS part, NOT filled AS missing FROM {ITEMS}",
    "flatten_pages": r"""
        WITH p AS (SELECT page_id, regexp_extract(url, '^\w+://([^/]*)', 1) AS host,
                          string_split(regexp_extract(url, '^\w+://[^/]*/([^?]*)', 1), '/') AS seg,
                          [x for x in string_split(regexp_extract(url, '\?(.*)$', 1), '&') if x <> ''] AS par FROM pages),
        s AS (SELECT page_id, host, unnest(seg) AS value, generate_subscripts(seg, 1) - 1 AS i FROM p),
        q AS (SELECT page_id, host, unnest(par) AS pair, generate_subscripts(par, 1) - 1 AS i FROM p)
        SELECT page_id, host, 'address.segments__' || i AS cell, value FROM s
        UNION ALL
        SELECT page_id, host, 'address.params__' || i || '.value', list_extract(string_split(pair, '='), 2) FROM q
        WHERE contains(pair, '=')""",
    "flatten_vector": "SELECT vec_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(64)) + " FROM embeddings",
    "flatten_ts_text": """
        SELECT event_id, t AS ts, t AS t0, strftime(date_trunc('day', ts), '%Y-%m-%dT00:00:00') AS t1
        FROM (SELECT event_id, ts, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                     ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS t FROM events)""",
    "unflatten_by_names": f"""
        SELECT o_orderkey, any_value(CASE WHEN o_orderkey % 7 <> 0 THEN k.cnt END) AS n, any_value(o.o_orderstatus) AS status,
               any_value(CASE WHEN o_orderkey % 5 <> 0 THEN array_to_string(regexp_split_to_array(o.o_orderpriority, '[- ]'), '|') END) AS tags
        FROM orders o JOIN (SELECT o_orderkey, count_if(filled)::INTEGER AS cnt FROM {ITEMS} GROUP BY 1) k USING (o_orderkey)
        GROUP BY o_orderkey""",
    "unflatten_pad": f"SELECT o_orderkey, (i - 1)::INTEGER AS i, NOT filled AS empty, CASE WHEN filled THEN part END AS part, "
    f"CASE WHEN filled THEN i::INTEGER END AS line FROM {ITEMS}",
    "unflatten_compact": f"SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderkey ORDER BY i) - 1)::INTEGER AS i, false AS empty, "
    f"part, i::INTEGER AS line FROM {ITEMS} WHERE filled",
    "unflatten_length": f"""
        SELECT o_orderkey, any_value(null_list) AS null_list,
               CASE WHEN any_value(null_list) THEN -1 ELSE any_value(n) END::INTEGER AS n,
               CASE WHEN any_value(null_list) THEN -1 ELSE count_if(i <= n AND NOT filled) END::INTEGER AS null_items,
               coalesce(sum(part) FILTER (filled), 0)::BIGINT AS parts
        FROM {ITEMS} GROUP BY o_orderkey""",
    "unflatten_struct": f"""
        SELECT c_custkey, mode, absent AND mode = 'keep' AS absent, CASE WHEN NOT absent THEN r_name END AS r_name
        FROM ({CUSTOMER_NESTED_SQL}), (VALUES ('keep'), ('expand')) AS m(mode)""",
    "reproject_items": f"""
        SELECT o_orderkey, CASE WHEN filled THEN part::INTEGER END AS part, CASE WHEN filled THEN i::VARCHAR END AS line,
               NULL::VARCHAR AS colour FROM {ITEMS} WHERE i <= n""",
}
