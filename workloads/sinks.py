"""Sinks: what is written comes back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from facsimile.session import scratch_path
from facsimile.sinks.document import DEFAULT_ROWS, sample_document, width_errors
from facsimile.sinks.fanout import overall_status, write_all
from facsimile.sinks.files import as_records, write_files
from facsimile.sinks.tables import TableWriteError, table_properties, write_table
from workloads.common import NESTED_ITEM, ORDER_ITEMS_SQL, order_nested, read


def write_csv(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    report = write_files(customer, scratch_path(spark, "sink"), "customer", "csv", "demo/tables").first()
    return spark.read.schema(customer.schema).option("header", True).csv(report["path"])


def write_csv_nested(spark, sf_dir):
    """Nested columns become JSON text in CSV."""
    df = order_nested(spark, sf_dir)
    report = write_files(df, scratch_path(spark, "sink"), "orders.txt", "csv").first()
    back = spark.read.schema("o_orderkey bigint, head string, items string").option("header", True).option("escape", '"').csv(report["path"])
    items = F.from_json("items", f"array<{NESTED_ITEM}>")
    return back.select(
        "o_orderkey", F.get_json_object("head", "$.o_orderstatus").alias("status"), F.size(items).alias("n"),
        F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["part"], F.lit(0))).alias("parts"),
    )


def write_json(spark, sf_dir):
    customer = read(spark, sf_dir, "customer")
    report = write_files(customer, scratch_path(spark, "sink"), "customer", "json").first()
    return spark.read.schema(customer.schema).json(report["path"])


def write_parquet(spark, sf_dir):
    report = write_files(order_nested(spark, sf_dir), scratch_path(spark, "sink"), "orders", "parquet").first()
    back = spark.read.parquet(report["path"])
    return back.select("o_orderkey", F.size("items").alias("n"), F.col("head.total").alias("total"))


def write_report(spark, sf_dir):
    base = scratch_path(spark, "sink")
    reports = [write_files(read(spark, sf_dir, t), base, f"dir/{t}.bak", "parquet", "p") for t in ("customer", "orders")]
    both = reports[0].union(reports[1])
    return both.select(F.replace("path", F.lit(base), F.lit("")).alias("path"), "format", "mime", "rows")


def _fresh_name():
    return f"customer_{uuid.uuid4().hex}"


def table_create(spark, sf_dir):
    name, base = _fresh_name(), scratch_path(spark, "warehouse")
    write_table(read(spark, sf_dir, "customer"), "facsimile_demo", name, base)
    return spark.table(f"facsimile_demo.{name}")


def table_evolve(spark, sf_dir):
    """Second write: one column gone, one new, one wider; rows are replaced."""
    name, base = _fresh_name(), scratch_path(spark, "warehouse")
    customer = read(spark, sf_dir, "customer")
    write_table(customer.select("c_custkey", "c_name", "c_nationkey"), "facsimile_demo", name, base)
    second = customer.where("c_acctbal > 0").select(
        "c_mktsegment", "c_custkey", F.col("c_nationkey").cast("bigint").alias("c_nationkey")
    )
    write_table(second, "facsimile_demo", name, base)
    return spark.table(f"facsimile_demo.{name}")


def table_evolve_nested(spark, sf_dir):
    """Fields added inside a struct, and columns added by name."""
    name, base = _fresh_name(), scratch_path(spark, "warehouse")
    supplier = read(spark, sf_dir, "supplier")
    write_table(supplier.select("s_suppkey", F.struct("s_name").alias("info")), "facsimile_demo", name, base)
    write_table(supplier.select(F.struct("s_nationkey").alias("info"), "s_suppkey", "s_acctbal"), "facsimile_demo", name, base)
    return spark.table(f"facsimile_demo.{name}").select("s_suppkey", "s_acctbal", "info.s_name", "info.s_nationkey")


def table_report(spark, sf_dir):
    name, base = _fresh_name(), scratch_path(spark, "warehouse")
    customer = read(spark, sf_dir, "customer")
    first = write_table(customer, "facsimile_demo", name, base)
    second = write_table(customer.where("c_custkey % 2 = 0"), "facsimile_demo", name, base)
    return first.union(second).select(
        F.replace("table", F.lit(name), F.lit("T")).alias("table"), "rows", "created",
        F.col("location").startswith(f"{base}/facsimile_demo.db/{name}/").alias("placed"),
    )


def table_partitioned(spark, sf_dir):
    """A table laid out by market segment, written twice; only one segment's folder is read."""
    name, base = _fresh_name(), scratch_path(spark, "warehouse")
    customer = read(spark, sf_dir, "customer")
    write_table(customer.limit(10), "facsimile_demo", name, base, partition_by=["c_mktsegment"])
    write_table(customer, "facsimile_demo", name, base)
    table = spark.table(f"facsimile_demo.{name}")
    return table.filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_mktsegment")


def table_properties_kept(spark, sf_dir):
    """Properties after a second write that adds one and widens a column."""
    name, base = _fresh_name(), scratch_path(spark, "warehouse")
    nation = read(spark, sf_dir, "nation")
    write_table(nation, "facsimile_demo", name, base, {"team": "demo", "note": "it's one"})
    write_table(nation.withColumn("n_regionkey", F.col("n_regionkey").cast("bigint")), "facsimile_demo", name, base, {"step": "two"})
    kept = table_properties(spark, f"facsimile_demo.{name}")
    rows = [(k, kept.get(k)) for k in ("team", "note", "step")]
    return spark.createDataFrame(rows, "key string, value string").crossJoin(
        spark.table(f"facsimile_demo.{name}").agg(F.sum("n_regionkey").alias("regions"))
    )


def table_conflict(spark, sf_dir):
    """Two writes that expect the same snapshot: the second is refused and the rows of the first stay."""
    name, base = _fresh_name(), scratch_path(spark, "warehouse")
    customer = read(spark, sf_dir, "customer")
    start = write_table(customer, "facsimile_demo", name, base, partition_by=["c_mktsegment"]).first()["snapshot"]
    write_table(customer.filter("c_acctbal > 0"), "facsimile_demo", name, base, expected=start)
    try:
        write_table(customer.filter("c_acctbal <= 0"), "facsimile_demo", name, base, expected=start)
        step = "none"
    except TableWriteError as e:
        step = e.operation
    return spark.table(f"facsimile_demo.{name}").select("c_custkey", "c_mktsegment", F.lit(step).alias("refused_at"))


def times_out(spark, sf_dir):
    """Microseconds through CSV, JSON, records and a document."""
    events = read(spark, sf_dir, "events").select("event_id", "ts")
    base = scratch_path(spark, "sink")
    csv = spark.read.schema("event_id bigint, csv string").option("header", True).csv(write_files(events, base, "t", "csv").first()["path"])
    json = spark.read.schema("event_id bigint, ts string").json(write_files(events, base, "t", "json").first()["path"])
    records = as_records(events).select(F.from_json("record", "event_id bigint, ts string").alias("r")).select("r.*")
    cells = F.from_json("document", "rows array<array<string>>").getField("rows")
    document = sample_document(events, ["event_id"], 1 << 30, chunk_rows=3000).select(F.explode(cells).alias("r"))
    document = document.select(F.get("r", F.lit(0)).cast("bigint").alias("event_id"), F.get("r", F.lit(1)).alias("document"))
    joined = csv.join(json.withColumnRenamed("ts", "json"), "event_id").join(records.withColumnRenamed("ts", "record"), "event_id")
    return joined.join(document, "event_id").select("event_id", *[F.substring(c, 1, 26).alias(c) for c in ("csv", "json", "record", "document")])


def document(spark, sf_dir):
    return sample_document(read(spark, sf_dir, "customer"), ["c_custkey"]).select(
        "document", F.array_join("columns", ",").alias("columns"), F.size("rows").alias("n"),
        F.array_join(F.flatten("rows"), "|").alias("cells"),
    )


def row_widths(spark, sf_dir):
    docs = read(spark, sf_dir, "customer").select(
        "c_custkey",
        F.array(F.lit("a"), F.lit("b")).alias("columns"),
        F.array(
            F.array("c_name", "c_mktsegment"),
            F.slice(F.array("c_name", "c_mktsegment", "c_name"), F.lit(1), (F.col("c_custkey") % 3 + 1).cast("int")),
        ).alias("rows"),
    )
    return width_errors(docs, ["c_custkey"])


def sink_status(spark, sf_dir):
    code = (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 3
    status = F.when(code == 0, "success").when(code == 1, "failed").otherwise("skipped")
    return overall_status(read(spark, sf_dir, "orders").select("o_custkey", status.alias("status")), ["o_custkey"])


def fanout(spark, sf_dir):
    base, name = scratch_path(spark, "fanout"), _fresh_name()
    statuses = write_all(
        read(spark, sf_dir, "customer"),
        {
            "files": lambda rows: write_files(rows, base, "customer", "csv"),
            "table": lambda rows: write_table(rows, "facsimile_demo", name, base),
            "broken": lambda rows: write_files(rows, base, "customer", "xlsx"),
            "absent": None,
        },
    )
    return statuses.select(
        "sink", "status", "reason", F.get_json_object("details", "$.rows").cast("long").alias("rows"),
        F.col("error").isNotNull().alias("has_error"),
    )


def records(spark, sf_dir):
    return as_records(read(spark, sf_dir, "supplier").withColumn("note", F.lit(None).cast("string")))


QUERIES = {f.__name__: f for f in (
    write_csv, write_csv_nested, write_json, write_parquet, write_report, table_create, table_evolve, table_evolve_nested,
    table_partitioned, table_properties_kept, table_conflict, times_out, table_report, document, row_widths, sink_status, fanout, records,
)}

JSON_ROW = """'[' || c_custkey || ',"' || c_name || '",' || c_nationkey || ',' || c_acctbal || ',"' || c_mktsegment || '"]'"""

ORACLES = {
    "write_csv": "SELECT * FROM customer",
    "write_csv_nested": f"""
        SELECT o_orderkey, any_value(o_orderstatus) AS status, CASE WHEN NOT any_value(null_list) THEN any_value(n)::INTEGER END AS n,
               CASE WHEN NOT any_value(null_list) THEN coalesce(sum(part) FILTER (filled), 0)::BIGINT END AS parts
        FROM ({ORDER_ITEMS_SQL}) JOIN orders USING (o_orderkey) GROUP BY o_orderkey""",
    "write_json": "SELECT * FROM customer",
    "write_parquet": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 6)::INTEGER END AS n, o_totalprice AS total FROM orders",
    "write_report": " UNION ALL ".join(
        f"SELECT '/p/dir/{t}.parquet' AS path, 'parquet' AS format, 'application/vnd.apache.parquet' AS mime, count(*) AS rows FROM {t}"
        for t in ("customer", "orders")),
    "table_create": "SELECT * FROM customer",
    "table_partitioned": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "table_properties_kept": """
        SELECT k AS key, v AS value, (SELECT sum(n_regionkey)::BIGINT FROM nation) AS regions
        FROM (VALUES ('team', 'demo'), ('note', 'it''s one'), ('step', 'two')) AS p(k, v)""",
    "table_conflict": "SELECT c_custkey, c_mktsegment, 'conflict' AS refused_at FROM customer WHERE c_acctbal > 0",
    "times_out": """
        SELECT event_id, t AS csv, t AS json, t AS record, t AS document FROM (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS t FROM events)""",
    "table_evolve": "SELECT c_custkey, NULL::VARCHAR AS c_name, c_nationkey::BIGINT AS c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 0",
    "table_evolve_nested": "SELECT s_suppkey, s_acctbal, NULL::VARCHAR AS s_name, s_nationkey FROM supplier",
    "table_report": """
        SELECT 'facsimile_demo.T' AS "table", count(*) AS rows, true AS created, true AS placed FROM customer
        UNION ALL SELECT 'facsimile_demo.T', count(*), false, true FROM customer WHERE c_custkey % 2 = 0""",
    "document": f"""
        SELECT '{{"columns":["c_custkey","c_name","c_nationkey","c_acctbal","c_mktsegment"],"rows":[' ||
               string_agg({JSON_ROW}, ',' ORDER BY c_custkey) || ']}}' AS document,
               'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns, count(*)::INTEGER AS n,
               string_agg(c_custkey || '|' || c_name || '|' || c_nationkey || '|' || c_acctbal || '|' || c_mktsegment, '|' ORDER BY c_custkey) AS cells
        FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT {DEFAULT_ROWS})""",
    "row_widths": """
        SELECT c_custkey, 1 AS row, (c_custkey % 3 + 1)::INTEGER AS found, 2 AS expected FROM customer WHERE c_custkey % 3 <> 1""",
    "sink_status": """
        SELECT *, CASE WHEN failed = 0 THEN 'ok' WHEN failed = sinks THEN 'error' ELSE 'partial_success' END AS message FROM (
          SELECT o_custkey, count(*) AS sinks, count_if(code = 0) AS succeeded, count_if(code = 2) AS skipped, count_if(code = 1) AS failed
          FROM (SELECT o_custkey, (o_orderkey * 7 + o_custkey) % 3 AS code FROM orders) GROUP BY o_custkey)""",
    "fanout": """
        SELECT sink, status, reason, CASE WHEN status = 'success' THEN n END AS rows, status = 'failed' AS has_error
        FROM (VALUES ('files', 'success', NULL), ('table', 'success', NULL), ('broken', 'failed', 'upload_failed'),
                     ('absent', 'skipped', 'not_configured')) AS v(sink, status, reason), (SELECT count(*) AS n FROM customer)""",
    "records": """
        SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"s_acctbal":' ||
               s_acctbal || ',"note":null}' AS record FROM supplier""",
}
