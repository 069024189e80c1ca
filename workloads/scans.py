"""Sources, landing checks and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from facsimile.session import scratch_path
from facsimile.sources.landing import check_payloads
from facsimile.sources.naming import engine_table, record_namespace, record_title
from facsimile.sources.tables import INTERNAL_COLUMNS, json_records, ranked_head, read_table
from workloads.common import read

LIMIT = 1000


def scan_limit(spark, sf_dir):
    return read_table(spark, "parquet", f"{sf_dir}/orders.parquet", limit=LIMIT, order_by=["o_orderkey"]).select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


def scan_ranked_head(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey", "o_custkey")
    half = orders.count() // 2
    return ranked_head(orders, half, ["o_totalprice", "o_orderkey"], slot_rows=5_000)


def drop_internal(spark, sf_dir):
    dirty = read(spark, sf_dir, "supplier")
    for name in INTERNAL_COLUMNS[:3]:
        dirty = dirty.withColumn(name, F.lit("x"))
    dirty.createOrReplaceTempView("supplier_with_internal_columns")
    return read_table(spark, "table", "supplier_with_internal_columns")


def json_lines(spark, sf_dir):
    path = scratch_path(spark, "json")
    read(spark, sf_dir, "customer").write.json(path)
    return read_table(spark, "json", path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def json_columns(spark, sf_dir):
    return json_records(read(spark, sf_dir, "events").select("event_id", "props"), "props")


def payload_check(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 5
    body = F.when(kind == 1, F.encode("text", "UTF-8")).otherwise(
        F.concat(F.unhex(F.lit("4F626A01")), F.encode("text", "UTF-8"))
    )
    text = F.translate(F.base64(body), "\r\n", "")  # Spark breaks base64 into lines
    payload = F.when(kind == 2, F.substring(text, F.lit(1), F.length(text) - 1)).when(
        kind == 3, F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit("*"))
    ).otherwise(text)
    name = F.when(F.col("doc_id") % 7 == 1, F.concat(F.lit("doc "), "doc_id", F.lit(".avro"))).when(
        F.col("doc_id") % 7 != 2, F.concat(F.lit("doc_"), "doc_id", F.lit(".avro"))
    )
    uploads = docs.select("doc_id", payload.alias("payload"), name.alias("filename"))
    return check_payloads(uploads).select("doc_id", "ok", "reason")


def qualified_name(spark, sf_dir):
    name = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(
        F.concat(F.lit("org."), F.col("s_nationkey").cast("string"), F.lit("."), F.col("s_name"))
    )
    return read(spark, sf_dir, "supplier").select(
        "s_suppkey", record_namespace(name, "main").alias("namespace"), record_title(name).alias("title")
    )


def fqn_map(spark, sf_dir):
    fqn = F.concat(
        F.lit("service.lake."), F.lower("c_mktsegment"), F.lit("-raw."), F.lit("cust-"), F.col("c_custkey").cast("string")
    )
    broken = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("a."), fqn)).otherwise(fqn)
    return read(spark, sf_dir, "customer").select("c_custkey", engine_table(broken, "lake").alias("table_name"))


QUERIES = {
    "scan_limit": scan_limit,
    "scan_ranked_head": scan_ranked_head,
    "drop_internal": drop_internal,
    "json_lines": json_lines,
    "json_columns": json_columns,
    "payload_check": payload_check,
    "qualified_name": qualified_name,
    "fqn_map": fqn_map,
}

ORACLES = {
    "scan_limit": f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT {LIMIT}",
    "scan_ranked_head": """
        SELECT o_totalprice, o_orderkey, o_custkey FROM orders
        QUALIFY row_number() OVER (ORDER BY o_totalprice, o_orderkey) <= (SELECT count(*) // 2 FROM orders)""",
    "drop_internal": "SELECT * FROM supplier",
    "json_lines": "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "json_columns": "SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events",
    "payload_check": """
        WITH made AS (
          SELECT doc_id,
                 to_base64(CASE WHEN doc_id % 5 = 1 THEN encode(text) ELSE '\\x4F\\x62\\x6A\\x01'::BLOB || encode(text) END) AS t,
                 CASE WHEN doc_id % 7 = 1 THEN 'doc ' || doc_id || '.avro'
                      WHEN doc_id % 7 <> 2 THEN 'doc_' || doc_id || '.avro' END AS filename
          FROM documents),
        sent AS (
          SELECT doc_id, filename,
                 CASE doc_id % 5 WHEN 2 THEN substr(t, 1, length(t) - 1)
                                 WHEN 3 THEN substr(t, 1, length(t) - 1) || '*' ELSE t END AS payload
          FROM made),
        judged AS (
          SELECT doc_id,
                 CASE WHEN length(payload) % 4 <> 0 OR NOT regexp_full_match(payload, '[A-Za-z0-9+/]*={0,2}')
                        THEN 'malformed base64'
                      WHEN substr(payload, 1, 5) <> 'T2JqA' OR ascii(substr(payload, 6, 1)) NOT BETWEEN ascii('Q') AND ascii('f')
                        THEN 'not an Avro container'
                      WHEN filename IS NOT NULL AND NOT regexp_full_match(filename, '[\\w\\-.]+\\.avro') THEN 'bad file name'
                 END AS reason
          FROM sent)
        SELECT doc_id, reason IS NULL AS ok, reason FROM judged""",
    "qualified_name": """
        SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'main' ELSE 'org.' || s_nationkey END AS namespace, s_name AS title
        FROM supplier""",
    "fqn_map": """
        SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0
               THEN 'lake.' || replace(lower(c_mktsegment) || '-raw.cust-' || c_custkey, '-', '_') END AS table_name
        FROM customer""",
}
