"""Casts driven by formats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions import casts
from facsimile.functions.epoch import epoch_micros
from facsimile.operators.ingest import ingest
from facsimile.operators.typed import conform
from facsimile.plans.avro import table_schema
from workloads.common import millionths, millionths_sql, read

MIN, MAX = casts.MICROS_MIN, casts.MICROS_MAX


def _time_texts(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.col("o_orderkey") % 9
    text = (
        F.when(kind == 0, F.concat(day, F.lit("T01:02:03Z")))
        .when(kind == 1, F.concat(day, F.lit("T10:20:30.123456789+05:00")))
        .when(kind == 2, F.concat(day, F.lit("T10:20:30.5")))
        .when(kind == 3, day)
        .when(kind == 4, F.lit("not a time"))
        .when(kind == 5, F.lit("1500-06-01T00:00:00Z"))
        .when(kind == 6, F.lit("2500-06-01T00:00:00Z"))
        .when(kind == 7, F.concat(day, F.lit(" 08:15")))
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))


def ts_parse_clamp(spark, sf_dir):
    return _time_texts(spark, sf_dir).select("o_orderkey", F.unix_micros(casts.timestamp_from_text(F.col("t"))).alias("us"))


def ts_parse_null(spark, sf_dir):
    parsed = casts.timestamp_from_text(F.col("t"), "-02:30", on_error="null")
    return _time_texts(spark, sf_dir).select("o_orderkey", F.unix_micros(parsed).alias("us"))


TS_SQL = """
    WITH d AS (SELECT o_orderkey, epoch_us(o_orderdate) AS day FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 9
        WHEN 0 THEN day + 3723000000
        WHEN 1 THEN day + 37230123456 - 18000000000
        WHEN 2 THEN day + 37230500000 - {offset}
        WHEN 3 THEN day - {offset}
        WHEN 4 THEN {junk}
        WHEN 5 THEN {low}
        WHEN 6 THEN {high}
        WHEN 7 THEN day + 29700000000 - {offset} END AS us
    FROM d"""


def ts_from_ns(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    us = epoch_micros("ts", events.schema["ts"].dataType)
    ns = us * F.lit(1000) + F.col("event_id") % 1000
    negative = F.when(F.col("event_id") % 2 == 0, ns).otherwise(-ns)
    wide = F.when(F.col("event_id") % 10 == 3, negative.cast("decimal(38,0)") * F.lit(100)).otherwise(negative.cast("decimal(38,0)"))
    return events.select(
        "event_id",
        F.unix_micros(casts.timestamp_from_nanos(negative)).alias("us"),
        F.unix_micros(casts.timestamp_from_nanos(wide)).alias("us_wide"),
        casts.text_from_nanos(wide).alias("text"),
    )


def date_parse(spark, sf_dir):
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    kind = F.col("l_orderkey") % 4
    text = F.when(kind == 0, day).when(kind == 1, F.concat(day, F.lit("T23:59:59Z"))).when(kind == 2, F.lit("31/12/1999"))
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.unix_date(casts.date_from_text(text)).alias("day")
    )


def uint64_parse(spark, sf_dir):
    key = F.col("o_orderkey")
    text = (
        F.when(key % 5 == 0, F.lit("junk"))
        .when(key % 5 == 1, F.lit("18446744073709551616"))
        .otherwise((F.lit(str(casts.UINT64_MAX)).cast("decimal(20,0)") - key.cast("decimal(20,0)")).cast("string"))
    )
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", casts.uint64_from_text(text, on_error="null").cast("string").alias("value")
    )


def _uuid(key):
    h = F.md5(key.cast("string"))
    dashed = F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)
    )
    return F.when(key % 6 == 0, F.upper(dashed)).when(key % 6 != 1, dashed).otherwise(F.lit("no-uuid"))


def uuid_bytes(spark, sf_dir):
    text = _uuid(F.col("c_custkey"))
    return read(spark, sf_dir, "customer").select(
        "c_custkey", F.hex(casts.uuid_bytes(text)).alias("bytes"), casts.uuid_text(text).alias("canonical")
    )


def conform_schema(spark, sf_dir):
    schema = T.StructType.fromDDL("c_name string, phone string, c_custkey int, c_acctbal decimal(12,2), c_nationkey bigint")
    out = conform(read(spark, sf_dir, "customer"), schema)
    return out.select("c_custkey", "c_name", "phone", "c_nationkey", (F.col("c_acctbal") * 100).cast("long").alias("cents"))


# A record schema in the style of the inputs: unions, nested records, lists, formats.
ORDER_AVRO = {
    "type": "record",
    "name": "demo.order",
    "fields": [
        {"name": "id", "type": "string", "format": "uint64"},
        {"name": "placed", "type": ["null", "string"], "format": "RFC3339Nano"},
        {
            "name": "detail",
            "type": [
                "null",
                {
                    "type": "record",
                    "name": "detail",
                    "fields": [
                        {"name": "due", "type": ["null", "string"], "format": "ISO8601Date"},
                        {"name": "refs", "type": ["null", {"type": "array", "items": {"type": "string", "logicalType": "uuid"}}]},
                        {
                            "name": "steps",
                            "type": {
                                "type": "array",
                                "items": {
                                    "type": "record",
                                    "name": "step",
                                    "fields": [
                                        {"name": "at", "type": "string", "format": "ISO8601"},
                                        {"name": "no", "type": "int"},
                                    ],
                                },
                            },
                        },
                    ],
                },
            ],
        },
        {"name": "note", "type": ["null", "string"]},
    ],
}


def _typed_orders(spark, sf_dir, **options):
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    steps = F.transform(
        F.sequence(F.lit(1), (key % 3 + 1).cast("int")),
        lambda i: F.struct(F.concat(day, F.lit("T0"), i.cast("string"), F.lit(":00:00Z")).alias("at"), i.cast("string").alias("no")),
    )
    detail = F.struct(
        F.concat(day, F.lit("T00:00:00")).alias("due"),
        F.when(key % 4 != 0, F.array(_uuid(key))).alias("refs"),
        F.when(key % 5 != 0, steps).alias("steps"),
        F.lit("dropped").alias("extra"),
    )
    raw = read(spark, sf_dir, "orders").select(
        key.cast("string").alias("id"),
        F.concat(day, F.lit("T12:00:00")).alias("placed"),
        F.when(key % 7 != 0, detail).alias("detail"),
    )
    schema, formats = table_schema(ORDER_AVRO)
    return conform(raw, schema, formats, **options)


def _typed_view(df):
    steps = F.col("detail.steps")
    return df.select(
        F.col("id").cast("long").alias("id"),
        F.unix_micros("placed").alias("placed_us"),
        F.col("detail").isNull().alias("no_detail"),
        F.unix_date("detail.due").alias("due_day"),
        F.size("detail.refs").alias("refs"),
        F.get(F.col("detail.refs"), F.lit(0)).alias("ref"),
        F.when(steps.isNotNull(), F.size(steps)).alias("steps"),
        F.unix_micros(F.get(steps, F.size(steps) - 1)["at"]).alias("last_us"),
        F.get(steps, F.lit(0))["no"].alias("first_no"),
        "note",
    )


def typed_nested(spark, sf_dir):
    return _typed_view(_typed_orders(spark, sf_dir))


def typed_nested_expanded(spark, sf_dir):
    return _typed_view(_typed_orders(spark, sf_dir, null_lists="empty", null_structs="expand"))


TYPED_SQL = """
    WITH d AS (
      SELECT o_orderkey AS k, epoch_us(o_orderdate) AS day, md5(o_orderkey::VARCHAR) AS h,
             o_orderkey % 7 = 0 AS gone FROM orders),
    e AS (SELECT *, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 3 + 1 END AS n,
                 substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS u FROM d)
    SELECT k AS id, day + 32400000000 AS placed_us, {no_detail} AS no_detail,
           CASE WHEN NOT gone THEN (day // 86400000000)::INTEGER END AS due_day,
           CASE WHEN gone THEN {none} WHEN k % 4 <> 0 THEN 1 ELSE {none} END AS refs,
           CASE WHEN NOT gone AND k % 4 <> 0 AND k % 6 <> 1 THEN u END AS ref,
           CASE WHEN gone THEN {none} ELSE coalesce(n, {none}) END AS steps,
           CASE WHEN NOT gone THEN day + n * 3600000000 END AS last_us,
           CASE WHEN NOT gone AND n IS NOT NULL THEN 1 END AS first_no,
           NULL::VARCHAR AS note
    FROM e"""

INGEST_DDL = (
    "id BIGINT NOT NULL, price DOUBLE, placed TIMESTAMP, big DECIMAL(20,0), lines ARRAY<STRUCT<no: INT, due: DATE>>, head STRUCT<code: INT, note: STRING>, late STRING"
)


def _ingested(spark, sf_dir):
    """Orders staged as text; keys tell which cells are bad, several in some rows."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    line = lambda i: F.struct(
        F.when((key + i) % 19 == 0, F.concat(F.lit("n"), i.cast("string"))).otherwise(i.cast("string")).alias("no"),
        F.when((key + i) % 23 == 0, F.lit("2024-13-01")).otherwise(day).alias("due"),
    )
    staged = read(spark, sf_dir, "orders").select(
        F.when(key % 11 != 0, key.cast("string")).alias("id"),
        F.when(key % 13 == 0, F.lit("12,50")).otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(key % 17 == 0, F.lit("soon")).otherwise(F.concat(day, F.lit("T10:00:00Z"))).alias("placed"),
        F.when(key % 29 == 0, F.lit("18446744073709551616")).otherwise(key.cast("string")).alias("big"),
        F.when(key % 5 != 0, F.transform(F.sequence(F.lit(1), (key % 3 + 1).cast("int")), line)).alias("lines"),
        F.when(key % 7 != 0, F.struct(F.when(key % 31 == 0, F.lit("?")).otherwise(F.lit("7")).alias("code"), F.lit("x").alias("note"))).alias("head"),
        key.alias("staged_key"),
    )
    return ingest(staged, T.StructType.fromDDL(INGEST_DDL), {"big": "uint64"})


def ingest_quarantine(spark, sf_dir):
    """Accepted rows with their typed values, rejected ones with what is wrong with them."""
    found = _ingested(spark, sf_dir)
    lines = lambda c: F.aggregate(F.coalesce(c, F.array().cast("array<struct<no:int,due:date>>")), F.lit(0), lambda a, x: a + x["no"])
    accepted = found.accepted().select(
        F.lit(True).alias("accepted"), F.col("id").alias("key"), millionths(F.col("price")).alias("price_e6"), F.unix_micros("placed").alias("placed_us"),
        lines(F.col("lines")).cast("long").alias("lines"), F.col("head.code").alias("code"), F.lit(None).cast("string").alias("problems"),
    )
    told = F.transform("problems", lambda p: F.concat_ws("|", p["path"], F.coalesce(p["value"], F.lit("-")), p["reason"]))
    rejected = found.rejected().select(
        F.lit(False).alias("accepted"), F.col("staged_key").alias("key"), F.lit(None).cast("long").alias("price_e6"), F.lit(None).cast("long").alias("placed_us"),
        F.lit(None).cast("long").alias("lines"), F.lit(None).cast("int").alias("code"), F.array_join(told, ";").alias("problems"),
    )
    return accepted.unionByName(rejected)


def ingest_counts(spark, sf_dir):
    """How many rows and cells have each problem."""
    return _ingested(spark, sf_dir).counts()


QUERIES = {
    "ingest_quarantine": ingest_quarantine,
    "ingest_counts": ingest_counts,
    "ts_parse_clamp": ts_parse_clamp,
    "ts_parse_null": ts_parse_null,
    "ts_from_ns": ts_from_ns,
    "date_parse": date_parse,
    "uint64_parse": uint64_parse,
    "uuid_bytes": uuid_bytes,
    "conform_schema": conform_schema,
    "typed_nested": typed_nested,
    "typed_nested_expanded": typed_nested_expanded,
}

INGEST_SQL = """
    o AS (SELECT o_orderkey AS k, o_totalprice AS price, epoch_us(o_orderdate) AS day FROM orders),
    l AS (SELECT k, unnest(range(1, k % 3 + 2)) AS i FROM o WHERE k % 5 <> 0),
    notes AS (
      SELECT k, 0 AS place, 0 AS sub, 'id' AS path, '-' AS value, 'missing' AS reason FROM o WHERE k % 11 = 0
      UNION ALL SELECT k, 1, 0, 'price', '12,50', 'not a double' FROM o WHERE k % 13 = 0
      UNION ALL SELECT k, 2, 0, 'placed', 'soon', 'not a timestamp' FROM o WHERE k % 17 = 0
      UNION ALL SELECT k, 3, 0, 'big', '18446744073709551616', 'not a uint64' FROM o WHERE k % 29 = 0
      UNION ALL SELECT k, 4, 2 * i, 'lines._item.no', 'n' || i, 'not a int' FROM l WHERE (k + i) % 19 = 0
      UNION ALL SELECT k, 4, 2 * i + 1, 'lines._item.due', '2024-13-01', 'not a date' FROM l WHERE (k + i) % 23 = 0
      UNION ALL SELECT k, 5, 0, 'head.code', '?', 'not a int' FROM o WHERE k % 7 <> 0 AND k % 31 = 0)"""

ORACLES = {
    "ingest_quarantine": f"""
        WITH {INGEST_SQL},
        bad AS (SELECT k, string_agg(path || '|' || value || '|' || reason, ';' ORDER BY place, sub) AS problems FROM notes GROUP BY k)
        SELECT problems IS NULL AS accepted, o.k AS key, CASE WHEN problems IS NULL THEN {millionths_sql('price')} END AS price_e6,
               CASE WHEN problems IS NULL THEN (day // 86400000000) * 86400000000 + 36000000000 END AS placed_us,
               CASE WHEN problems IS NULL THEN CASE WHEN o.k % 5 = 0 THEN 0 ELSE (o.k % 3 + 1) * (o.k % 3 + 2) // 2 END END AS lines,
               CASE WHEN problems IS NULL AND o.k % 7 <> 0 THEN 7 END AS code, problems
        FROM o LEFT JOIN bad ON bad.k = o.k""",
    "ingest_counts": f"""
        WITH {INGEST_SQL}
        SELECT path, reason, count(DISTINCT k) AS rows, count(*) AS cells FROM notes GROUP BY path, reason""",
    "ts_parse_clamp": TS_SQL.format(offset=3 * 3600 * 10**6, junk=MIN, low=MIN, high=MAX),
    "ts_parse_null": TS_SQL.format(offset=-9000 * 10**6, junk="NULL", low=MIN, high=MAX),
    "ts_from_ns": f"""
        WITH n AS (
          SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END
                            * (epoch_us(ts)::HUGEINT * 1000 + event_id % 1000)) AS ns FROM events),
        w AS (SELECT event_id, ns, CASE WHEN event_id % 10 = 3 THEN ns * 100 ELSE ns END AS wide FROM n),
        c AS (SELECT *, greatest(least(wide, {casts.NANOS_MAX}::HUGEINT), {casts.NANOS_MIN}::HUGEINT) AS inside FROM w),
        f AS (SELECT event_id, wide, inside,
                     (ns - ((ns % 1000) + 1000) % 1000) // 1000 AS us,
                     (inside - ((inside % 1000) + 1000) % 1000) // 1000 AS us_wide FROM c)
        SELECT event_id, us::BIGINT AS us, us_wide::BIGINT AS us_wide,
               CASE WHEN wide <> inside THEN 'TIMESTAMP_NS:' || wide
                    WHEN us_wide % 1000000 = 0 THEN strftime(make_timestamp(us_wide::BIGINT), '%Y-%m-%dT%H:%M:%S')
                    ELSE strftime(make_timestamp(us_wide::BIGINT), '%Y-%m-%dT%H:%M:%S.%f') END AS text
        FROM f""",
    "date_parse": """
        SELECT l_orderkey, l_linenumber,
               CASE WHEN l_orderkey % 4 < 2 THEN (epoch_us(l_shipdate) // 86400000000)::INTEGER END AS day FROM lineitem""",
    "uint64_parse": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 THEN (18446744073709551615::HUGEINT - o_orderkey)::VARCHAR END AS value
        FROM orders""",
    "uuid_bytes": """
        SELECT c_custkey, CASE WHEN c_custkey % 6 <> 1 THEN upper(md5(c_custkey::VARCHAR)) END AS bytes,
               CASE WHEN c_custkey % 6 <> 1 THEN regexp_replace(md5(c_custkey::VARCHAR),
                    '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') END AS canonical
        FROM customer""",
    "conform_schema": """
        SELECT c_custkey::INTEGER AS c_custkey, c_name, NULL::VARCHAR AS phone, c_nationkey::BIGINT AS c_nationkey,
               round(c_acctbal * 100)::BIGINT AS cents FROM customer""",
    "typed_nested": TYPED_SQL.format(no_detail="gone", none="NULL::INTEGER"),
    "typed_nested_expanded": TYPED_SQL.format(no_detail="false", none="0"),
}
