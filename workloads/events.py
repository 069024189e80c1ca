"""Change events, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from facsimile.session import scratch_path
from facsimile.streaming.events import classify_changes, parse_events, regenerate_on_change
from workloads.common import read

KINDS = 16


def _text(s):
    return F.lit(s)


def change_events(df):
    """One change event as JSON per row, its form chosen by ``event_id``."""
    key = F.col("event_id").cast("string")
    user = F.col("user_id").cast("string")
    head = F.concat(_text('{"id":"e'), key, _text('","entityType":"table","entityId":"t'), user, _text('","timestamp":17,"extra":[1],"eventType":'))
    column = F.concat(
        _text('"[{\\"name\\":\\"c'), user, _text('\\",\\"fullyQualifiedName\\":\\"a.b.c\\",\\"dataType\\":\\"INT\\"}]"')
    )
    update = F.concat(head, _text('"entityUpdated","changeDescription":{"previousVersion":0.1,'))
    close = _text("]}}")

    def added(name, value):
        return F.concat(update, _text('"fieldsAdded":[{"name":"'), name, _text('","newValue":'), value, _text("}"), close)

    def updated(name, new, old):
        return F.concat(
            update, _text('"fieldsUpdated":[{"name":"'), name, _text('","newValue":'), new, _text(',"oldValue":'), old, _text("}"), close
        )

    def deleted(name, value):
        return F.concat(update, _text('"fieldsDeleted":[{"name":"'), name, _text('","oldValue":'), value, _text("}"), close)

    attribute = F.concat(_text("columns.a."), user, _text(".description"))
    tags = F.concat(_text("columns.c"), user, _text(".tags"))
    forms = [
        F.concat(head, _text('"entityCreated"}')),                                          # 0 created
        added(_text("columns"), column),                                                    # 1 column added
        updated(attribute, _text('"new"'), _text('"old"')),                                 # 2 attribute changed
        updated(tags, _text('"x"'), _text('"y"')),                                          # 3 tags only
        deleted(_text("columns"), column),                                                  # 4 column deleted
        added(_text("columns"), _text('"[]"')),                                             # 5 empty column list
        F.concat(_text('{"message":"hello '), key, _text('"}')),                            # 6 test message
        F.replace(F.concat(head, _text('"entityCreated"}')), F.lit('"table"'), F.lit('"topic"')),  # 7 other entity
        added(_text("description"), _text('"text"')),                                       # 8 unrelated field
        updated(_text("columns"), column, _text('"no list"')),                              # 9 old value is no list
        F.concat(update, _text('"fieldsAdded":[{"name":"columns"}'), close),                # 10 value missing
        F.concat(head, _text('"entityDeleted"}')),                                          # 11 other event
        _text("{broken"),                                                                   # 12 no JSON
        F.concat(
            update, _text('"fieldsAdded":[{"name":"owner","newValue":"u"}],"fieldsUpdated":[{"name":"'), attribute,
            _text('","newValue":"n","oldValue":"o"},{"name":"columns","newValue":'), column, _text(',"oldValue":'), column, _text("}"), close,
        ),                                                                                  # 13 several fields
        added(_text("columns"), _text('[{"name":"c","fullyQualifiedName":"a.b.c"}]')),      # 14 a list that is no text
        added(_text("columns"), F.concat(_text('"[{\\"name\\":'), user, _text(',\\"fullyQualifiedName\\":\\"a.b.c\\"}]"'))),  # 15 a number as column name
    ]
    payload = forms[0]
    for i, form in enumerate(forms[1:], 1):
        payload = F.when(F.col("event_id") % KINDS == i, form).otherwise(payload)
    return df.select("event_id", payload.alias("payload"))


def _classified(spark, sf_dir, **options):
    return parse_events(change_events(read(spark, sf_dir, "events")), **options)


def event_route(spark, sf_dir):
    return _classified(spark, sf_dir).select("event_id", "kind", "action", "entity_id")


def schema_change(spark, sf_dir):
    return _classified(spark, sf_dir).select("event_id", "schema_change", F.array_join("changed_columns", "|").alias("columns"))


def schema_change_with_deletes(spark, sf_dir):
    return _classified(spark, sf_dir, count_deletes=True).select(
        "event_id", "schema_change", F.array_join("changed_columns", "|").alias("columns")
    )


def _catalog(spark, sf_dir):
    key = F.col("c_custkey")
    fqn = F.concat(F.lit("svc.db."), F.lower("c_mktsegment"), F.lit(".my-table-"), key.cast("string"))
    broken = F.when(key % 10 == 4, F.lit("svc.only")).otherwise(fqn)
    return read(spark, sf_dir, "customer").where("c_custkey % 10 <> 3").select(
        F.concat(F.lit("t"), key.cast("string")).alias("table_id"), broken.alias("fully_qualified_name")
    )


def resolve_table(spark, sf_dir):
    events = change_events(read(spark, sf_dir, "events"))
    return classify_changes(events, _catalog(spark, sf_dir), "lake").select("event_id", "action", "fqn", "table_name")


# The stream: every event type stands for a table of the test data.
STREAM_TABLES = {"click": "supplier", "error": "part", "view": "region"}  # region is read without its rows


def stream_regenerate(spark, sf_dir):
    """Events as a stream; the tables that changed get a new sample, published as files."""
    base = scratch_path(spark, "stream")
    source = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    payload = F.concat(
        F.lit('{"id":"e","entityType":"table","eventType":"entityCreated","timestamp":1,"entityId":"'), "event_type", F.lit('"}')
    )
    rows = [(event, f"svc.db.sf.{table}") for event, table in STREAM_TABLES.items()]
    catalog = spark.createDataFrame(rows, "table_id string, fully_qualified_name string")

    def load(table_name):
        table = read(spark, sf_dir, table_name.split(".")[-1])
        return table.filter("false") if table_name.endswith("region") else table

    def publish(table_name, sample):
        sample.write.mode("overwrite").parquet(f"{base}/samples/{table_name}")

    def record(classified, batch_id):
        classified.select("event_id", "action", "table_name").write.mode("overwrite").parquet(f"{base}/events/batch={batch_id}")

    query = regenerate_on_change(
        stream.select("event_id", payload.alias("payload")), catalog, "lake", load, publish, f"{base}/checkpoint",
        record=record, available_now=True,
        report=lambda statuses, batch_id: statuses.write.mode("overwrite").parquet(f"{base}/status/batch={batch_id}"),
    )
    query.awaitTermination()
    counts = None
    for table in ("supplier", "part"):
        one = spark.read.parquet(f"{base}/samples/lake.sf.{table}").agg(F.count(F.lit(1)).alias("sampled"))
        one = one.select(F.lit(f"lake.sf.{table}").alias("table_name"), "sampled")
        counts = one if counts is None else counts.union(one)
    seen = spark.read.parquet(f"{base}/events").groupBy("table_name", "action").agg(F.count(F.lit(1)).alias("events"))
    status = spark.read.parquet(f"{base}/status").select("table_name", "status").distinct()
    return seen.join(counts, "table_name", "left").join(status, "table_name", "left")


QUERIES = {f.__name__: f for f in (
    event_route, schema_change, schema_change_with_deletes, resolve_table, stream_regenerate,
)}

BASE = f"SELECT event_id, user_id, event_id % {KINDS} AS k FROM events"
ACTION = (
    "CASE WHEN k IN (0, 1, 2, 5, 13) THEN 'generate' WHEN k IN (3, 4, 8, 9, 15) THEN 'none' WHEN k = 6 THEN 'echo' ELSE 'reject' END"
)

ORACLES = {
    "event_route": f"""
        SELECT event_id, CASE WHEN k = 0 THEN 'created' WHEN k IN (1, 2, 3, 4, 5, 8, 9, 13, 15) THEN 'updated'
                              WHEN k = 6 THEN 'test' ELSE 'rejected' END AS kind, {ACTION} AS action,
               CASE WHEN k IN (0, 1, 2, 3, 4, 5, 8, 9, 13, 15) THEN 't' || user_id END AS entity_id FROM ({BASE})""",
    "schema_change": f"""
        SELECT event_id, CASE WHEN k IN (1, 2, 5, 13) THEN true WHEN k IN (3, 4, 8, 9, 15) THEN false END AS schema_change,
               CASE WHEN k = 1 THEN 'c' || user_id WHEN k = 2 THEN 'a.' || user_id WHEN k = 13 THEN 'a.' || user_id || '|c' || user_id
                    WHEN k IN (3, 4, 5, 8, 9, 15) THEN '' END AS columns FROM ({BASE})""",
    "schema_change_with_deletes": f"""
        SELECT event_id, CASE WHEN k IN (1, 2, 4, 5, 13) THEN true WHEN k IN (3, 8, 9, 15) THEN false END AS schema_change,
               CASE WHEN k IN (1, 4) THEN 'c' || user_id WHEN k = 2 THEN 'a.' || user_id WHEN k = 13 THEN 'a.' || user_id || '|c' || user_id
                    WHEN k IN (3, 5, 8, 9, 15) THEN '' END AS columns FROM ({BASE})""",
    "resolve_table": f"""
        SELECT event_id, CASE WHEN a = 'generate' AND (c_custkey IS NULL OR c_custkey % 10 = 4) THEN 'unknown_table' ELSE a END AS action,
               CASE WHEN c_custkey % 10 = 4 THEN 'svc.only' WHEN c_custkey IS NOT NULL
                    THEN 'svc.db.' || lower(c_mktsegment) || '.my-table-' || c_custkey END AS fqn,
               CASE WHEN c_custkey % 10 <> 4 THEN 'lake.' || lower(c_mktsegment) || '.my_table_' || c_custkey END AS table_name
        FROM (SELECT *, {ACTION} AS a FROM ({BASE})) e
        LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 3) c
          ON c.c_custkey = e.user_id AND k IN (0, 1, 2, 3, 4, 5, 8, 9, 13, 15)""",
    "stream_regenerate": """
        SELECT CASE event_type WHEN 'click' THEN 'lake.sf.supplier' WHEN 'error' THEN 'lake.sf.part'
                               WHEN 'view' THEN 'lake.sf.region' END AS table_name,
               CASE WHEN event_type IN ('click', 'error', 'view') THEN 'generate' ELSE 'unknown_table' END AS action,
               count(*) AS events, CASE WHEN any_value(event_type) IN ('click', 'error') THEN 1000 END AS sampled,
               CASE WHEN any_value(event_type) IN ('click', 'error') THEN 'success' WHEN any_value(event_type) = 'view' THEN 'failed' END AS status
        FROM events GROUP BY 1, 2""",
}
