"""Change events: rules one by one, and the stream against the batch."""

import json

import pytest
from pyspark.sql import functions as F

from facsimile import parse_events, regenerate_on_change, resolve_tables
from workloads.common import read

COLUMN = json.dumps([{"name": "amount", "fullyQualifiedName": "s.d.c.t.amount", "dataType": "INT"}])


def event(kind="entityUpdated", **extra):
    return {"id": "1", "entityType": "table", "eventType": kind, "entityId": "t1", "timestamp": 5, "ignored": {"a": 1}, **extra}


def update(added=(), updated=(), deleted=()):
    return event(changeDescription={"fieldsAdded": list(added), "fieldsUpdated": list(updated), "fieldsDeleted": list(deleted)})


def field(name, new=None, old=None):
    values = {"name": name}
    if new is not None:
        values["newValue"] = new
    if old is not None:
        values["oldValue"] = old
    return values


CASES = [
    ("created", event("entityCreated"), "created", "generate", None),
    ("column added", update([field("columns", COLUMN)]), "updated", "generate", ["amount"]),
    ("column changed", update(updated=[field("columns", COLUMN, COLUMN)]), "updated", "generate", ["amount"]),
    ("attribute", update([field("columns.a.b.description", "x")]), "updated", "generate", ["a.b"]),
    ("tags", update([field("columns.a.tags", "x")]), "updated", "none", []),
    ("column deleted", update(deleted=[field("columns", old=COLUMN)]), "updated", "none", []),
    ("attribute deleted", update(deleted=[field("columns.a.description", old="x")]), "updated", "none", []),
    ("empty list", update([field("columns", "[]")]), "updated", "generate", []),
    ("no list", update([field("columns", "text")]), "updated", "none", []),
    ("list of other things", update([field("columns", '[{"name": "a"}]')]), "updated", "none", []),
    ("one object", update([field("columns", '{"name": "a", "fullyQualifiedName": "b"}')]), "updated", "none", []),
    ("old value is no list", update(updated=[field("columns", COLUMN, "text")]), "updated", "none", []),
    ("unrelated", update([field("owner", "x")]), "updated", "none", []),
    ("nothing changed", update(), "updated", "none", []),
    ("no lists given", event(changeDescription={}), "updated", "none", []),
    ("value missing", update([field("columns")]), "rejected", "reject", None),
    ("no description", event(), "rejected", "reject", None),
    ("other entity", {**event("entityCreated"), "entityType": "topic"}, "rejected", "reject", None),
    ("other event", event("entityDeleted"), "rejected", "reject", None),
    ("test message", {"message": "hello"}, "test", "echo", None),
    ("object as value", update([field("columns", [{"name": "a", "fullyQualifiedName": "b"}])]), "rejected", "reject", None),
    ("number as value", update([field("owner", 5)]), "rejected", "reject", None),
    ("number as old value", update(updated=[field("owner", "x", 5)]), "rejected", "reject", None),
    ("number as field name", update([{"name": 5, "newValue": "x"}]), "rejected", "reject", None),
    ("number as id", {**event("entityCreated"), "id": 7}, "rejected", "reject", None),
    ("object as message", {"message": {"a": 1}}, "rejected", "reject", None),
    ("number as column name", update([field("columns", '[{"name": 5, "fullyQualifiedName": "b"}]')]), "updated", "none", []),
    ("list of numbers", update([field("columns", "[1, 2]")]), "updated", "none", []),
    ("digits as text", update([field("columns", '[{"name": "5", "fullyQualifiedName": "6"}]')]), "updated", "generate", ["5"]),
    ("no JSON", "{broken", "rejected", "reject", None),
]


def test_rules(spark):
    rows = [(name, body if isinstance(body, str) else json.dumps(body)) for name, body, *_ in CASES]
    parsed = parse_events(spark.createDataFrame(rows, "name string, payload string"))
    got = {r["name"]: (r["kind"], r["action"], r["changed_columns"]) for r in parsed.collect()}
    assert got == {name: (kind, action, columns) for name, _, kind, action, columns in CASES}


def test_deletes_can_count(spark):
    rows = [(json.dumps(update(deleted=[field("columns", old=COLUMN)])),)]
    parsed = parse_events(spark.createDataFrame(rows, "payload string"), count_deletes=True).first()
    assert parsed["schema_change"] and parsed["changed_columns"] == ["amount"]


def test_resolve(spark):
    rows = [(i, json.dumps({**event("entityCreated"), "entityId": f"t{i}"})) for i in range(4)]
    catalog = spark.createDataFrame(
        [("t0", "svc.db.my-schema.orders"), ("t1", "svc.orders")], "table_id string, fully_qualified_name string"
    )
    out = resolve_tables(parse_events(spark.createDataFrame(rows, "n int, payload string")), catalog, "lake")
    got = {r["n"]: (r["action"], r["table_name"]) for r in out.collect()}
    assert got == {
        0: ("generate", "lake.my_schema.orders"), 1: ("unknown_table", None), 2: ("unknown_table", None), 3: ("unknown_table", None),
    }


def test_stream(spark, sf_dir, tmp_path):
    """Two files of events: one sample per changed table and batch, same classes as the batch job."""
    rows = [(i, c[1] if isinstance(c[1], str) else json.dumps(c[1])) for i, c in enumerate(CASES)]
    events = spark.createDataFrame(rows, "n int, payload string")
    folder = str(tmp_path / "in")
    events.coalesce(1).write.parquet(folder)
    catalog = spark.createDataFrame([("t1", "svc.db.sf.supplier")], "table_id string, fully_qualified_name string")
    published, seen = [], []

    def publish(name, sample):
        published.append((name, sample.count(), sample.columns))

    query = regenerate_on_change(
        spark.readStream.schema(events.schema).parquet(folder), catalog, "lake",
        load=lambda name: read(spark, sf_dir, name.split(".")[-1]), publish=publish,
        checkpoint=str(tmp_path / "checkpoint"), output_rows=50,
        record=lambda batch, i: seen.extend((r["n"], r["action"]) for r in batch.collect()), available_now=True,
    )
    query.awaitTermination()
    assert published == [("lake.sf.supplier", 50, read(spark, sf_dir, "supplier").columns)]
    assert dict(seen) == {i: c[3] for i, c in enumerate(CASES)}


def test_stream_survives_a_bad_table(spark, tmp_path):
    events = spark.createDataFrame([(json.dumps(event("entityCreated")),)], "payload string")
    folder = str(tmp_path / "in")
    events.write.parquet(folder)
    catalog = spark.createDataFrame([("t1", "a.b.c.d"), ("t2", "a.b.c.e")], "table_id string, fully_qualified_name string")
    second = json.dumps({**event("entityCreated"), "entityId": "t2"})
    spark.createDataFrame([(second,)], "payload string").write.mode("append").parquet(folder)
    published, reported = [], []
    query = regenerate_on_change(
        spark.readStream.schema(events.schema).parquet(folder), catalog, "lake",
        load=lambda name: spark.range(0 if name.endswith("d") else 40).toDF("x"),
        publish=lambda name, sample: published.append((name, sample.count())), checkpoint=str(tmp_path / "checkpoint"),
        output_rows=7, available_now=True, report=lambda statuses, i: reported.extend(tuple(r) for r in statuses.collect()),
    )
    query.awaitTermination()
    assert published == [("lake.c.e", 7)]
    assert sorted(r[:2] for r in reported) == [("lake.c.d", "failed"), ("lake.c.e", "success")]
    assert [r[2] for r in reported if r[1] == "failed"] == ["no valid records loaded from source"]


def test_hot_table_in_events(spark):
    """Most events name one table; every event still gets its answer."""
    created = F.concat(F.lit('{"id":"1","entityType":"table","eventType":"entityCreated","timestamp":1,"entityId":"'),
                       F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.col("id").cast("string")), F.lit('"}'))
    events = spark.range(3000).select("id", created.alias("payload"))
    catalog = spark.createDataFrame([("hot", "a.b.c.d")], "table_id string, fully_qualified_name string")
    out = resolve_tables(parse_events(events), catalog, "lake").groupBy("action").count().collect()
    assert {r["action"]: r["count"] for r in out} == {"generate": 2000, "unknown_table": 1000}
