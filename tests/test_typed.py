"""Format-driven casts and Avro schemas."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile import conform, format_paths, table_schema
from facsimile.functions import casts
from facsimile.operators.ingest import ingest
from facsimile.plans.avro import override_types, spark_type, uuid_paths
from workloads.typed import ORDER_AVRO


def micros(spark, text, **options):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(F.unix_micros(casts.timestamp_from_text(F.col("t"), **options))).first()[0]


def instant(*parts, offset=0):
    zone = dt.timezone(dt.timedelta(hours=offset))
    delta = dt.datetime(*parts, tzinfo=zone) - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return delta // dt.timedelta(microseconds=1)


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-01-02T03:04:05Z", instant(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02T03:04:05.123456789Z", instant(2024, 1, 2, 3, 4, 5, 123456)),
        ("2024-01-02T03:04:05-05:30", instant(2024, 1, 2, 3, 4, 5, offset=-5.5)),
        ("2024-01-02T03:04:05", instant(2024, 1, 2, 3, 4, 5, offset=3)),
        ("2024-01-02 03:04", instant(2024, 1, 2, 3, 4, offset=3)),
        ("2024-01-02T03+01:00", instant(2024, 1, 2, 3, offset=1)),
        ("2024-01-02T03", instant(2024, 1, 2, 3, offset=3)),
        ("2024-01-02", instant(2024, 1, 2, offset=3)),
        ("1500-01-01T00:00:00Z", casts.MICROS_MIN),
        ("2500-01-01T00:00:00Z", casts.MICROS_MAX),
        ("junk", casts.MICROS_MIN),
        ("12:30:00", casts.MICROS_MIN),
        ("2024-02-30T00:00:00Z", casts.MICROS_MIN),
        (None, None),
    ],
)
def test_timestamp_text(spark, text, want):
    assert micros(spark, text) == want


def test_timestamp_errors(spark):
    assert micros(spark, "junk", on_error="null") is None
    with pytest.raises(PySparkException, match="Cannot convert 'junk' to timestamp at 'a.b'"):
        micros(spark, "junk", on_error="raise", path="a.b")


def test_nanos(spark):
    df = spark.createDataFrame([(-1,), (1999,), (casts.NANOS_MIN,), (casts.NANOS_MAX,), (None,)], "n bigint")
    got = [r[0] for r in df.select(F.unix_micros(casts.timestamp_from_nanos(F.col("n")))).collect()]
    assert got == [-1, 1, casts.MICROS_MIN, casts.MICROS_MAX, None]


def test_uint64(spark):
    df = spark.createDataFrame([("18446744073709551615",), ("0007",), ("18446744073709551616",), ("-1",), (None,)], "t string")
    got = [r[0] for r in df.select(casts.uint64_from_text(F.col("t"), on_error="null").cast("string")).collect()]
    assert got == ["18446744073709551615", "7", None, None, None]
    with pytest.raises(PySparkException, match="Cannot convert 'x' to uint64 at 'parcel.id'"):
        spark.createDataFrame([("x",)], "t string").select(casts.uint64_from_text(F.col("t"), path="parcel.id")).collect()


def test_uuid(spark):
    text = "123E4567-e89b-12d3-a456-426614174000"
    df = spark.createDataFrame([(text,), (text.replace("-", ""),), ("123",)], "t string")
    got = [tuple(r) for r in df.select(F.hex(casts.uuid_bytes(F.col("t"))), casts.uuid_text(F.col("t"))).collect()]
    assert got == [(text.replace("-", "").upper(), text.lower())] * 2 + [(None, None)]


def test_format_paths():
    assert format_paths(ORDER_AVRO) == {
        "id": "uint64", "placed": "RFC3339Nano", "detail.due": "ISO8601Date", "detail.steps._item.at": "ISO8601",
    }
    assert uuid_paths(ORDER_AVRO) == {"detail.refs._item": "uuid"}
    assert format_paths("string") == {}


def test_schema_types():
    schema, _ = table_schema(ORDER_AVRO)
    assert schema["id"].dataType == T.DecimalType(20, 0) and not schema["id"].nullable
    assert schema["placed"].dataType == T.TimestampType() and schema["placed"].nullable
    steps = schema["detail"].dataType["steps"].dataType
    assert steps.containsNull and steps.elementType["at"].dataType == T.TimestampType()
    decimal = {"type": "bytes", "logicalType": "decimal", "precision": 8, "scale": 3}
    assert spark_type(["null", decimal]) == T.DecimalType(8, 3)
    assert spark_type({"type": "map", "values": "long"}) == T.MapType(T.StringType(), T.LongType())
    with pytest.raises(ValueError, match="exactly one member"):
        spark_type(["null", "int", "string"])


def test_custom_mapping_and_misplaced_format():
    schema = T.StructType.fromDDL("a string, b array<string>")
    assert override_types(schema, {"a": "whole"}, {"whole": T.LongType()})["a"].dataType == T.LongType()
    with pytest.raises(ValueError, match="scalar"):
        override_types(schema, {"b": "ISO8601"})


def test_null_containers(spark):
    df = spark.createDataFrame([(1, None, None)], "id int, l array<string>, s struct<a:string>")
    target = T.StructType.fromDDL("id bigint, l array<int>, s struct<a:int,b:string>, extra double")
    kept = conform(df, target).first()
    assert (kept["l"], kept["s"], kept["extra"]) == (None, None, None)
    loose = conform(df, target, null_lists="empty", null_structs="expand").first()
    assert loose["l"] == [] and loose["s"].asDict() == {"a": None, "b": None}
    with pytest.raises(ValueError):
        conform(df, target, on_error="ignore")


def test_ingest_sets_rows_apart(spark):
    schema = T.StructType.fromDDL("id INT NOT NULL, at TIMESTAMP, tags ARRAY<INT>, inner STRUCT<a: INT NOT NULL, b: DATE>, gone STRING")
    rows = [
        ("1", "2024-01-01T00:00:00Z", ["1", None], ("3", "2024-01-01"), "u"),
        (None, "x", None, None, None),
        ("z", None, ["a", "2", "b"], (None, "bad"), None),
        ("4", "2024-01-01", [], None, "v"),
    ]
    staged = spark.createDataFrame(rows, "id string, at string, tags array<string>, inner struct<a:string,b:string>, extra string")
    found = ingest(staged, schema)
    assert found.accepted().schema.simpleString() == schema.simpleString()
    assert sorted(r.id for r in found.accepted().collect()) == [1, 4]
    notes = {r.at: [tuple(p) for p in r.problems] for r in found.rejected().collect()}
    assert notes == {
        "x": [("id", None, "missing"), ("at", "x", "not a timestamp")],
        None: [
            ("id", "z", "not a int"), ("tags._item", "a", "not a int"), ("tags._item", "b", "not a int"),
            ("inner.a", None, "missing"), ("inner.b", "bad", "not a date"),
        ],
    }
    assert found.rejected().columns == [*staged.columns, "problems"]
    counts = {(r.path, r.reason): (r.rows, r.cells) for r in found.counts().collect()}
    assert counts[("tags._item", "not a int")] == (1, 2) and counts[("id", "missing")] == (1, 1)


def test_ingest_shapes_and_avro(spark):
    """Containers that are none, absent columns, and the formats that an Avro record brings."""
    avro = {
        "type": "record", "name": "r",
        "fields": [
            {"name": "key", "type": {"type": "string", "logicalType": "uuid"}},
            {"name": "list", "type": ["null", {"type": "array", "items": "int"}]},
            {"name": "rec", "type": ["null", {"type": "record", "name": "s", "fields": [{"name": "x", "type": ["null", "int"]}]}]},
            {"name": "need", "type": "int"},
        ],
    }
    staged = spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000", "no list", "no record"), ("nope", None, None)], "key string, list string, rec string")
    notes = [[(p.path, p.reason) for p in r.problems] for r in sorted(ingest(staged, avro).rejected().collect(), key=lambda r: r.key)]
    assert notes[0] == [("list", "not a list"), ("rec", "not a record"), ("need", "missing")]
    assert notes[1] == [("key", "not a uuid"), ("need", "missing")]
    plain = spark.createDataFrame([(1,)], "a int")
    assert ingest(plain, plain.schema).accepted().count() == 1 and ingest(plain.limit(0), plain.schema).rows.count() == 0
