"""Reading, limits, landing checks, names."""

import base64

import pytest
from pyspark.sql import functions as F

from facsimile import check_payloads, json_records, read_table, require_rows, split_payloads
from facsimile.session import settle, snapshot
from facsimile.sources.naming import engine_table, file_path, record_namespace, record_title, table_location
from facsimile.sources.tables import first_rows, jdbc_options, json_schema, ranked_head, s3_options, training_rows


def test_limits(spark, sf_dir):
    df = read_table(spark, "parquet", f"{sf_dir}/orders.parquet", limit=5, order_by=["o_orderkey"])
    assert [r["o_orderkey"] for r in df.collect()] == [0, 1, 2, 3, 4]
    assert read_table(spark, "parquet", f"{sf_dir}/orders.parquet", limit=7).count() == 7
    assert first_rows(spark.range(3), 10).count() == 3
    with pytest.raises(ValueError):
        first_rows(spark.range(3), 0)
    assert first_rows(spark.range(3), 2_000_000).count() == 3


@pytest.mark.parametrize("limit", [1, 99, 250, 1000])
def test_ranked_head(spark, limit):
    df = spark.range(600).select((F.col("id") * 7919 % 600).alias("k"), F.col("id").alias("v"))
    got = ranked_head(df, limit, ["k"], slot_rows=50)
    assert sorted(r["k"] for r in got.collect()) == list(range(min(limit, 600)))


@pytest.mark.parametrize("limit", [1, 40, 57, 333, 599])
def test_ties_and_types(spark, limit):
    """Repeated keys, nulls first, and keys whose digits must survive: exactly as many rows, none out of order."""
    n = F.col("id") * 7919 % 600
    keys = [
        F.when(n % 9 != 0, F.concat(F.lit("q'\\\""), (n % 5).cast("string"))).alias("text"),
        F.timestamp_micros(n % 4 * 1_000_003).alias("at"),
        (n / 7).cast("decimal(20,9)").alias("exact"),
        F.when(n % 50 != 0, n / 3).otherwise(float("nan")).alias("number"),
    ]
    df = spark.range(600).select(*keys, F.lit(1).alias("v"))
    for order in (["text"], ["at", "text"], ["exact"], ["number", "at"]):
        got = first_rows(df, limit, order)
        want = df.orderBy(*order).limit(limit)
        assert got.count() == limit and got.columns == df.columns
        assert sorted(map(str, got.select(*order).collect())) == sorted(map(str, want.select(*order).collect()))


def test_limits_gather_no_rows(spark, sf_dir, monkeypatch):
    """One path for every size; rows stay where the scan has them."""
    path = f"{sf_dir}/lineitem.parquet"
    for limit in (10, 3_000, 5_999):
        for order in ([], ["l_extendedprice"], ["l_orderkey", "l_linenumber"]):
            df = first_rows(spark.read.parquet(path), limit, order)
            text = df._jdf.queryExecution().executedPlan().toString()
            assert "SinglePartition" not in text and "Limit" not in text and "TakeOrdered" not in text
            assert df.count() == limit
    many = spark.range(0, 1000, 1, 7).filter("id % 3 = 0")
    assert [first_rows(many, n).count() for n in (1, 48, 49, 200, 333, 334, 900)] == [1, 48, 49, 200, 333, 334, 334]
    assert first_rows(many.groupBy((F.col("id") % 50).alias("k")).count(), 20).count() == 20


def test_training_rows_are_fixed(spark, sf_dir):
    rows = training_rows(read_table(spark, "parquet", f"{sf_dir}/lineitem.parquet"), 100)
    assert rows.count() == 100 and sorted(map(str, rows.collect())) == sorted(map(str, rows.collect()))


def test_database_tables_are_dealt_out(spark):
    """The options that Spark cuts the ranges by; its own cutting is asked for the ranges, no database is needed."""
    assert jdbc_options("t") == {"dbtable": "t"}
    made = jdbc_options("t", "id", (0, 1000), 4)
    assert made == {"dbtable": "t", "partitionColumn": "id", "lowerBound": "0", "upperBound": "1000", "numPartitions": "4"}
    for bad in (dict(bounds=(0, 1)), dict(parts=3), dict(split_by="id"), dict(split_by="id", bounds=(5, 5), parts=2), dict(split_by="id", bounds=(0, 5), parts=0)):
        with pytest.raises(ValueError):
            jdbc_options("t", **bad)
    with pytest.raises(ValueError, match="jdbc"):
        read_table(spark, "parquet", "x", split_by="id", bounds=(0, 1), parts=2)


def test_json_files_and_guards(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"a": 1, "b": {"c": [1, 2]}}\n{"a": 2, "d": "x"}\n')
    df = read_table(spark, "json", str(path))
    assert df.columns == ["a", "b", "d"] and df.count() == 2
    array = tmp_path / "b.json"
    array.write_text('[{"a": 1}, {"b": null}]')
    assert read_table(spark, "json", str(array), options={"multiLine": "true"}).count() == 2
    empty = tmp_path / "c.json"
    empty.write_text("{}\n{}\n")
    with pytest.raises(ValueError, match="empty"):
        read_table(spark, "json", str(empty))
    with pytest.raises(ValueError, match="no valid records"):
        require_rows(spark.range(0))
    assert require_rows(spark.range(1)).count() == 1


def test_json_columns(spark):
    data = [(1, '{"a": 1, "b": {"c": 2.5}}'), (2, '{"a": 7, "x y": [true]}'), (3, "no json"), (4, None)]
    df = spark.createDataFrame(data, "id int, t string")
    assert "`x y`" in json_schema(df, "t")
    got = {r["id"]: r for r in json_records(df, "t").collect()}
    assert got[1]["b"]["c"] == 2.5 and got[2]["x y"] == [True] and got[3]["a"] is None and got[4]["a"] is None
    with pytest.raises(ValueError, match="empty"):
        json_records(df.where("id > 2"), "t")


def test_kinds_of_sources(spark, sf_dir):
    with pytest.raises(ValueError, match="s3://"):
        read_table(spark, "s3", "/local/path")
    with pytest.raises(ValueError, match="kind must be"):
        read_table(spark, "excel", "x")
    spark.range(2).select("id", F.lit(1).alias("_dq"), F.lit(1).alias("keep")).createOrReplaceTempView("with_internal")
    assert read_table(spark, "table", "with_internal", drop=["absent"]).columns == ["id", "keep"]


def test_s3_options():
    common = {"access_key": "A", "secret_key": "B", "region": "r"}
    assert s3_options({"access_key": "X"}, common)["fs.s3a.access.key"] == "X"
    assert s3_options({"access_key": "X"}, common)["fs.s3a.secret.key"] == "B"
    assert "fs.s3a.access.key" not in s3_options({"access_key": "X"}, {})
    assert s3_options({"endpoint_url": "http://h"}, {})["fs.s3a.endpoint"] == "http://h"


def test_payloads(spark):
    good = base64.b64encode(b"Obj\x01rest").decode()
    data = [
        (1, good, "a-b.c.avro"), (2, good[:-1], "a.avro"), (3, base64.b64encode(b"Obj\x02rest").decode(), "a.avro"),
        (4, good, "a.AVRO"), (5, good, None), (6, "", "a.avro"), (7, None, "a.avro"), (8, good.replace("T", "*"), "a.avro"),
        (9, good, "a b.avro"), (10, "T2Jq", "a.avro"),
    ]
    df = spark.createDataFrame(data, "id int, payload string, filename string")
    got = {r["id"]: r["reason"] for r in check_payloads(df).collect()}
    assert got == {
        1: None, 2: "malformed base64", 3: "not an Avro container", 4: "bad file name", 5: None,
        6: "not an Avro container", 7: "malformed base64", 8: "malformed base64", 9: "bad file name",
        10: "not an Avro container",
    }
    accepted, quarantine = split_payloads(df)
    assert accepted.count() == 2 and quarantine.count() == 8 and accepted.columns == df.columns


def test_names(spark):
    df = spark.createDataFrame([("test.User",), ("User",), ("a.b.C",), ("",)], "n string")
    got = [tuple(r) for r in df.select(record_namespace(F.col("n"), "main"), record_title(F.col("n"))).collect()]
    assert got == [("test", "User"), ("main", "User"), ("a.b", "C"), (None, None)]
    df = spark.createDataFrame([("svc.db.my-schema.v2-t",), ("a.b.c",), ("a.b.c.d.e",)], "n string")
    assert [r[0] for r in df.select(engine_table(F.col("n"), "lake")).collect()] == ["lake.my_schema.v2_t", None, None]
    assert file_path("simple", "csv", "data/examples") == "data/examples/simple.csv"
    assert file_path("dir/simple.txt", "json") == "dir/simple.json"
    assert file_path("dir/simple", "parquet") == "dir/simple.parquet"
    assert file_path("/a/b.c/.hidden", "csv", "p") == "p/a/b.c/.hidden.csv"
    assert table_location("s3://b/wh", "ns", "t") == "s3://b/wh/ns.db/t/"
    with pytest.raises(ValueError):
        file_path("x", "excel")


def test_spread(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    wide = snapshot(df)
    assert len(wide.inputFiles()) == spark.sparkContext.defaultParallelism
    assert wide.count() == df.count()
    assert snapshot(spark.range(5)).count() == 5


def test_folder_without_the_setting(spark, monkeypatch):
    from facsimile import session

    monkeypatch.setattr(session, "CHECKPOINT_SETTING", "spark.absent.setting")
    first = session.shared_dir(spark)
    assert session.shared_dir(spark) == first and "facsimile-" in first


def test_settle_goes_to_the_shared_folder(spark):
    stored = settle(spark.range(10).toDF("x"), "check")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder in f for f in stored.inputFiles()) and stored.count() == 10
