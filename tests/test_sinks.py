"""Files, tables, documents and fan-out."""

import json

import pytest
from pyspark.sql import functions as F

from facsimile import as_records, overall_status, sample_document, width_errors, write_all, write_files, write_table
from facsimile.sinks.tables import TableWriteError, union_schema
from pyspark.sql import types as T


@pytest.fixture()
def df(spark):
    return spark.createDataFrame([(1, "a", [1, 2]), (2, None, None)], "id int, name string, v array<int>")


def test_files(df, spark, tmp_path):
    report = write_files(df, str(tmp_path), "out", "csv", "p").first()
    assert report["path"] == f"{tmp_path}/p/out.csv" and report["rows"] == 2 and report["mime"] == "text/csv"
    assert spark.read.option("header", True).csv(report["path"]).where("v = '[1,2]'").count() == 1
    lines = spark.read.text(write_files(df, str(tmp_path), "out", "json").first()["path"])
    assert lines.where(F.contains("value", F.lit('"name":null'))).count() == 1
    with pytest.raises(ValueError):
        write_files(df, str(tmp_path), "out", "excel")


def test_table_replaces_rows_and_unites_columns(df, spark, tmp_path):
    first = write_table(df, "sinks", "t1", str(tmp_path)).first()
    assert first["created"] and first["rows"] == 2
    second = write_table(df.select(F.col("id").cast("long").alias("id"), F.lit(1.5).alias("x")), "sinks", "t1", str(tmp_path)).first()
    assert not second["created"] and second["snapshot"] != first["snapshot"]
    table = spark.table("sinks.t1")
    assert table.columns == ["id", "name", "v", "x"] and table.schema["id"].dataType == T.LongType()
    assert table.where("x = 1.5 AND name IS NULL").count() == 2
    assert spark.read.parquet(first["location"]).count() == 2  # the old snapshot is still there


def test_table_can_read_itself(df, spark, tmp_path):
    write_table(df, "sinks", "t2", str(tmp_path))
    write_table(spark.table("sinks.t2").where("id = 1"), "sinks", "t2", str(tmp_path))
    assert spark.table("sinks.t2").count() == 1


def test_incompatible_change_is_refused(df, spark, tmp_path):
    write_table(df, "sinks", "t3", str(tmp_path))
    with pytest.raises(TableWriteError, match="union_schema"):
        write_table(df.withColumn("name", F.lit(5)), "sinks", "t3", str(tmp_path))
    assert spark.table("sinks.t3").count() == 2


def test_failed_write_leaves_no_table(df, spark, tmp_path):
    broken = df.withColumn("bad", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(TableWriteError, match="write_data"):
        write_table(broken, "sinks", "t4", str(tmp_path))
    assert not spark.catalog.tableExists("sinks.t4")
    write_table(df, "sinks", "t5", str(tmp_path))
    with pytest.raises(TableWriteError):
        write_table(broken, "sinks", "t5", str(tmp_path))
    assert spark.table("sinks.t5").columns == df.columns and spark.table("sinks.t5").count() == 2


def test_readers_always_find_a_table(spark, tmp_path, monkeypatch):
    """New columns, wider types and new folders under the entry that is there; a reader looks after every step."""
    def rows(ids, extra="int"):
        return spark.createDataFrame([(i, ["a=b/c", "x y", None, "q'"][i % 4], i) for i in ids], f"id int, kind string, n {extra}")

    write_table(rows(range(8)), "sinks", "t6", str(tmp_path), partition_by=["kind"])
    seen, plain = [], type(spark).sql

    def watched(self, query, *args, **more):
        done = plain(self, query, *args, **more)
        if query.startswith(("ALTER", "DROP", "CREATE TABLE")):
            plain(self, "REFRESH TABLE sinks.t6")
            seen.append((query.split()[0], self.table("sinks.t6").count()))
        return done

    monkeypatch.setattr(type(spark), "sql", watched)
    write_table(rows([0, 1, 4, 5, 9], "bigint").withColumn("more", F.lit(1.5)), "sinks", "t6", str(tmp_path))
    monkeypatch.undo()
    assert seen and all(step == "ALTER" and count >= 4 for step, count in seen)
    table = spark.table("sinks.t6")
    assert table.schema["n"].dataType == T.LongType() and {r.kind for r in table.collect()} == {"a=b/c", "x y"}
    assert table.count() == 5 and table.filter("kind = 'x y'").count() == 3 and table.filter("more = 1.5").count() == 5
    write_table(rows([2, 3, 6]).withColumn("more", F.lit(2.5)), "sinks", "t6", str(tmp_path))
    assert sorted((r.id, r.kind) for r in spark.table("sinks.t6").collect()) == [(2, None), (3, "q'"), (6, None)]
    with pytest.raises(TableWriteError, match="keep their types"):
        write_table(rows([1]).withColumn("kind", F.col("id")), "sinks", "t7", str(tmp_path), partition_by=["kind"])
        write_table(rows([1]).withColumn("kind", F.col("id").cast("long")), "sinks", "t7", str(tmp_path))


def test_two_writers(df, spark, tmp_path, monkeypatch):
    """A write that another one has overtaken is refused, and so is one that expects another snapshot."""
    from facsimile.sinks import tables

    first = write_table(df, "sinks", "t8", str(tmp_path)).first()["snapshot"]
    second = write_table(df, "sinks", "t8", str(tmp_path), expected=first).first()["snapshot"]
    assert tables.table_properties(spark, "sinks.t8")[tables.SNAPSHOT] == second
    with pytest.raises(TableWriteError, match="conflict"):
        write_table(df, "sinks", "t8", str(tmp_path), expected=first)
    counted = tables.counted

    def overtaken(rows, name):
        monkeypatch.setattr(tables, "counted", counted)
        write_table(df.limit(1), "sinks", "t8", str(tmp_path))
        return counted(rows, name)

    monkeypatch.setattr(tables, "counted", overtaken)
    with pytest.raises(TableWriteError, match="conflict"):
        write_table(df, "sinks", "t8", str(tmp_path))
    assert spark.table("sinks.t8").count() == 1
    monkeypatch.setattr(tables, "_point", lambda *a: 1 / 0)
    with pytest.raises(TableWriteError, match="commit"):
        write_table(df, "sinks", "t8", str(tmp_path))
    monkeypatch.undo()
    assert write_table(df, "sinks", "t8", str(tmp_path)).first()["rows"] == 2


def test_union_schema():
    a = T.StructType.fromDDL("x int, s struct<p:int>, l array<int>, d decimal(8,2)")
    b = T.StructType.fromDDL("l array<bigint>, s struct<q:string,p:int>, y date, d decimal(10,2)")
    assert union_schema(a, b).simpleString() == (
        "struct<x:int,s:struct<p:int,q:string>,l:array<bigint>,d:decimal(10,2),y:date>"
    )
    with pytest.raises(ValueError, match="'s.p'"):
        union_schema(a, T.StructType.fromDDL("s struct<p:string>"))


def test_document(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (2, 'b\"q', timestamp_ntz'2024-01-02 03:04:05', array(1)), (1, NULL, NULL, NULL) AS t(id, name, ts, v)"
    )
    row = sample_document(df, ["id"]).first()
    assert row["columns"] == ["id", "name", "ts", "v"]
    assert row["rows"] == [["1", None, None, None], ["2", 'b"q', "2024-01-02T03:04:05", "[1]"]]
    loaded = json.loads(row["document"])
    assert loaded["columns"] == row["columns"] and loaded["rows"][0] == [1, None, None, None]
    assert loaded["rows"][1][1] == 'b"q' and loaded["rows"][1][3] == [1]
    with pytest.raises(ValueError):
        sample_document(df, ["id"], 0)
    with pytest.raises(ValueError):
        sample_document(df, [])


def test_widths(spark):
    docs = spark.createDataFrame([(1, ["a", "b"], [["1", "2"], ["1"], ["1", "2", "3"]])], "d int, columns array<string>, rows array<array<string>>")
    assert [tuple(r) for r in width_errors(docs, ["d"]).orderBy("row").collect()] == [(1, 1, 1, 2), (1, 2, 3, 2)]


def test_fan_out(df, spark, tmp_path):
    good = lambda rows: write_files(rows, str(tmp_path), "a", "json")
    bad = lambda rows: write_files(rows, str(tmp_path), "a", "excel")

    def message(sinks):
        return overall_status(write_all(df, sinks)).first()["message"]

    assert message({"a": good, "b": None}) == "ok"
    assert message({"a": good, "b": bad}) == "partial_success"
    assert message({"a": bad, "b": bad}) == "error"
    failed = write_all(df, {"a": good, "b": bad}).where("sink = 'b'").first()
    assert failed["status"] == "failed" and "format must be" in failed["error"]
    with pytest.raises(ValueError):
        write_all(df, {"a": None})


def test_records(df):
    assert [json.loads(r["record"]) for r in as_records(df.orderBy("id")).collect()] == [
        {"id": 1, "name": "a", "v": [1, 2]}, {"id": 2, "name": None, "v": None},
    ]


@pytest.mark.parametrize("limit", [110_001, 1 << 30])
def test_large_document_has_no_top_k(spark, monkeypatch, limit):
    """Many rows are placed in slices; one reducer holds no more than a slice."""
    from facsimile.sinks import document

    plans, settle = [], document.settle
    monkeypatch.setattr(document, "settle", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df, name))
    rows = spark.range(0, 120_000, 1, 4).selectExpr("119999 - id AS id")
    got = sample_document(rows, ["id"], limit).sort("chunk").select("rows").collect()
    assert "Limit" not in plans[0] and "Sort" not in plans[0]
    assert [int(r[0]) for chunk in got for r in chunk.rows] == list(range(min(limit, 120_000)))
