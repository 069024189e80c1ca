"""Flatten and unflatten on hand-made rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from facsimile import Plan, array_groups, flatten, infer_plan, plan_from_names, unflatten
from facsimile.plans.shape import type_label
from pyspark.sql import types as T


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_ragged_list(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5]), (3, [6])], "id bigint, v array<bigint>")
    flat = flatten(df, infer_plan(df))
    assert flat.columns == ["id", "v__0", "v__1", "v__2"]
    assert rows(flat, "id") == [(1, 1, 2, 3), (2, 4, 5, None), (3, 6, None, None)]
    assert rows(unflatten(flat, infer_plan(df)), "id") == rows(df, "id")


def test_index_style(spark):
    df = spark.createDataFrame([(1, ["a", "b"])], "id bigint, v array<string>")
    assert flatten(df, infer_plan(df), index_style="[i]").columns == ["id", "v[0]", "v[1]"]
    with pytest.raises(ValueError):
        flatten(df, infer_plan(df), index_style="(i)")


def test_null_and_empty_lists(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None)], "id bigint, v array<bigint>")
    plan = infer_plan(df)
    assert plan.extent("v") == (True, 3, False)
    flat = flatten(df, plan)
    assert "v._is_null" in flat.columns
    assert rows(unflatten(flat, plan), "id") == [(1, [1, 2, 3]), (2, []), (3, None)]


def test_null_elements_stay(spark):
    df = spark.createDataFrame([(1, [1, 2, None]), (2, [4, 5, 6])], "id bigint, v array<bigint>")
    plan = infer_plan(df)
    assert plan.extent("v").null_items
    assert rows(unflatten(flatten(df, plan), plan), "id") == rows(df, "id")


def test_compaction_closes_gaps(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5, 6])], "id bigint, v array<bigint>")
    plan = infer_plan(df)
    flat = spark.createDataFrame([(1, 1, 2, 3), (2, 4, None, 6)], "id bigint, v__0 bigint, v__1 bigint, v__2 bigint")
    assert rows(unflatten(flat, plan), "id") == [(1, [1, 2, 3]), (2, [4, 6])]
    assert rows(unflatten(flat, plan, arrays="pad"), "id") == [(1, [1, 2, 3]), (2, [4, None, 6])]


def test_missing_places(spark):
    df = spark.createDataFrame([(1, [1, 2, 3])], "id bigint, v array<bigint>")
    plan = infer_plan(df)
    flat = spark.createDataFrame([(1, 1)], "id bigint, v__0 bigint")
    assert rows(unflatten(flat, plan), "id") == [(1, [1])]
    assert rows(unflatten(flat, plan, arrays="pad"), "id") == [(1, [1, None, None])]


def test_matrix_and_list_of_structs_stay_whole(spark):
    df = spark.createDataFrame(
        [(1, [[1, 2], [3]], [("a", 1)]), (2, [[4]], [("b", 2), ("c", 3)])],
        "id bigint, m array<array<bigint>>, s array<struct<k:string,n:int>>",
    )
    plan = infer_plan(df)
    flat = flatten(df, plan)
    assert flat.columns == ["id", "m__0", "m__1", "s__0", "s__1"]
    assert rows(unflatten(flat, plan), "id") == rows(df, "id")
    assert plan.extent("m._item").width == 2


def test_deep(spark):
    df = spark.createDataFrame(
        [(1, ("x", (["a"], [1, 2]))), (2, ("y", ([], [3])))],
        "id bigint, p struct<name:string,meta:struct<tags:array<string>,scores:array<bigint>>>",
    )
    plan = infer_plan(df)
    flat = flatten(df, plan)
    assert flat.columns == ["id", "p.name", "p.meta.tags__0", "p.meta.scores__0", "p.meta.scores__1"]
    assert rows(unflatten(flat, plan), "id") == rows(df, "id")


def test_null_struct(spark):
    df = spark.createDataFrame([(1, ("a", 1)), (2, None)], "id bigint, u struct<name:string,age:bigint>")
    plan = infer_plan(df)
    flat = flatten(df, plan)
    assert rows(flat, "id") == [(1, False, "a", 1), (2, True, None, None)]
    assert rows(unflatten(flat, plan), "id")[1] == (2, None)
    assert rows(unflatten(flat, plan, null_structs="expand"), "id")[1][1].asDict() == {"name": None, "age": None}


def test_saved_plan_on_new_data(spark, tmp_path):
    df = spark.createDataFrame([(1, ("a", 1))], "id bigint, user struct<name:string,age:bigint>")
    plan = infer_plan(df)
    plan.save(spark, str(tmp_path / "plan"))
    loaded = Plan.load(spark, str(tmp_path / "plan"))
    assert loaded == plan
    flat = spark.createDataFrame([(7, "z", 9)], ["id", "user.name", "user.age"])
    assert rows(unflatten(flat, loaded), "id") == [(7, ("z", 9))]


def test_far_timestamps_as_text(spark):
    df = spark.sql(
        "SELECT 1 AS id, named_struct('ts', timestamp_ntz'1800-01-01 00:00:00', 'n', 'a') AS e, "
        "array(timestamp_ntz'2500-01-01 01:02:03.5') AS times"
    )
    flat = flatten(df, infer_plan(df), timestamps="string")
    assert rows(flat, "id") == [(1, "1800-01-01T00:00:00", "a", "2500-01-01T01:02:03.500000")]
    assert rows(unflatten(flat, infer_plan(df)), "id") == rows(df, "id")


def test_empty_table(spark):
    df = spark.createDataFrame([], "id bigint, v array<int>, s struct<a:int>")
    plan = infer_plan(df)
    flat = flatten(df, plan)
    assert flat.columns == ["id", "s.a"]
    assert unflatten(flat, plan).columns == df.columns


def test_map_and_void_carried(spark):
    df = spark.sql("SELECT 1 AS id, map('a', 1) AS m, NULL AS n")
    plan = infer_plan(df)
    assert [r.label for r in plan.rows(spark).collect()] == ["int64", "object", "null"]
    assert rows(unflatten(flatten(df, plan), plan), "id") == [(1, {"a": 1}, None)]


def test_collision_is_an_error(spark):
    df = spark.createDataFrame([(1, ("x",))], "`s.a` int, s struct<a:string>")
    with pytest.raises(ValueError, match="same column"):
        flatten(df, infer_plan(df))


def test_keep_nested(spark):
    df = spark.createDataFrame([(1, list(range(50)))], "id int, v array<int>")
    assert flatten(df, infer_plan(df, keep_nested=["v"])).columns == ["id", "v"]


def test_unflatten_needs_a_plan(spark):
    with pytest.raises(ValueError):
        unflatten(spark.range(1), None)


def test_array_groups_and_names(spark):
    groups = array_groups(["id", "v__10", "v__2", "v__x", "a.b__0"])
    assert groups == {"v": ["v__2", "v__10"], "a.b": ["a.b__0"]}
    assert array_groups(["v[1]", "v[0]", "v__0"], "[i]") == {"v": ["v[0]", "v[1]"]}
    df = spark.createDataFrame([(1, ("a", [1, 2])), (2, None)], "id int, s struct<k:string,v:array<int>>")
    flat = flatten(df, infer_plan(df), lengths=True)
    plan = plan_from_names(flat.schema)
    assert plan.schema.simpleString() == "struct<id:int,s:struct<k:string,v:array<int>>>"
    assert rows(unflatten(flat, plan, arrays="length"), "id") == rows(df, "id")


@pytest.mark.parametrize("style", ["__i", "[i]"])
def test_names_of_any_depth(spark, style):
    df = spark.createDataFrame(
        [(1, [("a", [1, 2]), ("b", None)], [[1], [2, 3]]), (2, None, [])],
        "id int, x array<struct<a:string,n:array<int>>>, m array<array<int>>",
    )
    flat = flatten(df, infer_plan(df, deep=True), index_style=style, lengths=True)
    plan = plan_from_names(flat.schema, style)
    assert plan.deep and plan.schema.simpleString() == df.schema.simpleString()
    assert rows(unflatten(flat, plan, arrays="length", index_style=style), "id") == rows(df, "id")


def test_labels():
    assert [type_label(t) for t in (T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType(), T.NullType())] == [
        "int64", "float64", "bool", "object", "null",
    ]


item = st.none() | st.tuples(st.none() | st.integers(-9, 9), st.none() | st.lists(st.none() | st.text("ab'\\`", max_size=3), max_size=3))
row = st.tuples(
    st.none() | st.lists(st.none() | st.integers(-5, 5), max_size=4),
    st.none() | st.tuples(st.none() | st.floats(-1, 1), st.none() | st.lists(item, max_size=3)),
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=st.lists(row, min_size=1, max_size=6), deep=st.booleans())
def test_round_trip(spark, data, deep):
    schema = "id int, v array<int>, s struct<x:double,items:array<struct<n:int,t:array<string>>>>"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], schema)
    plan = infer_plan(df, deep=deep)
    back = unflatten(flatten(df, plan, lengths=True), Plan.from_json(plan.to_json()), arrays="length")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert rows(back, "id") == rows(df, "id")
