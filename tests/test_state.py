"""States of parts of a table, merged, against a fit of the whole."""

import pytest
from pyspark.sql import functions as F

from facsimile import fit, sample
from facsimile.operators.state import FitState, learn_state
from workloads.common import read


@pytest.fixture(scope="module")
def lines(spark, sf_dir):
    text = F.concat(F.lit("note "), F.sha2(F.col("l_orderkey").cast("string"), 256), F.lit(" end"))
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate", text.alias("note"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax")).alias("tax"), (F.col("l_linenumber") > 2).alias("late"),
        F.when(F.col("l_orderkey") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice")).alias("price"),
        F.encode("l_returnflag", "UTF-8").alias("raw"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber") % 2).alias("half"),
    )


def plain(model):
    columns = {s["column"]: {k: v for k, v in s.items() if k not in ("mean", "std", "spaced", "class")} for s in model.columns}
    entries = sorted(map(tuple, model.categories.select("column", "value", "count", "lo", "hi").collect()))
    return columns, model.quantiles, entries


def test_parts_equal_the_whole(spark, lines, tmp_path):
    whole = fit(lines, exact=True)
    cuts = [F.col("l_orderkey") % 3 == 0, F.col("l_orderkey") % 3 == 1, F.col("l_orderkey") % 3 == 2]
    state = learn_state(lines.filter(cuts[0]), str(tmp_path / "0"), exact=True)
    for i, cut in enumerate(cuts[1:], 1):
        state = FitState.load(spark, state.path).append(lines.filter(cut), str(tmp_path / str(i)))
    state = state.append(lines.limit(0), str(tmp_path / "none"))
    model = state.model(path=str(tmp_path / "model"))
    assert plain(model) == plain(whole)
    for a, b in zip(model.columns, whole.columns):
        for name in ("mean", "std"):
            assert a[name] == (b[name] if b[name] is None else pytest.approx(b[name], rel=1e-9))
    assert set(model.correlation) == set(whole.correlation)
    assert max(abs(r - whole.correlation[pair]) for pair, r in model.correlation.items()) < 0.06  # scores of the first 2,000 rows
    assert sample(model, 50, seed=1).count() == 50


def test_sketches(spark, lines, tmp_path):
    state = learn_state(lines.filter("l_orderkey % 2 = 0"), str(tmp_path / "a"), independent=True)
    model = state.append(lines.filter("l_orderkey % 2 = 1"), str(tmp_path / "b")).model()
    whole = fit(lines, independent=True)
    assert {s["column"]: s["kind"] for s in model.columns} == {s["column"]: s["kind"] for s in whole.columns}
    for name, grid in whole.quantiles.items():
        apart = sum(abs(a - b) for a, b in zip(model.quantiles[name], grid)) / len(grid)
        assert apart <= 0.005 * (grid[-1] - grid[0]), name
    assert plain(model)[2] == plain(whole)[2]


def test_new_categories_and_kinds(spark, tmp_path):
    old = spark.range(200).selectExpr("id AS n", "if(id % 2 = 0, 'a', 'b') AS c", "id % 5 AS m")
    state = learn_state(old, str(tmp_path / "a"), exact=True)
    grown = state.append(spark.range(100).selectExpr("id AS n", "'z' AS c", "id % 5 AS m"), str(tmp_path / "b")).model()
    assert {v for (v, _) in grown.literals["c"]} == {"a", "b", "z"} and grown.columns[0]["rows"] == 300
    texts = spark.range(20000).selectExpr("id AS n", "concat('text ', id) AS c", "0L AS m")
    with pytest.raises(ValueError, match="c from categorical to"):
        state.append(texts, str(tmp_path / "c")).model()
    with pytest.raises(ValueError, match="columns and types"):
        state.append(old.drop("m"), str(tmp_path / "d"))
    with pytest.raises(ValueError, match="own folder"):
        state.append(old, state.path)


def test_new_rows_alone_are_read(spark, tmp_path):
    old = str(tmp_path / "old")
    spark.range(100).selectExpr("id AS n", "id % 3 AS g").write.parquet(old)
    state = learn_state(spark.read.parquet(old), str(tmp_path / "a"), exact=True)
    spark.range(1).selectExpr("id AS n", "id % 3 AS g").write.mode("overwrite").parquet(old)
    assert state.append(spark.range(100, 150).selectExpr("id AS n", "id % 3 AS g"), str(tmp_path / "b")).model().columns[0]["rows"] == 150
