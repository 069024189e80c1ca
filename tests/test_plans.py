"""What the plans must look like at scale: pruned scans, no shuffles, no wide broadcasts."""

import pytest
from pyspark.sql import functions as F

from facsimile import fit, flatten, infer_plan, sample, unflatten
from facsimile.operators.ranks import running_totals
from workloads.common import order_nested, read


def plan_text(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nested") / "orders")
    order_nested(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def test_flat_names_prune_and_push_down(stored):
    flat = flatten(stored, infer_plan(stored, deep=True), lengths=True)
    text = plan_text(flat.select("`items__0.part`", "`head.total`").where("`head.total` > 10"))
    assert "ReadSchema: struct<head:struct<total:double>,items:array<struct<part:bigint>>>" in text
    assert "GreaterThan(head.total,10.0)" in text and "Exchange" not in text


def test_round_trip_is_one_projection(stored):
    plan = infer_plan(stored, deep=True)
    text = plan_text(unflatten(flatten(stored, plan, lengths=True), plan, arrays="length"))
    assert "Exchange" not in text and "ArrowEvalPython" not in text and "BatchEvalPython" not in text


def test_sampling_has_no_shuffle(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    assert "Exchange" not in plan_text(sample(fit(lines), 1000))


def test_running_totals_partition_by_slice(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("string").alias("g"), "id", F.lit(1).alias("w"))
    text = plan_text(running_totals(df, ["g"], ["id"], "w", slot_rows=100))
    assert "hashpartitioning(g#" in text and "SinglePartition" not in text
