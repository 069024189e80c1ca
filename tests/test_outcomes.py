"""Parts of the outcomes query: the comparison of a table with its round trip."""

import re

from facsimile import flatten, infer_plan, unflatten
from workloads.outcomes import carried_rows

ITEMS = "key long, items array<struct<part:long,price:double>>"


def test_lists_are_compared_after_the_join(spark):
    rows = [(1, None), (2, []), (3, [(1, 0.5), None]), (4, [(1, None)]), (5, [(7, float("nan"))])]
    one = spark.createDataFrame(rows, ITEMS)
    plan = infer_plan(one, keep_nested=["items"], deep=True)
    whole = unflatten(flatten(one, plan, lengths=True), plan, arrays="length")
    assert carried_rows(one, whole, "key", "items").first()["rows"] == 5
    other = spark.createDataFrame([(1, []), (2, None), (3, [(1, 0.5)]), (4, [None]), (5, rows[4][1]), (6, None)], ITEMS)
    assert carried_rows(one, other, "key", "items").first()["rows"] == 1


def test_the_join_has_no_list_among_its_keys(spark):
    one = spark.createDataFrame([(1, [(1, 0.5)])], ITEMS)
    text = carried_rows(one, one, "key", "items")._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"(?:Join|HashJoin) \[(.*?)\], \[(.*?)\], Inner", text)
    assert keys and all(re.fullmatch(r"key#\d+L", k) for pair in keys for k in pair)
