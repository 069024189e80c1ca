"""Different texts of null ids stay apart, also where their 32-bit hashes are equal."""

import pytest
from pyspark.sql import functions as F

from facsimile.llm.contamination import without_items
from facsimile.llm.line_rules import judge_lines
from facsimile.llm.simhash import near_duplicates
from facsimile.llm.suffix import remove_repeats

PASSAGE = " ".join(f"passage{i}" for i in range(60))
LONG, SHORT = f"{PASSAGE} 18322", "clean words 340330"  # one F.hash


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, LONG, "h"), (None, SHORT, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert docs.select(F.hash("text")).distinct().count() == 1
    return docs


def test_near_duplicates(docs):
    found = near_duplicates(docs).collect()
    assert len(found) == 2 and len({r.print for r in found}) == 2


def test_remove_repeats(spark, docs):
    again = spark.createDataFrame([(1, f"{PASSAGE} 7", "h")], docs.schema)
    kept = sorted(bytes(r.kept) for r in remove_repeats(docs.union(again)).collect())
    assert kept[-1] == SHORT.encode() and all(len(k) < 8 for k in kept[:-1])


def test_without_items(spark, docs):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert [r.text for r in without_items(docs, items).collect()] == [SHORT]


def test_judge_lines(spark):
    """Eleven documents hold the footer, two of them of one F.hash."""
    numbers = [132027, 290692, *range(9)]
    rows = [(None if n > 9 else n, f"own line {n}x\nthe same footer", "h") for n in numbers]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert docs.filter("doc_id IS NULL").select(F.hash("text")).distinct().count() == 1
    assert {r.clean_text for r in judge_lines(docs).collect()} == {f"own line {n}x" for n in numbers}
