"""Contained items against sets of shingles."""

import random

import pytest

from facsimile.llm import contamination
from facsimile.llm.contamination import contained_items, shingles, without_items

SCHEMA = "doc_id long, text string, item_id string, n_item string"


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcÉé", k=rng.randint(1, 4)))
    items = [" ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 12, 40]))) for _ in range(25)] + ["", None, "  ", "same same same same same same"]
    docs = []
    for _ in range(60):
        parts = [word() for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.7:
            own = (rng.choice(items) or "").split()
            for _ in range(rng.randint(0, 2)):
                if own:
                    own[rng.randrange(len(own))] = word()
            cut = rng.randint(0, len(parts))
            parts[cut:cut] = own
        docs.append("\t ".join(parts).upper() if rng.random() < 0.2 else " ".join(parts))
    long = " ".join(word() for _ in range(20_000)) + " " + (items[3] or "")
    return items + [items[4]], [*docs, *[t for t in items if t][:6], "", None, long]


@pytest.mark.parametrize("block", [5_000, 7])
def test_same_as_sets(spark, monkeypatch, block):
    monkeypatch.setattr(contamination, "BLOCK_ITEMS", block)
    items, docs = made(block)
    rows = [(i, t, "x", "y") for i, t in enumerate(docs)] + [(None, docs[60], "x", "y"), (3, docs[3], "x", "y")]
    asked = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = []
    for i, t, *_ in rows:
        for n, item in enumerate(items):
            own = set(shingles((t or "").encode(), min(5, len((item or "").split())) or 1))
            s = set(shingles((item or "").encode(), 5))
            if s and 10 * len(s & own) >= 8 * len(s):
                want.append((str(i), n, len(s & own), len(s)))
    got = [(str(r.row_id), r.item_id, r.n_shared, r.n_item) for r in contained_items(frame, asked).collect()]
    assert sorted(got) == sorted(want) and len(want) >= 10
    left = without_items(frame, asked)
    assert left.columns == frame.columns
    assert left.count() == sum(str(r[0]) not in {w[0] for w in want} for r in rows)


def test_short_items_inside_texts(spark):
    items = spark.createDataFrame([(1, "Capital of France"), (2, "paris"), (3, "of  france is Paris"), (4, "of france paris")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the capital of France is Paris today", "", ""), (2, "capital\tof france", "", ""), (3, "of France", "", ""), (4, "Paris", "", "")], SCHEMA)
    found = sorted((r.row_id, r.item_id, r.n_shared, r.n_item) for r in contained_items(docs, items).collect())
    assert found == [(1, 1, 1, 1), (1, 2, 1, 1), (1, 3, 1, 1), (2, 1, 1, 1), (4, 2, 1, 1)]
    assert [r.doc_id for r in without_items(docs, items).collect()] == [3]


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", "y")], SCHEMA)
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contained_items(docs, items).count() == 1
    assert contained_items(docs.limit(0), items).count() == contained_items(docs, items.limit(0)).count() == 0
