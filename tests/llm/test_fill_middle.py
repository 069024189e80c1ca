"""Cuts and outputs against a plain split into units."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from facsimile.llm.fill_middle import Marks, as_words, character_ends, cut_places, fill_middle, line_ends, restored_text

SCHEMA = "doc_id long, text string, output string, row string"


def units(text, unit):
    return re.findall("[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)


def brute(doc_id, text, unit="line", spm=50, rate=100):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    u = units(text, unit)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    prefix, middle, suffix = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    if h4 % 100 < spm:
        return len(u), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(u), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(rng):
    fixed = [None, "", "\n", "\n\n\n", "x", "x\n", "\nx", "no end\nof line", "é\n漢字\n😀😀\n", "has <P> in it\nx", "<S>", "a<\nS>\n<\n<M", "<M>\nq", "\r\n\r\n", "\x8a\x0b\n\x89"]
    made = ["".join(rng.choices("ab \n\né漢\U0001f600Ċਊ<SPM>", k=rng.randint(1, 90))) for _ in range(200)]
    return fixed + made + ["line of text\n" * 200_000, "one long line " * 100_000, fixed[7], fixed[7]]


@pytest.mark.parametrize("unit", ["line", "character"])
def test_against_split(spark, unit):
    rows = [(i if i % 17 else None, t, "o", "r") for i, t in enumerate(texts(random.Random(1)))] + [(5, "x\n", "o", "r")] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = fill_middle(docs, unit=unit).withColumn("restored", restored_text(F.col("output"), F.col("form"))).collect()
    got = sorted((str(r.row.doc_id), r.row_text, r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in made)
    want = []
    for i, t, *_ in rows:
        n, form, a, b, out = brute(i, t, unit)
        want.append((str(i), t or "", n, form, str(a), str(b), out))
    assert got == sorted(want)
    assert all(r.restored == r.row_text and r.row.output == "o" for r in made)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_rates(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('a\\n', 'b\\n', id) AS text")
    got = {r.row.doc_id: (r.form, r.output) for r in fill_middle(docs, rate=40, spm_rate=10).collect()}
    assert got == {i: brute(i, f"a\nb\n{i}", spm=10, rate=40)[1::3] for i in range(300)}


def test_select_in_every_byte():
    rng = np.random.default_rng(3)
    for density in (0.01, 0.3, 0.9, 1):
        data = np.where(rng.random(1003) < density, 0x0A, rng.integers(0, 256, 1003)).astype(np.uint8)
        marks, places = Marks(line_ends(as_words(data))), np.flatnonzero(data == 0x0A)
        assert np.array_equal(marks.select(np.arange(len(places))), places)
        assert np.array_equal(marks.rank(np.arange(1004)), np.searchsorted(places, np.arange(1004)))
    text = np.frombuffer("aé漢😀b".encode(), np.uint8)
    assert Marks(character_ends(as_words(text))).select(np.arange(4)).tolist() == [0, 2, 5, 9]


def test_rows_within_a_buffer():
    parts = [b"", b"a\nb", b"\n", b"", b"c", b"d\n\n"]
    offsets = np.cumsum([0, *map(len, parts)])
    n, *_ = cut_places(np.frombuffer(b"".join(parts), np.uint8), offsets, np.zeros(6, np.int64), np.ones(6, np.int64))
    assert n.tolist() == [0, 2, 1, 0, 1, 2]


def test_no_rows_and_bad_marks(spark):
    assert fill_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    for marks in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<<P>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle(spark.createDataFrame([], SCHEMA), marks=marks)
