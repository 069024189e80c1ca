"""Removed bytes against a table of all windows."""

import random
from collections import Counter

import pytest

from facsimile.llm import suffix
from facsimile.llm.suffix import remove_repeats

SCHEMA = "doc_id long, text string, row string, row_text string"


def brute(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans, i = [], 0
        while i < len(t):
            if gone[i]:
                j = i
                while j < len(t) and gone[j]:
                    j += 1
                spans.append((i, j - i))
                i = j
            else:
                i += 1
        out.append((bytes(b for b, g in zip(t, gone) if not g), tuple(spans)))
    return out


def made_texts(rng):
    def words(n):
        return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(n))

    passages = [words(60), words(45), "x" * 450, "ab " * 150]
    texts = [words(rng.randint(0, 300)) for _ in range(30)]
    for i in range(30):
        p = rng.choice(passages)
        cut = rng.randint(0, 40)
        texts.append(words(rng.randint(0, 50)) + p[cut : len(p) - rng.randint(0, 40)] + words(rng.randint(0, 50)))
    base = words(200)
    for _ in range(12):  # near copies: one letter changed here and there
        changed = list(base)
        for _ in range(rng.randint(1, 4)):
            changed[rng.randrange(len(base))] = "#"
        texts.append("".join(changed))
    return texts + [texts[3]] * 2 + ["", "short", "y" * 199, "z" * 200, "w" * 201]


@pytest.mark.parametrize("batches", [1, 4])
def test_same_as_all_windows(spark, batches):
    rng = random.Random(batches)
    texts = made_texts(rng)
    rows = [(i, t, "r", "t") for i, t in enumerate(texts)] + [(900, None, "r", "t"), (None, texts[5], "r", "t"), (7, texts[7], "r", "t")]
    want = Counter()
    for (i, *_), (kept, spans) in zip(rows, brute([(r[1] or "").encode() for r in rows], 200)):
        want[(i, kept, spans)] += 1
    got = Counter()
    for r in remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), batches=batches).collect():
        assert r.row.row == "r" and r.row.row_text == "t"
        got[(r.row.doc_id, bytes(r.kept), tuple((s.start, s.length) for s in r.spans))] += 1
    assert got == want


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefgh", k=9000))
    texts = [long, long[1000:5000] + "Q" + long[5001:7000], "new " + long[8000:8300]]
    monkeypatch.setattr(suffix, "BUFFER", 4096)
    data = b"".join(t.encode() for t in texts)
    import numpy as np

    ends = np.cumsum([len(t) for t in texts])
    offsets = np.concatenate([[0], ends])
    rows, begin, end = suffix._segments(offsets, 200)
    windows = set()
    for part in suffix._buffers(begin, end):
        piece, first, at, length, key, run = suffix.find_runs(np.frombuffer(data, np.uint8), begin[part], end[part], 200)
        for f, n in zip(first, length):
            for s in range(f, f + n):
                assert s not in windows
                windows.add(s)
    assert windows == {s for a, b in zip(offsets, ends) for s in range(a, b - 199)}


def test_no_rows(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_equal_rows(spark):
    """A thousand equal rows without id, as many with one, and a text that holds a part of them."""
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefgh ", k=3000))
    part = "own beginning " + text[100:800] + " own end"
    rows = [(None, text, "r", "t")] * 1000 + [(5, text, "r", "t")] * 1000 + [(6, part, "r", "t"), (7, "s" * 150, "r", "t"), (7, "s" * 150, "r", "t")]
    got = Counter((r.row.doc_id, bytes(r.kept), tuple((s.start, s.length) for s in r.spans or ())) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    start = len("own beginning ")
    assert got == {(None, b"", ((0, 3000),)): 1000, (5, b"", ((0, 3000),)): 1000, (6, b"own beginning  own end", ((start, 700),)): 1, (7, b"s" * 150, ()): 2}


def test_many_texts_without_id_share_a_passage(spark):
    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=600))
    texts = [f"{rng.random()} begins {passage[i % 5 :]} ends {rng.random()}" for i in range(200)]
    want = Counter(kept for kept, _ in brute([t.encode() for t in texts], 200))
    rows = spark.createDataFrame([(None, t, "r", "t") for t in texts], SCHEMA)
    assert Counter(bytes(r.kept) for r in remove_repeats(rows).collect()) == want
