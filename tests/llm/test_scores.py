"""Held-out accuracy, folds, and odd tables for the two classifiers."""

import os
import random
import tracemalloc
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facsimile.llm import toxicity
from facsimile.llm.labelled import fold, labelled_sample
from facsimile.llm.quality_vote import fit_vote
from facsimile.llm.queries import op4_quality_vote, op8_toxicity
from facsimile.llm.toxicity import FEATURES, Flags, fit_toxicity, text_features

SCHEMA = "doc_id long, text string, score string, row string, features string"


@pytest.fixture(scope="module")
def larger():
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


@pytest.mark.parametrize(
    "query, label, folds, rest, least", [(op4_quality_vote, "quality", 4, 2, 0.95), (op8_toxicity, "toxic", 5, 0, 0.93)]
)
def test_held_out_accuracy(spark, larger, query, label, folds, rest, least):
    scored = query(spark, larger).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    assert len(scored) == spark.read.parquet(f"{larger}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == rest) for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= least * len(held) > 0


def odd(spark):
    rows = [(None, None, "s", "r", "f"), (1, "", "s", "r", "f"), (2, "word " * 60_000, "s", "r", "f"), (3, "x", "s", "r", "f"), (3, "x", "s", "r", "f")]
    rows += [(i, f"you are an id{'i' * (i % 3)}ot and ST*PID {i}" if i % 2 else f"calm words of day {i}", "s", "r", "f") for i in range(10, 60)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("fit, label", [(fit_vote, "quality"), (fit_toxicity, "toxic")])
def test_odd_tables(spark, fit, label):
    docs = odd(spark)
    made = [(i, i % 2) for i in range(10, 60)] + [(10, 0), (None, 1), (999, 1), (3, None)]
    some = spark.createDataFrame(made, f"doc_id long, {label} int")
    for labels in (some, some.filter(f"{label} = 1"), some.limit(0)):
        found = fit(docs, labels, fold("doc_id", 7) == 3, label_col=label).score(docs).collect()
        assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
        assert {(r.row.score, r.row.row, r.row.features) for r in found} == {("s", "r", "f")}
        assert len({r.score for r in found if r.row.doc_id == 3}) == 1
    model = fit(docs, some, F.lit(False), label_col=label)
    by_id = {r.row.doc_id: r.score for r in model.score(docs).collect()}
    assert sum((by_id[i] >= 0.5) == bool(i % 2) for i in range(10, 60)) >= 45
    assert fit(docs.limit(0), some, F.lit(False), label_col=label).score(docs.limit(0)).count() == 0


def test_sample_is_bounded_and_excludes(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, y int")
    held_out = fold("doc_id", 5) == 0
    taken = [labelled_sample(d, labels, "y", held_out, 40).collect() for d in (docs, docs.repartition(2))]
    assert len(taken[0]) == 40 and sorted(taken[0]) == sorted(taken[1])
    assert all(zlib.crc32(str(r.sample_id).encode()) % 5 and r.label == r.sample_id % 2 for r in taken[0])


def test_features():
    flags = Flags(frozenset(["idiot"]), frozenset(["vequ-"]))
    names = dict(zip(FEATURES, text_features("YOU are an idiot, vequta! 1d1ot", flags)))
    assert names["given_density"] > 0 and names["learned_density"] > 0 and names["hidden_hits"] > 0
    assert names["near_second_person"] > 0 and names["shouted"] > 0
    assert all(v == 0 for v in text_features("", flags))


def test_remembered_words_are_bounded():
    """Words of any length: a task keeps no more letters than it may, and the flags stay right."""
    flags = Flags(frozenset(["idiot"]), frozenset(["vequ-"]))
    for i in range(3000):
        word = ("vequ" if i % 3 == 0 else "calm") + f"{i:012b}".replace("0", "a").replace("1", "b") * 400
        assert (flags[word], flags["idiot"], flags["day"]) == (int(i % 3 == 0), 2, 0)
        assert sum(map(len, flags)) <= 2_000_000
    flags = Flags(frozenset(), frozenset())
    assert not any(flags[f"w{i}"] for i in range(150_000)) and len(flags) <= 100_000


def test_counted_keys_are_bounded(spark, monkeypatch):
    """Words of any length: a task hands its counts on in parts, and no count is lost."""
    emits, mapped = [], toxicity.map_batches
    monkeypatch.setattr(toxicity, "map_batches", lambda rows, emit, schema: emits.append(emit) or mapped(rows, emit, schema))
    sample = spark.createDataFrame([("idiot day", 1), ("calm day", 0)] * 4, "text string, label int")
    assert toxicity.learn_lexicon(sample, 5, 3, 0.9) == {"idiot", "idio-", "idiot-"}
    texts = [letter * 300_000 for letter in "abcdefghijklmnopqrstuvwxyz"] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([1, 0] * 26)], names=["text", "label"])
    parts = [part.to_pydict() for part in emits[0](iter([batch]))]
    assert max(sum(map(len, part["key"])) for part in parts) < 4_400_000
    assert sum(sum(part["docs"]) for part in parts) == 4 * len(texts) and sum(sum(part["toxic"]) for part in parts) == 2 * len(texts)


def test_long_texts_are_taken_in_pieces(monkeypatch):
    """A long text has the features that it has as a whole, in memory of little more than its length."""
    draw, flags = random.Random(5), Flags(frozenset(toxicity.LEXICON), frozenset(["vequ-"]))
    words = ["day", "You,", "your", "IDIOT!", "vequta", "st*pid", "1d1ot", "calm", "ΟΔΟΣ", "ΣΑΣ", "\x1f", "\n", "\u2003", "GROẞ", "a.b-c", "\u0130x"]
    texts = ["", " ", "x" * 300, " " * 300] + [" ".join(draw.choices(words, k=k)) for k in (1, 9, 60, 400)]
    whole = [text_features(t, flags) for t in texts]
    for size in (1, 7, 50):
        monkeypatch.setattr(toxicity, "PIECE", size)
        assert all("".join(toxicity.pieces(t)) == t for t in texts)
        assert [text_features(t, flags) for t in texts] == whole
    monkeypatch.undo()
    text = "calm words of a day, idiot " * 300_000
    tracemalloc.start()
    try:
        text_features(text, flags)
        assert tracemalloc.get_traced_memory()[1] < 4 * len(text)
    finally:
        tracemalloc.stop()
