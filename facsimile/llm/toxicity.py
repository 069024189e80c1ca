"""Toxicity: gradient-boosted trees over dense features of a text, calibrated isotonically.

The features are densities of a given lexicon and of one learned from labelled rows
(words, and word beginnings of four to six letters), lexicon words near a second-person
word, capitals, punctuation and obfuscated words. The trees are Spark's; a separate part
of the sample calibrates them.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import Stored, map_batches, packed
from facsimile.llm.labelled import labelled_sample

LEXICON = (
    "idiot moron stupid dumb loser pathetic worthless scum trash disgusting clown hate ugly fool jerk garbage filth vermin pig liar "
    "coward freak imbecile cretin"
).split()
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
NEAR = 5  # words between a lexicon word and a second-person word
STEMS = (4, 5, 6)
PIECE = 100_000  # characters of a text that are taken at once
KEPT_WORDS, KEPT_LETTERS = 100_000, 2_000_000  # that a task remembers with their flags
COUNTED_KEYS, COUNTED_LETTERS = 200_000, 4_000_000  # that a task counts before it hands them on
FEATURES = (
    "given_density", "learned_density", "hits", "distinct_hits", "near_second_person", "second_person", "capitals", "shouted",
    "exclamations", "punctuation", "obfuscated", "hidden_hits", "size",
)

SPACE = re.compile(r"\s")
WORD = re.compile(r"[^\W\d_]+")
SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
OBFUSCATED = re.compile(r"[^\W\d_][@$!0134*_.\-]+[^\W\d_]")
PLAIN = str.maketrans("@$!0134", "asioiea", "*_.-")
UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
MARKS = b"!?"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def keys_of(word: str) -> set[str]:
    """What a lexicon may hold of a word: itself, and its beginnings marked with a hyphen."""
    return {word} | {word[:n] + "-" for n in STEMS if len(word) >= n}


class Flags(dict):
    """word -> 0, 1 (learned) or 2 (given); remembers the words it has seen, up to a number and to a length in all."""

    def __init__(self, given: frozenset, learned: frozenset) -> None:
        self.given, self.learned, self.letters = given, learned, 0

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS or self.letters + len(word) > KEPT_LETTERS:
            self.clear()
            self.letters = 0
        self.letters += len(word)
        flag = 2 if word in self.given else int(not self.learned.isdisjoint(keys_of(word)))
        self[word] = flag
        return flag


def pieces(text: str) -> Iterator[str]:
    """The text cut after a white space, which no word, token or lower-casing reaches across; without one it stays whole."""
    start = 0
    while len(text) - start > PIECE and (space := SPACE.search(text, start + PIECE - 1)):
        yield text[start : space.end()]
        start = space.end()
    yield text[start:]


def text_features(text: str, flags: Flags) -> tuple[float, ...]:
    """The features of a text, summed over its pieces, so that no list grows to all its words."""
    n_words = given = shouted = n_strange = hidden = letters = capitals = size = marks = punctuation = 0
    hits, persons, hit_words = array("q"), array("q"), set()
    for piece in pieces(text):
        lowered = piece.lower()
        words = WORD.findall(lowered)
        raw = piece.encode()
        marked = [(i, f) for i, f in enumerate(map(flags.__getitem__, words)) if f]
        given += sum(f == 2 for _, f in marked)
        hits.extend([n_words + i for i, _ in marked])
        hit_words.update([words[i] for i, _ in marked])
        persons.extend([n_words + i for i, w in enumerate(words) if w in SECOND_PERSON])
        strange = [w for w in lowered.split() if OBFUSCATED.search(w)] if OBFUSCATED.search(lowered) else []
        n_strange += len(strange)
        hidden += sum(any(flags[x] for x in WORD.findall(w.translate(PLAIN))) for w in strange)
        shouted += len(SHOUTED.findall(piece))
        letters += len(raw) - len(raw.translate(None, LETTERS))
        capitals += len(raw) - len(raw.translate(None, UPPER))
        marks += len(raw) - len(raw.translate(None, MARKS))
        punctuation += len(raw) - len(raw.translate(None, PUNCTUATION))
        size += len(raw)
        n_words += len(words)
    near, p = 0, 0
    for i in hits:
        while p < len(persons) and persons[p] < i - NEAR:
            p += 1
        near += p < len(persons) and persons[p] <= i + NEAR
    n, size = max(1, n_words), max(1, size)
    return (
        given / n,
        (len(hits) - given) / n,
        math.log1p(len(hits)),
        math.log1p(len(hit_words)),
        near / n,
        len(persons) / n,
        capitals / max(1, letters),
        shouted / n,
        marks / size,
        punctuation / size,
        n_strange / n,
        hidden / n,
        math.log1p(n_words),
    )


def learn_lexicon(sample: DataFrame, entries: int, least_docs: int, least_share: float) -> frozenset:
    """Words and beginnings that stand in at least ``least_docs`` toxic texts and mostly in such; at most ``entries``."""

    def count(batches):
        seen: Counter = Counter()
        toxic: Counter = Counter()
        letters = 0

        def out():
            keys = list(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([seen[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())],
                names=["key", "docs", "toxic"],
            )

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                own = {k for piece in pieces(text) for w in set(WORD.findall(piece.lower())) for k in keys_of(w)}
                letters += sum(len(k) for k in own if k not in seen)
                seen.update(own)
                if label:
                    toxic.update(own)
                if len(seen) > COUNTED_KEYS or letters > COUNTED_LETTERS:
                    yield out()
                    seen.clear()
                    toxic.clear()
                    letters = 0
        yield out()

    counts = map_batches(sample.select("text", "label"), count, "key string, docs long, toxic long")
    totals = counts.groupBy("key").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    telling = totals.filter((F.col("toxic") >= least_docs) & (F.col("toxic") >= least_share * F.col("docs")))
    return frozenset(r.key for r in telling.orderBy(F.desc("toxic"), "key").limit(entries).collect())


def with_features(rows: DataFrame, given: frozenset, learned: frozenset, kept: list[str]) -> DataFrame:
    """The columns ``kept`` of ``rows`` and one double per feature of the column ``row_text``."""

    def emit(batches):
        flags = Flags(given, learned)
        for whole in batches:
            for i in range(0, len(whole), 512):
                batch = whole.slice(i, 512)
                values = [text_features(t.as_py(), flags) for t in batch.column("row_text")]
                columns = [pa.array(v, pa.float64()) for v in zip(*values)]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + columns, names=[*kept, *FEATURES])

    read = list(dict.fromkeys([*kept, "row_text"]))
    types = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"{f} double" for f in FEATURES]
    return map_batches(rows.select(*read), emit, ", ".join(types))


@dataclass
class ToxicityModel:
    """A fitted model; without both labels in the sample it scores every text with their mean."""

    given: frozenset
    learned: frozenset
    trees: object | None
    calibration: object | None
    mean: float

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Each row of ``docs`` as (row, row_text, score): its other columns, its text and the calibrated score.

        Null texts are empty and are scored like any text; equal rows have equal scores;
        null ids and an empty table are no special case. Other columns, whatever their
        names, come back in ``row``.
        """
        rows = packed(docs, id_col, text_col)
        if self.trees is None:
            return rows.select("row", "row_text", F.lit(self.mean).alias("score"))
        featured = with_features(rows, self.given, self.learned, ["row", "row_text"])
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
        return self.calibrated(featured).select("row", "row_text", score.alias("score"))

    def calibrated(self, featured: DataFrame) -> DataFrame:
        return self.calibration.transform(_margins(self.trees, featured).drop("prediction"))


def _assembled(featured: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured).drop(*FEATURES)


def _margins(trees, featured: DataFrame) -> DataFrame:
    scored = trees.transform(_assembled(featured))
    return scored.withColumn("margin", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labelled: int = 12_000,
    lexicon: list[str] | tuple[str, ...] = tuple(LEXICON),
    lexicon_entries: int = 500,
    trees: int = 20,
    depth: int = 4,
) -> ToxicityModel:
    """Learn from at most ``max_labelled`` labelled rows, held-out ones excluded.

    Every fourth row of the sample calibrates, the others grow the trees; the lexicon is
    learned from all of them. Ties in the sample and the lexicon are broken by id and word.
    """
    given = frozenset(lexicon)
    # A bounded sample, dealt over many tasks.
    stored = Stored(labelled_sample(docs, labels, label_col, held_out, max_labelled, id_col, text_col).repartition(32), "toxic-sample")
    sample = stored.df.withColumnRenamed("text", "row_text")
    counts = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    positive = sum(n for label, n in counts.items() if label)
    mean = positive / total if total else 0.0
    if not 0 < positive < total:
        return ToxicityModel(given, frozenset(), None, None, mean)
    learned = learn_lexicon(stored.df, lexicon_entries, max(3, positive // 100), max(0.5, min(0.9, 4 * mean)))
    featured = Stored(
        with_features(sample, given, learned, ["sample_id", "label"]).withColumn("label", F.col("label").cast("double")), "toxic-features"
    ).df
    calibrates = F.pmod(F.xxhash64("sample_id", F.lit(1)), F.lit(4)) == 0
    grown = featured.filter(~calibrates)
    if grown.select("label").distinct().count() < 2:
        return ToxicityModel(given, learned, None, None, mean)
    forest = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, maxBins=64)
    fitted = forest.fit(_assembled(grown).select("features", "label"))
    held = _margins(fitted, featured.filter(calibrates)).drop("prediction")
    if held.isEmpty():
        held = _margins(fitted, grown).drop("prediction")
    calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="prediction").fit(held.select("margin", "label"))
    return ToxicityModel(given, learned, fitted, calibration, mean)
