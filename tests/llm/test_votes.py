"""Scores of the two classifiers, step by step against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facsimile.llm.common import packed
from facsimile.llm.quality_vote import _blocks, fit_vote
from facsimile.llm.toxicity import FEATURES, Flags, fit_toxicity, text_features, with_features


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")]


def test_votes_are_the_nearest_by_cosine(tables):
    """Every text against every labelled vector, in double precision and one by one."""
    docs, labels = tables
    model = fit_vote(docs, labels, F.lit(False), max_labelled=60, rank=12, neighbours=7)
    scores = {r.row.doc_id: r.score for r in model.score(docs).collect()}
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("row_text")).toArrow().combine_chunks().to_batches()[0]
    counts = np.concatenate([c for _, _, c in _blocks(rows, "row_text")])
    assert len(model.vectors) == 60 and model.vectors.shape[1] == 12
    checked = 0
    for doc_id, count in zip(rows.column("doc_id").to_pylist(), counts):
        value = np.array([(1 + math.log(c)) * w if c else 0.0 for c, w in zip(count.tolist(), model.idf.tolist())])
        vector = value / (np.linalg.norm(value) or 1) @ model.space.astype(float)
        vector = vector / (np.linalg.norm(vector) or 1)
        near = sorted(((float(np.dot(vector, v)), y) for v, y in zip(model.vectors.astype(float), model.labels)), reverse=True)
        if near[6][0] - near[7][0] < 1e-5:
            continue  # either neighbour may vote
        weights = [(max(c, 0.0) ** model.sharpness, y) for c, y in near[:7]]
        total = sum(w for w, _ in weights)
        want = sum(w * y for w, y in weights) / total if total else float(model.labels.mean())
        assert scores[doc_id] == pytest.approx(want, abs=2e-4)
        checked += 1
    assert checked > 0.8 * len(scores)


def pooled(points):
    """Isotonic regression of (x, y) by pooling adjacent violators: (first x, last x, value) of each pool."""
    by_x = {}
    for x, y in points:
        by_x.setdefault(x, []).append(y)
    pools = []
    for x in sorted(by_x):
        pools.append([x, x, sum(by_x[x]), len(by_x[x])])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            last = pools.pop()
            pools[-1][1:] = [last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    return [(a, b, s / n) for a, b, s, n in pools]


def test_toxicity_is_trees_then_isotonic(spark, tables):
    docs, labels = tables
    model = fit_toxicity(docs, labels, F.lit(False), trees=6, depth=3)
    rows = packed(docs, "doc_id", "text")
    featured = with_features(rows, model.given, model.learned, ["row_id", "row_text"])
    flags = Flags(model.given, model.learned)
    margins = {}
    for r in featured.collect():
        values = [r[f] for f in FEATURES]
        assert values == pytest.approx(list(text_features(r.row_text, flags)))
        from pyspark.ml.linalg import Vectors

        raw = sum(w * t.predict(Vectors.dense(values)) for w, t in zip(model.trees.treeWeights, model.trees.trees)) if len(margins) < 120 else None
        margins[r.row_id] = None if raw is None else 1 / (1 + math.exp(-2 * raw))
    bounds, levels = list(model.calibration.boundaries), list(model.calibration.predictions)
    assert levels == sorted(levels) and bounds == sorted(bounds)
    scores = {r.row.doc_id: r.score for r in model.score(docs).collect()}
    for doc_id, margin in margins.items():
        if margin is not None:
            want = float(np.interp(margin, bounds, levels))
            assert scores[doc_id] == pytest.approx(min(1.0, max(0.0, want)), abs=1e-9)


def test_isotonic_pools(spark):
    """The calibration that the scores go through, against pooling by hand."""
    from pyspark.ml.regression import IsotonicRegression

    rng = np.random.default_rng(4)
    points = [(float(x), float(rng.random() < x)) for x in np.round(rng.random(200), 2)]
    fitted = IsotonicRegression(featuresCol="margin", labelCol="label").fit(spark.createDataFrame(points, "margin double, label double"))
    pools = pooled(points)
    want = {x: v for a, b, v in pools for x in (a, b)}
    got = dict(zip(map(float, fitted.boundaries), map(float, fitted.predictions)))
    assert got == pytest.approx({x: want[x] for x in got}) and len(set(got.values())) == len({v for *_, v in pools})
