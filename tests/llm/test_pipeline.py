"""Stages after the toxicity scores against brute force on a small table."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from facsimile.llm import byte_bpe
from facsimile.llm.contamination import shingles
from facsimile.llm.queries import op8_toxicity
from tests.llm.test_simhash import brute_print
from tests.llm.test_suffix import brute


def test_pipeline(spark, sf_dir):
    con = duckdb.connect()
    docs = dict(con.execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall())
    items = [t for (t,) in con.execute(f"SELECT text FROM '{sf_dir}/benchmark.parquet'").fetchall()]
    toxic = {r.doc_id for r in op8_toxicity(spark, sf_dir).filter("predicted = 1").collect()}
    left = {i: t for i, t in docs.items() if i not in toxic}
    prints = {i: brute_print(t) for i, t in left.items()}
    group = {i: i for i in left}
    changed = True
    while changed:
        changed = False
        for a in left:
            for b in left:
                if group[a] > group[b] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    group[a], changed = group[b], True
    left = {i: t for i, t in left.items() if group[i] == i}
    cut = {}
    for i, (_, spans) in zip(left, brute([t.encode() for t in left.values()], 200)):
        at = [n for n, c in enumerate(left[i]) for _ in c.encode()]
        gone = {at[p] for a, n in spans for p in range(a, a + n)}
        cut[i] = "".join(c for n, c in enumerate(left[i]) if n not in gone)
    tests = [set(shingles(t.encode(), 5)) for t in items]
    clean = {i: t for i, t in cut.items() if not any(s and 10 * len(s & set(shingles(t.encode(), 5))) >= 8 * len(s) for s in tests)}
    table = byte_bpe.token_table(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(table) if t}, special_tokens={})
    want = {}
    for i, t in clean.items():
        ids = np.array(plain.encode_ordinary(t), "<u4")
        want[i] = (len(t), len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), True)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_chars, r.n_tokens, r.ids_sha256, r.intact) for r in got} == want and len(got) == len(want)
    assert 0 < len(clean) < len(cut) < len(docs)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, row_id long"


def test_odd_rows(spark, sf_dir):
    """Null ids and texts, equal rows, empty and very long texts, clashing columns."""
    words = [f"word{i % 977}x{i % 31}" for i in range(30_000)]
    rows = [
        (None, None, None, None, None, "r", 5), (None, None, None, None, None, "r", 5), (1, None, "en", "s", 0, "r", 5), (2, "", "en", "s", 0, "r", 5),
        (3, " ".join(words), "en", None, 9, "r", 5), (4, "short text é", "fr", "s", 12, "r", 5), (4, "short text é", "fr", "s", 12, "r", 5),
        (4, "another text of the same id", "fr", "s", 12, "r", 5),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(3, 0), (4, 1), (4, 1), (None, 1)], "doc_id long, toxic int")
    from facsimile.llm.toxicity import fit_toxicity

    scores = fit_toxicity(docs, labels, F.lit(False)).score(docs)
    assert scores.filter("score BETWEEN 0 AND 1").count() == len(rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, (r.text or "")[:7]) for r in kept.collect()) == Counter([(1, ""), (3, "word0x0"), (4, "short t"), (4, "another")])
    cut = corpus_pipeline.cut_repeats(spark, docs, sf_dir)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert corpus_pipeline.decontaminate(spark, docs, sf_dir).count() == len(rows)
    tokens = corpus_pipeline.tokenize(spark, docs, sf_dir)
    assert tokens.filter("intact").count() == len(rows)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert fit_toxicity(docs.limit(0), labels, F.lit(False)).score(docs.limit(0)).count() == 0
