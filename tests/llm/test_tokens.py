"""Encoders against the plain libraries; files against their input."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from facsimile.llm import byte_bpe, dac
from facsimile.llm.common import BATCH_BYTES, map_batches

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, row string"
LETTERS = ["abcdeinorst", "abc'sdtrelmvABC ", "  \n\t\r\x0b\xa0\x85 \x1c", "0123456789²½", "éüñçßǼé̈İΣς", "漢字かな", "😀👍🏽🇩🇪", "​﻿　", "!?.,*$%&|<>_"]


def thue_morse(a, b, steps=10):
    """Two words of which every polynomial hash modulo 2^64 is the same."""
    one, two = a, b
    for _ in range(steps):
        one, two = one + two, two + one
    return [one, two]


def odd_texts(seed, n):
    rng = random.Random(seed)
    out = thue_morse("a", "b") + thue_morse("x", "é", 11) + [f"see {w} there" for w in thue_morse("a", "b")]
    out += ["\x00", "a\x00", "seven77 seven78", "eight888 eight889"]
    out += ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "Don't   we'll 's", "<|endoftext|> x<|startoftext|>", "word*** *** 10 0 00", "x" * 3000]
    for _ in range(n):
        out.append("".join(rng.choice(rng.choice(LETTERS)) for _ in range(rng.randint(0, 80))))
        out.append(" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 14))) + rng.choice(["", ",", "$$$", "'s"]) for _ in range(20)))
    return out


@pytest.fixture(scope="module")
def plain():
    table = byte_bpe.token_table(byte_bpe.read_ranks(RANKS))
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(table) if t}, special_tokens={})


def test_byte_bpe(spark, plain):
    texts = odd_texts(1, 400)
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, None, "x", "y"), (3, texts[3], "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    encoded = byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN, offsets=True)
    at_once = byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN, decoded=True).select("ids", "decoded").collect()
    assert sorted(at_once) == sorted(byte_bpe.decode_tokens(encoded, RANKS).select("ids", "decoded").collect())
    table = byte_bpe.token_table(byte_bpe.read_ranks(RANKS))
    places = {r.row.doc_id: (r.first_char, r.last_char) for r in encoded.collect()}
    got = byte_bpe.decode_tokens(encoded, RANKS).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.row.doc_id] if r.row.doc_id is not None else ""
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == plain.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
        assert "".join(byte_bpe.decode_pieces(bytes(r.ids), table)) == text
        begin, end = places[r.row.doc_id]
        for t, a, b in zip(ids, begin, end):
            assert table[t] in text[a : b + 1].encode()
        assert (r.row.ids, r.row.row) == ("x", "y")


def batch_bytes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([len(batch)])], names=["size", "n"])


def test_batches_end_by_bytes(spark):
    """A task of 30 MB of text gets it in small batches; a size that the session names holds."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text")).coalesce(1)
    spark.conf.unset(BATCH_BYTES)
    try:
        byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
        got = docs.mapInArrow(batch_bytes, "size long, n long").collect()
        assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < 3 << 20
        spark.conf.set(BATCH_BYTES, "64m")
        assert max(r.size for r in map_batches(docs, batch_bytes, "size long, n long").collect()) > 20 << 20
    finally:
        spark.conf.unset(BATCH_BYTES)


def test_kept_pieces_are_bounded(plain):
    """More distinct pieces than are kept: the ids stay right, and no more than a slice's pieces come on top."""
    texts = ["".join(f" {i * 100_000 + j:07d}x" for j in range(100_000)) for i in range(6)]
    encoder = byte_bpe.PieceEncoder(byte_bpe.tokenizer(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN), byte_bpe.token_table(byte_bpe.read_ranks(RANKS)))
    most = 0
    for text in texts + texts[:1]:
        (ids,) = encoder.packed(pa.array([text]))
        assert np.frombuffer(ids[0].as_py(), "<u4").tolist() == plain.encode_ordinary(text)
        most = max(most, len(encoder.known.key))
    assert 300_000 <= most <= 450_000


def test_byte_bpe_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.decode_tokens(byte_bpe.encode_texts(empty, RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 511, 513, 5000])
def test_random_access(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.3, rng.integers(0, 256, n), rng.integers(0, 1 << rng.integers(1, 33), n)).astype(np.uint32)
    segment = dac.Segment(dac.encode_segment(ids))
    assert len(segment) == n
    places = rng.integers(0, n, 400) if n else np.zeros(0, int)
    assert (segment.take(places) == ids[places]).all()
    assert (segment.take(np.arange(n)) == ids).all()


def test_files(spark, tmp_path):
    texts = odd_texts(2, 300)
    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    rows = [(1000 - 3 * i, t, "x", "y") for i, t in enumerate(texts)] + [(None, None, "x", "y"), (1000, texts[0], "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    segments = dac.write_tokens(docs, WORDS, end_id=2, path=str(tmp_path / "tokens"), segment_tokens=500)
    assert segments.count() >= 1
    got = dac.read_tokens(dac.open_tokens(spark, str(tmp_path / "tokens"))).withColumn("crc", F.crc32("ids")).collect()
    at = 0
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.row_id for r in ordered] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    by_id = {r[0]: r[1] or "" for r in rows}
    for r in ordered:
        want = np.array([*whole.encode(by_id[r.row_id], add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert bytes(r.ids) == want and r.start == at and r.crc == zlib.crc32(want)
        at += len(want) // 4


def test_files_no_rows(spark):
    assert dac.read_tokens(dac.write_tokens(spark.createDataFrame([], SCHEMA), WORDS, end_id=2)).count() == 0




def test_files_special_tokens(spark, tmp_path):
    """The registered query against the library's plain call, with strings of special tokens in the texts."""
    from facsimile.llm.queries import op9_addressable_codes

    rng = random.Random(6)
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "text|>", "<|", "|>", " ", "Ab", "é", "\n"]
    texts = ["see <|endoftext|> here", "<|endoftext|>", "<|endof", "text|> x", "", "<|endoftext|><|startoftext|>", "a<|endoftext|>B's", *odd_texts(5, 100)]
    texts += ["".join(rng.choices(marks, k=rng.randint(1, 9))) for _ in range(300)]
    whole = Tokenizer.from_file(WORDS)
    assert whole.encode(texts[0], add_special_tokens=False).ids == [862, 49407, 763]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got, at = {r.doc_id: r for r in op9_addressable_codes(spark, str(tmp_path)).collect()}, 0
    for i, text in enumerate(texts):
        want = np.array([*whole.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want), zlib.crc32(want.tobytes())), text
        at += len(want)
    assert len(got) == len(texts)


def test_null_ids_are_dealt_over_parts(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        segments = dac.write_tokens(docs, WORDS, end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert segments.select("part").distinct().count() > 1
    starts = [r.start for r in dac.read_tokens(segments).sort("start").select("start").collect()]
    assert len(starts) == 2000 and starts[0] == 0 and len(set(starts)) == 2000
