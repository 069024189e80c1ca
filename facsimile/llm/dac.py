"""Token ids in files of directly addressable codes.

An id is split into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id
that has one; a continuation bitmap beside it tells which of its entries go on, and a
rank directory counts the set bits before every 64th. The chunk of entry i of a level is
found at entry rank(i) of the next one, so any token is read by at most four lookups and
no block is decoded.

Layout of a segment (little-endian): magic ``DAC1``, number of levels (uint32), then per
level its entries (uint64), the chunks (a byte each, padded to eight), the bitmap (64-bit
words) and the directory (a uint32 per word).
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facsimile.llm.common import gc_paused, packed, store, text_bytes
from facsimile.llm.rolling import U
from facsimile.llm.words import WordTable, byte_slices, word_places

MAGIC = b"DAC1"
SEGMENT_TOKENS = 1 << 19
CACHED_WORDS = 1_000_000
READ_AT_ONCE = 32  # documents
WORD_END = "</w>"
# A plain letter or digit before a symbol ends the tokenizer's match; the apostrophe may begin a contraction.
BEFORE_SYMBOL = re.compile(r"(?<=[0-9a-zÀ-ÖØ-öø-ÿ])(?=[!-&(-/:-@\[-`{-~])")


def encode_segment(ids: np.ndarray) -> bytes:
    """The bytes of one segment."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest):
        more = rest > 0xFF
        words = np.packbits(np.pad(more, (0, -len(rest) % 64)), bitorder="little").view("<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        before = np.cumsum(counts) - counts
        chunks = (rest & 0xFF).astype(np.uint8)
        levels.append((np.array([len(rest)], "<u8"), np.pad(chunks, (0, -len(chunks) % 8)), words, before.astype("<u4")))
        rest = rest[more] >> 8
    return MAGIC + np.array([len(levels)], "<u4").tobytes() + b"".join(part.tobytes() for level in levels for part in level)


class Segment:
    """Random access to the ids of an encoded segment; nothing is decoded beforehand."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.levels, at = [], 8
        for _ in range(int(np.frombuffer(data, "<u4", 1, 4)[0])):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            words = -(-n // 64)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n + -n % 8
            bitmap = np.frombuffer(data, "<u8", words, at)
            at += 8 * words
            ranks = np.frombuffer(data, "<u4", words, at)
            at += ranks.nbytes
            self.levels.append((chunks, bitmap, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, in any order."""
        places = np.asarray(places, np.int64)
        ids = np.zeros(len(places), np.uint32)
        who = np.arange(len(places))
        for depth, (chunks, bitmap, ranks) in enumerate(self.levels):
            ids[who] |= chunks[places].astype(np.uint32) << np.uint32(8 * depth)
            word, bit = places >> 6, (places & 63).astype(np.uint64)
            goes_on = (bitmap[word] >> bit & np.uint64(1)).astype(bool)
            who, word, bit = who[goes_on], word[goes_on], bit[goes_on]
            if not len(who):
                break
            places = ranks[word] + np.bitwise_count(bitmap[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
        return ids


@lru_cache(maxsize=2)
def _word_encoder(tokenizer_json: str, special_tokens: bool) -> "WordEncoder":
    return WordEncoder(tokenizer_json, special_tokens)


def _normal(text: str) -> str:
    """NFC, and each character in lower case for itself: no final sigma."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()


class WordEncoder:
    """Ids of texts for a tokenizer that drops white space and marks word ends: words are encoded once each.

    Words of letters alone are one match of the tokenizer's pattern, so many of them are
    normalised (NFC, each character in lower case) and encoded together, without the
    pattern, and cut again at the word ends. Known words are found by a 64-bit hash.
    Rows are cut at added tokens before anything else, as the library does; with
    ``special_tokens`` off, the strings of special ones are ordinary text.
    """

    def __init__(self, tokenizer_json: str, special_tokens: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        given = Tokenizer.from_str(tokenizer_json)
        self.whole = Tokenizer(given.model)  # without added tokens: a lower-cased word may look like one
        self.whole.normalizer, self.whole.pre_tokenizer = given.normalizer, given.pre_tokenizer
        added = [t for t in json.loads(tokenizer_json).get("added_tokens", []) if special_tokens or not t["special"]]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens must be plain strings of the text: not normalized, single words or stripped")
        self.added = {t["content"].encode(): t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.any_added = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.letters = Tokenizer(self.whole.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocab = given.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True
        self.known = WordTable()

    def _ids(self, built, text: str) -> np.ndarray:
        return np.array(built.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _keys(self, pieces: list[str]) -> np.ndarray:
        """Keys of words that are in lower case and hold no white space."""
        if not pieces:
            return np.zeros(0, U)
        data = np.frombuffer("\n".join(pieces).encode(), np.uint8)
        end = np.append(np.flatnonzero(data == 10), len(data))
        return self.known.keys(data, np.append(0, end[:-1] + 1), end)

    def _learn(self, pieces: list[str]) -> None:
        """Encode and enter pieces that are not known yet, each given once."""
        keys = self._keys(pieces)
        fresh = np.flatnonzero(self.known.find(keys) < 0).tolist()
        letters, others = [], []
        for i in fresh:
            (letters if pieces[i].isalpha() else others).append(i)
        order, found, sizes = [], [], []
        for k in range(0, len(letters), 1000):
            part = letters[k : k + 1000]
            text = _normal(" ".join([pieces[i] for i in part]))
            if not text.replace(" ", "").isalpha():  # a letter became a letter and a mark
                others += [i for i in part if not _normal(pieces[i]).isalpha()]
                part = [i for i in part if _normal(pieces[i]).isalpha()]
                text = _normal(" ".join([pieces[i] for i in part]))
            ids = self._ids(self.letters, text)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                order += part
                found.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:
                others += part
        for i in others:
            found.append(self._ids(self.whole, pieces[i]))
            sizes.append([len(found[-1])])
        if found:
            self.known.add(keys[order + others], np.concatenate(found), np.concatenate(sizes).astype(np.int64))

    def _added_places(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(row, begin, end, id) of the added tokens in rows of UTF-8 text."""
        raw = data.tobytes()
        if self.any_added is None or not self.any_added.search(raw):
            return np.zeros((0, 4), np.int64)
        bounds = offsets.tolist()
        found = [
            (row, m.start(), m.end(), self.added[m.group()])
            for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))
            for m in self.any_added.finditer(raw, a, b)
        ]
        return np.array(found, np.int64).reshape(-1, 4)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows of UTF-8 text, how many each row has)."""
        if self.known.full(CACHED_WORDS):
            self.known = WordTable()
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        added = self._added_places(data, offsets)
        lowered, row, begin, end = word_places(data, np.sort(np.concatenate([offsets, added[:, 1], added[:, 2]])))
        if len(added):
            last = np.searchsorted(added[:, 1], begin, side="right") - 1
            own = (last < 0) | (begin >= added[last, 2])
            begin, end = begin[own], end[own]
            row = np.searchsorted(offsets, begin, side="right") - 1
        keys, first, of = np.unique(self.known.keys(lowered, begin, end), return_index=True, return_inverse=True)
        missing = np.flatnonzero(self.known.find(keys) < 0)
        raw = lowered.tobytes()
        words = [raw[a:b].decode() for a, b in zip(begin[first[missing]].tolist(), end[first[missing]].tolist())]
        cut = [[w] if w.isalpha() else BEFORE_SYMBOL.split(w) for w in words]
        self._learn(list(dict.fromkeys(p for own in cut for p in own)))
        several = [i for i, own in enumerate(cut) if len(own) > 1]
        if several:
            parts = self.known.find(self._keys([p for i in several for p in cut[i]]))
            ids, n = self.known.gather(parts)
            bounds = np.cumsum([len(cut[i]) for i in several])
            total = np.diff(np.concatenate([[0], np.cumsum(n)])[bounds], prepend=0)
            self.known.add(keys[missing[several]], ids, total)
        ids, n = self.known.gather(self.known.find(keys)[of])
        sizes = np.bincount(row, weights=n, minlength=len(offsets) - 1).astype(np.int64)
        if len(added):
            before = np.append(0, np.cumsum(n))[np.searchsorted(begin, added[:, 1])]
            ids = np.insert(ids, before, added[:, 3])
            sizes += np.bincount(added[:, 0], minlength=len(offsets) - 1)
        return ids, sizes


SEGMENTS = (
    "part int, segment int, before long, tokens long, row_ids array<bigint>, row_copies array<bigint>, begins array<bigint>, codes binary"
)


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    segment_tokens: int = SEGMENT_TOKENS,
    special_tokens: bool = False,
) -> DataFrame:
    """Token ids of all texts in ascending id order, as stored segments; returns the segment table.

    Rows are dealt to parts by ranges of the id and the text's hash and sorted within;
    equal ids are ordered by their text's hash, null ids come first. A part is a sequence of segments; a
    segment ends with the documents that fill it, a few megabytes of text at most or one
    longer document. ``before`` counts the part's ids before the segment. With
    ``special_tokens`` the string of a special token becomes its id, as in the library's
    plain call; without, it is ordinary text.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    def emit(batches):
        from pyspark import TaskContext

        encoder, part = _word_encoder(tokenizer_json, special_tokens), TaskContext.get().partitionId()
        ids, copies, codes, sizes, held, segment, before = [], [], [], [], 0, 0, 0

        def flush():
            size = np.concatenate(sizes)
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "part": part, "segment": segment, "before": before, "tokens": held, "row_ids": ids, "row_copies": copies,
                        "begins": np.cumsum(size) - size, "codes": encode_segment(np.concatenate(codes)),
                    }
                ],
                schema=pa.schema(
                    [
                        ("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("tokens", pa.int64()), ("row_ids", pa.list_(pa.int64())),
                        ("row_copies", pa.list_(pa.int64())), ("begins", pa.list_(pa.int64())), ("codes", pa.binary()),
                    ]
                ),
            )

        for batch in batches:
            data, offsets = text_bytes(batch.column("row_text"))
            for i, j in byte_slices(offsets):
                with gc_paused():
                    found, n = encoder.encode(data, offsets[i : j + 1])
                codes.append(np.insert(found, np.cumsum(n), end_id).astype("<u4"))
                sizes.append(n + 1)
                ids += batch.column("row_id").slice(i, j - i).to_pylist()
                copies += batch.column("row_copy").slice(i, j - i).to_pylist()
                held += int(n.sum()) + j - i
                if held >= segment_tokens:
                    yield flush()
                    segment, before = segment + 1, before + held
                    ids, copies, codes, sizes, held = [], [], [], [], 0
        if codes:
            yield flush()
        encoder.known = WordTable()  # the worker may live on

    rows = packed(docs, id_col, text_col).select("row_id", "row_copy", "row_text")
    dealt = rows.repartitionByRange("row_id", "row_copy").sortWithinPartitions("row_id", "row_copy")
    return store(dealt.mapInArrow(emit, SEGMENTS), "tokens") if path is None else _store_at(dealt.mapInArrow(emit, SEGMENTS), path)


def _store_at(segments: DataFrame, path: str) -> DataFrame:
    segments.write.mode("overwrite").parquet(path)
    return segments.sparkSession.read.schema(segments.schema).parquet(path)


def open_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def read_tokens(segments: DataFrame) -> DataFrame:
    """(row_id, start, ids) of every document, read by random access; ``start`` counts the ids of all documents before it."""
    parts = segments.groupBy("part").agg(F.sum("tokens").alias("n"))  # a row per file part
    first = parts.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def emit(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = Segment(row["codes"])
                bounds = np.append(np.array(row["begins"], np.int64), row["tokens"])
                packed_ids = []
                for i in range(0, len(bounds) - 1, READ_AT_ONCE):
                    own = bounds[i : i + READ_AT_ONCE + 1]
                    ids = codes.take(np.arange(own[0], own[-1])).astype("<u4").tobytes()
                    cuts = (4 * (own - own[0])).tolist()
                    packed_ids += [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                starts = bounds[:-1] + row["base"] + row["before"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["row_ids"], pa.int64()), pa.array(starts), pa.array(packed_ids, pa.binary())], names=["row_id", "start", "ids"]
                )

    placed = segments.join(F.broadcast(first), segments.part == first.of)  # bounded by the number of parts
    return placed.select("base", "before", "tokens", "row_ids", "begins", "codes").mapInArrow(emit, "row_id long, start long, ids binary")
