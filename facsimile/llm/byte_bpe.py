"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

The vocabulary is a rank file (base64 of a token's bytes, its rank), given by path, read
once on the driver and shipped as text of a few hundred kilobytes. Bytes are mapped to
printable characters for the library and back by the same table. A token sequence is
packed as little-endian unsigned 32-bit integers.

Texts are cut where a single space stands between two characters that are not white
space. The pattern always begins a match at such a space, so each piece is encoded for
itself, and each distinct piece of a task only once.
"""

from __future__ import annotations

import base64
import codecs
import os
from functools import lru_cache
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import gc_paused, map_batches, text_bytes
from facsimile.llm.words import WordTable, byte_slices

CACHED_PIECES = 300_000  # of about 190 bytes each
JOINED_PIECES = 500
ROWS_AT_ONCE = 512
# ASCII characters that some definition counts as white space, and first bytes of longer ones that may be.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
MAY_BE_SPACE = np.zeros(256, bool)
MAY_BE_SPACE[[0xE1, 0xE2, 0xE3]] = True


def read_ranks(path: str) -> str:
    """The rank file as text; its size does not depend on the data."""
    with open(path, encoding="ascii") as file:
        return file.read()


@lru_cache(maxsize=4)
def token_table(ranks: str) -> tuple[bytes, ...]:
    """The bytes of each id; ids that the file leaves out are empty."""
    pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in ranks.splitlines() if line.strip())]
    table = [b""] * (max(r for _, r in pairs) + 1)
    for token, rank in pairs:
        table[rank] = token
    return tuple(table)


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = {b: chr(b) for b in prints}, 256
    for b in range(256):
        if b not in letters:
            letters[b], free = chr(free), free + 1
    return [letters[b] for b in range(256)]


@lru_cache(maxsize=4)
def tokenizer(ranks: str, pattern: str):
    """A tokenizer that merges by rank within each match of ``pattern``.

    The rank file names merged tokens, not pairs: every cut of a token into two tokens
    is a merge of that token's rank.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    letters, table = byte_letters(), token_table(ranks)
    spelled = {token: "".join(letters[b] for b in token) for token in table if token}
    merges = [
        (spelled[token[:i]], spelled[token[i:]])
        for token in table
        for i in range(1, len(token))
        if token[:i] in spelled and token[i:] in spelled
    ]
    vocab = {spelled[token]: rank for rank, token in enumerate(table) if token}
    built = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    built.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return built


def piece_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of pieces: a row is cut before each single space between characters that are surely no white space."""
    raw = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    before = np.zeros(len(raw), bool)  # the character that ends here is no white space
    wide = MAY_BE_SPACE[raw]
    before[:] = ~BLANK[raw]
    before[1:] &= ~((raw[:-1] == 0xC2) & (raw[1:] >= 0x80))
    before[2:] &= ~(wide[:-2] & (raw[2:] >= 0x80))
    after = ~BLANK[raw] & ~wide & (raw != 0xC2)  # the character that begins here is none either
    cut = raw == 0x20
    cut[:1] = cut[-1:] = False
    cut[1:] &= before[:-1]
    cut[:-1] &= after[1:]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    cut &= ~edge[:-1] & ~edge[1:]  # not where its neighbour is another row's
    filled = offsets[:-1][np.diff(offsets) > 0]
    cut[filled] = True
    begin = np.flatnonzero(cut)
    return np.searchsorted(offsets, begin, side="right") - 1, begin, np.append(begin[1:], len(raw))[: len(begin)]


class PieceEncoder:
    """Ids of texts from the ids of their pieces; known pieces are found by their bytes."""

    def __init__(self, built, table: tuple[bytes, ...]) -> None:
        self.built = built
        self.size = np.array([len(t) for t in table])
        self.known = WordTable()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.built.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Enter new pieces; those that begin with a space are encoded many at a time and cut again by their bytes."""
        spaced = [i for i, p in enumerate(pieces) if p[:1] == b" "]
        others = [i for i, p in enumerate(pieces) if p[:1] != b" "]
        found, sizes = [], []
        for k in range(0, len(spaced), JOINED_PIECES):
            part = [pieces[i] for i in spaced[k : k + JOINED_PIECES]]
            ids = self._ids(b"".join(part).decode())
            cuts = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(p) for p in part]), side="right")
            found.append(ids[: cuts[-1]])
            sizes.append(np.diff(cuts, prepend=0))
        for i in others:
            found.append(self._ids(pieces[i].decode()))
            sizes.append([len(found[-1])])
        if found:
            self.known.add(keys[spaced + others], np.concatenate(found), np.concatenate(sizes).astype(np.int64))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows of UTF-8 text, how many each row has)."""
        if self.known.full(CACHED_PIECES):
            self.known = WordTable()
        row, begin, end = piece_places(data, offsets)
        own = data[offsets[0] : offsets[-1]]
        keys, first, of = np.unique(self.known.keys(own, begin, end), return_index=True, return_inverse=True)
        missing = np.flatnonzero(self.known.find(keys) < 0)
        raw = own.tobytes()
        self._learn(keys[missing], [raw[a:b] for a, b in zip(begin[first[missing]].tolist(), end[first[missing]].tolist())])
        ids, n = self.known.gather(self.known.find(keys)[of])
        return ids, np.bincount(row, weights=n, minlength=len(offsets) - 1).astype(np.int64)

    def packed(self, texts: pa.Array) -> Iterator[pa.Array]:
        """Packed ids of the texts, some rows at a time."""
        data, offsets = text_bytes(texts)
        for i, j in byte_slices(offsets):
            with gc_paused():
                ids, n = self.encode(data, offsets[i : j + 1])
            until = np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32)
            yield pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(until.tobytes()), pa.py_buffer(ids.tobytes())])


@lru_cache(maxsize=2)
def _encoder(ranks: str, pattern: str) -> PieceEncoder:
    return PieceEncoder(tokenizer(ranks, pattern), token_table(ranks))


def decode(ids: bytes, table: tuple[bytes, ...]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode_pieces(ids: bytes, table: tuple[bytes, ...]) -> list[str]:
    """The text that each token completes; a character split over tokens comes with its last byte."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    tokens = np.frombuffer(ids, "<u4").tolist()
    return [decoder.decode(table[t], final=i + 1 == len(tokens)) for i, t in enumerate(tokens)]


def token_offsets(ids: bytes, table: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) character of each token, as places in the decoded text; a split character counts for all its tokens."""
    tokens = np.frombuffer(ids, "<u4").tolist()
    size = np.fromiter((len(table[t]) for t in tokens), np.int64, len(tokens))
    data = np.frombuffer(decode(ids, table), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    end = np.cumsum(size)
    return character[end - size], character[end - 1]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(batch), ROWS_AT_ONCE):
        yield batch.slice(i, ROWS_AT_ONCE)


def encode_texts(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", offsets: bool = False, decoded: bool = False
) -> DataFrame:
    """Each row of ``docs`` as (row, ids[, first_char, last_char][, decoded]): its other columns and the packed token ids.

    ``decoded`` decodes the ids again on the way, in the same Python worker.

    Null and empty texts have no ids. No special tokens: their strings are ordinary text.
    Rows are independent, so equal rows agree and an empty table gives an empty result;
    other columns, whatever their names, come back in ``row``.
    """
    ranks = read_ranks(ranks_path)

    def emit(batches):
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            done = 0
            for ids in encoder.packed(batch.column("row_text")):
                columns, names = [batch.column("row").slice(done, len(ids)), ids], ["row", "ids"]
                done += len(ids)
                if offsets:
                    places = [token_offsets(p, token_table(ranks)) for p in ids.to_pylist()]
                    columns += [pa.array([p[i] for p in places], pa.list_(pa.int64())) for i in (0, 1)]
                    names += ["first_char", "last_char"]
                if decoded:
                    columns.append(_decoded(ids, token_table(ranks)))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        encoder.known = WordTable()  # the worker may live on

    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("row_text"),
    )
    places = ", first_char array<bigint>, last_char array<bigint>" if offsets else ""
    places += ", decoded binary" if decoded else ""
    return map_batches(rows, emit, f"row {rows.schema['row'].dataType.simpleString()}, ids binary{places}")


def _decoded(ids: pa.Array, table: tuple[bytes, ...]) -> pa.Array:
    return pa.array([decode(p.as_py() or b"", table) for p in ids], pa.binary())


def decode_tokens(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(row, ids, decoded): the bytes that the ids stand for. Null ids decode to nothing; an id outside the file is an error."""
    ranks = read_ranks(ranks_path)

    def emit(batches):
        table = token_table(ranks)
        for whole in batches:
            for batch in _slices(whole):
                decoded = _decoded(batch.column("ids"), table)
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("ids"), decoded], names=["row", "ids", "decoded"])

    kept = encoded.select("row", "ids")
    return map_batches(kept, emit, f"row {kept.schema['row'].dataType.simpleString()}, ids binary, decoded binary")
