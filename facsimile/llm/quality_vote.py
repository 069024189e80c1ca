"""Quality by nearest-neighbour voting among labelled texts in a latent-semantic space.

A text is a bag of hashed byte trigrams and of hashed four-grams of character classes
(lower case, upper case, digit, white space, each symbol for itself), weighted by
1 + log(count) and by the inverse document frequency over *all* documents. A truncated
SVD of the labelled sample's matrix gives the latent space. The labelled vectors and the
projection are broadcast (their size is a parameter), every document's cosines with all
of them are one matrix product per block of rows, and its ``neighbours`` nearest labels
are averaged with their similarities as weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import Stored, packed, text_bytes
from facsimile.llm.labelled import labelled_sample

HALF = 4096  # hashed features of a kind
WIDTH = 2 * HALF
BLOCK_ROWS = 256
BLOCK_BYTES = 1 << 22


def _classes() -> np.ndarray:
    """Character class of each byte: letters and digits merge, every symbol stays itself."""
    kinds = np.arange(256, dtype=np.uint32)
    kinds[ord("a") : ord("z") + 1] = ord("a")
    kinds[ord("A") : ord("Z") + 1] = ord("A")
    kinds[ord("0") : ord("9") + 1] = ord("0")
    kinds[[0x20, *range(0x09, 0x0A), *range(0x0B, 0x0E)]] = 0x20
    kinds[128:] = ord("a")
    return kinds


CLASSES = _classes()


def _grams(letters: np.ndarray, size: int) -> np.ndarray:
    code = np.zeros(len(letters) - size + 1, np.uint32)
    for i in range(size):
        code = code * np.uint32(257) + letters[i : len(letters) - size + 1 + i]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(20)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``WIDTH`` counts per text; a long text is counted piece by piece."""
    rows = len(offsets) - 1
    counts = np.zeros((rows, WIDTH), np.float32)
    if rows > 1 and offsets[-1] - offsets[0] <= BLOCK_BYTES:
        own = data[offsets[0] : offsets[-1]]
        ends = offsets[1:] - offsets[0]
        for letters, size, base in ((own.astype(np.uint32), 3, 0), (CLASSES[own], 4, HALF)):
            if len(own) < size:
                continue
            code = _grams(letters, size)
            row = np.repeat(np.arange(rows), np.diff(offsets))[: len(code)]
            inside = np.arange(len(code)) + size <= ends[row]
            counts[:, base : base + HALF] = np.bincount(row[inside] * HALF + code[inside], minlength=rows * HALF).reshape(rows, HALF)
        return counts
    for i in range(rows):
        for at in range(offsets[i], offsets[i + 1], BLOCK_BYTES):
            own = data[at : min(at + BLOCK_BYTES + 3, offsets[i + 1])]
            for letters, size, base in ((own.astype(np.uint32), 3, 0), (CLASSES[own], 4, HALF)):
                code = _grams(letters, size)[:BLOCK_BYTES] if len(own) >= size else np.zeros(0, np.uint32)
                counts[i, base : base + HALF] += np.bincount(code, minlength=HALF)
    return counts


def _blocks(batch: pa.RecordBatch, column: str):
    """(first row, rows, counts) of a batch, a bounded number of rows and bytes at a time."""
    data, offsets = text_bytes(batch.column(column))
    i = 0
    while i < len(batch):
        j = int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, side="right")) - 1
        j = min(max(j, i + 1), i + BLOCK_ROWS, len(batch))
        yield i, j - i, gram_counts(data, offsets[i : j + 1])
        i = j


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature stands, over all rows, and the number of rows."""

    def count(batches):
        found, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for _, size, counts in _blocks(batch, "row_text"):
                found += np.count_nonzero(counts, axis=0)
                n += size
        features = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(features, -1)), pa.array(np.append(found[features], n))], names=["feature", "n"])

    partial = rows.select("row_text").mapInArrow(count, "feature long, n long")
    total = {r.feature: r.n for r in partial.groupBy("feature").agg(F.sum("n").alias("n")).collect()}  # WIDTH rows
    out = np.zeros(WIDTH, np.int64)
    for feature, n in total.items():
        if feature >= 0:
            out[feature] = n
    return out, total.get(-1, 0)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of (1 + log count) times idf; a text without grams stays zero."""
    with np.errstate(divide="ignore"):
        values = np.where(counts > 0, 1 + np.log(counts), 0).astype(np.float32) * idf
    return unit(values)


def unit(values: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(values, axis=1, keepdims=True)
    return values / np.where(length > 0, length, 1)


def latent_space(matrix: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors (features x rank), by a randomised range finder with two power steps."""
    rank = min(rank, *matrix.shape)
    start = np.random.default_rng(seed).standard_normal((matrix.shape[1], min(rank + 16, *matrix.shape))).astype(np.float32)
    basis = np.linalg.qr(matrix @ start)[0]
    for _ in range(2):
        basis = np.linalg.qr(matrix @ np.linalg.qr(matrix.T @ basis)[0])[0]
    right = np.linalg.svd(basis.T @ matrix, full_matrices=False)[2]
    return np.ascontiguousarray(right[:rank].T)


@dataclass
class VoteModel:
    """What the tasks are sent: idf, projection, labelled vectors and labels, all of bounded size."""

    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    sharpness: float

    def votes(self, counts: np.ndarray) -> np.ndarray:
        """A score per row; rows without similar labelled texts get the mean label."""
        mean = float(self.labels.mean()) if len(self.labels) else 0.0
        if not len(self.labels):
            return np.full(len(counts), mean)
        near = unit(weighted(counts, self.idf) @ self.space) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        best = np.argpartition(near, -k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(near, best, axis=1), 0) ** self.sharpness
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[best]).sum(axis=1) / np.where(total > 0, total, 1), mean)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Each row of ``docs`` as (row, score): its other columns and the vote.

        Null and empty texts are scored with the mean label; equal rows have equal
        scores; null ids and an empty table are no special case. Other columns, whatever
        their names, come back in ``row``.
        """
        rows = packed(docs, id_col, text_col).select("row", "row_text")
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def emit(batches):
            model = shared.value
            for batch in batches:
                scores = [np.zeros(0)] + [model.votes(counts) for _, _, counts in _blocks(batch, "row_text")]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(scores).clip(0, 1))], names=["row", "score"])

        return rows.mapInArrow(emit, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def fit_vote(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labelled: int = 4096,
    rank: int = 64,
    neighbours: int = 15,
    sharpness: float = 4.0,
) -> VoteModel:
    """Learn from at most ``max_labelled`` labelled rows, held-out ones excluded; document frequencies cover all rows."""
    found, n = document_frequencies(packed(docs, id_col, text_col))
    idf = (np.log((1 + n) / (1 + found)) + 1).astype(np.float32)
    sample = Stored(labelled_sample(docs, labels, label_col, held_out, max_labelled, id_col, text_col).repartition(32), "quality-sample")

    def vectors(batches):
        for batch in batches:
            for i, size, counts in _blocks(batch, "text"):
                own = batch.slice(i, size)
                packed_rows = [row.astype("<f2").tobytes() for row in weighted(counts, idf)]
                yield pa.RecordBatch.from_arrays([own.column("sample_id"), own.column("label"), pa.array(packed_rows, pa.binary())], names=["sample_id", "label", "v"])

    kept = sample.df.select("sample_id", "label", "text").mapInArrow(vectors, "sample_id long, label int, v binary")
    rows = sorted(kept.toLocalIterator(), key=lambda r: r.sample_id)  # at most max_labelled
    matrix = np.stack([np.frombuffer(r.v, "<f2") for r in rows]).astype(np.float32) if rows else np.zeros((0, WIDTH), np.float32)
    space = latent_space(matrix, rank) if rows else np.zeros((WIDTH, 0), np.float32)
    marks = np.array([r.label for r in rows], np.float64)
    return VoteModel(idf, space, unit(matrix @ space), marks, neighbours, sharpness)
