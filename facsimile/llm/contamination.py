"""Benchmark decontamination: test items whose word shingles lie inside documents.

Size-partitioned containment search with MinHash sketches of the small sets. An item of
q distinct shingles that a document holds to a share t lacks at most q - ceil(t q) of
them, so of its k = q - ceil(t q) + 1 smallest shingle hashes at least one is in the
document: these k are its sketch. Items are partitioned by size, and a class of sizes
uses the k of its largest, so no item's sketch is too short. Every shingle of every
document is hashed (all words of a batch at once) and looked up in the sketches; items
that are met are then verified by exact shingle containment in the same task. The search
misses nothing, so long documents need no windows and no estimate. Items of fewer words
than a shingle are one shingle of their own width, and texts are searched at each width.

Benchmarks are query sets, stated in blocks: each block's sketches and texts are shipped
to the tasks and the documents are scanned, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import copy_key, map_batches, packed, text_bytes
from facsimile.llm.rolling import U, mix
from facsimile.llm.words import word_hashes, word_places

BLOCK_ITEMS = 5_000  # items of a block: its texts and sketches are what a task is sent


def shingles(text: bytes, words: int) -> list[bytes]:
    """Distinct shingles in order of appearance: lower-cased words joined by spaces; shorter texts are one shingle."""
    parts = text.lower().split()
    if not parts:
        return []
    return list(dict.fromkeys(b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of rows of UTF-8 text, repeats included."""
    lowered, row, begin, end = word_places(data, offsets)
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, U)
    word = word_hashes(lowered, begin, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    width = np.minimum(words, count)[row]  # shorter texts are one shingle
    place = np.arange(len(row)) - first[row]
    starts = np.flatnonzero(place + width <= count[row])
    starts = starts[(width[starts] == words) | (place[starts] == 0)]
    total = np.zeros(len(starts), U)
    for step in range(words):
        has = step < width[starts]
        following = word[np.minimum(starts + step, len(word) - 1)]
        total = np.where(has, mix(total * U(0x9E3779B97F4A7C15) + following + U(step + 1)), total)
    return row[starts], total


class ItemBlock:
    """Sketches and shingles of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], words: int, share: float) -> None:
        self.share = share
        self.ids = [i for i, _ in items]
        self.sets = [frozenset(shingles(text, words)) for _, text in items]
        self.width = [min(words, len(text.split())) for _, text in items]
        keys: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for n, own in enumerate(self.sets):
            if not own:
                continue
            texts = list(own)
            data = np.frombuffer(b"\n".join(texts), np.uint8)
            ends = np.cumsum([len(t) + 1 for t in texts])
            # Shingles are separate rows; the separating newline belongs to the row before it.
            offsets = np.concatenate([[0], np.minimum(ends, len(data))])
            hashes = np.unique(shingle_hashes(data, offsets, words)[1])
            sketch = hashes[: self.sketch_size(len(own))]
            keys.setdefault(self.width[n], []).append(sketch)
            owners.setdefault(self.width[n], []).append(np.full(len(sketch), n))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by width: sorted sketch hashes and their items
        for width in keys:
            key, owner = np.concatenate(keys[width]), np.concatenate(owners[width])
            order = np.argsort(key, kind="stable")
            self.tables[width] = key[order], owner[order]

    def sketch_size(self, size: int) -> int:
        """Of a size class (bounds are powers of two): how many shingles its largest member may lack, and one."""
        upper = 1 << (size - 1).bit_length()
        return min(size, upper - int(np.ceil(self.share * upper - 1e-9)) + 1)

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Distinct (row, item) with a sketch hash in the row."""
        pairs = [np.zeros((0, 2), np.int64)]
        for width, (key, owners) in self.tables.items():
            row, found = shingle_hashes(data, offsets, width)
            at = np.searchsorted(key, found)
            hit = np.flatnonzero(key[np.minimum(at, len(key) - 1)] == found)
            begin, end = at[hit], np.searchsorted(key, found[hit], side="right")
            many = end - begin
            owner = owners[np.repeat(begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            pairs.append(np.stack([np.repeat(row[hit], many), owner], axis=1))
        return np.unique(np.concatenate(pairs), axis=0)


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 5,
    share: float = 0.8,
) -> DataFrame:
    """(row_id, row_copy, item_id, n_shared, n_item): items of which a text holds ``share`` of the distinct word shingles or more.

    Words are what ASCII white space separates, A-Z in lower case; an item of fewer than
    ``words`` words is one shingle of as many words, found wherever they follow each other. Items
    without words match nothing, null texts are empty, null ids are reported as null,
    equal rows are reported each, and either table may be empty. Items are read in blocks
    of ``BLOCK_ITEMS`` by the driver: a benchmark is a stated query set.
    """
    rows = packed(docs, id_col, text_col).select("row_id", "row_copy", "row_text")
    schema = "row_id long, row_copy long, item_id long, n_shared long, n_item long"
    found = None
    for block in _blocks(benchmark, item_col, item_text_col, words, share):
        part = map_batches(rows, _emit_contained(block), schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def without_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item; rows and columns are as they were."""
    hits = contained_items(docs, benchmark, id_col, text_col, **options).select("row_id", "row_copy").distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.join(hits, F.col(id_col).cast("bigint").eqNullSafe(hits.row_id) & (copy_key(text) == hits.row_copy), "left_anti")


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, words: int, share: float):
    held = []
    items = benchmark.select(F.col(item_col).cast("bigint"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for item_id, text in items.toLocalIterator():
        held.append((item_id, text.encode()))
        if len(held) == BLOCK_ITEMS:
            yield ItemBlock(held, words, share)
            held = []
    if held:
        yield ItemBlock(held, words, share)


def _emit_contained(block: ItemBlock):
    def emit(batches):
        for whole in batches:
            for i in range(0, len(whole), 2048):
                batch = whole.slice(i, 2048)
                data, offsets = text_bytes(batch.column("row_text"))
                pairs = block.candidates(data, offsets)
                rows, items, shared = [], [], []
                last, own = -1, {}
                for row, item in pairs.tolist():
                    if row != last:
                        last, own = row, {}
                    width = block.width[item]
                    if width not in own:
                        own[width] = frozenset(shingles(data[offsets[row] : offsets[row + 1]].tobytes(), width))
                    n = len(block.sets[item] & own[width])
                    if n >= block.share * len(block.sets[item]) - 1e-9:
                        rows.append(row)
                        items.append(item)
                        shared.append(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row_id").take(pa.array(rows, pa.int64())), batch.column("row_copy").take(pa.array(rows, pa.int64())),
                        pa.array([block.ids[n] for n in items], pa.int64()), pa.array(shared, pa.int64()),
                        pa.array([len(block.sets[n]) for n in items], pa.int64()),
                    ],
                    names=["row_id", "row_copy", "item_id", "n_shared", "n_item"],
                )

    return emit
