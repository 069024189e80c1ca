"""Suffix-array dedup: bytes of long strings that occur more than once.

The corpus arrives in batches and is kept as a logarithmic family of sorted suffix
arrays. They are sparse: a suffix is entered where the smallest hash of the 64-byte
strings of some window lies, so equal windows enter the suffix at the same place, and
one suffix stands for about 69 positions. Entries are ordered by the suffix's first three bytes
and then by a 40-bit fingerprint of its first 64 bytes; equality is all that a search for
repeats needs of the order below that.

* A new batch is sorted, and merge-scanned against every level (sort-merge joins on the
  suffix key). Keys met twice are hits.
* Levels of equal size merge like the digits of a binary counter, so an entry is
  rewritten log2(batches) times at most.
* Hits are then settled exactly. The windows that one suffix stands for form a *run*.
  Equal runs met twice are repeated as a whole. Other runs of a repeated suffix are cut
  into blocks of 16 windows, compared by the bytes that all windows of a block share, and
  only blocks that agree there are compared window by window. Counts are map-side
  aggregates at each step, so a passage that a third of all documents hold is one row per
  task, and no pairs are made. Runs and blocks are compared by 64-bit hashes
  within a group of equal 64-bit keys, windows by 32 bits within such a group.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import Stored, map_batches, packed, same_row, text_bytes
from facsimile.llm.rolling import BUFFER, U, all_hashes, mix, prefix_sums, sliding_minimum, substring_hash

ANCHOR = 64  # bytes that pick a suffix and order it
BLOCK = 16  # windows of a block

RUNS = "suffix long, run long, row_id long, row_copy long, start int, lead short, length short, batch int"
BLOCKS = "suffix long, run long, row_id long, row_copy long, start int, lead short, length short"
WINDOWS = "suffix long, run int, row_id long, row_copy long, start int"
SPANS = "array<struct<start:int,length:int>>"


def _segments(offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of pieces of at most half a buffer; each window lies in one piece."""
    begin, end = offsets[:-1], offsets[1:]
    row = np.flatnonzero(end - begin >= window)
    piece = BUFFER // 2
    pieces = -(-(end[row] - begin[row] - window + 1) // piece)
    rows = np.repeat(row, pieces)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = begin[rows] + number * piece
    return rows, at, np.minimum(at + piece + window - 1, end[rows])


def _buffers(begin: np.ndarray, end: np.ndarray) -> Iterator[slice]:
    """Neighbouring pieces that fit into a buffer together."""
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + BUFFER, side="right")))
        yield slice(i, j)
        i = j


def find_runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int):
    """Runs of windows with a common anchor: (piece, first window, anchor, windows, suffix key, run hash)."""
    base = begin[0]
    begin, end = begin - base, end - base
    buffer = data[base : base + end[-1]]
    sums = prefix_sums(buffer)
    hashes = mix(all_hashes(sums, ANCHOR))
    # The hash above, the place below: ties go to the first place, which the bytes alone decide.
    order = (hashes & U(0xFFFFFFFFFFC00000)) | np.arange(len(hashes), dtype=U)
    anchor = (sliding_minimum(order, window - ANCHOR + 1) & U(0x3FFFFF)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, np.int32)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end - window + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    opens = inside.copy()
    opens[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    opens[begin] = True
    closes = inside.copy()
    closes[:-1] &= opens[1:] | ~inside[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    at = anchor[first]
    head = (buffer[at].astype(U) << U(16)) | (buffer[at + 1].astype(U) << U(8)) | buffer[at + 2].astype(U)
    suffix = (head << U(40)) | (hashes[at] >> U(24))
    run = run_hash(sums, first, at - first, last - first + 1, window)
    return np.searchsorted(begin, first, side="right") - 1, first + base, at + base, last - first + 1, suffix, run


def run_hash(sums, first, lead, length, window):
    """Of all bytes of neighbouring windows, and where the anchor lies among them."""
    shape = (lead * 256 + length).astype(U) * U(0x9E3779B97F4A7C15)
    return mix(substring_hash(sums, first, first + length + window - 1) ^ mix(shape))


def _emit_runs(window: int):
    def emit(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("row_text"))
            ids, copies, dealt = (batch.column(c) for c in ("row_id", "row_copy", "batch"))
            rows, begin, end = _segments(offsets, window)
            for part in _buffers(begin, end):
                piece, first, at, length, suffix, run = find_runs(data, begin[part], end[part], window)
                row = rows[part][piece]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(suffix.view(np.int64)), pa.array(run.view(np.int64)), ids.take(pa.array(row)),
                        copies.take(pa.array(row)), pa.array((first - offsets[row]).astype(np.int32)),
                        pa.array((at - first).astype(np.int16)), pa.array(length.astype(np.int16)), dealt.take(pa.array(row)),
                    ],
                    names=["suffix", "run", "row_id", "row_copy", "start", "lead", "length", "batch"],
                )

    return emit


def suffix_runs(rows: DataFrame, window: int, batches: int) -> DataFrame:
    """All sampled suffixes of the texts with their runs, and the batch each belongs to."""
    dealt = rows.select("row_id", "row_copy", "row_text", F.pmod(F.hash("row_id", "row_copy"), F.lit(batches)).alias("batch"))
    return map_batches(dealt, _emit_runs(window), RUNS)


class SuffixIndex:
    """Levels of sorted suffix entries (suffix, row_id, n); level i holds 2^i batches."""

    def __init__(self) -> None:
        self.levels: dict[int, Stored] = {}

    def add(self, runs: DataFrame) -> Stored:
        """Enter a batch of runs; returns the suffix keys found to be repeated."""
        batch = runs.groupBy("suffix").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n"))
        merged, level, old = batch, 0, []
        while level in self.levels:
            old.append(self.levels.pop(level))
            merged = merged.unionByName(old[-1].df)
            level += 1
        if level:
            merged = merged.groupBy("suffix").agg(F.min("row_id").alias("row_id"), F.sum("n").alias("n"))
        new = Stored(merged.sortWithinPartitions("suffix"), "suffix-level")
        found = new.df.filter("n > 1").select("suffix")
        for other in self.levels.values():  # merge scan: both sides are sorted by the suffix
            found = found.unionByName(other.df.select("suffix").join(new.df.select("suffix"), "suffix", "left_semi"))
        hits = Stored(found, "suffix-hits")
        self.levels[level] = new
        for level in old:
            level.drop()
        return hits

    def drop(self) -> None:
        for level in self.levels.values():
            level.drop()


def resolve(rows: DataFrame, group: str, kind: str) -> DataFrame:
    """Rows of repeated groups with ``whole`` (their kind repeats) and ``open`` (other kinds of the group may share a part).

    Of a repeated kind, only rows of one text stay open, null ids included: they stand for all of them.
    """
    owner = F.xxhash64("row_id", "row_copy")
    # Stored: a join of plain shuffles is one whose hot keys Spark splits.
    kinds = Stored(rows.groupBy(group, kind).agg(F.count(F.lit(1)).alias("n"), F.min(owner).alias("owner")), "suffix-kinds")
    groups = Stored(kinds.df.groupBy(group).agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "suffix-groups").df
    known = Stored(kinds.df.join(groups, group, "left").filter("n > 1 OR k > 1"), "suffix-known").df
    kinds.drop()
    return rows.join(known, [group, kind]).select(
        *rows.columns,
        (F.col("n") > 1).alias("whole"),
        (F.col("k").isNotNull() & ((F.col("n") == 1) | (owner == F.col("owner")))).alias("open"),
    )


def _with_text(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The open rows of each text, as one list beside it."""
    lists = found.filter("open").groupBy("row_id", "row_copy").agg(F.collect_list(F.struct("start", "lead", "length")).alias("runs"))
    texts = rows.select("row_id", "row_copy", "row_text")
    lists = lists.withColumnRenamed("row_id", "id").withColumnRenamed("row_copy", "copy")
    same = texts.row_id.eqNullSafe(lists.id) & (texts.row_copy == lists.copy)
    return texts.join(lists, same).select("row_id", "row_copy", "row_text", "runs")


def _listed(batch: pa.RecordBatch):
    """(text bytes, row, first byte, lead, length) of all listed runs, piece by piece of bounded size."""
    data, offsets = text_bytes(batch.column("row_text"))
    lists = batch.column("runs")
    counts = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten()
    start, lead, length = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
    row = np.repeat(np.arange(len(counts)), counts)
    first = offsets[row] + start
    order = np.argsort(first, kind="stable")
    row, first, lead, length = row[order], first[order], lead[order], length[order]
    i = 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(first, first[i] + BUFFER - 1024, side="right")))
        yield data, offsets, row[i:j], first[i:j], lead[i:j], length[i:j]
        i = j


def _spread(first, lead, length):
    """Every window of the runs: (run, first byte, lead)."""
    run = np.repeat(np.arange(len(first)), length)
    step = np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length)
    return run, first[run] + step, lead[run] - step


def _emit_blocks(window: int):
    def emit(batches):
        for batch in batches:
            ids, copies = batch.column("row_id"), batch.column("row_copy")
            for data, offsets, row, first, lead, length in _listed(batch):
                base = first[0]
                sums = prefix_sums(data[base : first.max() + window + 256])
                run, at, ahead = _spread(first - base, lead, length)
                block = ahead // BLOCK
                opens = np.flatnonzero(np.diff(run, prepend=-1) | np.diff(block, prepend=-1))
                size = np.diff(np.append(opens, len(run)))
                at, ahead, block, run = at[opens], ahead[opens], block[opens], run[opens]
                group = _block_key(sums, at, ahead, block, window)
                kind = run_hash(sums, at, ahead, size, window)
                who = pa.array(row[run])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(group.view(np.int64)), pa.array(kind.view(np.int64)), ids.take(who), copies.take(who),
                        pa.array((at + base - offsets[row[run]]).astype(np.int32)), pa.array(ahead.astype(np.int16)),
                        pa.array(size.astype(np.int16)),
                    ],
                    names=["suffix", "run", "row_id", "row_copy", "start", "lead", "length"],
                )

    return emit


def _block_key(sums, at, ahead, block, window):
    """Of the anchor, the block's number and the bytes that every window of the block holds."""
    anchor = at + ahead
    shared = anchor - BLOCK * block
    own = substring_hash(sums, anchor, anchor + ANCHOR) + (block + 1).astype(U) * U(0x9E3779B97F4A7C15)
    return mix(mix(own) ^ substring_hash(sums, shared, shared + window - BLOCK + 1))


def _emit_windows(window: int):
    def emit(batches):
        for batch in batches:
            ids, copies = batch.column("row_id"), batch.column("row_copy")
            for data, offsets, row, first, lead, length in _listed(batch):
                base = first[0]
                sums = prefix_sums(data[base : first.max() + window + 256])
                run, at, ahead = _spread(first - base, lead, length)
                group = _block_key(sums, at, ahead, ahead // BLOCK, window)
                kind = mix(substring_hash(sums, at, at + window) + ahead.astype(U))
                who = pa.array(row[run])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(group.view(np.int64)), pa.array((kind >> U(32)).astype(np.uint32).view(np.int32)), ids.take(who),
                        copies.take(who), pa.array((at + base - offsets[row[run]]).astype(np.int32)),
                    ],
                    names=["suffix", "run", "row_id", "row_copy", "start"],
                )

    return emit


def repeated_spans(rows: DataFrame, window: int = 200, batches: int = 4) -> DataFrame:
    """(row_id, row_copy, start, length): neighbouring windows that also start elsewhere; spans may overlap."""
    runs = Stored(suffix_runs(rows, window, batches), "suffix-runs")
    index = SuffixIndex()
    hits = [index.add(runs.df.filter(F.col("batch") == number)) for number in range(batches)]
    known = Stored(reduce(DataFrame.unionByName, [h.df for h in hits]).distinct(), "suffix-hits")
    repeated = Stored(runs.df.drop("batch").join(known.df, "suffix", "left_semi"), "suffix-repeated")
    for spent in (runs, index, known, *hits):
        spent.drop()
    found = Stored(resolve(repeated.df, "suffix", "run").drop("suffix", "run"), "suffix-found")
    repeated.drop()
    blocks = Stored(map_batches(_with_text(found.df, rows), _emit_blocks(window), BLOCKS), "suffix-blocks")
    finer = Stored(resolve(blocks.df, "suffix", "run").drop("suffix", "run"), "suffix-finer")
    blocks.drop()
    windows = Stored(map_batches(_with_text(finer.df, rows), _emit_windows(window), WINDOWS), "suffix-windows")
    last = Stored(resolve(windows.df, "suffix", "run").drop("suffix", "run"), "suffix-last")
    windows.drop()

    def spans(part: DataFrame, length) -> DataFrame:
        return part.filter("whole").select("row_id", "row_copy", "start", length.cast("int").alias("length"))

    width = F.col("length") + (window - 1)
    return spans(found.df, width).unionByName(spans(finer.df, width)).unionByName(spans(last.df, F.lit(window)))


def _emit_kept(whole_characters: bool):
    def emit(batches):
        for batch in batches:
            yield from _kept(batch, whole_characters)

    return emit


def _kept(batch: pa.RecordBatch, whole_characters: bool):
    if len(batch):
        data, offsets = text_bytes(batch.column("row_text"))
        lists = batch.column("spans")
        counts = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        flat = lists.flatten()
        start, length = (np.asarray(flat.field(i)).astype(np.int64) for i in range(2))
        start = start + np.repeat(offsets[:-1], counts)
        until = np.concatenate([[0], np.cumsum(counts)])
        i = 0
        while i < len(batch):
            j = min(len(batch), max(i + 1, int(np.searchsorted(offsets, offsets[i] + BUFFER, side="right")) - 1))
            spans = slice(until[i], until[j])
            yield _cut(batch.column("row").slice(i, j - i), data, offsets[i : j + 1], start[spans], length[spans], whole_characters)
            i = j


def _cut(
    rows: pa.Array, data: np.ndarray, offsets: np.ndarray, start: np.ndarray, length: np.ndarray, whole_characters: bool
) -> pa.RecordBatch:
    """Some rows' bytes without the spans, and the maximal removed runs of each row."""
    base, bounds = offsets[0], offsets - offsets[0]
    own = data[base : offsets[-1]]
    edge = np.zeros(len(own) + 1, np.int32)
    np.add.at(edge, start - base, 1)
    np.add.at(edge, start - base + length, -1)
    gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
    if whole_characters:
        character = np.cumsum((own & 0xC0) != 0x80)
        gone = (np.bincount(character, weights=gone) > 0)[character] if len(own) else gone
    border = np.zeros(len(own) + 1, bool)
    border[bounds] = True  # runs end with their row
    first = np.flatnonzero(gone & (border[:-1] | ~np.concatenate([[False], gone[:-1]])))
    last = np.flatnonzero(gone & (border[1:] | ~np.concatenate([gone[1:], [False]])))
    row = np.searchsorted(bounds, first, side="right") - 1
    kept_until = np.concatenate([[0], np.cumsum(~gone)])[bounds].astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(kept_until.tobytes()), pa.py_buffer(own[~gone].tobytes())])
    spans = pa.StructArray.from_arrays(
        [pa.array((first - bounds[row]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], names=["start", "length"]
    )
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))]).astype(np.int32)
    return pa.RecordBatch.from_arrays([rows, kept, pa.ListArray.from_arrays(pa.array(ends), spans)], names=["row", "kept", "spans"])


def _folded(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Each (row_id, row_copy) once with its text, and those that came several times (None: there are none)."""
    rows = rows.select("row_id", "row_copy", "row_text")
    several = Stored(rows.groupBy("row_id", "row_copy").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "suffix-several").df
    if several.isEmpty():
        return rows, None
    keys = several.withColumnsRenamed({"row_id": "id", "row_copy": "copy"})
    same = rows.row_id.eqNullSafe(keys.id) & (rows.row_copy == keys["copy"])
    told = Stored(rows.join(keys, same, "left").select("row_id", "row_copy", "row_text", F.col("copy").isNotNull().alias("again")), "suffix-told").df
    single, again = told.filter("NOT again"), told.filter("again").dropDuplicates(["row_id", "row_copy"])
    return single.unionByName(again).drop("again"), again.drop("again")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, batches: int = 4, whole_characters: bool = False
) -> DataFrame:
    """Each row of ``docs`` as (row, kept, spans): its other columns, the bytes left, the maximal removed runs.

    Every byte covered by a ``window``-byte string that also starts anywhere else, in the
    same text or in another row, is removed; strings are judged on the input. With
    ``whole_characters`` a character goes when one of its bytes does, so ``kept`` is valid
    UTF-8; without it bytes are cut as they are. Null texts
    are empty; texts shorter than ``window`` stay whole; equal rows are copies of each
    other and lose what they share, and are searched once, however many; a null id is a document of its own; an empty table
    gives an empty result. Other columns, whatever their names, come back in ``row``.
    """
    if not ANCHOR + 2 * BLOCK <= window <= 255:
        raise ValueError(f"window must lie between {ANCHOR + 2 * BLOCK} and 255 bytes")
    rows = packed(docs, id_col, text_col)
    single, several = _folded(rows)
    spans = repeated_spans(single, window, batches)
    if several is not None:  # every string of such a text also starts in its copy
        size = F.octet_length("row_text")
        whole = several.filter(size >= window).select("row_id", "row_copy", F.lit(0).alias("start"), size.cast("int").alias("length"))
        spans = spans.unionByName(whole)
    lists = spans.groupBy("row_id", "row_copy").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    joined = rows.join(lists, same_row(rows, lists), "left").select("row_text", "row", "spans")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, kept binary, spans {SPANS}"
    return map_batches(joined, _emit_kept(whole_characters), schema)
