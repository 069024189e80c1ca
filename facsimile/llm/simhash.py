"""SimHash near-dedup by multi-index hashing.

A text's fingerprint has 64 bits: each is the majority of that bit over the XXH64 of all
word shingles. Two fingerprints at most ``distance`` bits apart differ by at most
``distance // 2`` bits in one of their two 32-bit segments. Each distinct fingerprint is
entered in one table per segment; the small Hamming ball around its own segment is
enumerated, the table's matches are fetched by an equi-join, and the whole distance is
verified inside that join. Linked fingerprints then form components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import gc_paused, map_batches, packed, same_row, store
from facsimile.llm.components import components

SEED = 42
SEGMENT_BITS = 32


def fingerprint(text: bytes, words: int) -> int:
    """The SimHash of a text's lower-cased word shingles; no words: zero."""
    parts = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    n = len(parts)
    if n == 0:
        return 0
    joined = b" ".join(parts)
    shingles = n - words + 1
    if shingles <= 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, parts), np.int64, n)
        ends = np.cumsum(size + 1) - 1
        begins = (ends - size)[:shingles].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], SEED) for i, j in zip(begins, ends[words - 1 :].tolist())]
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(octets), 1 << 16):
        ones += np.unpackbits(octets[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(octets), bitorder="little").view(np.int64)[0])


def fingerprints(rows: DataFrame, words: int) -> DataFrame:
    """(row_id, row_copy, print): one row per input row."""

    def emit(batches):
        for batch in batches:
            texts = batch.column("row_text").cast(pa.large_binary())
            with gc_paused():
                prints = pa.array([fingerprint(t.as_py(), words) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("row_copy"), prints], names=["row_id", "row_copy", "print"])

    return map_batches(rows.select("row_id", "row_copy", "row_text"), emit, "row_id long, row_copy long, print long")


def hamming_ball(radius: int) -> list[int]:
    """All masks of a segment with at most ``radius`` bits set."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(SEGMENT_BITS), r)]


def near_links(prints: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between different fingerprints ``print`` at most ``distance`` bits apart.

    A link is found from one side only, and a fingerprint has a bounded number of
    neighbours (41,728 others lie within three bits), however many documents there are.
    """
    low = F.col("print").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("print", SEGMENT_BITS)
    table = prints.select("print", F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), v.alias("key")) for i, v in enumerate((low, high))])).alias("s"))
    table = table.select("print", "s.segment", "s.key")
    masks = F.array(*[F.lit(m).cast("long") for m in hamming_ball(distance // 2)])
    probes = table.select(F.col("print").alias("probe"), "segment", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("key")))).alias("key"))
    near = F.bit_count(F.col("probe").bitwiseXOR(F.col("print"))) <= distance
    found = probes.join(table, ["segment", "key"]).filter((F.col("probe") < F.col("print")) & near)
    return found.select(F.col("probe").alias("a"), F.col("print").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3
) -> DataFrame:
    """Each row of ``docs`` as (row, row_text, print, component_id, group, first, copies).

    ``component_id`` is the smallest id reachable over links, ``group`` the component's
    smallest fingerprint. Fingerprints link at ``distance`` or fewer differing bits; equal
    ones always do. ``first`` marks the row that stands for its component: the smallest id,
    of equal ids the smallest text hash; ``copies`` counts rows equal in id and text, which
    agree in all columns. Null texts are empty; texts without words have the fingerprint
    zero, linked like any other; shorter texts than ``words`` are one shingle. Null ids
    take part and come last; a component of null ids has a null ``component_id``. An
    empty table gives an empty result. Other columns, whatever their names, come back in
    ``row``.
    """
    rows = packed(docs, id_col, text_col)
    keyed = store(fingerprints(rows, words), "simhash")
    place = F.struct(F.col("row_id").isNull().alias("no_id"), "row_id", "row_copy")
    distinct = keyed.groupBy("print").agg(F.min(place).alias("smallest"))
    member = components(near_links(distinct.select("print"), distance))
    named = distinct.join(member, distinct.print == member.node, "left").select(
        "print", "smallest", F.coalesce("component", "print").alias("group")
    )
    owners = named.groupBy("group").agg(F.min("smallest").alias("owner"))
    by_print = store(named.select("print", "group").join(owners, "group"), "simhash-groups")
    counted = keyed.groupBy("print", "row_id", "row_copy").agg(F.count(F.lit(1)).alias("copies"))
    labelled = counted.join(by_print, "print")
    return rows.join(labelled, same_row(rows, labelled)).select(
        rows.row,
        rows.row_text,
        "print",
        F.col("owner.row_id").alias("component_id"),
        "group",
        (rows.row_id.eqNullSafe(F.col("owner.row_id")) & (rows.row_copy == F.col("owner.row_copy"))).alias("first"),
        "copies",
    )


def one_of_each(found: DataFrame) -> DataFrame:
    """One row of each component of ``near_duplicates``; only rows that have equal copies are shuffled for it."""
    first = found.filter("first")
    return first.filter("copies = 1").unionByName(first.filter("copies > 1").dropDuplicates(["group"]))
