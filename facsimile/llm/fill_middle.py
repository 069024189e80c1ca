"""Fill-in-middle transformation: texts cut at unit ends that are found eight bytes at a time.

The UTF-8 bytes of many rows are viewed as 64-bit words. Bytes that end a unit (a line or
a character) are marked in all words by arithmetic, counted per word, and the counts are
summed up. The end of unit k is then a binary search for its word and a selection among
the eight bytes of that word; no text is split into units.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import text_bytes
from facsimile.llm.words import byte_slices

U = np.uint64
ONES, HIGH, REST = U(0x0101010101010101), U(0x8080808080808080), U(0x7F7F7F7F7F7F7F7F)
CONTINUATION = 0x80  # fills the last word: no line end, and no character begins there
UNITS = ("line", "character")


def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes as 64-bit words, lowest byte first, and one word more."""
    filled = np.full((len(data) // 8 + 2) * 8, CONTINUATION, np.uint8)
    filled[: len(data)] = data
    return filled.view("<u8")


def line_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a line feed: of the bytes that are zero after the exclusive or."""
    x = words ^ (ONES * U(0x0A))
    return ~(((x & REST) + REST) | x | REST)


def character_begins(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that does not continue a character (bits 10 at its top)."""
    return ~(words & ~(words << U(1))) & HIGH


def character_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte before the beginning of a character."""
    begins = character_begins(words)
    ends = begins >> U(8)
    ends[:-1] |= begins[1:] << U(56)
    return ends


class Marks:
    """Marked bytes, with their number before each word."""

    def __init__(self, marks: np.ndarray) -> None:
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """How many bytes before each place are marked."""
        word, below = place >> 3, (U(1) << ((place & 7) << 3).astype(U)) - U(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, number: np.ndarray) -> np.ndarray:
        """The places of the marked bytes of these numbers, counted from zero."""
        word = np.searchsorted(self.before, number, side="right") - 1
        within = (number - self.before[word]).astype(U)
        up_to = (self.marks[word] >> U(7)) * ONES  # byte i: marks in the bytes 0 to i
        passed = ((within * ONES) | HIGH) - up_to  # its high bit stays where up_to <= within
        return (word << 3) + np.bitwise_count(passed & HIGH)


def cut_places(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str = "line"):
    """(units, begin, cut, cut, end, prefix and middle characters) of each row.

    The cuts lie after ``min`` and ``max`` of ``first`` and ``second``, each modulo the
    row's units and one more.
    """
    raw = data[offsets[0] : offsets[-1]]
    words = as_words(raw)
    ends = Marks(line_ends(words) if unit == "line" else character_ends(words))
    begin, end = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    filled = end > begin
    base = ends.rank(begin)
    n = np.where(filled, ends.rank(np.maximum(end - 1, begin)) - base + 1, 0)  # the last byte ends a unit, marked or not
    picked = np.stack([first % (n + 1), second % (n + 1)])
    cuts = []
    for k in (picked.min(axis=0), picked.max(axis=0)):
        inside = (k > 0) & (k < n)
        cut = np.where(k == 0, begin, end)
        cut[inside] = ends.select((base + k - 1)[inside]) + 1
        cuts.append(cut)
    characters = Marks(character_begins(words))
    until = [characters.rank(x) for x in (begin, *cuts)]
    return n, begin, *cuts, end, until[1] - until[0], until[2] - until[1]


def fill_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    unit: str = "line",
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
) -> DataFrame:
    """Each row of ``docs`` as (row, row_text, output, form, n, prefix_chars, middle_chars).

    Two cuts after whole units, drawn by the SHA-256 of seed and id, make a prefix, a
    middle and a suffix. ``psm`` writes prefix, suffix, middle behind their marks, ``spm``
    suffix, prefix, middle (``spm_rate`` of 100 rows). ``plain`` rows keep their text and
    have null lengths: empty texts, texts that hold a mark, and all but ``rate`` of 100.
    Marks begin with ``<``, end with ``>`` and have neither inside, so that
    ``restored_text`` finds them wherever the cuts are.

    A null text is empty, a null id is drawn as an empty one. Rows are independent: equal
    rows agree, rows of one id have the same draws, an empty table gives an empty result.
    Other columns, whatever their names, come back in ``row``.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    if len(set(marks)) != 3 or not all(m[:1] == "<" and m[-1:] == ">" and len(m) > 2 and not set("<>") & set(m[1:-1]) for m in marks):
        raise ValueError("marks are three different strings like <P>")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draw = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    marked = text.contains(marks[0]) | text.contains(marks[1]) | text.contains(marks[2])
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
        text.alias("row_text"),
        draw[0].alias("first"),
        draw[1].alias("second"),
        F.when((text == "") | marked | (draw[2] % 100 >= rate), "plain").when(draw[3] % 100 < spm_rate, "spm").otherwise("psm").alias("form"),
    )
    prefix_mark, suffix_mark, middle_mark = (m.encode() for m in marks)

    def emit(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("row_text"))
            for i, j in byte_slices(offsets):
                part, own = batch.slice(i, j - i), offsets[i : j + 1]
                first, second = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "second"))
                n, begin, low, high, end, prefix_chars, middle_chars = cut_places(data, own, first, second, unit)
                raw = data[own[0] : own[-1]].tobytes()
                forms, made = part.column("form").to_pylist(), []
                for form, a, b, c, d in zip(forms, begin.tolist(), low.tolist(), high.tolist(), end.tolist()):
                    if form == "plain":
                        made.append(raw[a:d])
                    elif form == "psm":
                        made.append(b"".join((prefix_mark, raw[a:b], suffix_mark, raw[c:d], middle_mark, raw[b:c])))
                    else:
                        made.append(b"".join((suffix_mark, raw[c:d], prefix_mark, raw[a:b], middle_mark, raw[b:c])))
                plain = np.array([f == "plain" for f in forms], bool)
                until = np.concatenate([[0], np.cumsum([len(m) for m in made])]).astype(np.int32)
                output = pa.Array.from_buffers(pa.string(), len(made), [None, pa.py_buffer(until.tobytes()), pa.py_buffer(b"".join(made))])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("row_text"), output, part.column("form"), pa.array(n, pa.int64()),
                        pa.array(prefix_chars, pa.int64(), mask=plain), pa.array(middle_chars, pa.int64(), mask=plain),
                    ],
                    names=["row", "row_text", "output", "form", "n", "prefix_chars", "middle_chars"],
                )

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(emit, f"row {kind}, row_text string, output string, form string, n long, prefix_chars long, middle_chars long")


def restored_text(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that ``fill_middle`` was given, from its output and form alone."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        before = F.substring_index(body, second, 1)
        after = F.substr(body, F.length(before) + len(second) + 1)
        between = F.substring_index(after, marks[2], 1)
        return before, between, F.substr(after, F.length(between) + len(marks[2]) + 1)

    prefix, suffix, middle = parts(marks[0], marks[1])
    spm_suffix, spm_prefix, spm_middle = parts(marks[1], marks[0])
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(spm_prefix, spm_middle, spm_suffix))
        .otherwise(output)
    )
