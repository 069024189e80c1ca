"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, white space runs as one space, digits as 0), hashed,
and counted by distinct documents per host. Lines above the limit are
boilerplate and are removed from the text; a document that keeps too few of its words is
rejected, as is one that fails the base rules on its own text.

Each step is a column of its own, so that no lambda evaluates an array more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import Stored, packed, same_row

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), f"{SPACE}+", " "), "[0-9]", "0"))


def with_repeated_words(rows: DataFrame, window: int = 8) -> DataFrame:
    """Adds n_repeat_words: words of ``words`` in windows found twice or more, the first one included.

    Hashes of windows are sorted only in texts that repeat one; equal neighbours mark
    their places, and a marked place covers up to ``window`` words before the next.
    """
    last = F.size("words") - (window - 1)
    hashes = F.when(last > 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, window))))
    rows = rows.withColumn("hashes", hashes)
    ordered = F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("ordered", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), ordered)).drop("hashes")
    beside = lambda j: F.get(F.col("ordered"), j).h
    marked = F.transform(
        "ordered", lambda s, j: F.when(beside(j - 1).eqNullSafe(s.h) | beside(j + 1).eqNullSafe(s.h), s.i)
    )
    rows = rows.withColumn("places", F.array_sort(F.array_compact(marked))).drop("ordered")
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(
        "places",
        start,
        lambda a, i: F.struct(i.alias("last"), (a.n + F.least(F.lit(window), i - a.last)).cast("bigint").alias("n")),
        lambda a: a.n,
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("places")


def base_counts(rows: DataFrame) -> DataFrame:
    """row_id, row_copy, row_text, host, row with the counts on the text itself."""
    with_word = F.filter(F.split("row_text", "\n"), lambda line: line.rlike(WORD))
    rows = rows.withColumn("words", words_of(F.col("row_text"))).withColumn("lines", with_word)
    counted = with_repeated_words(rows)
    return counted.select(
        "row_id",
        "row_copy",
        "row_text",
        "host",
        "row",
        F.size("words").cast("bigint").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.regexp_count("row_text", F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
    )


def text_lines(rows: DataFrame) -> DataFrame:
    """(host, line, row_id, row_copy): each distinct normalised line of a text, hashed."""
    lines = F.transform(F.filter(F.split("row_text", "\n"), lambda line: line.rlike(WORD)), lambda line: F.xxhash64(normal_line(line)))
    return rows.select("host", F.explode(lines).alias("line"), "row_id", "row_copy").distinct()


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines whose normalised form has one of the hashes; the other lines are as they were."""
    own = F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(hashes, F.xxhash64(normal_line(line))))
    return F.when(hashes.isNull(), text).otherwise(F.array_join(own, "\n"))


def judge_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = 10,
    max_per_mille: int | None = None,
    min_words: int = 20,
    min_kept_percent: int = 50,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """Each row of ``docs`` as (row, clean_text, base counts, base_failed, removed_share, kept).

    A line is removed where more than ``max_docs`` documents of the host have it, however
    many documents the host has; ``clean_text`` is the text without such lines. A caller
    may ask for more than ``max_per_mille`` thousandths of the host's documents too. A
    document is kept if it passes the base rules (``min_words``, ``max_repeat_percent``)
    and its clean text holds ``min_kept_percent`` of its words or more. Null texts are
    empty, have no words and fail; null hosts are one host; equal
    rows count as one document and share the verdict; null ids are one id whose texts
    are told apart; an empty table gives an empty result. Other columns, whatever their
    names, come back in ``row``.
    """
    rows = packed(docs, id_col, text_col).withColumn("host", F.col("row")[host_col].cast("string"))
    base = base_counts(rows)
    lines = Stored(text_lines(rows), "lines").df  # counted and judged: read twice, and joined by plain shuffles
    frequent = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > max_docs)
    if max_per_mille is not None:
        sizes = rows.select("host", "row_id", "row_copy").distinct().groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("host_docs"))
        of_host = F.col("docs") * 1000 > F.col("host_docs") * max_per_mille
        frequent = frequent.join(sizes, F.col("host").eqNullSafe(F.col("of"))).filter(of_host)
    above = frequent.select(F.col("host").alias("above_host"), F.col("line").alias("above_line"))
    marked = lines.join(above, (lines.line == F.col("above_line")) & lines.host.eqNullSafe(F.col("above_host")))
    gone = marked.groupBy("row_id", "row_copy", "host").agg(F.collect_set("above_line").alias("gone"))  # of rows that lose a line
    same = same_row(base, gone) & base.host.eqNullSafe(gone.host)
    joined = base.join(gone, same, "left").select(*[base[c] for c in base.columns if c not in ("row_id", "row_copy", "host")], "gone")
    cleaned = joined.withColumn("clean_text", without_lines(F.col("row_text"), F.col("gone")))
    left = F.when(F.col("gone").isNull(), F.col("n_words")).otherwise(F.size(words_of(F.col("clean_text"))).cast("bigint"))
    cleaned = cleaned.withColumn("left", left)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    enough = (F.col("n_words") > 0) & (F.col("left") * 100 >= F.col("n_words") * min_kept_percent)
    return cleaned.select(
        "row", "clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.coalesce((F.col("n_words") - F.col("left")) / F.nullif(F.col("n_words"), F.lit(0)), F.lit(0.0)).alias("removed_share"),
        (~failed & enough).alias("kept"),
    )
