"""Ranks without one task seeing all rows: running totals, and the first rows of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facsimile.functions.nested import TIME_FORMATS, column, quoted
from facsimile.functions.search import count_at_most_sql, sql_string
from facsimile.session import settle

SLOT_ROWS = 100_000
MAX_SLOTS = 4096
OVERSAMPLE = 16  # sampled keys per split point; evens out the slices
ROW_BITS = 33  # of the numbers that Spark gives the rows of a partition


def _key_sql(df: DataFrame, order_by: list[str]) -> tuple[str, str]:
    """The ordering key as a struct, and its type."""
    names = [f"k{i}" for i in range(len(order_by))]
    text = "named_struct(" + ", ".join(f"'{n}', {quoted(c)}" for c, n in zip(order_by, names)) + ")"
    fields = df.select(*[column(c) for c in order_by]).schema
    return text, "struct<" + ",".join(f"{n}:{f.dataType.simpleString()}" for n, f in zip(names, fields)) + ">"


def _keys_sql(keys: list[str], ddl: str) -> str:
    """Keys as one literal; they come as JSON, which holds every digit of numbers and times."""
    formats = ", ".join(f"{sql_string(k)}, {sql_string(v)}" for k, v in TIME_FORMATS.items())
    return f"from_json({sql_string('[' + ','.join(keys) + ']')}, {sql_string(f'array<{ddl}>')}, map({formats}))"


def _split_points(keys: DataFrame, wanted: int, rows: int) -> list[str]:
    """At most ``wanted`` keys that cut ``keys(key)`` into about equal slices, in order.

    A sample by hash, the same whenever it is taken: about ``OVERSAMPLE`` keys per point,
    each key once, are sorted and every so many of them taken.
    """
    uniform = F.shiftrightunsigned(F.xxhash64("key"), 11) / F.lit(float(1 << 53))
    some = keys.filter(uniform < wanted * OVERSAMPLE / rows).distinct().orderBy("key")
    sample = [r[0] for r in some.select(F.to_json("key", TIME_FORMATS)).collect()]  # about MAX_SLOTS * OVERSAMPLE keys
    wanted = min(wanted, len(sample))
    return [sample[(i + 1) * len(sample) // (wanted + 1)] for i in range(wanted)]


def slot_column(df: DataFrame, order_by: list[str], rows: int, slot_rows: int = SLOT_ROWS) -> Column:
    """Number of the slice of the ordering a row falls in; slices are about equal.

    The split points are the same whenever they are taken, so a recomputed task lands
    rows in the same slices. ``df`` must hold each ordering key once.
    """
    wanted = min(MAX_SLOTS, rows // slot_rows)
    if wanted == 0:
        return F.lit(0)
    text, ddl = _key_sql(df, order_by)
    points = _split_points(df.select(F.expr(text).alias("key")), wanted, rows)
    return F.expr(f"coalesce({count_at_most_sql(_keys_sql(points, ddl), len(points), text)}, 0)")  # never null: joins need no filter


def first_by(df: DataFrame, limit: int, order_by: list[str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """The first ``limit`` rows by ``order_by``: rows up to a threshold key, found by counting.

    Each pass counts the rows of up to ``MAX_SLOTS`` slices and goes on in the slice that
    holds the last row wanted, until that one is small. No row is sorted or moved. Of rows
    with the threshold's key, any are taken that are still wanted.
    """
    text, ddl = _key_sql(df, order_by)
    part, before = df.select(F.expr(text).alias("key")), 0
    rows = part.count()
    if rows <= limit:
        return df
    while rows > slot_rows:
        points = _split_points(part, min(MAX_SLOTS, max(2, rows // slot_rows)), rows)
        if not points:
            break
        slot = F.expr(f"coalesce({count_at_most_sql(_keys_sql(points, ddl), len(points), 'key')}, 0)")
        counts = dict(part.groupBy(slot.alias("slot")).count().collect())  # a number per slice
        chosen = None
        for place in sorted(counts):
            chosen = place
            if before + counts[place] >= limit:
                break
            before += counts[place]
        same = counts[chosen] == rows
        part, rows = part.filter(slot == chosen), counts[chosen]
        if same:  # one key, or too few to be cut
            break
    counted = part.groupBy("key").count().orderBy("key").select(F.to_json("key", TIME_FORMATS), "count")
    for key, n in counted.toLocalIterator():  # of a small slice, or of a few frequent keys
        if before + n >= limit:
            break
        before += n
    last = f"{_keys_sql([key], ddl)}[0]"
    if before + n == limit:
        return df.filter(F.expr(f"{text} <= {last}"))
    return df.filter(F.expr(f"{text} < {last}")).unionByName(any_rows(df.filter(F.expr(f"{text} = {last}")), limit - before))


def any_rows(df: DataFrame, limit: int) -> DataFrame:
    """``limit`` rows, those of the first partitions, by the partitions' counts; no row is moved.

    Both passes must see the same partitions: a scan has them, anything that is shuffled
    is stored first.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = settle(df, "rows")
    counts = df.groupBy(F.spark_partition_id().alias("part")).count().orderBy("part").collect()  # a number per partition
    left = limit
    for part, n in counts:
        if left <= n:
            break
        left -= n
    else:
        return df
    number = F.monotonically_increasing_id()
    place, row = F.shiftright(number, ROW_BITS), number.bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    at, nth = column("._part"), column("._row")
    numbered = df.withColumns({"._part": place, "._row": row})
    return numbered.filter((at < part) | ((at == part) & (nth < left))).select(*[column(c) for c in df.columns])


def running_totals(
    df: DataFrame,
    groups: list[str],
    order_by: list[str],
    weight: str,
    rows: int | None = None,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Adds ``lo`` and ``hi``: the sum of ``weight`` before and up to each row.

    Totals run within ``groups`` in the order of ``order_by``, which must name
    each row once. The ordering is cut into slices; each slice is summed on its
    own and shifted by the total of the slices before it.
    """
    if rows is None:
        rows = df.count()
    key = [*groups, *order_by]
    sliced = df.withColumn("slot", slot_column(df, key, rows, slot_rows))
    inner = W.partitionBy(*groups, "slot").orderBy(*order_by).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = F.sum(weight).over(inner)
    if rows < slot_rows:
        out = sliced.withColumn("hi", local)
    else:
        before = W.partitionBy(*groups).orderBy("slot").rowsBetween(W.unboundedPreceding, -1) if groups else (
            W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
        )
        bases = (
            sliced.groupBy(*groups, "slot")
            .agg(F.sum(weight).alias("mass"))
            .select(*groups, "slot", F.coalesce(F.sum("mass").over(before), F.lit(0)).alias("base"))
        )
        out = sliced.join(bases, [*groups, "slot"]).withColumn("hi", F.col("base") + local).drop("base")
    return out.withColumn("lo", F.col("hi") - F.col(weight)).drop("slot")
