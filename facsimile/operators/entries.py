"""Maps: the sizes are a column of the flat table; here are the keys and the values of each key.

Entries are one long table (size, key, value), whatever the maps' sizes, so a map of many
different keys widens nothing. Keys have frequencies for each size, of larger sizes for
each doubling. A map of n entries takes the keys at n evenly spaced points of the cumulated
frequencies, from a random start: each key comes as often as it was learnt, and no key
twice. Values are learnt key by key and joined to the drawn keys.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.epoch import as_number_sql, from_number
from facsimile.functions.text import fill_shape_sql, shape_sql
from facsimile.operators.frequencies import Frequencies
from facsimile.operators.kinds import detect_kinds, to_digits_sql
from facsimile.operators.lookup import lookup_join
from facsimile.operators.model import SKETCH_SIZE, ranked_grid, type_of
from facsimile.operators.sample import STREAMS, VALUE
from facsimile.session import settle

KEY_KNOTS = 101  # of a key's values
SINGLE_SIZES = 8  # sizes with key frequencies of their own
PLACE_STRIDE = 7919 * STREAMS  # distance of the draw streams of two entries of one map
KEY, EMPTY, LETTERS = 5, 6, 7  # draw streams beside VALUE


def is_map(dtype: T.DataType) -> bool:
    """Whether it is a map with a marginal for its keys and for its values."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.BinaryType, T.NullType)
    return isinstance(dtype, T.MapType) and not isinstance(dtype.keyType, nested) and not isinstance(dtype.valueType, nested)


@dataclass
class MapModel:
    """``keys`` by size; ``values`` a row per key with its share of nulls and, for numbers, its grid; ``texts`` of each key or their shapes."""

    map_type: T.MapType
    keys: Frequencies
    value: dict[str, Any]
    values: DataFrame
    texts: Frequencies | None

    def save(self, path: str) -> None:
        facts = json.dumps({"type": self.map_type.jsonValue(), "value": self.value, "texts": self.texts is not None})
        self.values.sparkSession.createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("overwrite").json(f"{path}/facts")
        self.keys.save(f"{path}/keys")
        self.values.write.mode("overwrite").parquet(f"{path}/values")
        if self.texts is not None:
            self.texts.save(f"{path}/texts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MapModel:
        facts = json.loads(spark.read.schema("facts string").json(f"{path}/facts").first()["facts"])
        texts = Frequencies.load(spark, f"{path}/texts") if facts["texts"] else None
        return cls(
            T.MapType.fromJson(facts["type"]), Frequencies.load(spark, f"{path}/keys"), facts["value"], spark.read.parquet(f"{path}/values"), texts
        )


def size_label(size: str) -> str:
    """SQL: the group of sizes that share their key frequencies; sizes to ``SINGLE_SIZES``, then doublings."""
    return f"if({size} <= {SINGLE_SIZES}, string({size}), concat('2^', int(ceil(log2({size})))))"


def entries_of(table: DataFrame, maps: list[str]) -> DataFrame:
    """(size, key, value): the entries of all the maps, keys as text."""
    listed = [f"coalesce(transform(map_entries({m}), e -> named_struct('size', size({m}), 'key', string(e.key), 'value', e.value)), array())" for m in maps]
    return table.selectExpr(f"inline(concat({', '.join(listed)}))")


def fit_map(entries: DataFrame, map_type: T.MapType, exact: bool = False) -> MapModel:
    """Learn ``entries(size, key, value)`` of maps for which ``is_map`` holds.

    Numbers and times get a quantile grid per key, all others the frequencies of their
    values per key: of the values themselves where they are categories, else of their
    shapes (see :mod:`facsimile.functions.text`). ``exact`` as in :func:`fit`.
    """
    entries = settle(entries, "entries")
    keys = Frequencies.learn(entries.select(F.expr(size_label("size")).alias("label"), F.col("key").alias("text")))
    found = detect_kinds(entries.select("value"), exact=exact).first().asDict()
    spec = {"kind": found["kind"], "digits": found["digits"], "type_json": json.dumps(T.StructType([T.StructField("v", map_type.valueType)]).jsonValue())}
    text = isinstance(map_type.valueType, T.StringType)
    shares = entries.groupBy("key").agg((F.count_if(F.col("value").isNull()) / F.count(F.lit(1))).alias("empty"))
    if spec["kind"] in ("numeric", "datetime") or spec["kind"] == "id" and not text:
        number = as_number_sql("value", map_type.valueType)
        filled = entries.select(F.col("key").alias("column"), F.expr(number).cast("double").alias("value")).filter("value IS NOT NULL")
        if exact:
            grid = ranked_grid(settle(filled.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")), "values"), KEY_KNOTS)
        else:
            ranks = ", ".join(f"{i / (KEY_KNOTS - 1)!r}D" for i in range(KEY_KNOTS))
            sketch = filled.groupBy("column").agg(F.expr(f"kll_sketch_agg_double(value, {SKETCH_SIZE})").alias("sketch"))
            grid = sketch.selectExpr("column", f"kll_sketch_get_quantile_double(sketch, array({ranks})) AS knots")
        smooth = F.expr("size(array_distinct(knots)) > size(knots) div 2")
        shares = shares.join(grid.select(F.col("column").alias("key"), "knots", smooth.alias("smooth")), "key", "left")
        return MapModel(map_type, keys, spec, settle(shares, "map-values"), None)
    shape = shape_sql("value") if text and spec["kind"] in ("id", "text") else "string(value)"
    texts = Frequencies.learn(entries.selectExpr("key AS label", f"{shape} AS text"))
    return MapModel(map_type, keys, spec, settle(shares, "map-values"), texts)


def _drawn_values(model: MapModel, drawn: DataFrame, draws, offset: int) -> DataFrame:
    """Adds ``value`` to (row, place, key)."""
    dtype = type_of(model.value)

    def uniform(purpose: int) -> str:
        return draws.uniform_sql("row", f"(bigint(place) * {PLACE_STRIDE}L + {offset * STREAMS + purpose}L)")

    known = lookup_join(drawn, model.values, "key", ["row", "place"])
    there = F.expr(f"{uniform(EMPTY)} >= empty")
    if model.texts is None:
        last = KEY_KNOTS - 1
        at = known.withColumn("at", F.expr(f"if(smooth, {uniform(VALUE)} * {last}D, {uniform(VALUE)} * {KEY_KNOTS}D)"))
        at = at.withColumn("i", F.expr(f"int(least(floor(at), if(smooth, {last - 1}, {last})))"))
        number = "get(knots, i) + if(smooth, (at - i) * (get(knots, i + 1) - get(knots, i)), 0D)"
        if model.value["digits"] is not None:
            number = to_digits_sql(f"({number})", model.value["digits"])
        return at.select("row", "place", "key", F.when(there, from_number(F.expr(number), dtype)).cast(dtype).alias("value"))
    found = model.texts.draw(known.withColumn("label", F.col("key")), uniform(VALUE))
    made = "text"
    if model.value["kind"] in ("id", "text") and isinstance(dtype, T.StringType):
        made = fill_shape_sql("text", "row", draws, f"bigint(place) * {PLACE_STRIDE}L + {offset * STREAMS + LETTERS}")
    return found.select("row", "place", "key", F.when(there, F.expr(made)).cast(dtype).alias("value"))


def sample_maps(model: MapModel, sizes: DataFrame, draws, offset: int) -> DataFrame:
    """(row, made): a map of ``size`` entries for each row of ``sizes(row, size)``; none for rows of size 0.

    ``offset`` tells the draws of several maps of one row apart.
    """
    start = draws.uniform_sql("row", f"{offset * STREAMS + KEY}L")
    sized = sizes.filter("size > 0").withColumn("label", F.expr(size_label("size")))
    places = sized.select("row", "size", "label", F.expr("explode(sequence(0, size - 1))").alias("place"))
    drawn = model.keys.draw(places, f"((double(place) + {start}) / double(size))").select("row", "place", F.col("text").alias("key"))
    listed = _drawn_values(model, drawn, draws, offset).groupBy("row").agg(F.collect_list(F.struct("place", "key", "value")).alias("entries"))
    # A key that is wider than the step is met by neighbouring points; a size never learnt has no keys.
    fresh = F.expr("filter(array_sort(entries, (a, b) -> a.place - b.place), e -> e.key IS NOT NULL)")
    key_type = model.map_type.keyType
    pairs = F.transform("entries", lambda e: F.struct(e["key"].cast(key_type).alias("key"), e["value"].alias("value")))
    first_of_key = F.expr("filter(entries, (e, i) -> i = 0 OR e.key <> get(entries, i - 1).key)")
    return listed.withColumn("entries", fresh).withColumn("entries", first_of_key).select("row", F.map_from_entries(pairs).alias("made"))
