"""End to end: flatten, fit, sample, unflatten.

Lists and maps have a long form beside the flat table. The first places of a list are
columns of the flat table; the items beyond are an exploded table (row, place, item),
learnt band by band of places by a synthesizer of their own, so items may be nested in
turn. A map's entries are an exploded table too (see :mod:`facsimile.operators.entries`).
What is drawn in long form is regrouped by row.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.draws import make_draws
from facsimile.functions.nested import column, quoted
from facsimile.operators.entries import MapModel, entries_of, fit_map, is_map, sample_maps
from facsimile.operators.flatten import FlatField, flat_fields, flatten
from facsimile.operators.model import Model, fit
from facsimile.operators.sample import numbered_rows, sample_rows
from facsimile.operators.unflatten import unflatten
from facsimile.plans.shape import ENTRIES, LENGTH, TAIL, Plan, infer_plan
from facsimile.session import settle, snapshot

DEFAULT_OUTPUT_ROWS = 1000
LIST_COLUMNS = 64  # places of a list that are columns
BAND_GROWTH = 4  # the first place of a band times this is the first of the next
ROW = "._row"


@dataclass
class Tails:
    """The items of one place's lists from ``head`` on: a synthesizer per band of places, (first place, model)."""

    names: list[str]
    width: int
    bands: list[tuple[int, Synthesizer]]


@dataclass
class Maps:
    """The maps of one place, under their flat names."""

    names: list[str]
    model: MapModel


def _by_place(fields: list[FlatField]) -> dict[str, list[FlatField]]:
    out: dict[str, list[FlatField]] = {}
    for f in fields:
        out.setdefault(f.place, []).append(f)
    return out


class Synthesizer:
    """A plan and a model that belong together. Reading either before ``fit`` is an error.

    ``list_columns`` places of each list depend on the other columns of their row; the
    items beyond are drawn by their place alone, in any number.
    """

    def __init__(self, list_columns: int = LIST_COLUMNS, **fit_options):
        self.list_columns, self.fit_options = list_columns, fit_options
        self._plan: Plan | None = None
        self._model: Model | None = None
        self.tails: list[Tails] = []
        self.maps: list[Maps] = []

    @property
    def plan(self) -> Plan:
        if self._plan is None:
            raise RuntimeError("call fit before reading the plan")
        return self._plan

    @property
    def model(self) -> Model:
        if self._model is None:
            raise RuntimeError("call fit before reading the model")
        return self._model

    def fit(self, df: DataFrame, keep_nested: tuple[str, ...] = (), path: str | None = None) -> Synthesizer:
        plan = infer_plan(df, keep_nested=keep_nested, deep=True, head=self.list_columns)
        fields = flat_fields(plan, lengths=True)
        tails = _by_place([f for f in fields if f.name.endswith(TAIL)])
        maps = _by_place([f for f in fields if is_map(f.dtype)])
        flat = snapshot(flatten(df, plan, lengths=True))
        apart = {f.name for group in (*tails.values(), *maps.values()) for f in group}
        present = {f.name: f.present for f in fields if f.present is not None and f.name not in apart}
        present |= {f.name + ENTRIES: f.present for group in maps.values() for f in group if f.present is not None}
        sizes = [F.size(column(f.name)).alias(f.name + ENTRIES) for group in maps.values() for f in group]
        plain = flat.select(*[column(f.name) for f in fields if f.name not in apart], *sizes)
        self._model = fit(plain, present=present, path=path, **self.fit_options)
        self._plan = plan
        self.maps = [self._fit_maps(flat, group) for group in maps.values()]
        found = [self._fit_tails(flat, plan.columns(place), group) for place, group in tails.items()]
        self.tails = [t for t in found if t.bands]
        lost = [s["column"] for s in self._model.columns if s["kind"] == "carried" and s["nulls"] < s["rows"]]
        if lost:
            warnings.warn(f"no values are made for {', '.join(lost)}: they are null in a sample", stacklevel=2)
        if path:
            self._save_parts(df.sparkSession, path)
        return self

    def _fit_maps(self, flat: DataFrame, group: list[FlatField]) -> Maps:
        entries = entries_of(flat, [quoted(f.name) for f in group])
        return Maps([f.name for f in group], fit_map(entries, group[0].dtype, self.fit_options.get("exact", False)))

    def _fit_tails(self, flat: DataFrame, first: int, group: list[FlatField]) -> Tails:
        placed = [f"transform({quoted(f.name)}, (x, i) -> named_struct('place', i + {first}, 'item', x))" for f in group]
        lists = [f"coalesce({p}, array())" for p in placed]
        items = settle(flat.selectExpr(f"inline(concat({', '.join(lists)}))"), "items")
        # Lists within the columns of other lists may be shorter than the longest of their place.
        width = (items.agg(F.max("place")).first()[0] or 0) + 1
        bands = []
        while first < width:
            band = items.filter((F.col("place") >= first) & (F.col("place") < BAND_GROWTH * first)).select("item")
            bands.append((first, Synthesizer(self.list_columns, **self.fit_options).fit(band)))
            first *= BAND_GROWTH
        return Tails([f.name.removesuffix(TAIL) for f in group], width, bands)

    def _save_parts(self, spark: SparkSession, path: str) -> None:
        self.plan.save(spark, f"{path}/plan")
        facts = {
            "list_columns": self.list_columns,
            "maps": [m.names for m in self.maps],
            "tails": [{"names": t.names, "width": t.width, "firsts": [first for first, _ in t.bands]} for t in self.tails],
        }
        spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").json(f"{path}/parts")
        for i, m in enumerate(self.maps):
            m.model.save(f"{path}/maps/{i}")
        for i, t in enumerate(self.tails):
            for first, maker in t.bands:
                maker.model.save(f"{path}/tails/{i}/{first}")
                maker._save_parts(spark, f"{path}/tails/{i}/{first}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Synthesizer:
        """The plan and model that ``fit(…, path=path)`` stored."""
        facts = json.loads(spark.read.schema("facts string").json(f"{path}/parts").first()["facts"])
        maker = cls(facts["list_columns"])
        maker._plan, maker._model = Plan.load(spark, f"{path}/plan"), Model.load(spark, path)
        maker.maps = [Maps(names, MapModel.load(spark, f"{path}/maps/{i}")) for i, names in enumerate(facts["maps"])]
        maker.tails = [
            Tails(t["names"], t["width"], [(first, cls.load(spark, f"{path}/tails/{i}/{first}")) for first in t["firsts"]])
            for i, t in enumerate(facts["tails"])
        ]
        return maker

    def sample(self, n: int, seed: int = 0, rng: str = "hash") -> DataFrame:
        if n <= 0:
            raise ValueError("the number of rows must be positive")
        return self.sample_rows(numbered_rows(self.model.spark, n), seed, rng).drop(ROW)

    def sample_rows(self, rows: DataFrame, seed: int = 0, rng: str = "hash") -> DataFrame:
        """A synthetic row for each value of ``rows.row`` (a bigint, each value once), which comes first as ``._row``."""
        flat = sample_rows(self.model, rows, seed, rng, keep_row=True, row_name=ROW)
        drawn = flat
        for number, (name, m) in enumerate((name, m) for m in self.maps for name in m.names):
            drawn = self._with_maps(drawn, flat, name, m.model, make_draws(rng, seed), len(self.model.columns) + number)
        for t in self.tails:
            drawn = self._with_tails(drawn, flat, t, seed, rng)
        return unflatten(drawn, self.plan, arrays="length", carry=(ROW,))

    def _with_maps(self, drawn: DataFrame, flat: DataFrame, name: str, model: MapModel, draws, offset: int) -> DataFrame:
        sizes = flat.select(column(ROW).alias("row"), column(name + ENTRIES).cast("int").alias("size"))
        made = sample_maps(model, sizes, draws, offset).select(F.col("row").alias(ROW), F.col("made").alias(name))
        empty = F.when(column(name + ENTRIES).isNotNull(), F.create_map().cast(model.map_type))
        kept = [column(c) for c in drawn.columns if c != name + ENTRIES]
        return drawn.join(made, ROW, "left").select(*kept, F.coalesce(column(name), empty).alias(name))

    def _with_tails(self, drawn: DataFrame, flat: DataFrame, tails: Tails, seed: int, rng: str) -> DataFrame:
        """Adds the items beyond the columns; items are numbered by row, list and place, so any task draws the same."""
        first, lists, width = tails.bands[0][0], len(tails.names), tails.width
        named = [F.struct(F.lit(i).alias("list"), column(n + LENGTH).cast("int").alias("size")) for i, n in enumerate(tails.names)]
        sized = flat.select(column(ROW).alias("row"), F.explode(F.array(*named)).alias("of")).filter(F.col("of.size") > first)
        number = F.col("row") * lists + F.col("of.list")
        places = sized.select(number.alias("number"), F.explode(F.sequence(F.lit(first), F.col("of.size") - 1)).alias("place"))
        keys = places.select((F.col("number") * width + F.col("place")).alias("row"), "place")
        items = None
        for i, (low, maker) in enumerate(tails.bands):
            mine = keys.filter((F.col("place") >= low) & (F.col("place") < BAND_GROWTH * low)).select("row")
            made = maker.sample_rows(mine, seed + 1 + i, rng).select(column(ROW).alias("key"), "item")
            items = made if items is None else items.unionByName(made)
        entry = F.struct((F.col("key") % width).alias("place"), "item")
        one = items.groupBy(F.expr(f"key div {width}").alias("number")).agg(F.collect_list(entry).alias("items"))
        ordered = F.array_sort("items", lambda a, b: (a["place"] - b["place"]).cast("int"))
        one = one.select("number", F.transform(ordered, lambda e: e["item"]).alias("items"))
        wide = one.groupBy(F.expr(f"number div {lists}").alias(ROW)).agg(
            *[F.first(F.when(F.col("number") % lists == i, F.col("items")), ignorenulls=True).alias(n + TAIL) for i, n in enumerate(tails.names)]
        )
        return drawn.join(wide, ROW, "left")


def synthesize(
    df: DataFrame,
    n: int = DEFAULT_OUTPUT_ROWS,
    seed: int = 0,
    marginal: str = "ecdf",
    independent: bool = False,
    keep_nested: tuple[str, ...] = (),
    overrides: dict[str, str] | None = None,
    path: str | None = None,
    missing: str = "patterns",
) -> DataFrame:
    """``n`` synthetic rows with the schema of ``df`` and similar statistics."""
    if n <= 0:
        raise ValueError("the number of rows must be positive")
    maker = Synthesizer(marginal=marginal, independent=independent, overrides=overrides, missing=missing)
    return maker.fit(df, keep_nested, path).sample(n, seed)


def conform_sample(flat: DataFrame, schema: T.StructType, widen: bool = False, on_failure: str = "null") -> DataFrame:
    """Bring a sampled table to the fitted flat schema: order, types, missing columns as nulls.

    Values that do not cast become null, or with ``on_failure="string"`` turn
    their column into text. ``widen`` makes integer and decimal columns double
    where nulls occur. Both options look at the data in one aggregate.
    """
    if on_failure not in ("null", "string"):
        raise ValueError("on_failure must be 'null' or 'string'")
    types = {f.name: f.dataType for f in flat.schema.fields}
    exact = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
    checks = {}
    for i, f in enumerate(schema.fields):
        if f.name not in types:
            continue
        c = column(f.name)
        if on_failure == "string" and types[f.name] != f.dataType:
            checks[f"fail{i}"] = F.bool_or(c.isNotNull() & c.try_cast(f.dataType).isNull())
        if widen and isinstance(f.dataType, exact):
            checks[f"null{i}"] = F.bool_or(c.isNull())
    found = flat.agg(*[v.alias(k) for k, v in checks.items()]).first().asDict() if checks else {}
    chosen = []
    for i, f in enumerate(schema.fields):
        if f.name not in types:
            value = F.lit(None).cast(f.dataType)
        elif found.get(f"fail{i}"):
            value = column(f.name).cast("string")
        elif found.get(f"null{i}"):
            value = column(f.name).try_cast("double")
        elif types[f.name] == f.dataType:
            value = column(f.name)
        else:
            value = column(f.name).try_cast(f.dataType)
        chosen.append(value.alias(f.name))
    return flat.select(*chosen)

