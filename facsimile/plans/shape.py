"""The flatten plan: a Spark schema, and what one aggregate measured at its nested places."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Iterable, Iterator, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.nested import column

INDEX_STYLES = {"__i": "{base}__{i}", "[i]": "{base}[{i}]"}
INDEX_SUFFIX = {"__i": re.compile(r"^(.+)__(\d+)$"), "[i]": re.compile(r"^(.+)\[(\d+)\]$")}
NULL_FLAG = "._is_null"
LENGTH = "._len"
TAIL = "._tail"  # the items of an array beyond the places that are columns
ENTRIES = "._entries"  # the size of a map
ITEM = "_item"  # stands for an array's element in a place such as ``items._item.price``


class Extent(NamedTuple):
    """Measured at a struct or an array: nulls at all, items at most, null items at all."""

    nulls: bool = False
    width: int = 0
    null_items: bool = False


def type_label(dtype: T.DataType) -> str:
    """Coarse kind of a scalar: int64, float64, bool, null or object."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int64"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "float64"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.NullType):
        return "null"
    return "object"


def places(schema: T.StructType, whole: Iterable[str] = ()) -> Iterator[tuple[str, T.DataType]]:
    """Every place of a schema with its type, parents first; nothing below the ``whole`` ones."""
    pending = [(f.name, f.dataType) for f in reversed(schema.fields)]
    stop = set(whole)
    while pending:
        place, dtype = pending.pop()
        yield place, dtype
        if place in stop:
            continue
        if isinstance(dtype, T.StructType):
            pending += [(f"{place}.{f.name}", f.dataType) for f in reversed(dtype.fields)]
        elif isinstance(dtype, T.ArrayType):
            pending.append((f"{place}.{ITEM}", dtype.elementType))


@dataclass
class Plan:
    """``whole`` places are carried as they are; ``deep`` plans flatten array elements too.

    ``head`` is how many places of an array are columns (None: all). The items beyond
    them stay together in one column, so that a long list widens nothing.
    """

    schema: T.StructType
    extents: dict[str, Extent] = field(default_factory=dict)
    whole: frozenset[str] = frozenset()
    deep: bool = False
    head: int | None = None

    def columns(self, place: str) -> int:
        """How many places of the array there are columns."""
        width = self.extent(place).width
        return width if self.head is None else min(width, self.head)

    def extent(self, place: str) -> Extent:
        return self.extents.get(place, Extent())

    def branches(self, place: str, dtype: T.DataType) -> T.DataType | None:
        """The type if the place is taken apart, None if it is a leaf."""
        return dtype if isinstance(dtype, (T.StructType, T.ArrayType)) and place not in self.whole else None

    def to_json(self) -> str:
        measured = {place: list(e) for place, e in self.extents.items()}
        return json.dumps({"schema": self.schema.jsonValue(), "extents": measured, "whole": sorted(self.whole), "deep": self.deep, "head": self.head})

    @classmethod
    def from_json(cls, text: str) -> "Plan":
        data = json.loads(text)
        extents = {place: Extent(*e) for place, e in data["extents"].items()}
        return cls(T.StructType.fromJson(data["schema"]), extents, frozenset(data["whole"]), data["deep"], data.get("head"))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "plan string").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Plan":
        rows = spark.read.schema("plan string").json(path).take(1)
        if not rows:
            raise ValueError(f"no flatten plan at {path}")
        return cls.from_json(rows[0]["plan"])

    def rows(self, spark: SparkSession) -> DataFrame:
        """The plan as a small table, one row per place."""
        out = []
        for place, dtype in places(self.schema, self.whole):
            e, branch = self.extent(place), self.branches(place, dtype)
            array = isinstance(branch, T.ArrayType)
            kind = "array" if array else "struct" if branch else "scalar"
            out.append((place, kind, type_label(dtype), e.width, e.nulls and array, e.null_items, e.nulls and not array))
        return spark.createDataFrame(
            out,
            "path string, kind string, label string, max_elements int, nullable_array boolean, "
            "nullable_elements boolean, nullable_struct boolean",
        )


def _field_of_each(values: Column, name: str) -> Column:
    return F.transform(values, lambda x: x.getField(name))


def _measures(place: str, dtype: T.DataType, value: Column, inside: bool, whole: frozenset[str]) -> Iterator[tuple[str, str, Column]]:
    """(place, measure, value) of all nested places; inside arrays ``value`` holds all values at the place."""
    if place in whole or not isinstance(dtype, (T.StructType, T.ArrayType)):
        return
    yield place, "nulls", F.exists(value, lambda x: x.isNull()) if inside else value.isNull()
    if isinstance(dtype, T.StructType):
        for f in dtype.fields:
            child = _field_of_each(value, f.name) if inside else value.getField(f.name)
            yield from _measures(f"{place}.{f.name}", f.dataType, child, inside, whole)
    else:
        yield place, "width", F.array_max(F.transform(value, F.array_size)) if inside else F.array_size(value)
        items = F.flatten(F.filter(value, lambda x: x.isNotNull())) if inside else value
        yield place, "null_items", F.exists(items, lambda x: x.isNull())
        yield from _measures(f"{place}.{ITEM}", dtype.elementType, items, True, whole)


def infer_plan(df: DataFrame, keep_nested: Iterable[str] = (), deep: bool = False, head: int | None = None) -> Plan:
    """Shape of ``df``: types from the schema, widths and null flags from one aggregate.

    ``keep_nested`` names columns (dotted paths) carried whole. With ``deep``
    the elements of arrays are flattened too, not only structs. ``head`` limits how
    many places of an array become columns.
    """
    if head is not None and head < 1:
        raise ValueError("head must be at least 1")
    whole = frozenset(keep_nested)
    asked = [m for f in df.schema.fields for m in _measures(f.name, f.dataType, column(f.name), False, whole)]
    found = df.agg(*[F.max(value).alias(f"m{i}") for i, (_, _, value) in enumerate(asked)]).first() if asked else []
    extents: dict[str, Extent] = {}
    for (place, measure, _), value in zip(asked, found):
        known = int(value or 0) if measure == "width" else bool(value)
        extents[place] = extents.get(place, Extent())._replace(**{measure: known})
    return Plan(df.schema, extents, whole, deep, head)


def array_groups(names: Iterable[str], index_style: str = "__i") -> dict[str, list[str]]:
    """The columns of each array among flat names, in index order."""
    found = [(m[1], int(m[2]), name) for name in names if (m := INDEX_SUFFIX[index_style].match(name))]
    groups: dict[str, list[str]] = {}
    for base, _, name in sorted(found, key=lambda entry: entry[:2]):
        groups.setdefault(base, []).append(name)
    return groups


def _steps(name: str, index_style: str) -> tuple[str | int, ...]:
    """A flat name as keys (text) and indexes (numbers): ``a.v__0.x`` is a, v, 0, x."""
    out: list[str | int] = []
    for part in name.split("."):
        indexes = []
        while found := INDEX_SUFFIX[index_style].match(part):
            part, index = found.groups()
            indexes.insert(0, int(index))
        out += [part, *indexes]
    return tuple(out)


def plan_from_names(schema: T.StructType, index_style: str = "__i") -> Plan:
    """A plan for flat data that came without one: dots make structs, indexes arrays, at any depth."""
    extents: dict[str, Extent] = {}
    flags = {_steps(n[: -len(NULL_FLAG)], index_style) for n in schema.names if n.endswith(NULL_FLAG)}
    leaves = {
        _steps(f.name, index_style): f.dataType for f in schema.fields if not f.name.endswith((NULL_FLAG, LENGTH))
    }

    def typed(place: str, below: dict[tuple, T.DataType], nulls: set[tuple]) -> T.DataType:
        """The type of a place from the names below it; ``nulls`` holds the flags at and below it."""
        if () in below:
            return below[()]
        firsts = list(dict.fromkeys(steps[0] for steps in below))
        parts = {k: {s[1:]: t for s, t in below.items() if s[0] == k} for k in firsts}
        marks = {k: {s[1:] for s in nulls if s and s[0] == k} for k in firsts}
        if all(isinstance(k, int) for k in firsts):
            merged: dict[tuple, T.DataType] = {}
            for part in parts.values():
                merged |= part
            extents[place] = Extent(() in nulls, max(firsts) + 1)
            return T.ArrayType(typed(f"{place}.{ITEM}", merged, set().union(*marks.values())))
        if place:
            extents[place] = Extent(() in nulls)
        return T.StructType([T.StructField(str(k), typed(f"{place}.{k}" if place else k, parts[k], marks[k])) for k in firsts])

    root = typed("", leaves, flags) if leaves else T.StructType()
    deep = any(isinstance(k, int) for steps in leaves for k in steps[:-1])
    return Plan(root, extents, frozenset(), deep)
