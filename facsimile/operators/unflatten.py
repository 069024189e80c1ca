"""Flat columns back to the nesting a plan describes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.nested import column, nullable, quoted, reproject
from facsimile.functions.search import sql_string
from facsimile.plans.shape import INDEX_STYLES, ITEM, LENGTH, NULL_FLAG, TAIL, Plan

ARRAY_MODES = ("compact", "pad", "length")


def unflatten(
    flat: DataFrame,
    plan: Plan | None,
    arrays: str = "compact",
    index_style: str = "__i",
    null_structs: str = "keep",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Inverse of :func:`facsimile.operators.flatten.flatten`.

    ``arrays``: ``compact`` drops null elements unless the plan allows them and
    gives a null array where the flag says so; ``pad`` always gives
    ``max_elements`` items; ``length`` cuts by ``a._len`` and is an exact inverse. Items
    in ``a._tail`` follow, except with ``pad``.
    ``null_structs="expand"`` ignores struct flags (a null struct comes back as
    a struct of nulls). Columns named in ``carry`` come first, as they are.
    """
    if plan is None or not plan.schema.fields:
        raise ValueError("unflatten needs a plan: call infer_plan first or load a saved one")
    if arrays not in ARRAY_MODES:
        raise ValueError(f"arrays must be one of {ARRAY_MODES}")
    if null_structs not in ("keep", "expand"):
        raise ValueError("null_structs must be 'keep' or 'expand'")
    types = {f.name: f.dataType for f in flat.schema.fields}
    indexed = INDEX_STYLES[index_style]

    def known(name: str, place: str, dtype: T.DataType) -> bool:
        if name in types or name + NULL_FLAG in types:
            return True
        branch = plan.branches(place, dtype)
        if isinstance(branch, T.StructType):
            return any(known(f"{name}.{f.name}", f"{place}.{f.name}", f.dataType) for f in branch.fields)
        if isinstance(branch, T.ArrayType):
            items = (indexed.format(base=name, i=i) for i in range(plan.columns(place)))
            return any(known(n, f"{place}.{ITEM}", branch.elementType) for n in items)
        return False

    def flagged(name: str, value: str) -> str:
        return f"if({quoted(name + NULL_FLAG)}, NULL, {value})" if name + NULL_FLAG in types else value

    def build(name: str, place: str, dtype: T.DataType) -> str:
        branch = plan.branches(place, dtype)
        if branch is None:
            return leaf(name, dtype)
        if isinstance(branch, T.ArrayType):
            return build_array(name, place, branch)
        parts = [f"{sql_string(f.name)}, {build(f'{name}.{f.name}', f'{place}.{f.name}', f.dataType)}" for f in branch.fields]
        value = f"named_struct({', '.join(parts)})"
        return value if null_structs == "expand" else flagged(name, value)

    def build_array(name: str, place: str, dtype: T.ArrayType) -> str:
        extent, below, element = plan.extent(place), f"{place}.{ITEM}", dtype.elementType
        names = [indexed.format(base=name, i=i) for i in range(plan.columns(place))]
        if arrays == "compact":
            names = [n for n in names if known(n, below, element)]
        items = [build_item(n, below, element) if plan.deep else leaf(n, element) for n in names]
        value = f"array({', '.join(items)})"
        if arrays == "pad":
            return value
        if arrays == "length":
            if name + LENGTH in types:
                value = f"slice({value}, 1, greatest(least(int({quoted(name + LENGTH)}), {len(names)}), 0))"
        elif not extent.null_items:
            value = f"filter({value}, x -> x IS NOT NULL)"
        if name + TAIL in types:
            value = f"concat({value}, coalesce({tail(name, dtype)}, array()))"
        return flagged(name, value)

    def tail(name: str, dtype: T.ArrayType) -> str:
        if nullable(types[name + TAIL]) != nullable(dtype):
            reshaped[name + TAIL] = reproject(column(name + TAIL), types[name + TAIL], dtype)
        return quoted(name + TAIL)

    def build_item(name: str, place: str, dtype: T.DataType) -> str:
        value = build(name, place, dtype)
        if arrays != "compact" or not isinstance(plan.branches(place, dtype), T.StructType) or name + NULL_FLAG in types:
            return value
        # No flag and no length: an element of which nothing is set is a missing one.
        parts = [f"{quoted(n)} IS NOT NULL" for n in types if n.startswith(f"{name}.") and not n.endswith(NULL_FLAG)]
        return f"if({' OR '.join(parts) or 'false'}, {value}, NULL)"

    def leaf(name: str, dtype: T.DataType) -> str:
        if name not in types:
            return "NULL"
        if nullable(types[name]) != nullable(dtype):
            reshaped[name] = reproject(column(name), types[name], dtype)
        return quoted(name)

    reshaped: dict[str, Column] = {}
    texts = {c.name: build(c.name, c.name, c.dataType) for c in plan.schema.fields}
    ready = flat.withColumns(reshaped) if reshaped else flat
    return ready.select(*map(column, carry), *[F.expr(texts[c.name]).cast(nullable(c.dataType)).alias(c.name) for c in plan.schema.fields])
