"""Literal arrays and binary search in them, as SQL text.

Expressions generated for many columns are built as text: one call to the JVM
per expression instead of one per operator.
"""

from __future__ import annotations

import json
import math
from typing import Any, Sequence

LITERAL_LIMIT = 1000  # entries of a lookup array that may live inside a plan


def sql_string(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_sql(values: Sequence[Any], element_ddl: str) -> str:
    """An array literal as one node of the plan, folded to a constant by the optimizer.

    ``array(lit, lit, …)`` with a thousand entries would make every analysis and
    optimizer pass walk a thousand nodes per column.
    """
    return f"from_json({sql_string(json.dumps(list(values)))}, {sql_string(f'array<{element_ddl}>')})"


def doubles_sql(values: Sequence[float]) -> str:
    plain = [float(v) for v in values]
    if not all(math.isfinite(v) for v in plain):
        raise ValueError("lookup arrays hold finite numbers only")
    return array_sql(plain, "double")


def longs_sql(values: Sequence[int]) -> str:
    return array_sql([int(v) for v in values], "bigint")


def count_at_most_sql(points: str, size: int, value: str) -> str:
    """How many of the sorted ``points`` are <= ``value``: log2(size) steps."""
    if size == 0:
        return "0"
    steps = ", ".join(str(1 << b) for b in range(size.bit_length() - 1, -1, -1))
    return (
        f"aggregate(array({steps}), 0, (found, step) -> "
        f"if(get({points}, found + step - 1) <= {value}, found + step, found))"
    )
