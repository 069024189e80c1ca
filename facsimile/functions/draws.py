"""Repeatable uniform draws keyed by row number and stream.

``rand(seed)`` depends on how rows are split into partitions, so a retried task
or another cluster size would change the sample. Both generators here are pure
functions of (row number, stream, seed).
"""

from __future__ import annotations

MANTISSA_BITS = 52


class HashDraws:
    """Uniform numbers in the open interval (0, 1) from a 64-bit hash."""

    def __init__(self, seed: int = 0):
        self.seed = int(seed)

    def key_sql(self, row: str) -> str:
        """What all draws of a row have in common."""
        return f"bigint({row})"

    def uniform_of_key_sql(self, key: str, stream: str | int) -> str:
        return self.uniform_sql(key, stream)

    def uniform_sql(self, row: str, stream: str | int) -> str:
        bits = f"(xxhash64({row}, bigint({stream}), bigint({self.seed})) & {(1 << MANTISSA_BITS) - 1}L)"
        return f"((double({bits}) + 0.5D) / {float(1 << MANTISSA_BITS)!r}D)"


class PowerDraws:
    """Uniform numbers from x^5 modulo a prime, in plain 64-bit arithmetic.

    The fifth power permutes the residues of the prime. Any SQL engine repeats
    this generator, which is what it is for. Row numbers count by their remainder, so
    numbers that are a multiple of the prime apart share their draws.
    """

    PRIME = 2147483647
    ROW_FACTOR = 1103515245
    STREAM_FACTOR = 48271

    def __init__(self, seed: int = 0):
        self.seed = int(seed)

    @classmethod
    def _fifth_power(cls, x: str) -> str:
        square = f"(({x}) * ({x}) % {cls.PRIME}L)"
        return f"(({square} * {square}) % {cls.PRIME}L * ({x}) % {cls.PRIME}L)"

    def key_sql(self, row: str) -> str:
        """What all draws of a row have in common."""
        return self._fifth_power(f"(bigint({row}) % {self.PRIME}L * {self.ROW_FACTOR}L + {self.seed}L) % {self.PRIME}L")

    def uniform_of_key_sql(self, key: str, stream: str | int) -> str:
        """The draw of a row by its ``key_sql``. Within a lambda nothing is shared, so a key that stands there is made in every step."""
        second = self._fifth_power(f"({key} + bigint({stream}) * {self.STREAM_FACTOR}L) % {self.PRIME}L")
        return f"((double({second}) + 0.5D) / {float(self.PRIME)!r}D)"

    def uniform_sql(self, row: str, stream: str | int) -> str:
        return self.uniform_of_key_sql(self.key_sql(row), stream)


def make_draws(kind: str, seed: int):
    if kind == "hash":
        return HashDraws(seed)
    if kind == "power":
        return PowerDraws(seed)
    raise ValueError(f"unknown generator {kind!r}; use 'hash' or 'power'")
