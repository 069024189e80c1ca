"""Look-alike text: only character classes and lengths are taken over, never characters."""

from __future__ import annotations

from facsimile.functions.search import sql_string

CAPITAL, OTHER_LETTER, DIGIT = r"\p{Lu}", r"[^\P{L}A]", r"\p{Nd}"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
HEX = "0123456789abcdef"
HEX_AS_LETTERS = "etaoinshrdlucmfw"  # stands in for hex digits in invented words
STRIDE = 1_000_003  # distance of the draw streams of two positions in one text


def shape_sql(c: str) -> str:
    """Capitals become ``A``, other letters ``a``, digits ``9``; the rest stays."""
    shape = f"regexp_replace({c}, {sql_string(CAPITAL)}, 'A')"
    shape = f"regexp_replace({shape}, {sql_string(OTHER_LETTER)}, 'a')"
    return f"regexp_replace({shape}, {sql_string(DIGIT)}, '9')"


def fill_shape_sql(shape: str, row: str, draws, stream: int) -> str:
    """A text of the given shape; every letter and digit is drawn anew."""
    u = draws.uniform_of_key_sql("key", f"(bigint(i) * {STRIDE}L + {stream}L)")

    def pick(alphabet: str) -> str:
        return f"substring('{alphabet}', 1 + int(floor({u} * {len(alphabet)}D)), 1)"

    one = f"CASE ch WHEN 'A' THEN {pick(UPPER)} WHEN 'a' THEN {pick(LOWER)} WHEN '9' THEN {pick(DIGITS)} ELSE ch END"
    filled = f"array_join(transform(split({shape}, ''), (ch, i) -> {one}), '')"
    return f"transform(array({draws.key_sql(row)}), key -> {filled})[0]"  # the row's part of the draws once, not per letter


def numbered_shape_sql(shape: str, row: str) -> str:
    """A text of the given shape that differs for every row number.

    The number is written from the right into the letter and digit places, each
    place with its own radix; what does not fit is appended after a dash.
    """

    def digit(alphabet: str) -> str:
        size = len(alphabet)
        return (
            f"named_struct('rest', state.rest div {size}L, "
            f"'text', concat(substring('{alphabet}', int(state.rest % {size}L) + 1, 1), state.text))"
        )

    place = (
        f"CASE ch WHEN 'A' THEN {digit(UPPER)} WHEN 'a' THEN {digit(LOWER)} WHEN '9' THEN {digit(DIGITS)} "
        "ELSE named_struct('rest', state.rest, 'text', concat(ch, state.text)) END"
    )
    return (
        f"aggregate(reverse(split({shape}, '')), named_struct('rest', bigint({row}), 'text', ''), (state, ch) -> {place}, "
        "state -> if(state.rest = 0, state.text, concat(state.text, '-', string(state.rest))))"
    )


def invented_digits_sql(row: str, position: str, length: str, stream: int, seed: int) -> str:
    """A word of ``length`` hex digits made from a hash of its place."""
    key = f"concat_ws(':', string({row}), string({position}), '{stream}:{seed}')"
    return f"substring(repeat(md5({key}), int(ceil({length} / 32))), 1, int({length}))"


def letters_sql(digits: str) -> str:
    """Hex digits as letters; blanks between words stay."""
    return f"translate({digits}, '{HEX}', '{HEX_AS_LETTERS}')"


def invented_word_sql(row: str, position: str, length: str, stream: int, seed: int) -> str:
    """A word of ``length`` letters made from a hash of its place."""
    return letters_sql(invented_digits_sql(row, position, length, stream, seed))
