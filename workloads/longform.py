"""Bytes, maps and long lists in samples, draw by draw."""

from __future__ import annotations

from pyspark.sql import functions as F

from facsimile.operators.entries import EMPTY, KEY, KEY_KNOTS, PLACE_STRIDE
from facsimile.operators.model import fit
from facsimile.operators.sample import MISSING, STREAMS, TEXT, VALUE, sample_rows
from facsimile.operators.synthesize import BAND_GROWTH, ROW, Synthesizer
from workloads.common import draws_sql, millionths, millionths_sql, read
from workloads.model import knots_sql

KNOTS = 1001
LONGEST, HEAD = 20_000, 20


def sample_binary(spark, sf_dir):
    """Addresses as bytes: their lengths, and every byte by the frequency of its value."""
    raw = F.when(F.col("page_id") % 6 != 0, F.col("url").cast("binary")).alias("raw")
    pages = read(spark, sf_dir, "pages").select(raw)
    out = sample_rows(fit(pages, exact=True), spark.range(pages.count()).selectExpr("id AS row"), rng="power", keep_row=True)
    return out.select("row", F.hex("raw").alias("raw_hex"), F.octet_length("raw").cast("long").alias("length"))


def sample_map(spark, sf_dir):
    """Maps of one to three numbers, some of them null, and null maps."""
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    tax = F.when(F.col("l_linenumber") != 4, F.col("l_tax"))
    entries = [
        F.array(entry("quantity", F.col("l_quantity"))),
        F.when(F.col("l_linenumber") % 2 == 0, F.array(entry("tax", tax))).otherwise(F.array()),
        F.when(F.col("l_returnflag") == "R", F.array(entry("price", F.col("l_extendedprice")))).otherwise(F.array()),
    ]
    lines = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.map_from_entries(F.concat(*entries))).alias("facts"))
    maker = Synthesizer(exact=True, independent=True).fit(lines)
    made = maker.sample_rows(spark.range(lines.count()).selectExpr("id AS row"), rng="power")
    values = [millionths(F.col("facts")[k]).alias(f"{k}_e6") for k in ("quantity", "tax", "price")]
    has = F.array_join(F.array_sort(F.map_keys("facts")), ",").alias("keys")
    return made.select(F.col(f"`{ROW}`").alias("row"), has, *values)


def synthesize_long_lists(spark, sf_dir):
    """One list of 20,000 items next to short ones: lengths, and the items beyond the columns."""
    key = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders")
    size = F.when(key == orders.agg(F.min("o_orderkey")).first()[0], LONGEST).otherwise(key % 40).cast("int")
    item = lambda p: ((key + p) % 20 + 100 * F.length(F.bin(p))).cast("int")
    lists = orders.select(F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda p: item(p - 1))).otherwise(F.array().cast("array<int>")).alias("items"))
    maker = Synthesizer(list_columns=HEAD, exact=True, independent=True).fit(lists)
    made = maker.sample_rows(spark.range(orders.count()).selectExpr("id AS row"), rng="power")
    tail = F.aggregate(F.slice("items", HEAD + 1, LONGEST), F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select(F.col(f"`{ROW}`").alias("row"), F.size("items").cast("long").alias("length"), tail.alias("tail_sum"))


QUERIES = {f.__name__: f for f in (sample_binary, sample_map, synthesize_long_lists)}


# --- checks -------------------------------------------------------------------------


def _rows(table: str) -> str:
    return f"(SELECT unnest(range(count(*))) AS row FROM {table})"


def _grid(name: str, column: str, table: str, knots: int = KNOTS) -> str:
    """A common table of one row: the knots, and whether values between them are drawn."""
    return f"{name} AS (SELECT array_agg(value ORDER BY i) AS g, count(DISTINCT value) > {knots // 2} AS smooth FROM ({knots_sql(column, table, knots)}))"


def _at(u: str, knots: int = KNOTS) -> str:
    """The value at ``u`` of the grid ``g``."""
    last = knots - 1
    low = f"least(floor({u} * {last}.0::DOUBLE), {last - 1})::BIGINT"
    between = f"g[{low} + 1] + ({u} * {last}.0::DOUBLE - {low}) * (g[{low} + 2] - g[{low} + 1])"
    return f"CASE WHEN smooth THEN {between} ELSE g[least(floor({u} * {knots}.0::DOUBLE), {last})::BIGINT + 1] END"


ADDRESSES = "(SELECT url, strlen(url) AS w FROM pages WHERE page_id % 6 <> 0)"
SIZE_DRAWS = draws_sql(_rows("pages"), "row", {"u": VALUE, "m": MISSING}, "row")
BYTE_DRAWS = draws_sql("places", "row", {"u": f"(i * {STREAMS * 1009} + {TEXT})"}, "row, i")

LINES = """(SELECT *, CASE WHEN l_linenumber <> 3 THEN 1 + (l_linenumber % 2 = 0)::INT + (l_returnflag = 'R')::INT END AS size FROM lineitem)"""
ENTRIES = f"""
    SELECT size, 'quantity' AS key, l_quantity AS value FROM {LINES} WHERE size IS NOT NULL
    UNION ALL SELECT size, 'tax', CASE WHEN l_linenumber <> 4 THEN l_tax END FROM {LINES} WHERE size IS NOT NULL AND l_linenumber % 2 = 0
    UNION ALL SELECT size, 'price', l_extendedprice FROM {LINES} WHERE size IS NOT NULL AND l_returnflag = 'R'"""
MAP_DRAWS = draws_sql(_rows("lineitem"), "row", {"u": VALUE, "m": MISSING, "s": STREAMS + KEY}, "row")
ENTRY_DRAWS = draws_sql(
    "keyed", "row", {"u": f"(place * {PLACE_STRIDE} + {STREAMS + VALUE})", "e": f"(place * {PLACE_STRIDE} + {STREAMS + EMPTY})"}, "row, place, key"
)
MAP_KEYS = ("quantity", "tax", "price")

LISTS = f"(SELECT o_orderkey AS k, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN {LONGEST} ELSE o_orderkey % 40 END AS n FROM orders)"
LIST_DRAWS = draws_sql(_rows("orders"), "row", {"u": VALUE}, "row")
FIRSTS = [HEAD * BAND_GROWTH**b for b in range(20) if HEAD * BAND_GROWTH**b < LONGEST]


def _band_sql(b: int, first: int) -> str:
    """The drawn items of one band."""
    mine = f"(SELECT row, row * {LONGEST} + place AS k FROM places WHERE place >= {first} AND place < {BAND_GROWTH * first})"
    drawn = draws_sql(mine, "k", {"u": VALUE}, "row, k", seed=1 + b)
    return f"SELECT row, round({_at('u')})::BIGINT AS item FROM {drawn}, g{b}"


ORACLES = {
    "sample_binary": f"""
        WITH {_grid("grid", "w", ADDRESSES)},
        sizes AS (SELECT row, round({_at("u")})::INTEGER AS n FROM {SIZE_DRAWS}, grid
                  WHERE m >= (SELECT count_if(page_id % 6 = 0)::DOUBLE / count(*) FROM pages)),
        places AS (SELECT row, unnest(range(1, n + 1)) AS i FROM sizes),
        bytes AS (SELECT b, count(*) AS c FROM (SELECT substr(h, p * 2 + 1, 2) AS b
                  FROM (SELECT h, unnest(range(length(h) // 2)) AS p FROM (SELECT hex(url) AS h FROM {ADDRESSES}))) GROUP BY b),
        ends AS (SELECT b, c, sum(c) OVER (ORDER BY c DESC, b) AS hi, sum(c) OVER () AS total FROM bytes),
        drawn AS (SELECT row, i, least(floor(u * total), total - 1)::BIGINT AS p FROM {BYTE_DRAWS}, (SELECT any_value(total) AS total FROM ends)),
        made AS (SELECT row, string_agg(b, '' ORDER BY i) AS h, count(*) AS n FROM drawn JOIN ends ON hi - c <= p AND p < hi GROUP BY row)
        SELECT r.row, h AS raw_hex, n AS length FROM {_rows("pages")} r LEFT JOIN made ON made.row = r.row""",
    "sample_map": f"""
        WITH entries AS ({ENTRIES}),
        {_grid("grid", "size", f"(SELECT size FROM {LINES} WHERE size IS NOT NULL)")},
        {", ".join(_grid(f"g_{k}", "value", f"(SELECT value FROM entries WHERE key = '{k}' AND value IS NOT NULL)", KEY_KNOTS) for k in MAP_KEYS)},
        shares AS (SELECT key, count_if(value IS NULL)::DOUBLE / count(*) AS empty FROM entries GROUP BY key),
        sizes AS (SELECT row, s, round({_at("u")})::INTEGER AS size FROM {MAP_DRAWS}, grid
                  WHERE m >= (SELECT count_if(size IS NULL)::DOUBLE / count(*) FROM {LINES})),
        freq AS (SELECT size, key, count(*) AS c FROM entries GROUP BY size, key),
        ends AS (SELECT *, sum(c) OVER (PARTITION BY size ORDER BY c DESC, key) AS hi, sum(c) OVER (PARTITION BY size) AS total FROM freq),
        points AS (SELECT row, size, unnest(range(size)) AS place, s FROM sizes),
        placed AS (SELECT p.row, place, key FROM points p JOIN ends e ON e.size = p.size
                   AND hi - c <= least(floor((place + s) / p.size::DOUBLE * total), total - 1) AND least(floor((place + s) / p.size::DOUBLE * total), total - 1) < hi),
        keyed AS (SELECT row, key, min(place) AS place FROM placed GROUP BY row, key),
        drawn AS (SELECT d.row, d.key, u, e >= empty AS there FROM {ENTRY_DRAWS} d JOIN shares ON shares.key = d.key),
        valued AS ({" UNION ALL ".join(f"SELECT row, key, CASE WHEN there THEN round_even(({_at('u', KEY_KNOTS)}) * 1e2, 0) / 1e2 END AS value FROM drawn, g_{k} WHERE key = '{k}'" for k in MAP_KEYS)}),
        wide AS (SELECT row, string_agg(key, ',' ORDER BY key) AS keys, {", ".join(f"max(value) FILTER (key = '{k}') AS {k}" for k in MAP_KEYS)} FROM valued GROUP BY row)
        SELECT r.row, keys, {", ".join(f"{millionths_sql(k)} AS {k}_e6" for k in MAP_KEYS)}
        FROM {_rows("lineitem")} r LEFT JOIN wide ON wide.row = r.row""",
    "synthesize_long_lists": f"""
        WITH {_grid("grid", "n", LISTS)},
        items AS (SELECT p AS place, (k + p) % 20 + 100 * length(bin(p)) AS item FROM (SELECT k, unnest(range({HEAD}, n)) AS p FROM {LISTS})),
        {", ".join(_grid(f"g{b}", "item", f"(SELECT item FROM items WHERE place >= {f} AND place < {BAND_GROWTH * f})") for b, f in enumerate(FIRSTS))},
        sizes AS (SELECT row, round({_at("u")})::BIGINT AS n FROM {LIST_DRAWS}, grid),
        places AS (SELECT row, unnest(range({HEAD}, n)) AS place FROM sizes),
        drawn AS ({" UNION ALL ".join(_band_sql(b, f) for b, f in enumerate(FIRSTS))})
        SELECT s.row, n AS length, coalesce(sum(item), 0)::BIGINT AS tail_sum FROM sizes s LEFT JOIN drawn d ON d.row = s.row GROUP BY s.row, n""",
}
