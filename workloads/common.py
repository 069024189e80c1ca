"""Shared inputs of the registered queries, and SQL pieces of their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.functions.draws import PowerDraws


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def millionths(c: Column) -> Column:
    """A number as whole millionths, so that engines agree on the last digit."""
    return F.floor(c * F.lit(1e6) + F.lit(0.5)).cast("long")


def millionths_sql(x: str) -> str:
    return f"CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)"


# Orders with a list of records made from the row itself: null lists (key % 7 = 0),
# empty lists (key % 6 = 0) and null elements (first place, key % 11 = 0).
NESTED_ITEM = "struct<line:int,part:bigint,price:double>"


def order_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    count = (key % 6).cast("int")

    def item(i: Column) -> Column:
        made = F.struct(
            i.cast("int").alias("line"),
            ((F.col("o_custkey") + key * i) % 1000).alias("part"),
            (F.col("o_totalprice") * i).alias("price"),
        )
        return F.when((i == 1) & (key % 11 == 0), F.lit(None)).otherwise(made)

    items = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), item)).otherwise(
        F.array().cast(f"array<{NESTED_ITEM}>")
    )
    tags = F.when(key % 5 != 0, F.split("o_orderpriority", "[- ]"))
    return orders.select(
        "o_orderkey",
        F.struct("o_orderstatus", F.col("o_totalprice").alias("total"), tags.alias("tags")).alias("head"),
        F.when(key % 7 != 0, items).alias("items"),
    )


ORDER_ITEMS_SQL = """
SELECT o_orderkey, i,
       (o_orderkey % 7 = 0) AS null_list,
       CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 6 END AS n,
       (o_orderkey % 7 <> 0 AND i <= o_orderkey % 6 AND NOT (i = 1 AND o_orderkey % 11 = 0)) AS filled,
       (o_custkey + o_orderkey * i) % 1000 AS part, o_totalprice * i AS price
FROM orders, range(1, 6) AS r(i)
"""


def customer_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.struct(F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name")).alias("region")).alias("nation")
    )
    joined = customer.join(place, customer.c_nationkey == place.n_nationkey)
    return joined.select(
        "c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 13 != 0, F.col("nation")).alias("nation")
    )


CUSTOMER_NESTED_SQL = """
SELECT c_custkey, c_acctbal, c_custkey % 13 = 0 AS absent, n_name, r_name
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def page_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses taken apart: path segments and query parameters as lists."""
    url = F.col("url")
    query = F.regexp_extract(url, r"\?(.*)$", 1)
    params = F.transform(
        F.filter(F.split(query, "&"), lambda p: F.length(p) > 0),
        lambda p: F.struct(
            F.split(p, "=")[0].alias("key"), F.get(F.split(p, "="), F.lit(1)).alias("value")
        ),
    )
    path = F.regexp_extract(url, r"^\w+://[^/]*/([^?]*)", 1)
    return read(spark, sf_dir, "pages").select(
        "page_id",
        F.struct(
            F.regexp_extract(url, r"^\w+://([^/]*)", 1).alias("host"),
            F.split(path, "/").alias("segments"),
            F.when(F.size(params) > 0, params).alias("params"),
        ).alias("address"),
    )


def draws_sql(source: str, row: str, streams: dict[str, str | int], keep: str = "", seed: int = 0) -> str:
    """A sub-select over ``source`` with one uniform draw per entry of ``streams``."""
    p, a, b = PowerDraws.PRIME, PowerDraws.ROW_FACTOR, PowerDraws.STREAM_FACTOR
    kept = f"{keep}, " if keep else ""
    names = list(streams)
    level = f"SELECT {kept}({row} * {a} + {seed}) % {p} AS x, {', '.join(f'{s} AS s_{n}' for n, s in streams.items())} FROM {source}"
    level = f"SELECT *, (x * x) % {p} AS x2 FROM ({level})"
    level = f"SELECT *, (((x2 * x2) % {p}) * x) % {p} AS x5 FROM ({level})"
    level = f"SELECT *, {', '.join(f'(x5 + s_{n} * {b}) % {p} AS y_{n}' for n in names)} FROM ({level})"
    level = f"SELECT *, {', '.join(f'(y_{n} * y_{n}) % {p} AS q_{n}' for n in names)} FROM ({level})"
    drawn = ", ".join(f"(((((q_{n} * q_{n}) % {p}) * y_{n}) % {p})::DOUBLE + 0.5) / {p}.0::DOUBLE AS {n}" for n in names)
    return f"(SELECT {kept}{drawn} FROM ({level}))"
