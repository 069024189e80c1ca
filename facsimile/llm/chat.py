"""Tool-call linking in chats, in DataFrame and SQL functions only.

Calls and results are hash-joined by conversation and identifier, ordered so that a call
comes after every call whose result its arguments refer to, checked against the schemas
of the tools, and written as canonical JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import Stored

REFERENCE = "$ref"  # {"$ref": "<call id>"} as an argument's value stands for that call's result
TYPES = {"BIGINT": "integer", "BOOLEAN": "boolean", "STRING": "string", "VOID": "null", "DOUBLE": "number", "FLOAT": "number"}


def json_type(variant: Column) -> Column:
    """The JSON name of a variant value's type."""
    found = F.regexp_extract(F.schema_of_variant(variant), "^[A-Z]+", 0)
    named = F.when(found == "OBJECT", "object").when(found == "ARRAY", "array").when(found == "DECIMAL", "number")
    for spark_type, name in TYPES.items():
        named = named.when(found == spark_type, name)
    return named.otherwise(F.lower(found))


def first_calls(calls: DataFrame) -> DataFrame:
    """One row per conversation and call id: the first in (turn, position), with the number of calls of that id."""
    order = F.struct("turn", "position", "name", "arguments")
    known = calls.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    first = known.groupBy("conv_id", "call_id").agg(F.min(order).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    return first.select("conv_id", "call_id", "c.*", "n_calls")


def first_results(results: DataFrame) -> DataFrame:
    known = results.filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    first = known.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    return first.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"), "n_results")


def arguments_of(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, name, argument, found, needs): a row per argument of calls whose arguments are a JSON object."""
    objects = calls.filter(F.schema_of_variant("parsed").startswith("OBJECT<")).select("conv_id", "call_id", "name", "parsed")
    exploded = objects.sparkSession.sql(
        "SELECT conv_id, call_id, name, e.key AS argument, e.value AS value FROM {calls}, LATERAL variant_explode(parsed) AS e", calls=objects
    )
    needs = F.try_variant_get("value", f"$['{REFERENCE}']", "string")
    return exploded.select("conv_id", "call_id", "name", "argument", json_type(F.col("value")).alias("found"), needs.alias("needs"))


def violations(arguments: DataFrame, calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, problems): sorted texts like ``missing:limit``; calls without problems have no row.

    ``schemas`` has (name, argument, type, required), a row per argument a tool takes, and
    a row with a null argument for a tool that takes none.
    """
    tools = schemas.groupBy("name").agg(F.max(F.lit(True)).alias("known"))
    takes = schemas.filter(F.col("argument").isNotNull()).groupBy("name", "argument").agg(
        F.min("type").alias("type"), F.max("required").alias("required")
    )
    given = arguments.join(takes, ["name", "argument"], "left")
    fits = (F.col("found") == F.col("type")) | ((F.col("type") == "number") & (F.col("found") == "integer")) | F.col("needs").isNotNull()
    wrong = given.select(
        "conv_id",
        "call_id",
        F.when(F.col("type").isNull(), F.concat(F.lit("unknown:"), "argument"))
        .when(~fits, F.concat(F.lit("type:"), "argument"))
        .alias("problem"),
    )
    wanted = calls.select("conv_id", "call_id", "name").join(takes.filter("required").select("name", "argument"), "name")
    missing = wanted.join(arguments.select("conv_id", "call_id", "argument"), ["conv_id", "call_id", "argument"], "left_anti").select(
        "conv_id", "call_id", F.concat(F.lit("missing:"), "argument").alias("problem")
    )
    shape = calls.join(tools, "name", "left").select(
        "conv_id",
        "call_id",
        F.when(F.col("known").isNull(), "tool")
        .when(F.col("parsed").isNull() | ~F.schema_of_variant("parsed").startswith("OBJECT<"), "json")
        .alias("problem"),
    )
    known_tool = missing.unionByName(wrong).unionByName(shape).filter("problem IS NOT NULL")
    return known_tool.groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("problem")).alias("problems"))


def _followed(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, needs, steps): chains of calls with one reference each, followed to the first call of another kind.

    Pointers double in each round, so rounds grow with the logarithm of the longest
    chain. Calls in or behind a cycle of such calls never arrive and are left out.
    """
    links = Stored(single.withColumn("steps", F.lit(1).cast("bigint")), "tool-chain").df
    reach, longest = 1, links.count()
    while reach <= longest:
        ahead = links.select("conv_id", F.col("call_id").alias("needs"), F.col("needs").alias("then"), F.col("steps").alias("more"))
        joined = links.join(ahead, ["conv_id", "needs"], "left")
        links = Stored(
            joined.select(
                "conv_id", "call_id", F.coalesce("then", "needs").alias("needs"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")
            ),
            "tool-chain",
        ).df
        reach *= 2
        if links.join(single.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi").isEmpty():
            break
    return links.join(single.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_anti")


def depths(calls: DataFrame, arguments: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): 0 without references, else one more than the deepest call referred to.

    References to ids that no call has are left out. Calls with one reference are
    followed by pointer doubling. The others are settled in rounds, each settling the
    calls all of whose references are settled, as many rounds as such calls stand in a row. Calls in or
    behind a cycle are never settled and have no row.
    """
    key = ["conv_id", "call_id"]
    links = arguments.filter("needs IS NOT NULL").select("conv_id", "call_id", "needs").distinct()
    ids = calls.select("conv_id", F.col("call_id").alias("needs"))
    edges = Stored(links.join(ids, ["conv_id", "needs"], "left_semi"), "tool-edges").df
    several = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key)
    single = Stored(edges.join(several, key, "left_anti"), "tool-single").df
    followed = Stored(_followed(single), "tool-chain").df
    roots = calls.select(*key).join(edges, key, "left_anti")
    settled = fresh = Stored(roots.select(*key, F.lit(0).cast("bigint").alias("depth")), "tool-depth").df
    ends = followed.select("conv_id", F.col("call_id").alias("needs"), F.col("needs").alias("end"), F.col("steps").alias("more"))
    forks = edges.join(several, key, "left_semi").join(ends, ["conv_id", "needs"], "left")
    waiting = forks.select(*key, F.coalesce("end", "needs").alias("needs"), F.coalesce("more", F.lit(0)).alias("steps"), F.lit(None).cast("bigint").alias("depth"))
    while not fresh.isEmpty() and not several.isEmpty():
        done = fresh.select("conv_id", F.col("call_id").alias("needs"), F.col("depth").alias("now"))
        waiting = Stored(
            waiting.join(done, ["conv_id", "needs"], "left").select(*key, "needs", "steps", F.coalesce("depth", "now").alias("depth")), "tool-wait"
        ).df
        ready = waiting.groupBy(*key).agg(
            F.count(F.lit(1)).alias("n"), F.count("depth").alias("k"), (F.max(F.col("depth") + F.col("steps")) + 1).alias("depth")
        )
        fresh = Stored(ready.filter("n = k").select(*key, "depth"), "tool-depth").df
        waiting = waiting.join(fresh.select(*key), key, "left_anti")
        settled = Stored(settled.unionByName(fresh), "tool-depth").df
    ended = settled.select("conv_id", F.col("call_id").alias("needs"), "depth")
    chained = followed.join(ended, ["conv_id", "needs"]).select(*key, (F.col("depth") + F.col("steps")).alias("depth"))
    return settled.unionByName(chained)


def link_tools(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row per call, and per result without a call: its place in the order, problems and canonical JSON.

    ``calls`` has (conv_id, turn, position, call_id, name, arguments), ``results``
    (conv_id, turn, call_id, content). Of calls or results with the same id the first
    counts (``n_calls``, ``n_results`` tell how many there were). ``status`` is ``linked``,
    ``open`` (no result) or ``orphan`` (no call). Sorting a conversation by (depth, turn,
    position, call_id) is a topological order; ``depth`` is null in cycles and for
    orphans. ``json`` has sorted keys, no white space and no null fields. Rows with a
    null conversation or id cannot be linked and are left out; null or malformed
    arguments are the problem ``json``; unknown tools are the problem ``tool``; empty
    tables are no special case; further columns are ignored.
    """
    first = first_calls(calls).withColumn("parsed", F.try_parse_json("arguments"))
    first = Stored(first.withColumn("canonical", F.to_json("parsed")).drop("parsed"), "tool-calls").df
    first = first.withColumn("parsed", F.try_parse_json("canonical"))
    arguments = Stored(arguments_of(first), "tool-arguments").df
    problems = violations(arguments, first, schemas)
    ordered = depths(first, arguments)
    key = ["conv_id", "call_id"]
    linked = first.drop("parsed").join(first_results(results).hint("shuffle_hash"), key, "full_outer")
    linked = linked.join(problems, key, "left").join(ordered, key, "left")
    called, answered = F.col("n_calls").isNotNull(), F.col("n_results").isNotNull()
    body = F.to_json(
        F.struct(
            F.try_parse_json("canonical").alias("arguments"), "depth", F.col("call_id").alias("id"), "name", "result", F.col("turn").alias("turn")
        )
    )
    return linked.select(
        "conv_id", "call_id", "turn", "position", "name", "depth",
        F.when(called & answered, "linked").when(called, "open").otherwise("orphan").alias("status"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.when(called, F.coalesce("problems", F.array().cast("array<string>"))).alias("problems"),
        body.alias("json"),
    )
