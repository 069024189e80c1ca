"""What operators answer in cases that have no rows to compare: refusals, defaults, carried columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile import Synthesizer, flatten, infer_plan, require_rows, sample, synthesize, unflatten, write_table
from facsimile.session import scratch_path
from facsimile.sinks.tables import TableWriteError
from facsimile.sources.tables import training_rows
from workloads.common import order_nested, read


def _refused(work) -> str:
    try:
        work()
    except TableWriteError as e:
        return e.operation
    except (ValueError, RuntimeError) as e:
        return str(e).split(":")[0]
    return "accepted"


def carried_rows(one: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """``rows``: how many rows have the same value of ``name``, nulls included, in both tables.

    Values are compared in the aggregate. As a filter the comparison would become a key of the
    join, which would then sort by whole lists of records.
    """
    both = one.select(key, name).join(other.select(key, F.col(name).alias("again")), key)
    return both.agg(F.count_if(F.col(name).eqNullSafe(F.col("again"))).alias("rows"))


def outcomes(spark, sf_dir):
    """(case, outcome, rows): the answer, and the rows of the table it was asked about."""
    customer = read(spark, sf_dir, "customer")
    nested = order_nested(spark, sf_dir)
    name, base = f"customer_{uuid.uuid4().hex}", scratch_path(spark, "warehouse")
    write_table(customer, "facsimile_demo", name, base)
    kept = infer_plan(nested, keep_nested=["items"], deep=True)
    whole = unflatten(flatten(nested, kept, lengths=True), kept, arrays="length")
    twice = training_rows(customer, customer.count(), ["c_custkey"])
    broken = customer.withColumn("c_name", F.array("c_name"))
    unread, gone = infer_plan(nested, deep=True), f"customer_{uuid.uuid4().hex}"
    nothing = nested.filter("o_orderkey < 0")
    empty_plan = infer_plan(nothing, deep=True)
    back = unflatten(flatten(nothing, empty_plan, lengths=True), empty_plan, arrays="length")
    later = unflatten(flatten(nothing, unread, lengths=True), unread, arrays="length")  # the plan of the full table
    failing = customer.withColumn("c_name", F.when(F.col("c_custkey") >= 0, F.raise_error(F.lit("stop"))).cast("string"))
    cases = {
        "empty table": f"{','.join(back.columns)} {back.count()}",
        "empty table, full plan": f"{later.schema.simpleString() == nested.schema.simpleString()} {later.count()}",
        "model before fit": _refused(lambda: Synthesizer().model),
        "plan before fit": _refused(lambda: Synthesizer().plan),
        "sample before fit": _refused(lambda: sample(None, 5)),
        "failed new table": _refused(lambda: write_table(failing, "facsimile_demo", gone, base)),
        "table after it": str(spark.catalog.tableExists(f"facsimile_demo.{gone}")),
        "rows after it": str(write_table(customer, "facsimile_demo", gone, base).first()["rows"] - customer.count()),
        "no rows to learn from": _refused(lambda: require_rows(customer.filter("c_custkey < 0"))),
        "no plan": _refused(lambda: unflatten(customer, None)),
        "no rows asked for": _refused(lambda: synthesize(customer, 0)),
        "incompatible table": _refused(lambda: write_table(broken, "facsimile_demo", name, base)),
        "rows by default": str(synthesize(read(spark, sf_dir, "nation")).count()),
        "training rows": str(twice.exceptAll(customer).count()),
        "after the refusal": str(spark.table(f"facsimile_demo.{name}").count() - customer.count()),
    }
    answers = spark.createDataFrame(list(cases.items()), "case string, outcome string").crossJoin(
        customer.agg(F.count(F.lit(1)).alias("rows"))
    )
    return answers.unionByName(
        carried_rows(nested, whole, "o_orderkey", "items").select(F.lit("carried whole").alias("case"), F.lit("equal").alias("outcome"), "rows")
    )


QUERIES = {"outcomes": outcomes}

ORACLES = {
    "outcomes": """
        SELECT c AS "case", o AS outcome, (SELECT count(*) FROM customer) AS rows
        FROM (VALUES ('empty table', 'o_orderkey,head,items 0'), ('empty table, full plan', 'True 0'),
                     ('model before fit', 'call fit before reading the model'), ('plan before fit', 'call fit before reading the plan'),
                     ('sample before fit', 'no fitted model; call fit first'), ('failed new table', 'write_data'),
                     ('table after it', 'False'), ('rows after it', '0'), ('no rows to learn from', 'no valid records loaded from source'), ('no plan', 'unflatten needs a plan'),
                     ('no rows asked for', 'the number of rows must be positive'), ('incompatible table', 'union_schema'),
                     ('rows by default', '1000'), ('training rows', '0'), ('after the refusal', '0')) AS v(c, o)
        UNION ALL SELECT 'carried whole', 'equal', count(*) FROM orders""",
}
