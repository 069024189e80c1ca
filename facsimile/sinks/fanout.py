"""Writing one result to several sinks, with a status for each and for the whole."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.session import settle

STATUS_DDL = "sink string, status string, reason string, error string, details string"
SUCCESS, SKIPPED, FAILED = "success", "skipped", "failed"


def overall_status(statuses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``ok``, ``partial_success`` or ``error`` (every sink failed), per group."""
    counts = statuses.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("sinks"),
        F.count_if(F.col("status") == SUCCESS).alias("succeeded"),
        F.count_if(F.col("status") == SKIPPED).alias("skipped"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
    )
    message = F.when(F.col("failed") == 0, "ok").when(F.col("failed") == F.col("sinks"), "error").otherwise("partial_success")
    return counts.withColumn("message", message)


def write_all(df: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame] | None]) -> DataFrame:
    """Write ``df`` to every sink and report per sink.

    A sink is a function from the rows to its report; ``None`` stands for one that
    is not configured. One failing sink does not stop the others. The rows are
    computed once and stored, so that all sinks get the same.
    """
    if not any(sinks.values()):
        raise ValueError("no sink is configured")
    rows = settle(df, "fanout")
    out = []
    for name, write in sinks.items():
        if write is None:
            out.append((name, SKIPPED, "not_configured", None, None))
            continue
        try:
            report = write(rows).select(F.to_json(F.struct("*")).alias("r")).first()
            out.append((name, SUCCESS, None, None, report["r"] if report else None))
        except Exception as e:
            out.append((name, FAILED, "upload_failed", str(e), None))
    return df.sparkSession.createDataFrame(out, STATUS_DDL)
