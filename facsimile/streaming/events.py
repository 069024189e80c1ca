"""Catalog change events: which ones ask for a new sample, and a stream that makes it."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from facsimile.operators.lookup import lookup_join
from facsimile.operators.synthesize import DEFAULT_OUTPUT_ROWS, synthesize
from facsimile.sources.naming import engine_table
from facsimile.session import settle
from facsimile.sources.tables import require_rows, training_rows

# Values of any JSON type come as variants: where a text is asked for, a number or an object is none.
EVENT_DDL = (
    "message variant, id variant, entityType variant, eventType variant, entityId variant, timestamp bigint, "
    "changeDescription struct<"
    "fieldsAdded:array<struct<name:variant,newValue:variant>>,"
    "fieldsUpdated:array<struct<name:variant,newValue:variant,oldValue:variant>>,"
    "fieldsDeleted:array<struct<name:variant,oldValue:variant>>>"
)
VALUE_DDL = "array<struct<name:variant,fullyQualifiedName:variant>>"

# Entity and event types, and the patterns of changed field names.
TABLE, CREATED, UPDATED = "table", "entityCreated", "entityUpdated"
COLUMNS = r"^columns$"
COLUMN_ATTRIBUTE = r"^columns\.(.+)\.([^\.]+)$"
COLUMN_TAGS = r"^columns\.(.+)\.tags$"

SUCCESS, FAILED = "success", "failed"
STATUS_DDL = "table_name string, status string, error string"
GENERATE, NO_ACTION, ECHO, REJECT, UNKNOWN_TABLE = "generate", "none", "echo", "reject", "unknown_table"


def _text(value: Column) -> Column:
    """The text of a variant, null if it is of another type."""
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))


def _texts(items: Column, *names: str) -> Column:
    return F.transform(items, lambda x: F.struct(*[_text(x[n]).alias(n) for n in names]))


def _plain(event: Column) -> Column:
    """A parsed event with texts in place of variants; a list with a field that is none stays a list."""
    change = event["changeDescription"]
    lists = {"fieldsAdded": ("name", "newValue"), "fieldsUpdated": ("name", "newValue", "oldValue"), "fieldsDeleted": ("name", "oldValue")}
    opened = [_texts(change[f], *names).alias(f) for f, names in lists.items()]
    return F.struct(
        *[_text(event[n]).alias(n) for n in ("message", "id", "entityType", "eventType", "entityId")],
        event["timestamp"].alias("timestamp"),
        F.when(change.isNotNull(), F.struct(*opened)).alias("changeDescription"),
    )


def _list(fields: Column) -> Column:
    return F.coalesce(fields, F.array())


def _complete(fields: Column, *attributes: str) -> Column:
    def whole(f: Column) -> Column:
        ok = f["name"].isNotNull()
        for a in attributes:
            ok = ok & f[a].isNotNull()
        return ok

    return F.coalesce(F.forall(fields, whole), F.lit(True))


def event_kind(event: Column) -> Column:
    """``created``, ``updated``, ``test`` or ``rejected`` for a parsed event."""
    change = event["changeDescription"]
    table_event = F.coalesce(
        (event["entityType"] == TABLE) & event["id"].isNotNull() & event["entityId"].isNotNull() & event["timestamp"].isNotNull(),
        F.lit(False),
    )
    well_formed = (
        change.isNotNull()
        & _complete(change["fieldsAdded"], "newValue")
        & _complete(change["fieldsUpdated"], "newValue", "oldValue")
        & _complete(change["fieldsDeleted"], "oldValue")
    )
    return (
        F.when(table_event & (event["eventType"] == CREATED), "created")
        .when(table_event & (event["eventType"] == UPDATED) & well_formed, "updated")
        .when(event["message"].isNotNull(), "test")
        .otherwise("rejected")
    )


def _opened(fields: Column, *attributes: str) -> Column:
    """The fields with their values parsed, once, as lists of columns (null if they are no list)."""

    def one(f: Column) -> Column:
        described = f["name"].rlike(COLUMNS)
        parsed = {a: F.from_json(F.when(described & f[a].rlike(r"^\s*\["), f[a]), VALUE_DDL) for a in attributes}
        lists = [_texts(v, "name", "fullyQualifiedName").alias(a) for a, v in parsed.items()]
        return F.struct(f["name"].alias("name"), *lists)

    return F.transform(_list(fields), one)


def _listed(columns: Column) -> Column:
    whole = F.forall(columns, lambda c: c["name"].isNotNull() & c["fullyQualifiedName"].isNotNull())
    return F.coalesce(whole, F.lit(False))


def _finding(name: Column, columns: Column, listed: Column) -> Column:
    """``(column, failed)`` of one changed field; an empty list of columns is a failure."""
    attribute = name.rlike(COLUMN_ATTRIBUTE) & ~name.rlike(COLUMN_TAGS)
    target = F.when(listed, F.get(columns, F.lit(0))["name"]).when(attribute, F.regexp_extract(name, COLUMN_ATTRIBUTE, 1))
    failed = F.coalesce(listed & (F.size(columns) == 0), F.lit(False))
    return F.struct(target.alias("column"), failed.alias("failed"))


def change_findings(change: Column, count_deletes: bool = False) -> Column:
    """Array of ``(column, failed)`` over all changed fields of an update.

    Deleted fields name no column unless ``count_deletes`` is set.
    """
    parts = [
        F.transform(
            _opened(change["fieldsAdded"], "newValue"), lambda f: _finding(f["name"], f["newValue"], _listed(f["newValue"]))
        ),
        F.transform(
            _opened(change["fieldsUpdated"], "newValue", "oldValue"),
            lambda f: _finding(f["name"], f["newValue"], _listed(f["newValue"]) & _listed(f["oldValue"])),
        ),
    ]
    if count_deletes:
        parts.append(
            F.transform(
                _opened(change["fieldsDeleted"], "oldValue"), lambda f: _finding(f["name"], f["oldValue"], _listed(f["oldValue"]))
            )
        )
    return F.concat(*parts)


def parse_events(events: DataFrame, payload: str = "payload", count_deletes: bool = False) -> DataFrame:
    """Adds ``kind``, ``entity_id``, ``changed_columns``, ``schema_change`` and ``action``.

    Created tables and updates that touch a column ask for a new sample. A field
    that cannot be judged counts as a schema change.
    """
    parsed = events.withColumn("event", F.from_json(F.col(payload), EVENT_DDL)).withColumn("event", _plain(F.col("event")))
    parsed = parsed.withColumn("kind", event_kind(F.col("event")))
    findings = F.when(F.col("kind") == "updated", change_findings(F.col("event.changeDescription"), count_deletes))
    parsed = parsed.withColumn("findings", findings)
    named = F.filter(F.transform("findings", lambda x: x["column"]), lambda c: F.coalesce(F.length(c) > 0, F.lit(False)))
    changed = (F.size(named) > 0) | F.exists("findings", lambda x: x["failed"])
    is_change = F.when(F.col("kind") == "updated", changed)
    action = (
        F.when(F.col("kind") == "created", GENERATE)
        .when(F.col("kind") == "updated", F.when(changed, GENERATE).otherwise(NO_ACTION))
        .when(F.col("kind") == "test", ECHO)
        .otherwise(REJECT)
    )
    table_event = F.col("kind").isin("created", "updated")
    return (
        parsed.withColumn("entity_id", F.when(table_event, F.col("event.entityId")))
        .withColumn("changed_columns", named)
        .withColumn("schema_change", is_change)
        .withColumn("action", action)
        .drop("event", "findings")
    )


def resolve_tables(classified: DataFrame, catalog: DataFrame, engine_catalog: str) -> DataFrame:
    """Adds ``fqn`` and ``table_name`` from ``catalog(table_id, fully_qualified_name)``.

    Events that ask for a sample of a table the catalog does not know, or whose
    name has not four parts, get the action ``unknown_table``.
    """
    named = catalog.select(
        F.col("table_id").alias("entity_id"),
        F.col("fully_qualified_name").alias("fqn"),
        engine_table(F.col("fully_qualified_name"), engine_catalog).alias("table_name"),
    )
    spread = [c for c, t in classified.dtypes if t in ("string", "bigint", "int")]
    joined = lookup_join(classified, named, "entity_id", spread)
    missing = (F.col("action") == GENERATE) & F.col("table_name").isNull()
    return joined.withColumn("action", F.when(missing, UNKNOWN_TABLE).otherwise(F.col("action")))


def classify_changes(
    events: DataFrame,
    catalog: DataFrame,
    engine_catalog: str,
    payload: str = "payload",
    count_deletes: bool = False,
) -> DataFrame:
    return resolve_tables(parse_events(events, payload, count_deletes), catalog, engine_catalog)


def regenerate_on_change(
    stream: DataFrame,
    catalog: DataFrame,
    engine_catalog: str,
    load: Callable[[str], DataFrame],
    publish: Callable[[str, DataFrame], None],
    checkpoint: str,
    payload: str = "payload",
    train_rows: int | None = None,
    output_rows: int = DEFAULT_OUTPUT_ROWS,
    seed: int = 0,
    record: Callable[[DataFrame, int], None] | None = None,
    available_now: bool = False,
    report: Callable[[DataFrame, int], None] | None = None,
    at_once: int = 4,
) -> StreamingQuery:
    """Per micro-batch: classify, then one new sample for each table that changed.

    Several events of one table in a batch cause one sample. ``record`` gets the
    classified events of a batch, for example to store rejected ones. A table that
    cannot be loaded, learnt or published fails alone: ``report`` gets the batch's
    ``(table_name, status, error)``, a row per changed table, and the stream goes on.
    ``at_once`` tables are in work together. Samples learn from whole tables unless
    ``train_rows`` bounds them. A batch may run again after a failure, so the callbacks
    should replace what they wrote for the same table or batch.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        classified = settle(classify_changes(batch, catalog, engine_catalog, payload), "events")
        if record is not None:
            record(classified, batch_id)
        tables = classified.where(F.col("action") == GENERATE).select("table_name").distinct()
        with ThreadPoolExecutor(at_once) as pool:
            statuses = list(pool.map(renew, (row["table_name"] for row in tables.toLocalIterator())))  # one name per changed table
        if report is not None:
            report(batch.sparkSession.createDataFrame(statuses, STATUS_DDL), batch_id)

    def renew(table_name: str) -> tuple[str, str, str | None]:
        try:
            rows = require_rows(load(table_name))
            rows = rows if train_rows is None else training_rows(rows, train_rows)
            publish(table_name, synthesize(rows, output_rows, seed=seed))
        except Exception as e:  # noqa: BLE001 one table must not stop the others
            return table_name, FAILED, str(e)
        return table_name, SUCCESS, None

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
