"""Writing catalog tables: create, or unite the schemas by name and replace the rows."""

from __future__ import annotations

import uuid
from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.nested import column, reproject
from facsimile.functions.search import sql_string
from facsimile.sinks.files import counted
from facsimile.sources.naming import table_identifier, table_location

SNAPSHOT = "facsimile.snapshot"  # property: the snapshot that the entry points to
EMPTY_PARTITION = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder name of null
REPORT_DDL = "table string, rows bigint, snapshot string, created boolean, location string"

# The widenings a table schema may take without rewriting its meaning.
_WIDER = {
    (T.ByteType, T.ShortType), (T.ByteType, T.IntegerType), (T.ByteType, T.LongType),
    (T.ShortType, T.IntegerType), (T.ShortType, T.LongType), (T.IntegerType, T.LongType),
    (T.FloatType, T.DoubleType),
}


class TableWriteError(Exception):
    """A table write that failed; ``operation`` says in which step."""

    def __init__(self, message: str, table: str, operation: str):
        super().__init__(f"{message} (table {table}, step {operation})")
        self.table, self.operation = table, operation


def union_type(old: T.DataType, new: T.DataType, path: str = "") -> T.DataType:
    """The type that holds both, or an error: numbers may widen, structs unite by name."""
    if old == new or isinstance(new, T.NullType):
        return old
    if isinstance(old, T.NullType) or (type(old), type(new)) in _WIDER:
        return new
    if (type(new), type(old)) in _WIDER:
        return old
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType) and old.scale == new.scale:
        return T.DecimalType(max(old.precision, new.precision), old.scale)
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return union_schema(old, new, path)
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return T.ArrayType(union_type(old.elementType, new.elementType, f"{path}._item"))
    if isinstance(old, T.MapType) and isinstance(new, T.MapType) and old.keyType == new.keyType:
        return T.MapType(old.keyType, union_type(old.valueType, new.valueType, f"{path}._value"))
    raise ValueError(f"incompatible change of {path!r}: {old.simpleString()} to {new.simpleString()}")


def union_schema(old: T.StructType, new: T.StructType, path: str = "") -> T.StructType:
    """Fields of ``old`` in their order, then the fields only ``new`` has. Names are case-sensitive."""
    added = {f.name: f.dataType for f in new.fields}
    fields = []
    for f in old.fields:
        place = f"{path}.{f.name}" if path else f.name
        fields.append(T.StructField(f.name, union_type(f.dataType, added.pop(f.name, f.dataType), place)))
    fields += [T.StructField(f.name, f.dataType) for f in new.fields if f.name in added]
    return T.StructType(fields)


def to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    present = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            (reproject(column(f.name), present[f.name], f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(
                f.name
            )
            for f in schema.fields
        ]
    )


def _without_void(schema: T.StructType) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.NullType) else f.dataType) for f in schema.fields]
    )


def write_table(
    df: DataFrame,
    namespace: str,
    table: str,
    warehouse: str,
    properties: dict[str, str] | None = None,
    partition_by: Iterable[str] = (),
    expected: str | None = None,
) -> DataFrame:
    """Write ``df`` as table ``namespace.table`` and report what happened.

    Rows go to a new snapshot folder below the table's location first. Only when
    they are complete does the catalog entry point to it, so a failed write leaves the
    table as it was. An existing table takes new columns and wider types; anything else
    is refused before a row is written. ``partition_by`` lays a new table out in folders
    by those columns, so that scans prune; an existing table keeps its own layout.
    ``properties`` are added to the table's. The entry itself stays: its schema, location
    and partitions are changed one after the other, so readers always find a table (with
    a layout, one of whose folders some are old and some new for that moment).

    A table follows one snapshot with one other: if another writer has replaced the
    snapshot that this write started from, or that is ``expected``, the write is refused.
    """
    spark, name = df.sparkSession, table_identifier(namespace, table)
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS `{namespace}` LOCATION '{warehouse.rstrip('/')}/{namespace}.db'")
    exists = spark.catalog.tableExists(name)
    try:
        schema = union_schema(spark.table(name).schema, df.schema) if exists else df.schema
    except ValueError as e:
        raise TableWriteError(str(e), name, "union_schema") from e
    previous = table_properties(spark, name).get(SNAPSHOT, "") if exists else ""
    if expected is not None and expected != previous:
        raise TableWriteError(f"the table is at snapshot {previous or 'none'}, not at {expected}", name, "conflict")
    layout = _partition_columns(spark, name) if exists else list(partition_by)
    if exists and list(partition_by) not in ([], layout):
        raise TableWriteError(f"the table is laid out by {layout}", name, "union_schema")
    if not set(layout) < set(schema.names):
        raise TableWriteError(f"no rows to lay out by {layout}", name, "union_schema")
    if exists and any(spark.table(name).schema[c].dataType != schema[c].dataType for c in layout):
        raise TableWriteError("columns that lay the table out keep their types", name, "union_schema")
    schema = _without_void(schema)
    schema = T.StructType([f for f in schema.fields if f.name not in layout] + [schema[c] for c in layout])  # as files hold them
    base = table_location(warehouse, namespace, table)
    snapshot = uuid.uuid4().hex
    location = f"{base}{snapshot}"
    observed, seen = counted(to_schema(df, schema), "table")
    try:
        observed.write.mode("errorifexists").partitionBy(*layout).parquet(location)
    except Exception as e:
        raise TableWriteError("the rows could not be written", name, "write_data") from e
    if not _claim(spark, base, previous):
        raise TableWriteError("another writer has replaced the snapshot that this write started from", name, "conflict")
    try:
        _point(spark, name, schema, location, exists, (properties or {}) | {SNAPSHOT: snapshot}, layout)
    except Exception as e:
        _release(spark, base, previous)
        raise TableWriteError("the catalog entry could not be changed", name, "commit") from e
    rows = [(name, int(seen.get["rows"]), snapshot, not exists, location)]
    return spark.createDataFrame(rows, REPORT_DDL)


def _quoted(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def _path(spark: SparkSession, text: str):
    """A Hadoop path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _claim(spark: SparkSession, base: str, previous: str) -> bool:
    """Whether this writer is the first to follow ``previous``: a file that only one can create."""
    path, files = _path(spark, f"{base}_followed/{previous or 'none'}")
    try:
        files.create(path, False).close()
    except Exception:
        if files.exists(path):
            return False
        raise
    return True


def _release(spark: SparkSession, base: str, previous: str) -> None:
    path, files = _path(spark, f"{base}_followed/{previous or 'none'}")
    files.delete(path, False)


def _point(
    spark: SparkSession, name: str, schema: T.StructType, location: str, exists: bool, properties: dict[str, str], layout: list[str]
) -> None:
    """Let the entry point to a complete snapshot: new columns and types first, then folders, at last what is gone."""
    if not exists:
        _create(spark, name, schema, location, properties, layout)
        return
    table = _quoted(name)
    if spark.table(name).schema.simpleString() != schema.simpleString():
        state = spark._jsparkSession.sessionState()
        data = T.StructType([f for f in schema.fields if f.name not in layout])
        state.catalog().alterTableDataSchema(state.sqlParser().parseTableIdentifier(table), spark._jsparkSession.parseDataType(data.json()))
    gone: list[str] = []
    if layout:
        old = {r["partition"] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
        new = _folders(spark, location, len(layout))
        for folder in sorted(old & new):
            spark.sql(f"ALTER TABLE {table} PARTITION ({_spec(spark, folder)}) SET LOCATION {sql_string(f'{location}/{folder}')}")
        added = [f"PARTITION ({_spec(spark, f)}) LOCATION {sql_string(f'{location}/{f}')}" for f in sorted(new - old)]
        if added:
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {' '.join(added)}")
        gone = [f"PARTITION ({_spec(spark, f)})" for f in sorted(old - new)]
    spark.sql(f"ALTER TABLE {table} SET LOCATION {sql_string(location)}")
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ({_pairs(properties)})")
    if gone:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {', '.join(gone)}")  # external: the files stay
    spark.catalog.refreshTable(name)


def _folders(spark: SparkSession, location: str, depth: int) -> set[str]:
    """The folders of a layout, such as ``year=2024/kind=a``."""
    path, files = _path(spark, location + "/*=*" * depth)
    found = [f.getPath().toString().split("/") for f in files.globStatus(path) or []]
    return {"/".join(parts[-depth:]) for parts in found}


def _spec(spark: SparkSession, folder: str) -> str:
    """SQL of the partition of a folder."""
    unescaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    pairs = [part.split("=", 1) for part in folder.split("/")]
    return ", ".join(f"`{unescaped(k)}` = {'NULL' if v == EMPTY_PARTITION else sql_string(unescaped(v))}" for k, v in pairs)


def _pairs(properties: dict[str, str]) -> str:
    return ", ".join(f"{sql_string(k)} = {sql_string(v)}" for k, v in properties.items())


def _create(spark: SparkSession, name: str, schema: T.StructType, location: str, properties: dict[str, str], layout: list[str]) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parts = f" PARTITIONED BY ({', '.join(f'`{c}`' for c in layout)})" if layout else ""
    extra = f" TBLPROPERTIES ({_pairs(properties)})" if properties else ""
    try:
        spark.sql(f"CREATE TABLE {_quoted(name)} ({columns}) USING parquet{parts} LOCATION '{location}'{extra}")
        if layout:
            spark.sql(f"MSCK REPAIR TABLE {_quoted(name)}")  # the catalog learns the folders
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(name)}")
        raise


def table_properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {_quoted(name)}").collect()}


def _partition_columns(spark: SparkSession, name: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
