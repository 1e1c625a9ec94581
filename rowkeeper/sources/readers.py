"""Sources: many places into one table, catalogs, listings and nested documents."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from rowkeeper.schemas import CATALOG

MAX_INLINE_ROWS = 10_000


def collect_union(frames: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Rows of every frame with the name of their source. For sources that already
    share one folder use ``collect_folders``, which needs a single scan."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def collect_folders(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """One scan over ``root/<tag>=<source>/``; a filter on the tag prunes folders."""
    return spark.read.schema(schema).parquet(root)


def source_list(df: DataFrame, name_col: str, active: Column) -> DataFrame:
    return df.filter(active).select(name_col).distinct()


def param_query(spark: SparkSession, sql: str, args: dict, **frames: DataFrame) -> DataFrame:
    """SQL text with ``:name`` parameters; ``{name}`` stands for a frame."""
    return spark.sql(sql, args=args, **frames)


def catalog_columns(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """One row per column of the given tables; reads schemas only."""
    rows = [
        (name, field.name, field.dataType.simpleString(), at)
        for name, df in frames.items()
        for at, field in enumerate(df.schema.fields, 1)
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, type_name string, ordinal bigint")


def column_profile(frames: dict[str, DataFrame]) -> DataFrame:
    """``catalog_columns`` with what the rows say: rows of the table (``n_rows``) and those that hold a value (``n_values``).

    Each table is aggregated to one row in one scan, which is then written out as a row per column.
    """
    def profiled(name: str, df: DataFrame) -> DataFrame:
        fields = df.schema.fields
        counted = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(f"`{f.name}`")).alias(f"_{i}") for i, f in enumerate(fields)])
        return counted.select(F.inline(F.array(*[
            F.struct(
                F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("type_name"),
                F.lit(i + 1).cast("bigint").alias("ordinal"), "n_rows", F.col(f"_{i}").alias("n_values"),
            ) for i, f in enumerate(fields)
        ])))

    return reduce(DataFrame.unionByName, [profiled(name, df) for name, df in frames.items()])


def session_catalog(spark: SparkSession, server_name: str) -> DataFrame:
    """Columns of all tables and views of all databases of the session's catalog; reads schemas only."""
    rows = []
    for database in spark.catalog.listDatabases():
        for table in spark.catalog.listTables(database.name):
            db_name = table.namespace[-1] if table.namespace else database.name
            kind = "VIEW" if table.isTemporary or table.tableType == "VIEW" else "USER_TABLE"
            name = table.name if table.isTemporary else f"{db_name}.{table.name}"
            rows += [
                (server_name, db_name, kind, name, field.name, field.dataType.simpleString())
                for field in spark.table(name).schema.fields
            ]
    return spark.createDataFrame(rows, CATALOG).distinct()


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Every file under a root, but for empty ones, which Spark's readers leave out.

    The content column is never selected, so no file is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(
        F.lit(root).alias("root"),
        F.regexp_replace("path", "^file:", "").alias("full_name"),
        F.col("modificationTime").alias("last_write_time"),
        F.col("length").alias("size_bytes"),
    )


def file_rows(df: DataFrame) -> DataFrame:
    """The files that hold a table's rows, with their size and the rows in each; no column is read."""
    return df.select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").groupBy(
        F.col("file_path").alias("full_name"), F.col("file_modification_time").alias("last_write_time"), F.col("file_size").alias("size_bytes")
    ).agg(F.count(F.lit(1)).alias("n_rows"))


def json_field(df: DataFrame, col: str, schema: StructType | str, out: str) -> DataFrame:
    return df.withColumn(out, F.from_json(F.col(col), schema))


def json_flatten(
    df: DataFrame, col: str, schema: StructType | str, paths: list[str], keep: list[str] | None = None
) -> DataFrame:
    """Parse nested JSON text and give one row per innermost item; ``json_rejects`` gives the documents that have none.

    ``paths`` names the array field to open on each level; the plain fields of every
    level become columns.
    """
    at = "_level"
    flat = df.select(*(keep or []), F.from_json(F.col(col), schema).alias(at))
    columns = list(keep or [])
    for path in [*paths, None]:
        level = flat.schema[at].dataType
        plain = [f.name for f in level.fields if not isinstance(f.dataType, ArrayType)]
        opened = [] if path is None else [F.explode(F.col(at)[path]).alias("_next")]
        flat = flat.select(*columns, *[F.col(at)[name].alias(name) for name in plain], *opened)
        flat = flat.withColumnRenamed("_next", at)
        columns += plain
    return flat


CORRUPT = "_corrupt_record"


def json_rejects(
    df: DataFrame, col: str, schema: StructType | str, paths: list[str], keep: list[str] | None = None
) -> DataFrame:
    """The documents that ``json_flatten`` makes no row of, with their text and a ``reason``.

    ``missing`` is a null text, ``malformed`` one that is no JSON or does not fit the schema, ``no items`` one that fits but
    holds nothing on the innermost level.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = StructType([*fields.fields, StructField(CORRUPT, StringType())])
    parsed = F.from_json(F.col(col), marked, {"columnNameOfCorruptRecord": CORRUPT})

    def any_item(level: Column, rest: list[str]) -> Column:
        if not rest:
            return F.lit(True)
        return F.coalesce(F.exists(level[rest[0]], lambda item: any_item(item, rest[1:])), F.lit(False))

    read = df.withColumn("_read", parsed)
    reason = (
        F.when(F.col(col).isNull(), "missing")
        .when(F.col("_read").isNull() | F.col("_read")[CORRUPT].isNotNull(), "malformed")
        .when(~any_item(F.col("_read"), paths), "no items")
    )
    return read.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(*(keep or []), col, "reason")


def inline_rows(spark: SparkSession, rows: list[tuple], schema: StructType | str) -> DataFrame:
    """A literal table. One of at most MAX_INLINE_ROWS rows is always broadcast; of a larger one Spark checks the size."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = {field.name: [row[i] for row in rows] for i, field in enumerate(fields)}
    table = spark.createDataFrame(pa.table(columns), fields)
    return F.broadcast(table) if len(rows) <= MAX_INLINE_ROWS else table


def json_documents(spark: SparkSession, path: str, out: str = "config") -> DataFrame:
    """One row per JSON file, as text for ``json_flatten``; a file is one document."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("full_name"), F.col("value").alias(out)
    )


def json_list(df: DataFrame, col: str, schema: str, out: str) -> DataFrame:
    """Parse a JSON list of objects into an array column; ``schema`` lists the fields wanted from each object."""
    return df.withColumn(out, F.from_json(F.col(col), f"array<struct<{schema}>>"))
