"""Table listing, description and scans over the session catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.tables import DEFAULTS, RULES

DESCRIPTION = (
    "table_name string, field string, type string, nullable boolean, key string, default_value string, extra string"
)


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """Expose DataFrames as session views under their logical names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def table_names(spark: SparkSession) -> list[str]:
    return sorted(table.name for table in spark.catalog.listTables())


def scan(spark: SparkSession, name: str) -> tuple[list[str], DataFrame]:
    """Columns and rows of a listed table; an unlisted name is an error."""
    if name not in table_names(spark):
        raise ValueError(f"no such table: {name!r}")
    df = spark.table(name)
    return df.columns, df


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, columns, rows) for each table."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("columns"), "rows"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def _key_mark(name: str, column: str) -> str:
    """Key column of a description: primary, unique, leading part of a unique key, or parent reference."""
    rules = RULES.get(name)
    if rules is None:
        return ""
    if column == rules.key:
        return "PRI"
    if (column,) in rules.unique:
        return "UNI"
    if column in rules.parents or any(column == columns[0] for columns in rules.unique):
        return "MUL"
    return ""


def describe(spark: SparkSession, name: str) -> DataFrame:
    """One row per column: type, nullability, key, default and extra."""
    _, df = scan(spark, name)
    rules = RULES.get(name)
    required = set(rules.not_null) | {rules.key} if rules else set()
    defaults = DEFAULTS.get(name, {})
    rows = [
        (
            name,
            column.name,
            column.dataType.simpleString(),
            column.name not in required,
            _key_mark(name, column.name),
            None if column.name not in defaults else str(defaults[column.name]),
            "generated" if rules and column.name == rules.key else "",
        )
        for column in df.schema
    ]
    return spark.createDataFrame(rows, DESCRIPTION)


def profile(spark: SparkSession, name: str) -> DataFrame:
    """The description of a listed table with the number of rows in which each column has a value."""
    columns, df = scan(spark, name)
    counts = df.agg(*[F.count(F.col(f"`{column}`")).alias(column) for column in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("filled")) for c in columns]))
    return describe(spark, name).join(counts.select(pairs.alias("one")).select("one.*"), "field").select(
        *[column.strip().split(" ")[0] for column in DESCRIPTION.split(",")], "filled"
    )
