"""Readers and writers of ordered tables; every path goes through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_files(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options) -> DataFrame:
    """Parquet, ORC, CSV, JSON or text; text formats need a schema, so that no inference pass reads the data twice."""
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options) -> DataFrame:
    """A database table, read in parallel by ranges of a numeric column."""
    bounds = {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **bounds, **options).load()


def write_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def as_ordered(df: DataFrame, key: str, value, pos: str) -> DataFrame:
    """(key, value, _pos) from columns of a table: value is a column name or a Column, pos orders the rows."""
    return df.select(F.col(key).alias("key"), (F.col(value) if isinstance(value, str) else value).alias("value"), F.col(pos).alias("_pos"))
