"""Ordered keyed tables: (key, value, _pos). _pos is the insertion position; only its order counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

POS = "_pos"


def empty(spark: SparkSession, key: DataType, value: DataType, capacity: int = 0) -> DataFrame:
    """A table without rows. capacity is taken and has no effect: tables have no room to set aside."""
    return spark.createDataFrame([], StructType([StructField("key", key), StructField("value", value), StructField(POS, LongType())]))


def from_pairs(spark: SparkSession, pairs: list[tuple], value: str, key: str = "string") -> DataFrame:
    """A small literal table; the list's order is the insertion order, a repeated key keeps its place and takes the last value."""
    rows = {k: v for k, v in pairs}
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows.items())], f"key {key}, value {value}, _pos long")


def scan(df: DataFrame) -> DataFrame:
    return df.orderBy(POS).select("key", "value")


def keys(df: DataFrame) -> DataFrame:
    return df.orderBy(POS).select("key")


def values(df: DataFrame) -> DataFrame:
    return df.orderBy(POS).select("value")


def length(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("len"))


def get(df: DataFrame, key) -> DataFrame:
    """The row of a key, or none; the predicate reaches the scan."""
    return df.filter(F.col("key") == F.lit(key)).select("key", "value")


def exists(df: DataFrame, key) -> bool:
    return not df.filter(F.col("key") == F.lit(key)).limit(1).isEmpty()


def get_batch(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each row of wanted (key): its value, null if absent, and whether it exists."""
    held = df.select("key", "value", F.lit(True).alias("found"))
    return wanted.join(held, "key", "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def exists_batch(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted keys that exist."""
    return wanted.join(df.select("key"), "key", "left_semi")
