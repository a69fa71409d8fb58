"""Queries over a table of leased resources: status counts, expiry, first free one, release.

Rows: (id, created_at, last_used, in_use, _pos). now is a timestamp column or literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.frame import POS


def _seconds(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later.cast("timestamp")) / 1e6 - F.unix_micros(earlier.cast("timestamp")) / 1e6


def with_ages(df: DataFrame, now: Column) -> DataFrame:
    return df.withColumns({"age_s": _seconds(now, F.col("created_at")), "idle_s": _seconds(now, F.col("last_used"))})


def status(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("in_use")).alias("available"), F.count_if("in_use").alias("in_use"))


def unexpired(df: DataFrame, now: Column, lifetime_s: float) -> DataFrame:
    return df.filter(_seconds(now, F.col("created_at")) <= lifetime_s)


def needs_check(df: DataFrame, now: Column, idle_s: float = 300.0) -> DataFrame:
    return df.filter(_seconds(now, F.col("last_used")) > idle_s)


def first_available(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("in_use")).orderBy(POS).limit(1)


def released(df: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """df with the resources in wanted (id) given back. Those that weren't in use stay as they were."""
    marked = df.join(wanted.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("in_use")
    return marked.withColumns({"in_use": F.col("in_use") & ~hit, "last_used": F.when(hit, now.cast("timestamp")).otherwise(F.col("last_used"))}).select(df.columns)


def release_errors(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, error) of the wanted ids that can't be given back: not in use, or not found. Ids must be distinct."""
    found = wanted.select("id").join(df.select("id", "in_use"), "id", "left")
    error = F.when(F.col("in_use").isNull(), "not found").when(~F.col("in_use"), "not in use")
    return found.select("id", error.alias("error")).filter("error is not null")


def maintained(df: DataFrame, now: Column, lifetime_s: float) -> tuple[DataFrame, DataFrame]:
    """What is left after expiry, and one row of counts: valid, available, in_use, expired."""
    valid = F.coalesce(_seconds(now, F.col("created_at")) <= lifetime_s, F.lit(False))
    counts = df.agg(F.count_if(valid).alias("valid"), F.count_if(valid & ~F.col("in_use")).alias("available"), F.count_if(valid & F.col("in_use")).alias("in_use"), F.count_if(~valid).alias("expired"))
    return df.filter(valid), counts


def reset(df: DataFrame, minimum: int, now: Column, prefix: str = "r") -> DataFrame:
    """As many new free resources as minimum says, in place of all of df."""
    n = F.col("n").cast("long")
    new = df.sparkSession.range(1, minimum + 1).toDF("n").withColumn("now", now.cast("timestamp"))
    kind = df.schema["id"].dataType
    return new.select((F.concat(F.lit(prefix), n.cast("string")) if kind.typeName() == "string" else n).cast(kind).alias("id"), F.col("now").alias("created_at"), F.col("now").alias("last_used"), F.lit(False).alias("in_use"), n.alias(POS))
