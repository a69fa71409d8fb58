"""Positions in a total order, and sums over all rows before, without sending all rows to one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import written

#: Up to this estimated size one task numbers all rows.
ONE_TASK_BYTES = 32 << 20


def small(df: DataFrame, most: int = ONE_TASK_BYTES) -> bool:
    """Whether the optimizer's upper estimate of df's size is within most bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def numbered(df: DataFrame, order: list[Column], name: str = "rank", sums: dict[str, str] | None = None, size_of: DataFrame | None = None, one_task: int | None = None) -> DataFrame:
    """Adds the place of each row in the given order, from 1, and for each sums item {new: column} the sum of that
    column over all rows before. size_of: a table that is at least as large, to decide by its estimate; one_task: the
    bytes up to which one task numbers all rows (ONE_TASK_BYTES if None).

    Large tables are range-partitioned by the order and written once; each partition's count and sums (a row for each
    partition) give the offsets, so no task sees more than one range. Ties get any order among themselves: end the
    order with a unique column.
    """
    sums = sums or {}
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if small(df if size_of is None else size_of, *([] if one_task is None else [one_task])):
        w = Window.orderBy(*order)
        return df.withColumns({name: F.row_number().over(w).cast("long"), **{k: before(c, w) for k, c in sums.items()}})
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    ranged = written(df.repartitionByRange(n, *order).withColumn("_numbered_range", F.spark_partition_id()), "numbered")
    added = [name, *sums]
    totals = ranged.groupBy(F.col("_numbered_range").alias("_numbered_r")).agg(F.count(F.lit(1)).alias("_numbered_0"), *[F.sum(c).alias(f"_numbered_{i}") for i, c in enumerate(sums.values(), 1)])
    rows = sorted(map(tuple, totals.collect()))
    starts = [list(accumulate((r[i] or 0 for r in rows), initial=0))[:-1] for i in range(1, len(added) + 1)]
    offsets = spark.createDataFrame(list(zip((r[0] for r in rows), *starts, strict=True)), totals.schema)  # a row for each range
    w = Window.partitionBy("_numbered_range").orderBy(*order)
    out = ranged.withColumns({name: F.row_number().over(w).cast("long"), **{k: before(c, w) for k, c in sums.items()}})
    out = out.join(F.broadcast(offsets), F.col("_numbered_range") == F.col("_numbered_r"))
    return out.withColumns({k: F.col(k) + F.col(f"_numbered_{i}") for i, k in enumerate(added)}).drop("_numbered_range", *offsets.columns)
