"""The changelog fold over a stream: per-key state, or snapshots by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankloom.operators.changelog import fold_sets
from rankloom.operators.resources import maintained

OUTPUT = "key {key}, value {value}, _pos long, deleted boolean"


def stream_fold(ops: DataFrame, key: str = "long", value: str = "double", tombstone_ms: int | None = None) -> DataFrame:
    """Streaming (seq, op, key, arg) of set and delete; each batch puts out the new row of each key that it touched.

    State per key: place, value, last seq. Operations at or below a key's last seq are late repeats and are dropped;
    within a batch they are taken in order of seq. A deleted key keeps its last seq, so that late repeats
    stay dropped; with tombstone_ms for so long, and then it leaves the state, which goes on making batches without data.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # a key that was deleted and hasn't come back
            state.remove()
            return
        pos, held, last = state.get if state.exists else (None, None, -1)
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, op, arg in zip(rows["seq"], rows["op"], rows["arg"], strict=True):
            if seq <= last:
                continue
            last = int(seq)
            if op == "delete":
                pos, held = None, None
            else:
                pos, held = (last if pos is None else pos), arg
        state.update((pos, held, last))
        if pos is None and tombstone_ms is not None:
            state.setTimeoutDuration(tombstone_ms)
        yield pd.DataFrame({"key": [k[0]], "value": pd.Series([held], dtype=object), "_pos": pd.array([pos], dtype="Int64"), "deleted": [pos is None]})

    return ops.groupBy("key").applyInPandasWithState(step, OUTPUT.format(key=key, value=value), f"_pos long, value {value}, last long", "update", GroupStateTimeout.NoTimeout if tombstone_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def fold_each_batch(ops: DataFrame, path: str, sink: Callable[[DataFrame, int], None]):
    """Folds each micro-batch of set, delete and clear into the snapshot of the one before, and hands the new one to sink.

    A snapshot is a folder under path for each batch, with (key, value, _pos, last): a batch reads the last one and its own
    operations, not the log. A batch that runs again after a failure replaces its folder. Operations of a later batch
    should have higher numbers; of late ones a set doesn't replace a newer value. Old folders may be deleted at any time
    but for the last."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("seq", "op", "key", "arg")
        if number:
            held = spark.read.parquet(f"{path}/batch={number - 1}")
            # a row of the snapshot is its first set and its last one
            first, last = (held.select(F.col(c).alias("seq"), F.lit("set").alias("op"), "key", F.col("value").alias("arg")) for c in ("_pos", "last"))
            new = last.unionByName(first).unionByName(new)
        folded = fold_sets(new, with_last=True)
        folded.write.mode("overwrite").parquet(f"{path}/batch={number}")
        sink(spark.read.parquet(f"{path}/batch={number}").drop("last"), number)

    return ops.writeStream.foreachBatch(each)


def maintained_each(spark: SparkSession, read: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame], None], lifetime_s: float, every: str = "10 seconds"):
    """Expiry of leased resources at a fixed pace: write gets what is left and the counts, for read() of that moment."""

    def each(batch: DataFrame, number: int) -> None:
        write(*maintained(read(), F.current_timestamp(), lifetime_s))

    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.trigger(processingTime=every).foreachBatch(each)


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "op", size: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Operations of each kind in tumbling windows, with a watermark for late ones."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("window"), kind).agg(F.count(F.lit(1)).alias("n"))
