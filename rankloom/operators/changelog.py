"""The state of an ordered table, folded from an append-only log of operations.

ops: (seq, op, key, arg). op is set, update, set_or_update, update_generic, delete or clear; seq is unique; clear has
no key. A key's place is the seq of the first operation that made it since its last delete or clear.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from rankloom.operators.frame import POS


class UpdateOperation(Protocol):
    """What update_generic applies to a value."""

    def apply(self, value: Column, kind: DataType) -> Column: ...


class DirectUpdate:
    def __init__(self, value):
        self.value = value

    def apply(self, value: Column, kind: DataType) -> Column:
        return F.lit(self.value).cast(kind)


class FunctionUpdate:
    def __init__(self, function: Callable[[Column], Column]):
        self.function = function

    def apply(self, value: Column, kind: DataType) -> Column:
        return self.function(value)


class FieldUpdate:
    """Sets fields of a struct. Unknown fields and values of another type are errors; ints aren't widened to floats."""

    #: Python types that a field of a Spark type takes.
    TAKES = {"string": (str,), "double": (float,), "float": (float,), "bigint": (int,), "int": (int,), "smallint": (int,), "tinyint": (int,), "boolean": (bool,)}

    def __init__(self, fields: dict):
        self.fields = fields

    def apply(self, value: Column, kind: DataType) -> Column:
        if not isinstance(kind, StructType):
            raise TypeError("only struct values have fields")
        for name, new in self.fields.items():
            if name not in kind.fieldNames():
                raise ValueError(f"no field {name!r}")
            held = kind[name].dataType
            if type(new) not in self.TAKES.get(held.simpleString(), ()):
                raise TypeError(f"field {name!r} is {held.simpleString()}, not {type(new).__name__}")
            value = value.withField(name, F.lit(new).cast(held))
        return value


def update_keys(df: DataFrame, wanted: DataFrame, operation: UpdateOperation) -> DataFrame:
    """Applies the operation to the rows whose key is in wanted (key), in place. Absent keys change nothing."""
    new = operation.apply(F.col("value"), df.schema["value"].dataType)
    marked = df.join(wanted.select("key").distinct().withColumn("_hit", F.lit(True)), "key", "left")
    return marked.select("key", F.when(F.col("_hit"), new).otherwise(F.col("value")).alias("value"), POS)


def missing_keys(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted keys that an update of existing rows would refuse."""
    return wanted.join(df.select("key"), "key", "left_anti")


def delete_keys(df: DataFrame, gone: DataFrame) -> DataFrame:
    return df.join(gone.select("key"), "key", "left_anti")


def _live(ops: DataFrame) -> DataFrame:
    """The operations after the last delete of their key and the last clear. Both sides of the join are aggregated
    or split by AQE, so a hot key doesn't fill one task."""
    cleared = ops.filter(F.col("op") == "clear").agg(F.max("seq").alias("_cleared"))
    deleted = ops.filter(F.col("op") == "delete").groupBy("key").agg(F.max("seq").alias("_deleted"))
    kept = ops.filter(~F.col("op").isin("clear", "delete"))
    reset = F.greatest(F.coalesce("_deleted", F.lit(-(2**63))), F.coalesce("_cleared", F.lit(-(2**63))))
    return kept.join(F.broadcast(cleared)).join(deleted, "key", "left").filter(F.col("seq") > reset).drop("_cleared", "_deleted")


def fold_sets(ops: DataFrame, with_last: bool = False) -> DataFrame:
    """For logs of set, delete and clear: (key, value, _pos), by aggregates that combine before the shuffle; with_last
    adds the number of the key's last set."""
    last = [F.max("seq").alias("last")] if with_last else []
    return _live(ops).groupBy("key").agg(F.max_by("arg", "seq").alias("value"), F.min("seq").alias(POS), *last)


def fold_sums(ops: DataFrame, aggregate: Callable[[str], Column] = F.sum) -> DataFrame:
    """For logs whose updates add arg to the value by one aggregate that doesn't depend on order and starts from its
    neutral value (sum, min, max): the aggregate of the args since the key's last set. It combines before the shuffle, so
    a hot key is one row for each task. update_generic changes existing keys only."""
    tail = _tail(_live(ops))
    return tail.groupBy("key", POS).agg(aggregate("arg").alias("value")).select("key", "value", POS)


def _tail(live: DataFrame) -> DataFrame:
    """The operations that count: from the one that made the key on, and from its last set on; with the key's place."""
    base = live.groupBy("key").agg(F.max(F.when(F.col("op") == "set", F.col("seq"))).alias("_set"), F.min(F.when(F.col("op") != "update_generic", F.col("seq"))).alias(POS))
    return live.join(base, "key").filter((F.col("seq") >= F.coalesce("_set", F.lit(-(2**63)))) & (F.col("seq") >= F.col(POS)))


def fold(ops: DataFrame, zero: Column, update: Callable[[Column, Column], Column], fallback: Callable[[Column, Column], Column] | None = None, fails: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """For logs with updates: update(value, arg) is applied in order of seq, from zero where the key is absent.

    set_or_update takes arg itself where the key is absent, else fallback(value, arg) (update if None).
    update_generic changes existing keys only. An update for which fails(value, arg) isn't null leaves the value, and
    leaves zero where the key was absent; fold_errors lists those. What precedes a key's last set is dropped before rows
    meet; the rest of a key is one array, as a general update depends on its order. Where it doesn't, fold_sums needs none.
    """
    fallback = fallback or update
    steps = _tail(_live(ops)).groupBy("key", POS).agg(F.sort_array(F.collect_list(F.struct("seq", "op", "arg"))).alias("_steps"))
    kind = ops.schema["arg"].dataType
    start = F.struct(F.lit(False).alias("there"), zero.cast(kind).alias("value"))

    def step(acc: Column, x: Column) -> Column:
        updated = update(acc["value"], x["arg"])
        if fails:
            updated = F.when(fails(acc["value"], x["arg"]).isNotNull(), acc["value"]).otherwise(updated)
        new = (
            F.when(x["op"] == "set", x["arg"])
            .when((x["op"] == "set_or_update") & ~acc["there"], x["arg"])
            .when(x["op"] == "set_or_update", fallback(acc["value"], x["arg"]))
            .otherwise(updated)
        )
        return F.struct(F.lit(True).alias("there"), new.cast(kind).alias("value"))

    return steps.select("key", F.aggregate("_steps", start, step)["value"].alias("value"), POS)


def fold_errors(ops: DataFrame, zero: Column, update: Callable[[Column, Column], Column], fallback: Callable[[Column, Column], Column] | None = None, fails: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(seq, key, error) of the updates of the whole log that failed: for fails(value, arg), or, of update_generic, as
    the key wasn't there. A key's operations are one array, sets, deletes and clears included."""
    fallback = fallback or update
    kind = ops.schema["arg"].dataType
    cleared = ops.filter("op = 'clear'").agg(F.sort_array(F.collect_list(F.struct("seq", "op", "arg"))).alias("_clears"))  # few
    steps = ops.filter("op <> 'clear'").groupBy("key").agg(F.collect_list(F.struct("seq", "op", "arg")).alias("_own")).join(F.broadcast(cleared))
    start = F.struct(F.lit(False).alias("there"), zero.cast(kind).alias("value"), F.array().cast("array<struct<seq: bigint, error: string>>").alias("errors"))

    def step(acc: Column, x: Column) -> Column:
        absent = ~acc["there"]
        held = F.when(absent, zero.cast(kind)).otherwise(acc["value"])
        failed = fails(held, x["arg"]) if fails else F.lit(None).cast("string")
        error = F.when((x["op"] == "update_generic") & absent, F.lit("key not found")).when(x["op"].isin("update", "update_generic"), failed)
        new = (
            F.when(x["op"].isin("delete", "clear"), F.lit(None).cast(kind))
            .when((x["op"] == "set") | (x["op"] == "set_or_update") & absent, x["arg"])
            .when(x["op"] == "set_or_update", fallback(held, x["arg"]))
            .when(error.isNotNull(), held)
            .otherwise(update(held, x["arg"]))
        )
        there = F.when(x["op"].isin("delete", "clear"), F.lit(False)).when(x["op"] == "update_generic", acc["there"]).otherwise(F.lit(True))
        errors = F.when(error.isNull(), acc["errors"]).otherwise(F.concat(acc["errors"], F.array(F.struct(x["seq"].cast("long").alias("seq"), error.alias("error")))))
        return F.struct(there.alias("there"), new.cast(kind).alias("value"), errors.alias("errors"))

    done = steps.select("key", F.explode(F.aggregate(F.sort_array(F.concat("_own", "_clears")), start, step)["errors"]).alias("e"))
    return done.select("e.seq", "key", "e.error")
