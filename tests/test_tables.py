import random
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rankloom.operators import changelog as C
from rankloom.operators import frame, resources
from rankloom.operators.sorting import OrderBy, sort_by_field, sort_by_fields
from rankloom.sources.io import read_files, read_jdbc, write_files
from rankloom.streaming.changelog_stream import fold_each_batch, maintained_each, stream_fold, windowed_counts

PEOPLE = [(1, (3, "Charlie", 85.0)), (2, (1, "Alice", 90.0)), (3, (2, "Bob", 75.0))]
KIND = "struct<ID: bigint, Name: string, Score: double>"


def ops(spark, rows):
    return spark.createDataFrame(rows, "seq long, op string, key string, arg long")


def order(df):
    return [(r["key"], r["value"]) for r in df.orderBy("_pos").collect()]


def test_basics(spark):
    df = frame.from_pairs(spark, [("one", 1), ("two", 2), ("three", 3)], "int")
    assert frame.get(df, "two").collect()[0]["value"] == 2
    assert frame.exists(df, "one") and not frame.exists(df, "four")
    assert frame.length(df).collect()[0][0] == 3
    assert [r[0] for r in frame.keys(df).collect()] == ["one", "two", "three"]
    assert [r[0] for r in frame.values(df).collect()] == [1, 2, 3]
    gone = spark.createDataFrame([("two",)], "key string")
    assert [tuple(r) for r in frame.scan(C.delete_keys(df, gone)).collect()] == [("one", 1), ("three", 3)]
    assert {tuple(r) for r in frame.get_batch(df, spark.createDataFrame([("one",), ("x",)], "key string")).collect()} == {("one", 1, True), ("x", None, False)}


def test_field_sorts(spark):
    df = frame.from_pairs(spark, PEOPLE, KIND, "int")
    assert [r["value"]["ID"] for r in sort_by_field(df, OrderBy("ID")).collect()] == [1, 2, 3]
    assert [r["value"]["Score"] for r in sort_by_field(df, OrderBy("Score", True)).collect()] == [90, 85, 75]
    tied = frame.from_pairs(spark, [(1, (2, "Bob", 90.0)), (2, (1, "Alice", 90.0)), (3, (3, "Charlie", 85.0))], KIND, "int")
    assert [r["value"]["Name"] for r in sort_by_fields(tied, [OrderBy("Score", True), OrderBy("Name")]).collect()] == ["Alice", "Bob", "Charlie"]
    assert [r["key"] for r in sort_by_field(tied, OrderBy("Score", True)).collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        sort_by_field(df, OrderBy("None"))
    with pytest.raises(TypeError):
        sort_by_field(frame.from_pairs(spark, [("a", 1)], "int"), OrderBy("ID"))


def test_places(spark):
    assert order(C.fold_sets(ops(spark, [(1, "set", "a", 1), (2, "set", "b", 2), (3, "set", "c", 3), (4, "delete", "b", None), (5, "set", "b", 4)]))) == [("a", 1), ("c", 3), ("b", 4)]
    assert order(C.fold_sets(ops(spark, [(1, "set", "a", 1), (2, "set", "b", 2), (3, "set", "a", 9)]))) == [("a", 9), ("b", 2)]
    assert order(C.fold_sets(ops(spark, [(1, "set", "a", 1), (2, "clear", None, None), (3, "set", "b", 2)]))) == [("b", 2)]
    assert order(C.fold_sets(ops(spark, []))) == []


def test_update_operations(spark):
    df = frame.from_pairs(spark, [("r", (1, "Test", 10.0))], KIND)
    hit = spark.createDataFrame([("r",), ("none",)], "key string")
    assert C.update_keys(df, hit, C.FieldUpdate({"Name": "Updated", "Score": 25.5})).collect()[0]["value"][1:] == ("Updated", 25.5)
    assert [r[0] for r in C.missing_keys(df, hit).collect()] == ["none"]
    for bad, error in (({"Score": 3}, TypeError), ({"No": 1}, ValueError)):
        with pytest.raises(error):
            C.update_keys(df, hit, C.FieldUpdate(bad))
    n = frame.from_pairs(spark, [("r", 10)], "int")
    n = C.update_keys(C.update_keys(n, hit, C.DirectUpdate(20)), hit, C.FunctionUpdate(lambda v: v + 5))
    assert n.collect()[0]["value"] == 25


def replay(rows):
    held = {}
    for _, op, key, arg in sorted(rows):
        if op == "clear":
            held = {}
        elif op == "delete":
            held.pop(key, None)
        elif op == "set":
            held[key] = arg
        elif op == "update":
            held[key] = held.get(key, 0) * 2 + arg
        elif op == "set_or_update":
            held[key] = held[key] * 2 + arg if key in held else arg
        elif op == "update_generic" and key in held:
            held[key] = held[key] * 2 + arg
    return list(held.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_replay(spark, seed):
    rng = random.Random(seed)
    kinds = ["set", "update", "set_or_update", "update_generic", "delete"] * 8 + ["clear"]
    rows = [(i, op, None if op == "clear" else rng.choice("abcdefg"), rng.randint(0, 9)) for i, op in enumerate(rng.choices(kinds, k=150))]
    assert order(C.fold(ops(spark, rows), F.lit(0), lambda v, x: v * 2 + x)) == replay(rows)
    plain = [r for r in rows if r[1] in ("set", "delete", "clear")]
    assert order(C.fold_sets(ops(spark, plain))) == replay(plain)


def test_streams(spark, tmp_path):
    first = [(1, "set", "a", 1), (2, "set", "b", 2), (3, "delete", "a", None)]
    second = [(2, "set", "b", 99), (4, "set", "a", 5), (5, "set", "b", 6)]
    for i, rows in enumerate((first, second)):
        ops(spark, rows).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("seq long, op string, key string, arg long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = stream_fold(stream, "string", "long").writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.table("folded").collect():
        last[r["key"]] = r
    assert last["b"]["value"] == 6 and last["b"]["_pos"] == 2
    assert last["a"]["value"] == 5 and last["a"]["_pos"] == 4
    seen = []
    q = fold_each_batch(stream, str(tmp_path / "log"), lambda df, n: seen.append(order(df))).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert seen[-1] == [("b", 6), ("a", 5)]


def test_sums_equal_replay(spark):
    rng = random.Random(5)
    rows = [(i, op, None if op == "clear" else rng.choice("abcde"), rng.randint(0, 9)) for i, op in enumerate(rng.choices(["set", "update", "set_or_update", "update_generic", "delete"] * 8 + ["clear"], k=200))]
    assert order(C.fold_sums(ops(spark, rows))) == order(C.fold(ops(spark, rows), F.lit(0), lambda v, x: v + x))


@pytest.mark.parametrize("seed", [3, 4])
def test_failed_updates(spark, seed):
    """A failed update leaves the value, or zero where the key was absent; update_generic of an absent key is an error."""
    rng = random.Random(seed)
    kinds = ["set", "update", "update", "set_or_update", "update_generic", "delete"] * 6 + ["clear"]
    rows = [(i, op, None if op == "clear" else rng.choice("abcd"), rng.randint(0, 9)) for i, op in enumerate(rng.choices(kinds, k=120))]
    held, errors = {}, []
    for seq, op, key, arg in rows:
        if op == "clear":
            held = {}
        elif op == "delete":
            held.pop(key, None)
        elif op == "set" or op == "set_or_update" and key not in held:
            held[key] = arg
        elif op == "update_generic" and key not in held:
            errors.append((seq, key, "key not found"))
        else:
            value = held.setdefault(key, 0)
            if op != "set_or_update" and value + arg > 12:
                errors.append((seq, key, "too much"))
            else:
                held[key] = value + arg
    too_much = lambda v, x: F.when(v + x > 12, F.lit("too much"))
    add = lambda v, x: v + x
    assert order(C.fold(ops(spark, rows), F.lit(0), add, fails=too_much)) == list(held.items())
    assert sorted(map(tuple, C.fold_errors(ops(spark, rows), F.lit(0), add, fails=too_much).collect())) == errors and errors


def test_pool_operations(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    df = spark.createDataFrame([("a", "2024-01-01 00:50:00", True, 0), ("b", "2024-01-01 00:00:00", True, 1), ("c", "2024-01-01 00:55:00", False, 2)], "id string, at string, in_use boolean, _pos long")
    df = df.select("id", F.col("at").cast("timestamp").alias("created_at"), F.col("at").cast("timestamp").alias("last_used"), "in_use", "_pos")
    wanted = spark.createDataFrame([("a",), ("c",), ("x",)], "id string")
    out = {r["id"]: r for r in resources.released(df, wanted, now).collect()}
    assert [out[k]["in_use"] for k in "abc"] == [False, True, False]
    assert [out[k]["last_used"].minute for k in "abc"] == [0, 0, 55]
    assert sorted(map(tuple, resources.release_errors(df, wanted).collect())) == [("c", "not in use"), ("x", "not found")]
    left, counts = resources.maintained(df, now, 1200)
    assert [r["id"] for r in left.orderBy("_pos").collect()] == ["a", "c"] and tuple(counts.first()) == (2, 1, 1, 1)
    assert [tuple(r)[0] for r in resources.reset(df, 2, now).orderBy("_pos").collect()] == ["r1", "r2"]
    assert resources.reset(df, 2, now).filter("in_use").count() == 0


def test_maintenance_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, False), ("b", 10**10, True)], "id string, at long, in_use boolean").select("id", F.timestamp_seconds("at").alias("created_at"), "in_use")
    seen = []
    q = maintained_each(spark, lambda: df, lambda left, counts: seen.append((left.count(), tuple(counts.first()))), 60.0, "1 second").option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(60):
        if seen:
            break
        time.sleep(0.5)
    q.stop()
    assert seen[0] == (1, (1, 0, 1, 1))


def test_windowed_counts(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:01:00", "set"), ("2024-01-01 00:02:00", "set"), ("2024-01-01 00:11:00", "delete"), ("2024-01-01 02:00:00", "set")], "ts string, op string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, op string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["window"]["start"].minute, r["op"], r["n"]) for r in spark.table("windows").collect()} == {(0, "set", 2), (10, "delete", 1)}


@pytest.mark.parametrize("fmt,options", [("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": "true", "quote": '"', "escape": '"'})])
def test_files_round_trip(spark, tmp_path, fmt, options):
    rows = [("a", 1, 1.5, "2024-01-01"), ('q"uo,te', None, -2.0, "2024-01-02"), ("é", 3, None, "2024-01-02")]
    schema = "key string, n long, x double, day string"
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / fmt)
    write_files(df, path, fmt, partition_by=["day"], **options)
    held = read_files(spark, path, fmt, None if fmt in ("parquet", "orc") else schema, **options)
    assert sorted(map(repr, (tuple(r) for r in held.select("key", "n", "x", F.col("day").cast("string")).collect()))) == sorted(map(repr, rows))
    assert "day=2024-01-01" in held.filter("day = '2024-01-01'")._jdf.queryExecution().executedPlan().toString() or held.filter("day = '2024-01-01'").count() == 1
    write_files(df.limit(1), path, fmt, "overwrite", **options)
    assert read_files(spark, path, fmt, schema, **options).count() == 1
    with pytest.raises(AnalysisException):
        write_files(df, path, fmt, **options)
    if fmt in ("json", "csv"):
        with pytest.raises(ValueError):
            read_files(spark, path, fmt)


def test_jdbc_options(monkeypatch):
    """The options that reach the reader; no database is at hand."""
    calls = {}

    class Reader:
        def format(self, name):
            calls["format"] = name
            return self

        def options(self, **kw):
            calls.update(kw)
            return self

        def load(self):
            return "rows"

    class Session:
        read = Reader()

    assert read_jdbc(Session(), "jdbc:x", "t", "id", 0, 100, 4, fetchsize="10") == "rows"
    assert calls == {"format": "jdbc", "url": "jdbc:x", "dbtable": "t", "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "4", "fetchsize": "10"}


def test_empty_with_capacity(spark):
    from pyspark.sql.types import LongType, StringType

    assert frame.empty(spark, StringType(), LongType(), 10).count() == 0
