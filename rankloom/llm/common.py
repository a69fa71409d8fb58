"""What the operators share: tables, written steps, batches and components."""

from __future__ import annotations

import ctypes
import functools
import math
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.numbering import small
from rankloom.session import shared_folder, written

#: Words of the contracts: runs of anything but a space or \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{os.getpid()}-{uuid.uuid4().hex}"


#: Bytes of a batch that a kernel gives back, about.
OUT_BYTES = 2_000_000


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose batches go out in slices of about OUT_BYTES, which the JVM reads one at a time, and after which the worker
    gives the memory that the task has freed back to the system: workers live on, and what their allocators keep would
    count beside the JVM's memory in stages that need no Python."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in run(batches):
                step = max(1, out.num_rows * OUT_BYTES // max(1, out.nbytes))
                for a in range(0, out.num_rows, step):
                    yield out.slice(a, step)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return tidied


def arrow_rows(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """make() for each Arrow batch of df, without state between batches."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := make(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


#: File bytes of a written table for which a partition of packed arrays is made, at least.
PART_BYTES = 64 << 20


def in_parts(table: DataFrame) -> int:
    """Partitions in which to hold what a written table's rows bring: the session's setting, or more if it is large."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(2, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


#: Bits of the filter of maybe_among, and of one of its blocks.
FILTER_BITS, BLOCK_BITS = 1 << 25, 1 << 12


def maybe_among(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of df whose key (a long hash) may be one of keys (one column), so that a join needn't move the rest.

    A filter of FILTER_BITS bits, whatever the number of keys, is built by tasks and read as a scalar; where it fills up more
    rows pass, and the join decides as before."""

    @released
    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.asarray(b.column(0))
            for block in np.unique(at // BLOCK_BITS).tolist():
                held.setdefault(block, np.zeros(BLOCK_BITS, bool))[at[at // BLOCK_BITS == block] % BLOCK_BITS] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], names=["block", "bits"])

    @released
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = bytearray(FILTER_BITS // 8)
        for b in batches:
            for block, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out[block * (BLOCK_BITS // 8) : (block + 1) * (BLOCK_BITS // 8)] = bits
        yield pa.RecordBatch.from_arrays([pa.array([bytes(out)], pa.binary())], names=["bits"])

    places = keys.toDF("k").select(F.pmod("k", F.lit(FILTER_BITS)).alias("at")).distinct()
    blocks = places.repartition(in_parts(keys), F.floor(F.col("at") / BLOCK_BITS)).mapInArrow(built, "block long, bits binary")
    bits = blocks.repartition(1).mapInArrow(joined, "bits binary").scalar()
    at = F.pmod(key, F.lit(FILTER_BITS))
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.filter(F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once, also where use mentions it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Sets up to which all that aren't connected yet are compared, without an index.
FEW = 8


def jaccard_reaches(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sets, as sorted arrays, reach a Jaccard of least; their lengths may rule it out."""
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two runs to merge
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared >= least * (n + m - shared)


def spanning_pairs(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of places in sets, sorted arrays of hashes, with a Jaccard of least: enough of them to connect all that such
    pairs connect.

    Sets that reach least share one of the first few items of either: only those meet. They are indexed by component, so
    a component that is connected already costs one look."""
    parent = list(range(len(sets)))
    out = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def linked(i: int, j: int) -> bool:
        if jaccard_reaches(sets[i], sets[j], least):
            parent[find(i)] = find(j)
            out.append((i, j))
            return True
        return False

    if len(sets) <= FEW:
        for i in range(1, len(sets)):
            for j in range(i):
                if find(i) != find(j):
                    linked(i, j)
        return out
    index: dict = {}
    for i, own in enumerate(sets):
        n = len(own)
        prefix = own[: n - math.ceil(n * least - 1e-9) + 1].tolist() if n else [None]
        seen = set()
        for x in prefix:
            for root, members in index.get(x, {}).items():
                if find(root) != find(i):
                    for j in members:
                        if j not in seen:
                            seen.add(j)
                            if linked(i, j):
                                break
        mine = find(i)
        for x in prefix:
            index.setdefault(x, {}).setdefault(mine, []).append(i)
    return out


#: Written edges, 16 bytes each before compression, that one task joins.
ONE_TASK_BYTES = 8 << 20


@released
def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of a task; the smaller root wins, so a root is its component's smallest node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b) of longs: component is the smallest node reachable.

    Edges of at most ONE_TASK_BYTES, as written, are joined by one task's union-find. Beyond that large star and small
    star take turns, each a grouped minimum and a join that AQE splits where a node is hot; the edges are written after
    each round, so a lost executor costs one round, and rounds end when one changes nothing.
    """
    spark = links.sparkSession
    both = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = written(both, "edges"), None
    if small(edges, ONE_TASK_BYTES):
        return edges.repartition(1).mapInArrow(_united, "node long, component long")
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0)).alias("h")).first()
        if state == seen:
            break
        seen = state
        around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        to_least = large.join(least, "u")
        out = to_least.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v")
        edges = written(out.distinct(), "edges")
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = nodes.select(F.col("component").alias("node"), "component").distinct()
    return nodes.unionAll(roots)
