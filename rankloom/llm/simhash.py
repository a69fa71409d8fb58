"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import components, documents, in_parts, maybe_among, released, spanning_pairs
from rankloom.llm.tokens import batches_of
from rankloom.session import written

BITS = 64
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Groups of at most so many fingerprints are compared pair by pair, in blocks; larger ones are split further first.
DIRECT = 1500


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of size words, with repeats; fewer words: of all of them; none: empty. A-Z are
    lower-cased; words are parted by space and \\t \\n \\v \\f \\r."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - size + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[min(size, len(words)) - 1 :].tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(raw) < 500:
        count = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    else:  # how often each byte occurs in each place, times its bits
        count = np.concatenate([np.bincount(raw[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(count * 2 > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(df: DataFrame, size: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer. A null or empty text has 0."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = []
            for _, texts in batches_of(b.column(1), 16_000_000):
                fps += [signed(majority(shingle_hashes(t, size))) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, fp long")


def covering_masks(radius: int, places: list[int] | None = None) -> list[int]:
    """2^(radius+1) - 1 masks such that any two numbers that differ in at most radius bits agree on all bits of one.

    Each bit place gets a label of radius+1 bits, not 0, in turn. The mask of v keeps the places whose label has an odd
    number of bits in common with v. For up to radius differing places some v other than 0 has an even number with each
    of their labels, as radius linear equations have a solution in radius+1 unknowns: that mask keeps none of them.
    """
    places = list(range(BITS)) if places is None else places
    top = (1 << (radius + 1)) - 1
    label = {p: i % top + 1 for i, p in enumerate(places)}
    return [sum(1 << p for p in places if (label[p] & v).bit_count() % 2) for v in range(1, top + 1)]


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def spanning_links(fps: np.ndarray, radius: int, free: int = (1 << BITS) - 1) -> list[tuple[int, int]]:
    """Links (i, j) that connect the fingerprints as all pairs within radius would. free: the bits in which they may
    differ. Large groups are split by covering masks over the free bits, again and again, so that what is compared
    directly is small; pairs that are connected already cost nothing more than the comparison."""
    out: list[tuple[int, int]] = []
    parent = np.arange(len(fps))

    def direct(at: np.ndarray) -> None:
        own = fps[at]
        for a in range(0, len(at), 512):
            near = np.bitwise_count(own[a : a + 512, None] ^ own[None, :]) <= radius
            for i, j in np.argwhere(near):
                x, y = _find(parent, at[a + i]), _find(parent, at[j])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(at[a + i]), int(at[j])))

    def split(at: np.ndarray, bits: int) -> None:
        places = [p for p in range(BITS) if bits >> p & 1]
        if len(at) <= DIRECT or len(places) <= radius + 1:
            direct(at)
            return
        for mask in covering_masks(radius, places):
            keys = fps[at] & np.uint64(mask)
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.diff(keys[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    split(at[part], bits & ~mask)

    split(np.arange(len(fps)), free)
    return out


def links(reps: DataFrame, radius: int, spanning: bool = True) -> DataFrame:
    """(a, b) of node numbers from rows (node, fp) with distinct fp, within radius; enough of them to connect all that
    any link connects. Each row goes to one bucket for each mask; a bucket's rows agree on half of the bits and are
    distinct, so it holds 16 bytes for each at most, and its links are fewer than its rows."""
    masks = covering_masks(radius)
    spark = reps.sparkSession
    tables = F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = reps.select("node", "fp", F.explode(tables).alias("t")).select("t.table", "t.key", "node", "fp")
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(n, "table", "key").sortWithinPartitions("table", "key", "node")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the bucket that the next batch may go on with

        def linked(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            table, key, node, fp = cols
            cuts = np.flatnonzero((np.diff(table) != 0) | (np.diff(key) != 0)) + 1
            edges = [0, *cuts.tolist(), len(table)]
            sizes = np.diff(edges)
            a, b = [], []
            for k in np.flatnonzero(sizes > 1):
                at, to = edges[k], edges[k + 1]
                free = ~masks[int(table[at])] & ((1 << BITS) - 1)
                for i, j in spanning_links(fp[at:to].view(np.uint64), radius, free):
                    a.append(node[at + i])
                    b.append(node[at + j])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if a else None

        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = [c[cut:] for c in cols]
            if cut and (out := linked([c[:cut] for c in cols])) is not None:
                yield out
        if held is not None and (out := linked(held)) is not None:
            yield out

    return dealt.mapInArrow(run, "a long, b long")


def near_components(fps: DataFrame, radius: int) -> DataFrame:
    """(id, fp, component_id) of rows (id, fp): component_id is the smallest id reachable by links within radius, the
    own one included. Equal fingerprints meet once, as their smallest id. Works on empty tables; repeated ids are kept
    as rows."""
    reps = written(fps.groupBy("fp").agg(F.min("id").alias("node")), "reps")
    parts = components(links(reps, radius))
    named = reps.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    fps = written(with_fingerprint(documents(spark, sf_dir), 3), "fingerprints")
    out = near_components(fps, 3)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near duplicates by likeness ------------------------------------------------------------------------------------
#: Words of a shingle, the Jaccard that a link must reach, and the radius of the covering masks over SimHashes of the
#: same shingles. Pairs at 0.8 differ in about 9 of 64 bits, so the masks catch the closest pairs only.
WORDS, LEAST, RADIUS = 5, 0.8, 3
#: Bands of the MinHash of the compared sets, and rows of each: whatever the edit, a pair at 0.8 shares one of them with
#: 1 - (1 - 0.8^6)^32 = 99.99 %.
BANDS, ROWS = 32, 6
#: Documents that one task compares; larger groups become a grid of pairs of such chunks.
CHUNK = 4000


@functools.cache
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 32, (n, 1), dtype=np.uint32) | np.uint32(1)


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 32-bit key for each band of a set of hashes: of its number and the minima of permuted hashes. Keys that meet by
    chance only cost a comparison."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, (1 << 32) - 1, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 1024):  # in pieces that stay in the processor's cache; an odd factor permutes
            np.minimum(least, (h[at : at + 1024] * _factors(bands * rows)).min(axis=1), out=least)
        key = np.arange(1, bands + 1, dtype=np.uint64)
        for row in least.reshape(bands, rows).T:
            key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
    return (key >> np.uint64(32)).astype(np.uint32)


def digests(docs: DataFrame) -> DataFrame:
    """(id, same, fp, n, bands): same tells equal texts, null as empty; n: how many different shingles a text has."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, texts in batches_of(b.column(1), 4_000_000):
                same, fps, n, bands = [], [], [], []
                for t in texts:
                    h = shingle_hashes(t, WORDS)
                    n.append(len(np.unique(h)))
                    same.append(xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")))
                    fps.append(signed(majority(h)))
                    bands.append(band_keys(h).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(texts)), pa.array(same, pa.binary()), pa.array(fps, pa.int64()), pa.array(n, pa.int64()), pa.array(bands, pa.binary())], names=["id", "same", "fp", "n", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, same binary, fp long, n long, bands binary")


def covering_links(reps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): what links() connects for rows (node, fp) of which some share a fingerprint."""
    heads = written(reps.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    equal = reps.select("node", "fp").join(heads, "fp").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return links(heads.select(F.col("head").alias("node"), "fp"), radius).unionAll(equal)


#: A band key of a set of n hashes.
PAIR = np.dtype([("key", "<u4"), ("n", "<u4"), ("node", "<i8")])


def band_links(reps: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b) for rows (node, n, bands): the nodes of each band key, in order of n, as chains. A chain is cut where n grows
    by more than 1 / least: no sets from both sides reach least. Keys and nodes travel as packed arrays."""
    parts = in_parts(reps)

    @released
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint32)
            pairs = np.empty(len(keys), dtype=PAIR)
            pairs["key"] = keys
            pairs["n"] = np.repeat(np.minimum(np.asarray(b.column(1)), (1 << 32) - 1), len(keys) // b.num_rows)
            pairs["node"] = np.repeat(np.asarray(b.column(0)), len(keys) // b.num_rows)
            to = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts)
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(edges)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pairs[order[edges[p] : edges[p + 1]]].tobytes() for p in some], pa.binary())], names=["part", "pairs"])

    @released
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                pairs = np.concatenate(held)
                held.clear()
                pairs = pairs[np.lexsort((pairs["node"], pairs["n"], pairs["key"]))]
                n = pairs["n"].astype(np.float64)
                near = np.flatnonzero((pairs["key"][1:] == pairs["key"][:-1]) & (n[:-1] >= least * n[1:] - 1e-9))
                node = np.ascontiguousarray(pairs["node"])
                yield pa.RecordBatch.from_arrays([pa.array(node[near]), pa.array(node[near + 1])], names=["a", "b"])

        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != part:
                    yield from done()
                    part = p
                held.append(np.frombuffer(blob, dtype=PAIR))
        yield from done()

    dealt = reps.select("node", "n", "bands").mapInArrow(deal, "part int, pairs binary").repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(link, "a long, b long")


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, WORDS))


def verified_groups(docs: DataFrame, members: DataFrame, hashes: Callable[[str | None], np.ndarray] = shingle_set, least: float = LEAST, kind: type = np.int64) -> DataFrame:
    """(a, b): links of members (node, g) of one group g whose sets hashes(text), ascending and of kind's size, reach a
    Jaccard of least, enough of them to connect what all such pairs of the group connect. Sets are moved, not texts."""
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))

    @released
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, texts in batches_of(b.column(1), 4_000_000):
                found = [hashes(t) for t in texts]
                ends = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(texts)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(kind)))], names=["node", "sh"])

    sizes = members.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("s"))
    chunk = F.pmod(F.xxhash64("node"), F.col("s")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda x: F.struct(F.least(x, F.col("c")).alias("i"), F.greatest(x, F.col("c")).alias("j")))
    dealt = members.join(sizes, "g").withColumn("c", chunk).select("g", "node", F.explode(cells).alias("cell"))
    some = maybe_among(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), F.xxhash64("node"), members.select(F.xxhash64("node")))
    texts = some.mapInArrow(sets, f"node long, sh array<{'int' if kind is np.int32 else 'long'}>")
    rows = dealt.join(texts, "node").select("g", "cell.i", "cell.j", "node", "sh").repartition(parts, "g", "i", "j").sortWithinPartitions("g", "i", "j", "node")

    @released
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, sets, out = None, [], [], []

        def done() -> None:
            nonlocal held, sets
            if len(held) > 1:
                out.extend((held[i], held[j]) for i, j in spanning_pairs(sets, least))
            held, sets = [], []

        for b in batches:
            values, ends = np.asarray(b.column(4).flatten()), np.concatenate([[0], np.cumsum(np.asarray(b.column(4).value_lengths()))])
            for r, (g, i, j, node) in enumerate(zip(*(c.to_pylist() for c in b.columns[:4]), strict=True)):
                if (g, i, j) != cell:
                    done()
                    cell = (g, i, j)
                held.append(node)
                sets.append(values[ends[r] : ends[r + 1]].copy())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out.clear()
        done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(id, component_id) for rows of docs (doc_id, text): documents are linked if their texts are equal, or if their
    sets of WORDS-word shingles reach a Jaccard of LEAST and they are proposed: by SimHashes that collide under a covering
    mask within RADIUS, or by MinHashes that share one of BANDS. component_id is the smallest doc_id that links reach.

    Null texts count as empty, and texts without words are alike; texts have any length. A row has the
    component of its text, also where an id has several. A null id is one id, the least, and null in the result. An empty
    table gives an empty one."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text")
    rows = written(digests(docs), "digests")
    reps = rows.groupBy("same").agg(F.min("id").alias("node"), *(F.first(c).alias(c) for c in ("fp", "n", "bands")))
    near = written(covering_links(reps).unionAll(band_links(reps)), "links")
    groups = written(components(near).select("node", F.col("component").alias("g")), "groups")
    links = written(verified_groups(docs, groups), "verified")
    parts = components(links)
    named = reps.select("same", "node").join(parts, "node", "left").select("same", F.coalesce("component", "node").alias("component_id"))
    shown = (F.when(F.col(c) != F.lit(-(2**63)), F.col(c)).alias(c) for c in ("id", "component_id"))
    return rows.select("id", "same").join(named, "same").select(*shown)
