"""Fuzzy line deduplication by MinHash."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import components, documents, in_parts, maybe_among, released, spanning_pairs
from rankloom.llm.tokens import batches_of
from rankloom.session import written

#: Characters of a shingle, the least similarity, bands and rows of a band (a pair at 0.8 is found with 98.5 %).
SHINGLE, LEAST, BANDS, ROWS = 8, 0.8, 8, 4
#: Distinct lines of a bucket that one task compares; larger buckets become a grid of pairs of such chunks.
CHUNK = 4000
#: Characters whose signatures are made together, so that they stay in the processor's cache.
PIECE = 1 << 17
#: A band key of a line.
PAIR = np.dtype([("key", "<u4"), ("k", "<u8")])


def normal(line: str) -> str:
    """The compared form of a line: lower case, white space as one space."""
    return " ".join(line.lower().split())


#: Lower case of Latin-1, and white space but line ends as spaces.
FOLD = bytes(10 if c == 10 else 32 if chr(c).isspace() else ord(chr(c).lower()) for c in range(256))


def compared_lines(text: str | None) -> Iterator[tuple[int, str]]:
    """(number, compared form) of the lines that aren't blank. Latin-1 texts are folded as bytes, all lines at once."""
    try:
        folded = (text or "").encode("latin-1").translate(FOLD).decode("latin-1")
    except UnicodeEncodeError:
        folded = "\n".join(map(normal, text.split("\n")))
    if "  " in folded:
        folded = re.sub("  +", " ", folded)
    for i, line in enumerate(folded.split("\n")):
        if form := line.strip(" "):
            yield i, form


def key_of(form: str) -> int:
    """A signed 64-bit key of a compared form. Two of n different forms share one with odds of n^2 / 2^65."""
    x = xxhash.xxh3_64_intdigest(form.encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def shingle_sets(forms: list[str]) -> list[np.ndarray]:
    """The sorted set of 64-bit hashes of the shingles of each form of SHINGLE characters or more."""
    chars = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(chars) - SHINGLE + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for k in range(SHINGLE):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += chars[k : k + n]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    out, at = [], 0
    for form in forms:
        own = np.sort(h[at : at + len(form) - SHINGLE + 1])
        new = np.empty(len(own), dtype=bool)
        new[0] = True
        np.not_equal(own[1:], own[:-1], out=new[1:])
        out.append(own[new])
        at += len(form)
    return out


@functools.cache
def _factors() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def _least(forms: list[str]) -> np.ndarray:
    """(forms x BANDS * ROWS) minima of permuted shingle hashes, for forms of about one length: a row of a matrix for
    each form, filled up with its last shingle."""
    chars = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.fromiter(map(len, forms), dtype=np.int64, count=len(forms))
    n = len(chars) - SHINGLE + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint32)
        for k in range(SHINGLE):
            h *= np.uint32(0x9E3779B1)
            h += chars[k : k + n]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(13)
        starts = np.cumsum(sizes) - sizes
        h = h[starts[:, None] + np.minimum(np.arange(int(sizes.max()) - SHINGLE + 1), (sizes - SHINGLE)[:, None])]
        out, mixed = np.empty((BANDS * ROWS, len(forms)), dtype=np.uint32), np.empty_like(h)
        for row, factor in enumerate(_factors()):  # an odd factor permutes the hashes
            np.multiply(h, factor, out=mixed)
            np.min(mixed, axis=1, out=out[row])
    return out.T


def band_keys(forms: list[str]) -> np.ndarray:
    """(forms x BANDS) 32-bit keys: each of ROWS minima of permuted shingle hashes. Forms of SHINGLE characters or more.
    Keys that meet by chance only cost a comparison."""
    sizes = np.fromiter(map(len, forms), dtype=np.int64, count=len(forms))
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    least = np.empty((len(forms), BANDS * ROWS), dtype=np.uint32)
    a = 0
    while a < len(order):
        shortest = int(sizes[a])
        alike = int(np.searchsorted(sizes, shortest * 1.1 + 8, side="right"))  # so that little of a row is filled up
        b = min(alike, a + max(1, PIECE // shortest))
        least[order[a:b]] = _least([forms[i] for i in order[a:b]])
        a = b
    with np.errstate(over="ignore"):
        key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(forms), axis=0)
        for row in range(ROWS):
            key = (key ^ least[:, row::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
    return (key >> np.uint64(32)).astype(np.uint32)


def scanned_lines(docs: DataFrame) -> DataFrame:
    """(doc, tie, no, k, bands) of all compared lines of rows (doc, tie, text), written. bands: the BANDS keys of a form
    as bytes, at its first place in a batch. A line under SHINGLE characters is its only shingle: it is like none but its
    equals, which have its key, and has no bands."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, texts in batches_of(b.column(2), 4_000_000):
                forms: dict[str, int] = {}
                no, own, count = [], [], []
                for t in texts:
                    before = len(no)
                    for i, f in compared_lines(t):
                        no.append(i)
                        own.append(forms.setdefault(f, len(forms)))
                    count.append(len(no) - before)
                if not no:
                    continue
                listed = list(forms)
                keys = np.array([key_of(f) for f in listed], dtype=np.int64)
                long = [i for i, f in enumerate(listed) if len(f) >= SHINGLE]
                bands: list[bytes | None] = [None] * len(listed)
                for i, x in zip(long, band_keys([listed[i] for i in long]), strict=True):
                    bands[i] = x.tobytes()
                row = np.repeat(np.arange(len(texts)) + a, count)
                own = np.array(own)
                first = np.zeros(len(own), dtype=bool)
                first[np.unique(own, return_index=True)[1]] = True
                shown = [bands[i] if new else None for i, new in zip(own.tolist(), first.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(no, pa.int32()), pa.array(keys[own]), pa.array(shown, pa.binary())], names=["doc", "tie", "no", "k", "bands"])

    return written(docs.mapInArrow(run, "doc long, tie long, no int, k long, bands binary"), "lines")


def shared_buckets(lines: DataFrame) -> DataFrame:
    """(bucket, k) of the sets of different lines that share a band key, written. Bands that bring the same lines together
    are one bucket, named by a sum over its keys, so a set is compared once. Pairs travel as packed arrays; a line that
    repeats within a batch counts once there, so a hot line reaches a task once for each batch."""
    parts = in_parts(lines)

    @released
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = np.empty(b.num_rows * BANDS, dtype=PAIR)
            pairs["key"] = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32)
            pairs["k"] = np.repeat(np.asarray(b.column(0)).view(np.uint64), BANDS)
            to = (pairs["key"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts)
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(parts + 1))
            some = np.flatnonzero(np.diff(edges)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pairs[order[edges[p] : edges[p + 1]]].tobytes() for p in some], pa.binary())], names=["part", "pairs"])

    @released
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            pairs = np.concatenate(held)
            held.clear()
            key, k = pairs["key"], pairs["k"]
            order = np.lexsort((k, key))
            key, k = key[order], k[order]
            once = np.concatenate([[True], (key[1:] != key[:-1]) | (k[1:] != k[:-1])])
            key, k = key[once], k[once]
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(heads, len(k)))
            with np.errstate(over="ignore"):
                mixed = k * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                name = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), heads)
            several = np.repeat(sizes > 1, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, sizes)[several].view(np.int64)), pa.array(k[several].view(np.int64))], names=["bucket", "k"])

        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != part:
                    yield from done()
                    part = p
                held.append(np.frombuffer(blob, dtype=PAIR))
        yield from done()

    packed = lines.filter("bands is not null").select("k", "bands").mapInArrow(deal, "part int, pairs binary")
    found = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(shared, "bucket long, k long")
    return written(found.distinct(), "buckets")


def verified_links(docs: DataFrame, places: DataFrame, buckets: DataFrame) -> DataFrame:
    """(a, b) of keys: links of at least LEAST, enough of them to connect what any link within a bucket connects.
    docs: (doc, tie, text); places: (k, doc, tie, no), a line for each key of buckets. A line's text goes from its document
    straight to its buckets."""
    parts = in_parts(buckets)
    large = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK).select("bucket", F.ceil(F.col("n") / CHUNK).cast("int").alias("s"))
    chunk = F.pmod(F.xxhash64("k"), F.col("s")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda x: F.struct(F.least(x, F.col("c")).alias("i"), F.greatest(x, F.col("c")).alias("j")))
    dealt = buckets.join(large, "bucket", "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("c", chunk).select("bucket", "k", F.explode(cells).alias("cell"))
    wanted = dealt.join(places, "k").groupBy("doc", "tie").agg(F.collect_list(F.struct("no", "k", "bucket", "cell.i", "cell.j")).alias("w"))
    some = maybe_among(docs, F.xxhash64("doc", "tie"), places.select(F.xxhash64("doc", "tie")))
    joined = some.join(wanted, ["doc", "tie"]).select("text", *(F.col("w")[c].alias(c) for c in ("no", "k", "bucket", "i", "j")))

    @released
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, texts in batches_of(b.column(0), 4_000_000):
                form = []
                columns = [b.column(c).slice(a, len(texts)) for c in range(1, 6)]
                for text, numbers in zip(texts, columns[0].to_pylist(), strict=True):
                    held = text.split("\n")
                    form += [normal(held[no]) for no in numbers]
                k, bucket, i, j = (c.flatten() for c in columns[1:])
                yield pa.RecordBatch.from_arrays([bucket, i, j, k, pa.array(form, pa.string())], names=["bucket", "i", "j", "k", "form"])

    rows = joined.mapInArrow(lines, "bucket long, i int, j int, k long, form string").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "k")

    @released
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, keys, sets, out = None, [], [], []

        def done() -> None:
            nonlocal keys, sets
            if len(keys) > 1:
                out.extend((min(keys[i], keys[j]), max(keys[i], keys[j])) for i, j in spanning_pairs(sets, LEAST))
            keys, sets = [], []

        for b in batches:
            for a, forms in batches_of(b.column(4), 1_000_000):
                found = shingle_sets(forms)
                for bucket, i, j, k, own in zip(*(c.slice(a, len(forms)).to_pylist() for c in b.columns[:4]), found, strict=True):
                    if (bucket, i, j) != cell:
                        done()
                        cell = (bucket, i, j)
                    if not keys or keys[-1] != k:  # else a repeated row of a document
                        keys.append(k)
                        sets.append(own)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out.clear()
        done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, tie, text) of docs: a null id is the least; tie tells the texts of one id apart. Null texts have no lines."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("tie"), "text")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc, tie, no) of the lines that go: of each component the first place (least doc, tie, then number) stays."""
    rows = keyed(docs).filter("text is not null")
    lines = scanned_lines(rows)
    buckets = shared_buckets(lines)
    first = lines.groupBy("k").agg(F.min(F.struct("doc", "tie", "no")).alias("p"), F.count(F.lit(1)).alias("n"))
    places = written(first.join(buckets.select("k").distinct(), "k", "left_semi").select("k", "p.doc", "p.tie", "p.no"), "places")
    links = written(verified_links(rows, places, buckets).distinct(), "links")
    parts = components(links)
    named = first.join(parts, F.col("k") == F.col("node"), "left").filter("n > 1 or node is not null").withColumn("c", F.coalesce("component", "k"))
    # a key without links is a component of its own
    best = named.groupBy("c").agg(F.min("p").alias("best"))
    kept = named.join(best, "c").select(F.col("k").alias("_k"), "best")
    here = F.struct("doc", "tie", "no")
    return lines.select("doc", "tie", "no", "k").join(kept, F.col("k") == F.col("_k")).filter(here != F.col("best")).select("doc", "tie", "no")


def without_near_lines(docs: DataFrame) -> DataFrame:
    """docs with text without the lines that repeat an earlier one, and _n_lines, _n_removed.

    Lines are parted by \\n. They are alike at a Jaccard of LEAST over their lower-case character shingles, those under
    SHINGLE characters if equal; blank lines stay. Of each component of likeness the line of the smallest doc_id (null
    first), then first in its text, stays. Texts of one doc_id are ordered by their XXH64; equal rows are one document and
    get equal results. Null texts stay null, and lines have any length. Columns named _n_lines or _n_removed are replaced;
    an empty table gives an empty one."""
    gone = dropped_lines(docs).groupBy(F.col("doc").alias("_line_doc"), F.col("tie").alias("_line_tie")).agg(F.collect_set("no").alias("_line_gone"))
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))) == F.col("_line_doc")) & (F.xxhash64("text") == F.col("_line_tie"))
    joined = docs.join(gone, same, "left").drop("_line_doc", "_line_tie")
    split = F.split("text", "\n", -1)
    left = F.concat_ws("\n", F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "_line_gone"), lambda i: F.get(split, i)))
    return joined.withColumns({"_n_lines": F.coalesce(F.size(split), F.lit(0)), "_n_removed": F.coalesce(F.size("_line_gone"), F.lit(0)), "text": F.when(F.col("_line_gone").isNull(), F.col("text")).otherwise(left)}).drop("_line_gone")


def op7_lines(spark, sf_dir: str) -> DataFrame:
    """For each document how many lines it had and lost, and the SHA-256 of what is left (null: of nothing)."""
    out = without_near_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
