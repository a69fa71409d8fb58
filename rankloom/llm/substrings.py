"""Removal of repeated substrings: suffixes are sorted one bucket at a time, long ties go by ranks of a sample.

Every window of `length` bytes has an anchor: of the hashes of its GRAM-byte strings the least, the leftmost of equal
ones. Equal windows have equal anchors at equal places, so the anchors are a sample that covers all pairs of equal
windows, at about 2 / (length - GRAM + 2) of the places. The windows of one anchor are neighbours and start in a
range; the bytes that they span together give the anchor its class.

1. Anchors are dealt by their string. An anchor whose class occurs before is a long tie: all its windows start
   earlier too, and nothing of it is compared again. Anchors whose string is unique are done.
2. What is left - the first of each class where a string has several classes - is a suffix bucket: the windows, as
   strings of length bytes, are sorted, and of equal neighbours all but the first start earlier.
3. The removed windows meet their document, and the covered bytes go.

Strings that are very common in a block of text (over HOT classes), or in all (over HOT_IN_ALL), skip step 2's buckets:
their windows are dealt by their own hash, after repeats within what is cut out together are settled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import documents
from rankloom.session import written

LENGTH, GRAM = 100, 32
#: Bytes of text that are handled together; bytes and windows that are cut out together.
BLOCK, CUT_BYTES, CUT_WINDOWS = 2 << 20, 2 << 20, 50_000
#: Classes of one string in a block, and in all, beyond which its windows are dealt by their own hash.
HOT, HOT_IN_ALL = 64, 1024
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
RECORD = np.dtype([("a", "<u8"), ("h", "<u8"), ("doc", "<i8"), ("tie", "<u4"), ("s", "<u4"), ("at", "u1"), ("n", "u1")])
#: Kinds of found windows: they start earlier; compare in the anchor's bucket; compare in buckets of their own.
GONE, BUCKET, OWN = 0, 1, 2


def _table() -> np.ndarray:
    """A 64-bit number for each byte."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "big") for b in range(256)], dtype=np.uint64)


TABLE = _table()


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [_powers(max(n, BLOCK + 1), MULTIPLIER), _powers(max(n, BLOCK + 1), INVERSE)]
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any substring of x, from one pass."""

    def __init__(self, x: np.ndarray):
        up, self.down = powers(len(x) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[x] * up[: len(x)], dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width keys: running minima within aligned blocks, from both sides."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    right = np.minimum.accumulate(rows, axis=1).ravel()
    left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def anchors(x: np.ndarray, owner: np.ndarray, base: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, Hashes | None, np.ndarray]:
    """Records of the windows of x: a, h, and s, at, n (doc holds the number of the text). owner: the text of each
    byte; base: where texts start. Also the hashes, and where each record's windows start in x."""
    if len(x) < length:
        return np.empty(0, RECORD), None, np.empty(0, np.int64)
    hashes = Hashes(x)
    place = np.arange(len(x) - GRAM + 1)
    grams = hashes.of(place, place + GRAM)
    # up to 2^24 places in a block: 40 bits of hash order the strings, then the place
    least = sliding_least((grams & ~np.uint64((1 << 24) - 1)) | place.astype(np.uint64), length - GRAM + 1)
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    n = len(x) - length + 1
    good = owner[:n] == owner[length - 1 :]
    first = good.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~good[:-1] | (owner[1:n] != owner[: n - 1])
    starts = np.flatnonzero(first)
    # a run of windows ends before the next first one, or where windows stop being good
    stops = np.flatnonzero(good & np.concatenate([first[1:] | ~good[1:], [True]])) + 1
    out = np.empty(len(starts), RECORD)
    out["a"] = grams[at[starts]]
    out["h"] = hashes.of(starts, stops - 1 + length) + (at[starts] - starts).astype(np.uint64)
    out["doc"] = owner[starts]
    out["s"] = starts - base[owner[starts]]
    out["at"] = at[starts] - starts
    out["n"] = stops - starts
    return out, hashes, starts


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of a string or binary column start and end, and all bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype="<i8" if wide else "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)


def pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to about most."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return ((a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of (doc, tie, text) up to about BLOCK bytes together: bytes, owner, base, doc, tie. Longer texts are on
    their own, in overlapping parts that each count windows of their own."""
    text = batch.column(2)
    offsets, data = buffers(text)
    doc, tie = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, side="right")) - 1)
        size = int(offsets[b] - offsets[a])
        if size <= BLOCK:
            base = offsets[a:b] - offsets[a]
            yield data[offsets[a] : offsets[b]], np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1])), base, doc[a:b], tie[a:b]
        else:  # one long text: parts share LENGTH - 1 bytes, so that each window is in one part
            for p in range(0, size - LENGTH + 1, BLOCK - LENGTH + 1):
                part = data[offsets[a] + p : min(offsets[a] + p + BLOCK, offsets[b])]
                yield part, np.zeros(len(part), np.int64), np.array([-p]), doc[a : a + 1], tie[a : a + 1]
        a = b


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, tie, text): a null text is empty, a null id the least; tie tells texts of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.crc32(text.cast("binary")).alias("tie"), text.alias("text"))


def _rows(kind: int, bucket, r: np.ndarray) -> pa.RecordBatch:
    n = len(r)
    cols = [np.full(n, kind, np.int8), (bucket if len(np.shape(bucket)) else np.zeros(n, np.uint64)).view(np.int64), r["doc"], r["tie"].astype(np.int64), r["s"].astype(np.int64), r["n"].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["kind", "bucket", "doc", "tie", "s", "n"])


FOUND = "kind byte, bucket long, doc long, tie long, s long, n int"


def _firsts(keys: list[np.ndarray]) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    out = np.zeros(len(keys[0]), dtype=bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _ordered(r: np.ndarray) -> np.ndarray:
    """By string, class and place, each place once."""
    r = r[np.lexsort((r["s"], r["tie"], r["doc"], r["h"], r["a"]))]
    return r[_firsts([r[k] for k in ("a", "h", "doc", "tie", "s")])]


def found_windows(docs: DataFrame) -> DataFrame:
    """Step 1: rows of FOUND, written."""
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, owner, base, doc, tie in blocks(batch):
                r, _, _ = anchors(x, owner, base)
                if not len(r):
                    continue
                r["tie"] = tie[r["doc"]]
                r["doc"] = doc[r["doc"]]
                r = _ordered(r)
                new = _firsts([r["a"], r["h"]])
                gone, r = r[~new], r[new]
                # strings with many classes here
                heads = np.flatnonzero(_firsts([r["a"]]))
                counts = np.diff(np.append(heads, len(r)))
                hot = np.repeat(counts > HOT, counts)
                marks = r[heads[counts > HOT]].copy()
                marks["n"], marks["s"] = 0, 0xFFFFFFFF  # not a place of any text
                own = r[hot]
                send = np.concatenate([r[~hot], marks])
                to = (send["a"] >> np.uint64(40)) % np.uint64(parts)
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(parts + 1))
                out = [(p, BUCKET, send[order[edges[p] : edges[p + 1]]]) for p in range(parts) if edges[p + 1] > edges[p]]
                aside = (int(doc[0]) * 0x9E3779B1 >> 12) % parts  # what needs no more dealing spreads by block
                out += [(aside, k, v) for k, v in ((GONE, gone), (OWN, own)) if len(v)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int8()), pa.array([o[2].tobytes() for o in out], pa.binary())], names=["part", "kind", "records"])

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        part = None

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            r = _ordered(np.concatenate(held))
            held.clear()
            heads = np.flatnonzero(_firsts([r["a"]]))
            counts = np.diff(np.append(heads, len(r)))
            marked = np.repeat((np.add.reduceat(r["n"] == 0, heads) > 0) | (counts > HOT_IN_ALL), counts)
            real = r["n"] > 0
            own, r = r[marked & real], r[~marked]
            new = _firsts([own["a"], own["h"]])
            yield _rows(GONE, 0, own[~new])
            yield _rows(OWN, 0, own[new])
            new = _firsts([r["a"], r["h"]]) if len(r) else np.empty(0, bool)
            yield _rows(GONE, 0, r[~new])
            r = r[new]
            if len(r):
                heads = np.flatnonzero(_firsts([r["a"]]))
                counts = np.diff(np.append(heads, len(r)))
                several = np.repeat(counts > 1, counts)
                yield _rows(BUCKET, r["a"][several], r[several])

        for b in batches:
            for p, kind, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    yield from done()
                    part = p
                r = np.frombuffer(blob, dtype=RECORD)
                if kind == BUCKET:
                    held.append(r)
                else:
                    yield _rows(kind, 0, r)
        yield from done()

    sampled = keyed(docs).mapInArrow(sample, "part int, kind byte, records binary")
    dealt = sampled.repartition(parts, "part").sortWithinPartitions("part")
    return written(dealt.mapInArrow(classes, FOUND), "found", "zstd")


def compared_windows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Step 2: (doc, tie, s, n) of windows that start earlier, among those left in buckets."""
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = found.filter(F.col("kind") != GONE).groupBy("doc", "tie").agg(F.collect_list(F.struct("kind", "bucket", "s", "n")).alias("w"))
    texts = keyed(docs)
    joined = texts.join(wanted, ["doc", "tie"]).select("doc", "tie", F.encode("text", "UTF-8").alias("text"), "w.kind", "w.bucket", "w.s", "w.n")

    odd = powers(16)[0][1 : 1 + -(-LENGTH // 8)]

    def rows_of(bucket, doc, tie, s, at, size, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The strings of size bytes from data at their places."""
        for a, b in pieces(size, CUT_BYTES):
            n = size[a:b]
            ends = np.cumsum(n)
            found = data[np.repeat(at[a:b] - (ends - n), n) + np.arange(ends[-1])]
            held = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.concatenate([[0], ends]).astype("<i4")), pa.py_buffer(found)])
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c[a:b])) for c in (bucket, doc, tie, s)], held], names=["bucket", "doc", "tie", "s", "bytes"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column(2))
            row = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column(3).value_lengths()))
            doc, tie = np.asarray(batch.column(0))[row], np.asarray(batch.column(1))[row]
            kind, bucket, s, n = (np.asarray(batch.column(c).flatten()) for c in range(3, 7))
            at, n = offsets[row] + s, n.astype(np.int64)
            k = np.flatnonzero(kind == BUCKET)
            yield from rows_of(bucket[k], doc[k], tie[k], s[k], at[k], n[k] - 1 + LENGTH, data)
            own = np.flatnonzero(kind == OWN)
            for a, b in pieces(n[own], CUT_WINDOWS):
                runs = own[a:b]
                inner = np.arange(n[runs].sum()) - np.repeat(np.cumsum(n[runs]) - n[runs], n[runs])
                k = np.repeat(runs, n[runs])
                d, t, place, start = doc[k], tie[k], s[k] + inner, at[k] + inner
                window = np.zeros((len(k), 8 * len(odd)), dtype=np.uint8)
                window[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[start]
                with np.errstate(over="ignore"):
                    h = mixed((window.view("<u8") * odd).sum(axis=1, dtype=np.uint64))
                order = np.lexsort((place, t, d, h))
                d, t, place, start, h = d[order], t[order], place[order], start[order], h[order]
                # of equal windows the first is sent; the others are settled here
                same = np.flatnonzero(h[1:] == h[:-1]) + 1
                same = same[(window[order[same]] == window[order[same - 1]]).all(axis=1)]
                sent = np.ones(len(h), dtype=bool)
                sent[same] = False
                yield from rows_of(h[sent].view(np.int64), d[sent], t[sent], place[sent], start[sent], np.full(int(sent.sum()), LENGTH), data)
                gone = same[(d[same] != d[same - 1]) | (t[same] != t[same - 1]) | (place[same] != place[same - 1])]
                if len(gone):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(gone), pa.int64()), pa.array(d[gone]), pa.array(t[gone]), pa.array(place[gone]), pa.array([b""] * len(gone), pa.binary())], names=["bucket", "doc", "tie", "s", "bytes"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch | None:
            """Sorts the windows of whole buckets as suffixes of length bytes."""
            data = t.column("bytes").combine_chunks()
            data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
            ends = np.frombuffer(data.buffers()[1], dtype="<i4")[data.offset : data.offset + len(data) + 1].astype(np.int64)
            x = np.frombuffer(data.buffers()[2], dtype=np.uint8)
            n = np.diff(ends) - LENGTH + 1
            row = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            doc, tie, s = (np.asarray(t.column(k).combine_chunks()) for k in ("doc", "tie", "s"))
            key = (doc[row], tie[row], s[row] + inner)
            order = np.lexsort(key[::-1])
            views = np.lib.stride_tricks.sliding_window_view(x, LENGTH)
            out = []
            windows = np.ascontiguousarray(views[(ends[row] + inner)[order]]).view(f"S{LENGTH}").ravel()
            by = np.argsort(windows, kind="stable")
            windows, order = windows[by], order[by]
            same = np.flatnonzero(windows[1:] == windows[:-1]) + 1
            heads = np.arange(len(windows))
            first = np.ones(len(windows), bool)
            first[same] = False
            heads = np.maximum.accumulate(np.where(first, heads, 0))
            lost, kept = order[same], order[heads[same]]
            later = (key[0][lost] != key[0][kept]) | (key[1][lost] != key[1][kept]) | (key[2][lost] != key[2][kept])
            out = np.sort(lost[later])
            if not len(out):
                return None
            # neighbours of one row become runs
            cut = np.concatenate([[True], (np.diff(out) != 1) | (np.diff(row[out]) != 0)])
            heads = out[cut]
            sizes = np.diff(np.append(np.flatnonzero(cut), len(out)))
            return pa.RecordBatch.from_arrays([pa.array(key[0][heads]), pa.array(key[1][heads]), pa.array(key[2][heads]), pa.array(sizes.astype(np.int32))], names=["doc", "tie", "s", "n"])

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """Buckets together, up to about 60,000 windows."""
            lengths = np.asarray(pa.compute.binary_length(rows.column("bytes"))) - LENGTH + 1
            bucket = np.asarray(rows.column("bucket"))
            heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            sums = np.concatenate([[0], np.cumsum(lengths)])
            at = 0
            while at < len(heads):
                to = max(at + 1, int(np.searchsorted(sums[heads], sums[heads[at]] + 60_000)))
                end = heads[to] if to < len(heads) else len(bucket)
                if end - heads[at] > 1 and (out := done(rows.slice(heads[at], end - heads[at]))) is not None:
                    yield out
                at = to

        import pyarrow.compute  # noqa: F401

        for b in batches:
            gone = pa.compute.is_null(b.column(0))
            if pa.compute.any(gone).as_py():
                g = b.filter(gone)
                yield pa.RecordBatch.from_arrays([g.column(1), g.column(2), g.column(3), pa.array(np.ones(g.num_rows, np.int32))], names=["doc", "tie", "s", "n"])
                b = b.filter(pa.compute.invert(gone))
            if b.num_rows:
                bucket = np.asarray(b.column(0))
                held.append(b)
                last = np.flatnonzero(bucket != bucket[-1])
                if len(last):
                    cut = int(last[-1]) + 1
                    whole = pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
                    held[:] = [b.slice(cut)]
                    yield from flush(whole)
        if held:
            yield from flush(pa.Table.from_batches(held))

    cut = joined.mapInArrow(slices, "bucket long, doc long, tie long, s long, bytes binary")
    # what is settled has no bucket: it is dealt by its place
    dealt = cut.withColumn("_to", F.coalesce(F.col("bucket"), F.xxhash64("doc", "s"))).repartition(parts, "_to").drop("_to").sortWithinPartitions("bucket")
    return written(dealt.mapInArrow(sort, "doc long, tie long, s long, n int"), "compared", "zstd")


def removed_spans(starts: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Removed runs of bytes, from windows by start and count."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate((starts + counts - 1 + length)[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    heads = np.flatnonzero(new)
    return list(zip(a[heads].tolist(), b[np.append(heads[1:], len(a)) - 1].tolist(), strict=True))


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of docs (doc_id, text): kept is what is left of the
    text's UTF-8 bytes, in order.

    A byte goes if a string of LENGTH bytes over it starts earlier too: in a smaller doc_id, or before in the same
    text. Texts of one doc_id are ordered by CRC-32; equal rows are one document and get equal results. Null and
    short texts lose nothing."""
    found = found_windows(docs)
    more = compared_windows(docs, found)
    runs = found.filter(F.col("kind") == GONE).select("doc", "tie", "s", "n").unionAll(more)
    grouped = runs.groupBy("doc", "tie").agg(F.collect_list(F.struct("s", "n")).alias("w"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch.column(1))
            ends = np.cumsum(np.asarray(batch.column(2).value_lengths().fill_null(0)))
            starts, counts = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in (2, 3))
            for a, b in pieces(np.diff(offsets), CUT_BYTES):
                out = []
                for i in range(a, b):
                    text, mine = data[offsets[i] : offsets[i + 1]], slice(ends[i - 1] if i else 0, ends[i])
                    spans = removed_spans(starts[mine], counts[mine])
                    edges = [0, *(x for span in spans for x in span), len(text)]
                    kept = b"".join(text[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True))
                    out.append((len(text), len(text) - len(kept), len(spans), kept))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = keyed(docs).join(grouped, ["doc", "tie"], "left").select("doc", F.encode("text", "UTF-8").alias("text"), "w.s", "w.n")
    out = joined.mapInArrow(remove, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc") != F.lit(-(2**63)), F.col("doc"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
