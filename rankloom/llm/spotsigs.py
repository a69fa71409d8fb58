"""SpotSigs: chains of content words after common words, as document fingerprints."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import components, documents
from rankloom.llm.quality import STOP_WORDS
from rankloom.llm.simhash import LEAST, band_keys, band_links, verified_groups
from rankloom.llm.tokens import batches_of
from rankloom.session import written

ANCHORS = frozenset(STOP_WORDS.split())
TERM = regex.compile(r"[^\W_]+")
#: Bands of MinHashes of the signatures, and rows of each.
BANDS, ROWS = 16, 5
#: Words that a worker remembers before it starts anew.
MOST_WORDS = 150_000


class _Words(dict):
    """64-bit hash of a word, its last bit set for anchors."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        h = self[word] = h | 1 if word in ANCHORS else h & ~1
        return h


_WORDS = _Words()
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def spot_signatures(text: str | None) -> np.ndarray:
    """The sorted set of 32-bit signatures: each anchor with the next two content words, anchors between them skipped.

    A text without any is one signature of all its words, and one without words of itself (null: empty)."""
    shown = (text or "").lower()
    words = TERM.findall(shown)
    if len(_WORDS) > MOST_WORDS:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    anchor = (h & np.uint64(1)).astype(bool)
    content = h[~anchor]
    before = np.cumsum(~anchor)[anchor]  # content words before each anchor
    whole = before + 1 < len(content)
    at = before[whole]
    with np.errstate(over="ignore"):
        found = h[anchor][whole] * _ODD[0] + content[at] * _ODD[1] + content[at + 1] * _ODD[2] if len(at) else np.empty(0, np.uint64)
        found ^= found >> np.uint64(32)
        found *= _ODD[0]
    if len(found):
        return np.unique((found >> np.uint64(32)).astype(np.uint32))
    return np.array([xxhash.xxh32_intdigest((" ".join(words) or shown).encode("utf-8", "surrogatepass"), 1)], dtype=np.uint32)


def fingerprint(signatures: np.ndarray) -> str:
    """The set itself: Base64 of the ascending signatures as little-endian 32-bit integers, so that the likeness of two
    fingerprints follows from them alone."""
    return base64.b64encode(signatures.astype("<u4").tobytes()).decode("ascii")


def signatures_of(shown: str) -> np.ndarray:
    """The set that a fingerprint shows."""
    return np.frombuffer(base64.b64decode(shown), dtype="<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two ascending sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / (len(both) - shared)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many, or all, of the following text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(docs: DataFrame, classes: DataFrame, partitions: int) -> DataFrame:
    """(bucket, extra, doc_id, class_id, text) dealt and sorted so that each row's follower, by descending doc_id and then
    text, comes next. A bucket is a range of ids; the first rows of the next lower bucket are sent along with it as extra
    rows, those of the highest with the lowest. Texts are shuffled once; rows of classes (id, class_id) go with them, each
    before the documents of its id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = rows.agg(F.percentile_approx("doc_id", [i / partitions for i in range(1, partitions)], 100 * partitions)).first()[0] or []
    cuts = sorted(set(cuts))
    # a bucket's number is the number of cuts below the id, found by halving
    held = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    bucket = _cuts_below(held, len(cuts), F.col("doc_id"))
    rows = rows.withColumn("bucket", bucket)
    firsts = sorted((r["bucket"], r["top"]) for r in rows.filter("doc_id is not null").groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    no_class = F.lit(None).cast("long").alias("class_id")
    if not firsts:
        return rows.select("bucket", F.lit(0).alias("extra"), "doc_id", no_class, "text").filter("false")
    names = [b for b, _ in firsts]
    above = {top: names[(i + 1) % len(names)] for i, (_, top) in enumerate(firsts)}
    # a row for each bucket: as many as partitions
    tops = docs.sparkSession.createDataFrame(list(above.items()), "_top long, _above int")
    own = F.struct("bucket", F.lit(0).alias("extra"))
    places = F.when(F.col("_above").isNotNull(), F.array(own, F.struct(F.col("_above").alias("bucket"), F.lit(1).alias("extra")))).otherwise(F.array(own))
    dealt = rows.join(F.broadcast(tops), F.col("doc_id") == F.col("_top"), "left").filter("doc_id is not null").select(F.explode(places).alias("p"), "doc_id", "text").select("p.bucket", "p.extra", "doc_id", no_class, "text")
    named = classes.select(F.col("id").alias("doc_id"), "class_id").filter("doc_id is not null and class_id is not null").select(bucket.alias("bucket"), F.lit(0).alias("extra"), "doc_id", "class_id", F.lit(None).cast("string").alias("text"))
    return dealt.unionAll(named).repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "extra", F.desc("doc_id"), F.col("class_id").asc_nulls_last(), F.col("text").asc_nulls_first())


def _cuts_below(held, n: int, value):
    """How many of n sorted numbers are below value: halving, a step for each bit of n."""
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda found, step: F.when((found + step <= n) & (F.get(held, found + step - 1) < value), found + step).otherwise(found))


OUTPUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"


def compared_with_following(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text), with the fingerprints of its text and of its edited text, their likeness,
    and the class of spot_classes.

    Rows with equal doc_ids are ordered by text, nulls first as empty; rows without a doc_id go. Texts have any length; a
    table of one row follows itself, an empty one gives an empty one; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, of one bucket
        known = (None, None)  # the last class and its id

        def compare(rows: list[tuple]) -> pa.RecordBatch | None:
            nonlocal held, known
            out = []
            for bucket, extra, doc, kind, text in rows:
                if kind is not None:
                    known = doc, kind
                    continue
                text = text or ""
                sigs = None
                if held is not None and held[0] == bucket:
                    _, old, before, own, named = held
                    sigs = spot_signatures(text)
                    new = edited(before, text)
                    changed = spot_signatures(new)
                    out.append((old, len(before), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(own), fingerprint(changed), likeness(own, changed), likeness(own, sigs), named))
                # an extra row ends its bucket: only the first of equal ids follows
                held = None if extra else (bucket, doc, text, spot_signatures(text) if sigs is None else sigs, known[1] if known[0] == doc else doc)
            if not out:
                return None
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"])

        for b in batches:
            for a, texts in batches_of(b.column(4), 4_000_000):
                n = len(texts)
                rows = list(zip(*(b.column(c).slice(a, n).to_pylist() for c in range(4)), texts, strict=True))
                if (out := compare(rows)) is not None:
                    yield out

    n = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return with_following(docs, written(spot_classes(docs), "classes"), n).mapInArrow(run, OUTPUT)


def spot_classes(docs: DataFrame) -> DataFrame:
    """Near-duplicates by their fingerprints: (id, class_id) for each id, class_id being the smallest id reachable by links
    of a Jaccard of LEAST or more. Ids with equal sets of signatures are one from the start.

    Sets meet if they share a band of MinHashes (BANDS of ROWS: a pair at 0.8 is missed with 0.2 %), are partitioned there
    where lengths grow by more than 1 / LEAST, and are compared by whole sets, with lengths that rule a pair out first.
    An id with several texts gets the least of their classes; a null id is the least and null in the result."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, texts in batches_of(b.column(1), 4_000_000):
                sets = [spot_signatures(t) for t in texts]
                same = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                bands = [band_keys(s.astype(np.uint64) << np.uint64(32), BANDS, ROWS).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(texts)), pa.array(same, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.binary())], names=["id", "same", "n", "bands"])

    rows = written(docs.mapInArrow(run, "id long, same binary, n long, bands binary"), "spots")
    reps = rows.groupBy("same").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    groups = written(components(written(band_links(reps, LEAST), "links")).select("node", F.col("component").alias("g")), "groups")
    parts = components(written(verified_groups(docs, groups, spot_signatures, LEAST, np.int32), "verified"))
    named = reps.select("same", "node").join(parts, "node", "left").select("same", F.coalesce("component", "node").alias("class_id"))
    shown = (F.when(F.col(c) != F.lit(-(2**63)), F.col(c)).alias(c) for c in ("id", "class_id"))
    return rows.select("id", "same").join(named, "same").groupBy("id").agg(F.min("class_id").alias("class_id")).select(*shown)


def op1_spotsigs(spark, sf_dir: str) -> DataFrame:
    return compared_with_following(documents(spark, sf_dir))
