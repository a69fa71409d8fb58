"""Best-fit packing, planned over the histogram of lengths."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import documents, released
from rankloom.llm.tokens import batches_of, encoder, vocabulary_path
from rankloom.operators.numbering import small
from rankloom.session import written

ROWS_IN_BIN = 20_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, from_rank, to_rank, each, first_sequence, offset).

    Pieces of a length with ranks from from_rank up to to_rank fill sequences from first_sequence on, each of them with
    `each` pieces side by side, from offset. Sequences with equal room are one class, so the work depends on the
    number of lengths and rooms, which capacity bounds, and not on the number of pieces.
    """
    classes: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, how many)
    rooms: list[int] = []
    out, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in classes:
                bisect.insort(rooms, room)
            classes[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = classes[room].pop()
                if not classes[room]:
                    del classes[room]
                    rooms.pop(k)
            else:
                room, each = capacity, capacity // length
                first, n = sequences, -(-left // each)
                sequences += n
            each = min(room // length, left)
            full = min(n, left // each)
            out.append((length, rank, rank + full * each, each, first, capacity - room))
            put(room - each * length, first, full)
            put(room, first + full, n - full)
            left -= full * each
            rank += full * each
    return out


def pack(pieces: DataFrame, capacity: int, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to capacity; keys must tell rows apart.

    The histogram has a row for each length. Ranks within a length come from bins of about ROWS_IN_BIN rows by hash:
    bins are counted, a prefix over their counts gives each bin its start, and no task sees a whole length. Rows with
    equal keys get ranks of their own. An empty table gives an empty one; a length out of range is an error.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("a length is out of range")
    bins = spark.createDataFrame([(n, max(1, -(-c // ROWS_IN_BIN))) for n, c in counts.items()], "_l long, _bins int")
    slots = spark.createDataFrame(plan(counts, capacity), "_l long, _from long, _to long, _each long, _first long, _offset long")
    binned = pieces.join(F.broadcast(bins), F.col("length") == F.col("_l")).withColumn("_bin", F.pmod(F.xxhash64(*keys), F.col("_bins")).cast("int")).drop("_l", "_bins")
    before = Window.partitionBy("_sl").orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy(F.col("length").alias("_sl"), F.col("_bin").alias("_sb")).count().select("_sl", "_sb", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    starts = written(starts, "starts")
    if small(starts, 4 << 20):
        starts = F.broadcast(starts)
    ranked = binned.join(starts, (F.col("length") == F.col("_sl")) & (F.col("_bin") == F.col("_sb"))).withColumn("_rank", F.col("_start") + F.row_number().over(Window.partitionBy("length", "_bin").orderBy(*keys)) - 1)
    # slots are bounded by the capacity, not by the rows
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    within = F.col("_rank") - F.col("_from")
    sequence = F.col("_first") + F.floor(within / F.col("_each"))
    offset = F.col("_offset") + within % F.col("_each") * F.col("length")
    return placed.select(*pieces.columns, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def token_pieces(df: DataFrame, capacity: int, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each row's ids and end id, cut after every capacity ids."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        tail = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            for a, texts in batches_of(b.column(1)):
                docs = b.column(0).slice(a, len(texts)).to_pylist()
                rows = []
                for doc, blob in zip(docs, enc.encode(texts), strict=True):
                    blob += tail
                    for k, at in enumerate(range(0, len(blob), 4 * capacity)):
                        part = blob[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their sequences. A null or empty text is the end id alone."""
    pieces = written(token_pieces(docs, capacity, vocabulary or vocabulary_path(), end_id), "pieces")
    return pack(pieces, capacity)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
