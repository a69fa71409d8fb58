"""Token ids: an encoder around a tokenizers file, and token files in Parquet."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import documents, new_path

#: Pieces, or words of other texts, that a worker's cache takes before the older half goes: bounds memory, changes no
#: result.
MOST_PIECES, MOST_WORDS = 200_000, 50_000
#: Fixed value: how the vocabulary's file splits normalised text: runs of letters, what follows an apostrophe, single
#: numbers, runs of anything else. Here for lower-case Latin-1.
PLAIN_PIECE = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z0-9\s\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+")
#: The settings of vocabulary files for which that holds.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "added_tokens": ["<|endoftext|>", "<|startoftext|>"],
}
#: Texts of these Latin-1 characters alone are their own NFC form, and have one-to-one lower case.
PLAIN = bytes([*range(9, 14), *range(32, 127), *range(161, 256)])
#: Code points that str.split takes for white space and the vocabulary's file doesn't.
SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable ones stand for themselves, others follow 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (n for n in range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


class _Pieces(dict):
    """The ids of pieces of lower-case Latin-1, by the library's BPE model when a piece is new."""

    def __init__(self, model):
        super().__init__()
        self.model, self.older = model, {}
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        self[piece] = ids
        return ids

    def trim(self) -> None:
        """Called between texts: what hasn't been used since the last full cache goes."""
        if len(self) > MOST_PIECES:
            self.older = dict(self)
            self.clear()


class Encoder:
    """encode() of the tokenizers library, for files with the KNOWN settings a distinct piece at a time; for others the
    library encodes whole texts.

    No token of such a vocabulary spans pieces or white space, and its normalisation doesn't look across white space.
    Plain texts are lower-cased and split here, and each new piece goes through the library's BPE model. Other texts go
    word by word: plain words as before, the rest through the library's whole tokenizer. Ids are held as little-endian
    32-bit integers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        own = {"normalizer": file.get("normalizer"), "pre_tokenizer": file.get("pre_tokenizer"), "added_tokens": sorted(t["content"] for t in file.get("added_tokens") or [])}
        self.by_pieces = own == KNOWN and file["model"]["type"] == "BPE"
        self.pieces = _Pieces(self.whole.model)
        self.words: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PLAIN_PIECE.findall(text.lower())))

    def _by_words(self, text: str) -> bytes:
        if SEPARATORS.search(text):
            return self._encoded([text])[0]
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        words = text.split()
        new = set(words) - self.words.keys()
        odd = [w for w in new if not is_plain(w)]
        self.words.update(zip(odd, self._encoded(odd), strict=True))
        self.words.update((w, self._plain(w)) for w in new.difference(odd))
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, null as empty, as little-endian 32-bit integers."""
        if not self.by_pieces:
            return self._encoded([t or "" for t in texts])
        out = []
        for t in texts:
            self.pieces.trim()
            out.append((self._plain(t) if is_plain(t) else self._by_words(t)) if t else b"")
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def batches_of(column: pa.Array, chars: int = 4_000_000) -> Iterator[tuple[int, list]]:
    """Slices of a text column of about so many bytes, with their first row."""
    sizes = np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
    group = np.cumsum(sizes) // chars
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield a, column.slice(a, b - a).to_pylist()


def ids_list(blobs: list[bytes]) -> pa.Array:
    """Little-endian ids as a list<int32> array."""
    ends = np.cumsum([0, *(len(b) // 4 for b in blobs)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), dtype="<i4")))


#: Writer settings: ids by dictionary (16 bits each), other numbers by deltas, small pages with indexes.
FILE_OPTIONS = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#first": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "compression": "zstd",
}


def write_token_files(df: DataFrame, path: str, vocabulary: str, end_id: int | None, id_column: str = "doc_id", text: str = "text") -> None:
    """Files of (doc_id, part, first, n_tokens, ids), in ascending doc_id order within and across files.

    part: the number of the range that a file holds; first: ids of this part before the row. Equal doc_ids are ordered
    by text. A null text counts as empty, so it holds the end id alone. An empty table gives files without rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        first = 0
        for b in batches:
            for a, texts in batches_of(b.column(1)):
                blobs = [x + tail for x in enc.encode(texts)]
                n = np.array([len(x) // 4 for x in blobs], dtype=np.int64)
                before = first + np.cumsum(n) - n
                first += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(texts)), b.column(2).slice(a, len(texts)), pa.array(before), pa.array(n), ids_list(blobs)], names=["doc_id", "part", "first", "n_tokens", "ids"])

    spark = df.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(n, "doc_id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("doc_id", "text")
    out = rows.mapInArrow(run, "doc_id long, part int, first long, n_tokens long, ids array<int>")
    out.write.options(**FILE_OPTIONS).parquet(path)


def read_token_files(spark, path: str, columns: list[str] | None = None, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """Rows of token files with start, the ids of all documents before. Only the columns asked for are read; a range
    of doc_ids reaches the files' page indexes."""
    df = spark.read.schema("doc_id long, part int, first long, n_tokens long, ids array<int>").parquet(path)
    parts = df.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # a row for each file range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if doc_ids is not None:
        df = df.filter(F.col("doc_id").between(*doc_ids))
    out = df.join(F.broadcast(starts), "part").withColumn("start", F.col("_start") + F.col("first"))
    return out.select(columns or ["doc_id", "start", "n_tokens", "ids"])


def with_crc32(df: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows with ids; the values of a batch are one buffer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            values = memoryview(np.ascontiguousarray(np.asarray(ids.values), dtype="<u4")).cast("B")
            ends = np.asarray(ids.offsets).tolist()
            sums = [zlib.crc32(values[4 * x : 4 * y]) for x, y in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark, sf_dir: str, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(documents(spark, sf_dir), path, vocabulary or vocabulary_path(), end_id)
    return with_crc32(read_token_files(spark, path))
