"""The corpus pipeline: documents of a known language, without repeated lines and near copies, mixed and packed.

Each stage takes (spark, docs, sf_dir) and returns rows that are written before the next one reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import documents
from rankloom.llm.language import UNKNOWN, identified, in_held_out_fold, train
from rankloom.llm.lines import without_near_lines
from rankloom.llm.mixing import copies
from rankloom.llm.packing import packed_documents
from rankloom.llm.simhash import near_duplicates
from rankloom.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of the Arrow batches that stages send to Python, about: texts of Spark's 10,000 rows would take ten times as much,
#: several times over in the JVM and in each worker. Results don't depend on it.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
#: A document goes if less than this share of its words is of one language.
LEAST_SHARE = 0.5


def _columns(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def _small_batches(spark: SparkSession) -> None:
    """Sets BATCH for the session; it stays set, as a stage's rows are made when its caller writes them."""
    spark.conf.set(*BATCH)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of no predominant language. lang is the predicted one.

    Rows are judged one by one: null and empty texts go, repeated rows and ids stay as often as they came, very long texts
    are read whole. An empty table gives an empty one."""
    _small_batches(spark)
    found = identified(docs, train(docs, in_held_out_fold(F.col("doc_id"))))
    return _columns(found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SHARE)).withColumn("lang", F.col("lang_pred")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; documents of which no word is left by that go too.

    Null texts and blank lines stay; equal rows are one document and get equal results; texts of one id are told apart.
    An empty table gives an empty one."""
    _small_batches(spark)
    out = without_near_lines(docs)
    return _columns(out.filter((F.col("_n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id (null: the least) stays.

    Null and empty texts are copies of each other; rows of one id stay or go together; very long texts are compared whole.
    An empty table gives an empty one."""
    _small_batches(spark)
    kept = near_duplicates(docs).filter("id <=> component_id").select("id").distinct()
    return _columns(docs.join(kept, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without a word are never taken; rows of one id count as one document; a null source is a source. An empty table
    gives an empty one."""
    return _columns(copies(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with copies as documents of their own, in their sequences.

    A null or empty text is one end id; very long texts are cut into several pieces. An empty table gives an empty one."""
    _small_batches(spark)
    return packed_documents(docs)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the trained model, MinHash or tokens; tests hold each stage's rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
