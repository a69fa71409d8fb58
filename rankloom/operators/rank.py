"""Ranked similarity search: filter by substring, score, and number all survivors best first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rankloom.functions import text as T
from rankloom.functions.vector import checked_dims, cosine
from rankloom.operators.frame import POS
from rankloom.operators.numbering import numbered, small
from rankloom.operators.tfidf import cosine_tfidf
from rankloom.plans.blend import COMBINED, BlendWeights, TextBlend, blended
from rankloom.session import written

#: Metrics of one projection: the function, and whether a small value is good.
METRICS = {"levenshtein": (T.levenshtein, True), "osa": (T.osa, True), "jaro_winkler": (T.jaro_winkler, False), "soundex": (T.soundex_score, False), "jaccard": (T.jaccard_ngrams, False)}


def _texts(df: DataFrame) -> None:
    if not isinstance(df.schema["value"].dataType, StringType):
        raise TypeError("values must be strings")


def survivors(df: DataFrame, text: Column, target: str, case_insensitive: bool, contains: str) -> tuple[DataFrame, str]:
    """df with the compared text in _text, of the rows that contain the filter; the target as it is compared."""
    shown = F.lower(text) if case_insensitive else text
    held = contains.lower() if case_insensitive else contains
    df = df.withColumn("_text", shown).filter(F.col("_text").isNotNull())
    return (df.filter(F.col("_text").contains(held)) if held else df), (target.lower() if case_insensitive else target)


def ranked(scored: DataFrame, score: Column, ascending: bool, k: int | None = None, size_of: DataFrame | None = None) -> DataFrame:
    """(key, value, score, rank): by the score rounded to 9 places, NaN last, then by insertion. k: only the best k."""
    rows = scored.select("key", "value", POS, F.round(score.cast("double"), 9).alias("score"))
    rows = rows.withColumn("_bad", F.coalesce(F.isnan("score"), F.lit(True)))
    order = [F.col("_bad").asc(), F.col("score").asc() if ascending else F.col("score").desc(), F.col(POS).asc()]
    if k is not None:
        rows = rows.orderBy(*order).limit(k)
    return numbered(rows, order, size_of=size_of).select("key", "value", "score", "rank")


def rank_by(df: DataFrame, metric: str, target: str, case_insensitive: bool = False, contains: str = "", k: int | None = None) -> DataFrame:
    """One of METRICS, or tfidf, or combined. Keeps every row that contains the filter."""
    _texts(df)
    rows, want = survivors(df, F.col("value"), target, case_insensitive, contains)
    if metric in METRICS:
        f, ascending = METRICS[metric]
        return ranked(rows, f(F.col("_text"), want), ascending, k, df)
    if metric == "tfidf":
        return ranked(with_cosine(rows, want), F.col("_cosine"), False, k, df)
    if metric == "combined":
        return ranked(with_cosine(rows, want), blended(F.col("_text"), want, F.col("_cosine"), None, COMBINED), False, k, df)
    raise ValueError(f"unknown metric {metric!r}")


def with_cosine(rows: DataFrame, want: str) -> DataFrame:
    """rows with _cosine, 0 where no token is shared."""
    found = cosine_tfidf(rows, F.col("_text"), want)
    if small(rows):  # rows bound the other side too: at most one score for each
        found = F.broadcast(found)
    return rows.join(found.withColumnRenamed("cosine", "_cosine"), POS, "left").withColumn("_cosine", F.coalesce("_cosine", F.lit(0.0)))


def _with_vector(df: DataFrame, text: Column, vector: Column, query: Sequence[float], dims: int) -> DataFrame:
    """Rows of another number of dimensions, or without a text or vector, go."""
    n = checked_dims(query, dims)
    return df.withColumns({"_plain": text, "_vector": vector.cast("array<double>")}).filter(F.col("_plain").isNotNull() & F.col("_vector").isNotNull() & (F.size("_vector") == n))


def rank_by_vector(df: DataFrame, query: Sequence[float], text: Column, vector: Column, dims: int = 0, case_insensitive: bool = False, contains: str = "", k: int | None = None) -> DataFrame:
    """By cosine to the query. text, vector: where a row's text and vector are."""
    rows, _ = survivors(_with_vector(df, text, vector, query, dims), F.col("_plain"), "", case_insensitive, contains)
    return ranked(rows, cosine(F.col("_vector"), query), False, k, df)


def rank_by_vector_and_text(df: DataFrame, target: str, query: Sequence[float], text: Column, vector: Column, dims: int = 0, weights: BlendWeights | None = None, case_insensitive: bool = False, contains: str = "", k: int | None = None) -> DataFrame:
    """By a weighted mean of the vector's cosine and the text metrics."""
    rows, want = survivors(_with_vector(df, text, vector, query, dims), F.col("_plain"), target, case_insensitive, contains)
    rows = written(rows.select("key", "value", POS, "_text", "_vector"), "survivors")  # read by each step of the text metrics
    w = weights or BlendWeights()
    blend = TextBlend(w.levenshtein, w.osa, w.jaro_winkler, w.cosine, w.jaccard, w.soundex, max(1, w.ngram), w.vector)
    return ranked(with_cosine(rows, want), blended(F.col("_text"), want, F.col("_cosine"), cosine(F.col("_vector"), query), blend), False, k, df)
