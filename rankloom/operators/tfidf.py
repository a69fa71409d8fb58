"""TF-IDF cosine of every row against a target; the corpus is the target and the rows given."""

from __future__ import annotations

import functools
import math
import operator
import unicodedata
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import once, tokens
from rankloom.operators.frame import POS
from rankloom.session import written

#: Target tokens up to which rows are searched for them as substrings before they are split.
FEW = 32


def target_tokens(target: str) -> Counter:
    """Maximal runs of letters and decimal digits, as functions.text.tokens has them: no other numerals, no marks."""
    kinds = ((c, unicodedata.category(c)) for c in target)
    return Counter("".join(c if k[0] == "L" or k == "Nd" else " " for c, k in kinds).split())


def term_counts(toks: Column) -> Column:
    """The distinct items of a non-empty array of strings with their counts, as an array of (tok, tf)."""

    def counted(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return once(heads, lambda h: F.transform(h, lambda p, j: F.struct(F.get(s, p).alias("tok"), (F.coalesce(F.get(h, j + 1), F.size(s)) - p).cast("double").alias("tf"))))

    return once(F.sort_array(toks), counted)


def cosine_tfidf(df: DataFrame, text: Column, target: str) -> DataFrame:
    """(_pos, cosine) for the rows that share a token with the target; all other rows score 0. _pos must be unique.

    Raw counts as term frequency, idf = ln(N / (1 + df)) + 1, N and df including the target. One pass over the rows
    counts rows and document frequencies together, combined before the shuffle, and is written. A second one splits only
    the rows that contain a token of the target, counts within each row, and sums by row before the shuffle.
    """
    wanted = target_tokens(target)
    spark = df.sparkSession
    if not wanted:
        return spark.createDataFrame([], f"{POS} {df.schema[POS].dataType.simpleString()}, cosine double")
    toks = tokens(text)
    # the empty string is no token: it counts the rows
    each = df.select(F.explode(F.array_distinct(F.concat(toks, F.array(F.lit(""))))).alias("tok"))
    seen = written(each.groupBy("tok").agg(F.count(F.lit(1)).alias("df")), "terms")
    held = {r["tok"]: r["df"] for r in seen.filter(F.col("tok").isin("", *wanted)).collect()}  # a row for each word of the target
    n = float(held.get("", 0) + 1)
    target_norm = math.sqrt(sum((c * (math.log(n / (2 + held.get(t, 0))) + 1)) ** 2 for t, c in wanted.items()))
    target_rows = spark.createDataFrame([(t, float(c)) for t, c in wanted.items()], "tok string, target_tf double")
    in_target = F.when(F.col("target_tf").isNotNull(), 1).otherwise(0)
    idf = seen.filter("tok <> ''").join(F.broadcast(target_rows), "tok", "left").select("tok", "target_tf", (F.log(F.lit(n) / (1 + F.col("df") + in_target)) + 1).alias("idf"))
    some = df.filter(functools.reduce(operator.or_, (F.contains(text, F.lit(t)) for t in wanted))) if len(wanted) <= FEW else df
    shared = some.select(POS, toks.alias("toks")).filter(F.arrays_overlap("toks", F.array(*map(F.lit, wanted))))
    scored = shared.select(POS, F.explode(term_counts(F.col("toks"))).alias("t")).select(POS, "t.tok", "t.tf").join(idf, "tok").groupBy(POS).agg(
        F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"),
        F.sum(F.col("tf") * F.col("target_tf") * F.col("idf") * F.col("idf")).alias("dot"),
    )
    both = F.col("norm") * F.lit(target_norm)
    return scored.select(POS, F.when(both > 0, F.coalesce("dot", F.lit(0.0)) / both).otherwise(F.lit(0.0)).alias("cosine"))
