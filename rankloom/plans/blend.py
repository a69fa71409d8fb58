"""Weighted means of the metrics, in one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions import text as T


@dataclass(frozen=True)
class BlendWeights:
    """Weights of the vector and text blend. They may be negative; a sum of 0 divides by 1."""

    vector: float = 2.0
    levenshtein: float = 1.0
    osa: float = 1.0
    jaro_winkler: float = 1.0
    cosine: float = 1.0
    jaccard: float = 0.75
    soundex: float = 0.5
    ngram: int = 3


@dataclass(frozen=True)
class TextBlend:
    levenshtein: float = 1.0
    osa: float = 1.0
    jaro_winkler: float = 1.0
    cosine: float = 1.0
    jaccard: float = 0.75
    soundex: float = 0.5
    ngram: int = 3
    vector: float = 0.0


#: The blend of the text metrics alone.
COMBINED = TextBlend()


def blended(text: Column, target: str, cosine: Column, vector: Column | None, w: TextBlend) -> Column:
    """The weighted mean; metrics of weight 0 aren't evaluated."""
    parts = [
        (w.vector, lambda: vector),
        (w.levenshtein, lambda: T.normalised(T.levenshtein(text, target), text, target)),
        (w.osa, lambda: T.normalised(T.osa(text, target), text, target)),
        (w.jaro_winkler, lambda: T.jaro_winkler(text, target)),
        (w.cosine, lambda: cosine),
        (w.jaccard, lambda: T.jaccard_ngrams(text, target, w.ngram)),
        (w.soundex, lambda: T.soundex_score(text, target)),
    ]
    total = sum(x for x, _ in parts) or 1.0
    mean = F.lit(0.0)
    for weight, score in parts:
        if weight:
            mean = mean + F.lit(float(weight)) * score()
    return mean / F.lit(float(total))
