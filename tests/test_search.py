import math
import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators.frame import from_pairs
from rankloom.operators.numbering import numbered
from rankloom.operators.rank import METRICS, rank_by, rank_by_vector, rank_by_vector_and_text
from rankloom.plans.blend import BlendWeights

WORDS = [("a", "developer"), ("b", "deliver"), ("c", "delta"), ("d", "programmer")]
NEAR = [("dev", "developer"), ("deve", "develope"), ("devs", "developers"), ("del", "deliver"), ("pro", "programmer")]
BLEND = [("dev", "developer"), ("del", "deliver"), ("devs", "developers"), ("prog", "programmer"), ("dlp", "develope")]
NAMES = [("eq", "MARTHA"), ("tr", "MARHTA"), ("mi", "MARTIN"), ("ro", "ROBERT")]
JOBS = [("a", "software developer"), ("b", "python developer"), ("c", "golang gopher"), ("d", "senior programming")]
SOUNDS = [("rob", "Robert"), ("rup", "Rupert"), ("rub", "Rubin")]

CASES = [
    ("levenshtein", WORDS, "developer", True, "", [("a", 0), ("b", 4), ("c", 6), ("d", 8)]),
    ("levenshtein", WORDS, "developer", True, "dev", [("a", 0)]),
    ("levenshtein", [("x", "DEVELOPER"), ("y", "developer"), ("z", "Developers")], "developer", True, "", [("x", 0), ("y", 0), ("z", 1)]),
    ("levenshtein", [("k1", "abx"), ("k2", "xbc"), ("k3", "axc")], "abc", False, "", [("k1", 1), ("k2", 1), ("k3", 1)]),
    ("levenshtein", [("k", "é")], "e", False, "", [("k", 2)]),
    ("osa", [("k1", "ac"), ("k2", "abc"), ("k3", "car")], "ca", False, "", [("k1", 1), ("k3", 1), ("k2", 3)]),
    ("osa", WORDS, "deliver", True, "del", [("b", 0), ("c", 4)]),
    ("osa", WORDS, "deliver", True, "zzz", []),
    ("jaro_winkler", NAMES, "MARTHA", False, "", [("eq", 1), ("tr", 0.961111), ("mi", 0.866667), ("ro", 0.555556)]),
    ("jaro_winkler", NAMES, "MARTHA", True, "mar", [("eq", 1), ("tr", 0.961111), ("mi", 0.866667)]),
    ("jaro_winkler", [("k", "abcxxx")], "bcaxxx", False, "", [("k", 0.916667)]),
    ("jaro_winkler", [("k", "abzzzz")], "abyyyy", False, "", [("k", 0.644444)]),
    ("jaro_winkler", [("k", ""), ("l", "a")], "", False, "", [("k", 1), ("l", 0)]),
    ("tfidf", JOBS, "developer python", True, "", [("b", 1), ("a", 0.338543), ("c", 0), ("d", 0)]),
    ("tfidf", JOBS, "developer python", True, "dev", [("b", 1), ("a", 0.262282)]),
    # numerals that are neither letters nor decimal digits part tokens, in the target as in rows
    ("tfidf", [("k", "½x"), ("l", "x"), ("m", "½")], "½x", False, "", [("k", 1), ("l", 1), ("m", 0)]),
    ("tfidf", [("k", "x²"), ("l", "aⅧb c"), ("m", "b")], "x² Ⅷb", False, "", [("k", 0.789807), ("m", 0.613356), ("l", 0.236370)]),
    ("combined", [("k", "½x")], "½x", False, "", [("k", 1)]),
    ("soundex", SOUNDS, "Robert", True, "", [("rob", 1), ("rup", 1), ("rub", 0.5)]),
    ("soundex", SOUNDS, "Robert", True, "ru", [("rup", 1), ("rub", 0.5)]),
    ("jaccard", NEAR, "developer", True, "", [("dev", 1), ("devs", 0.875), ("deve", 0.857143), ("del", 0), ("pro", 0)]),
    ("jaccard", NEAR, "developer", True, "dev", [("dev", 1), ("devs", 0.875), ("deve", 0.857143)]),
    ("jaccard", [("k", "xy"), ("l", "xyz")], "ab", False, "", [("k", 1), ("l", 0)]),
    ("combined", BLEND, "developer", True, "", [("dev", 1), ("devs", 0.749762), ("dlp", 0.742555), ("del", 0.389040), ("prog", 0.158730)]),
    ("combined", [("a", "senior programming"), ("b", "python developer"), ("c", "golang gopher"), ("d", "software developer")], "developer python", True, "dev", [("b", 0.457516), ("d", 0.227476)]),
    ("combined", [("k1", "abc"), ("k2", "abc")], "abc", False, "", [("k1", 1), ("k2", 1)]),
]


@pytest.mark.parametrize("metric,rows,target,ci,contains,expected", CASES)
def test_fixtures(spark, metric, rows, target, ci, contains, expected):
    got = rank_by(from_pairs(spark, rows, "string"), metric, target, ci, contains).orderBy("rank").collect()
    assert [r["key"] for r in got] == [k for k, _ in expected]
    assert [r["score"] for r in got] == pytest.approx([s for _, s in expected], abs=1e-6)
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))


@pytest.mark.parametrize("metric", [*METRICS, "tfidf", "combined"])
def test_other_values_are_refused_and_empty_tables_work(spark, metric):
    with pytest.raises(TypeError):
        rank_by(spark.createDataFrame([], "key string, value int, _pos long"), metric, "x")
    assert rank_by(spark.createDataFrame([], "key string, value string, _pos long"), metric, "x").count() == 0


def test_top_k(spark):
    got = rank_by(from_pairs(spark, WORDS, "string"), "levenshtein", "developer", k=2).orderBy("rank").collect()
    assert [(r["key"], r["rank"]) for r in got] == [("a", 1), ("b", 2)]


@pytest.mark.parametrize("name,code", [("Ashcraft", "A226"), ("1abc", "1120"), ("", "0000"), ("Tymczak", "T522"), ("Pfister", "P236"), ("Honeyman", "H555")])
def test_soundex_codes(spark, name, code):
    assert T.soundex_code_of(name) == code
    assert spark.createDataFrame([(name,)], "t string").select(T.soundex_code(F.col("t"))).first()[0] == code


def edit(a: bytes, b: bytes, swaps: bool) -> int:
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


TEXTS = st.lists(st.text("abcé", max_size=7), min_size=1, max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.text("abcé", max_size=6))
def test_osa_kernel(texts, target):
    import numpy as np

    want = np.frombuffer(target.encode(), dtype=np.uint8).astype(np.int16)
    got = T._by_distinct(pd.Series(texts), lambda m, n: T._osa_rows(m, n, want))
    assert list(got) == [edit(t.encode(), target.encode(), True) for t in texts]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS, st.text("abcé", min_size=1, max_size=6))
def test_metric_laws(spark, texts, target):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("t", T.levenshtein(F.col("t"), target).alias("lev"), T.osa(F.col("t"), target).alias("osa"), T.jaro_winkler(F.col("t"), target).alias("jw"), T.jaccard_ngrams(F.col("t"), target).alias("jac"), T.soundex_score(F.col("t"), target).alias("sdx")).collect()
    for r in got:
        assert r["lev"] == edit(r["t"].encode(), target.encode(), False)
        assert r["osa"] <= r["lev"]
        assert all(0 <= r[k] <= 1 for k in ("jw", "jac", "sdx"))


def unit(dims, rng):
    v = [rng.gauss(0, 1) for _ in range(dims)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def near(q, e, rng):
    v = [x + rng.gauss(0, e) for x in q]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


SCHEMA = "struct<text: string, vector: array<double>>"


def test_vectors(spark):
    rng = random.Random(7)
    q = unit(1024, rng)
    text, vector = F.col("value.text"), F.col("value.vector")
    df = from_pairs(spark, [("A", ("alpha dev", near(q, 0.005, rng))), ("B", ("beta", unit(1024, rng))), ("C", ("gamma dev", near(q, 0.02, rng))), ("D", ("dev", q[:5])), ("E", ("dev zero", [0.0] * 1024)), ("F", (None, q))], SCHEMA)
    got = rank_by_vector(df, q, text, vector, 1024, True, "DEV").orderBy("rank").collect()
    assert [r["key"] for r in got] == ["A", "C", "E"]
    assert got[-1]["score"] == 0
    with pytest.raises(ValueError):
        rank_by_vector(df, q[:1023], text, vector, 1024)
    blend = from_pairs(spark, [("1", ("Golang DEV Tools", unit(1024, rng))), ("2", ("python developer", q))], SCHEMA)
    assert [r["key"] for r in rank_by_vector_and_text(blend, "developer", q, text, vector, 1024, None, True, "DEV").orderBy("rank").collect()] == ["2", "1"]
    none = BlendWeights(0, 0, 0, 0, 0, 0, 0)
    assert [(r["key"], r["score"]) for r in rank_by_vector_and_text(blend, "developer", q, text, vector, 0, none).orderBy("rank").collect()] == [("1", 0), ("2", 0)]


def test_numbering_by_ranges(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 503).alias("x"), "id")
    order = [F.col("x").asc(), F.col("id").asc()]
    import rankloom.operators.numbering as N

    whole = {r["id"]: (r["rank"], r["s"]) for r in numbered(df, order, sums={"s": "x"}).collect()}
    held, N.ONE_TASK_BYTES = N.ONE_TASK_BYTES, 0
    try:
        N.small.__defaults__ = (0,)
        parts = {r["id"]: (r["rank"], r["s"]) for r in numbered(df, order, sums={"s": "x"}).collect()}
    finally:
        N.ONE_TASK_BYTES, N.small.__defaults__ = held, (held,)
    assert parts == whole and len(whole) == 500
