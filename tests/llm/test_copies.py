"""SpotSigs, repeated substrings, lines and SimHash against brute force."""

import hashlib
import itertools
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import common, lines, simhash, spotsigs, substrings
from rankloom.llm.common import components


@pytest.mark.parametrize("one_task", [8 << 20, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(common, "ONE_TASK_BYTES", one_task)
    got = components(spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 7), (1, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 20)], "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(3, 3), (4, 3), (5, 3), (7, 3), (8, 8), (9, 8), *((i, 20) for i in range(20, 25))}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spotsigs_follow(spark, docs, corpus, none):
    got = {r["doc_id"]: r for r in spotsigs.compared_with_following(docs).collect()}
    order = sorted(corpus, key=lambda r: -r[0])
    for (i, t, *_), (_, after, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, after, r = t or "", after or "", got[i]
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        own, edited, following = (set(spotsigs.spot_signatures(x).tolist()) for x in (t, new, after))
        assert r["near_edited"] == pytest.approx(len(own & edited) / len(own | edited))
        assert r["near_next"] == pytest.approx(len(own & following) / len(own | following))
        shown, changed = (set(spotsigs.signatures_of(r[k]).tolist()) for k in ("fingerprint", "edited_fingerprint"))
        assert (shown, changed) == (own, edited) and r["near_edited"] == pytest.approx(len(shown & changed) / len(shown | changed))
    assert got[101]["fingerprint"] == got[102]["fingerprint"] == got[10]["fingerprint"] != got[130]["fingerprint"]
    assert spotsigs.compared_with_following(none).count() == 0
    one = spark.createDataFrame([(7, "a b")], "doc_id long, text string")
    assert spotsigs.compared_with_following(one).first()["edited_sha256"] == hashlib.sha256(b"a a").hexdigest()
    tied = spark.createDataFrame([(7, "b"), (7, "a"), (7, "a")], "doc_id long, text string")
    assert spotsigs.compared_with_following(tied).count() == 3


def test_spot_signatures():
    """Anchors with the next two content words; anchors between are skipped."""
    assert np.array_equal(spotsigs.spot_signatures("The river, the stone!"), spotsigs.spot_signatures("the RIVER the stone"))
    assert len(spotsigs.spot_signatures("the river stone of cloud paper")) == 2


def test_spot_classes(spark, docs, corpus, links):
    """Through the rows of op1: components of likeness at 0.8, against all pairs."""
    sets = {i: frozenset(spotsigs.spot_signatures(t).tolist()) for i, t, *_ in corpus}
    union = links(sets)
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            union.join(a, b)
    assert {r["doc_id"]: r["class_id"] for r in spotsigs.compared_with_following(docs).collect()} == {i: union.find(i) for i in sets}
    rows = [(None, "the river stone and the cloud paper"), (3, "the river stone and the cloud paper"), (3, "of other words this time"), (4, None), (5, ""), (6, "of other words this time")]
    got = {(r["id"], r["class_id"]) for r in spotsigs.spot_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, None), (3, None), (4, 4), (5, 4), (6, 3)}


@pytest.mark.parametrize("n", [5, 40])
def test_spanning_pairs(links, n):
    """With and without the index: what is connected, and only true links."""
    rng = np.random.default_rng(n)
    base = [np.sort(rng.choice(10**6, 60, replace=False)) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(base[i % 4], 56, replace=False), rng.choice(10**6, int(rng.integers(0, 9)))])) for i in range(n)] + [np.empty(0, np.int64)] * 2
    brute, mine = links(range(len(sets))), links(range(len(sets)))
    true = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    for i, j in true:
        brute.join(i, j)
    for i, j in common.spanning_pairs(sets, 0.8):
        assert (min(i, j), max(i, j)) in true
        mine.join(i, j)
    assert [mine.find(i) for i in range(len(sets))] == [brute.find(i) for i in range(len(sets))]


def removed(texts):
    """(doc_id, n_bytes, n_removed, n_spans, sha) by looking at every string of 100 bytes in order."""
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = t.encode()
        gone = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k] += 1
                gone[k + 100] -= 1
            seen.add(w)
        gone = np.cumsum(gone)[: len(b)] > 0
        runs = [k for k, _ in itertools.groupby(gone)]
        out[i] = (i, len(b), int(gone.sum()), sum(runs), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def substring_rows(df):
    return {r["doc_id"]: (r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in substrings.without_repeats(df).collect()}


def test_substrings(docs, corpus, none):
    assert substring_rows(docs) == removed({i: t or "" for i, t, *_ in corpus})
    assert substrings.without_repeats(none).count() == 0


def test_substrings_in_small_blocks_and_hot(docs, corpus, monkeypatch):
    """Blocks smaller than texts, and strings that count as hot at once. In-process: the functions of a task."""
    monkeypatch.setattr(substrings, "BLOCK", 500)
    monkeypatch.setattr(substrings, "HOT", 1)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(substrings)
    try:
        assert substring_rows(docs) == removed({i: t or "" for i, t, *_ in corpus})
    finally:
        cloudpickle.unregister_pickle_by_value(substrings)


def test_substrings_of_runs(spark):
    texts = {1: "a" * 350, 2: "b" * 99, 3: "ab" * 120, 4: "ba" * 60 + "c", 5: "a" * 100}
    assert substring_rows(spark.createDataFrame(list(texts.items()), "doc_id long, text string")) == removed(texts)


def grams(form):
    return {form[i : i + 8] for i in range(max(1, len(form) - 7))}


def test_lines(docs, corpus, none, links):
    forms = sorted((i, no, f) for i, t, *_ in corpus for no, f in lines.compared_lines(t))
    sets = {f: grams(f) for _, _, f in forms}
    union = links(sets)
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            union.join(a, b)
    seen, gone = set(), set()
    for i, no, f in forms:
        root = union.find(f)
        if root in seen:
            gone.add((i, no))
        seen.add(root)
    got = {r["doc_id"]: r for r in lines.without_near_lines(docs).collect()}
    for i, t, *_ in corpus:
        kept = None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone)
        assert got[i]["text"] == kept, i
    assert got[105]["text"] is None and got[111]["id"] == "extra"
    assert len(gone) > 5
    assert lines.without_near_lines(none).count() == 0


def test_short_lines(spark):
    """Lines of any length are compared; blank ones stay."""
    texts = {1: "Menu\n\nabout us\nx", 2: "menu\n\n \t\nX\nHome", 3: "ABOUT  us\n你好。\n再见了。", 4: "你好。\nabout it", 5: "home\nmenus"}
    got = {r["doc_id"]: (r["text"], r["_n_removed"]) for r in lines.without_near_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: (texts[1], 0), 2: ("\n \t\nHome", 2), 3: ("你好。\n再见了。", 1), 4: ("about it", 1), 5: ("menus", 1)}


def test_lines_of_repeated_ids(spark):
    """Texts of one id are told apart, equal rows are one document, a null id is the least; extra columns stay."""
    rows = [(7, "the same old line\nfirst"), (7, "the same old line\nsecond and more\nthird"), (7, "the same old line\nfirst"), (None, "first\nnew"), (8, "third\n" + "x" * 100_000 + "\nlast"), (9, "x" * 100_000 + "\nLAST")]
    df = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], "doc_id long, text string, k string, n int, doc string")
    got = lines.without_near_lines(df).collect()
    assert len(got) == 6 and all((r["k"], r["n"], r["doc"]) == ("a", 1, "b") for r in got)
    by = {(r["doc_id"], r["_n_lines"]): r["text"] for r in got}
    assert by[None, 2] == "first\nnew" and by[9, 2] == ""
    sevens = [r["text"] for r in got if r["doc_id"] == 7]
    assert sum("first" in t for t in sevens) == 0  # it is in the document with the least id
    whole = [t for t in sevens if "same old" in t]
    assert len(set(whole)) == 1 and len(whole) in (1, 2)
    assert sum("third" in r["text"] for r in got) == 1


def edited_words(rng, words, n):
    """The words with n of them replaced, alone or together."""
    out, at = list(words), rng.choice(len(words), n, replace=False) if rng.random() < 0.5 else np.arange(n) + rng.integers(0, len(words) - n + 1)
    for i in at:
        out[i] = f"z{rng.integers(0, 10**6)}"
    return out


def test_recall_of_lines(spark):
    """Of pairs of lines at a Jaccard of 0.80 to 0.85 nine in ten are found at least."""
    rng = np.random.default_rng(3)
    rows, want = [], 0
    for d in range(3000):
        words = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(25, 60)))]
        copy = edited_words(rng, words, int(rng.integers(1, 4)))
        a, b = (" ".join(w) for w in (words, copy))
        j = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        if 0.80 <= j <= 0.85:
            rows += [(2 * d, a), (2 * d + 1, b)]
            want += 1
    found = sum(r["_n_removed"] for r in lines.without_near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert want > 500 and 0.95 * want <= found <= want


def test_recall_of_near_duplicates(spark):
    """The same for documents and shingles of five words."""
    rng = np.random.default_rng(4)
    rows, want = [], 0
    for d in range(2500):
        words = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(150, 400)))]
        n = int(len(words) * 0.19)
        copy = words[: len(words) - n] if d % 3 == 0 else edited_words(rng, words, int(len(words) * 0.021)) if d % 3 == 1 else words[: len(words) - n // 2] + [f"v{x}" for x in rng.integers(0, 10**6, n // 2)]
        a, b = (set(zip(*(w[k:] for k in range(5)), strict=False)) for w in (words, copy))
        if 0.80 <= len(a & b) / len(a | b) <= 0.85:
            rows += [(2 * d, " ".join(words)), (2 * d + 1, " ".join(copy))]
            want += 1
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).filter("id <> component_id").count()
    assert want > 500 and 0.95 * want <= found <= want


@pytest.mark.parametrize("bits", [1 << 25, 1 << 12])
def test_maybe_among(spark, monkeypatch, bits):
    """No key is lost, whatever the filter's size, and a large filter leaves few others."""
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    df = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    keys = df.filter("id % 100 = 3").select("h")
    got = {r["id"] for r in common.maybe_among(df, F.col("h"), keys).collect()}
    assert {*range(3, 20_000, 100)} <= got and (bits < 1 << 20 or len(got) < 250)
    assert common.maybe_among(df, F.col("h"), keys.filter("false")).count() == 0


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, corpus, none, links):
    fps = {i: fingerprint(t) for i, t, *_ in corpus}
    union = links(fps)
    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3:
            union.join(a, b)
    got = {r["id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_components(simhash.with_fingerprint(docs), 3).collect()}
    assert got == {i: (f, union.find(i)) for i, f in fps.items()}
    assert simhash.near_components(simhash.with_fingerprint(none), 3).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3), st.integers(1, 3))
def test_masks_cover(x, flips, radius):
    flips = set(list(flips)[:radius])
    y = x ^ sum(1 << b for b in flips)
    assert any(x & m == y & m for m in simhash.covering_masks(radius))


def test_spanning_links_of_large_groups(links, monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 8)
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 14, 600).astype(np.uint64) | np.uint64(1 << 60))
    brute, mine = links(range(len(fps))), links(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2:
            brute.join(i, j)
    for i, j in simhash.spanning_links(fps, 2):
        assert (int(fps[i]) ^ int(fps[j])).bit_count() <= 2
        mine.join(i, j)
    assert [mine.find(i) for i in range(len(fps))] == [brute.find(i) for i in range(len(fps))]


def test_near_duplicates(docs, corpus, none, links):
    sets = {i: frozenset(simhash.shingle_hashes(t, 5).tolist()) for i, t, *_ in corpus}
    union = links(sets)
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            union.join(a, b)
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: union.find(i) for i in sets}
    assert simhash.near_duplicates(none).count() == 0


def test_near_duplicates_cut_and_extended(spark):
    """Copies whose difference is one passage: cut to a prefix, extended, and with the end replaced."""
    rng = np.random.default_rng(1)
    rows, pairs = [], []
    for d in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 600)))]
        n = len(words)
        copy = [words[: int(n * 0.82)], words + [f"v{x}" for x in rng.integers(0, 5000, int(n * 0.2))], words[: int(n * 0.92)] + [f"v{x}" for x in rng.integers(0, 5000, int(n * 0.07))]][d % 3]
        rows += [(2 * d, " ".join(words)), (2 * d + 1, " ".join(copy))]
        a, b = (set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows[-2:])
        pairs.append(len(a & b) >= 0.8 * len(a | b))
    assert sum(pairs) > 50
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 1 if i % 2 and pairs[i // 2] else i for i in range(120)}
