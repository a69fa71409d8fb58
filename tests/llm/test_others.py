"""Mixing, tokens, packing, pages, language, quality and the pipeline."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from rankloom.llm import html, language, lines, mixing, packing, quality, simhash, tokens
from rankloom.llm.common import new_path
from rankloom.session import written

DATA = "/root/testdata/sf0.001"
VOCABULARY = tokens.vocabulary_path()


@pytest.mark.parametrize("name", ["op2_mixing", "op10_quality_rules"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    theirs = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    mine = entry.queries()[name](spark, DATA).select(*names)
    assert sorted(map(repr, map(tuple, mine.collect()))) == sorted(map(repr, theirs.fetchall()))


def test_mixing(spark, docs, corpus, none):
    rows = mixing.sized(docs)
    got = mixing.mix(rows).collect()
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in mixing.mix(rows).collect()}
    total = sum(r["size"] for r in got)
    target = {r["source"]: r["target"] for r in got}
    assert sum(target.values()) == pytest.approx(1.5 * total)
    by = defaultdict(int)
    for r in got:
        by[r["source"]] += r["taken"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", next(t for i, t, *_ in corpus if i == r["doc_id"]) or ""))
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] <= 2 * r["source_size"] + 1e-6
    assert all(abs(by[s] - target[s]) <= 1 for s in target)
    assert mixing.mix(mixing.sized(none)).count() == 0


@pytest.mark.parametrize("joined", [False, True])
def test_mixing_by_ranges(docs, monkeypatch, joined):
    rows = mixing.sized(docs)
    whole = {(r["doc_id"], r["taken"]) for r in mixing.mix(rows).collect()}
    monkeypatch.setattr(mixing, "ONE_TASK_BYTES", 0)
    if joined:
        monkeypatch.setattr(mixing, "small", lambda df, most=0: False)
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix(rows).collect()} == whole


def test_mixing_of_uneven_qualities(spark, monkeypatch):
    """Qualities from 0.01 to 1 in one hot source and two small ones: ranges stay even, totals are met, columns of clashing
    names stay, and those of the added names are replaced."""
    monkeypatch.setattr(mixing, "ONE_TASK_BYTES", 0)
    seen = []
    from rankloom.operators import numbering

    monkeypatch.setattr(numbering, "written", lambda df, *a: seen.append(kept := written(df, *a)) or kept)
    source = F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "b")
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), source.alias("source"), (F.col("id") % 50).alias("size"), (F.col("id") % 97 / 97 * 0.99 + 0.01).alias("quality"), F.lit("x").alias("target"), F.lit(1).alias("n"), F.lit(2).alias("weight"), F.lit(3).alias("bins"), F.lit(4).alias("start"))
    got = mixing.mix(rows).toPandas()
    assert len(got) == 8000 and set(got["n"]) == {1} and set(got["weight"]) == {2} and set(got["bins"]) == {3} and set(got["start"]) == {4}
    for _, own in got.fillna({"source": ""}).groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 1
    ranges = [r["count"] for r in seen[-1].groupBy("_numbered_range").count().collect()]
    assert max(ranges) < 2 * 8000 / len(ranges) and len(ranges) >= 4
    better = got[(got["source"] == "b") & (got["size"] > 0)]
    assert better[better["taken"] > better["size"]]["quality"].mean() > better[better["taken"] <= better["size"]]["quality"].mean()


def test_mixing_prefers_quality_where_a_source_is_cut(spark):
    """Sources at their cap are taken twice as a whole; the one that is cut takes better documents more often."""
    source = F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "b")
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), source.alias("source"), (F.col("id") % 50).alias("size"), (F.col("id") % 97 / 97 * 0.99 + 0.01).alias("quality"))
    got = mixing.mix(rows).toPandas().fillna({"source": ""}).query("size > 0")
    capped, cut = got[got["source"] != "hot"], got[got["source"] == "hot"]
    assert (capped["taken"] == 2 * capped["size"]).all()
    assert cut[cut["taken"] > cut["size"]]["quality"].mean() > cut[cut["taken"] <= cut["size"]]["quality"].mean() + 0.1


def test_targets(spark):
    sources = spark.createDataFrame([("a", 10, 3.0), ("b", 1000, 1.0), ("c", 100, 2.0), ("d", 0, 3.0)], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    assert got["a"] == 20 and got["c"] == 200 and got["d"] == 0
    assert got["b"] == pytest.approx(1110 * 1.5 - 220)


ODD = ["a\x1cb c", "<|endoftext|> x<|startoftext|>y", "İstanbul ΑΣΣ ς", "écoléx", "½ ² ª µ ß ÀÉ", "don't we'll I'M x y z", "日本語 テスト", "ẛx a​b", "it'S ABC’s ½x ²³ ñandú_año __x__ Œuvre", "'''s's 12345 ++--", "", None, "\x85a\x7f\xad b", " \n\t"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_encoder(tokenizer, corpus):
    texts = [*ODD, *[t for _, t, *_ in corpus], *["a" + chr(c) + "b" + 2 * chr(c) + " " + chr(c) + "'s" for c in range(1, 256)]]
    got = tokens.Encoder(VOCABULARY).encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_of_another_vocabulary(corpus):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path("byte_bpe_50k.json")
    texts = [*ODD, *[t for _, t, *_ in corpus], "Mixed CASE  and\n\nspace"]
    whole = Tokenizer.from_file(path)
    assert not tokens.Encoder(path).by_pieces and tokens.Encoder(VOCABULARY).by_pieces
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens.Encoder(path).encode(texts)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(blacklist_categories=["Cs"]), max_size=20))
def test_encoder_on_any_text(text):
    from tokenizers import Tokenizer

    global WHOLE, ENCODER
    if "WHOLE" not in globals():
        WHOLE, ENCODER = Tokenizer.from_file(VOCABULARY), tokens.Encoder(VOCABULARY)
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_small_caches_change_nothing(monkeypatch, corpus):
    texts = [t for _, t, *_ in corpus] + ODD
    whole = tokens.Encoder(VOCABULARY).encode(texts)
    monkeypatch.setattr(tokens, "MOST_PIECES", 3)
    monkeypatch.setattr(tokens, "MOST_WORDS", 3)
    enc = tokens.Encoder(VOCABULARY)
    assert [enc.encode([t])[0] for t in texts] == whole


def test_token_file_footers(spark, docs, tmp_path):
    """Ids by dictionary, numbers without one, page indexes, several pages, and row groups within their limit."""
    import pyarrow.parquet as pq

    path = str(tmp_path / "tokens")
    tokens.write_token_files(docs, path, VOCABULARY, 1)
    seen = 0
    for file in (tmp_path / "tokens").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            assert meta.row_group(g).total_byte_size <= 64 << 20
            columns = {meta.row_group(g).column(i).path_in_schema.split(".")[0]: meta.row_group(g).column(i) for i in range(meta.num_columns)}
            assert any("DICTIONARY" in e for e in columns["ids"].encodings)
            for name in ("doc_id", "first", "n_tokens"):
                assert columns[name].encodings and not any("DICTIONARY" in e for e in columns[name].encodings)
                assert "DELTA_BINARY_PACKED" in columns[name].encodings
            assert all(c.has_column_index and c.has_offset_index for n, c in columns.items() if n != "ids")
            assert columns["ids"].has_offset_index
            seen += meta.row_group(g).num_rows
    assert seen == docs.count()


def test_token_files(spark, docs, corpus, none, tokenizer):
    path = new_path(spark, "tokens")
    tokens.write_token_files(docs, path, VOCABULARY, 1)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in corpus}
    start = 0
    got = {r["doc_id"]: r for r in tokens.read_token_files(spark, path).collect()}
    for i in sorted(ids):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids"]) == (start, len(ids[i]), ids[i])
        start += len(ids[i])
    sums = {r["doc_id"]: r["ids_crc32"] for r in tokens.with_crc32(tokens.read_token_files(spark, path)).collect()}
    assert sums == {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in ids.items()}
    some = tokens.read_token_files(spark, path, ["doc_id", "start"], (100, 105))
    assert {r[0] for r in some.collect()} == {101, 102, 103, 104, 105}
    assert "ids" not in some._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    empty = new_path(spark, "tokens")
    tokens.write_token_files(none, empty, VOCABULARY, 1)
    assert tokens.with_crc32(tokens.read_token_files(spark, empty)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=12))
def test_packing_plan(counts):
    bins, ranks = Counter(), defaultdict(list)
    taken = defaultdict(set)
    for length, a, b, each, first, offset in packing.plan(counts, 32):
        for r in range(a, b):
            seq, place = first + (r - a) // each, offset + (r - a) % each * length
            assert not taken[seq] & set(range(place, place + length))
            taken[seq] |= set(range(place, place + length))
            bins[seq] += length
            ranks[length].append(r)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    assert all(taken[s] == set(range(n)) and n <= 32 for s, n in bins.items())
    # as many as best-fit decreasing makes, a piece at a time
    rooms = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fit = [r for r in rooms if r >= length]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 32) - length)
    assert len(bins) == len(rooms)


def test_packed_documents(docs, corpus, none, tokenizer):
    got = packing.packed_documents(docs, 64).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t, *_ in corpus}
    places = defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + 64]
        assert r["start"] == 64 * r["piece"] and r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    for spots in places.values():
        at = 0
        for offset, n in sorted(spots):
            assert offset == at
            at += n
        assert at <= 64
    assert packing.packed_documents(none).count() == 0


PAGES = [
    ("<nav>x<p>y</nav><article class='post'><header><h1>T</h1></header><p>a<b>b</b>c &lt;x&gt;&nbsp; d<div class='comments'><p>no</div><p>last<script>var x='</p>'</script> z</article><footer>f</footer>", "T abc <x> d last z"),
    ("<body><!-- <p>no</p> --><main><p>one<br>two<ul><li>i<li>j</ul><form><p>no</form><aside>no</aside><p>three<div class='ad'>no</div></main>", "one two i j three"),
    ("<article><p>open &amp; &#233; &copy;<p class='notice'>no<p>yes 1 < 2 and <", "open & é © yes 1 < 2 and <"),
    ("plain text only", "plain text only"),
    ("", ""),
    (None, ""),
    ("<nav>only</nav>", ""),
    ("<article><p title='a > b'>quoted</p><table><tr><td>c1<td>c2</table><style>p{}</style></article>", "quoted c1 c2"),
]


def test_pages(spark, none):
    df = spark.createDataFrame([(i, f"http://h{i}/", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html.main_text(df).collect()}
    for i, (_, text) in enumerate(PAGES):
        assert got[i]["text"] == text and got[i]["n_chars"] == len(text)
    assert html.main_text(df.filter("false")).count() == 0


KEPT = [
    # names within an article: the last word of a compound decides, elsewhere any
    ("<article><h1>Prices</h1><p class='share-price'>Shares rose.</p><section id='social-history'>Old times.</section><div class='reader-comments'>no</div><div class='ad-slot'>no</div><p class='x comments'>no</p></article>", "Prices Shares rose. Old times."),
    # a small article is not all there is, and teasers are not the article
    ("<p>before the article</p><article>short</article><p>and much text after it</p>", "before the article short and much text after it"),
    ("<article><p>a long article of very many words about one thing</p></article><article>a teaser</article><div class='share-price'>no</div>", "a long article of very many words about one thing"),
    ("<main><h1>T</h1><article>one two three</article><article>four five six</article></main>", "one two three four five six"),
]


@pytest.mark.parametrize("page,text", KEPT)
def test_what_is_kept(page, text):
    assert " ".join(html.chosen(page)[0]) == text


@pytest.mark.parametrize("block", [4_000_000, 1])
def test_host_passages(spark, monkeypatch, block):
    monkeypatch.setattr(html, "BLOCK_CHARS", block)
    same = "subscribe here for all of our daily news and more of it"
    rows = [(i, "http://one.org/a", f"<div>{same}</div><div>{i} own text of this page</div>") for i in range(3)]
    rows += [(9, "http://two.org/", f"<div>{same}</div>"), (10, None, f"<div>{same}</div>")]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"{i} own text of this page" for i in range(3)}, 9: same, 10: same}


@pytest.mark.parametrize("block", [4_000_000, 1])
def test_copies_of_a_page_are_one_page(spark, monkeypatch, block):
    """Three copies of a page without article or main keep their text, and so does a page of repeated passages alone."""
    monkeypatch.setattr(html, "BLOCK_CHARS", block)
    body = "the only copy of this text is what the page has to say today"
    menu = "subscribe here for all of our daily news and more of it"
    rows = [(i, "http://one.org/a", f"<div>{body}</div>") for i in range(3)] + [(3 + i, None, f"<div>{body}</div><div>x{i}</div>" if i == 3 else f"<div>{body}</div>") for i in range(4)]
    rows += [(10 + i, "http://two.org/", f"<div>{menu}</div><div>{i} own text</div>") for i in range(3)] + [(13, "http://two.org/b", f"<div>{menu}</div>"), (13, "http://two.org/b", f"<div>{menu}</div>")]
    df = spark.createDataFrame([(*r, "h", 5) for r in rows], "page_id long, url string, html string, host string, d int")
    found = html.main_text(df).collect()
    assert len(found) == len(rows)
    assert {r["page_id"]: r["text"] for r in found} == {**{i: body for i in range(6)}, 6: f"{body} x3", **{10 + i: f"{i} own text" for i in range(3)}, 13: menu}
    assert all(r["n_chars"] == len(r["text"]) for r in found)


@pytest.mark.parametrize("block", [4_000_000, 900])
def test_unique_runs_against_all_windows(spark, monkeypatch, block):
    """Pages without article or main of one large and two small hosts, with passages that some of them share."""
    import random

    monkeypatch.setattr(html, "BLOCK_CHARS", block)
    rng = random.Random(6)
    passages = [[f"p{k}w{rng.randint(0, 3)}{i}" for i in range(n)] for k, n in enumerate((7, 8, 9, 30, 60, 12))]
    pages = []
    for i in range(90):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages)[: rng.choice((7, 8, 20, 99))] if rng.random() < 0.6 else [f"u{rng.randint(0, 400)}" for _ in range(rng.randint(1, 15))]
        pages.append((i, f"https://h{max(0, i % 7 - 4)}.org/x", " ".join(words)))
    seen = defaultdict(set)
    for _, url, t in pages:
        w = t.split()
        for k in range(len(w) - 7):
            seen[url, tuple(w[k : k + 8])].add(t)
    want = {}
    for i, url, t in pages:
        w, gone = t.split(), set()
        for k in range(len(w) - 7):
            if len(seen[url, tuple(w[k : k + 8])]) >= 3:
                gone |= {*range(k, k + 8)}
        want[i] = " ".join(x for k, x in enumerate(w) if k not in gone) or t
    df = spark.createDataFrame([(i, u, f"<body><div>{t}</div></body>") for i, u, t in pages], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.main_text(df).collect()} == want
    assert sum(want[i] != t for i, _, t in pages) > 20


@pytest.mark.parametrize("limit", [1_000_000, 6000])
def test_articles_go_through_the_host_step(spark, monkeypatch, limit):
    """What most articles of a host have goes, wherever it stands; what fewer have, parts of a block, hosts of few pages and
    articles of template text alone stay. Copies are one page."""
    monkeypatch.setattr(html, "ARTICLE_CHARS", limit)
    note, common = "write to us for all of our daily news and more of it", "a line of nine words that some articles happen to share"
    want, rows = {}, []
    for i in range(60):
        own = f"{i} own text of this page, number {i}"
        body = [own, note] if i % 2 else [note, own]
        if i % 10 == 0:
            body.append(common)
        body.append(f"{note} and so on, {i}")
        rows.append((i, "http://one.org/a", "<article>" + "".join(f"<p>{x}</p>" for x in body) + "</article>"))
        want[i] = " ".join(x for x in body if x != note)
    for i in range(60, 64):
        rows.append((i, "http://few.org/", f"<main><p>{note}</p><p>{i}</p></main>"))
        want[i] = f"{note} {i}"
    for i in range(64, 72):
        rows.append((i, "http://copies.org/", f"<article><p>{common}</p><p>{note}</p></article>"))
        want[i] = f"{common} {note}"
    rows.append((72, "http://one.org/b", f"<article><p>{note}</p></article>"))
    want[72] = note
    df = spark.createDataFrame([*rows, rows[1]], "page_id long, url string, html string")
    found = html.main_text(df).collect()
    assert len(found) == 74 and {r["page_id"]: r["text"] for r in found} == want


def test_marginals_against_all_paths():
    rng = np.random.default_rng(2)
    moves = rng.normal(size=(3, 3))
    lengths = np.array([4, 1, 3])
    emissions = rng.normal(size=(8, 3))
    starts = np.cumsum(lengths) - lengths
    got = language.marginals(emissions, starts, lengths, moves)
    for a, n in zip(starts, lengths, strict=True):
        exact = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            w = np.exp(sum(emissions[a + t, y] for t, y in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:], strict=False)))
            for t, y in enumerate(path):
                exact[t, y] += w
        assert got[a : a + n] == pytest.approx(exact / exact.sum(axis=1, keepdims=True))


def test_expected_moves_against_all_paths():
    rng = np.random.default_rng(4)
    moves = rng.normal(size=(3, 3))
    lengths = np.array([4, 1, 3])
    emissions = rng.normal(size=(8, 3))
    starts = np.cumsum(lengths) - lengths
    nodes, got = language.marginals(emissions, starts, lengths, moves, edges=True)
    exact = np.zeros((3, 3))
    for a, n in zip(starts, lengths, strict=True):
        own, total = np.zeros((3, 3)), 0.0
        for path in np.ndindex(*[3] * n):
            w = np.exp(sum(emissions[a + t, y] for t, y in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:], strict=False)))
            total += w
            for x, y in zip(path, path[1:], strict=False):
                own[x, y] += w
        exact += own / total
    assert got == pytest.approx(exact)
    assert nodes == pytest.approx(language.marginals(emissions, starts, lengths, moves))


def test_code_switch():
    english, french = "the river and the stone are with this winter", "le fleuve et la pierre sont avec cet hiver"
    model = language.fit([english] * 20 + [french] * 20, ["en"] * 20 + ["fr"] * 20)
    mixed = language.words_of(english + " " + french)
    gamma = language.marginals(model.emissions(mixed), np.array([0]), np.array([len(mixed)]), model.moves)
    assert [model.labels[j] for j in gamma.argmax(axis=1)] == ["en"] * 9 + ["fr"] * 9


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = entry.queries()["op9_language"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) > 0
    assert all(0 <= r["score"] <= 1 for r in got)


def test_too_many_languages(docs, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1 values"):
        language.train(docs, F.lit(False))


def test_language_cases(docs, none):
    model = language.train(docs, F.lit(False))
    out = language.identified(docs.unionAll(docs).withColumn("score", F.lit("clash")), model)
    assert out.count() == 2 * docs.count() and out.columns == [*docs.columns, "lang_pred", "score"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert {got[i] for i in (105, 106, 107, 108)} == {("und", 0.0)}
    assert {v[0] for v in got.values()} <= {"en", "xx", "und"}
    assert language.train(none, F.lit(False)) is None
    assert {r["lang_pred"] for r in language.identified(docs, None).collect()} == {"und"}
    assert language.identified(none, model).count() == 0


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    held = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(held) - len(set(held)), len(covered)


def test_quality(spark, docs, corpus, none):
    more = [(900, "a b c a b c a b c", "", None), (901, "x " * 70, "", None), (902, "a b\na b\n \na b", "", None), (903, "p q r s p q r t q r s", "", None)]
    df = docs.select("doc_id", "text", F.lit("clash").alias("kept")).unionByName(spark.createDataFrame([(i, t, "clash") for i, t, *_ in more], "doc_id long, text string, kept string"))
    got = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    for i, t, *_ in [*corpus, *more]:
        r, own = got[i], counts(t)
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == own, i
        assert r["base_failed"] == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.quality_rules(none).count() == 0


def test_quality_paths_agree(spark):
    """The sort of packed longs against the sort of pairs, also where 40 bits of hash meet."""
    h = [(5 << 24) + 1, (5 << 24) + 2, (5 << 24) + 1, 7 << 24, 8 << 24, 7 << 24]
    df = spark.createDataFrame([(h,), ([1, 2, 3],), ([],), ([9, 9],)], "h array<long>")
    assert [r[0] for r in df.select(quality.repeat_words(F.col("h"))).collect()] == [8, 0, 0, 4]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    df, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, df = df, corpus_pipeline.written(stage(spark, df, DATA), name)
        seen[name] = df.count()
        if name != "packing":
            assert df.columns == docs.columns, name
        if name in ("language", "near_dedup"):
            assert df.select("doc_id").distinct().count() == seen[name] <= before.count()
    assert seen["language"] >= seen["line_dedup"] >= seen["near_dedup"] > 0
    assert seen["packing"] >= seen["mixing"] > 0
    assert corpus_pipeline.run(spark, DATA).count() == seen["packing"]


def test_pipeline_of_odd_rows(spark, docs, none):
    for df in (docs, none):
        df = df.select(corpus_pipeline.COLUMNS)
        for name, stage in corpus_pipeline.STAGES:
            df = corpus_pipeline.written(stage(spark, df, DATA), name)
        df.count()


def test_stages_against_brute_force(spark, docs, corpus, links, tokenizer):
    """Each stage's rows on the corpus, with repeated rows, against plain Python."""
    base = docs.select(corpus_pipeline.COLUMNS)
    base = corpus_pipeline.written(base.unionAll(base.filter("doc_id in (4, 101)")), "base")
    rows = lambda df: sorted((r["doc_id"], r["text"], r["n_chars"]) for r in df.collect())
    twice = [(i, t) for i, t, *_ in corpus] + [(i, t) for i, t, *_ in corpus if i in (4, 101)]

    model = language.train(base, language.in_held_out_fold(F.col("doc_id")))
    langs = dict(zip([t for _, t in twice], zip(*language.predict(model, [t for _, t in twice]), strict=True), strict=True))
    want = sorted((i, t, len(t)) for i, t in twice if langs[t][0] != "und" and langs[t][1] >= corpus_pipeline.LEAST_SHARE)
    first = corpus_pipeline.written(corpus_pipeline.language(spark, base, DATA), "first")
    assert rows(first) == want and first.count() < len(twice)

    grams = lambda f: {f[k : k + 8] for k in range(max(1, len(f) - 7))}
    forms = sorted({(i, no, f) for i, t, _ in want for no, f in lines.compared_lines(t)})
    sets = {f: grams(f) for *_, f in forms}
    union = links(sets)
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            union.join(a, b)
    seen, gone = set(), set()
    for i, no, f in forms:
        gone |= {(i, no)} if union.find(f) in seen else set()
        seen.add(union.find(f))
    cut = [(i, "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone), t) for i, t, _ in want]
    want = sorted((i, t, len(t)) for i, t, whole in cut if t == whole or t.split())
    second = corpus_pipeline.written(corpus_pipeline.line_dedup(spark, first, DATA), "second")
    assert rows(second) == want

    third = corpus_pipeline.written(corpus_pipeline.near_dedup(spark, first, DATA), "third")  # of what still has copies
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    sets = {i: frozenset(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    union = links(sets)
    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            union.join(a, b)
    assert {r["doc_id"] for r in third.collect()} == {i for i in sets if union.find(i) == i} != set(sets)

    fourth = corpus_pipeline.written(corpus_pipeline.mixing(spark, second, DATA), "fourth")
    plan = {r["doc_id"]: r for r in mixing.mix(mixing.sized(second).groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("size").alias("size"), F.avg("quality").alias("quality")), split_last=False).collect()}
    n = Counter(r["doc_id"] for r in second.collect())
    assert Counter(r["doc_id"] for r in fourth.collect()) == {i: n[i] * (r["taken"] // r["size"]) for i, r in plan.items() if r["size"] and r["taken"]}

    last = corpus_pipeline.packing(spark, fourth, DATA).collect()
    pieces = Counter()
    for r in fourth.collect():
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0]
        pieces.update((r["doc_id"], k, len(ids[2048 * k : 2048 * (k + 1)])) for k in range(-(-len(ids) // 2048)))
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in last) == pieces


def test_workers_give_memory_back():
    """What a kernel has freed goes back to the system when its task ends, also where a later piece holds the heap's end;
    its batches go out in slices."""
    import re
    from pathlib import Path

    import pyarrow as pa

    from rankloom.llm.common import OUT_BYTES, released

    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    kept = []

    def run(batches):
        pieces = [b"x" * 20_000 for _ in range(15_000)]  # 300 MB of pieces of the heap
        kept.append(b"y" * 20_000)
        yield from batches
        del pieces

    before = held()
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) * 1000 for i in range(3000)])], names=["x"])
    out = list(released(run)(iter([batch, batch.slice(0, 1), batch.slice(0, 0)])))
    assert held() - before < 100
    assert pa.Table.from_batches(out) == pa.Table.from_batches([batch, batch.slice(0, 1)]) and max(b.nbytes for b in out) < 2 * OUT_BYTES
