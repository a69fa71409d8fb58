import random

import pytest

WORDS = "the of and that river stone cloud paper garden window yellow seven bridge market winter letter simple copper forest silver".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "er", "ing", str(rng.randint(0, 99))]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, blanks, ties and a long text."""
    rng = random.Random(3)
    rows = [(i, ".\n".join(sentence(rng, rng.randint(5, 30)) for _ in range(rng.randint(1, 5)))) for i in range(0, 60, 2)]
    base = rows[5][1]
    passage = sentence(rng, 40)
    rows += [(101, base), (102, base), (103, base + " more"), (104, rows[7][1].replace("river", "rover", 1)), (105, None), (106, ""), (107, " \n\t"), (108, "!!! ***"), (109, "one"), (110, "é" * 130 + "ß" * 40)]
    rows += [(111 + k, sentence(rng, 12) + "\n" + passage + "\n" + sentence(rng, 9)) for k in range(6)]
    rows += [(130, "\n".join(sentence(rng, 20) for _ in range(250)))]
    return [(i, t, "en" if i % 3 else "xx", f"s{i % 4}" if i % 7 else None) for i, t in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns of clashing names."""
    df = spark.createDataFrame([(*r, len(r[1] or ""), "extra", 1.5) for r in corpus], "doc_id long, text string, lang string, source string, n_chars long, id string, k double")
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("false")


class Links:
    """Union-find for the brute-force versions."""

    def __init__(self, items):
        self.parent = {x: x for x in items}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)


@pytest.fixture
def links():
    return Links
