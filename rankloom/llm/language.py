"""Language identification by a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from rankloom.llm.common import documents, released

#: The training sample: so many documents of each language at most, a window of so many characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 1500
#: Languages that are learned at most, as the model has a weight for each feature and language; more are an error.
MOST_LANGUAGES = 256
FEATURE_BITS = 17
#: Tokens that a task remembers before it starts anew.
MOST_TOKENS = 100_000
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
EDGES = regex.compile(r"^[^\p{L}]+|[^\p{L}]+$")


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of lower-case words, flat, and where each word's end.

    With marks before and after each word: n-grams of 1 to 4 letters, of which those with a mark are the affixes, and
    the whole word as an entry of the lexicon."""
    marked = [f"\x02{w}\x03" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    ends = np.cumsum(sizes)
    place = np.arange(len(chars))
    stop = np.repeat(ends, sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    found, owner = [], []
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            h = np.full(max(0, len(chars) - n + 1), n, dtype=np.uint64)
            for k in range(n):
                h = (h ^ chars[k : len(chars) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            good = place[: len(h)] + n <= stop[: len(h)]
            found.append(h[good])
            owner.append(word[: len(h)][good])
        weights = np.uint64(0x100000001B3) ** (place - np.repeat(ends - sizes, sizes)).astype(np.uint64)
        whole = np.add.reduceat(chars * weights * np.uint64(0xD6E8FEB86659FD93), ends - sizes) if len(words) else np.empty(0, np.uint64)
        found.append(whole ^ (whole >> np.uint64(31)))
        owner.append(np.arange(len(words)))
        flat = (np.concatenate(found) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - FEATURE_BITS)
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return flat[order].astype(np.int64), np.cumsum(np.bincount(owners, minlength=len(words)))


def words_of(text: str) -> list[str]:
    """The white-space tokens with a letter, without what surrounds their letters, in lower case."""
    return [EDGES.sub("", w).lower() for w in text.split() if LETTER.search(w)]


@dataclass
class Model:
    """labels, feature weights (features x labels), transition scores (from x to)."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    tokens: dict[str, int] = field(default_factory=dict)
    held: list[np.ndarray] = field(default_factory=list)

    def __getstate__(self):
        return {"labels": self.labels, "weights": self.weights, "moves": self.moves, "tokens": {}, "held": []}

    def emissions(self, words: list[str]) -> np.ndarray:
        flat, ends = features(words)
        sums = np.vstack([np.zeros(len(self.labels)), np.cumsum(self.weights[flat], axis=0, dtype=np.float64)])
        return np.diff(sums[np.concatenate([[0], ends])], axis=0)


def marginals(emissions: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray, edges: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Forward-backward for all sequences at once: the probability of each label at each place. emissions holds the
    sequences one after another; a step handles the same place of all sequences that are long enough. With edges also
    the expected number of each move (from x to) over all sequences."""
    labels = moves.shape[0]
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left")  # how many are longer than t
    step = np.exp(moves - moves.max())
    local = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    forward = np.empty_like(local)
    last = np.full((len(starts), labels), 1.0 / labels)
    for t, n in enumerate(active):
        at = starts[:n] + t
        now = (last[:n] @ step if t else last[:n]) * local[at]
        now /= now.sum(axis=1, keepdims=True)
        forward[at] = now
        last = now
    back = np.ones((len(starts), labels))
    out = forward
    expected = np.zeros((labels, labels))
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        g = forward[at] * back[:n]
        out[at] = g / g.sum(axis=1, keepdims=True)
        onward = back[:n] * local[at]
        b = onward @ step.T
        if edges and t:  # the place before still holds its forward message
            before = forward[at - 1]
            expected += step * ((before / (before * b).sum(axis=1, keepdims=True)).T @ onward)
        back[:n] = b / b.sum(axis=1, keepdims=True)
    return (out, expected) if edges else out


def fit(texts: list[str], langs: list[str], epochs: int = 6, length: int = 40, rate: float = 0.3, seed: int = 9) -> Model:
    """Maximum likelihood by AdaGrad over sequences of words that carry their document's language. A third of the
    sequences join parts of two documents, so that transitions between languages are learned too."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    place = {x: i for i, x in enumerate(labels)}
    pieces = []
    for text, lang in zip(texts, langs, strict=True):
        words = words_of(text)
        pieces += [(words[a : a + length], place[lang]) for a in range(0, len(words), length)]
    k = len(labels)
    model = Model(labels, np.zeros((1 << FEATURE_BITS, k), dtype=np.float32), np.zeros((k, k)))
    if not pieces:
        return model
    order = rng.permutation(len(pieces))
    sequences, at = [], 0
    while at < len(order):
        words, lang = pieces[order[at]]
        tags = [lang] * len(words)
        if at + 1 < len(order) and rng.random() < 1 / 3:
            at += 1
            more, other = pieces[order[at]]
            words, tags = words[: length // 2] + more[: length // 2], tags[: length // 2] + [other] * len(more[: length // 2])
        sequences.append((words, tags))
        at += 1
    grown, grown_moves = np.full_like(model.weights, 1e-6), np.full_like(model.moves, 1e-6)
    for _ in range(epochs):
        for a in range(0, len(sequences), 64):
            batch = [s for s in sequences[a : a + 64] if s[0]]
            if not batch:
                continue
            words = [w for s in batch for w in s[0]]
            tags = np.array([t for s in batch for t in s[1]])
            lengths = np.array([len(s[0]) for s in batch])
            starts = np.cumsum(lengths) - lengths
            flat, ends = features(words)
            sums = np.vstack([np.zeros(k), np.cumsum(model.weights[flat], axis=0, dtype=np.float64)])
            emissions = np.diff(sums[np.concatenate([[0], ends])], axis=0)
            error, expected = marginals(emissions, starts, lengths, model.moves, edges=True)
            error[np.arange(len(tags)), tags] -= 1
            counts = np.diff(np.concatenate([[0], ends]))
            used, inverse = np.unique(flat, return_inverse=True)
            gradient = np.stack([np.bincount(inverse, np.repeat(error[:, j], counts), len(used)) for j in range(k)], axis=1) / len(batch)
            gradient += 1e-4 * model.weights[used]
            grown[used] += gradient**2
            model.weights[used] -= (rate * gradient / np.sqrt(grown[used])).astype(np.float32)
            inner = np.ones(len(tags), dtype=bool)
            inner[starts + lengths - 1] = False
            left = np.flatnonzero(inner)
            seen = np.zeros((k, k))
            np.add.at(seen, (tags[left], tags[left + 1]), 1)
            gradient = (expected - seen) / len(batch) + 1e-3 * model.moves
            grown_moves += gradient**2
            model.moves -= rate * gradient / np.sqrt(grown_moves)
    return model


def train(docs: DataFrame, held_out, docs_each: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model | None:
    """A model from rows with a text and a lang for which held_out (a boolean column) is false; None if there are none.

    The sample is bounded by docs_each documents of each language and a window of chars characters of each, which
    starts at a place drawn from the document's hash; it doesn't grow with the table. Which documents: the least
    hashes of their doc_id, of those that pass a rate that leaves three times as many. More than MOST_LANGUAGES
    languages are an error, so that none is left out unsaid."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values to learn")
    if not counts:
        return None
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30))
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 3 * docs_each / n))]), F.col("lang"))
    some = known.filter(F.col("lang").isin(list(counts))).withColumn("_draw", draw).filter(F.col("_draw") < rate * (1 << 30))
    start = F.greatest(F.lit(1), F.pmod(F.xxhash64("doc_id"), F.greatest(F.char_length("text") - chars, F.lit(1))) + 1).cast("int")
    rows = some.select("lang", "_draw", F.substring(F.col("text"), start, F.lit(chars)).alias("text")).toPandas()
    rows = rows.sort_values(["lang", "_draw", "text"]).groupby("lang").head(docs_each)
    return fit(rows["text"].tolist(), rows["lang"].tolist())


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language with the largest mean probability over the words of each text, and that mean."""
    if len(model.tokens) > MOST_TOKENS:
        model.tokens.clear()
        model.held.clear()
    lists = [t.split() if t else [] for t in texts]
    new = set()
    for words in lists:
        new.update(words)
    new = [w for w in new - model.tokens.keys()]
    bare = [EDGES.sub("", w).lower() if LETTER.search(w) else "" for w in new]
    kept = [(w, b) for w, b in zip(new, bare, strict=True) if b]
    size = sum(map(len, model.held))
    model.tokens.update(dict.fromkeys(new, -1))
    model.tokens.update({w: size + i for i, (w, _) in enumerate(kept)})
    for a in range(0, len(kept), 20_000):
        model.held.append(model.emissions([b for _, b in kept[a : a + 20_000]]).astype(np.float32))
    if model.held:
        model.held = [np.concatenate(model.held)]
    get = model.tokens.__getitem__
    ids = [np.fromiter(map(get, words), dtype=np.int64, count=len(words)) for words in lists]
    ids = [x[x >= 0] for x in ids]
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if lengths.sum():
        starts = np.cumsum(lengths) - lengths
        gamma = marginals(model.held[0][np.concatenate(ids)].astype(np.float64), starts[lengths > 0], lengths[lengths > 0], model.moves)
        means = np.add.reduceat(gamma, starts[lengths > 0], axis=0) / lengths[lengths > 0][:, None]
        for i, m in zip(np.flatnonzero(lengths), means, strict=True):
            j = int(m.argmax())
            langs[i], scores[i] = model.labels[j], float(min(1.0, m[j]))
    return langs, scores


def identified(df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all if None) of each row of df, with lang_pred and score, which replace columns of those names.

    und with score 0: a null text, one without a letter, or no model. Rows are predicted on their own, so repeated rows
    and ids, texts of any length and an empty table need nothing special; other columns may have any names."""
    held = df.sparkSession.sparkContext.broadcast(model)  # fixed size: features x languages
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    shown = df.select(*(F.col(f"`{c}`") for c in keep), *([] if text in keep else [F.col(text).alias("_language_text")]))
    at = keep.index(text) if text in keep else len(keep)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = np.full(b.num_rows, UNKNOWN, dtype=object), np.zeros(b.num_rows)
            sizes = np.asarray(pc.binary_length(b.column(at)).fill_null(0))
            order = np.argsort(-sizes, kind="stable")  # texts of about one length take about as many steps
            for part in np.split(order, np.flatnonzero(np.diff(np.cumsum(sizes[order]) // 1_000_000)) + 1):
                if held.value is not None:
                    langs[part], scores[part] = predict(held.value, b.column(at).take(pa.array(part)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])
        if held.value is not None:  # the worker lives on
            held.value.tokens.clear()
            held.value.held.clear()

    return shown.mapInArrow(run, StructType([*shown.schema.fields[: len(keep)], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def in_held_out_fold(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, in_held_out_fold(F.col("doc_id")))
    return identified(docs, model, keep=["doc_id"]).select("doc_id", in_held_out_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
