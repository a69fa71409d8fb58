"""String metrics against a fixed target.

Each metric takes the column of texts and the target (a Python string) and returns a Column. Metrics look at UTF-8
bytes, not characters. A null text gives null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Letters that have a Soundex digit, and the digits in the same order. Other characters count as 0.
SOUNDEX_LETTERS = "BFPVCGJKQSXZDTLMNR"
SOUNDEX_DIGITS = "111122222222334556"
#: Bytes of texts that one table of a kernel holds.
MOST_CELLS = 250_000


def byte_view(text: Column) -> Column:
    """One character for each byte of the UTF-8 form."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def _bytes_of(s: str) -> str:
    return s.encode("utf-8").decode("latin-1")


def levenshtein(text: Column, target: str) -> Column:
    return F.levenshtein(byte_view(text), F.lit(_bytes_of(target)))


def soundex_code(text: Column) -> Column:
    """First byte, then digits. Any uncoded character parts equal codes, and the whole text is coded; empty: 0000."""
    raw = byte_view(F.upper(text))
    coded = F.translate(F.regexp_replace(raw, f"[^{SOUNDEX_LETTERS}]", "0"), SOUNDEX_LETTERS, SOUNDEX_DIGITS)
    runs = F.regexp_replace(coded, r"(.)\1+", "$1")
    digits = F.regexp_replace(F.substring(runs, 2, 1_000_000_000), "0", "")
    return F.when(F.length(raw) == 0, F.lit("0000")).otherwise(F.concat(F.substring(raw, 1, 1), F.rpad(F.substring(digits, 1, 3), 3, "0")))


def soundex_code_of(s: str) -> str:
    """The same code for a literal."""
    raw = _bytes_of(s.upper())
    if not raw:
        return "0000"
    code = dict(zip(SOUNDEX_LETTERS, SOUNDEX_DIGITS, strict=True))
    out, last = raw[0], code.get(raw[0], "0")
    for c in raw[1:]:
        d = code.get(c, "0")
        if d not in ("0", last):
            out += d
        last = d
    return out[:4].ljust(4, "0")


def soundex_score(text: Column, target: str) -> Column:
    """Length of the common prefix of the two codes, over 4."""
    code, want = soundex_code(text), soundex_code_of(target)
    score = F.lit(0.0)
    for n in range(1, 5):
        score = F.when(F.substring(code, 1, n) == want[:n], F.lit(n / 4)).otherwise(score)
    return F.when(text.isNotNull(), score)


def once(value: Column, use) -> Column:
    """use(value), with value evaluated once even where use mentions it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def ngrams(text: Column, n: int) -> Column:
    """The set of byte n-grams, each as hexadecimal digits: slices of binary cost the same at every place."""

    def grams(raw: Column) -> Column:
        count = F.octet_length(raw) - (n - 1)
        some = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.hex(F.substring(raw, i, F.lit(n)))))
        return F.when(count >= 1, some).otherwise(F.array().cast("array<string>"))

    return once(F.encode(text, "UTF-8"), grams)


def jaccard_ngrams(text: Column, target: str, n: int = 3) -> Column:
    """Shared over all n-grams; two empty sets count as equal, n of 0 or less gives 0."""
    if n <= 0:
        return F.when(text.isNotNull(), F.lit(0.0))
    want = target.encode("utf-8")
    grams = list(dict.fromkeys(want[i : i + n].hex().upper() for i in range(len(want) - n + 1)))
    if not grams:
        return F.when(byte_length(text) < n, F.lit(1.0)).when(text.isNotNull(), F.lit(0.0))

    def share(own: Column) -> Column:
        shared = F.size(F.array_intersect(own, F.array(*map(F.lit, grams)))).cast("double")
        return shared / (F.size(own) + F.lit(len(grams)) - shared)

    return F.when(text.isNotNull(), once(ngrams(text, n), share))


def _by_distinct(texts: pd.Series, score) -> pd.Series:
    """score() is called once, with the distinct texts of the batch as a zero-padded byte matrix and their lengths."""
    codes, values = pd.factorize(texts)
    raw = [v.encode("utf-8") for v in values]
    lengths = np.array([len(b) for b in raw], dtype=np.int64)
    out = np.full(len(raw) + 1, np.nan)
    # texts of about one length share a matrix, of MOST_CELLS at most: one long text doesn't widen those of the short ones
    order = np.argsort(lengths, kind="stable")
    cells = np.cumsum(lengths[order] + 1)
    for part in np.split(order, np.flatnonzero(np.diff(np.maximum(cells // MOST_CELLS, np.arange(len(order)) // 512))) + 1):
        if len(part):
            matrix = np.zeros((len(part), int(lengths[part].max())), dtype=np.int16) - 1
            for row, k in enumerate(part):
                matrix[row, : lengths[k]] = np.frombuffer(raw[k], dtype=np.uint8)
            out[part] = score(matrix, lengths[part])
    return pd.Series(out[codes])


def _osa_rows(matrix: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Optimal string alignment for all rows at once. A row of the table is found as x[i] without insertions, then
    curr[i] = i + min over k <= i of (x[k] - k), a running minimum."""
    n, width = matrix.shape
    place = np.arange(width + 1)
    before, prev = np.zeros((n, width + 1), dtype=np.int64), np.tile(place, (n, 1))
    for j, b in enumerate(target, 1):
        x = np.empty_like(prev)
        x[:, 0] = j
        x[:, 1:] = np.minimum(prev[:, 1:] + 1, prev[:, :-1] + (matrix != b))
        if j > 1 and width > 1:
            swap = (matrix[:, 1:] == target[j - 2]) & (matrix[:, :-1] == b)
            x[:, 2:] = np.where(swap, np.minimum(x[:, 2:], before[:, :-2] + 1), x[:, 2:])
        before, prev = prev, np.minimum.accumulate(x - place, axis=1) + place
    return prev[np.arange(n), lengths].astype(float)


def _jaro_winkler_rows(matrix: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, width = matrix.shape
    m = len(target)
    reach = np.maximum(np.maximum(lengths, m) // 2 - 1, 0)
    used = np.zeros((n, m), dtype=bool)
    hit = np.zeros((n, width), dtype=bool)
    place = np.arange(m)
    for i in range(width):
        free = ~used & (matrix[:, i : i + 1] == target) & (np.abs(place - i) <= reach[:, None])
        if m and (found := free.any(axis=1)).any():
            first = free.argmax(axis=1)
            used[found, first[found]] = True
            hit[found, i] = True
    count = hit.sum(axis=1)
    # matched characters of both sides, in order, side by side
    left = np.take_along_axis(matrix, np.argsort(~hit, axis=1, kind="stable"), axis=1)
    right = target[np.argsort(~used, axis=1, kind="stable")] if m else np.zeros((n, 0), dtype=np.int64)
    most = min(width, m)
    real = np.arange(most) < count[:, None]
    halves = ((left[:, :most] != right[:, :most]) & real).sum(axis=1) / 2.0
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(count > 0, (count / lengths + count / max(m, 1) + (count - halves) / count) / 3.0, 0.0)
    prefix = np.zeros(n)
    going = np.ones(n, dtype=bool)
    for i in range(min(4, most)):
        going &= matrix[:, i] == target[i]
        prefix += going
    equal = (lengths == m) & ((matrix[:, :m] == target).all(axis=1) if width >= m else False)
    return np.where(equal, 1.0, jaro + prefix * 0.1 * (1.0 - jaro))


def osa(text: Column, target: str) -> Column:
    """Edit distance with swaps of neighbours, no part edited twice. Arrow batches; each distinct text is scored once."""
    want = np.frombuffer(target.encode("utf-8"), dtype=np.uint8).astype(np.int16)

    @pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return _by_distinct(s, lambda matrix, lengths: _osa_rows(matrix, lengths, want))

    return score(text).cast("int")


def jaro_winkler(text: Column, target: str) -> Column:
    """Jaro with half transpositions and the prefix boost at any score. Arrow batches, distinct texts."""
    want = np.frombuffer(target.encode("utf-8"), dtype=np.uint8).astype(np.int16)

    @pandas_udf("double")
    def score(s: pd.Series) -> pd.Series:
        return _by_distinct(s, lambda matrix, lengths: _jaro_winkler_rows(matrix, lengths, want))

    return score(text)


def tokens(text: Column) -> Column:
    """Maximal runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


def normalised(distance: Column, text: Column, target: str) -> Column:
    """1 - distance / longer byte length, not under 0; two empty texts: 1."""
    longer = F.greatest(byte_length(text), F.lit(len(target.encode("utf-8"))))
    return F.when(longer == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - distance / longer))
