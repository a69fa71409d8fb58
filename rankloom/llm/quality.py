"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import BLANKS, WORD, documents, once

#: Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "a and are as at be by for from has have he in is it not of on or she that the they this to was we were which with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas plus pour que qui sur un une "
    "aber als auch auf aus bei das dem den der des die ein eine einen er es für hat ich ihr im ist mit nicht sich sie sind über und von war wie wir zu zum zur "
    "al como con del el ella ellos ese esta este lo los las más me mi muy no nos para pero por se ser si sin su sus también te tu y ya"
)


@dataclass(frozen=True)
class Rule:
    """A measure must be within [least, most]; rules hold only where a document has at_least words."""

    measure: str
    least: float | None = None
    most: float | None = None
    at_least: int = 0


#: The threshold table.
RULES = (
    Rule("n_words", least=50),
    Rule("mean_word_chars", least=2.0, most=12.0),
    Rule("symbols_per_word", most=0.1),
    Rule("dup_line_share", most=0.4),
    Rule("repeat_word_share", most=0.5),
    Rule("stop_word_share", least=0.05),
    Rule("letter_share", least=0.7),
)


def repeat_words(hashes: Column) -> Column:
    """Words covered by windows of three that occur twice or more, from the windows' hashes in order.

    Windows are sorted as 40 hash bits and 24 bits of place in one long, so that the sort is one of primitives;
    neighbours are compared by their whole hashes. Where different windows share the 40 bits, or places don't fit,
    (hash, place) pairs are sorted instead.
    """
    high = ~((1 << 24) - 1)

    def covered(places: Column) -> Column:
        """places: starts of the repeated windows, ascending."""
        following = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(following, F.lit(0).cast("long"), lambda a, x: a + x)

    def pairs(h: Column) -> Column:
        rows = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        repeated = once(rows, lambda r: F.filter(F.transform(r, lambda x, j: F.when((F.get(r, j - 1)["h"] == x["h"]) | (F.get(r, j + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull()))
        return once(F.sort_array(repeated), covered)

    def packed(h: Column) -> Column:
        rows = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(high)).bitwiseOR(i.cast("long"))))

        def near(r: Column) -> Column:
            place = lambda x: x.bitwiseAND(F.lit(~high))
            equal = lambda x, y: F.coalesce(x.bitwiseAND(F.lit(high)) == y.bitwiseAND(F.lit(high)), F.lit(False))
            whole = lambda x: F.get(h, place(x).cast("int"))
            mixed = F.exists(F.transform(r, lambda x, j: equal(x, F.get(r, j + 1)) & (whole(x) != whole(F.get(r, j + 1)))), lambda x: x)
            repeated = F.transform(F.filter(r, lambda x, j: equal(x, F.get(r, j - 1)) | equal(x, F.get(r, j + 1))), place)
            return F.when(mixed, F.lit(None).cast("long")).otherwise(once(F.sort_array(repeated), covered))

        return once(rows, near)

    def count(h: Column) -> Column:
        fits = F.size(h) < (1 << 24)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(F.coalesce(F.when(fits, packed(h)), pairs(h)))

    return once(hashes, count)


def window_hashes(words: Column) -> Column:
    """A hash for each window of three words."""
    n = F.size(words) - 2
    inner = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n >= 1, inner).otherwise(F.array().cast("array<bigint>"))


def _without(text: Column, chars: str) -> Column:
    """Code points that are left without the characters."""
    return F.char_length(F.translate(text, chars, ""))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts to all columns of df. A null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    listed = [w for w in dict.fromkeys(STOP_WORDS.split())]

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            repeat_words(window_hashes(words)).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(listed))).cast("long").alias("n_stop_words"),
        )

    def lines(held: Column) -> Column:
        return F.struct(F.size(held).cast("long").alias("n_lines"), (F.size(held) - F.size(F.array_distinct(held))).cast("long").alias("n_dup_lines"))

    filled = F.filter(F.split(t, "\n", -1), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    out = df.withColumns({"_w": once(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), counts), "_l": once(filled, lines)})
    return out.withColumns(
        {
            "word_chars": _without(t, BLANKS).cast("long"),
            "n_symbols": (F.char_length(t) - _without(t, "#*$%&|<>")).cast("long"),
            "_letters": F.char_length(F.regexp_replace(t, r"[^\p{L}\p{M}]", "")).cast("long"),
        }
    )


#: Ratios of the counts, by name.
MEASURES: dict[str, Callable[[], Column]] = {
    "n_words": lambda: F.col("_w.n_words"),
    "mean_word_chars": lambda: F.col("word_chars") / F.greatest(F.col("_w.n_words"), F.lit(1)),
    "symbols_per_word": lambda: F.col("n_symbols") / F.greatest(F.col("_w.n_words"), F.lit(1)),
    "dup_line_share": lambda: F.col("_l.n_dup_lines") / F.greatest(F.col("_l.n_lines"), F.lit(1)),
    "repeat_word_share": lambda: F.col("_w.n_repeat_words") / F.greatest(F.col("_w.n_words"), F.lit(1)),
    "stop_word_share": lambda: F.col("_w.n_stop_words") / F.greatest(F.col("_w.n_words"), F.lit(1)),
    "letter_share": lambda: F.col("_letters") / F.greatest(F.col("word_chars"), F.lit(1)),
}


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean column over measured()."""
    verdict = F.lit(True)
    for r in rules:
        value, good = MEASURES[r.measure](), F.lit(True)
        if r.least is not None:
            good = good & (value >= r.least)
        if r.most is not None:
            good = good & (value <= r.most)
        verdict = verdict & (good | (F.col("_w.n_words") < r.at_least))
    return verdict


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All columns of df with the counts, base_failed and kept.

    base_failed: under 50 words, or over half of the words in repeated windows of three. kept: the rules hold and the
    base hasn't failed. An empty or null text fails the base; repeated rows get equal verdicts; an empty table gives
    none. Columns of df with the names of new ones are replaced.
    """
    m = measured(df, text)
    n, repeated = F.col("_w.n_words"), F.col("_w.n_repeat_words")
    failed = (n < 50) | (100 * repeated > 50 * n)
    return m.withColumns({"n_words": n, "n_repeat_words": repeated, "n_dup_lines": F.col("_l.n_dup_lines"), "base_failed": failed, "kept": ~failed & compiled(rules)}).drop("_w", "_l", "_letters")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_LISTED = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS.split()))
OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls FROM d),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len([x for x in ws if lower(x) IN ({_LISTED})]) AS n_stop_words,
    length(regexp_replace(t, '[^\\p{{L}}\\p{{M}}]', '', 'g')) AS letters
  FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS n FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 50 AND word_chars / n BETWEEN 2.0 AND 12.0 AND n_symbols / n <= 0.1 AND n_dup_lines / greatest(n_lines, 1) <= 0.4
  AND n_repeat_words / n <= 0.5 AND n_stop_words / n >= 0.05 AND letters / greatest(word_chars, 1) >= 0.7 AS kept
FROM v"""
