"""Mixing sources to target weights: Efraimidis-Spirakis order within each source, cut at token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import BLANKS, WORD, documents
from rankloom.operators.numbering import numbered, small
from rankloom.session import written

#: Fixed by the contract: weights of sources in order of code points, repeating; the share of all sizes; the most
#: times that a source is taken.
WEIGHTS, SHARE, MOST_TIMES = (3, 1, 2), 1.5, 2.0
#: Estimated bytes of rows that one task orders; larger tables are ordered by ranges.
ONE_TASK_BYTES = 1 << 20
SEED = 20


def n_words(text: Column) -> Column:
    """Words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_quality(text: Column) -> Column:
    """A weight of (0, 1]: the share of letters among the characters of words, plus 1, over 2."""
    chars = F.char_length(F.translate(text, BLANKS, ""))
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.coalesce((letters / F.nullif(chars, F.lit(0)) + 1) / 2, F.lit(0.5))


def uniform(key: Column, seed: int = SEED) -> Column:
    """A number within (0, 1) from 48 bits of MD5: the same in every run and engine."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST_TIMES) -> DataFrame:
    """Adds target to (source, source_size, weight): share of all sizes by weight, no source over most times its size,
    the excess reshared by weight. A source is capped from the level at which weight times level passes its cap, so
    only the level is sought: each round is one aggregate, whatever the number of sources."""
    cap = F.col("source_size") * most
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while total > 0:
        capped = cap <= F.col("weight") * level
        r = sources.agg(F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)).alias("held"), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("free")).first()
        if r["free"] <= 0:
            break
        new = (total - r["held"]) / r["free"]
        if new <= level * (1 + 1e-12):
            break
        level = new
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def by_source(rows: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, weight, start): sources by code point, nulls last, with weights that repeat; start: the
    sizes of all sources before."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    placed = numbered(written(sums, "sources"), [F.col("source").asc_nulls_last()], "place", {"start": "source_size"})
    return placed.withColumn("weight", F.element_at(listed, ((F.col("place") - 1) % len(weights) + 1).cast("int"))).drop("place")


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows joined to their source. The table of sources is broadcast if its estimate is small; else its rows are
    repeated for each of 16 salts, so that a hot source spreads over as many tasks."""
    right = sources.withColumnRenamed("source", "_mix_source")
    same = F.col("source").eqNullSafe(F.col("_mix_source"))
    if small(sources, 4 << 20):
        return rows.join(F.broadcast(right), same).drop("_mix_source")
    salted = right.withColumn("_mix_salt", F.explode(F.array(*map(F.lit, range(16)))))
    return rows.withColumn("_mix_own", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")).join(salted, same & (F.col("_mix_own") == F.col("_mix_salt"))).drop("_mix_source", "_mix_own", "_mix_salt")


def mix(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_TIMES, split_last: bool = True, seed: int = SEED) -> DataFrame:
    """Adds source_size, target, epochs and taken to (doc_id, source, size, quality) and other columns.

    A source is taken whole floor(target / size) times; what is left is filled in order of -ln(u) / quality, u from
    doc_id and seed, until the prefix sum of sizes reaches it. The document at the end is taken in part (split_last)
    or whole if more than half of it fits. Sizes of 0 are never taken. Ties of the order fall to doc_id, then size;
    equal rows are interchangeable. A null source is a source; a null quality counts as 1, one of 0 or less as the
    least positive weight. Columns of the added names are replaced, others may have any names. An empty table gives an
    empty one.

    No task sorts a whole source: rows are ordered by source and key as one, by ranges of about as many rows whatever the
    sources and qualities are, and a source's prefix is the running sum less what its predecessors add up to.
    """
    rows = rows.drop("source_size", "target", "epochs", "taken")
    sources = written(targets(by_source(rows, weights), share, most), "sources")
    quality = F.greatest(F.coalesce(F.col("quality"), F.lit(1.0)), F.lit(1e-9))
    placed = sources.select("source", "source_size", "target", F.col("start").alias("_mix_start"))
    keyed = _with_source(rows.withColumn("_mix_key", -F.log(uniform(F.col("doc_id"), seed)) / quality), placed)
    order = [F.col("source").asc_nulls_last(), *map(F.col, ("_mix_key", "doc_id", "size"))]
    held = numbered(keyed, order, "_mix_rank", {"_mix_before": "size"}, size_of=rows, one_task=ONE_TASK_BYTES)
    epochs = F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)) + 1e-9)
    left = F.round(F.col("target") - epochs * F.col("source_size")).cast("long") - (F.col("_mix_before") - F.col("_mix_start"))
    part = F.least(F.greatest(left, F.lit(0)), F.col("size"))
    if not split_last:
        part = F.when(2 * left > F.col("size"), F.col("size")).otherwise(F.lit(0))
    taken = F.coalesce(epochs * F.col("size") + part, F.lit(0)).cast("long")
    return held.withColumns({"epochs": F.coalesce(epochs, F.lit(0)).cast("int"), "taken": taken}).drop("_mix_key", "_mix_rank", "_mix_before", "_mix_start")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, size, quality) of documents."""
    return docs.select("doc_id", "source", n_words(F.col(text)).alias("size"), word_quality(F.col(text)).alias("quality"))


def copies(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_TIMES) -> DataFrame:
    """The mixed corpus itself: each row of docs as often as the mix takes it, whole; columns as they were.

    Rows are counted by doc_id: repeated rows of one id are taken as one document that is as large as all of them.
    """
    rows = sized(docs).groupBy("doc_id").agg(F.min("source").alias("source"), F.sum("size").alias("size"), F.avg("quality").alias("quality"))
    plan = mix(written(rows, "sizes"), weights, share, most, split_last=False)
    times = plan.filter("size > 0 and taken > 0").select(F.col("doc_id").alias("_id"), (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    joined = docs.join(times, F.col("doc_id") == F.col("_id"))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(docs.columns)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    rows = written(sized(documents(spark, sf_dir)), "sizes")
    return mix(rows).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken")


OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)}][(place - 1) % {len(WEIGHTS)} + 1] AS weight FROM s),
o AS (SELECT *, (SELECT sum(source_size) * {SHARE} FROM w) AS total,
  coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
l AS (SELECT max((total - held) / free) AS level FROM o WHERE 2 * source_size / weight > (total - held) / free),
t AS (SELECT source, source_size, least(2.0 * source_size, weight * coalesce((SELECT level FROM l), 1e300))::DOUBLE AS target FROM w),
k AS (SELECT d.doc_id, d.size, t.*, -ln((('0x' || substr(md5('{SEED}:' || doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / {float(1 << 48)}) /
  coalesce((length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')), 0) + 1) / 2, 0.5) AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix,
  floor(target / nullif(source_size, 0) + 1e-9) AS epochs FROM k)
SELECT doc_id, size, source_size, target, CAST(coalesce(epochs * size + least(greatest(CAST(round(target - epochs * source_size) AS BIGINT) - prefix, 0), size), 0) AS BIGINT) AS taken FROM p"""
