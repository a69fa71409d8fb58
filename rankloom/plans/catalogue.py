"""The registered queries over the star-schema tables, and the same in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import changelog as C
from rankloom.operators import frame, rank, resources
from rankloom.operators.numbering import numbered
from rankloom.operators.sorting import OrderBy, order_columns
from rankloom.plans.blend import BlendWeights
from rankloom.sources.io import as_ordered, read_table

#: Parameters of the queries.
PART_TARGET, PART_FILTER = "Red Widget", "RE"
NAME_TARGET, NAME_FILTER = "Customer#000000123", "99"
SUPPLIER_TARGET, SUPPLIER_FILTER = "Supplier#000000042", "7"
DOC_TARGET, DOC_FILTER = "the of and that retitioning", "license"
#: Letters beyond ASCII, and numerals that are no part of a token.
ACCENTED_TARGET = "\u00bdf\u00fcr x\u00b2 avec\u2167la\u2166 s\u00ednñ \u00e9t\u00e9 \u00dcBER"
QUERY_VECTOR = [math.sin(i + 1) for i in range(64)]
LIFETIME_S, IDLE_S = 3600.0 * 2, 3600.0 * 6
CLEAR_FROM = 360.0
NOW = "2024-01-31 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]


def parts(spark: SparkSession, d: str) -> DataFrame:
    return as_ordered(read_table(spark, d, "part"), "p_partkey", "p_name", "p_partkey")


def _ranked_positions(df: DataFrame) -> DataFrame:
    return numbered(df, [F.col("_pos").asc()])


# --- ordered tables -------------------------------------------------------------------------------------------------


def ordered_scan(spark, d):
    return _ranked_positions(parts(spark, d)).select("key", "value", "rank")


def ordered_keys(spark, d):
    return _ranked_positions(parts(spark, d)).select("key", "rank")


def ordered_values(spark, d):
    return _ranked_positions(parts(spark, d)).select("value", "rank")


def length(spark, d):
    return frame.length(parts(spark, d))


def _wanted(spark, d):
    return read_table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")


def _customers(spark, d):
    return as_ordered(read_table(spark, d, "customer").filter("c_acctbal > 0"), "c_custkey", "c_name", "c_custkey")


def get_batch(spark, d):
    wanted = _wanted(spark, d).select("key").distinct()
    return frame.get_batch(_customers(spark, d), wanted)


def exists_batch(spark, d):
    return frame.exists_batch(_customers(spark, d), _wanted(spark, d).select("key").distinct())


def _structs(spark, d):
    t = read_table(spark, d, "part")
    return as_ordered(t, "p_partkey", F.struct("p_name", "p_size", "p_retailprice"), "p_partkey")


def _sorted(df, order):
    return numbered(df, order_columns(df, order)).select("key", "rank")


def sort_field(spark, d):
    return _sorted(_structs(spark, d), [OrderBy("p_retailprice", descending=True)])


def sort_multi_field(spark, d):
    t = as_ordered(read_table(spark, d, "customer"), "c_custkey", F.struct("c_mktsegment", "c_nationkey", "c_acctbal"), "c_custkey")
    return _sorted(t, [OrderBy("c_mktsegment"), OrderBy("c_nationkey", descending=True), OrderBy("c_acctbal")])


# --- ranked search --------------------------------------------------------------------------------------------------


def _search(metric: str, table: str, key: str, text: str, target: str, contains: str) -> Query:
    def run(spark, d):
        return rank.rank_by(as_ordered(read_table(spark, d, table), key, text, key), metric, target, True, contains).select("key", "score", "rank")

    return run


PART = ("part", "p_partkey", "p_name")
CUSTOMER = ("customer", "c_custkey", "c_name")
SUPPLIER = ("supplier", "s_suppkey", "s_name")
DOCUMENT = ("documents", "doc_id", "text")

#: name: metric, table with key and text, target, filter
SEARCHES = {
    "levenshtein": ("levenshtein", PART, PART_TARGET, ""),
    "levenshtein_filtered": ("levenshtein", PART, PART_TARGET, PART_FILTER),
    "osa": ("osa", PART, PART_TARGET, ""),
    "osa_filtered": ("osa", PART, PART_TARGET, PART_FILTER),
    "jaro_winkler": ("jaro_winkler", PART, PART_TARGET, ""),
    "jaro_winkler_filtered": ("jaro_winkler", CUSTOMER, NAME_TARGET, NAME_FILTER),
    "tfidf": ("tfidf", DOCUMENT, DOC_TARGET, ""),
    "tfidf_filtered": ("tfidf", DOCUMENT, DOC_TARGET, DOC_FILTER),
    "tfidf_accented": ("tfidf", DOCUMENT, ACCENTED_TARGET, ""),
    "soundex": ("soundex", PART, PART_TARGET, ""),
    "soundex_filtered": ("soundex", SUPPLIER, SUPPLIER_TARGET, SUPPLIER_FILTER),
    "jaccard": ("jaccard", DOCUMENT, DOC_TARGET, ""),
    "jaccard_filtered": ("jaccard", PART, PART_TARGET, PART_FILTER),
    "combined": ("combined", PART, PART_TARGET, ""),
    "combined_filtered": ("combined", PART, PART_TARGET, PART_FILTER),
}


def _embedded(spark, d) -> DataFrame:
    """Embeddings with the part name of the same number: the text of a row."""
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "embedding")
    p = read_table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_name")
    return e.join(p, "key").select("key", F.struct(F.col("p_name").alias("text"), F.col("embedding").alias("vector")).alias("value"), F.col("key").alias("_pos"))


def vector_only(spark, d):
    df = _embedded(spark, d)
    return rank.rank_by_vector(df, QUERY_VECTOR, F.col("value.text"), F.col("value.vector"), 64, True, PART_FILTER).select("key", "score", "rank")


def _vector_blend(contains: str, weights: BlendWeights | None) -> Query:
    def run(spark, d):
        df = _embedded(spark, d)
        return rank.rank_by_vector_and_text(df, PART_TARGET, QUERY_VECTOR, F.col("value.text"), F.col("value.vector"), 0, weights, True, contains).select("key", "score", "rank")

    return run


OTHER_WEIGHTS = BlendWeights(vector=4.0, cosine=2.0, jaro_winkler=0.5, levenshtein=0.5, osa=0.5, jaccard=0.5, soundex=0.25, ngram=2)


# --- changes --------------------------------------------------------------------------------------------------------


def _ops(spark, d) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), F.col("user_id").alias("key"), F.col("value").alias("arg"))


def oplog_fold(spark, d):
    return C.fold_sets(_ops(spark, d)).select("key", "value", F.col("_pos").alias("pos"))


def oplog_delete_reinsert(spark, d):
    """Keys that were deleted and set again, with their new place in the order."""
    ops = _ops(spark, d)
    gone = ops.filter("op = 'delete'").select("key").distinct()
    return numbered(C.fold_sets(ops).join(gone, "key", "left_semi"), [F.col("_pos").asc()]).select("key", "value", "rank")


def oplog_clear(spark, d):
    ops = _ops(spark, d).withColumn("op", F.when(F.col("arg") >= CLEAR_FROM, "clear").otherwise(F.col("op")))
    return C.fold_sets(ops).select("key", "value", F.col("_pos").alias("pos"))


def _cent_ops(spark, d, sign: str) -> DataFrame:
    """Views set, clicks set or update, signups update what is there, errors delete, the rest is an update: of whole cents."""
    e = read_table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", sign).when(F.col("event_type") == "click", "set_or_update").when(F.col("event_type") == "signup", "update_generic").otherwise("update")
    return e.select(F.col("event_id").alias("seq"), kind.alias("op"), F.col("user_id").alias("key"), F.round(F.col("value") * 100).cast("long").alias("arg"))


def set_or_update(spark, d):
    """Views set, other events add to what is there; the sum is rounded at every step to whole cents."""
    return C.fold_sums(_cent_ops(spark, d, "set")).select("key", F.col("value").alias("cents"), F.col("_pos").alias("pos"))


def _odd(value, arg):
    return F.when(arg % 2 == 1, F.lit("odd amount"))


def update_checked(spark, d):
    """All but errors, clicks and signups are updates, which fail on odd amounts: a key made by such a one stays at zero."""
    return C.fold(_cent_ops(spark, d, "update"), F.lit(0), lambda v, x: v + x, fails=_odd).select("key", F.col("value").alias("cents"), F.col("_pos").alias("pos"))


def update_errors(spark, d):
    """The updates that failed, and why."""
    return C.fold_errors(_cent_ops(spark, d, "update"), F.lit(0), lambda v, x: v + x, fails=_odd)


def direct_update(spark, d):
    """Parts of one size get one price, whatever they had."""
    df = as_ordered(read_table(spark, d, "part"), "p_partkey", "p_retailprice", "p_partkey")
    return C.update_keys(df, read_table(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("key")), C.DirectUpdate(9.5)).select("key", "value")


def missing_keys(spark, d):
    """Customers with orders whom an update of positive balances would refuse."""
    return C.missing_keys(_customers(spark, d), _wanted(spark, d).select("key").distinct())


def update_generic(spark, d):
    """Existing keys get a new value, absent ones don't appear."""
    held = _customers(spark, d)
    return C.update_keys(held, _wanted(spark, d), C.FunctionUpdate(lambda v: F.concat(v, F.lit("!")))).select("key", "value")


def field_update(spark, d):
    df = as_ordered(read_table(spark, d, "part"), "p_partkey", F.struct("p_name", "p_size", "p_retailprice"), "p_partkey")
    wanted = df.filter("value.p_size = 7").select("key")
    out = C.update_keys(df, wanted, C.FieldUpdate({"p_name": "updated", "p_retailprice": 25.5}))
    return out.select("key", "value.p_name", "value.p_size", "value.p_retailprice")


def delete_batch(spark, d):
    gone = read_table(spark, d, "orders").filter("o_orderstatus = 'P' and o_totalprice > 300000").select(F.col("o_custkey").alias("key"))
    return C.delete_keys(_customers(spark, d), gone).select("key", "value")


# --- leased resources -----------------------------------------------------------------------------------------------


def _leases(spark, d) -> DataFrame:
    """A resource for each user: made at the first event, last used at the last one, in use after an odd number."""
    e = read_table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_used"), (F.count(F.lit(1)) % 2 == 1).alias("in_use"), F.min("event_id").alias("_pos"))


def _now(spark, d):
    return F.lit(NOW).cast("timestamp")


def pool_status(spark, d):
    return resources.status(_leases(spark, d))


def pool_ages(spark, d):
    return resources.with_ages(_leases(spark, d), _now(spark, d)).select("id", "in_use", F.round("age_s", 3).alias("age_s"), F.round("idle_s", 3).alias("idle_s"))


def ttl_expire(spark, d):
    return resources.unexpired(_leases(spark, d), F.lit("2024-01-01 03:00:00").cast("timestamp"), LIFETIME_S).select("id")


def idle_check(spark, d):
    return resources.needs_check(_leases(spark, d), _now(spark, d), IDLE_S).select("id")


def first_available(spark, d):
    return resources.first_available(_leases(spark, d)).select("id")


def _returned(spark, d) -> DataFrame:
    """Resources to give back: every seventh number, some of which aren't in use or don't exist."""
    return spark.range(0, 4000, 7).toDF("id")


def release(spark, d):
    out = resources.released(_leases(spark, d), _returned(spark, d), _now(spark, d))
    return out.select("id", "in_use", F.round(F.unix_micros("last_used") / 1e6, 3).alias("last_used_s"))


def release_errors(spark, d):
    return resources.release_errors(_leases(spark, d), _returned(spark, d))


def maintenance(spark, d):
    """What expiry would leave and take."""
    return resources.maintained(_leases(spark, d), F.lit("2024-01-01 03:00:00").cast("timestamp"), LIFETIME_S)[1]


def reset_pool(spark, d):
    return resources.reset(_leases(spark, d), 10, _now(spark, d)).select("id", "in_use", F.col("_pos").alias("pos"))


def top_k(spark, d):
    """The ten best parts."""
    return rank.rank_by(parts(spark, d), "levenshtein", PART_TARGET, True, k=10).select("key", "score", "rank")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {f.__name__: f for f in (ordered_scan, ordered_keys, ordered_values, get_batch, exists_batch, sort_field, sort_multi_field, vector_only, oplog_fold, oplog_delete_reinsert, oplog_clear, set_or_update, update_generic, field_update, delete_batch, pool_status, pool_ages, ttl_expire, idle_check, first_available, update_checked, update_errors, direct_update, missing_keys, release, release_errors, maintenance, reset_pool, top_k)}
    out["len"] = length
    for name, (metric, (table, key, text), target, contains) in SEARCHES.items():
        out[name] = _search(metric, table, key, text, target, contains)
    out["vector_combined"] = _vector_blend("", OTHER_WEIGHTS)
    out["vector_combined_filtered"] = _vector_blend(PART_FILTER, None)
    return out
