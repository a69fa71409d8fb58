"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from rankloom.plans import catalogue as Q
from rankloom.plans.blend import BlendWeights

def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rows(table: str, key: str, text: str, contains: str) -> str:
    return f"SELECT {key} AS key, lower({text}) AS t, {key} AS pos FROM {table} WHERE contains(lower({text}), {_quoted(contains.lower())})"


def _osa(target: str) -> str:
    """osa(t, d): a row of the table at a time; in-row insertions are a running minimum."""
    b, m = _quoted(target), len(target)
    x = f"[CASE WHEN i = 0 THEN j + 1 ELSE least(prev[i + 1] + 1, prev[i] + (CASE WHEN substr(t, i, 1) = substr({b}, j + 1, 1) THEN 0 ELSE 1 END), CASE WHEN i > 1 AND j > 0 AND substr(t, i, 1) = substr({b}, j, 1) AND substr(t, i - 1, 1) = substr({b}, j + 1, 1) THEN before[i - 1] + 1 ELSE 1000000 END) END for i in range(0, length(t) + 1)]"
    return f"""osa_rows AS (
  SELECT t, 0 AS j, range(0, length(t) + 1) AS before, range(0, length(t) + 1) AS prev FROM (SELECT DISTINCT t FROM rows)
  UNION ALL
  SELECT t, j + 1, prev, [i - 1 + list_min([x[k] - (k - 1) for k in range(1, i + 1)]) for i in range(1, length(t) + 2)]
  FROM (SELECT t, j, prev, {x} AS x FROM osa_rows WHERE j < {m})
), osa AS (SELECT t, prev[length(t) + 1] AS d FROM osa_rows WHERE j = {m})"""


def _jaro_winkler(target: str) -> str:
    """jw(t, s)"""
    b, m = _quoted(target), len(target)
    reach = f"greatest(0, greatest(length(t), {m}) // 2 - 1)"
    prefix = " + ".join(f"(CASE WHEN length(t) >= {i} AND {m} >= {i} AND substr(t, 1, {i}) = substr({b}, 1, {i}) THEN 1 ELSE 0 END)" for i in range(1, 5))
    return f"""jw_rows AS (
  SELECT t, 0 AS i, []::BIGINT[] AS acc FROM (SELECT DISTINCT t FROM rows)
  UNION ALL
  SELECT t, i + 1, list_append(acc, coalesce([k for k in range(greatest(1, i + 1 - {reach}), least({m}, i + 1 + {reach}) + 1) if substr({b}, k, 1) = substr(t, i + 1, 1) AND NOT list_contains(acc, k)][1], 0))
  FROM jw_rows WHERE i < length(t)
), jw_found AS (
  SELECT t, [substr(t, p, 1) for p in range(1, length(t) + 1) if acc[p] > 0] AS a, [substr({b}, k, 1) for k in list_sort([z for z in acc if z > 0])] AS c
  FROM jw_rows WHERE i = length(t)
), jw AS (
  SELECT t, CASE WHEN t = {b} THEN 1.0 WHEN n = 0 THEN 0.0 ELSE jaro + 0.1 * ({prefix}) * (1 - jaro) END AS s
  FROM (SELECT t, n, (n / length(t) + n / {m} + (n - h) / n) / 3 AS jaro FROM (
    SELECT t, len(a)::DOUBLE AS n, len([1 for p in range(1, len(a) + 1) if a[p] <> c[p]]) / 2.0 AS h FROM jw_found))
)"""


def _soundex(expr: str) -> str:
    letters, digits = "BFPVCGJKQSXZDTLMNR", "111122222222334556"
    coded = f"translate(regexp_replace(upper({expr}), '[^{letters}]', '0', 'g'), '{letters}', '{digits}')"
    for d in "0123456":
        coded = f"regexp_replace({coded}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {expr} = '' THEN '0000' ELSE substr(upper({expr}), 1, 1) || rpad(substr(replace(substr({coded}, 2), '0', ''), 1, 3), 3, '0') END"


def _soundex_score(target: str) -> str:
    return "CASE " + " ".join(f"WHEN substr(a, 1, {n}) = substr(b, 1, {n}) THEN {n / 4}" for n in (4, 3, 2, 1)) + " ELSE 0.0 END", f"SELECT t, {_soundex('t')} AS a, {_soundex(_quoted(target))} AS b FROM (SELECT DISTINCT t FROM rows)"


def _grams(expr: str, n: int) -> str:
    """Byte n-grams, as digits of the hexadecimal form."""
    return f"list_distinct([substr(hex(encode({expr})), 2 * i - 1, {2 * n}) for i in range(1, greatest(1, strlen({expr}) - {n - 2}))])"


def _jaccard(target: str, n: int) -> str:
    return f"""jac AS (
  SELECT t, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS s
  FROM (SELECT t, {_grams('t', n)} AS a, {_grams(_quoted(target), n)} AS b FROM (SELECT DISTINCT t FROM rows)))"""


def _tfidf(target: str) -> str:
    """cos(pos, s)"""
    words = "unnest(regexp_extract_all({}, '[\\p{{L}}\\p{{Nd}}]+'))"
    return f"""tok AS (SELECT pos, w, count(*)::DOUBLE AS tf FROM (SELECT pos, {words.format('t')} AS w FROM rows) GROUP BY ALL),
want AS (SELECT w, count(*)::DOUBLE AS tf FROM (SELECT {words.format(_quoted(target))} AS w) GROUP BY ALL),
idf AS (SELECT w, ln((SELECT count(*) + 1 FROM rows)::DOUBLE / (1 + count(*))) + 1 AS idf FROM (SELECT pos, w FROM tok UNION ALL SELECT NULL, w FROM want) GROUP BY w),
own AS (SELECT tok.pos, sqrt(sum((tok.tf * idf) ** 2)) AS norm, sum(tok.tf * coalesce(want.tf, 0) * idf * idf) AS dot FROM tok JOIN idf USING (w) LEFT JOIN want USING (w) GROUP BY tok.pos),
cos AS (SELECT rows.pos, coalesce(dot / nullif(norm * (SELECT sqrt(sum((tf * idf) ** 2)) FROM want JOIN idf USING (w)), 0), 0) AS s FROM rows LEFT JOIN own USING (pos))"""


def _final(score: str, ascending: bool, joins: str = "") -> str:
    return f"SELECT key, score, row_number() OVER (ORDER BY score {'ASC' if ascending else 'DESC'}, pos) AS rank FROM (SELECT rows.key, rows.pos, round(({score})::DOUBLE, 9) AS score FROM rows {joins})"


def _share(distance: str, target: str) -> str:
    longer = f"greatest(strlen(rows.t), {len(target.encode())})"
    return f"CASE WHEN {longer} = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - {distance}::DOUBLE / {longer}) END"


def _blend(target: str, w: BlendWeights, vector: str | None) -> tuple[str, str, str]:
    score, codes = _soundex_score(target)
    ctes = ", ".join([_osa(target), _jaro_winkler(target), _tfidf(target), _jaccard(target, w.ngram), f"sdx AS (SELECT t, {score} AS s FROM ({codes}))"])
    joins = "JOIN osa USING (t) JOIN jw USING (t) JOIN jac USING (t) JOIN sdx USING (t) JOIN cos ON cos.pos = rows.pos"
    parts = [(w.levenshtein, _share(f"levenshtein(rows.t, {_quoted(target)})", target)), (w.osa, _share("osa.d", target)), (w.jaro_winkler, "jw.s"), (w.cosine, "cos.s"), (w.jaccard, "jac.s"), (w.soundex, "sdx.s")]
    if vector:
        parts.append((w.vector, vector))
    total = sum(x for x, _ in parts) or 1
    return ctes, "(" + " + ".join(f"{x} * ({s})" for x, s in parts) + f") / {total}", joins


def _search(name: str) -> str:
    metric, (table, key, text), target, contains = Q.SEARCHES[name]
    t = target.lower()
    rows = f"rows AS ({_rows(table, key, text, contains)})"
    if metric == "levenshtein":
        return f"WITH {rows} {_final(f'levenshtein(rows.t, {_quoted(t)})', True)}"
    if metric == "osa":
        return f"WITH RECURSIVE {rows}, {_osa(t)} {_final('osa.d', True, 'JOIN osa USING (t)')}"
    if metric == "jaro_winkler":
        return f"WITH RECURSIVE {rows}, {_jaro_winkler(t)} {_final('jw.s', False, 'JOIN jw USING (t)')}"
    if metric == "tfidf":
        return f"WITH {rows}, {_tfidf(t)} {_final('cos.s', False, 'JOIN cos ON cos.pos = rows.pos')}"
    if metric == "soundex":
        score, codes = _soundex_score(t)
        return f"WITH {rows}, sdx AS (SELECT t, {score} AS s FROM ({codes})) {_final('sdx.s', False, 'JOIN sdx USING (t)')}"
    if metric == "jaccard":
        return f"WITH {rows}, {_jaccard(t, 3)} {_final('jac.s', False, 'JOIN jac USING (t)')}"
    ctes, score, joins = _blend(t, BlendWeights(vector=0.0), None)
    return f"WITH RECURSIVE {rows}, {ctes} {_final(score, False, joins)}"


_VECTOR = "[" + ", ".join(f"{x!r}::DOUBLE" for x in Q.QUERY_VECTOR) + "]"


def _embedded(contains: str) -> str:
    cosine = f"coalesce(list_dot_product(v, {_VECTOR}) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({_VECTOR}, {_VECTOR})), 0), 0)"
    return f"rows AS (SELECT key, t, key AS pos, {cosine} AS vec FROM (SELECT vec_id AS key, lower(p_name) AS t, embedding::DOUBLE[] AS v FROM embeddings JOIN part ON p_partkey = vec_id) WHERE contains(t, {_quoted(contains.lower())}) AND len(v) = {len(Q.QUERY_VECTOR)})"


def _vector_blend(contains: str, w: BlendWeights) -> str:
    ctes, score, joins = _blend(Q.PART_TARGET.lower(), w, "rows.vec")
    return f"WITH RECURSIVE {_embedded(contains)}, {ctes} {_final(score, False, joins)}"


_OPS = "ops AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op, user_id AS key, value AS arg FROM events)"
_LIVE = "live AS (SELECT * FROM (SELECT *, coalesce(max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY key), -1) AS gone FROM ops) WHERE op = 'set' AND seq > gone)"
_CENTS = "ops AS (SELECT event_id AS seq, event_type AS kind, user_id AS key, CAST(round(value * 100) AS BIGINT) AS arg FROM events)"
_PLACED = """live AS (SELECT * FROM (SELECT *, coalesce(max(CASE WHEN kind = 'error' THEN seq END) OVER (PARTITION BY key), -1) AS gone FROM ops) WHERE kind <> 'error' AND seq > gone),
placed AS (SELECT *, min(CASE WHEN kind <> 'signup' THEN seq END) OVER (PARTITION BY key) AS pos, coalesce(max(CASE WHEN {sets} THEN seq END) OVER (PARTITION BY key), -1) AS last_set FROM live)"""
_LEASES = "leases AS (SELECT user_id AS id, min(ts) AS created_at, max(ts) AS last_used, count(*) % 2 = 1 AS in_use, min(event_id) AS pos FROM events GROUP BY user_id)"
_CUSTOMERS = "held AS (SELECT c_custkey AS key, c_name AS value FROM customer WHERE c_acctbal > 0)"
_SECONDS = "(epoch_us(TIMESTAMP '{}') / 1e6 - epoch_us({}) / 1e6)"


def oracle_sql() -> dict[str, str]:
    out = {name: _search(name) for name in Q.SEARCHES}
    out |= {
        "ordered_scan": "SELECT p_partkey AS key, p_name AS value, row_number() OVER (ORDER BY p_partkey) AS rank FROM part",
        "ordered_keys": "SELECT p_partkey AS key, row_number() OVER (ORDER BY p_partkey) AS rank FROM part",
        "ordered_values": "SELECT p_name AS value, row_number() OVER (ORDER BY p_partkey) AS rank FROM part",
        "len": "SELECT count(*) AS len FROM part",
        "get_batch": f"WITH {_CUSTOMERS}, wanted AS (SELECT DISTINCT o_custkey AS key FROM orders) SELECT wanted.key, value, held.key IS NOT NULL AS found FROM wanted LEFT JOIN held ON held.key = wanted.key",
        "exists_batch": f"WITH {_CUSTOMERS} SELECT DISTINCT o_custkey AS key FROM orders WHERE EXISTS (SELECT 1 FROM held WHERE held.key = o_custkey)",
        "sort_field": "SELECT p_partkey AS key, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part",
        "sort_multi_field": "SELECT c_custkey AS key, row_number() OVER (ORDER BY c_mktsegment, c_nationkey DESC, c_acctbal, c_custkey) AS rank FROM customer",
        "vector_only": f"WITH {_embedded(Q.PART_FILTER)} {_final('rows.vec', False)}",
        "vector_combined": _vector_blend("", Q.OTHER_WEIGHTS),
        "vector_combined_filtered": _vector_blend(Q.PART_FILTER, BlendWeights()),
        "oplog_fold": f"WITH {_OPS}, {_LIVE} SELECT key, max_by(arg, seq) AS value, min(seq) AS pos FROM live GROUP BY key",
        "oplog_delete_reinsert": f"WITH {_OPS}, {_LIVE} SELECT key, value, row_number() OVER (ORDER BY pos) AS rank FROM (SELECT key, max_by(arg, seq) AS value, min(seq) AS pos FROM live WHERE gone >= 0 GROUP BY key)",
        "oplog_clear": f"WITH {_OPS.replace('CASE WHEN', f'CASE WHEN value >= {Q.CLEAR_FROM} THEN {_quoted("clear")} WHEN')}, {_LIVE} SELECT key, max_by(arg, seq) AS value, min(seq) AS pos FROM live WHERE seq > (SELECT coalesce(max(seq), -1) FROM ops WHERE op = 'clear') GROUP BY key",
        "set_or_update": f"""WITH {_CENTS}, {_PLACED.format(sets="kind = 'view'")}
SELECT key, CAST(sum(arg) AS BIGINT) AS cents, pos FROM placed WHERE seq >= pos AND seq >= last_set GROUP BY key, pos""",
        "update_checked": f"""WITH {_CENTS}, {_PLACED.format(sets="false")}
SELECT key, CAST(coalesce(sum(arg) FILTER (kind = 'click' OR arg % 2 = 0), 0) AS BIGINT) AS cents, pos FROM placed WHERE seq >= pos GROUP BY key, pos""",
        "update_errors": f"""WITH {_CENTS}, w AS (SELECT *, coalesce(max(CASE WHEN kind NOT IN ('error', 'signup') THEN seq END) OVER before, -1) AS made, coalesce(max(CASE WHEN kind = 'error' THEN seq END) OVER before, -1) AS gone FROM ops
  WINDOW before AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, key, CASE WHEN kind = 'signup' AND made <= gone THEN 'key not found' ELSE 'odd amount' END AS error FROM w
WHERE kind NOT IN ('error', 'click') AND (arg % 2 = 1 OR kind = 'signup' AND made <= gone)""",
        "direct_update": "SELECT p_partkey AS key, CASE WHEN p_size = 7 THEN 9.5 ELSE p_retailprice END AS value FROM part",
        "missing_keys": f"WITH {_CUSTOMERS} SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT key FROM held)",
        "release": f"WITH {_LEASES} SELECT id, in_use AND NOT (id % 7 = 0 AND id < 4000) AS in_use, round(epoch_us(CASE WHEN in_use AND id % 7 = 0 AND id < 4000 THEN TIMESTAMP '{Q.NOW}' ELSE last_used END) / 1e6, 3) AS last_used_s FROM leases",
        "release_errors": f"WITH {_LEASES} SELECT r.id, CASE WHEN in_use IS NULL THEN 'not found' ELSE 'not in use' END AS error FROM (SELECT unnest(range(0, 4000, 7)) AS id) r LEFT JOIN leases ON leases.id = r.id WHERE in_use IS NULL OR NOT in_use",
        "maintenance": f"WITH {_LEASES} SELECT count(*) FILTER (v) AS valid, count(*) FILTER (v AND NOT in_use) AS available, count(*) FILTER (v AND in_use) AS in_use, count(*) FILTER (NOT v) AS expired FROM (SELECT in_use, {_SECONDS.format('2024-01-01 03:00:00', 'created_at')} <= {Q.LIFETIME_S} AS v FROM leases)",
        "reset_pool": "SELECT n AS id, false AS in_use, n AS pos FROM (SELECT unnest(range(1, 11)) AS n)",
        "top_k": f"SELECT * FROM ({_search('levenshtein')}) WHERE rank <= 10",
        "update_generic": f"WITH {_CUSTOMERS} SELECT key, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = key) THEN value || '!' ELSE value END AS value FROM held",
        "field_update": "SELECT p_partkey AS key, CASE WHEN p_size = 7 THEN 'updated' ELSE p_name END AS p_name, p_size, CASE WHEN p_size = 7 THEN 25.5 ELSE p_retailprice END AS p_retailprice FROM part",
        "delete_batch": f"WITH {_CUSTOMERS} SELECT key, value FROM held WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = key AND o_orderstatus = 'P' AND o_totalprice > 300000)",
        "pool_status": f"WITH {_LEASES} SELECT count(*) AS total, count(*) FILTER (NOT in_use) AS available, count(*) FILTER (in_use) AS in_use FROM leases",
        "pool_ages": f"WITH {_LEASES} SELECT id, in_use, round({_SECONDS.format(Q.NOW, 'created_at')}, 3) AS age_s, round({_SECONDS.format(Q.NOW, 'last_used')}, 3) AS idle_s FROM leases",
        "ttl_expire": f"WITH {_LEASES} SELECT id FROM leases WHERE {_SECONDS.format('2024-01-01 03:00:00', 'created_at')} <= {Q.LIFETIME_S}",
        "idle_check": f"WITH {_LEASES} SELECT id FROM leases WHERE {_SECONDS.format(Q.NOW, 'last_used')} > {Q.IDLE_S}",
        "first_available": f"WITH {_LEASES} SELECT id FROM leases WHERE NOT in_use ORDER BY pos LIMIT 1",
    }
    return out
