"""SQL (DuckDB) for the registered queries, over the same tables."""

from __future__ import annotations

ITEMS = """
e AS (SELECT event_id, user_id, event_type, props, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k,
    CAST(count(*) FILTER (event_type IN ('view', 'click')) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS n FROM events),
e2 AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'ENTRIES' WHEN event_type = 'purchase' THEN 'PUT'
    WHEN event_type = 'error' THEN 'COMPACT' WHEN k < 2 THEN 'CLEAN' ELSE 'DEL' END AS kind FROM e),
items AS (SELECT CAST(0 AS INTEGER) AS queue, CAST(1 + event_id // 100 AS BIGINT) AS file_seq, event_id AS lsn, user_id AS region_id, kind,
    CASE WHEN kind = 'ENTRIES' THEN 3 * n - k % 3 WHEN kind = 'COMPACT' THEN greatest(0, 3 * n - k % 30) END AS first_index,
    CASE WHEN kind = 'ENTRIES' THEN 3 * n + 2 END AS last_index,
    CASE WHEN kind IN ('PUT', 'DEL') THEN 'k' || (k % 10) END AS key, CASE WHEN kind = 'PUT' THEN props END AS value FROM e2)"""


def _runs(items: str, out: str) -> str:
    return f"""
{out}_f AS (SELECT *, coalesce(max(CASE WHEN kind = 'CLEAN' THEN 1 ELSE 0 END) OVER later, 0) AS dead,
    min(CASE WHEN kind = 'ENTRIES' THEN first_index END) OVER later AS st, max(CASE WHEN kind = 'COMPACT' THEN first_index END) OVER later AS fl
    FROM {items} WINDOW later AS (PARTITION BY region_id ORDER BY lsn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{out}_l AS (SELECT region_id, lsn, queue, file_seq, greatest(first_index, coalesce(fl, first_index)) AS lo, least(last_index, coalesce(st - 1, last_index)) AS hi
    FROM {out}_f WHERE kind = 'ENTRIES' AND dead = 0),
{out} AS (SELECT * FROM {out}_l WHERE lo <= hi)"""


def _kvs(items: str, out: str) -> str:
    return f"""
{out}_w AS (SELECT region_id, key, arg_max(kind, lsn) AS kind, arg_max(value, lsn) AS value, arg_max(queue, lsn) AS queue, arg_max(file_seq, lsn) AS file_seq, max(lsn) AS lsn
    FROM {items} WHERE kind IN ('PUT', 'DEL') GROUP BY region_id, key),
{out}_c AS (SELECT region_id, max(lsn) AS clean_lsn FROM {items} WHERE kind = 'CLEAN' GROUP BY region_id),
{out} AS (SELECT w.region_id, key, value, queue, file_seq, lsn FROM {out}_w w LEFT JOIN {out}_c c ON w.region_id = c.region_id
    WHERE kind = 'PUT' AND (clean_lsn IS NULL OR lsn > clean_lsn))"""


RUNS = ITEMS + "," + _runs("items", "runs")
KVS = ITEMS + "," + _kvs("items", "kvs")
REGIONS = """
regions AS (SELECT region_id FROM items GROUP BY region_id
    HAVING max(CASE WHEN kind <> 'CLEAN' THEN lsn END) > coalesce(max(CASE WHEN kind = 'CLEAN' THEN lsn END), -1))"""
ENDS = "ends AS (SELECT region_id, min(lo) AS first_index, max(hi) AS last_index, CAST(sum(hi - lo + 1) AS BIGINT) AS entry_count FROM runs GROUP BY region_id)"
HOLED = "holed AS (SELECT * FROM items WHERE kind <> 'ENTRIES' OR lsn % 17 <> 0)"
TWO = (
    ITEMS + "," + _runs("items", "runs") + "," + _kvs("items", "kvs") + "," + REGIONS
    + """,
g AS (SELECT max(file_seq) AS last_file, max(file_seq) * 9 // 10 AS gate FROM items),
old_items AS (SELECT items.* FROM items, g WHERE file_seq <= gate),
app AS (SELECT items.* FROM items, g WHERE file_seq > gate * 4 // 5),"""
    + _runs("old_items", "old_runs") + "," + _kvs("old_items", "old_kvs") + "," + _runs("app", "new_runs") + "," + _kvs("app", "new_kvs")
    + """,
rw_items AS (SELECT 1 AS queue, CAST(1 + file_seq // 10 AS BIGINT) AS file_seq, lsn, region_id, 'ENTRIES' AS kind, lo AS first_index, hi AS last_index FROM old_runs
    UNION ALL SELECT 1, CAST(1 + file_seq // 10 AS BIGINT), lsn, region_id, 'PUT', NULL, NULL FROM old_kvs),
all_items AS (SELECT * FROM rw_items UNION ALL SELECT queue, file_seq, lsn, region_id, kind, first_index, last_index FROM app),
tomb AS (SELECT region_id, max(CASE WHEN kind = 'CLEAN' THEN 1 ELSE 0 END) AS cl, max(CASE WHEN kind = 'COMPACT' THEN first_index END) AS co FROM app GROUP BY region_id),
r1 AS (SELECT o.region_id, lsn, 1 AS queue, CAST(1 + file_seq // 10 AS BIGINT) AS file_seq, greatest(lo, coalesce(co, lo)) AS lo, hi
    FROM old_runs o LEFT JOIN tomb t ON o.region_id = t.region_id WHERE coalesce(cl, 0) = 0 AND greatest(lo, coalesce(co, lo)) <= hi),
fa AS (SELECT region_id, min(lo) AS fa FROM new_runs GROUP BY region_id),
fl AS (SELECT region_id, max(hi) AS fl FROM r1 GROUP BY region_id),
r2 AS (SELECT r1.region_id, lsn, queue, file_seq, lo, least(hi, coalesce(fa - 1, hi)) AS hi FROM r1 JOIN fl ON r1.region_id = fl.region_id
    LEFT JOIN fa ON r1.region_id = fa.region_id WHERE fa IS NULL OR fa <= fl + 1),
m_runs AS (SELECT * FROM r2 WHERE lo <= hi UNION ALL SELECT * FROM new_runs),
dels AS (SELECT DISTINCT region_id, key FROM app WHERE kind = 'DEL'),
k1 AS (SELECT o.region_id, o.key, value, 1 AS queue, CAST(1 + file_seq // 10 AS BIGINT) AS file_seq, lsn FROM old_kvs o LEFT JOIN tomb t ON o.region_id = t.region_id
    WHERE coalesce(cl, 0) = 0 AND NOT EXISTS (SELECT 1 FROM dels d WHERE d.region_id = o.region_id AND d.key = o.key)
    AND NOT EXISTS (SELECT 1 FROM new_kvs n WHERE n.region_id = o.region_id AND n.key = o.key)),
m_kvs AS (SELECT * FROM k1 UNION ALL SELECT * FROM new_kvs),
se AS (SELECT region_id, min(lo) AS first_index, max(hi) AS last_index, sum(hi - lo + 1) AS ec, sum(CASE WHEN queue = 1 THEN hi - lo + 1 ELSE 0 END) AS rc,
    min(CASE WHEN queue = 0 THEN file_seq END) AS e0, min(CASE WHEN queue = 1 THEN file_seq END) AS e1 FROM m_runs GROUP BY region_id),
sk AS (SELECT region_id, count(*) AS kc, min(CASE WHEN queue = 0 THEN file_seq END) AS k0, min(CASE WHEN queue = 1 THEN file_seq END) AS k1 FROM m_kvs GROUP BY region_id),
state AS (SELECT r.region_id, first_index, last_index, CAST(coalesce(ec, 0) AS BIGINT) AS entry_count, CAST(coalesce(rc, 0) AS BIGINT) AS rewrite_count, coalesce(kc, 0) AS kv_count,
    least(e0, k0) AS min_append_seq, least(e1, k1) AS min_rewrite_seq
    FROM regions r LEFT JOIN se ON r.region_id = se.region_id LEFT JOIN sk ON r.region_id = sk.region_id),
span AS (SELECT queue, min(file_seq) AS first_seq, max(file_seq) AS active_seq FROM all_items GROUP BY queue),
garbage AS (SELECT CAST(w AS BIGINT) AS written, CAST(w - l AS BIGINT) AS deleted, coalesce((w - l) / nullif(CAST(w AS DOUBLE), 0), 0.0) AS ratio FROM
    (SELECT coalesce(sum(CASE kind WHEN 'ENTRIES' THEN last_index - first_index + 1 ELSE 1 END), 0) AS w FROM rw_items),
    (SELECT coalesce((SELECT sum(hi - lo + 1) FROM m_runs WHERE queue = 1), 0) + (SELECT count(*) FROM m_kvs WHERE queue = 1) AS l)),
marks AS (SELECT least(first_seq + CAST(floor((active_seq - first_seq + 1) * 0.7) AS BIGINT), active_seq - 1) AS rewrite_seq,
    least(first_seq + CAST(floor((active_seq - first_seq + 1) * 0.2) AS BIGINT), active_seq - 1) AS compact_seq FROM span WHERE queue = 0 AND first_seq < active_seq),
m_ord AS (SELECT region_id, file_seq, sum(hi - lo + 1) OVER (PARTITION BY region_id ORDER BY lo) AS upto, sum(hi - lo + 1) OVER (PARTITION BY region_id ORDER BY lo) - (hi - lo + 1) AS before FROM m_runs)"""
)
#: Planner decisions; {counter} is the counter of earlier requests.
CANDIDATES = """,
heavy AS (SELECT s.region_id,
    EXISTS (SELECT 1 FROM m_ord o WHERE o.region_id = s.region_id AND 32 > before AND 32 <= upto AND o.file_seq <= rewrite_seq) AS full_heavy,
    EXISTS (SELECT 1 FROM m_ord o WHERE o.region_id = s.region_id AND 32 + s.rewrite_count > before AND 32 + s.rewrite_count <= upto AND o.file_seq <= rewrite_seq) AS append_heavy
    FROM state s, marks),
decide AS (SELECT s.region_id, (coalesce(min_append_seq < compact_seq, false) OR rewrite_count > 0) AND full_heavy AS ask, append_heavy,
    coalesce(min_append_seq <= rewrite_seq, false) AS has, CAST({counter} AS INTEGER) AS c FROM state s JOIN heavy h ON s.region_id = h.region_id, marks),
cand AS (SELECT region_id, ask AS should_compact, CASE WHEN ask AND c < 9 THEN false WHEN ask THEN has ELSE NOT append_heavy AND has END AS do_rewrite,
    CAST(CASE WHEN ask AND c < 9 THEN c + 1 ELSE 0 END AS INTEGER) AS counter FROM decide)"""
GATE34 = "(SELECT max(file_seq) * 3 // 4 FROM items)"
LOST = (
    ITEMS + "," + _runs("items", "runs")
    + """,
lost AS (SELECT region_id, lsn, dead, last_index - first_index + 1 AS size, greatest(0, least(last_index, coalesce(st - 1, last_index)) - first_index + 1) AS lft,
    greatest(0, least(last_index, coalesce(st - 1, last_index)) - greatest(first_index, coalesce(fl, first_index)) + 1) AS live FROM runs_f WHERE kind = 'ENTRIES')"""
)
STRICT = """,
s1 AS (SELECT region_id, lsn, kind, first_index, last_index, last_value(CASE WHEN kind = 'ENTRIES' THEN last_index END IGNORE NULLS) OVER b AS prev_last,
    count(CASE WHEN kind = 'ENTRIES' THEN 1 END) OVER b AS run FROM {items} WINDOW b AS (PARTITION BY region_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, prev_last IS NOT NULL AND coalesce(max(CASE WHEN kind = 'CLEAN' THEN 1 ELSE 0 END) OVER r, 0) = 0
    AND coalesce(max(CASE WHEN kind = 'COMPACT' THEN first_index END) OVER r <= prev_last, true) AS filled
    FROM s1 WINDOW r AS (PARTITION BY region_id, run ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, kind = 'ENTRIES' AND NOT coalesce(filled AND first_index <= prev_last + 1, false) AS fresh FROM s2),
s4 AS (SELECT *, count(CASE WHEN fresh THEN 1 END) OVER (PARTITION BY region_id ORDER BY lsn) AS life FROM s3),
s5 AS (SELECT *, CASE WHEN NOT fresh THEN greatest(first_value(CASE WHEN fresh THEN first_index END IGNORE NULLS) OVER l, coalesce(max(CASE WHEN kind = 'COMPACT' THEN first_index END) OVER l, 0)) END AS flr
    FROM s4 WINDOW l AS (PARTITION BY region_id, life ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bad AS (SELECT region_id, lsn, first_index, prev_last AS expected_last, flr AS expected_first, CASE WHEN filled AND first_index > prev_last + 1 THEN 'hole' ELSE 'compacted' END AS reason
    FROM s5 WHERE kind = 'ENTRIES' AND ((filled AND first_index > prev_last + 1) OR (NOT fresh AND first_index < flr)))"""
ENTRY_SIZE = "16 + (region_id * 31 + index * 7) % 64"
REQUESTS = "req AS (SELECT region_id, first_index + 1 AS b, first_index + 11 AS en FROM ends)"
FETCH = "got AS (SELECT r.region_id, unnest(range(greatest(lo, b), least(hi, en - 1) + 1)) AS index, lsn, file_seq FROM req JOIN runs r ON req.region_id = r.region_id WHERE lo < en AND hi >= b)"

_Q = {
    "log_items_dump": (ITEMS, "SELECT queue, file_seq, lsn, region_id, kind, first_index, last_index, key, value FROM items"),
    "dump_filtered_groups": (ITEMS, "SELECT lsn, region_id, kind, first_index, last_index FROM items WHERE region_id IN (1, 2, 3, 5, 8, 13)"),
    "file_hole_trim": (ITEMS, """SELECT queue, file_seq FROM (SELECT DISTINCT queue, file_seq FROM items WHERE file_seq % 7 <> 3) f WHERE file_seq >= (SELECT coalesce(max(file_seq), 0) FROM
        (SELECT file_seq, file_seq - lag(file_seq) OVER (ORDER BY file_seq) AS d FROM (SELECT DISTINCT file_seq FROM items WHERE file_seq % 7 <> 3)) WHERE d <> 1)"""),
    "fork_plan": (TWO, "SELECT queue, file_seq, CASE WHEN file_seq = max(file_seq) OVER (PARTITION BY queue) THEN 'copied' ELSE 'linked' END AS how FROM (SELECT DISTINCT queue, file_seq FROM all_items)"),
    "raw_log_dump": (ITEMS, """SELECT queue, file_seq, CAST(row_number() OVER (PARTITION BY queue, file_seq ORDER BY lsn) AS INTEGER) AS n, region_id, kind, first_index, last_index, key, value,
        CAST(list_sum(list_transform(range(first_index, last_index + 1), lambda i : length(region_id || ':' || i))) AS BIGINT) AS payload_bytes FROM items"""),
    "raw_log_recovered": (RUNS, "SELECT region_id, file_seq, lo, hi FROM runs"),
    "live_runs": (RUNS, "SELECT region_id, lsn, queue, file_seq, lo, hi FROM runs"),
    "live_runs_chunked": (RUNS, "SELECT region_id, lsn, queue, file_seq, lo, hi FROM runs"),
    "live_runs_with_holes": (ITEMS + "," + HOLED + """,
        p AS (SELECT *, last_value(CASE WHEN kind = 'ENTRIES' THEN last_index END IGNORE NULLS) OVER (PARTITION BY region_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM holed),
        h AS (SELECT region_id, max(CASE WHEN kind = 'ENTRIES' AND first_index > pb + 1 THEN lsn END) AS hole_lsn, max(CASE WHEN kind = 'CLEAN' THEN lsn END) AS clean_lsn FROM p GROUP BY region_id),""" + _runs("holed", "hr"),
        "SELECT r.region_id, lsn, lo, hi FROM hr r JOIN h ON r.region_id = h.region_id WHERE hole_lsn IS NULL OR lsn >= hole_lsn"),
    "live_entries": (RUNS, "SELECT region_id, unnest(range(lo, hi + 1)) AS index, lsn, file_seq FROM runs"),
    "overwritten_entries": (LOST, "SELECT region_id, lsn, size - lft AS overwritten FROM lost WHERE dead = 0 AND size > lft"),
    "compacted_entries": (LOST, "SELECT region_id, lsn, lft - live AS compacted FROM lost WHERE dead = 0 AND lft > live"),
    "cleaned_entries": (LOST, "SELECT region_id, CAST(sum(size) AS BIGINT) AS cleaned FROM lost WHERE dead = 1 GROUP BY region_id"),
    "cleaned_groups": (ITEMS, "SELECT region_id, max(lsn) AS clean_lsn FROM items WHERE kind = 'CLEAN' GROUP BY region_id"),
    "tombstones": (ITEMS, "SELECT region_id, lsn AS clean_lsn, file_seq FROM items i WHERE kind = 'CLEAN' AND lsn = (SELECT max(lsn) FROM items j WHERE j.region_id = i.region_id)"),
    "strict_violations": (ITEMS + "," + HOLED + STRICT.format(items="holed"), "SELECT * FROM bad"),
    "strict_violations_clean_log": (ITEMS + STRICT.format(items="items"), "SELECT region_id, lsn, reason FROM bad"),
    "first_last_index": (RUNS + "," + ENDS, "SELECT region_id, first_index, last_index FROM ends"),
    "streamed_first_last": (RUNS + "," + ENDS, "SELECT region_id, first_index, last_index FROM ends"),
    "raft_groups": (ITEMS + "," + REGIONS, "SELECT region_id FROM regions"),
    "is_empty": (ITEMS + "," + REGIONS, "SELECT count(*) = 0 AS is_empty FROM regions"),
    "get_entry": (RUNS + "," + ENDS, "SELECT r.region_id, (first_index + last_index) // 2 AS index, lsn, file_seq FROM ends JOIN runs r ON ends.region_id = r.region_id WHERE (first_index + last_index) // 2 BETWEEN lo AND hi"),
    "fetch_entries": (RUNS + "," + ENDS + "," + REQUESTS + "," + FETCH, "SELECT region_id, index, lsn, file_seq FROM got"),
    "fetch_entries_max_size": (RUNS + "," + ENDS + "," + REQUESTS + "," + FETCH + f""",
        sized AS (SELECT region_id, index, CAST({ENTRY_SIZE} AS BIGINT) AS size FROM got),
        run AS (SELECT *, sum(size) OVER (PARTITION BY region_id ORDER BY index) AS total FROM sized)""", "SELECT region_id, index, size FROM run WHERE total <= 150 OR total = size"),
    "fetch_status": (RUNS + "," + ENDS + "," + REGIONS + """,
        req AS (SELECT i.region_id, coalesce(first_index, 1) + i.region_id % 5 - 2 AS "begin", coalesce(last_index, 5) + 1 + i.region_id % 5 - 2 AS "end"
            FROM (SELECT DISTINCT region_id FROM items) i LEFT JOIN ends ON i.region_id = ends.region_id)""",
        """SELECT q.region_id, q."begin", q."end", CASE WHEN q."end" <= q."begin" OR g.region_id IS NULL THEN 'Ok' WHEN first_index IS NULL THEN 'NotFound' WHEN q."begin" < first_index THEN 'Compacted'
        WHEN q."end" > last_index + 1 THEN 'NotFound' ELSE 'Ok' END AS status FROM req q LEFT JOIN regions g ON q.region_id = g.region_id LEFT JOIN ends e2 ON q.region_id = e2.region_id AND g.region_id IS NOT NULL"""),
    "compact_to_result": (RUNS + "," + ENDS + "," + REGIONS + """,
        req AS (SELECT r.region_id, first_index, coalesce(first_index, 1) + r.region_id % 40 - 5 AS index FROM regions r LEFT JOIN ends e ON r.region_id = e.region_id)""",
        "SELECT region_id, index, coalesce(greatest(index, first_index) - first_index, 0) * CASE WHEN first_index IS NULL THEN 0 ELSE 1 END AS removed FROM req"),
    "kv_live": (KVS, "SELECT region_id, key, value, file_seq, lsn FROM kvs"),
    "kv_get": (KVS + "," + REGIONS, "SELECT r.region_id, 'k' || (r.region_id % 10) AS key, value FROM regions r LEFT JOIN kvs ON r.region_id = kvs.region_id AND kvs.key = 'k' || (r.region_id % 10)"),
    "kv_scan_range": (KVS, "SELECT region_id, key, value FROM kvs WHERE key >= 'k2' AND key < 'k7'"),
    "kv_scan_reverse_limit": (KVS, "SELECT region_id, key, value FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY key DESC) AS rn FROM kvs) WHERE rn <= 3"),
    "kv_scan_messages": (KVS, r"""SELECT region_id, key, CAST(m AS BIGINT) AS message FROM (SELECT region_id, key, regexp_extract(value, '\{"k": ([0-9]*[02468])\}', 1) AS m FROM kvs) WHERE m <> ''"""),
    "kv_get_messages": (KVS, "SELECT region_id, key, CAST(regexp_extract(value, '([0-9]+)', 1) AS BIGINT) AS message FROM kvs"),
    "entries_before_gate": (TWO, f"""SELECT region_id, file_seq, lo, hi FROM m_runs m WHERE queue = 0 AND file_seq <= {GATE34}
        AND NOT EXISTS (SELECT 1 FROM m_runs x WHERE x.region_id = m.region_id AND x.queue = 0 AND x.file_seq > {GATE34} AND x.lo <= m.lo)"""),
    "rewritten_entries": (TWO, "SELECT region_id, file_seq, lo, hi FROM m_runs WHERE queue = 1"),
    "kvs_before_gate": (TWO, f"SELECT region_id, key, file_seq FROM m_kvs WHERE queue = 0 AND file_seq <= {GATE34}"),
    "rewritten_kvs": (TWO, "SELECT region_id, key, file_seq FROM m_kvs WHERE queue = 1"),
    "batch_first_index": (ITEMS, "SELECT lsn // 10 AS batch_id, arg_min(first_index, lsn) AS first_index, arg_min(region_id, lsn) AS region_id FROM items WHERE kind = 'ENTRIES' GROUP BY lsn // 10"),
    "region_state": (TWO, "SELECT * FROM state"),
    "file_liveness": (TWO, """SELECT a.queue, a.file_seq, item_count, CAST(coalesce(le, 0) AS BIGINT) AS live_entries, coalesce(lk, 0) AS live_kvs FROM
        (SELECT queue, file_seq, count(*) AS item_count FROM all_items GROUP BY ALL) a
        LEFT JOIN (SELECT queue, file_seq, sum(hi - lo + 1) AS le FROM m_runs GROUP BY ALL) r ON a.queue = r.queue AND a.file_seq = r.file_seq
        LEFT JOIN (SELECT queue, file_seq, count(*) AS lk FROM m_kvs GROUP BY ALL) k ON a.queue = k.queue AND a.file_seq = k.file_seq"""),
    "file_span": (TWO, "SELECT * FROM span"),
    "total_size": (TWO, "SELECT queue, (active_seq - first_seq + 1) * 1048576 AS total_size FROM span"),
    "used_size": (TWO, "SELECT CAST(sum((active_seq - first_seq + 1) * 1048576) AS BIGINT) AS used_size FROM span"),
    "file_at": (TWO, "SELECT queue, first_seq + CAST(floor((active_seq - first_seq + 1) * 0.35) AS BIGINT) AS file_seq FROM span"),
    "file_references": (ITEMS, "SELECT queue, file_seq, count(*) AS pending FROM items WHERE lsn > (SELECT max(lsn) - 750 FROM items) GROUP BY queue, file_seq"),
    "region_slots": (ITEMS + """,
        h0 AS (SELECT DISTINCT region_id, CAST(region_id AS UHUGEINT) AS x FROM items),
        h1 AS (SELECT region_id, xor(x, x >> 30) * CAST('13787848793156543929' AS UHUGEINT) % CAST('18446744073709551616' AS UHUGEINT) AS x FROM h0),
        h2 AS (SELECT region_id, xor(x, x >> 27) * CAST('10723151780598845931' AS UHUGEINT) % CAST('18446744073709551616' AS UHUGEINT) AS x FROM h1)""",
        "SELECT region_id, CAST(xor(x, x >> 31) % 128 AS INTEGER) AS slot FROM h2"),
    "live_counts_by_queue": (TWO, "SELECT queue, CAST(sum(n) AS BIGINT) AS live_count FROM (SELECT queue, hi - lo + 1 AS n FROM m_runs UNION ALL SELECT queue, 1 FROM m_kvs) GROUP BY queue"),
    "garbage_ratio": (TWO, "SELECT * FROM garbage"),
    "nth_entry_file": (TWO, "SELECT r.region_id, CAST(5 AS BIGINT) AS n, file_seq FROM regions r JOIN m_ord o ON r.region_id = o.region_id WHERE 5 > before AND 5 <= upto"),
    "memory_usage": (TWO, "SELECT region_id, entry_count * 40 AS bytes FROM state"),
    "approx_size": (ITEMS, """SELECT file_seq, CAST(sum(9 + CASE kind WHEN 'ENTRIES' THEN 16 + 8 * (last_index - first_index + 1) WHEN 'COMPACT' THEN 9 WHEN 'CLEAN' THEN 1
        ELSE 17 + strlen(key) + coalesce(strlen(value), 0) END) AS BIGINT) AS approx_size, count(*) AS n FROM items GROUP BY file_seq"""),
    "size_histogram": (RUNS + f""",
        x AS (SELECT {ENTRY_SIZE} AS size FROM (SELECT region_id, unnest(range(lo, hi + 1)) AS index FROM runs))""",
        "SELECT CAST(CASE " + " ".join(f"WHEN size <= {16.0 * 1.25**i!r} THEN {i}" for i in range(8)) + " ELSE 8 END AS INTEGER) AS bucket, count(*) AS n FROM x GROUP BY ALL"),
    "latency_percentiles": ("one AS (SELECT 1)", """SELECT count(*) AS n, min(value) AS min, avg(value) AS avg, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95,
        quantile_cont(value, 0.99) AS p99, quantile_cont(value, 0.999) AS p999, max(value) AS max FROM events"""),
    "worker_fairness": (ITEMS, "SELECT stddev_samp(n) / quantile_cont(n, 0.5) AS fairness FROM (SELECT count(*) AS n FROM items GROUP BY region_id)"),
    "write_bandwidth": (ITEMS, """SELECT queue, CAST(sum(CASE WHEN kind = 'ENTRIES' THEN 48 * (last_index - first_index + 1) ELSE 24 END) AS BIGINT) AS bytes, CAST(max(lsn) - min(lsn) AS DOUBLE) AS seconds,
        sum(CASE WHEN kind = 'ENTRIES' THEN 48 * (last_index - first_index + 1) ELSE 24 END) / nullif(CAST(max(lsn) - min(lsn) AS DOUBLE), 0) AS bytes_per_second FROM items GROUP BY queue"""),
    "perf_context": ("one AS (SELECT 1)", "SELECT event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_us, count(*) AS n FROM events GROUP BY event_type"),
    "needs_rewrite": (TWO, """SELECT queue, active_seq > first_seq AND CASE WHEN queue = 0 THEN (active_seq - first_seq + 1) * 1048576 > 8388608
        ELSE (active_seq - first_seq + 1) * 1048576 > 1048576 AND ratio > 0.6 END AS needs_rewrite FROM span, garbage"""),
    "append_watermarks": (TWO, "SELECT * FROM marks"),
    "purge_candidates": (TWO + CANDIDATES.format(counter="s.region_id % 11"), "SELECT * FROM cand"),
    "rewrite_rewrite_regions": (TWO, "SELECT region_id, rewrite_count > 32 AS should_compact FROM state WHERE min_rewrite_seq IS NOT NULL"),
    "rewrite_set": (TWO + CANDIDATES.format(counter="0"), """
        SELECT region_id, 'CLEAN' AS kind, CAST(NULL AS BIGINT) AS first_index, CAST(NULL AS BIGINT) AS last_index, CAST(NULL AS VARCHAR) AS key, lsn FROM items i WHERE kind = 'CLEAN' AND lsn = (SELECT max(lsn) FROM items j WHERE j.region_id = i.region_id)
        UNION ALL SELECT m.region_id, 'ENTRIES', lo, hi, NULL, lsn FROM m_runs m JOIN cand c ON m.region_id = c.region_id, marks WHERE do_rewrite AND queue = 0 AND file_seq <= rewrite_seq
            AND NOT EXISTS (SELECT 1 FROM m_runs x WHERE x.region_id = m.region_id AND x.queue = 0 AND x.file_seq > rewrite_seq AND x.lo <= m.lo)
        UNION ALL SELECT k.region_id, 'PUT', NULL, NULL, key, lsn FROM m_kvs k JOIN cand c ON k.region_id = c.region_id, marks WHERE do_rewrite AND queue = 0 AND file_seq <= rewrite_seq"""),
    "apply_rewrite": (RUNS + f""",
        pre AS (SELECT region_id, lo, hi FROM runs m WHERE file_seq <= {GATE34} AND NOT EXISTS (SELECT 1 FROM runs x WHERE x.region_id = m.region_id AND x.file_seq > {GATE34} AND x.lo <= m.lo))""",
        "SELECT r.region_id, CASE WHEN p.lo IS NULL THEN 0 ELSE 1 END AS queue, CASE WHEN p.lo IS NULL THEN r.file_seq ELSE 9 END AS file_seq, r.lo, r.hi FROM runs r LEFT JOIN pre p ON r.region_id = p.region_id AND r.lo = p.lo"),
    "apply_rewrite_keys": (KVS, f"SELECT region_id, key, CASE WHEN file_seq <= {GATE34} THEN 1 ELSE 0 END AS queue, CASE WHEN file_seq <= {GATE34} THEN 9 ELSE file_seq END AS file_seq FROM kvs"),
    "purge_point": (TWO, "SELECT queue, least(CASE WHEN queue = 0 THEN (SELECT min(min_append_seq) FROM state) ELSE (SELECT min(min_rewrite_seq) FROM state) END, active_seq) AS purge_seq FROM span"),
    "purge_point_barrier": (TWO, "SELECT queue, least(CASE WHEN queue = 0 THEN (SELECT min(min_append_seq) FROM state) ELSE (SELECT min(min_rewrite_seq) FROM state) END, active_seq, 2) AS purge_seq FROM span"),
    "purgeable_files": (TWO, """SELECT DISTINCT a.queue, a.file_seq FROM all_items a JOIN span s ON a.queue = s.queue
        WHERE file_seq < least(CASE WHEN a.queue = 0 THEN (SELECT min(min_append_seq) FROM state) ELSE (SELECT min(min_rewrite_seq) FROM state) END, active_seq)"""),
    "pinned_groups": (TWO, "SELECT region_id, min_append_seq, CASE WHEN region_id % 3 = 0 AND min_rewrite_seq <= 4 THEN least(min_rewrite_seq, 1) ELSE min_rewrite_seq END AS min_rewrite_seq FROM state"),
    "merge_queues": (TWO, "SELECT region_id, lsn, queue, file_seq, lo, hi FROM m_runs"),
    "recovered_entries": (RUNS, "SELECT region_id, unnest(range(lo, hi + 1)) AS index FROM runs"),
    "recovered_kvs": (KVS, "SELECT region_id, key, value FROM kvs"),
    "atomic_groups": (ITEMS + """,
        mk AS (SELECT region_id AS group_id, lsn, CAST(lsn % 3 AS INTEGER) AS status FROM items WHERE kind IN ('PUT', 'DEL', 'COMPACT')),
        att AS (SELECT *, count(CASE WHEN status = 0 THEN 1 END) OVER (PARTITION BY group_id ORDER BY lsn) AS attempt FROM mk),
        en AS (SELECT *, min(CASE WHEN status = 2 THEN lsn END) OVER (PARTITION BY group_id, attempt) AS el, min(lsn) OVER (PARTITION BY group_id, attempt) AS bl FROM att)""",
        """SELECT group_id, lsn, status, coalesce(attempt > 0 AND lsn <= el, false) AS accepted, CASE WHEN attempt > 0 AND lsn <= el THEN bl END AS begin_lsn,
        CASE WHEN attempt > 0 AND lsn <= el THEN el END AS end_lsn FROM en"""),
    "consistency_check": (ITEMS + "," + HOLED, """SELECT region_id, arg_min(prev, lsn) AS last_valid FROM
        (SELECT region_id, lsn, first_index, lag(last_index) OVER (PARTITION BY region_id ORDER BY lsn) AS prev FROM holed WHERE kind = 'ENTRIES') WHERE prev + 1 < first_index GROUP BY region_id"""),
    "repair_filter": ("RECURSIVE " + ITEMS + "," + HOLED + """,
        h AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY file_seq, lsn) AS rn FROM holed),
        v(region_id, rn, f, c, lsn, kind, a, b, ins) AS (
            SELECT DISTINCT region_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false FROM h
            UNION ALL SELECT region_id, rn, CASE kind WHEN 'ENTRIES' THEN CASE WHEN ins OR c = 0 THEN a ELSE f END WHEN 'CLEAN' THEN 0
                    WHEN 'COMPACT' THEN CASE WHEN c = 0 OR a <= f THEN f WHEN a >= f + c - 1 THEN 0 ELSE a END ELSE f END,
                CASE kind WHEN 'ENTRIES' THEN b - CASE WHEN ins OR c = 0 THEN a ELSE f END + 1 WHEN 'CLEAN' THEN 0 WHEN 'COMPACT' THEN CASE WHEN c <> 0 AND a > f AND a >= f + c - 1 THEN 0 ELSE c END ELSE c END,
                lsn, kind, a, b, ins FROM (SELECT h.region_id, h.rn, h.lsn, h.kind, h.first_index AS a, h.last_index AS b, v.f, v.c,
                    h.kind = 'ENTRIES' AND v.c <> 0 AND NOT h.first_index BETWEEN v.f AND v.f + v.c AS ins FROM v JOIN h ON h.region_id = v.region_id AND h.rn = v.rn + 1))""",
        """SELECT lsn, region_id, kind, a AS first_index, b AS last_index, false AS inserted FROM v WHERE rn > 0
        UNION ALL SELECT lsn, region_id, 'COMPACT', 9223372036854775807, NULL, true FROM v WHERE rn > 0 AND ins"""),
    "checksum_crc32": ("RECURSIVE " + KVS + """,
        tb(n, c, i) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM tb WHERE i < 8),
        tbl AS (SELECT list(c ORDER BY n) AS t FROM tb WHERE i = 8),
        crc AS (SELECT region_id, key, file_seq, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(value) + 1), lambda i : CAST(ascii(substr(value, i, 1)) AS BIGINT))),
            lambda c, b : xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) AS crc FROM kvs, tbl)""",
        "SELECT region_id, key, CAST(crc AS BIGINT) AS crc, CAST(xor(crc, file_seq & 4294967295) AS BIGINT) AS signed_crc FROM crc"),
    "batch_merge": (ITEMS, "SELECT lsn // 20 AS batch_id, CAST(row_number() OVER (PARTITION BY lsn // 20 ORDER BY lsn) - 1 AS INTEGER) AS item_no, lsn, region_id, kind FROM items WHERE kind <> 'CLEAN'"),
    "aligned_offsets": (ITEMS, "SELECT lsn, (lsn * 37 + 511) // 512 * 512 AS up, lsn * 37 // 512 * 512 AS down FROM items"),
}


def oracle_sql() -> dict[str, str]:
    return {name: f"WITH {ctes}\n{select}" for name, (ctes, select) in _Q.items()}
