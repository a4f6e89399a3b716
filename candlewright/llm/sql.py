"""SQL equivalents of this subpackage's queries, where SQL can say them."""

_POOL = """
WITH pool AS (
  SELECT DISTINCT t.bucket_id, b.symbol, b.pos
  FROM bars b JOIN sample_targets t ON t.symbol = b.symbol AND t.month = strftime(b.timestamp AT TIME ZONE 'UTC', '%Y-%m')
   AND (t.atr_lo IS NULL OR b.atr_14 >= t.atr_lo) AND (t.atr_hi IS NULL OR b.atr_14 < t.atr_hi)
  WHERE b.atr_14 > 0 AND NOT isnan(b.atr_14)
    AND NOT EXISTS (SELECT 1 FROM anchored_events e WHERE e.symbol = b.symbol AND e.decision_pos = b.pos)),
counts AS (SELECT bucket_id, count(*) AS pool FROM pool GROUP BY bucket_id),
wanted AS (
  SELECT t.request_id, t.bucket_id, t.symbol, t.target_share, t.sample_size, t.min_rows AS least,
         greatest(t.min_rows, CAST(round(t.target_share * t.sample_size) AS BIGINT)) AS quota,
         coalesce(c.pool, 0) AS pool
  FROM sample_targets t LEFT JOIN counts c USING (bucket_id)),
sized AS (
  SELECT *, greatest(sum(least(pool, quota)) OVER r - sample_size, 0) AS over_by, sum(least(pool, quota) - least(pool, least)) OVER r AS room
  FROM wanted WINDOW r AS (PARTITION BY request_id)),
cuts AS (
  SELECT *, least(over_by, room) AS cut, least(over_by, room) * (least(pool, quota) - least(pool, least)) AS num FROM sized),
parts AS (
  SELECT *, CASE WHEN room > 0 THEN CAST(num AS BIGINT) // CAST(room AS BIGINT) ELSE 0 END AS whole,
         CASE WHEN room > 0 THEN CAST(num AS BIGINT) % CAST(room AS BIGINT) ELSE 0 END AS rest FROM cuts),
report AS (
  SELECT *, least(pool, quota) - whole
    - CASE WHEN row_number() OVER (PARTITION BY request_id ORDER BY rest DESC, bucket_id) <= cut - sum(whole) OVER (PARTITION BY request_id) THEN 1 ELSE 0 END AS drawn
  FROM parts)
"""

_RUNS = """
WITH lagged AS (
  SELECT *, row_number() OVER w AS rn, lag(episode_start_pos) OVER w AS ps, lag(episode_end_pos) OVER w AS pe, lag(ma_dispersion_atr) OVER w AS pd
  FROM episodes WINDOW w AS (PARTITION BY symbol, cell ORDER BY emitted_at NULLS FIRST, row_id)),
broken AS (
  SELECT *, CASE WHEN rn > 1 AND abs(episode_start_pos - ps) <= 2 AND abs(episode_end_pos - pe) <= 2
                  AND (abs(ma_dispersion_atr - pd) <= 0.020000001 OR (ma_dispersion_atr IS NULL AND pd IS NULL)) THEN 0 ELSE 1 END AS brk
  FROM lagged),
numbered AS (SELECT *, sum(brk) OVER (PARTITION BY symbol, cell ORDER BY rn) AS run FROM broken),
runs AS (
  SELECT symbol, cell, run, arg_min(row_id, rn) AS first_row_id, arg_max(row_id, rn) AS last_row_id, count(*) AS n_events,
         round((epoch_us(max(emitted_at)) - epoch_us(min(emitted_at))) / 1e6, 3) AS seconds
  FROM numbered GROUP BY ALL)
"""

SQL = {
    "p2_found": _POOL + "SELECT request_id, bucket_id FROM report WHERE pool < quota",
    "p2_report": _POOL
    + """
SELECT request_id, bucket_id, symbol, target_share, CAST(quota AS BIGINT) AS quota, pool, CAST(drawn AS BIGINT) AS drawn,
       round(drawn / nullif(sum(drawn) OVER (PARTITION BY request_id), 0), 6) AS reached_share,
       pool < quota AS exhausted, CAST(least(pool, quota) - drawn AS BIGINT) AS trimmed,
       sum(least) OVER (PARTITION BY request_id) > sample_size AS oversized
FROM report""",
    "p2_sample": _POOL
    + """
, ranked AS (
  SELECT bucket_id, pos, row_number() OVER (
    PARTITION BY bucket_id ORDER BY CAST('0x' || substr(md5(concat_ws('|', 42, symbol, pos)), 1, 15) AS BIGINT), pos) AS place FROM pool)
SELECT r.request_id, r.bucket_id, r.symbol, k.pos FROM ranked k JOIN report r USING (bucket_id) WHERE k.place <= r.drawn""",
    "p3_certified": """
WITH one AS (SELECT symbol, pos, loaded_at, max(ma_dispersion_atr) AS d, max(atr_14) AS a FROM bars GROUP BY ALL),
bar AS (SELECT symbol, pos, arg_max_null(d, loaded_at) AS d, arg_max_null(a, loaded_at) AS a FROM one GROUP BY ALL),
reading AS (
  SELECT symbol, 'ma_dispersion_atr' AS "column", d AS value FROM bar WHERE d IS NOT NULL AND NOT isnan(d)
  UNION ALL SELECT symbol, 'atr_14', a FROM bar WHERE a IS NOT NULL AND NOT isnan(a)),
counted AS (
  SELECT false AS overall, symbol, "column", count(*) AS n FROM reading GROUP BY ALL
  UNION ALL SELECT true, NULL, "column", count(*) FROM reading GROUP BY ALL)
SELECT overall, symbol, "column", CAST(q AS DOUBLE) AS quantile, n, true AS within_bound
FROM counted, (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q)""",
    "p5_found": _RUNS + "SELECT first_row_id, last_row_id FROM runs WHERE n_events > 1",
    "p5_runs": _RUNS + "SELECT symbol, cell, first_row_id, last_row_id, n_events, seconds FROM runs",
}
