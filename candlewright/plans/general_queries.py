"""Queries of the general (not llm) training-data operators, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.operators import implausible, rolling
from candlewright.session import read_table


def p1_rolling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = rolling.rolling_bar_totals(read_table(spark, sf_dir, "bars"))
    numbers = ["total_volume", "avg_volume", "avg_close", "avg_atr_14"]
    return rolled.select(
        "symbol",
        F.date_format("day", "yyyy-MM-dd").alias("day"),
        F.col("window_days").cast("bigint").alias("window_days"),
        "n",
        *[F.round(F.round(c, 9), 6).alias(c) for c in numbers],
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.silent_windows(rolling.rolling_bar_totals(read_table(spark, sf_dir, "bars")))


def p4_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible.flag_implausible(read_table(spark, sf_dir, "klines"), read_table(spark, sf_dir, "symbols"))


def p4_ranges_and_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``p4_flags``: impossible readings and constant runs."""
    return p4_flags(spark, sf_dir).filter("impossible OR stuck").select("ingest_seq", "impossible", "stuck")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_flags(spark, sf_dir).select("ingest_seq")


_P1_DAILY = """
WITH one AS (
  SELECT symbol, pos, loaded_at, max(timestamp) AS ts, max(volume) AS volume, max(close) AS close, max(atr_14) AS atr_14
  FROM bars GROUP BY ALL),
bar AS (
  SELECT symbol, pos, arg_max_null(ts, loaded_at) AS ts, arg_max_null(volume, loaded_at) AS volume,
         arg_max_null(close, loaded_at) AS close, arg_max_null(atr_14, loaded_at) AS atr_14
  FROM one GROUP BY ALL),
daily AS (
  SELECT symbol, CAST(ts AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS n, count(*) FILTER (volume > 0) AS n_active,
         fsum(volume) AS v, count(volume) AS nv, fsum(close) AS c, count(close) AS nc, fsum(atr_14) AS a, count(atr_14) AS na
  FROM bar WHERE ts IS NOT NULL GROUP BY ALL),
span AS (
  SELECT symbol, min(day) AS d0, max(day) AS d1, min(day) FILTER (n_active > 0) AS a0, max(day) FILTER (n_active > 0) AS a1
  FROM daily GROUP BY symbol),
days AS (SELECT symbol, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS day, a0, a1 FROM span),
grid AS (SELECT symbol, day, a0, a1, w FROM days, (VALUES (7), (30)) AS t(w)),
rolled AS (
  SELECT g.symbol, g.day, g.w AS window_days, any_value(g.a0) AS a0, any_value(g.a1) AS a1,
         coalesce(sum(d.n), 0) AS n, coalesce(sum(d.n_active), 0) AS n_active,
         coalesce(fsum(d.v), 0) AS v, sum(d.nv) AS nv, fsum(d.c) AS c, sum(d.nc) AS nc, fsum(d.a) AS a, sum(d.na) AS na
  FROM grid g LEFT JOIN daily d ON d.symbol = g.symbol AND d.day <= g.day AND d.day > g.day - g.w
  GROUP BY ALL)
"""

_P4 = """
WITH scaled AS (
  SELECT symbol, quantile_disc(abs(ln(close / open)), 0.5) FILTER (open > 0 AND close > 0 AND close <> open) * 0.02 AS tol,
         coalesce(avg(CASE WHEN open > 0 AND close > 0 THEN CAST(close = open AS INT) END), 0) AS still,
         coalesce(avg(CAST(volume = 0 AS INT)), 0) AS silent, count(DISTINCT ts) AS n
  FROM klines GROUP BY symbol),
need AS (
  SELECT symbol, coalesce(tol, 2e-8) AS tol,
         greatest(6, ln(greatest(n * (1 - still), 1) / 1e-4) / -ln(least(greatest(still, 1e-6), 0.9999))) AS need_price,
         greatest(6, ln(greatest(n * (1 - silent), 1) / 1e-4) / -ln(least(greatest(silent, 1e-6), 0.9999))) AS need_silence
  FROM scaled),
bar AS (
  SELECT symbol, ts, min(ingest_seq) AS first_seq FROM klines WHERE ts IS NOT NULL GROUP BY symbol, ts),
reading AS (
  SELECT b.symbol, b.ts, CASE WHEN k.close > 0 THEN ln(k.close) END AS c, k.volume AS v FROM bar b JOIN klines k ON k.ingest_seq = b.first_seq),
price AS (
  SELECT r.*, tol, need_price, coalesce(abs(c - lag(c) OVER w) <= tol, false) AS same FROM reading r JOIN need USING (symbol) WHERE c IS NOT NULL
  WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
traded AS (
  SELECT r.*, need_silence, coalesce(v > 0 AND v = lag(v) OVER w, false) AS same, coalesce(v = 0 AND 0 = lag(v) OVER w, false) AS quiet
  FROM reading r JOIN need USING (symbol) WHERE v IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
price_runs AS (SELECT *, sum(CAST(NOT same AS INT)) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM price),
volume_runs AS (
  SELECT *, sum(CAST(NOT same AS INT)) OVER w AS run, sum(CAST(NOT quiet AS INT)) OVER w AS quiet_run FROM traded WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
price_long AS (SELECT *, count(*) OVER (PARTITION BY symbol, run) - 1 AS len FROM price_runs),
volume_long AS (
  SELECT *, count(*) OVER (PARTITION BY symbol, run) - 1 AS len, count(*) OVER (PARTITION BY symbol, quiet_run) - 1 AS quiet_len FROM volume_runs),
judged AS (
  SELECT k.ingest_seq,
    coalesce(k.high < k.low, false) OR coalesce(k.close < k.low, false) OR coalesce(k.close > k.high, false) OR coalesce(k.high <= 0, false)
      OR coalesce(k.low <= 0, false) OR coalesce(k.close <= 0, false) OR coalesce(k.volume < 0, false) AS impossible,
    coalesce(p.same AND p.len >= p.need_price AND abs(CASE WHEN k.close > 0 THEN ln(k.close) END - p.c) <= p.tol, false)
      OR coalesce(t.v = k.volume AND (t.same AND t.len >= 6 OR t.quiet AND t.quiet_len >= t.need_silence), false) AS stuck
  FROM klines k LEFT JOIN price_long p ON p.symbol = k.symbol AND p.ts = k.ts LEFT JOIN volume_long t ON t.symbol = k.symbol AND t.ts = k.ts)
"""

SQL = {
    "p4_ranges_and_runs": _P4 + "SELECT ingest_seq, impossible, stuck FROM judged WHERE impossible OR stuck",
    "p1_rolling_totals": _P1_DAILY
    + """
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, CAST(window_days AS BIGINT) AS window_days, CAST(n AS BIGINT) AS n,
       CAST(round(CAST(v AS DECIMAL(38,9)), 6) AS DOUBLE) AS total_volume, CAST(round(CAST(v / nullif(nv, 0) AS DECIMAL(38,9)), 6) AS DOUBLE) AS avg_volume,
       CAST(round(CAST(c / nullif(nc, 0) AS DECIMAL(38,9)), 6) AS DOUBLE) AS avg_close, CAST(round(CAST(a / nullif(na, 0) AS DECIMAL(38,9)), 6) AS DOUBLE) AS avg_atr_14
FROM rolled""",
    "p1_found": _P1_DAILY
    + """
SELECT symbol, strftime(day, '%Y-%m-%d') AS day, CAST(window_days AS INTEGER) AS window_days
FROM rolled WHERE n_active = 0 AND day > a0 AND day < a1""",
}

QUERIES = {"p1_rolling_totals": p1_rolling_totals, "p1_found": p1_found, "p4_found": p4_found, "p4_flags": p4_flags, "p4_ranges_and_runs": p4_ranges_and_runs}
