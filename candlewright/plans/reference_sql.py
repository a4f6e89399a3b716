"""SQL of the reference queries, put together from shared stages."""

from __future__ import annotations

from candlewright.operators.indicators import FEATURES
from candlewright.operators.outcomes import LABELS
from candlewright.plans.pipeline import Settings

S = Settings()
GATE = (40, 10, 10)


def full(agg: str, x: str, n: int, extra: int = 0) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN {n - 1 + extra} PRECEDING AND {extra or 'CURRENT'} {'PRECEDING' if extra else 'ROW'})"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {agg}({x}) {frame} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY pos)"


def mean(x: str, alpha: str, seed: int) -> str:
    r = f"(1 - {alpha})"
    return f"pow({r}, pos) * sum(CASE WHEN pos >= {seed} THEN (CASE WHEN pos = {seed} THEN 1 ELSE {alpha} END) * {x} * pow({r}, -pos) END) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING)"


def rd(x: str, digits: int) -> str:
    """Rounded half up on nine decimals, as ``rounded`` does: a tie is a tie in both engines."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def r(columns: list[str], digits: int) -> str:
    return ", ".join(f"{rd(c, digits)} AS {c}" for c in columns)


MAS = [f"{k}_{n}" for n in (20, 60, 120) for k in ("sma", "ema")]

BARS = """
WITH RECURSIVE firsts AS (
  SELECT * FROM klines WHERE symbol IS NOT NULL AND ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY ingest_seq) = 1),
sound AS (
  SELECT symbol, ts, open, high, low, close, volume FROM firsts
  WHERE high >= low AND high >= open AND high >= close AND low <= open AND low <= close AND low > 0 AND volume >= 0 AND open IS NOT NULL),
bars AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n_bars FROM sound)"""

IND = (
    BARS
    + f""",
ranged AS (
  SELECT *, CASE WHEN pos > 0 THEN greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END AS tr FROM bars),
ind AS (
  SELECT *, """
    + ", ".join(f"{full('avg', 'close', n)} AS sma_{n}, CASE WHEN pos >= {n - 1} THEN {mean('close', f'(2.0::DOUBLE / {n + 1})', 0)} END AS ema_{n}" for n in (20, 60, 120))
    + f""", CASE WHEN pos >= 14 THEN {mean('tr', '(1.0::DOUBLE / 14)', 1)} END AS atr_14,
    {full('avg', 'tr', 5)} AS tr_mean_5, {full('avg', 'tr', 20)} AS tr_mean_20
  FROM ranged),
banded AS (
  SELECT *, greatest({', '.join(MAS)}) AS ma_upper, least({', '.join(MAS)}) AS ma_lower,
         list_median(list_filter([{', '.join(MAS)}], x -> x IS NOT NULL)) AS cluster_center
  FROM ind),
clu AS (SELECT *, (ma_upper - ma_lower) / nullif(atr_14, 0) AS raw_dispersion, round((ma_upper - ma_lower) / nullif(atr_14, 0), {S.digits}) AS ma_dispersion_atr FROM banded),
wide AS (
  SELECT *, {lag('ma_dispersion_atr')} AS prev_dispersion, coalesce(ema_20 < {lag('ema_20', 5)}, false) AS slope_down,
    {full('min', 'low', S.local_low_window, 1)} AS prior_local_low,
    lead(open) OVER (PARTITION BY symbol ORDER BY pos) AS next_open,
    min(low) OVER f AS future_low, max(high) OVER f AS future_high,
    lead(close, {S.horizon}) OVER (PARTITION BY symbol ORDER BY pos) AS future_close,
    CAST(floor(n_bars * {S.train}::DOUBLE) AS BIGINT) AS train_end, CAST(floor(n_bars * ({S.train}::DOUBLE + {S.val}::DOUBLE)) AS BIGINT) AS val_end,
    make_timestamp(ts * 1000) AS timestamp
  FROM clu WINDOW f AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {S.horizon} FOLLOWING))"""
).replace("list_median(list_filter(", "list_aggregate(list_filter(").replace("x -> x IS NOT NULL))", "lambda x: x IS NOT NULL), 'median')")

_SHARE = lambda p: full("avg", f"(CASE WHEN {p} THEN 1.0 ELSE 0.0 END)", 10)


def _slope(x: str, k: int) -> str:
    return f"({x} - {lag(x, k)}) / nullif(atr_14, 0)"


FEAT = (
    IND
    + f""",
sided AS (
  SELECT *, sign(close - cluster_center) AS side,
    pos - coalesce(max(CASE WHEN NOT coalesce(close > cluster_center, false) THEN pos END) OVER (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING), -1) AS run_above,
    {full('max', 'high', 60)} AS high60, {full('min', 'low', 60)} AS low60, {full('min', 'low', 20)} AS low20
  FROM wide),
crossing AS (SELECT *, CASE WHEN side * {lag('side')} < 0 THEN 1.0 ELSE 0.0 END AS crossed FROM sided),
feat AS (
  SELECT *,
    {full('avg', 'raw_dispersion', 5)} AS ma_dispersion_mean_5,
    {full('min', 'raw_dispersion', 10)} AS ma_dispersion_min_10,
    raw_dispersion - {lag('raw_dispersion', 5)} AS ma_dispersion_slope_5,
    {_slope('ema_20', 5)} AS ema20_slope_5, {_slope('sma_20', 5)} AS sma20_slope_5,
    {_slope('ema_60', 10)} AS ema60_slope_10, {_slope('sma_120', 20)} AS sma120_slope_20,
    {_slope('ema_20', 5)} - {_slope('sma_120', 20)} AS short_long_slope_gap,
    (close - cluster_center) / nullif(atr_14, 0) AS close_to_cluster_atr,
    {_SHARE('close > cluster_center')} AS close_above_cluster_ratio_10,
    {_SHARE('close < cluster_center')} AS close_below_cluster_ratio_10,
    {_SHARE('close >= ma_lower AND close <= ma_upper')} AS close_inside_cluster_ratio_10,
    {full('sum', 'crossed', 10)} AS cluster_penetration_count_10,
    {full('sum', '(CASE WHEN high >= ma_lower AND close < cluster_center THEN 1.0 ELSE 0.0 END)', 10)} AS failed_reclaim_count_10,
    CASE WHEN pos >= 9 THEN CAST(list_max(list_transform(list(run_above) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), lambda s, i: least(s, i))) AS DOUBLE) END AS max_consecutive_close_above_10,
    close / {lag('close', 20)} - 1 AS return_20, close / {lag('close', 60)} - 1 AS return_60,
    CASE WHEN pos >= 59 THEN regr_slope(close, pos) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) END / nullif(atr_14, 0) AS linear_slope_60,
    (high60 - close) / nullif(atr_14, 0) AS distance_from_high_60_atr,
    (close - low60) / nullif(high60 - low60, 0) AS price_location_in_range_60,
    abs(close - open) / nullif(high - low, 0) AS body_ratio,
    (high - low) / nullif(atr_14, 0) AS range_atr,
    tr_mean_5 / nullif(tr_mean_20, 0) AS atr_ratio_5_20,
    CASE WHEN pos >= 19 THEN (volume - avg(volume) OVER v) / nullif(stddev_pop(volume) OVER v, 0) END AS volume_zscore_20,
    (close - low20) / nullif(atr_14, 0) AS distance_to_low_20_atr
  FROM crossing WINDOW v AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""
)


def _thresholds(quantiles: tuple[float, ...], source: str = "wide", keys: str = "symbol", cond: str = "pos < train_end") -> str:
    """One aggregate a quantile: the quantile argument has to be constant."""
    parts = [
        f"SELECT {keys}, {x}::DOUBLE AS quantile, round(quantile_cont(ma_dispersion_atr, {x}), {S.digits}) AS threshold, count(ma_dispersion_atr) AS n_train FROM {source} WHERE {cond} AND ma_dispersion_atr IS NOT NULL GROUP BY {keys}"
        for x in quantiles
    ]
    return ",\nthr AS (" + "\nUNION ALL ".join(parts) + ")"


def _streaks(keys: str = "symbol, quantile", source: str = "wide JOIN thr USING (symbol)") -> str:
    over = f"OVER (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    return f""",
marked AS (
  SELECT *, coalesce(ma_dispersion_atr < threshold, false) AS below, coalesce(ma_dispersion_atr >= threshold, false) AS above FROM {source}),
counted AS (
  SELECT *, pos - coalesce(max(CASE WHEN NOT below THEN pos END) {over}, -1) AS streak,
         pos - coalesce(max(CASE WHEN NOT above THEN pos END) {over}, -1) AS above_run FROM marked),
streaks AS (
  SELECT *, coalesce(lag(streak) OVER (PARTITION BY {keys} ORDER BY pos), 0) AS prev_streak FROM counted)"""


def _scan(keys: str = "symbol, quantile") -> str:
    return f""",
raw AS (
  SELECT *, 'zone_start' AS trigger, streak AS zone_length FROM streaks WHERE streak >= {S.min_duration}
  UNION ALL SELECT *, 'dispersion_exit', prev_streak FROM streaks WHERE above AND prev_streak >= {S.min_duration}
  UNION ALL SELECT *, 'price_breakout', prev_streak FROM streaks WHERE (close > ma_upper OR close < ma_lower) AND prev_streak >= {S.min_duration}),
kept AS (
  SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY {keys}, trigger ORDER BY pos) > {S.cooldown}, true) AS first_of_group FROM raw),
scanned AS (SELECT * FROM kept WHERE first_of_group)"""


THR = IND + _thresholds(S.quantiles)
STREAK = THR + _streaks()
SCAN = STREAK + _scan()

EPI = (
    STREAK
    + f""",
signals AS (
  SELECT symbol, quantile, pos, n_bars, streak = {S.min_duration} AS q,
    max(CASE WHEN above_run = {S.exit_confirm} THEN pos END) OVER (PARTITION BY symbol, quantile ORDER BY pos ROWS UNBOUNDED PRECEDING) AS last_e,
    min(CASE WHEN above_run = {S.exit_confirm} THEN pos END) OVER (PARTITION BY symbol, quantile ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_e
  FROM streaks),
epi AS (
  SELECT symbol, quantile, min(pos) - {S.min_duration - 1} AS episode_start_pos, min(pos) AS episode_qualified_pos,
    coalesce(arg_min_null(next_e, pos), max(n_bars) - 1) AS episode_end_pos, arg_min_null(next_e, pos) IS NOT NULL AS episode_closed
  FROM signals WHERE q GROUP BY symbol, quantile, coalesce(last_e, -1)),
flags AS (
  SELECT *, coalesce(high >= ma_lower AND close < ma_lower, false) AND slope_down AS failed_reclaim,
    coalesce(prev_dispersion < threshold AND ma_dispersion_atr >= threshold AND close < ma_lower, false) AND slope_down AS compression_exit_down,
    coalesce(close < prior_local_low AND close < cluster_center, false) AND slope_down AS local_low_break
  FROM streaks)"""
)

ANC = (
    EPI
    + """,
hits AS (
  SELECT e.symbol, e.quantile, e.episode_start_pos, e.episode_qualified_pos, min(f.pos) AS decision_pos
  FROM epi e JOIN flags f ON f.symbol = e.symbol AND f.quantile = e.quantile AND f.pos BETWEEN e.episode_qualified_pos AND e.episode_end_pos
  WHERE f.failed_reclaim OR f.compression_exit_down OR f.local_low_break GROUP BY ALL),
anc AS (
  SELECT h.*, max(f.timestamp) FILTER (f.pos = h.decision_pos) AS decision_at,
    count(*) FILTER (f.below) AS compression_duration_at_decision,
    CAST(max(f.failed_reclaim::INT) FILTER (f.pos = h.decision_pos) AS INTEGER) AS trigger_failed_reclaim,
    CAST(max(f.compression_exit_down::INT) FILTER (f.pos = h.decision_pos) AS INTEGER) AS trigger_compression_exit_down,
    CAST(max(f.local_low_break::INT) FILTER (f.pos = h.decision_pos) AS INTEGER) AS trigger_local_low_break,
    max(f.ma_dispersion_atr) FILTER (f.pos = h.decision_pos) AS ma_dispersion_atr_at_decision,
    min(f.ma_dispersion_atr) AS episode_min_dispersion_so_far
  FROM hits h JOIN flags f ON f.symbol = h.symbol AND f.quantile = h.quantile AND f.pos BETWEEN h.episode_start_pos AND h.decision_pos GROUP BY ALL),
anchored AS (
  SELECT *, decision_pos - episode_start_pos AS episode_age_at_decision, compression_duration_at_decision AS zone_length,
    ma_dispersion_atr_at_decision - episode_min_dispersion_so_far AS dispersion_change_from_min,
    concat_ws('+', CASE WHEN trigger_compression_exit_down = 1 THEN 'compression_exit_down' END, CASE WHEN trigger_failed_reclaim = 1 THEN 'failed_reclaim' END,
              CASE WHEN trigger_local_low_break = 1 THEN 'local_low_break' END) AS trigger_type
  FROM anc)"""
)

LAB = f""",
dropped AS (
  SELECT *, CASE WHEN pos + {S.horizon} >= n_bars THEN 'incomplete_horizon' WHEN NOT coalesce(atr_14 > 0, false) THEN 'bad_atr' END AS label_drop FROM wide),
priced AS (
  SELECT *, next_open AS entry_price, atr_14 AS atr_at_entry, (next_open - future_low) / nullif(atr_14, 0) AS mfe_short, (future_high - next_open) / nullif(atr_14, 0) AS mae_short,
    (next_open - future_close) / nullif(next_open, 0) AS gross_return
  FROM dropped),
labels AS (
  SELECT symbol AS s, pos AS p, label_drop, n_bars AS nb, train_end AS te, val_end AS ve, entry_price, atr_at_entry, mfe_short, mae_short,
    mfe_short - {S.mae_penalty} * mae_short AS short_utility, gross_return AS future_close_return_short, gross_return, gross_return - {S.cost} AS net_return
  FROM priced)"""


def _split(pos: str = "decision_pos") -> str:
    return f"CASE WHEN {pos} < te THEN 'train' WHEN {pos} < te + {S.gap} THEN 'dropped_gap' WHEN {pos} < ve THEN 'val' WHEN {pos} < ve + {S.gap} THEN 'dropped_gap' ELSE 'test' END"


_OUT = ", ".join(f"l.{c}" for c in LABELS)
ZONES = (
    SCAN
    + LAB
    + f""",
zones AS (
  SELECT k.symbol, k.quantile, k.pos AS decision_pos, k.zone_length, k.ma_dispersion_atr, l.label_drop, {_OUT}, {_split('k.pos')} AS split
  FROM scanned k JOIN labels l ON l.s = k.symbol AND l.p = k.pos WHERE k.trigger = 'zone_start')"""
)
SCORED = (
    ANC
    + LAB
    + f""",
scored AS (
  SELECT a.*, {_OUT}, {_split('a.decision_pos')} AS split, -a.ma_dispersion_atr_at_decision AS score
  FROM anchored a JOIN labels l ON l.s = a.symbol AND l.p = a.decision_pos WHERE l.label_drop IS NULL)"""
)

FOLDS = f""",
fold_n AS (SELECT DISTINCT symbol, n_bars FROM bars),
folds AS (
  SELECT symbol, k AS fold, CAST(floor(n_bars * ({S.initial}::DOUBLE + (1 - {S.initial}::DOUBLE) * k / {S.n_folds}::DOUBLE)) AS BIGINT) AS train_edge,
    CAST(floor(n_bars * ({S.initial}::DOUBLE + (1 - {S.initial}::DOUBLE) * (k + 1) / {S.n_folds}::DOUBLE)) AS BIGINT) AS test_hi
  FROM fold_n, (SELECT CAST(unnest(range({S.n_folds})) AS DOUBLE) AS k)),
fold_rows AS (SELECT symbol, CAST(fold AS BIGINT) AS fold, train_edge, test_hi, CAST(floor(train_edge * (1 - {S.inner_val}::DOUBLE)) AS BIGINT) AS inner_val_start FROM folds)"""

GRID = (
    IND
    + FOLDS
    + ",\nfold_bars AS (SELECT w.symbol, w.pos, w.ma_dispersion_atr, f.fold, f.inner_val_start FROM wide w JOIN fold_rows f USING (symbol))"
    + _thresholds(S.quantiles, "fold_bars", "symbol, fold", "pos < inner_val_start")
    + _streaks("symbol, fold, quantile", "wide JOIN (SELECT symbol, fold, quantile, threshold FROM thr) USING (symbol)")
    + _scan("symbol, fold, quantile")
    + LAB
    + f""",
grid AS (
  SELECT k.trigger, k.quantile, k.symbol, k.fold, k.pos AS decision_pos, k.ma_dispersion_atr, {_OUT}, f.train_edge, f.test_hi,
    CASE WHEN k.pos < f.inner_val_start THEN 'train' WHEN k.pos >= f.inner_val_start + {S.gap} AND k.pos < f.train_edge - {S.horizon} THEN 'val'
         WHEN k.pos >= f.train_edge + {S.gap} AND k.pos < f.test_hi THEN 'test' ELSE 'dropped' END AS split
  FROM scanned k JOIN labels l ON l.s = k.symbol AND l.p = k.pos JOIN fold_rows f ON f.symbol = k.symbol AND f.fold = k.fold WHERE l.label_drop IS NULL)"""
)


def _stats(keys: str, source: str) -> str:
    means = {"mean_short_utility": "avg(short_utility)", "median_short_utility": "median(short_utility)", "mean_mfe": "avg(mfe_short)", "mean_mae": "avg(mae_short)", "mean_gross_return": "avg(gross_return)", "mean_net_return": "avg(net_return)", "positive_net_return_ratio": "avg(CAST(net_return > 0 AS DOUBLE))"}
    return f"SELECT {keys}, count(*) AS sample_count, " + ", ".join(f"CAST(round(CAST({e} AS DECIMAL(38,9)), 5) AS DOUBLE) AS {n}" for n, e in means.items()) + f" FROM {source} GROUP BY {keys}"


def _quartiles(keys: str, source: str, v: str) -> str:
    return f"SELECT {keys}, count({v}) AS n, CAST(round(CAST(avg({v}) AS DECIMAL(38,9)), 5) AS DOUBLE) AS mean, CAST(round(CAST(quantile_cont({v}, 0.5) AS DECIMAL(38,9)), 5) AS DOUBLE) AS median, CAST(round(CAST(quantile_cont({v}, 0.25) AS DECIMAL(38,9)), 5) AS DOUBLE) AS p25, CAST(round(CAST(quantile_cont({v}, 0.75) AS DECIMAL(38,9)), 5) AS DOUBLE) AS p75 FROM {source} GROUP BY {keys}"


def _ranks(keys: str, source: str) -> str:
    avg = lambda x: f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0"
    return f"SELECT *, {avg('score')} AS ra, {avg('short_utility')} AS rb FROM {source}"


TOPPED = """,
placed AS (SELECT *, row_number() OVER (PARTITION BY quantile, split ORDER BY score DESC, symbol, decision_pos) AS place, count(*) OVER (PARTITION BY quantile, split) AS size FROM scored WHERE score IS NOT NULL),
topped AS (
  SELECT *, 'all' AS grp FROM placed UNION ALL SELECT *, 'top_10pct' FROM placed WHERE place <= greatest(1, ceil(size * 0.1::DOUBLE))
  UNION ALL SELECT *, 'top_20pct' FROM placed WHERE place <= greatest(1, ceil(size * 0.2::DOUBLE)))"""


def control(events: str, pool: str, gross: str) -> str:
    """Draws for ``events`` (symbol, decision_pos) from ``pool`` (symbol, pos, timestamp, atr_14)."""
    return f""",
pool AS ({pool}),
cuts AS (SELECT symbol, round(quantile_cont(atr_14, 1.0::DOUBLE / 3), {S.digits}) AS t1, round(quantile_cont(atr_14, 2.0::DOUBLE / 3), {S.digits}) AS t2 FROM pool GROUP BY symbol),
bucketed AS (SELECT p.symbol, p.pos, strftime(p.timestamp, '%Y-%m') AS month, CASE WHEN atr_14 < t1 THEN 0 WHEN atr_14 < t2 THEN 1 ELSE 2 END AS ter FROM pool p JOIN cuts USING (symbol)),
everywhere AS (SELECT * FROM bucketed UNION ALL SELECT symbol, pos, '*', -1 FROM bucketed),
numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol, month, ter ORDER BY pos) - 1 AS number, count(*) OVER (PARTITION BY symbol, month, ter) AS size FROM everywhere),
sizes AS (SELECT DISTINCT symbol, month, ter, size FROM numbered),
asked AS (
  SELECT e.symbol, e.decision_pos AS event_pos, strftime(e.timestamp, '%Y-%m') AS month, CASE WHEN e.atr_14 < t1 THEN 0 WHEN e.atr_14 < t2 THEN 1 ELSE 2 END AS ter
  FROM ({events}) e JOIN cuts USING (symbol)),
settled AS (
  SELECT a.symbol, a.event_pos, s.size IS NULL AS fallback, CASE WHEN s.size IS NULL THEN '*' ELSE a.month END AS month, CASE WHEN s.size IS NULL THEN -1 ELSE a.ter END AS ter
  FROM asked a LEFT JOIN sizes s ON s.symbol = a.symbol AND s.month = a.month AND s.ter = a.ter),
drawn AS (
  SELECT t.symbol, t.event_pos, t.fallback, t.month, t.ter, CAST(d AS INTEGER) AS draw,
    CAST('0x' || substr(md5(concat_ws('|', t.event_pos, d, {S.seed})), 1, 8) AS BIGINT) % s.size AS number
  FROM settled t JOIN sizes s ON s.symbol = t.symbol AND s.month = t.month AND s.ter = t.ter, (SELECT unnest(range({S.draws})) AS d)),
control AS (
  SELECT d.symbol, d.event_pos, d.draw, n.pos AS decision_pos, d.fallback, {gross}
  FROM drawn d JOIN numbered n ON n.symbol = d.symbol AND n.month = d.month AND n.ter = d.ter AND n.number = d.number)"""


CONTROL = SCORED + control(
    f"SELECT s.symbol, s.decision_pos, w.timestamp, w.atr_14 FROM scored s JOIN wide w ON w.symbol = s.symbol AND w.pos = s.decision_pos WHERE s.split = 'test' AND s.quantile = {S.quantiles[0]}",
    f"SELECT symbol, pos, timestamp, atr_14 FROM wide WHERE pos >= val_end + {S.gap} AND pos < least(n_bars, n_bars - {S.horizon} - 1) AND atr_14 > 0",
    "(SELECT l.gross_return FROM labels l WHERE l.s = d.symbol AND l.p = n.pos) AS gross_return, (SELECT l.net_return FROM labels l WHERE l.s = d.symbol AND l.p = n.pos) AS net_return",
)

PLT = (
    IND
    + _thresholds((S.platform_quantile,))
    + _streaks()
    + """,
runs AS (
  SELECT symbol, pos - streak + 1 AS core_start, max(pos) AS core_end, count(*) AS core_len, max(high) AS hi, min(low) AS lo, arg_max_null(atr_14, pos) AS atr,
    arg_max_null(sma_20, pos) AS s1, arg_min_null(sma_20, pos) AS s0, min(ma_dispersion_atr) AS min_dispersion, max(ts) AS end_ts
  FROM streaks WHERE below GROUP BY symbol, pos - streak + 1),
sized AS (SELECT *, (hi - lo) / nullif(atr, 0) AS range_atr, abs(s1 - s0) / nullif(atr, 0) AS sma20_drift_atr FROM runs),
plt AS (
  SELECT *, CASE WHEN core_len < 4 THEN 'too_short' WHEN core_len > 12 THEN 'too_long' WHEN range_atr >= 3 THEN 'range' WHEN sma20_drift_atr >= 0.5 THEN 'drift' END AS reject FROM sized)"""
)

_EVENT = "symbol, quantile, trigger, pos AS decision_pos, ts AS decision_ts, zone_length"
_WITH_FEATURES = [f for f in FEATURES if f != "compression_duration"]
_COMPLETE = " AND ".join(f"f.{c} IS NOT NULL" for c in _WITH_FEATURES)

_GAP = """
WITH firsts AS (SELECT * FROM klines WHERE symbol IS NOT NULL AND ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY ingest_seq) = 1),
stepped AS (
  SELECT f.*, s.bar_minutes * 60000 AS step_ms, lag(f.ts) OVER (PARTITION BY f.symbol ORDER BY f.ts) AS prev_ts, min(f.ts) OVER (PARTITION BY f.symbol) AS first_ts
  FROM firsts f LEFT JOIN symbols s USING (symbol))
"""


def _d(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def _sets(k: int) -> str:
    """Review sets of ``k`` rows each."""
    return f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY quantile ORDER BY score DESC, symbol, decision_pos) AS place, count(*) OVER (PARTITION BY quantile) AS n FROM scored WHERE split = 'test' AND score IS NOT NULL),
named AS (SELECT *, CASE WHEN place <= least({k}, n) THEN 'top' WHEN place > n - least({k}, greatest(0, n - {k})) THEN 'bottom' ELSE 'middle' END AS review_set FROM placed),
middles AS (SELECT *, row_number() OVER (PARTITION BY quantile ORDER BY md5(concat_ws('|', symbol, decision_pos, {S.seed})), symbol, decision_pos) AS rn FROM named WHERE review_set = 'middle'),
reviewed AS (SELECT * FROM named WHERE review_set <> 'middle' UNION ALL SELECT * EXCLUDE (rn) FROM middles WHERE rn <= {k})"""


FOLD_DATA = (
    FEAT
    + GRID[len(IND) :]
    + f""",
dataset AS (SELECT g.* FROM grid g JOIN feat f ON f.symbol = g.symbol AND f.pos = g.decision_pos WHERE g.split <> 'dropped' AND {_COMPLETE}),
gated AS (
  SELECT *, n_train >= 40 AND n_val >= 10 AND n_test >= 10 AS passes_gate
  FROM (SELECT trigger, quantile, fold, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test FROM dataset GROUP BY ALL))"""
)
FOLD_CONTROL = (
    FOLD_DATA
    + """,
test AS (
  SELECT d.trigger, d.quantile, concat_ws('#', d.symbol, d.fold) AS symbol, d.symbol AS base, d.fold, d.decision_pos, d.short_utility, d.gross_return, -d.ma_dispersion_atr AS score
  FROM dataset d JOIN gated g ON g.trigger = d.trigger AND g.quantile = d.quantile AND g.fold = d.fold AND g.passes_gate WHERE d.split = 'test')"""
    + control(
        "SELECT DISTINCT t.symbol, t.decision_pos, w.timestamp, w.atr_14 FROM test t JOIN wide w ON w.symbol = t.base AND w.pos = t.decision_pos",
        f"SELECT concat_ws('#', w.symbol, f.fold) AS symbol, w.pos, w.timestamp, w.atr_14 FROM wide w JOIN fold_rows f USING (symbol) WHERE w.pos >= f.train_edge + {S.gap} AND w.pos < least(f.test_hi, w.n_bars - {S.horizon} - 1) AND w.atr_14 > 0",
        "(SELECT l.gross_return FROM labels l WHERE l.s = split_part(d.symbol, '#', 1) AND l.p = n.pos) AS g",
    )
)

SQL = {
    "src_feed_bars": BARS + " SELECT symbol, pos, ts, open, high, low, close, volume, strftime(make_timestamp(ts * 1000), '%Y-%m') AS month FROM bars",
    "src_5_holdout": BARS.replace("ts IS NOT NULL", "ts IS NOT NULL AND ts < 1704067200000") + " SELECT symbol, count(*) AS n, max(ts) AS last_ts FROM bars GROUP BY symbol",
    "src_10_event_bars": """
SELECT symbol, slot AS ts, arg_min(x, o) AS open, max(x) AS high, min(x) AS low, arg_max(x, o) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM (SELECT event_type AS symbol, epoch_ms(ts) - epoch_ms(ts) % 900000 AS slot, value + 1 AS x, {'a': epoch_ms(ts), 't': event_id} AS o FROM events) GROUP BY symbol, slot""",
    "chk_report": _GAP
    + """,
report AS (
  SELECT symbol, count(*) AS rows_final,
    count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS null_rows,
    count(*) FILTER (coalesce(high < low, false) OR coalesce(high < open, false) OR coalesce(high < close, false) OR coalesce(low > open, false) OR coalesce(low > close, false) OR coalesce(low <= 0, false)) AS bound_violations,
    count(*) FILTER (volume < 0) AS negative_volumes, count(*) FILTER ((ts - first_ts) % step_ms <> 0) AS off_grid, count(*) FILTER (ts - prev_ts <> step_ms) AS n_gaps, min(ts) AS start_ts, max(ts) AS end_ts
  FROM stepped GROUP BY symbol)
SELECT r.*, c.rows_raw, c.rows_raw - r.rows_final AS duplicates, null_rows + bound_violations + negative_volumes + off_grid = 0 AS passed
FROM report r JOIN (SELECT symbol, count(*) AS rows_raw FROM klines WHERE ts IS NOT NULL GROUP BY symbol) c USING (symbol)""",
    "chk_5_gaps": _GAP
    + "SELECT symbol, prev_ts AS after_ts, ts AS before_ts, CAST(round(CAST((ts - prev_ts) / step_ms AS DECIMAL(38,9)), 6) AS DOUBLE) AS gap_bars FROM stepped WHERE ts - prev_ts <> step_ms QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts) <= 20",
    "ind_1_2_averages": IND + f" SELECT symbol, pos, {r(MAS, 4)} FROM wide",
    "ind_3_5_true_range": IND + f" SELECT symbol, pos, {r(['tr', 'atr_14', 'tr_mean_5', 'tr_mean_20'], 4)} FROM wide",
    "clu_cluster": IND + f" SELECT symbol, pos, {r(['ma_upper', 'ma_lower', 'cluster_center'], 4)}, CAST(round(CAST(ma_dispersion_atr AS DECIMAL(38,9)), 6) AS DOUBLE) AS ma_dispersion_atr FROM wide",
    "feat_27": FEAT
    + _thresholds(S.quantiles[:1])
    + _streaks(source="feat JOIN thr USING (symbol)")
    + f" SELECT symbol, pos, CAST(streak AS DOUBLE) AS compression_duration, {r(_WITH_FEATURES, 5)} FROM streaks",
    "thr_1_thresholds": IND + _thresholds((*S.quantiles, S.platform_quantile)) + " SELECT symbol, quantile, CAST(round(CAST(threshold AS DECIMAL(38,9)), 6) AS DOUBLE) AS threshold, n_train FROM thr",
    "isl_1_streaks": STREAK + " SELECT symbol, quantile, pos, streak, prev_streak, above_run FROM streaks",
    **{f"scn_{i}_{t}": SCAN + f" SELECT {_EVENT} FROM scanned WHERE trigger = '{t}'" for i, t in enumerate(("zone_start", "dispersion_exit", "price_breakout"), 1)},
    "scn_5_stats": SCAN + " SELECT symbol, quantile, trigger, count(*) AS raw_candidate_count, count(*) FILTER (first_of_group) AS dedup_event_count FROM kept GROUP BY ALL",
    "epi_episodes": EPI
    + f""" SELECT e.*, max(s.ts) FILTER (s.pos = episode_start_pos) AS episode_start_ts, max(s.ts) FILTER (s.pos = episode_qualified_pos) AS episode_qualified_ts,
  max(s.ts) FILTER (s.pos = episode_end_pos) AS episode_end_ts, episode_end_pos - episode_start_pos + 1 AS episode_duration_bars,
  CAST(round(CAST(min(s.ma_dispersion_atr) AS DECIMAL(38,9)), 5) AS DOUBLE) AS min_dispersion, CAST(round(CAST(avg(s.ma_dispersion_atr) AS DECIMAL(38,9)), 5) AS DOUBLE) AS mean_dispersion,
  CAST(round(CAST(max(s.ma_dispersion_atr) FILTER (s.pos = episode_qualified_pos) AS DECIMAL(38,9)), 5) AS DOUBLE) AS qualified_dispersion
FROM epi e JOIN streaks s ON s.symbol = e.symbol AND s.quantile = e.quantile AND s.pos BETWEEN e.episode_start_pos AND e.episode_end_pos GROUP BY ALL""",
    "trg_flags": EPI + " SELECT symbol, quantile, pos, CAST(compression_exit_down AS INTEGER) AS compression_exit_down, CAST(failed_reclaim AS INTEGER) AS failed_reclaim, CAST(local_low_break AS INTEGER) AS local_low_break, CAST(round(CAST(prior_local_low AS DECIMAL(38,9)), 6) AS DOUBLE) AS prior_local_low FROM flags",
    "anc_events": ANC
    + f" SELECT * EXCLUDE (decision_at, ma_dispersion_atr_at_decision, episode_min_dispersion_so_far, dispersion_change_from_min), epoch_ms(decision_at) AS decision_ts, {r(['ma_dispersion_atr_at_decision', 'episode_min_dispersion_so_far', 'dispersion_change_from_min'], 5)} FROM anchored",
    "plt_1_platforms": PLT + f" SELECT symbol, core_start, core_end, core_len, end_ts, reject, {r(['min_dispersion', 'range_atr', 'sma20_drift_atr'], 5)} FROM plt",
    "plt_1_rejects": PLT + " SELECT coalesce(reject, 'accepted') AS reason, count(*) AS n FROM plt GROUP BY ALL",
    "plt_2_stats": PLT
    + " SELECT s.symbol, s.share_below, p.core_len, p.n FROM (SELECT symbol, CAST(round(CAST(avg(CAST(below AS DOUBLE)) AS DECIMAL(38,9)), 6) AS DOUBLE) AS share_below FROM streaks GROUP BY symbol) s LEFT JOIN (SELECT symbol, core_len, count(*) AS n FROM plt WHERE reject IS NULL GROUP BY ALL) p USING (symbol)",
    "plt_3_pick": PLT
    + """, acc AS (SELECT *, row_number() OVER (ORDER BY end_ts, symbol, core_start) - 1 AS number, count(*) OVER () AS n FROM plt WHERE reject IS NULL)
SELECT end_ts, symbol, core_start, core_len FROM acc WHERE number IN (SELECT (i * (n - 1)) // greatest(least(50, n) - 1, 1) FROM (SELECT DISTINCT n FROM acc), (SELECT unnest(range(50)) AS i) WHERE i < least(50, n))""",
    "lab_labels": ZONES + f" SELECT symbol, quantile, decision_pos, {r(LABELS[:2], 4)}, {r(LABELS[2:], 5)} FROM zones WHERE label_drop IS NULL",
    "lab_8_9_drops": ZONES + " SELECT quantile, coalesce(label_drop, 'labelled') AS outcome, count(*) AS n FROM zones GROUP BY ALL",
    "spl_1_boundaries": IND + " SELECT DISTINCT symbol, n_bars, train_end, val_end, NOT (train_end > 0 AND train_end < val_end AND val_end < n_bars) AS degenerate FROM wide",
    "spl_2_counts": ZONES + " SELECT symbol, quantile, split, count(*) AS n FROM zones WHERE label_drop IS NULL GROUP BY ALL",
    "spl_3_dataset": FEAT
    + ZONES[len(IND) :]
    + f" SELECT z.symbol, z.quantile, z.decision_pos, z.split, CAST(z.zone_length AS DOUBLE) AS compression_duration, {r(['short_utility', 'net_return', 'linear_slope_60', 'volume_zscore_20', 'sma120_slope_20', 'max_consecutive_close_above_10'], 5)} FROM zones z JOIN feat f ON f.symbol = z.symbol AND f.pos = z.decision_pos WHERE z.label_drop IS NULL AND {_COMPLETE}",
    "flt_3_dropped": FEAT + ZONES[len(IND) :] + f" SELECT z.symbol, count(*) FILTER (NOT ({_COMPLETE})) AS dropped, count(*) FILTER ({_COMPLETE}) AS kept FROM zones z JOIN feat f ON f.symbol = z.symbol AND f.pos = z.decision_pos WHERE z.label_drop IS NULL GROUP BY z.symbol",
    "wf_1_folds": BARS + FOLDS + " SELECT symbol, fold, train_edge AS train_end, train_edge AS test_lo, test_hi, inner_val_start FROM fold_rows",
    "wf_2_thresholds": GRID + " SELECT symbol, fold, quantile, CAST(round(CAST(threshold AS DECIMAL(38,9)), 6) AS DOUBLE) AS threshold, n_train FROM thr",
    "wf_4_7_grid": GRID
    + " SELECT trigger, quantile, symbol, fold, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test FROM grid GROUP BY ALL",
    "wf_5_gate": FOLD_DATA + " SELECT trigger, quantile, fold, n_train, n_val, n_test, passes_gate FROM gated",
    "wf_8_pool": FOLD_CONTROL
    + f""",
fold_rank AS ({_ranks('trigger, quantile, fold', 'test')}),
all_rank AS ({_ranks('trigger, quantile', 'test')}),
rho AS (SELECT trigger, quantile, fold, count(*) AS n, CASE WHEN stddev_pop(ra) * stddev_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM fold_rank GROUP BY ALL),
weighted AS (SELECT trigger, quantile, count(*) AS n_folds_used, CAST(sum(n) AS BIGINT) AS n_oos_events, sum(rho * n) / sum(n) FILTER (rho IS NOT NULL) AS weighted_mean_spearman FROM rho GROUP BY ALL),
pooled AS (SELECT trigger, quantile, corr(ra, rb) AS pooled_spearman FROM all_rank GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY trigger, quantile, fold ORDER BY score DESC, base, decision_pos) AS place, count(*) OVER (PARTITION BY trigger, quantile, fold) AS size FROM test WHERE score IS NOT NULL),
groups AS (
  SELECT trigger, quantile, avg(gross_return) FILTER (place <= greatest(1, ceil(size * 0.1::DOUBLE))) AS gross_top_10pct, avg(gross_return) FILTER (place <= greatest(1, ceil(size * 0.2::DOUBLE))) AS gross_top_20pct, avg(gross_return) AS gross_all
  FROM placed GROUP BY ALL),
fold_control AS (SELECT t.trigger, t.quantile, t.fold, avg(c.g) AS control_gross, count(c.g) AS control_n FROM test t JOIN control c ON c.symbol = t.symbol AND c.event_pos = t.decision_pos GROUP BY ALL),
controls AS (SELECT trigger, quantile, count(*) AS n_folds_with_control, sum(control_gross * control_n) / sum(control_n) AS control_mean FROM fold_control WHERE control_gross IS NOT NULL GROUP BY ALL)
SELECT trigger, quantile, n_folds_used, n_oos_events, CAST(round(CAST(weighted_mean_spearman AS DECIMAL(38,9)), 6) AS DOUBLE) AS weighted_mean_spearman, CAST(round(CAST(pooled_spearman AS DECIMAL(38,9)), 6) AS DOUBLE) AS pooled_spearman, {r(['gross_top_10pct', 'gross_top_20pct', 'gross_all'], 6)},
  n_folds_with_control, CAST(round(CAST(control_mean AS DECIMAL(38,9)), 6) AS DOUBLE) AS control_mean_gross_return, CAST(round(CAST((gross_all - control_mean) * 1e4 AS DECIMAL(38,9)), 3) AS DOUBLE) AS edge_all_vs_control_bp, CAST(round(CAST((gross_top_10pct - control_mean) * 1e4 AS DECIMAL(38,9)), 3) AS DOUBLE) AS edge_top10_vs_control_bp
FROM weighted JOIN pooled USING (trigger, quantile) JOIN groups USING (trigger, quantile) LEFT JOIN controls USING (trigger, quantile)""",
    "agg_1_group_stats": SCORED + " " + _stats("quantile, split", "scored"),
    "agg_2_quartiles": SCORED + " " + _quartiles("quantile, split", "scored", "short_utility"),
    "agg_3_trigger_types": SCORED + " SELECT quantile, trigger_type, count(*) AS n, CAST(round(CAST(avg(short_utility) AS DECIMAL(38,9)), 5) AS DOUBLE) AS mean_utility, CAST(round(CAST(avg(net_return) AS DECIMAL(38,9)), 5) AS DOUBLE) AS mean_net FROM scored GROUP BY ALL",
    "agg_6_7_correlations": SCORED
    + f", ranked AS ({_ranks('quantile, split', '(SELECT * FROM scored WHERE score IS NOT NULL AND short_utility IS NOT NULL)')}) SELECT quantile, split, count(*) AS n, CAST(round(CAST(corr(score, short_utility) AS DECIMAL(38,9)), 6) AS DOUBLE) AS pearson, CAST(round(CAST(corr(ra, rb) AS DECIMAL(38,9)), 6) AS DOUBLE) AS spearman FROM ranked GROUP BY ALL HAVING count(*) >= 3",
    "agg_9_terciles": IND
    + "".join(f"{' UNION ALL' if i > 1 else ''} SELECT symbol, CAST(round(CAST({i}.0::DOUBLE / 3 AS DECIMAL(38,9)), 6) AS DOUBLE) AS quantile, CAST(round(CAST(quantile_cont(atr_14, {i}.0::DOUBLE / 3) AS DECIMAL(38,9)), 4) AS DOUBLE) AS value, count(*) AS n FROM wide WHERE atr_14 > 0 GROUP BY symbol" for i in (1, 2)),
    "agg_11_cost_sweep": SCORED
    + f" SELECT quantile, split, cost, count(*) AS n, CAST(round(CAST(avg(gross_return - cost) AS DECIMAL(38,9)), 6) AS DOUBLE) AS mean_net_return, CAST(round(CAST(avg(CAST(gross_return - cost > 0 AS DOUBLE)) AS DECIMAL(38,9)), 6) AS DOUBLE) AS positive_ratio FROM scored, (VALUES {', '.join(f'({c}::DOUBLE)' for c in S.costs)}) AS t(cost) GROUP BY ALL",
    "agg_13_semantics": SCORED
    + _scan()
    + f""",
zones AS (SELECT k.quantile, k.zone_length, k.ma_dispersion_atr, l.short_utility FROM scanned k JOIN labels l ON l.s = k.symbol AND l.p = k.pos WHERE k.trigger = 'zone_start' AND l.label_drop IS NULL),
arms AS (
  SELECT quantile, 'anchored' AS arm, CAST(episode_age_at_decision AS DOUBLE) AS episode_age_at_decision, CAST(compression_duration_at_decision AS DOUBLE) AS compression_duration_at_decision, ma_dispersion_atr_at_decision, short_utility FROM scored
  UNION ALL SELECT quantile, 'legacy', zone_length - 1, zone_length, ma_dispersion_atr, short_utility FROM zones),
long AS (UNPIVOT arms ON episode_age_at_decision, compression_duration_at_decision, ma_dispersion_atr_at_decision, short_utility INTO NAME measure VALUE v)
{_quartiles('quantile, arm, measure', 'long', 'v')}""",
    "agg_14_episode_stats": ANC
    + """ SELECT e.quantile, count(*) AS episode_count, count(a.decision_pos) AS with_trigger, count(*) FILTER (a.decision_pos IS NULL) AS without_trigger, count(*) FILTER (e.episode_closed) AS closed,
  CAST(round(CAST(avg(e.episode_end_pos - e.episode_start_pos + 1) AS DECIMAL(38,9)), 6) AS DOUBLE) AS mean_duration, max(e.episode_end_pos - e.episode_start_pos + 1) AS max_duration
FROM epi e LEFT JOIN anchored a ON a.symbol = e.symbol AND a.quantile = e.quantile AND a.episode_start_pos = e.episode_start_pos GROUP BY e.quantile""",
    "sort_1_top_groups": SCORED + TOPPED + " " + _stats("quantile, split, grp", "topped"),
    "sort_3_review_sets": SCORED + _sets(10) + " SELECT quantile, review_set, place, symbol, decision_pos FROM reviewed",
    "sort_3_published_sets": SCORED + _sets(50) + " SELECT quantile, review_set, place, symbol, decision_pos FROM reviewed",
    "prj_10_titles": SCORED
    + _sets(50)
    + f""",
shown AS (
  SELECT *, concat_ws(' ', concat(review_set, ' #', place), concat('id=', decision_pos), printf('pred=%.3f', {_d('score', 3)}), strftime(timestamp, '%Y-%m-%d %H:%M'), concat('(', split, ')'),
      CASE WHEN trigger_type <> '' THEN concat('trig=', trigger_type) END, CASE WHEN episode_age_at_decision IS NOT NULL THEN concat('ep_age=', episode_age_at_decision) END) AS decision_title
  FROM reviewed JOIN (SELECT symbol AS ws, pos AS wp, timestamp FROM wide) ON ws = symbol AND wp = decision_pos)
SELECT quantile, symbol, decision_title, concat(decision_title, printf(' | utility=%.3f mfe=%.2f mae=%.2f gross=%+.1fbp net=%+.1fbp', {_d('short_utility', 3)}, {_d('mfe_short', 2)}, {_d('mae_short', 2)}, {_d('gross_return', 5)} * 1e4, {_d('net_return', 5)} * 1e4)) AS outcome_title
FROM shown""",
    "sort_4_pool": SCORED
    + """,
sizes AS (SELECT quantile, symbol, count(*) FILTER (split = 'test') AS t, count(*) FILTER (split = 'val') AS v FROM scored GROUP BY ALL),
pools AS (SELECT quantile, symbol, CASE WHEN t >= 30 THEN 'test' WHEN t + v >= 30 THEN 'val+test' ELSE 'train+val+test' END AS pool FROM sizes)
SELECT s.quantile, s.symbol, p.pool, count(*) AS n FROM scored s JOIN pools p ON p.quantile = s.quantile AND p.symbol = s.symbol
WHERE s.split = 'test' OR s.split = 'val' AND p.pool <> 'test' OR s.split = 'train' AND p.pool = 'train+val+test' GROUP BY ALL""",
    "flt_5_flags": SCORED + " SELECT quantile, split, trigger_type, count(*) AS sample_count, count(*) < 10 AS few FROM scored GROUP BY ALL",
    "flt_5_pools": IND
    + f" SELECT symbol, count(*) FILTER (pos >= val_end + {S.gap} AND pos < least(n_bars, n_bars - {S.horizon} - 1) AND atr_14 > 0) AS pool, count(*) FILTER (pos >= val_end + {S.gap} AND pos < least(n_bars, n_bars - {S.horizon} - 1) AND atr_14 > 0) >= 100 AS enough FROM wide GROUP BY symbol",
    "sort_7_context": SCORED
    + f" SELECT s.symbol, s.decision_pos, b.pos - s.decision_pos AS \"offset\", b.ts, b.close FROM scored s JOIN bars b ON b.symbol = s.symbol AND b.pos BETWEEN s.decision_pos - 119 AND s.decision_pos + {S.horizon} WHERE s.split = 'test' AND s.quantile = 0.3",
    "win_percent_rank": SCORED
    + f", ranked AS ({_ranks('quantile, split', '(SELECT * FROM scored WHERE score IS NOT NULL)')}) SELECT quantile, split, symbol, decision_pos, CAST(round(CAST(ra / count(*) OVER (PARTITION BY quantile, split) AS DECIMAL(38,9)), 6) AS DOUBLE) AS score_pct FROM ranked",
    "smp_1_control": CONTROL + " SELECT symbol, event_pos, draw, decision_pos, fallback, CAST(round(CAST(gross_return AS DECIMAL(38,9)), 6) AS DOUBLE) AS gross_return FROM control",
    "smp_1_report": CONTROL
    + f""", per AS (SELECT symbol, count(*) * {S.draws} AS requested_sample_count FROM scored WHERE split = 'test' AND quantile = {S.quantiles[0]} GROUP BY symbol)
SELECT p.symbol, requested_sample_count, count(c.draw) AS actual_sample_count, count(DISTINCT c.decision_pos) AS unique_decision_pos_count, count(DISTINCT CASE WHEN c.fallback THEN c.event_pos END) AS n_fallback_events, count(c.draw) - count(DISTINCT c.decision_pos) AS duplicate_draw_count
FROM per p LEFT JOIN control c USING (symbol) GROUP BY ALL""",
    "agg_12_edges": CONTROL
    + f""", e AS (SELECT avg(gross_return) AS event_gross, avg(net_return) AS event_net FROM scored WHERE split = 'test' AND quantile = {S.quantiles[0]}), c AS (SELECT avg(gross_return) AS control_gross, avg(net_return) AS control_net FROM control)
SELECT {r(['event_gross', 'event_net', 'control_gross', 'control_net'], 6)}, CAST(round(CAST((event_gross - control_gross) * 1e4 AS DECIMAL(38,9)), 3) AS DOUBLE) AS edge_gross_bp, CAST(round(CAST((event_net - control_net) * 1e4 AS DECIMAL(38,9)), 3) AS DOUBLE) AS edge_net_bp FROM e, c""",
}
