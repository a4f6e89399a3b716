"""Implausible readings in a bar feed: impossible values, spikes and stuck stretches, per series.

Normal behaviour of a series comes from robust principal components: consecutive days
stacked to a (days x slots of the day) matrix per reading, split by alternating projections into
a low-rank part (what the series normally shows at that time) and a sparse part, the readings that lie beyond the
tail of the block's own residuals. A sparse entry is a spike if it is gone again within a few bars. Ranges and
constant runs are tested apart; runs are joined over all blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.salting import sized_join
from candlewright.session import materialise

#: Grid steps, in minutes, that a series may have; used where no step is given.
STEPS = (1, 3, 5, 15, 30, 60, 120, 240, 360, 480, 720, 1440, 10080)
DAY_MS = 86_400_000
#: Kinds of constant runs: close, traded volume, no volume.
RUNS = ("price", "volume", "silence")


@dataclass(frozen=True)
class SpikeRules:
    """block_bars, block_days: a task holds that many grid steps of a series, and that many days, at least. edge_bars: what
    a block sees of its neighbours. rounds: of the decomposition. false_spikes: expected number of ordinary readings
    a block, and reading, beyond the sparse part's cut (at 100 TB, some 10^8 blocks, a few hundred). near: bars looked at on each side. still: move, in
    scales of the series, below which a bar has not moved. least_run: shortest stuck stretch (bars after its first).
    false_runs: expected number of ordinary stretches of the needed length in a series.
    """

    block_bars: int = 4096
    block_days: int = 16
    edge_bars: int = 128
    rounds: int = 4
    false_spikes: float = 1e-6
    near: int = 7
    still: float = 0.02
    least_run: int = 6
    false_runs: float = 1e-4


def series_scales(feed: DataFrame, key: str = "symbol") -> DataFrame:
    """Per series: number of bars, scale of its moves inside a bar, shares of still and of silent bars, median log volume.

    Sketch aggregates with partial merging; no series is ordered or gathered.
    """
    ok = (F.col("open") > 0) & (F.col("close") > 0) & ~F.isnan("open") & ~F.isnan("close")
    move = F.when(ok, F.abs(F.ln(F.col("close") / F.col("open"))))
    traded = F.when((F.col("volume") > 0) & ~F.isnan("volume"), F.ln("volume"))
    return feed.groupBy(key).agg(
        F.approx_count_distinct("ts", 0.02).alias("_n"),  # bars, however often they were delivered
        F.percentile_approx(F.when(move > 0, move), 0.5, 1000).alias("_scale"),
        F.avg(F.when(move.isNotNull(), (move == 0).cast("double"))).alias("_still"),
        F.avg((F.col("volume") == 0).cast("double")).alias("_silent"),
        F.percentile_approx(traded, 0.5, 1000).alias("_logvol"),
        F.min("ts").alias("_first"),
        F.max("ts").alias("_last"),
    )


def with_step(scales: DataFrame, steps: DataFrame | None, key: str = "symbol") -> DataFrame:
    """``scales`` with the grid step in ms: as given, else the standard step nearest to the mean spacing."""
    spacing = (F.col("_last") - F.col("_first")) / F.greatest(F.col("_n") - 1, F.lit(1)) / 60000.0
    nearest = F.array_min(F.transform(F.array(*[F.lit(s) for s in STEPS]), lambda s: F.struct(F.abs(F.ln(s / F.greatest(spacing, F.lit(0.5)))).alias("off"), s.alias("s"))))["s"]
    if steps is None:
        return scales.withColumn("_step", nearest.cast("bigint") * 60000)
    # one row a series even if the given table repeats one
    given = steps.groupBy(F.col(key).alias("_k")).agg(F.min(F.when(F.col("bar_minutes") > 0, F.col("bar_minutes"))).alias("_given"))
    joined = scales.join(given, scales[key].eqNullSafe(given["_k"]), "left")
    return joined.withColumn("_step", F.coalesce(F.col("_given"), nearest).cast("bigint") * 60000).drop("_k", "_given")


def _known_median(m: np.ndarray, axis: int) -> np.ndarray:
    """Medians of the known values along an axis, 0 where there is none."""
    v = np.sort(m, axis=axis)  # NaN last
    n = np.isfinite(v).sum(axis=axis, keepdims=True)
    pick = lambda k: np.take_along_axis(v, np.maximum(k, 0), axis=axis)
    return np.where(n > 0, (pick((n - 1) // 2) + pick(n // 2)) / 2, 0.0)


def tail_cut(residual: np.ndarray, expected: float) -> float:
    """Size that ``expected`` of the residuals would exceed if all were ordinary: a Weibull tail through their own quartile and 95 % point.

    Zeros are left out. Up to a twentieth of the residuals may be anything without moving it. Infinite where fewer than 16 are known.
    """
    size = np.abs(residual[np.isfinite(residual)])
    size = np.sort(size[size > 1e-12])
    n = len(size)
    if n < 16:
        return np.inf
    low, high = size[int(0.75 * (n - 1))], size[int(0.95 * (n - 1))]
    shape = np.log(high / low) / np.log(np.log(0.05) / np.log(0.25))
    return float(high * (np.log(n / expected) / -np.log(0.05)) ** shape)


def decompose(m: np.ndarray, rounds: int, expected: float) -> tuple[np.ndarray, np.ndarray]:
    """Low-rank parts of a stack of matrices (c, days, slots) with gaps (NaN), and the cuts (c) beyond which an entry is sparse.

    Alternating projections: entries whose residual exceeds the tail of all residuals are left out of the fit and, like the gaps, filled from the
    current low-rank part (one ordinary entry may be, at the end only ``expected``); that part is the days' medians plus those principal components that exceed the
    greatest one left when each day is turned by a random number of slots. A single day, whose one component any turn keeps, has none.
    """
    known = np.isfinite(m)
    c, days, slots = m.shape
    value = np.where(known, m, 0.0)
    level = _known_median(m, 2)
    low = np.broadcast_to(level, m.shape)
    cuts = lambda low, expected: np.array([tail_cut(r[k], expected) for r, k in zip(value - low, known)])
    cut = cuts(low, 1.0)

    def gram(x: np.ndarray) -> np.ndarray:
        return x @ x.transpose(0, 2, 1) if slots > days else x.transpose(0, 2, 1) @ x

    # each day turned by hours drawn at random keeps its spread and its smoothness, and what days have in common at one time is lost
    about = np.where(known & (np.abs(value - low) <= cut[:, None, None]), value - low, 0.0)
    turns = np.random.default_rng(0).integers(0, slots, (4, days, 1))
    turned = [np.take_along_axis(about, np.broadcast_to((np.arange(slots) + t) % slots, m.shape), 2) for t in turns]
    noise = np.max([np.linalg.eigvalsh(gram(x))[:, -1] for x in turned], axis=0)
    for _ in range(rounds):
        dense = known & (np.abs(value - low) <= cut[:, None, None])
        filled = np.where(dense, value, low) - level
        size, vectors = np.linalg.eigh(gram(filled))
        kept = vectors * (size > 1.1 * noise[:, None])[:, None, :]
        parts = kept @ (kept.transpose(0, 2, 1) @ filled) if slots > days else (filled @ kept) @ kept.transpose(0, 2, 1)
        level = _known_median(np.where(known, m - parts, np.nan), 2)
        low = level + parts
        cut = cuts(low, 1.0)
    return low, cuts(low, expected)


def _side_medians(x: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the ``near`` known values before and after each place (NaN where none)."""
    pad = np.full(near, np.nan)
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, x, pad]), near)

    def med(v: np.ndarray) -> np.ndarray:
        v = np.sort(v, axis=1)  # NaN last
        n = np.isfinite(v).sum(1)
        at = np.arange(len(v))
        lo, hi = v[at, np.maximum((n - 1) // 2, 0)], v[at, np.minimum(n // 2, near - 1)]
        return np.where(n > 0, (lo + hi) / 2, np.nan)

    n = len(x)
    return med(views[:n]), med(views[near + 1 : near + 1 + n])


def _level(x: np.ndarray, near: int) -> np.ndarray:
    """Median of the known values within ``near`` places of each (NaN where none)."""
    pad = np.full(near, np.nan)
    v = np.sort(np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, x, pad]), 2 * near + 1), axis=1)  # NaN last
    n = np.isfinite(v).sum(1)
    at = np.arange(len(v))
    return np.where(n > 0, (v[at, np.maximum((n - 1) // 2, 0)] + v[at, np.minimum(n // 2, 2 * near)]) / 2, np.nan)


def _runs(same: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Of flags 'as the one before' of known bars (the first has none): length of the run each is in, and the runs at head and tail."""
    n = len(same)
    if n < 2:
        return np.zeros(n, np.int64), 0, 0
    edge = np.diff(np.concatenate([[0], same[1:].astype(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = np.zeros(n, np.int64)
    length[1:][same[1:]] = np.repeat(end - start, end - start)
    head = int(end[0]) if len(start) and start[0] == 0 else 0
    tail = int(n - 1 - start[-1]) if len(end) and end[-1] == n - 1 else 0
    return length, head, tail


_JUDGED = "ingest_seq bigint, symbol string, ts bigint, block bigint, impossible boolean, spike boolean, " + ", ".join(f"{k}_run bigint, {k}_at int" for k in RUNS)
_JUDGED += ", " + ", ".join(f"{k}_n bigint, {k}_head bigint, {k}_tail bigint, {k}_first double, {k}_last double" for k in RUNS)
#: Where in a block's runs a bar stands: its first known bar, in the run at its head, in the run at its tail, or none of these.
FIRST, HEAD, TAIL = 4, 1, 2


def _judge(pdf: pd.DataFrame, rules: SpikeRules) -> pd.DataFrame:
    """Flagged deliveries of one block of one series and those whose constant run may go on in another, and one row on the block's runs."""
    columns = [f.split(" ")[0] for f in _JUDGED.split(", ")]
    if not pdf["_own"].any():  # copies of a neighbour's edge, and nothing here
        return pd.DataFrame(columns=columns)
    order = np.lexsort((pdf["ingest_seq"].to_numpy(), pdf["ts"].to_numpy()))
    ts = pdf["ts"].to_numpy()[order]
    high, low, close, volume = (pdf[c].to_numpy(dtype=np.float64, na_value=np.nan)[order] for c in ("high", "low", "close", "volume"))
    own = pdf["_own"].to_numpy()[order]
    one = pdf.iloc[0]
    scale, step = float(one["_scale"]), int(one["_step"])
    with np.errstate(all="ignore"):
        h, lo, c = (np.log(np.where(v > 0, v, np.nan)) for v in (high, low, close))
        v = np.log(np.where(volume > 0, volume, np.nan)) - float(one["_logvol"])
        impossible = (high < low) | (close < low) | (close > high) | (high <= 0) | (low <= 0) | (close <= 0) | (volume < 0)
        for x in (h, lo, c, v):
            x[~np.isfinite(x)] = np.nan
        first = np.concatenate([[True], ts[1:] != ts[:-1]])  # the first delivery stands for the bar
        bar = np.cumsum(first) - 1
        rep = np.flatnonzero(first)
        rc, rv = c[rep], v[rep]
        level = _level(rc, rules.near)

        # profiles: rows are days (or as many bars as make 16 slots at least), columns slots
        slots = max(DAY_MS // max(step, 1), 16)
        cell = ts[rep] // max(step, 1)
        cell = cell - cell[0] // slots * slots
        _, row = np.unique(cell // slots, return_inverse=True)
        col = cell % slots
        m = np.full((4, row.max() + 1, slots), np.nan)
        for k, x in enumerate((rc - level, h[rep] - level, lo[rep] - level, rv)):
            m[k, row, col] = x
        normal, cut = decompose(m, rules.rounds, rules.false_spikes)
        normal = normal[:, row, col]
        quiet = rv - normal[3]
        normal = normal[:, bar]

        # the sparse part decides; what lies off both sides by half as much is gone again
        sides = [x[bar] for x in (*_side_medians(rc, rules.near), *_side_medians(quiet, rules.near))]
        spike = np.zeros(len(ts), bool)
        for k, x in enumerate((c, h, lo)):
            sparse = np.abs(x - level[bar] - normal[k]) > cut[k]
            off = (x - sides[0], x - sides[1])
            spike |= sparse & (off[0] * off[1] > 0) & (np.minimum(np.abs(off[0]), np.abs(off[1])) > cut[k] / 2)
        beside = np.fmax(sides[2], sides[3])
        loud = v - normal[3]
        spike |= (loud > cut[3]) & (loud - np.where(np.isfinite(beside), beside, 0.0) > cut[3] / 2)

        # constant runs of the block's own bars, on the first deliveries; a later delivery is stuck only if it tells the same
        mine = own[rep]
        raw = volume[rep]
        tol = rules.still * scale
        known = {"price": mine & np.isfinite(rc), "volume": mine & np.isfinite(raw), "silence": mine & np.isfinite(raw)}
        told = {"price": (rc, c, tol), "volume": (np.where(raw > 0, raw, np.nan), volume, 0.0), "silence": (np.where(raw == 0, raw, np.nan), volume, 0.0)}
        out: dict[str, np.ndarray] = {}
        edges: dict[str, list] = {}
        for k in RUNS:
            at = np.flatnonzero(known[k])
            x, each, slack = told[k]
            same = np.zeros(len(at), bool)
            same[1:] = np.abs(np.diff(x[at])) <= slack  # NaN: no
            length, head, tail = _runs(same)
            place = np.zeros(len(at), np.int64)
            if len(at):
                place[0] |= FIRST
                place[1 : 1 + head] |= HEAD
                place[len(at) - tail :] |= TAIL
            run_, at_ = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64)
            run_[at], at_[at] = length, place
            as_told = np.abs(each - x[bar]) <= slack
            out[f"{k}_run"], out[f"{k}_at"] = np.where(as_told, run_[bar], 0), np.where(as_told, at_[bar], 0)
            ends = (float(x[at[0]]), float(x[at[-1]])) if len(at) else (np.nan, np.nan)
            edges |= {f"{k}_n": [len(at)], f"{k}_head": [head], f"{k}_tail": [tail], f"{k}_first": [ends[0]], f"{k}_last": [ends[1]]}
    keep = own & (impossible | spike | np.any([(out[f"{k}_run"] >= rules.least_run) | (out[f"{k}_at"] > 0) for k in RUNS], axis=0))
    # one frame: the kept deliveries, then the row on the block's runs; whole numbers stay whole beside missing ones
    k = int(keep.sum())
    last = np.arange(k + 1) == k

    def of_rows(x: np.ndarray, kind: type) -> pd.api.extensions.ExtensionArray:
        return kind(np.append(x[keep], np.zeros(1, x.dtype)), last)

    def of_block(x: float, kind: type | None) -> pd.api.extensions.ExtensionArray | np.ndarray:
        return np.where(last, x, np.nan) if kind is None else kind(np.where(last, x, 0).astype(np.int64), ~last)

    whole, flag = pd.arrays.IntegerArray, pd.arrays.BooleanArray
    found = {"ingest_seq": of_rows(pdf["ingest_seq"].to_numpy(np.int64)[order], whole), "symbol": one["symbol"], "ts": of_rows(ts.astype(np.int64), whole), "block": one["_block"]}
    found |= {"impossible": of_rows(impossible, flag), "spike": of_rows(spike, flag)} | {n: of_rows(x.astype(np.int64), whole) for n, x in out.items()}
    found |= {n: of_block(x[0], None if n.endswith(("first", "last")) else whole) for n, x in edges.items()}
    return pd.DataFrame(found, columns=columns)


def _whole_runs(blocks: DataFrame, kind: str) -> DataFrame:
    """Per block: lengths of the constant runs at its head and tail, counted over all blocks they reach, and whether its first bar goes on.

    ``blocks`` has one row a block. A block that is one run, and goes on from the one before, adds to it; any other starts anew.
    """
    col = lambda name: F.col(f"{kind}_{name}")
    of = Window.partitionBy("symbol").orderBy("block")
    tol = F.col("_tol") if kind == "price" else F.lit(0.0)
    some = blocks.filter(col("n") > 0).select("symbol", "block", col("n").alias("n"), col("head").alias("head"), col("tail").alias("tail"), F.nanvl(col("first"), F.lit(None)).alias("first"), F.nanvl(col("last"), F.lit(None)).alias("last"), tol.alias("tol"))
    linked = some.withColumn("goes_on", F.coalesce(F.abs(F.col("first") - F.lag("last").over(of)) <= F.col("tol"), F.lit(False)))
    through = F.col("goes_on") & (F.col("head") == F.col("n") - 1)
    chained = linked.withColumns({"_new": F.when(through, 0).otherwise(1), "_adds": F.when(through, F.col("n")).otherwise(F.col("tail"))})
    chained = chained.withColumns({"_chain": F.sum("_new").over(of.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.when(F.lead("goes_on").over(of) & (F.lead("_new").over(of) == 1), F.lead("head").over(of) + 1).otherwise(0)})
    chain = Window.partitionBy("symbol", "_chain")
    whole = chained.withColumn("_total", F.sum(F.col("_adds") + F.col("_next")).over(chain))
    head = F.when(~F.col("goes_on"), F.col("head")).when(F.col("_new") == 0, F.col("_total")).otherwise(F.lag("_total").over(of))
    return whole.select("symbol", "block", F.col("goes_on").alias(f"{kind}_goes_on"), head.alias(f"{kind}_from"), F.col("_total").alias(f"{kind}_to"))


def _needed(rules: SpikeRules, share: Column, n: Column) -> Column:
    """Length that ordinary stretches of bars of this share reach ``false_runs`` times in a series of ``n`` bars."""
    p = F.least(F.greatest(share, F.lit(1e-6)), F.lit(0.9999))
    return F.greatest(F.lit(float(rules.least_run)), F.ln(F.greatest(n * (1 - share), F.lit(1.0)) / rules.false_runs) / -F.ln(p))


def flag_implausible(feed: DataFrame, steps: DataFrame | None = None, rules: SpikeRules = SpikeRules()) -> DataFrame:
    """Rows of ``feed`` (ingest_seq, symbol, ts, open, high, low, close, volume) that cannot be true or do not fit their series.

    Returns (ingest_seq, symbol, ts, impossible, spike, stuck), one row a flagged delivery. Every
    delivery is judged by its own values; the first delivery of a bar stands for the bar where
    others are compared with it, ties broken by ingest_seq (a NULL one first). NULL and NaN readings are never flagged,
    are left out of all scales, and do not end a stuck stretch; a row without ts is judged for impossible values only. A NULL
    symbol is a series of its own. Exact copies of a row are judged alike, and each is returned. An empty
    feed gives no rows; columns besides those named are ignored.

    A series is cut into blocks, each with ``edge_bars`` of its neighbours, so that no task holds a whole series; scales are the
    whole series'. Constant runs are found in each block's own bars and joined through one row a block, so that a
    stretch of any length is found whole wherever blocks meet and however long a gap is.
    """
    columns = ["ingest_seq", "symbol", "ts", "high", "low", "close", "volume"]
    scales = with_step(series_scales(feed), steps)
    scale = F.greatest(F.coalesce("_scale", F.lit(1e-6)), F.lit(1e-9))
    n, still, silent = F.col("_n"), F.coalesce("_still", F.lit(0.0)), F.coalesce("_silent", F.lit(0.0))
    per_series = materialise(  # one row a series
        scales.select("symbol", scale.alias("_scale"), F.coalesce("_logvol", F.lit(0.0)).alias("_logvol"), "_step", (scale * rules.still).alias("_tol"), _needed(rules, still, n).alias("_need_price"), _needed(rules, silent, n).alias("_need_silence"))
    )
    n_series = per_series.count()
    unnamed = F.lit(-(2**63)).cast("bigint")  # stands for a NULL id, so that ids stay whole numbers in Python
    timed = feed.filter(F.col("ts").isNotNull()).select(F.coalesce("ingest_seq", unnamed).alias("ingest_seq"), *columns[1:])
    rows = sized_join(timed, per_series.select("symbol", "_scale", "_logvol", "_step"), "symbol", "ts", n_series)
    span = F.col("_step") * F.greatest(F.lit(rules.block_bars), F.ceil(F.lit(rules.block_days * DAY_MS) / F.col("_step")))
    edge = F.col("_step") * rules.edge_bars
    block = F.floor(F.col("ts") / span).cast("bigint")
    inside = F.pmod(F.col("ts"), span)
    places = F.array_compact(
        F.array(
            F.struct(block.alias("b"), F.lit(True).alias("own")),
            F.when(inside < edge, F.struct((block - 1).alias("b"), F.lit(False).alias("own"))),
            F.when(inside >= span - edge, F.struct((block + 1).alias("b"), F.lit(False).alias("own"))),
        )
    )
    placed = rows.withColumn("_place", F.explode(places)).select(*columns, "_scale", "_logvol", "_step", F.col("_place.b").alias("_block"), F.col("_place.own").alias("_own"))
    judged = materialise(placed.groupBy("symbol", "_block").applyInPandas(lambda pdf: _judge(pdf, rules), _JUDGED))

    # runs over all blocks: one row a block
    blocks = judged.filter("price_n IS NOT NULL")
    n_blocks = blocks.count()
    blocks = sized_join(blocks, per_series.select("symbol", "_tol"), "symbol", "block", n_series)
    hits = judged.filter("price_n IS NULL").select("ingest_seq", "symbol", "ts", "block", "impossible", "spike", *[f"{k}_{x}" for k in RUNS for x in ("run", "at")])
    hits = sized_join(hits, per_series.select("symbol", "_need_price", "_need_silence"), "symbol", "ts", n_series)
    needed = {"price": F.col("_need_price"), "volume": F.lit(float(rules.least_run)), "silence": F.col("_need_silence")}
    stuck = F.lit(False)
    for k in RUNS:
        hits = sized_join(hits, _whole_runs(blocks, k), ["symbol", "block"], "ts", n_blocks, salts=4, how="left")
        at, need = F.col(f"{k}_at"), needed[k]
        bit = lambda b: at.bitwiseAND(F.lit(b)) > 0  # noqa: E731, B023
        here = F.col(f"{k}_run") >= need
        head = (bit(HEAD) | bit(FIRST) & F.col(f"{k}_goes_on")) & (F.col(f"{k}_from") >= need)
        tail = bit(TAIL) & (F.col(f"{k}_to") >= need)
        stuck = stuck | here | F.coalesce(head, F.lit(False)) | F.coalesce(tail, F.lit(False))
    found = hits.select(F.nullif("ingest_seq", unnamed).alias("ingest_seq"), "symbol", "ts", "impossible", "spike", stuck.alias("stuck")).filter("impossible OR spike OR stuck")
    no_time = feed.filter(F.col("ts").isNull()).select(
        "ingest_seq",
        "symbol",
        F.col("ts").cast("bigint").alias("ts"),
        F.coalesce(impossible_reading(), F.lit(False)).alias("impossible"),
        F.lit(False).alias("spike"),
        F.lit(False).alias("stuck"),
    )
    return found.unionByName(no_time.filter("impossible"))


def impossible_reading():
    """Predicate on one bar's own readings; NULL readings say nothing."""
    h, lo, c, v = F.col("high"), F.col("low"), F.col("close"), F.col("volume")
    tests = [h < lo, c < lo, c > h, h <= 0, lo <= 0, c <= 0, v < 0]
    hit = F.lit(False)
    for t in tests:
        hit = hit | F.coalesce(t, F.lit(False))
    return hit
