"""Fixed-capacity containers filled with whole texts: pattern packing by non-negative least squares."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.llm.tokens import VOCABULARY, token_counter
from candlewright.session import materialise


#: Rows a plan may have. It has as many as patterns are committed, which the capacity bounds: some 7,000 at 2,048 tokens and 10^9 texts.
MOST_SLOTS = 1_000_000


@dataclass(frozen=True)
class Slot:
    """Pieces of ``length`` with ranks [start, end) go, ``each`` a container, to containers from ``container`` on."""

    length: int
    start: int
    end: int
    container: int
    each: int


def candidate_patterns(lengths: np.ndarray, capacity: int, partners: int = 6) -> list[dict[int, int]]:
    """Fillings of one container with copies of at most three lengths, found from each length in turn.

    For a leading length taken once, as often as fits, and half as often: the rest is filled by one
    length that fits it exactly, or by a partner length and the one that best fills what is then left.
    """
    present = set(lengths.tolist())
    at_most = np.zeros(capacity + 1, np.int64)  # greatest length present that is no longer than the index
    at_most[lengths] = lengths
    at_most = np.maximum.accumulate(at_most)
    found: dict[tuple, dict[int, int]] = {}

    def add(*pairs: tuple[int, int]) -> None:
        pattern: dict[int, int] = {}
        for length, times in pairs:
            if length and times:
                pattern[length] = pattern.get(length, 0) + times
        found.setdefault(tuple(sorted(pattern.items())), pattern)

    spread = lengths[np.unique(np.linspace(0, len(lengths) - 1, partners).astype(int))] if len(lengths) else lengths
    for a in lengths.tolist():
        most = capacity // a
        for m in sorted({1, max(1, most // 2), most}):
            rest = capacity - m * a
            if rest == 0 or rest in present:
                add((a, m), (rest, 1))
                continue
            best = int(at_most[rest])
            add((a, m), (best, rest // best if best else 0))
            for b in spread.tolist():
                if b <= rest:
                    for k in {1, rest // b}:
                        c = int(at_most[rest - k * b])
                        add((a, m), (b, k), (c, 1 if c else 0))
    return list(found.values())


def fit_repeats(patterns: list[dict[int, int]], histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts x that minimise ||A x - histogram||, by multiplicative updates.

    A is sparse (at most three entries a pattern) and non-negative, so x stays so.
    """
    col = np.concatenate([np.full(len(p), j) for j, p in enumerate(patterns)])
    row = np.concatenate([np.fromiter(p.keys(), np.int64) for p in patterns])
    val = np.concatenate([np.fromiter(p.values(), np.float64) for p in patterns])
    target = np.bincount(col, val * histogram[row], len(patterns))
    x = np.full(len(patterns), max(histogram.sum() / max(len(patterns), 1), 1e-9))
    for _ in range(rounds):
        ax = np.bincount(row, val * x[col], len(histogram))
        x *= target / np.maximum(np.bincount(col, val * ax[row], len(patterns)), 1e-12)
    return x


def plan_containers(histogram: np.ndarray, capacity: int) -> tuple[list[Slot], int]:
    """Slots for all pieces of a length histogram (index = length, 0 unused), and the number of containers.

    Fitted repeat counts are rounded and committed as far as pieces are left, larger fits first. What
    remains is packed by patterns built from the longest remaining length down, each repeated as
    often as the remaining counts allow, so that every one uses up a length. Work and result depend
    on ``capacity`` and the lengths that occur, not on the number of pieces.
    """
    left = histogram.astype(np.int64).copy()
    slots: list[Slot] = []
    ranks = np.zeros(len(left), np.int64)
    used = 0

    def commit(pattern: dict[int, int], repeats: int) -> None:
        nonlocal used
        for length, each in pattern.items():
            n = repeats * each
            slots.append(Slot(length, int(ranks[length]), int(ranks[length] + n), used, each))
            ranks[length] += n
            left[length] -= n
        used += repeats

    lengths = np.flatnonzero(left)
    if len(lengths):
        patterns = candidate_patterns(lengths, capacity)
        fit = np.round(fit_repeats(patterns, left.astype(np.float64)))
        filled = np.array([sum(k * v for k, v in p.items()) for p in patterns])
        for j in np.lexsort((-fit, -filled)):
            if fit[j] < 1 or filled[j] < capacity * 0.99:
                continue
            repeats = min(int(fit[j]), *(int(left[k]) // v for k, v in patterns[j].items()))
            if repeats > 0:
                commit(patterns[j], repeats)
    while left.any():
        room, pattern = capacity, {}
        free = np.flatnonzero(left)
        while room > 0 and len(free):
            k = int(np.searchsorted(free, room, side="right")) - 1
            if k < 0:
                break
            length = int(free[k])
            take = min(room // length, int(left[length]) - pattern.get(length, 0))
            if take > 0:
                pattern[length] = pattern.get(length, 0) + take
                room -= take * length
            free = free[:k]
        commit(pattern, min(int(left[k]) // v for k, v in pattern.items()))
    return slots, used


def pieces_of(sized: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, token_from, tokens): a text that fits is one piece, a longer one is cut every ``capacity`` tokens."""
    last = F.greatest(F.ceil(F.col("tokens") / capacity) - 1, F.lit(0))
    return sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select(
        "doc_id",
        "piece",
        (F.col("piece") * capacity).alias("token_from"),
        F.least(F.col("tokens") - F.col("piece") * capacity, F.lit(capacity).cast("bigint")).alias("tokens"),
    )


def pack(documents: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY, salts: int = 256) -> DataFrame:
    """The container of each document or piece: (doc_id, piece, token_from, tokens, container).

    Only texts of more than ``capacity`` tokens are cut. NULL and empty texts have no tokens, take no
    room and get a NULL container. Repeated rows are packed each; an empty table gives no rows; columns
    besides doc_id and text are ignored.

    Texts are read and tokenized once; (doc_id, tokens) is written to the checkpoint folder.
    The driver sees the histogram of lengths (at most ``capacity`` numbers) and returns the plan, whose
    size ``capacity`` bounds too. Pieces of one length are numbered by salts of the id's hash, so that a
    length may hold any part of the rows.
    """
    spark = documents.sparkSession
    tokens = token_counter(spark, vocabulary)
    sized = materialise(documents.select("doc_id", tokens(F.col("text")).alias("tokens")))
    pieces = pieces_of(sized, capacity).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    solid = pieces.filter(F.col("tokens") > 0)
    counts = solid.groupBy("tokens", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("tokens").agg(F.sum("_n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[r["tokens"]] = r["n"]
    slots, _ = plan_containers(histogram, capacity)
    if len(slots) > MOST_SLOTS:
        raise ValueError(f"a plan of {len(slots)} slots is too large to broadcast")
    schema = "_length bigint, _start bigint, _end bigint, _base bigint, _each bigint"
    plan = spark.createDataFrame([(s.length, s.start, s.end, s.container, s.each) for s in slots], schema)

    offsets = counts.select("tokens", "_salt", F.coalesce(F.sum("_n").over(Window.partitionBy("tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    numbered = solid.withColumn("_within", F.row_number().over(Window.partitionBy("tokens", "_salt").orderBy("doc_id", "piece")) - 1)
    ranked = numbered.join(offsets, ["tokens", "_salt"]).withColumn("_rank", F.col("_offset") + F.col("_within"))
    here = (F.col("tokens") == F.col("_length")) & (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_end"))
    placed = ranked.join(F.broadcast(plan), here).select(  # the plan's size is bounded by the capacity
        "doc_id", "piece", "token_from", "tokens", (F.col("_base") + F.floor((F.col("_rank") - F.col("_start")) / F.col("_each"))).alias("container")
    )
    void = pieces.filter(F.col("tokens") <= 0).select("doc_id", "piece", "token_from", "tokens", F.lit(None).cast("bigint").alias("container"))
    return placed.unionByName(void)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, pieces, tokens, fill (share of the room used; NULL without containers)."""
    per = packed.filter(F.col("container").isNotNull()).groupBy("container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    n = F.count(F.lit(1))
    return per.agg(
        n.alias("containers"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.coalesce(F.max("t"), F.lit(0)).alias("fullest"),
        F.try_divide(F.sum("t").cast("double"), n * capacity).alias("fill"),
    )
