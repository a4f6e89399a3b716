"""The published horizon and embargo are exercised by a registered query."""

from candlewright.plans import reference_queries as rq
from candlewright.plans.pipeline import Pipeline


def test_split_counts(spark, make_walk, tmp_path):
    make_walk(3000).to_parquet(tmp_path / "klines.parquet")
    p = rq.published(Pipeline(spark, str(tmp_path)))
    assert (p.s.horizon, p.s.gap) == (24, 164)
    n, a, b = 3000, 2100, 2550
    want = {}
    for r in p.events("zone_start").collect():
        pos = r.decision_pos
        if pos + 24 < n:
            split = "train" if pos < a else "val" if a + 164 <= pos < b else "test" if pos >= b + 164 else "dropped_gap"
            want[r["quantile"], split] = want.get((r["quantile"], split), 0) + 1
    got = {(r["quantile"], r["split"]): r.n for r in rq.QUERIES["spl_2_published_counts"](spark, str(tmp_path)).collect()}
    assert {s for _, s in want} == {"train", "val", "test", "dropped_gap"}
    assert got == want
