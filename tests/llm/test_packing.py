"""Packing: every piece once, nothing overfull, little unused; and token counts."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candlewright.llm import packing, tokens


def filled(slots):
    room = {}
    for s in slots:
        for rank in range(s.start, s.end):
            c = s.container + (rank - s.start) // s.each
            room[c] = room.get(c, 0) + s.length
    return room


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plans_pack_every_piece_once(hist):
    h = np.zeros(65, np.int64)
    for k, v in hist.items():
        h[k] = v
    slots, used = packing.plan_containers(h, 64)
    for k in range(1, 65):
        spans = sorted((s.start, s.end) for s in slots if s.length == k)
        assert [a for a, _ in spans] == [0, *[b for _, b in spans]][: len(spans)] and (spans[-1][1] if spans else 0) == h[k]
    room = filled(slots)
    assert len(room) == used and all(v <= 64 for v in room.values())
    assert used <= 2 * -(-int((h * np.arange(65)).sum()) // 64) + 1


def test_fill_on_many_lengths():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(5, 1, 20_000).astype(int), 1, 2048)
    h = np.bincount(lengths, minlength=2049)
    slots, used = packing.plan_containers(h, 2048)
    assert lengths.sum() / (used * 2048) > 0.995 and len(slots) < 60_000
    many, used_many = packing.plan_containers(h * 1000, 2048)
    assert len(many) < 60_000 and abs(used_many / used - 1000) < 10


def test_fitted_repeats_solve_an_exact_case():
    x = packing.fit_repeats([{10: 1, 6: 1}, {8: 2}], np.array([0] * 6 + [5, 0, 8, 0, 5.0]), 2000)
    np.testing.assert_allclose(x, [5, 4], rtol=1e-3)


SCHEMA = "doc_id bigint, text string, tokens string, container int, piece double"


def test_documents(spark):
    word = "alpha beta gamma "
    rows = [(i, word * (1 + i * 7 % 120), "clash", 1, 1.0) for i in range(300)] + [(900, word * 4000, "", 1, 1.0), (901, None, "", 1, 1.0), (902, "", "", 1, 1.0), (903, word, "", 1, 1.0), (903, word, "", 1, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack(df, 512, salts=3).toPandas()
    sizes = df.select("doc_id", tokens.token_counter(spark)(df.text).alias("t")).toPandas()
    assert got.groupby("doc_id").tokens.sum().sort_index().to_dict() == sizes.groupby("doc_id").t.sum().sort_index().to_dict()
    assert got[got.doc_id.isin([901, 902])].container.isna().all() and got[~got.doc_id.isin([901, 902])].container.notna().all()
    assert got.groupby("container").tokens.sum().max() <= 512
    whole = got[got.doc_id < 900]
    assert (whole.groupby("doc_id").size() == np.maximum(1, -(-sizes[sizes.doc_id < 900].set_index("doc_id").t // 512))).all()
    long = got[got.doc_id == 900].sort_values("piece")
    assert (long.token_from.to_numpy() == np.arange(len(long)) * 512).all() and (long.tokens[:-1] == 512).all()
    assert len(got[got.doc_id == 903]) == 2
    report = packing.fill_report(packing.pack(df, 512), 512).first()
    assert report["fill"] > 0.97 and report["fullest"] <= 512
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    assert packing.fill_report(packing.pack(spark.createDataFrame([], SCHEMA))).first()["containers"] == 0


def test_tokens_are_those_of_the_vocabulary(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = ["Hello, it's 3 o'clock!\n\n  ok", "", None, "x" * 200_000, "naïve Straße 你好 <|endoftext|>", "a\r\n\tb   "]
    want = [len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in texts]
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(texts)), "text": texts}))
    got = df.select("i", tokens.token_counter(spark)(df.text).alias("n")).orderBy("i").toPandas().n.tolist()
    assert got == want
