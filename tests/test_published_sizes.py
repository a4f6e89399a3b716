"""Model and review queries run at the published sizes."""

import inspect
from types import SimpleNamespace

import pytest

from candlewright.operators import evaluate as ev
from candlewright.operators import model
from candlewright.plans import reference_queries as rq


class Seen(Exception):
    pass


def recorder(f):
    def call(*args, **kwargs):
        bound = inspect.signature(f).bind(*args, **kwargs)
        bound.apply_defaults()
        raise Seen(bound.arguments)

    return call


class Rows:
    def filter(self, _):
        return self


@pytest.fixture
def p(monkeypatch):
    monkeypatch.setattr(rq, "Pipeline", lambda spark, sf_dir, features=False: SimpleNamespace(s=SimpleNamespace(seed=42), scored=Rows(), spark=None))
    monkeypatch.setattr(rq, "_dataset", lambda p: Rows())
    return monkeypatch


def settings(name):
    with pytest.raises(Seen) as seen:
        rq.QUERIES[name](None, "")
    return seen.value.args[0]


@pytest.mark.parametrize("name", ["ml_1_3_scores", "ml_5_importance", "ml_6_evaluation", "smp_2_permutation"])
def test_training(p, name):
    p.setattr(model, "train", recorder(model.train))
    got = settings(name)
    assert (got["rounds"], got["patience"], got["depth"], got["step"], got["seed"]) == (300, 50, 5, 0.03, 42)


def test_permutation(p):
    p.setattr(model, "train", lambda *a, **k: (None, {}))
    p.setattr(model, "permutation_importance", recorder(model.permutation_importance))
    assert settings("smp_2_permutation")["repeats"] == 5


@pytest.mark.parametrize("name", ["prj_10_titles", "sort_3_published_sets"])
def test_review_sets(p, name):
    p.setattr(ev, "review_sets", recorder(ev.review_sets))
    got = settings(name)
    assert (got["top"], got["middle"], got["bottom"]) == (50, 50, 50)
