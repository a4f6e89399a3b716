import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from candlewright.session import local_session

    session = local_session("tests", cores=4, partitions=4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


def walk(n=400, seed=7, symbol="A", step_ms=900_000):
    """Bars of a mean-reverting log price with bursts of activity, on a 15-minute grid."""
    rng = np.random.default_rng([seed, n])
    busy = np.exp(0.5 * np.sin(np.arange(n + 1) / 17) + rng.standard_t(6, n + 1) / 6)
    level = np.zeros(n + 1)
    for i in range(1, n + 1):
        level[i] = 0.995 * level[i - 1] + 0.003 * busy[i] * rng.standard_normal()
    price = 40 * np.exp(level)
    before, after = price[:-1], price[1:]
    reach = 0.001 * busy[1:] * before
    up, down = rng.gamma(2.0, 1.0, (2, n)) * reach
    return pd.DataFrame(
        {
            "symbol": symbol,
            "ts": 1_706_745_600_000 + np.arange(n) * step_ms,
            "open": before,
            "high": np.fmax(before, after) + up,
            "low": np.fmin(before, after) - down,
            "close": after,
            "volume": np.round(300 * busy[1:], 3),
            "ingest_seq": np.arange(n),
        }
    )


@pytest.fixture(scope="session")
def make_walk():
    return walk
