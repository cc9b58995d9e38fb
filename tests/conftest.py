import datetime as dt
import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairsignals import schemas  # noqa: E402
from pairsignals.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=8, app="pairsignals-tests")
    yield s
    s.stop()


def make_bars(spark, series: dict[str, list[float]], volume=100.0, start=dt.date(2001, 1, 1)):
    """Bars from close lists given oldest first; one bar per calendar day."""
    rows = []
    for ticker, closes in series.items():
        for k, c in enumerate(closes):
            v = volume(ticker, k) if callable(volume) else volume
            c = float(c)
            rows.append((ticker, start + dt.timedelta(days=k), c, c, c, c, float(v)))
    return spark.createDataFrame(rows, schemas.BARS)


def random_series(rng, n, kind="noise"):
    if kind == "noise":
        return list(1000 + rng.normal(0, 10, n))
    return list(1000 + np.cumsum(rng.normal(0, 10, n)))
