"""Pair statistics against the literal numpy model, both physical forms."""

import math

import numpy as np
import pytest

from conftest import make_bars, random_series
from pairsignals.config import AnalysisConfig
from pairsignals.plans.analysis import pair_verdicts
from pair_model import pair as model_pair

N_BARS = 40


def _fixture(spark, seed=7, kinds=("noise", "walk", "noise", "walk", "noise")):
    rng = np.random.default_rng(seed)
    series = {f"T{k}": random_series(rng, N_BARS, kind) for k, kind in enumerate(kinds)}
    return series, make_bars(spark, series)


def _rows(df):
    return {(r["stock_a"], r["stock_b"]): r.asDict() for r in df.collect()}


@pytest.mark.parametrize("method", ["wide", "two_pass"])
@pytest.mark.parametrize("spread", ["cross", "aligned"])
def test_matches_literal_model(spark, method, spread):
    series, bars = _fixture(spark)
    cfg = AnalysisConfig(min_days=30, min_mean_volume=0.0, ndays=20, z_thresh=0.5, spread=spread,
                         pair_blocks=2)
    got = _rows(pair_verdicts(bars, cfg, method=method))
    tickers = sorted(series)
    assert len(got) == len(tickers) * (len(tickers) - 1)
    for a in tickers:
        for b in tickers:
            if a == b:
                assert (a, b) not in got
                continue
            wa = np.array(series[a][::-1][:20])  # newest first, trimmed window
            wb = np.array(series[b][::-1][:20])
            want = model_pair(wa, wb, z_thresh=0.5, spread=spread)
            row = got[(a, b)]
            for k in ("alpha", "beta", "adf_t", "crit_value", "signal_sd", "z_score"):
                assert math.isclose(row[k], want[k], rel_tol=1e-9, abs_tol=1e-9), (a, b, k, row[k], want[k])
            assert abs(row["signal_mean"] - want["signal_mean"]) < 1e-8
            assert row["verdict"] == want["verdict"]
            assert row["close_a"] == pytest.approx(series[a][-1])
            assert row["n_obs"] == 20


def test_one_pass_equals_two_pass_with_offset(spark):
    _, bars = _fixture(spark, seed=11)
    cfg = AnalysisConfig(min_days=25, min_mean_volume=0.0, ndays=30, begin_day=3, pair_blocks=3)
    w = _rows(pair_verdicts(bars, cfg, method="wide"))
    t = _rows(pair_verdicts(bars, cfg, method="two_pass"))
    assert w.keys() == t.keys()
    for k in w:
        for c in ("alpha", "beta", "adf_t", "z_score", "signal_sd"):
            assert math.isclose(w[k][c], t[k][c], rel_tol=1e-9, abs_tol=1e-9)
        assert w[k]["n_obs"] == 22  # min(ndays, min_days) - begin_day
        assert w[k]["date"] == t[k]["date"]


def test_forward_order_differs_and_matches(spark):
    series, bars = _fixture(spark, seed=5)
    cfg = AnalysisConfig(min_days=30, min_mean_volume=0.0, ndays=20, forward=True, pair_blocks=2)
    w = _rows(pair_verdicts(bars, cfg, method="wide"))
    t = _rows(pair_verdicts(bars, cfg, method="two_pass"))
    for k in w:
        assert math.isclose(w[k]["adf_t"], t[k]["adf_t"], rel_tol=1e-9)
    a, b = "T0", "T1"
    wa = np.array(series[a][-20:])  # oldest first
    wb = np.array(series[b][-20:])
    assert math.isclose(w[(a, b)]["adf_t"], model_pair(wa, wb)["adf_t"], rel_tol=1e-9)


def test_window_of_four_is_smallest_with_t(spark):
    _, bars = _fixture(spark)
    four = _rows(pair_verdicts(bars, AnalysisConfig(min_days=30, min_mean_volume=0, ndays=4)))
    assert all(r["adf_t"] is not None for r in four.values())
    for n in (1, 2, 3):  # no t is defined: refused when the query is built
        with pytest.raises(ValueError):
            pair_verdicts(bars, AnalysisConfig(min_days=30, min_mean_volume=0, ndays=n))


def test_exact_linear_pair_does_not_fail(spark):
    rng = np.random.default_rng(1)
    a = random_series(rng, N_BARS, "walk")
    bars = make_bars(spark, {"A": a, "B": [2 * x + 3 for x in a], "C": random_series(rng, N_BARS)})
    rows = _rows(pair_verdicts(bars, AnalysisConfig(min_days=30, min_mean_volume=0, ndays=20)))
    assert math.isclose(rows[("B", "A")]["beta"], 2.0, rel_tol=1e-9)
    assert len(rows) == 6


FORMS = [("rank", "wide"), ("rank", "two_pass"), ("date", "auto"), ("date", "moments"), ("date", "two_pass")]


@pytest.mark.parametrize("align,method", FORMS)
def test_constant_series_are_never_cointegrated(spark, align, method):
    """Also at prices whose mean over a window is not exact in binary."""
    rng = np.random.default_rng(2)
    fixed = {"K0": 50.0, "K1": 0.1, "K2": 10.1, "K3": 7.77, "K4": 4.35, "K5": 33.3}
    bars = make_bars(spark, {k: [v] * N_BARS for k, v in fixed.items()}
                     | {f"X{i}": random_series(rng, N_BARS) for i in range(3)})
    cfg = AnalysisConfig(min_days=30, min_mean_volume=0, ndays=27, align=align, min_overlap=10, z_thresh=0.0)
    rows = _rows(pair_verdicts(bars, cfg, method=method))
    assert len(rows) == 9 * 8
    for (a, b), row in rows.items():
        if b in fixed:
            assert row["beta"] is None and row["adf_t"] is None
        elif a in fixed:
            assert row["beta"] == 0.0 and row["adf_t"] is None and row["z_score"] is None
        if a in fixed or b in fixed:
            assert row["verdict"] == "not_cointegrated"


@pytest.mark.parametrize("spread", ["cross", "aligned"])
@pytest.mark.parametrize("forward", [False, True])
def test_kernel_filter_keeps_every_tradeable_pair(spark, spread, forward):
    from pairsignals.plans.analysis import tradeable_pairs
    rng = np.random.default_rng(21)
    bars = make_bars(spark, {f"T{k}": random_series(rng, N_BARS, "noise" if k % 3 else "walk") for k in range(14)}
                     | {"K": [10.1] * N_BARS})
    for z in (0.0, 0.5, 1.5):
        cfg = AnalysisConfig(min_days=30, min_mean_volume=0.0, ndays=30, z_thresh=z, spread=spread, forward=forward,
                             pair_blocks=3)
        want = {k: v for k, v in _rows(pair_verdicts(bars, cfg)).items() if v["verdict"] == "tradeable"}
        assert _rows(tradeable_pairs(bars, cfg)) == want
        assert want or z > 1


def test_kernel_holds_a_bounded_number_of_pairs(monkeypatch):
    """A large block pair comes out in frames of bounded size, each pair once."""
    import pandas as pd
    from pairsignals.operators import kernels
    monkeypatch.setattr(kernels, "PAIRS_AT_ONCE", 500)
    n = 120
    rows = [{"_ga": 0, "_gb": 0, "_side": side, "ticker": f"T{k:03}", "mean": 0.0, "date0": None, "close0": 1.0, "q": 1.0,
             "l": 0.0, "c_first": 0.0, "c_last": 0.0, "c": np.array([k, 1.0, -1.0])} for side in (0, 1) for k in range(n)]
    frames = list(kernels.block_products()(iter([pd.DataFrame(rows)])))
    assert max(map(len, frames)) <= 500
    out = pd.concat(frames)
    assert len(out) == n * (n - 1) // 2 and (out["a_ticker"] < out["b_ticker"]).all()
    assert not out.duplicated(["a_ticker", "b_ticker"]).any()


def test_nan_close_gives_not_cointegrated(spark):
    rng = np.random.default_rng(3)
    x = random_series(rng, N_BARS)
    x[-2] = float("nan")
    bars = make_bars(spark, {"N": x, "P": random_series(rng, N_BARS), "Q": random_series(rng, N_BARS)})
    rows = _rows(pair_verdicts(bars, AnalysisConfig(min_days=30, min_mean_volume=0, ndays=20)))
    for k, r in rows.items():
        if "N" in k:
            assert r["verdict"] == "not_cointegrated"
    assert rows[("P", "Q")]["verdict"] != "not_cointegrated" or rows[("P", "Q")]["adf_t"] is not None


def test_properties(spark):
    _, bars = _fixture(spark, seed=21)
    base = AnalysisConfig(min_days=30, min_mean_volume=0.0, ndays=20, z_thresh=0.0)
    cross = _rows(pair_verdicts(bars, base))
    aligned = _rows(pair_verdicts(bars, base.with_(spread="aligned")))
    for k in cross:
        assert aligned[k]["signal_sd"] <= cross[k]["signal_sd"] + 1e-9
        assert (k[1], k[0]) in cross
    counts = []
    for z in (0.0, 0.5, 1.0, 2.0):
        rows = _rows(pair_verdicts(bars, base.with_(z_thresh=z)))
        counts.append(sum(r["verdict"] == "tradeable" for r in rows.values()))
    assert counts == sorted(counts, reverse=True)


def test_shift_invariance(spark):
    series, bars = _fixture(spark, seed=9)
    shifted = make_bars(spark, {k: [x + 500.0 for x in v] for k, v in series.items()})
    cfg = AnalysisConfig(min_days=30, min_mean_volume=0.0, ndays=20)
    a, b = _rows(pair_verdicts(bars, cfg)), _rows(pair_verdicts(shifted, cfg))
    for k in a:
        assert math.isclose(a[k]["z_score"], b[k]["z_score"], rel_tol=1e-7, abs_tol=1e-9)
        assert math.isclose(a[k]["beta"], b[k]["beta"], rel_tol=1e-7, abs_tol=1e-9)


@pytest.mark.parametrize("method", ["auto", "moments"])
def test_date_alignment_one_pass_equals_two_pass(spark, method):
    rng = np.random.default_rng(4)
    from conftest import make_bars as mk
    # three tickers on partly different calendars
    series = {f"D{k}": random_series(rng, N_BARS, "walk") for k in range(4)}
    bars = mk(spark, series)
    # drop some dates of D1 and D2 so that pairs share different subsets
    from pyspark.sql import functions as F
    bars = bars.where(~((F.col("ticker") == "D1") & (F.dayofmonth("date") % 3 == 0)))
    bars = bars.where(~((F.col("ticker") == "D2") & (F.dayofmonth("date") % 4 == 1)))
    cfg = AnalysisConfig(min_days=20, min_mean_volume=0.0, ndays=25, align="date", min_overlap=8,
                         pair_blocks=2)
    one = _rows(pair_verdicts(bars, cfg, method=method))
    two = _rows(pair_verdicts(bars, cfg, method="two_pass"))
    assert one.keys() == two.keys() and len(one) == 12
    for k in one:
        assert one[k]["n_obs"] == two[k]["n_obs"]
        assert one[k]["date"] == two[k]["date"]
        for c in ("alpha", "beta", "adf_t", "z_score", "signal_sd"):
            assert math.isclose(one[k][c], two[k][c], rel_tol=1e-9, abs_tol=1e-9), (k, c)


@pytest.mark.parametrize("diagonal", [True, False])
def test_date_block_kernel_chunks_agree(monkeypatch, diagonal):
    """The date kernel gives the same sums whatever the chunk of left tickers,
    and pairs without a shared date give no row."""
    import pandas as pd
    from pairsignals.operators import kernels
    rng = np.random.default_rng(5)
    rows = []
    for side in (0, 1):
        names = [f"T{k}" for k in range(6)] if diagonal else [f"{'L' if side == 0 else 'R'}{k}" for k in range(6)]
        for k, t in enumerate(names):
            days = range(100, 130) if k < 5 else range(500, 520)  # the last ticker shares no date
            for d in days:
                if (d + k) % (k + 2) == 0:
                    continue
                x = float(rng.normal())
                rows.append((0, 0 if diagonal else 1, side, t, d, x, x + 7.0, 7.0))
    pdf = pd.DataFrame(rows, columns=["_ga", "_gb", "_side", "ticker", "day", "x", "v", "mu"])

    def sums(pdf):  # the group may come in several batches
        return pd.concat(list(kernels.date_block_sums(iter([pdf.iloc[:50], pdf.iloc[50:]]))))

    whole = sums(pdf).sort_values(["a_ticker", "b_ticker"]).reset_index(drop=True)
    monkeypatch.setattr(kernels, "DATE_CHUNK_ROWS", 1)
    chunked = sums(pdf).sort_values(["a_ticker", "b_ticker"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, chunked)
    # the sixth ticker shares dates only with the sixth of the other side
    # (itself in a diagonal block, which is no pair)
    n_pairs = 10 if diagonal else 5 * 5 + 1
    assert len(whole) == n_pairs
    if diagonal:
        assert (whole["a_ticker"] < whole["b_ticker"]).all()
    # brute force for one pair
    a, b = whole.iloc[0]["a_ticker"], whole.iloc[0]["b_ticker"]
    la = pdf[(pdf["_side"] == 0) & (pdf["ticker"] == a)].set_index("day")["x"]
    rb = pdf[(pdf["_side"] == 1) & (pdf["ticker"] == b)].set_index("day")["x"]
    shared = sorted(set(la.index) & set(rb.index), reverse=True)
    xa, xb = la.loc[shared].to_numpy(), rb.loc[shared].to_numpy()
    r = whole.iloc[0]
    assert r["n_obs"] == len(shared) and r["day0"] == shared[0]
    assert math.isclose(r["sab"], float(xa @ xb), rel_tol=1e-12)
    assert math.isclose(r["lab"], float(xa[:-1] @ xb[1:]), rel_tol=1e-12)
    assert math.isclose(r["lba"], float(xb[:-1] @ xa[1:]), rel_tol=1e-12)
    assert math.isclose(r["laa"], float(xa[:-1] @ xa[1:]), rel_tol=1e-12)
    assert r["ae"] == xa[-1] and r["be"] == xb[-1]


def test_long_window_uses_one_pass_and_matches_two_pass(spark):
    """Long windows (past 256, where unrolled sums were once the limit) take
    the one-pass kernel and agree with the two-pass form."""
    rng = np.random.default_rng(13)
    n = 300
    series = {f"L{k}": random_series(rng, n + 10, kind) for k, kind in enumerate(("walk", "noise", "walk", "noise"))}
    bars = make_bars(spark, series)
    cfg = AnalysisConfig(min_days=n + 5, min_mean_volume=0.0, ndays=n, pair_blocks=2)
    assert cfg.window == n
    df = pair_verdicts(bars, cfg)
    assert "FlatMapGroupsInPandas" in df._jdf.queryExecution().executedPlan().toString()
    w = _rows(df)
    t = _rows(pair_verdicts(bars, cfg, method="two_pass"))
    assert w.keys() == t.keys() and len(w) == 12
    for k in w:
        assert w[k]["n_obs"] == n
        for c in ("alpha", "beta", "adf_t", "z_score", "signal_sd"):
            assert math.isclose(w[k][c], t[k][c], rel_tol=1e-8, abs_tol=1e-9), (k, c)


def test_null_close_in_window_gives_the_same_verdict_in_every_form(spark):
    """A NULL value in a window counts as NaN: every statistics form reports
    no number (NULL or NaN) for the pair and the same verdict."""
    import datetime as dt
    from pyspark.sql import types as T
    from pairsignals import schemas
    rng = np.random.default_rng(1)
    rows = []
    for t in ("A", "B", "C"):
        for k in range(40):
            c = float(1000 + rng.normal(0, 10))
            if t == "B" and k == 35:
                c = None
            rows.append((t, dt.date(2001, 1, 1) + dt.timedelta(days=k), c, c, c, c, 100.0))
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schemas.BARS.fields])
    bars = spark.createDataFrame(rows, nullable)
    seen = set()
    for align, methods in (("rank", ("wide", "two_pass")), ("date", ("auto", "moments", "two_pass"))):
        cfg = AnalysisConfig(min_days=30, min_mean_volume=0.0, ndays=25, align=align, min_overlap=8,
                             pair_blocks=2)
        for method in methods:
            got = _rows(pair_verdicts(bars, cfg, method=method))
            for k in (("A", "B"), ("B", "A"), ("B", "C")):
                beta = got[k]["beta"]
                assert beta is None or math.isnan(beta), (align, method, k)
                seen.add(got[k]["verdict"])
            assert got[("A", "C")]["beta"] is not None and not math.isnan(got[("A", "C")]["beta"])
    assert seen == {"not_cointegrated"}
