"""The closing formulas run in the kernel, over whole arrays."""

import numpy as np
import pandas as pd

from conftest import make_bars, random_series
from pairsignals.config import AnalysisConfig
from pairsignals.operators import kernels
from pairsignals.plans.analysis import pair_statistics, window_for


def test_no_generated_method_holds_the_closing_formulas(spark):
    rng = np.random.default_rng(4)
    bars = make_bars(spark, {f"T{k}": random_series(rng, 40) for k in range(4)})
    for align in ("rank", "date"):
        cfg = AnalysisConfig(min_days=30, min_mean_volume=0.0, ndays=20, align=align, pair_blocks=2)
        stats = pair_statistics(window_for(bars, cfg), cfg)
        above = stats._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInPandas")[0]
        assert "Generate" not in above and "SQRT" not in above.upper()
        assert stats.count() == 12


def test_a_constant_regressor_has_no_slope():
    side = {"ticker": "A", "mean": 2.0, "date0": 1, "close0": 3.0, "q": 4.0, "l": 1.0, "c_first": 1.0, "c_last": -1.0}
    flat = side | {"ticker": "B", "q": 0.0, "l": 0.0, "c_first": 0.0, "c_last": 0.0}
    f = pd.DataFrame([{f"a_{c}": v for c, v in side.items()} | {f"b_{c}": v for c, v in flat.items()}
                      | {"s": 0.0, "cx": 0.0}])
    on_flat, of_flat = (kernels.closed(f, *order, 10, False).iloc[0] for order in ("ab", "ba"))
    assert np.isnan([on_flat["beta"], on_flat["alpha"], on_flat["var_resid"], on_flat["adf_t"]]).all()
    assert on_flat["adf_m"] == 0 and on_flat["var_a"] == 0.4
    assert of_flat["beta"] == 0.0 and of_flat["adf_m"] == 9 and of_flat["alpha"] == 2.0


def _block_pair(n: int, bars: int, seed: int = 5) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    rows = []
    for side in (0, 1):
        v = 100 + rng.standard_normal((n, bars))
        c = v - v.mean(axis=1)[:, None]
        rows.append(pd.DataFrame({
            "_ga": 0, "_gb": 1, "_side": side, "ticker": [f"{side}T{k}" for k in range(n)], "mean": v.mean(axis=1),
            "date0": 9000, "close0": v[:, 0], "q": (c * c).sum(axis=1), "l": (c[:, 1:] * c[:, :-1]).sum(axis=1),
            "c_first": c[:, 0], "c_last": c[:, -1], "c": list(c)}))
    return pd.concat(rows)


def test_pairs_ruled_out_by_z_get_no_rows_of_their_own(monkeypatch):
    """Only pairs outside the z threshold reach the part of the filter that
    copies the numbers of both tickers for each pair; nothing is lost by it."""
    block, seen, whole = _block_pair(60, 40), [], kernels.PairFilter.order

    def order(self, a, b, s, cx):
        seen.append(len(s))
        return whole(self, a, b, s, cx)

    monkeypatch.setattr(kernels.PairFilter, "order", order)
    for spread in ("cross", "aligned"):
        seen.clear()
        keep = kernels.PairFilter(40, -2.9, 2.0, spread, False)
        found = pd.concat(kernels.block_stats(40, False, keep)(iter([block])))
        every = pd.concat(kernels.block_stats(40, False)(iter([block])))
        assert sum(seen) < 0.2 * len(every) == 0.2 * 2 * 60 * 60
        var = every["var_resid"] if spread == "aligned" else every["var_a"] + every["beta"] ** 2 * every["var_b"]
        want = every[(every["resid0"].abs() > 2 * var ** 0.5) & (every["adf_t"] < -2.9)]
        assert set(zip(found["stock_a"], found["stock_b"])) >= set(zip(want["stock_a"], want["stock_b"]))
        assert 0 < len(want) <= len(found) < 1.01 * len(want) + 1


def test_a_missing_date_is_no_shared_date():
    rows = [(0, 1, side, f"{side}T", day, float(day % 7 + side), 1.0, 0.0) for side in (0, 1) for day in range(100, 112)]
    rows += [(0, 1, side, f"{side}T", np.nan, 50.0, 1.0, 0.0) for side in (0, 1)]
    block = pd.DataFrame(rows, columns=["_ga", "_gb", "_side", "ticker", "day", "x", "v", "mu"])
    (sums,) = kernels.date_block_sums(iter([block]))
    assert sums["n_obs"].tolist() == [12] and sums["day0"].tolist() == [111]


def test_only_the_columns_asked_for_leave_the_kernel(spark):
    rng = np.random.default_rng(4)
    bars = make_bars(spark, {f"T{k}": random_series(rng, 40) for k in range(4)})
    for align in ("rank", "date"):
        cfg = AnalysisConfig(min_days=30, min_mean_volume=0.0, ndays=20, align=align, pair_blocks=2)
        w = window_for(bars, cfg)
        some = pair_statistics(w, cfg, columns=["stock_a", "stock_b", "date", "beta"])
        whole = pair_statistics(w, cfg)
        assert some.columns == ["stock_a", "stock_b", "date", "beta"]
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select(*some.columns).collect()))
