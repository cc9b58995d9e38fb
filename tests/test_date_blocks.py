"""The date kernel joins only the pairs whose rows are needed."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pairsignals.functions.critical import CRIT_COEFFS
from pairsignals.operators import kernels


def _block(diagonal: bool = False, n: int = 40, odd: bool = True, seed: int = 3) -> pd.DataFrame:
    """Two blocks of windows over 200 days, a row for each ticker; with odd
    ones: constant, nearly constant, with a NaN, with no day of the others."""
    rng, rows = np.random.default_rng(seed), []
    for side in (0, 1):
        if diagonal and side:
            rows += [r | {"_side": 1} for r in rows]
            break
        for k in range(n):
            days = np.sort(rng.choice(200, 60, replace=False))[::-1].astype(np.int32)
            v = 100 + rng.standard_normal(60)
            if odd and k == 0:
                v[:] = 10.1
            if odd and k == 1:
                v = np.where(np.arange(60) < 50, 7.77, v)
            if odd and k == 2:
                v[5] = np.nan
            if odd and k == 3:
                days = days + 1000
            rows.append({"_ga": 0, "_gb": 0 if diagonal else 1, "_side": side, "ticker": f"{side}T{k:02}",
                         "mu": v.mean(), "days": days, "w": v})
    return pd.DataFrame(rows)


def _flat(block: pd.DataFrame) -> pd.DataFrame:
    rows = block.rename(columns={"days": "day", "w": "v"}).explode(["day", "v"], ignore_index=True)
    rows["day"], rows["v"] = rows["day"].astype(np.int64), rows["v"].astype(float)
    return rows.assign(x=rows["v"] - rows["mu"])


@pytest.mark.parametrize("diagonal", [True, False])
def test_windows_as_arrays_give_the_same_sums(diagonal):
    block = _block(diagonal)
    a, b = (pd.concat(kernels.date_block_sums(iter([x]))) for x in (block, _flat(block)))
    pd.testing.assert_frame_equal(a, b)


def test_newest_shared_day():
    rng = np.random.default_rng(1)
    a, b = rng.random((30, 150)) < 0.1, rng.random((20, 150)) < 0.1
    place = kernels.newest_shared(a, b)
    for i in range(30):
        for j in range(20):
            both = np.flatnonzero(a[i] & b[j])
            assert not len(both) or place[i, j] == both[-1]


@pytest.mark.parametrize("spread", ["cross", "aligned"])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("diagonal", [True, False])
def test_only_pairs_outside_z_are_joined_on_date(monkeypatch, spread, forward, diagonal):
    block, joined, whole = _block(diagonal), [], kernels.DateBlocks._sums

    def sums(self, lo, tables, ia, row):
        joined.append(len(row))
        return whole(self, lo, tables, ia, row)

    monkeypatch.setattr(kernels.DateBlocks, "_sums", sums)
    every = pd.concat(kernels.date_block_stats_of(8, forward)(iter([block])))
    all_rows = sum(joined)
    joined.clear()
    keep = kernels.DatePairFilter(CRIT_COEFFS["10%"], 2.0, spread)
    for rows_at_once in (kernels.DATE_CHUNK_ROWS, 50):
        monkeypatch.setattr(kernels, "DATE_CHUNK_ROWS", rows_at_once)
        found = pd.concat(kernels.date_block_stats_of(8, forward, keep=keep)(iter([block])))
        var = every["var_resid"] if spread == "aligned" else every["var_a"] + every["beta"] ** 2 * every["var_b"]
        b0, b1, b2, b3 = CRIT_COEFFS["10%"]
        inv = 1 / every["adf_m"].where(every["adf_m"] > 0)
        crit = b0 + inv * (b1 + inv * (b2 + inv * b3))
        z = every["resid0"].abs() / var ** 0.5
        want = every[((z > 2) & (every["adf_t"] < crit)).fillna(False)]
        key = ["stock_a", "stock_b"]
        got = want[key].merge(found, on=key)
        assert 0 < len(want) == len(got)
        pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True),
                                      want.sort_values(key).reset_index(drop=True))
    assert sum(joined) / 2 < 0.35 * all_rows  # pairs of the odd ones are joined, too


@pytest.mark.parametrize("odd", [True, False])
@pytest.mark.parametrize("diagonal", [True, False])
def test_sizes_need_no_joined_rows_of_sure_pairs(monkeypatch, diagonal, odd):
    """``adf_m`` of every pair, by the shared dates alone; only pairs of a
    ticker that may be constant, or has no number, are joined."""
    block, joined, whole = _block(diagonal, odd=odd), [], kernels.DateBlocks._sums
    every = pd.concat(kernels.date_block_stats_of(12, False, ["stock_a", "stock_b", "adf_m"])(iter([block])))
    monkeypatch.setattr(kernels.DateBlocks, "_sums", lambda self, *a: joined.append(1) or whole(self, *a))
    batch = pa.RecordBatch.from_pandas(block, preserve_index=False)
    made = pa.Table.from_batches(kernels.date_test_sizes(12)(iter([batch]))).to_pandas()
    got = sorted((r.stock_a, b, r.adf_m) for r in made.itertuples() for b in r.stock_b)
    assert got == sorted(map(tuple, every[["stock_a", "stock_b", "adf_m"]].astype(object).to_numpy().tolist()))
    assert {m for *_, m in got} > ({0} if odd else set()) and bool(joined) == odd
    assert len(made) < 0.8 * len(got)


def test_critical_values_are_computed_before_pairs_are_listed(spark):
    from conftest import SF_SMALL
    from pairsignals.plans.catalog import QUERIES
    plan = QUERIES["adf_critical_values"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Generate explode(stock_b", 1)
    assert "-3.43035" not in above and "-3.43035" in below.split("FlatMapGroupsInArrow")[0]
