"""What is sent to the tasks that match the bars of given pairs."""

import datetime as dt

from pairsignals.operators import pairs as P


def test_pairs_are_sent_with_empty_windows_not_null_ones(spark, monkeypatch):
    """Spark's Arrow writer fills the offsets of all NULL arrays of a batch
    anew for every row: time grows with the square of the pairs in a batch."""
    sent, whole = [], P._by_block_pair
    monkeypatch.setattr(P, "_by_block_pair", lambda df, b: sent.append(df) or whole(df, b))
    window = spark.createDataFrame([(t, i, dt.date(2001, 1, 1 + i), float(i)) for t in "AB" for i in range(4)],
                                   "ticker string, i int, date date, v double")
    pairs = spark.createDataFrame([("A", "B")], "stock_a string, stock_b string")
    assert P.pairs_aligned_date(window, pairs, 2).count() == 4
    rows = sent[0].selectExpr("_side", "w IS NULL AS missing", "size(w) AS n").collect()
    assert sum(r._side == 2 and r.n == 0 for r in rows) == 1 and not any(r.missing for r in rows)


def test_pairs_are_sent_packed(spark):
    """Pairs of a block pair go as one row in which a ticker is a number, not
    as rows of their own, and come out whole."""
    import numpy as np
    import pyarrow as pa
    from pairsignals.operators import kernels
    rng = np.random.default_rng(2)
    n = 30_000
    blocks = [pa.array(rng.integers(0, 3, n), pa.int32()) for _ in "ab"]
    stocks = [pa.array([f"{p}{x}" for x in rng.integers(0, 500, n)]) for p in "XY"]
    extra = pa.array(np.where(rng.random(n) < 0.1, None, rng.random(n)), pa.float64())
    batch = pa.RecordBatch.from_arrays([*blocks, stocks[0], stocks[1], extra],
                                       names=["_ga", "_gb", "stock_a", "stock_b", "alpha"])
    columns = ["stock_a", "stock_b", "alpha"]
    (out,) = kernels.packed_pairs(columns)(iter([batch.slice(0, 10_000), batch.slice(10_000)]))
    assert len(out) == 9 and set(out["_side"].to_pylist()) == {2}
    assert out["pairs"].nbytes < 0.75 * batch.select(columns).nbytes
    got = [(r["_ga"], r["_gb"], *x.values()) for r in out.to_pylist()
           for x in kernels._unpacked(pa.py_buffer(r["pairs"])).to_pylist()]
    want = [tuple(r.values()) for r in batch.to_pylist()]
    key = str
    assert sorted(got, key=key) == sorted(want, key=key)
