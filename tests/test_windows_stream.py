"""Newest bars by a stream with state, against windows of the batch store."""

import datetime as dt

import numpy as np
import pytest
from conftest import make_bars, random_series
from pyspark.sql import functions as F

from pairsignals.operators import series as ser
from pairsignals.operators.store import PartitionedTable, upsert_by_load
from pairsignals.session import scratch_path
from pairsignals.streaming.refresh import LANDED, land
from pairsignals.streaming.windows import ROCKSDB, read_windows, start_windows_stream


def rows(df):
    return sorted(tuple(r) for r in df.select("ticker", "rk", "date", "close", "volume").collect())


def test_windows_survive_restarts_and_late_bars(spark):
    rng = np.random.default_rng(2)
    loads = [(1, make_bars(spark, {"A": random_series(rng, 50), "B": [1.0, 2.0]})),
             # corrections, new days and a new ticker
             (3, make_bars(spark, {"A": [7.0] * 5, "C": [5.0]}, start=dt.date(2001, 2, 17))),
             # an older load that comes late: it replaces load 1 only; some of its days are older than any window
             (2, make_bars(spark, {"A": [9.0] * 30, "B": [4.0]}, start=dt.date(2001, 1, 25))),
             (4, make_bars(spark, {"C": [6.0] * 30}, start=dt.date(2000, 12, 1)))]
    landing, out, checkpoint = (scratch_path(spark, n) for n in ("w-landing", "w-out", "w-ckpt"))
    table = PartitionedTable(spark, scratch_path(spark, "w-bars"), LANDED)
    with pytest.raises(ValueError):
        start_windows_stream(spark, landing, out, checkpoint, 10)
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, ROCKSDB)
    try:
        for load_id, bars in loads:
            land(bars, landing, load_id)
            table.upsert(bars.withColumn("load_id", F.lit(load_id).cast("long")), merge=upsert_by_load)
            query = start_windows_stream(spark, landing, out, checkpoint, 10)
            query.awaitTermination()
            assert query.exception() is None
            assert rows(read_windows(spark, out)) == rows(ser.trim_series(table.read(), 10))
    finally:
        spark.conf.set(conf, before)
    assert {r.ticker for r in read_windows(spark, out).collect()} == {"A", "B", "C"}


def test_a_batch_reads_and_writes_the_state_once():
    import pandas as pd
    from pairsignals.streaming.windows import NewestBars

    class Held:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

        def getValueState(self, name, schema):
            return self

    held, bars = Held(), NewestBars(10)
    bars.init(held)
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=k) for k in range(300)]
    for load, part in ((1, days[:200]), (2, days[150:])):
        batch = pd.DataFrame({"date": part, "close": float(load), "volume": 1.0, "load_id": load})
        out = pd.concat(bars.handleInputRows(("A",), iter([batch]), None))
        assert list(out["date"]) == part[:-11:-1] and set(out["close"]) == {float(load)}
    assert held.calls == 4
