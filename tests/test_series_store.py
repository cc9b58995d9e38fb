"""Series filters, store operators, ingest and the streaming refresh."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import make_bars
from pairsignals import schemas
from pairsignals.config import AnalysisConfig
from pairsignals.operators import series as ser
from pairsignals.operators import store
from pairsignals.operators.pairs import pairs_all
from pairsignals.plans import ingest
from pairsignals.plans.analysis import pair_verdicts, window_for
from pairsignals.session import scratch_path
from pairsignals.sources.universe import first_n, read_universe_tsv
from pairsignals.streaming.refresh import run_refresh_stream


def test_config_validation():
    with pytest.raises(ValueError):
        AnalysisConfig(begin_day=100, ndays=100).validate()
    with pytest.raises(ValueError):
        AnalysisConfig(begin_day=-1).validate()
    with pytest.raises(ValueError):
        AnalysisConfig(z_thresh=-1).validate()
    with pytest.raises(ValueError):
        AnalysisConfig(crit_level="2%").validate()
    assert AnalysisConfig(min_days=2000, ndays=100).window == 100
    assert AnalysisConfig(min_days=50, ndays=100, begin_day=1).window == 49


def test_filters_are_strict_and_nan_safe(spark):
    bars = make_bars(spark, {
        "EXACT": [1.0] * 10,                 # exactly min_days bars: out
        "MORE": [1.0] * 11,                  # one more: in
        "LOWVOL": [1.0] * 11,                # mean volume exactly at the bound: out
        "NANVOL": [1.0] * 11,                # NaN volume: out
    }, volume=lambda t, k: {"LOWVOL": 50.0, "NANVOL": float("nan") if k == 3 else 80.0}.get(t, 80.0))
    cfg = AnalysisConfig(min_days=10, min_mean_volume=50.0)
    got = {r["ticker"] for r in ser.eligible_tickers(bars, cfg).collect()}
    assert got == {"MORE"}


def test_rank_trim_window(spark):
    bars = make_bars(spark, {"A": [float(k) for k in range(12)]})
    ranked = {r["rk"]: r["close"] for r in ser.rank_series(bars).collect()}
    assert ranked[1] == 11.0 and ranked[12] == 0.0
    assert ser.trim_series(bars, 5).count() == 5
    w = window_for(bars, AnalysisConfig(min_days=6, min_mean_volume=0, ndays=8, begin_day=1))
    rows = sorted((r["i"], r["v"]) for r in w.collect())
    assert rows == [(0, 10.0), (1, 9.0), (2, 8.0), (3, 7.0), (4, 6.0)]
    latest = ser.series_latest(bars).first()
    assert latest["close"] == 11.0


def test_pairs_never_self_and_both_orders(spark):
    t = spark.createDataFrame([(f"T{k}",) for k in range(13)], "ticker string")
    for b in (1, 2, 5):
        rows = {(r["stock_a"], r["stock_b"]) for r in pairs_all(t, b).collect()}
        assert len(rows) == 13 * 12
        assert all(a != b_ for a, b_ in rows)
        assert all((b_, a) in rows for a, b_ in rows)


def test_pairs_all_is_dealt_to_its_tasks_whatever_the_rows_sent(spark):
    t = spark.range(400).select(F.col("id").cast("string").alias("ticker"))
    made = pairs_all(t, 4).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in made) == 400 * 399
    assert len(made) == 10  # few bytes are sent: AQE once left them to four tasks
    assert max(r["count"] for r in made) < 2 * 400 * 399 / 10


def test_pairs_all_null_ticker_and_repeats_as_in_sql(spark):
    t = spark.createDataFrame([("A",), (None,), ("B",), ("B",), ("C",), ("",)], "ticker string")
    t.createOrReplaceTempView("named")
    sql = spark.sql("SELECT a.ticker AS stock_a, b.ticker AS stock_b FROM named a JOIN named b ON a.ticker <> b.ticker")
    for b in (1, 3):
        assert sorted(map(tuple, pairs_all(t, b).collect())) == sorted(map(tuple, sql.collect()))


def test_empty_universe_and_ticker_without_bars(spark):
    bars = make_bars(spark, {"A": [1.0, 2.0, 3.0, 4.0, 5.0, 7.0], "B": [2.0, 1.0, 4.0, 3.0, 6.0, 5.0]})
    empty = spark.createDataFrame([], schemas.UNIVERSE)
    cfg = AnalysisConfig(min_days=5, min_mean_volume=0, ndays=5)
    assert pair_verdicts(bars, cfg, universe=empty).count() == 0
    uni = spark.createDataFrame([(0, "A", "a"), (1, "B", "b"), (2, "Z", "no bars")], schemas.UNIVERSE)
    report = {r["ticker"]: (r["n_rows"], r["status"]) for r in ingest.load_report(bars, uni, 3).collect()}
    assert report == {"A": (6, "added"), "B": (6, "added"), "Z": (0, "not_added")}
    assert [r["ticker"] for r in first_n(uni, 2).collect()] == ["A", "B"]


def test_universe_tsv(spark, tmp_path):
    p = tmp_path / "tickers.txt"
    p.write_text("AAA\tAlpha Inc\nBBB\tBeta Co\n\nAAA\tDuplicate\nCCC\tGamma\n")
    uni = read_universe_tsv(spark, str(p))
    rows = sorted((r["pos"], r["ticker"], r["name"]) for r in uni.collect())
    assert [t for _, t, _ in rows] == ["AAA", "BBB", "CCC"]
    assert rows[0][2] == "Alpha Inc"


def test_upsert_later_batch_wins_and_idempotent(spark):
    old = make_bars(spark, {"A": [1.0, 2.0, 3.0]})
    new = make_bars(spark, {"A": [9.0, 9.0]}, start=dt.date(2001, 1, 2))
    merged = store.upsert_bars(old, new)
    got = {r["date"].day: r["close"] for r in merged.collect()}
    assert got == {1: 1.0, 2: 9.0, 3: 9.0}
    again = store.upsert_bars(merged, new)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))


def test_kv_operations(spark):
    b = spark.createDataFrame([("k1", '{"k": 1}'), ("k2", '{"k": 2}'), ("k3", '{"k": 3}')], schemas.KV)
    puts = spark.createDataFrame([("k2", '{"k": 20}', 1), ("k2", '{"k": 21}', 2), ("k4", '{"k": 4}', 1)],
                                 "key string, value string, seq int")
    put = store.upsert(b, puts.withColumnRenamed("seq", "_seq"), ["key"], seq=F.col("_seq"))
    assert {r["key"]: r["value"] for r in put.collect()} == {
        "k1": '{"k": 1}', "k2": '{"k": 21}', "k3": '{"k": 3}', "k4": '{"k": 4}'}
    got = store.kv_get(put, "k2", "k int").first()
    assert got["value"]["k"] == 21
    keys = spark.createDataFrame([("k1",), ("k9",)], "key string")
    after = store.kv_delete(put, keys)
    assert {r["key"] for r in after.collect()} == {"k2", "k3", "k4"}
    status = {r["key"]: r["status"] for r in store.kv_delete_confirm(after, keys).collect()}
    assert status == {"k1": "deleted", "k9": "deleted"}
    tbl = store.VersionedTable(spark, scratch_path(spark, "kv-test"))
    tbl.write(put)
    assert {r["key"] for r in store.kv_delete_all(tbl).collect()} == {"k1", "k2", "k3", "k4"}
    assert tbl.read().count() == 0 and tbl.read(1).count() == 4
    assert store.kv_delete_confirm(put, keys).where("status = 'failed'").first()["key"] == "k1"


def test_ties_of_an_upsert_do_not_depend_on_row_order(spark):
    bars = make_bars(spark, {"A": [1.0]})
    twice = make_bars(spark, {"A": [5.0]}).union(make_bars(spark, {"A": [3.0]}))
    for batch in (twice, twice.orderBy("close"), twice.orderBy(F.desc("close")).coalesce(1)):
        assert [r["close"] for r in store.upsert_bars(bars, batch).collect()] == [5.0]
    assert [r["close"] for r in store.upsert_bars(bars, twice, seq=-F.col("close")).collect()] == [3.0]


def test_old_versions_go(spark):
    tbl = store.VersionedTable(spark, scratch_path(spark, "versions"), keep=2)
    for k in range(4):
        tbl.write(spark.range(k))
    assert tbl.versions() == [3, 4] and tbl.read().count() == 3


def test_versioned_table_and_refresh(spark):
    tbl = store.VersionedTable(spark, scratch_path(spark, "bars-test"))
    bars = make_bars(spark, {"A": [1.0, 2.0, 3.0, 4.0]})
    v1 = tbl.write(bars)
    v2 = tbl.write(bars.where(F.col("close") > 2))
    assert (v1, v2) == (1, 2) and tbl.current_version() == 2
    assert tbl.read().count() == 2 and tbl.read(1).count() == 4
    meta = ingest.update_record(spark, dt.datetime(2001, 1, 3, 12, 30))
    assert ingest.refresh_start(meta, 1) == dt.date(2001, 1, 2)
    src = make_bars(spark, {"A": [5.0, 6.0, 7.0, 8.0]})
    out = {r["date"].day: r["close"] for r in ingest.incremental_refresh(bars, src, meta, None, 1).collect()}
    assert out == {1: 1.0, 2: 6.0, 3: 7.0, 4: 8.0}
    doc = meta.first()["value"]
    assert doc == '{"Year":2001,"Month":1,"Day":3,"Hour":12,"Minute":30}'


def test_refresh_stream_later_load_wins(spark):
    first = make_bars(spark, {"A": [1.0, 2.0, 3.0]})
    second = make_bars(spark, {"A": [9.0]}, start=dt.date(2001, 1, 3))
    out = {r["date"].day: r["close"] for r in run_refresh_stream(spark, [first, second]).collect()}
    assert out == {1: 1.0, 2: 2.0, 3: 9.0}


def test_refresh_stream_late_load_does_not_win(spark):
    """Load 1 lands after load 2 has been merged."""
    from pairsignals.streaming.refresh import LANDED, land, start_refresh_stream
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "stream")
    table = store.PartitionedTable(spark, scratch_path(spark, "late"), LANDED)
    for number, closes in ((2, [9.0]), (1, [1.0, 2.0])):
        land(make_bars(spark, {"A": closes}), landing, number)
        start_refresh_stream(spark, landing, table, checkpoint).awaitTermination()
    assert {r["date"].day: (r["close"], r["load_id"]) for r in table.read().collect()} == {1: (9.0, 2), 2: (2.0, 1)}


def test_full_load_then_nightly_job(spark):
    from pairsignals.plans.nightly import full_load_job, nightly_job
    import numpy as np
    from conftest import random_series
    rng = np.random.default_rng(12)
    series = {f"N{k}": random_series(rng, 30, "noise") for k in range(4)}
    src = make_bars(spark, series)
    uni = spark.createDataFrame([(k, t, t) for k, t in enumerate(sorted(series))], schemas.UNIVERSE)
    bars_t = store.PartitionedTable(spark, scratch_path(spark, "nb-bars"), schemas.BARS)
    meta_t = store.VersionedTable(spark, scratch_path(spark, "nb-meta"))
    sig_t = store.VersionedTable(spark, scratch_path(spark, "nb-signals"))
    first = src.where(F.col("date") <= F.lit("2001-01-25").cast("date"))
    report = full_load_job(spark, bars_t, meta_t, first, uni, now=dt.datetime(2001, 1, 25))
    assert {r["n_rows"] for r in report.collect()} == {25}
    cfg = AnalysisConfig(min_days=20, min_mean_volume=0.0, ndays=20, z_thresh=0.0)
    v = nightly_job(spark, bars_t, meta_t, sig_t, src, cfg, uni, overlap_days=5,
                    now=dt.datetime(2001, 1, 31))
    assert bars_t.read().count() == 4 * 30
    assert sig_t.read(v).count() == pair_verdicts(src, cfg, uni).where("verdict = 'tradeable'").count()
    assert ingest.last_update(meta_t.read()) == dt.date(2001, 1, 31)


def test_walk_from_totals_equals_running_sum(spark):
    import numpy as np
    from conftest import random_series
    from pairsignals.operators.series import analysis_window
    from pairsignals.sources.bars import walk_bars
    rng = np.random.default_rng(8)
    bars = make_bars(spark, {f"W{k}": random_series(rng, 40, "noise") for k in range(3)})
    cfg = AnalysisConfig(min_days=30, min_mean_volume=0.0, ndays=12, begin_day=2)
    fast = {(r["ticker"], r["i"]): r["v"] for r in analysis_window(bars, cfg, walk_offset=1500.0).collect()}
    full = {(r["ticker"], r["i"]): r["v"] for r in analysis_window(walk_bars(bars, 1500.0), cfg).collect()}
    assert fast.keys() == full.keys() and len(fast) == 30
    assert all(fast[k] == full[k] for k in fast)


def test_versioned_table_survives_a_partial_write(spark):
    import os
    root = scratch_path(spark, "partial")
    tbl = store.VersionedTable(spark, root)
    bars = make_bars(spark, {"A": [1.0, 2.0]})
    assert tbl.write(bars) == 1
    os.makedirs(root.replace("file:", "") + "/v000002")  # a write that died: no _SUCCESS
    assert tbl.current_version() == 1
    assert tbl.write(bars.where("close > 1")) == 3
    assert tbl.current_version() == 3 and tbl.read().count() == 1


def test_jobs_full_load_refresh_analyze(spark, tmp_path):
    import numpy as np
    from conftest import random_series
    from pairsignals import jobs
    rng = np.random.default_rng(31)
    series = {f"J{k}": random_series(rng, 30, "noise") for k in range(4)}
    src_dir = scratch_path(spark, "jobs-src")
    make_bars(spark, series).write.parquet(src_dir)
    uni = tmp_path / "tickers.tsv"
    uni.write_text("".join(f"{t}\t{t} Inc\n" for t in sorted(series)))
    store_root = scratch_path(spark, "jobs-store")
    common = ["--store", store_root, "--source", src_dir, "--universe", str(uni)]
    assert jobs.run(spark, ["full-load", *common, "--end", "2001-01-25", "--now", "2001-01-25T00:00"]) == 1
    st = jobs.Store(spark, store_root)
    assert st.bars.read().count() == 4 * 25
    assert jobs.run(spark, ["refresh", *common, "--now", "2001-01-31T00:00"]) == 2
    assert st.bars.read().count() == 4 * 30
    assert jobs.run(spark, ["analyze", "--store", store_root, "--min-days", "20", "--min-mean-volume", "0",
                            "--ndays", "20", "--z-thresh", "0"]) == 1
    want = pair_verdicts(make_bars(spark, series), AnalysisConfig(min_days=20, min_mean_volume=0, ndays=20,
                                                                  z_thresh=0.0))
    assert st.signals.read().count() == want.where("verdict = 'tradeable'").count()
    with pytest.raises(SystemExit):
        jobs.run(spark, ["refresh", "--store", store_root])


def test_two_level_rank_and_walk_equal_one_window_forms(spark):
    """The full-history rank and running sum run per (ticker, year) plus an
    offset carried over the years; they must equal the one-window forms,
    across year boundaries, with a null date and with years without bars."""
    import numpy as np
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from pairsignals.sources.bars import walk_bars, walk_step
    rng = np.random.default_rng(11)
    rows = []
    for t, step in (("Y1", 37), ("Y2", 1), ("Y3", 400)):
        for k in range(60):
            c = float(1000 + rng.normal(0, 10))
            rows.append((t, dt.date(1998, 12, 20) + dt.timedelta(days=k * step), c, c, c, c, 100.0))
    rows.append(("Y1", None, 990.0, 990.0, 990.0, 990.0, 100.0))
    # NULL closes: leading ones, then values, then the start of a new year
    for k in range(20):
        d = dt.date(2001, 12, 1) + dt.timedelta(days=k * 3)
        c = None if k < 4 or 11 <= k < 15 else float(1000 + k)
        rows.append(("Y4", d, c, c, c, c, 100.0))
    for k in range(10):
        rows.append(("Y5", dt.date(2002, 1, 1) + dt.timedelta(days=k), None if k >= 3 and k < 6 else 1000.0 + k,
                     1.0, 1.0, 1.0, 100.0))
    from pyspark.sql import types as T
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schemas.BARS.fields])
    bars = spark.createDataFrame(rows, nullable)
    newest_first = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    want_rank = {(r["ticker"], r["date"], r["rk"])
                 for r in bars.withColumn("rk", F.row_number().over(newest_first)).collect()}
    got_rank = {(r["ticker"], r["date"], r["rk"]) for r in ser.rank_series(bars).collect()}
    assert got_rank == want_rank and len(got_rank) == 211
    oldest_first = (Window.partitionBy("ticker").orderBy("date")
                    .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    want_walk = {(r["ticker"], r["date"], r["close"])
                 for r in bars.withColumn("close", F.sum(walk_step(1500.0)).over(oldest_first).cast("double")).collect()}
    walked = walk_bars(bars, 1500.0)
    assert walked.columns == bars.columns
    assert {(r["ticker"], r["date"], r["close"]) for r in walked.collect()} == want_walk
    assert sum(1 for t, _, c in want_walk if t == "Y4" and c is None) == 4
    # the trimmed-window walk (total minus newer bars) agrees, NULLs included
    from pairsignals.operators.series import analysis_window
    y4 = bars.where("ticker = 'Y4'")
    cfg = AnalysisConfig(min_days=19, min_mean_volume=0.0, ndays=20)
    # (a missing value enters the window as NaN)
    import math
    fast = {r["i"]: r["v"] for r in analysis_window(y4, cfg, walk_offset=1500.0).collect()}
    full = {r["i"]: r["v"] for r in analysis_window(walk_bars(y4, 1500.0), cfg).collect()}
    assert fast.keys() == full.keys() and len(fast) == 19
    assert all(fast[i] == full[i] or (math.isnan(fast[i]) and math.isnan(full[i])) for i in fast)
    assert sum(math.isnan(v) for v in fast.values()) == 3


def test_line_key_orders_like_the_pair(spark):
    from pairsignals.sources.bars import line_key
    keys = [(o, ln) for o in (-2 ** 63, -5, 0, 3, 4, 2 ** 63 - 1) for ln in (-2 ** 31, -1, 0, 1, 7, 65536, 2 ** 31 - 1)]
    df = spark.createDataFrame(keys, "l_orderkey long, l_linenumber int")
    got = [(r["l_orderkey"], r["l_linenumber"]) for r in df.orderBy(line_key()).collect()]
    assert got == sorted(keys)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace
    from pairsignals.session import checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(session)
