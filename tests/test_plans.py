"""Plan shapes that carry the scale properties: the pair stages shuffle only
the block-fanned window rows, nothing is shuffled after a kernel, no
cartesian product, partial top-k before the trim shuffle, hash aggregation
of the bars and a full-history rank windowed per ticker-year."""

import numpy as np
import pytest

from conftest import make_bars, random_series
from pairsignals.config import AnalysisConfig
from pairsignals.plans.analysis import pair_verdicts


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _bars(spark):
    rng = np.random.default_rng(3)
    return make_bars(spark, {f"P{k}": random_series(rng, 40, "walk") for k in range(6)})


def _assert_pair_stage(plan: str):
    lines = plan.splitlines()
    kernel = [i for i, line in enumerate(lines) if "FlatMapGroupsInPandas" in line]
    assert len(kernel) == 1, plan
    k = kernel[0]
    # nothing is shuffled after the kernel (lines above it are its ancestors)
    assert not any("Exchange" in line for line in lines[:k]), plan
    # the kernel's input is one repartition on the block pair
    below = [line for line in lines[k + 1:] if "Exchange" in line]
    assert "REPARTITION_BY_NUM" in below[0] and "direct_shuffle_partition_id(_pair" in below[0], plan
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


@pytest.mark.parametrize("align", ["rank", "date"])
def test_pair_stage_shuffles_only_block_rows(spark, align):
    cfg = AnalysisConfig(min_days=30, min_mean_volume=0.0, ndays=25, align=align, min_overlap=8, pair_blocks=2)
    plan = _plan(pair_verdicts(_bars(spark), cfg))
    _assert_pair_stage(plan)
    assert "WindowGroupLimit" in plan  # partial top-k before the trim shuffle
    if align == "date":
        # no window or aggregate keyed by the pair: those would shuffle pairs x dates
        assert "a_ticker#" not in "".join(line for line in plan.splitlines() if "Exchange" in line)


def test_bar_adapter_is_a_hash_aggregate(spark):
    from pairsignals.sources.bars import bars_from_lineitem
    lines = spark.createDataFrame(
        [(1, 7, 1, 2.0, 20.0, "1998-01-02"), (2, 7, 1, 1.0, 11.0, "1998-01-02")],
        "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_shipdate string").selectExpr("*", "CAST(l_shipdate AS TIMESTAMP_NTZ) AS ts").drop("l_shipdate") \
        .withColumnRenamed("ts", "l_shipdate")
    bars = bars_from_lineitem(lines)
    plan = _plan(bars)
    assert "HashAggregate" in plan and "SortAggregate" not in plan, plan
    row = bars.collect()[0]
    assert row["open"] == 10.0 and row["volume"] == 3.0


def test_full_history_rank_windows_per_ticker_year(spark):
    from pairsignals.operators.series import rank_series
    plan = _plan(rank_series(_bars(spark)))
    windows = [line for line in plan.splitlines() if "Window [" in line or "Window(" in line or " Window " in line]
    assert windows, plan
    row_number = [w for w in windows if "row_number" in w]
    assert row_number and all("_yr" in w for w in row_number), plan


def test_one_block_pair_for_each_task(spark):
    from pyspark.sql import functions as F
    from pairsignals.operators.stats import _fan_out, _per_block_pair

    def task(pdf):
        import pandas as pd
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        return pd.DataFrame({"ga": pdf["_ga"].iloc[:1], "gb": pdf["_gb"].iloc[:1], "task": [part]})

    b = 28
    df = spark.range(3000).select(F.col("id").cast("string").alias("ticker"))
    seen = _per_block_pair(_fan_out(df, b, ["ticker"]), b, task, "ga int, gb int, task int").collect()
    assert len(seen) == len({(r.ga, r.gb) for r in seen}) == len({r.task for r in seen}) == b * (b + 1) // 2


def _ran(df) -> str:
    df.collect()
    return _plan(df).split("Initial Plan")[0]


def test_bars_are_built_once(spark):
    from conftest import SF_SMALL
    from pairsignals.plans.catalog import QUERIES
    plan = _ran(QUERIES["pair_verdicts"](spark, SF_SMALL))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan, plan


def test_searches_are_pruned(spark):
    from conftest import SF_SMALL
    from pairsignals.plans.catalog import QUERIES

    def scan(key):
        lines = _ran(QUERIES[key](spark, SF_SMALL)).splitlines()
        return [line for line in lines if "FileScan" in line][0]

    assert "EqualTo(event_id,42)" in scan("kv_get")
    assert "EqualTo(l_suppkey,7)" in scan("bars_load_one_ticker")
    assert "l_shipdate,1999-01-01" in scan("index_search_eq")
    assert "month#" in scan("index_search_range").split("PartitionFilters")[1].split("]")[0]
    assert "EqualTo(stock_a," in scan("signals_search") and "EqualTo(year," in scan("signals_search")


def test_upsert_reads_only_the_months_of_its_batch(spark):
    import datetime as dt
    from conftest import make_bars
    from pairsignals import schemas
    from pairsignals.operators.store import PartitionedTable
    from pairsignals.session import scratch_path
    table = PartitionedTable(spark, scratch_path(spark, "pruned"), schemas.BARS)
    table.upsert(make_bars(spark, {"A": [float(k) for k in range(400)]}))
    batch = make_bars(spark, {"A": [-1.0] * 3}, start=dt.date(2001, 6, 29))
    plan = _ran(table.touched(batch))
    assert "number of partitions" not in plan and "(year#" in plan.split("PartitionFilters")[1]
    assert table.touched(batch).count() == 30 + 31
    table.upsert(batch)
    rows = {r.date: r.close for r in table.read().collect()}
    assert len(rows) == 400 and [rows[dt.date(2001, 6, d)] for d in (28, 29, 30)] == [178.0, -1.0, -1.0]


def test_aligned_rows_are_made_of_the_given_pairs_only(spark):
    """No exchange carries rows of pairs and bars: windows travel as arrays."""
    from pairsignals.operators.pairs import pairs_aligned_date, pairs_aligned_rank
    from pairsignals.plans.analysis import window_for
    bars = _bars(spark)
    pairs = spark.createDataFrame([("P1", "P2"), ("P3", "P0")], "stock_a string, stock_b string")
    for align, make in (("rank", pairs_aligned_rank), ("date", lambda w, p: pairs_aligned_date(w, p, 8))):
        cfg = AnalysisConfig(min_days=30, min_mean_volume=0.0, ndays=25, align=align, min_overlap=8)
        rows = make(window_for(bars, cfg), pairs)
        lines = _plan(rows).splitlines()
        generate = [i for i, line in enumerate(lines) if "Generate inline" in line][0]
        assert not any("Exchange" in line for line in lines[:generate])
        assert rows.count() == 50
