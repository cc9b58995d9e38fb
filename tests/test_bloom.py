"""Lookups by key skip row groups by their Bloom filters."""

import pytest
from pyspark.sql import functions as F

from pairsignals import schemas
from pairsignals.operators import store
from pairsignals.session import scratch_path


def rows_read(df) -> int:
    """Rows that the scan of an executed plan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    found = []
    for i in range(leaves.length()):
        leaf = leaves.apply(i)
        metric = leaf.metrics().get("numOutputRows")
        if "Scan" in leaf.nodeName() and metric.isDefined():
            found.append(metric.get().value())
    assert len(found) == 1, plan.toString()
    return found[0]


@pytest.fixture
def small_groups(spark):
    """Row groups of a few thousand rows, one file for each of four tasks."""
    conf = spark._jsc.hadoopConfiguration()
    for name, value in (("parquet.block.size", "32768"), ("parquet.page.size", "4096"),
                        ("parquet.block.size.row.check.min", "100")):
        conf.set(name, value)
    yield
    for name in ("parquet.block.size", "parquet.page.size", "parquet.block.size.row.check.min"):
        conf.unset(name)


def test_a_search_by_key_skips_row_groups(spark, small_groups):
    # Keys in random order, so that their least and largest value tell nothing.
    puts = spark.range(40_000).select(F.xxhash64("id").cast("string").alias("key"), F.col("id").cast("string").alias("value"))
    plain = store.VersionedTable(spark, scratch_path(spark, "plain"))
    bloom = store.VersionedTable(spark, scratch_path(spark, "bloom"), bloom=("key",))
    plain.write(puts.repartition(4))
    bloom.write(puts.repartition(4))
    key = puts.where("value = '12345'").first().key
    for table, least, most in ((plain, 30_000, 40_000), (bloom, 1, 20_000)):
        got = store.kv_get(table.read(), key)
        assert [r.value for r in got.collect()] == ["12345"]
        assert least <= rows_read(store.kv_get(table.read(), key)) <= most
    assert rows_read(store.kv_get(bloom.read(), "no such key")) < 8_000


def test_bars_and_signals_have_filters(spark):
    table = store.PartitionedTable(spark, scratch_path(spark, "bloom-bars"), schemas.BARS)
    assert table.bloom == ("ticker",)
    assert store.bloom_options(("a", "b"))["parquet.bloom.filter.enabled#b"] == "true"
