"""Registered queries: one per operator of the inventory, over the driver tables.

Every query reads whole tables: ``lineitem`` gives the daily bars (one bar per
supplier and ship date), ``supplier`` the universe, ``events`` a key/value
bucket (key = event id, value = the JSON ``props``). Doubles are reported
rounded to 6 decimals. Parameters are fixed per query (see ``FILTER`` and
``STATS``); the thresholds are chosen so that every filter and every verdict
branch is exercised on the driver data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsignals import schemas
from pairsignals.config import AnalysisConfig
from pairsignals.functions.calendar import date_from_iso_parts, date_parts, iso_date, record_key
from pairsignals.functions.columns import round6, round6_scale
from pairsignals.functions.critical import critical_value
from pairsignals.operators import series as ser
from pairsignals.operators import signals as sig
from pairsignals.operators import store
from pairsignals.operators.summaries import SummarizedBars
from pairsignals.operators.pairs import block_count, pair_residuals, pairs_aligned_date, pairs_aligned_rank, pairs_all
from pairsignals.plans import analysis, ingest
from pairsignals.session import scratch_path
from pairsignals.sources.bar_files import load_bar_files, with_reasons
from pairsignals.sources.bars import bars_from_lineitem, bars_in_range
from pairsignals.sources.tables import table
from pairsignals.sources.universe import first_n, universe_from_supplier

# Fixed parameters of the registered queries.
FILTER = AnalysisConfig(min_days=500, min_mean_volume=28.0)
STATS = AnalysisConfig(min_days=500, min_mean_volume=25.0, ndays=100)
WALK_CROSS = STATS.with_(series="walk", z_thresh=0.5)
WALK_ALIGNED = STATS.with_(series="walk", spread="aligned", crit_level="10%")
DATE_ALIGNED = STATS.with_(align="date", min_overlap=10, crit_level="1%")
WINDOW_OFFSET = STATS.with_(begin_day=10)
# A second analysis over the series stored for the first.
SHARED = STATS.with_(spread="aligned", ndays=80, begin_day=5, min_mean_volume=26.0, crit_level="1%")
# Suppliers whose newest bars are corrected between two analyses.
CORRECTED_NATIONS = (3, 11)
# Suppliers whose bar files are broken.
BROKEN_NATION = 5
RANGE_START, RANGE_END = dt.date(1998, 1, 1), dt.date(1998, 12, 31)
FIRST_N = 7
AS_OF = dt.datetime(2001, 6, 30)
OVERLAP_DAYS = 5
ONE_TICKER = "7"
ONE_KEY = "42"
DELETE_EVENT_TYPE = "error"
DELETE_BEFORE = dt.datetime(2024, 1, 15)
# Suppliers of these nations play tickers that stand still at a price whose
# mean over a window is not exact in binary.
PEGGED = {0: 10.1, 1: 0.1, 2: 7.77, 3: 4.35}
SEARCH_YEAR = 1999
SEARCH_STOCK, SEARCH_SIGNAL_YEAR = "61", 2001
SEARCH_MONTHS = (3, 5)

Query = Callable[[SparkSession, str], DataFrame]


def report(df: DataFrame) -> DataFrame:
    """Round every double column to 6 decimals (names unchanged). The scales
    are columns of their own: written into each use, they made the method
    generated for all verdict columns too long to be compiled."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    scaled = df.withColumns({f"_scale_{c}": round6_scale(c) for c in doubles}) if doubles else df
    return scaled.select(*[round6(c, f"_scale_{c}").alias(c) if c in doubles else F.col(c) for c in df.columns])


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_lineitem(table(spark, sf, "lineitem"))


def universe(spark: SparkSession, sf: str) -> DataFrame:
    return universe_from_supplier(table(spark, sf, "supplier"))


def bucket(spark: SparkSession, sf: str, key: str | None = None) -> DataFrame:
    """Events as a key/value bucket; of one ``key`` only, if given (the key
    reaches the scan as the number it is stored as)."""
    ev = table(spark, sf, "events")
    if key is not None:
        ev = ev.where(F.col("event_id") == F.lit(int(key)))
    return ev.select(F.col("event_id").cast("string").alias("key"), F.col("props").alias("value"))


# --------------------------------------------------------------------------
# scans and series
# --------------------------------------------------------------------------

def q_universe_scan(spark, sf):
    return universe(spark, sf)


def q_universe_first_n(spark, sf):
    return first_n(universe(spark, sf), FIRST_N)


def q_bars_scan_range(spark, sf):
    return report(bars_in_range(bars(spark, sf), RANGE_START, RANGE_END, universe(spark, sf)))


def q_series_profile(spark, sf):
    return report(ser.series_profile(bars(spark, sf)))


def q_filter_min_history(spark, sf):
    return ser.filter_min_history(ser.series_profile(bars(spark, sf)), FILTER.min_days).select("ticker", "n_bars")


def q_filter_min_volume(spark, sf):
    prof = ser.series_profile(bars(spark, sf))
    return report(ser.filter_min_volume(prof, FILTER.min_mean_volume).select("ticker", "mean_volume"))


def q_series_ranked(spark, sf):
    return report(ser.rank_series(bars(spark, sf)).select("ticker", "date", "close",
                                                          F.col("rk").cast("long").alias("rk")))


def q_series_trimmed(spark, sf):
    b = bars(spark, sf)
    ok = ser.eligible_tickers(b, FILTER).select("ticker")
    out = ser.trim_series(b, FILTER.trim).join(ok, "ticker", "left_semi")
    return report(out.select("ticker", "date", "close", "volume", F.col("rk").cast("long").alias("rk")))


def q_analysis_window(spark, sf):
    w = analysis.window_for(bars(spark, sf), WINDOW_OFFSET)
    return report(w.select("ticker", F.col("i").cast("long").alias("i"), "date",
                           F.col("v").alias("close"), "volume"))


def q_series_latest(spark, sf):
    return report(ser.series_latest(bars(spark, sf)))


def q_series_scan(spark, sf):
    return report(ser.series_scan(bars(spark, sf), universe(spark, sf)))


# --------------------------------------------------------------------------
# pairs
# --------------------------------------------------------------------------

def _eligible(spark, sf, cfg=STATS):
    return ser.eligible_tickers(bars(spark, sf), cfg).select("ticker")


def q_pairs_all(spark, sf):
    return pairs_all(_eligible(spark, sf), block_count(spark, STATS))


def q_pairs_aligned_rank(spark, sf):
    w = analysis.window_for(bars(spark, sf), STATS)
    out = pairs_aligned_rank(w, _tradeable(spark, sf))
    return report(out.select("stock_a", "stock_b", F.col("i").cast("long").alias("i"),
                             "date_a", "date_b", "close_a", "close_b"))


def q_pairs_aligned_date(spark, sf):
    w = analysis.window_for(bars(spark, sf), DATE_ALIGNED)
    # Closes leave as they come: rounded once in a window, not in every pair.
    return pairs_aligned_date(report(w), _tradeable(spark, sf, DATE_ALIGNED), DATE_ALIGNED.min_overlap)


# --------------------------------------------------------------------------
# statistics and verdicts
# --------------------------------------------------------------------------

def _stats(spark, sf, *columns, cfg=STATS, listed=False):
    """Statistics of every pair; only ``columns`` leave the kernel."""
    window = analysis.window_for(bars(spark, sf), cfg)
    return analysis.pair_statistics(window, cfg, columns=[*sig.PAIR, *columns], listed=listed)


def _verdicts(spark, sf, cfg=STATS):
    return sig.verdicts(_stats(spark, sf, *sig.verdict_reads(cfg), cfg=cfg), cfg)


def _tradeable(spark, sf, cfg=STATS):
    return analysis.tradeable_pairs(bars(spark, sf), cfg)


def q_pair_verdicts_pegged(spark, sf):
    """Verdicts where some series are constant: they are never a regressor of
    a cointegrated pair, nor cointegrated with one."""
    fixed = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), F.coalesce(
        *[F.when(F.col("s_nationkey") == n, F.lit(price)) for n, price in PEGGED.items()]).alias("_price"))
    b = bars(spark, sf).join(fixed, "ticker", "left").withColumn("close", F.coalesce("_price", "close")).drop("_price")
    stats = analysis.pair_statistics(analysis.window_for(b, STATS), STATS, columns=sig.verdict_reads(STATS))
    return report(sig.verdicts(stats, STATS))


def q_pair_ols(spark, sf):
    return report(_stats(spark, sf, "alpha", "beta").select("stock_a", "stock_b", "alpha", "beta"))


def q_pair_residuals(spark, sf):
    w = analysis.window_for(bars(spark, sf), STATS)
    out = pair_residuals(w, _tradeable(spark, sf))
    return report(out.select("stock_a", "stock_b", F.col("i").cast("long").alias("i"), "resid"))


def q_pair_adf_t(spark, sf):
    return report(_stats(spark, sf, "adf_m", "adf_t").select("stock_a", "stock_b", "adf_m", "adf_t"))


def q_adf_critical_values(spark, sf):
    # A ticker's pairs with the same adf_m have the same values: computed once, then one row for each pair.
    st, m = _stats(spark, sf, "adf_m", cfg=DATE_ALIGNED, listed=True), F.col("adf_m")
    crit = report(st.select("stock_a", "stock_b", "adf_m",
                            critical_value("1%", m).alias("crit_1pct"),
                            critical_value("5%", m).alias("crit_5pct"),
                            critical_value("10%", m).alias("crit_10pct")))
    return crit.withColumn("stock_b", F.explode("stock_b")).select("stock_a", "stock_b", *crit.columns[2:])


def q_pair_cointegration(spark, sf):
    st = sig.cointegrated(_stats(spark, sf, "alpha", "beta", *sig.COINTEGRATION_READS, cfg=WALK_ALIGNED),
                          WALK_ALIGNED.crit_level)
    return report(st.select("stock_a", "stock_b", "alpha", "beta", "adf_t", "crit_value", "cointegrated"))


def q_pair_spread_cross(spark, sf):
    st = _stats(spark, sf, *sig.SPREAD_READS["cross"])
    return report(sig.spread(st, "cross").select("stock_a", "stock_b", "signal_mean", "signal_sd"))


def q_pair_spread_aligned(spark, sf):
    st = _stats(spark, sf, *sig.SPREAD_READS["aligned"])
    return report(sig.spread(st, "aligned").select("stock_a", "stock_b", "signal_mean", "signal_sd"))


def q_pair_zscore(spark, sf):
    st = _stats(spark, sf, *sig.SPREAD_READS["cross"], *sig.ZSCORE_READS)
    return report(sig.zscore(sig.spread(st, "cross")).select("stock_a", "stock_b", "z_score"))


def q_pair_verdicts(spark, sf):
    return report(_verdicts(spark, sf))


def q_pair_verdicts_walk(spark, sf):
    return report(_verdicts(spark, sf, WALK_CROSS))


def q_pair_verdicts_walk_aligned(spark, sf):
    return report(_verdicts(spark, sf, WALK_ALIGNED))


def q_pair_verdicts_date(spark, sf):
    return report(_verdicts(spark, sf, DATE_ALIGNED))


def q_pairs_tradeable(spark, sf):
    return report(_tradeable(spark, sf))


def q_pair_analysis(spark, sf):
    """What the per-pair routine returns for tradeable pairs."""
    t = _tradeable(spark, sf)
    return report(t.select("stock_a", "stock_b", "date", "close_a", "close_b", "z_score", "beta",
                           "signal_mean", "signal_sd"))


def q_pair_analysis_walk(spark, sf):
    t = _tradeable(spark, sf, WALK_CROSS)
    return report(t.select("stock_a", "stock_b", "date", "close_a", "close_b", "z_score", "beta",
                           "signal_mean", "signal_sd"))


# --------------------------------------------------------------------------
# sinks
# --------------------------------------------------------------------------

def q_signals_table(spark, sf):
    return report(sig.signal_rows(_tradeable(spark, sf)))


def q_signals_write_tradeable(spark, sf):
    """Write the tradeable pairs to a fresh signal table, read it back."""
    tbl = store.VersionedTable(spark, scratch_path(spark, "signals"), sort_by=("stock_a", "date"))
    v = tbl.write(report(sig.signal_rows(_tradeable(spark, sf))))
    return tbl.read(v)


def q_signals_search(spark, sf):
    """Search of the written signal table by stock and year: both conditions
    reach the scan of the table, which is sorted by stock."""
    rows = q_signals_write_tradeable(spark, sf)
    return store.index_search_eq(store.index_search_eq(rows, "stock_a", SEARCH_STOCK), "year", SEARCH_SIGNAL_YEAR)


# --------------------------------------------------------------------------
# key/value bucket and bar store
# --------------------------------------------------------------------------

def q_kv_scan_all(spark, sf):
    return store.kv_scan(bucket(spark, sf))


def q_kv_get(spark, sf):
    out = store.kv_get(bucket(spark, sf, ONE_KEY), ONE_KEY, T.StructType([T.StructField("k", T.LongType())]))
    return out.select("key", F.col("value.k").alias("k"))


def q_kv_get_stored(spark, sf):
    """S11 on a written bucket: its Bloom filter on the key skips row groups."""
    tbl = store.VersionedTable(spark, scratch_path(spark, "bucket"), bloom=("key",))
    tbl.write(bucket(spark, sf))
    out = store.kv_get(tbl.read(), ONE_KEY, T.StructType([T.StructField("k", T.LongType())]))
    return out.select("key", F.col("value.k").alias("k"))


def q_kv_upsert(spark, sf):
    """S10 applied as a log: each event puts its props under its user id, in
    time order (ties by event id); the last put of each user wins."""
    ev = table(spark, sf, "events")
    late = F.coalesce(F.col("ts") >= F.lit(DELETE_BEFORE).cast("timestamp_ntz"), F.lit(False))

    def puts(df):
        return df.select(F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"),
                         F.struct("ts", "event_id").alias("_seq"))

    return store.kv_put(store.kv_put(None, puts(ev.where(~late)), "_seq"), puts(ev.where(late)), "_seq")


def _delete_keys(spark, sf):
    ev = table(spark, sf, "events")
    return ev.where(F.col("event_type") == F.lit(DELETE_EVENT_TYPE)).select(F.col("event_id").cast("string")
                                                                            .alias("key"))


def q_kv_delete(spark, sf):
    return store.kv_delete(bucket(spark, sf), _delete_keys(spark, sf))


def q_kv_delete_confirm(spark, sf):
    """Of the keys asked for, only those of early events are deleted."""
    early = table(spark, sf, "events").where(F.col("ts") < F.lit(DELETE_BEFORE).cast("timestamp_ntz")).select(
        F.col("event_id").cast("string").alias("key"))
    asked = _delete_keys(spark, sf)
    after = store.kv_delete(bucket(spark, sf), asked.join(early, "key", "left_semi"))
    return store.kv_delete_confirm(after, asked)


def q_kv_delete_all(spark, sf):
    tbl = store.VersionedTable(spark, scratch_path(spark, "bucket"))
    tbl.write(bucket(spark, sf))
    return store.kv_delete_all(tbl)


def q_kv_truncate(spark, sf):
    tbl = store.VersionedTable(spark, scratch_path(spark, "bucket"))
    before = tbl.read(tbl.write(bucket(spark, sf)))
    after = tbl.read(store.kv_truncate(tbl))
    marks = (before.select(F.lit(1).alias("before"), F.lit(0).alias("after"))
             .unionByName(after.select(F.lit(0).alias("before"), F.lit(1).alias("after"))))
    return marks.agg(F.coalesce(F.sum("before"), F.lit(0)).cast("long").alias("n_before"),
                     F.coalesce(F.sum("after"), F.lit(0)).cast("long").alias("n_after"))


def _documents(spark, sf):
    return store.bar_documents(bars(spark, sf))


def q_bars_documents(spark, sf):
    return _documents(spark, sf)


def q_index_search_eq(spark, sf):
    # The year as a range of dates, which the scan of the source can use.
    year = bars_in_range(bars(spark, sf), dt.date(SEARCH_YEAR, 1, 1), dt.date(SEARCH_YEAR, 12, 31))
    return store.index_search_eq(store.bar_documents(year), "year_int", SEARCH_YEAR).select("key", "doc")


def q_index_search_range(spark, sf):
    """The search reads the stored bars, whose months are partitions."""
    lo, hi = SEARCH_MONTHS
    tbl = store.PartitionedTable(spark, scratch_path(spark, "bars"), schemas.BARS)
    tbl.upsert(bars(spark, sf))
    months = store.index_search_range(tbl.read(with_parts=True), "month", lo, hi)
    return store.bar_documents(months).select("key", "doc")


def q_scalar_calendar_key(spark, sf):
    b = bars(spark, sf)
    iso = iso_date(F.col("date"))
    return b.select(record_key(F.col("ticker"), iso).alias("key"), iso.alias("date_iso"),
                    *date_parts(F.col("date")),
                    date_from_iso_parts(iso).alias("date_rebuilt"),
                    F.date_sub(F.col("date"), OVERLAP_DAYS).alias("date_minus_overlap"))


def _initial_and_refresh(spark, sf):
    src = bars(spark, sf)
    initial = ingest.load_bars(src, universe(spark, sf), None, AS_OF.date())
    meta = ingest.update_record(spark, AS_OF)
    return src, initial, meta


def _corrected(batch):
    """A refresh whose closes differ from the stored ones (each is raised by
    one), so that a merge that keeps the wrong row shows."""
    return batch.withColumn("close", F.col("close") + F.lit(1.0))


def q_bars_upsert(spark, sf):
    """S3: initial load up to the update day, then the refresh batch from
    five days before it; ``batch`` tells which load each stored row came from."""
    src, initial, meta = _initial_and_refresh(spark, sf)
    batch = _corrected(ingest.refresh_batch(src, meta, universe(spark, sf), OVERLAP_DAYS))
    merged = store.upsert(initial.withColumn("batch", F.lit(1)), batch.withColumn("batch", F.lit(2)),
                          ["ticker", "date"])
    return report(merged)


def q_bars_load_one_ticker(spark, sf):
    lines = table(spark, sf, "lineitem").where(F.col("l_suppkey") == F.lit(int(ONE_TICKER)))
    loaded = ingest.load_bars(bars_from_lineitem(lines), ticker=ONE_TICKER)
    counts = ingest.load_counts(loaded)
    want = spark.range(1).select(F.lit(ONE_TICKER).alias("ticker"))
    return (want.join(counts, "ticker", "left")
            .select("ticker", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows")))


def listed_universe(spark: SparkSession, sf: str) -> DataFrame:
    """A universe that is larger than the bars: suppliers, then a ticker named after each nation, which has no bars."""
    nations = table(spark, sf, "nation").select(
        (F.lit(1 << 40) + F.col("n_nationkey")).alias("pos"), F.col("n_name").alias("ticker"), F.col("n_name").alias("name"))
    return universe(spark, sf).unionByName(nations)


def q_load_report(spark, sf):
    """S5 of a load of all bars, without a start date; ``not_added`` are entries without any bar."""
    listed = listed_universe(spark, sf)
    return ingest.load_report(ingest.load_bars(bars(spark, sf), listed), listed)


def q_load_report_files(spark, sf):
    """S4 + S5 from a file for each ticker. In the files of one nation's
    suppliers, the last line has no number as its close."""
    broken = table(spark, sf, "supplier").where(F.col("s_nationkey") == F.lit(BROKEN_NATION)).select(
        F.col("s_suppkey").cast("string").alias("ticker"), F.lit(True).alias("_broken"))
    b = bars(spark, sf)
    last = b.groupBy("ticker").agg(F.max("date").alias("_last")).join(broken, "ticker", "left")
    close = F.when(F.col("_broken") & (F.col("date") == F.col("_last")), F.lit("n/a")).otherwise(F.col("close").cast("string"))
    lines = b.join(last, "ticker").select("ticker", "date", F.concat_ws(",", iso_date(F.col("date")), "open", "high", "low",
                                                                      close, "volume").alias("line"))
    root = scratch_path(spark, "ticker-files")
    lines.repartition("ticker").sortWithinPartitions("ticker", "date").select("ticker", "line").write.partitionBy(
        "ticker").text(root)
    loaded, failures = load_bar_files(spark, root)
    stored = SummarizedBars(spark, scratch_path(spark, "bars"), schemas.BARS)
    stored.upsert(loaded)
    listed = listed_universe(spark, sf)
    counts = stored.profile().select("ticker", F.col("n_bars").alias("n_rows"))
    return with_reasons(ingest.report_of_counts(counts, listed), failures)


def q_full_load_counts(spark, sf):
    loaded = ingest.load_bars(bars(spark, sf), universe(spark, sf))
    return ingest.load_counts(loaded).select("ticker", F.col("n_rows").cast("long").alias("n_rows"))


def q_watermark_write(spark, sf):
    """The update record after a full load, stamped with the newest bar
    date of the load, written as a new meta version and read back."""
    loaded = ingest.load_bars(bars(spark, sf), universe(spark, sf))
    rec = ingest.update_record(spark, source=loaded)
    tbl = store.VersionedTable(spark, scratch_path(spark, "meta"))
    v = tbl.write(store.upsert(None, rec, ["key"]))
    return tbl.read(v).select("key", "updated_at", "value")


def q_incremental_refresh(spark, sf):
    """The bars re-loaded by the nightly refresh."""
    src, _, meta = _initial_and_refresh(spark, sf)
    return report(ingest.refresh_batch(src, meta, universe(spark, sf), OVERLAP_DAYS))


def q_nightly_pipeline(spark, sf):
    """Refresh the stored bars, then analyse: the tradeable signal rows."""
    from pairsignals.plans.nightly import nightly
    src, initial, meta = _initial_and_refresh(spark, sf)
    return report(nightly(spark, initial, _corrected(src), meta, STATS, universe(spark, sf), OVERLAP_DAYS))


def q_incremental_refresh_stream(spark, sf):
    """Streaming form of the refresh: the initial load and the refresh batch
    land as files, an available-now stream upserts each into the table."""
    from pairsignals.streaming.refresh import run_refresh_stream
    src, initial, meta = _initial_and_refresh(spark, sf)
    batch = ingest.refresh_batch(src, meta, universe(spark, sf), OVERLAP_DAYS)
    return report(run_refresh_stream(spark, [initial, _corrected(batch)]))


def _stored_bars(spark, sf):
    """The bar store with its summaries, after the initial load and the
    (corrected) refresh."""
    src, initial, meta = _initial_and_refresh(spark, sf)
    stored = SummarizedBars(spark, scratch_path(spark, "bars"), schemas.BARS)
    stored.upsert(initial)
    stored.upsert(_corrected(ingest.refresh_batch(src, meta, universe(spark, sf), OVERLAP_DAYS)))
    return stored


def q_stored_profile(spark, sf):
    """A1 + A2 of the stored bars, from the summaries that the upserts keep."""
    return report(_stored_bars(spark, sf).profile())


def q_stored_window(spark, sf):
    """P3-P6 of the stored bars: filters on summaries, windows from the months they need."""
    w = _stored_bars(spark, sf).window(WINDOW_OFFSET)
    return report(w.select("ticker", F.col("i").cast("long").alias("i"), "date", F.col("v").alias("close"), "volume"))


def q_stored_series_signals(spark, sf):
    """Two analyses (spreads, levels and windows differ) over one table of
    eligible series, which is removed when both are written."""
    with analysis.store_series(_stored_bars(spark, sf), STATS, SHARED) as series:
        made = [analysis.stored_signals(series, c).withColumn("analysis", F.lit(n))
                for n, c in (("cross", STATS), ("aligned", SHARED))]
        tbl = store.VersionedTable(spark, scratch_path(spark, "signals"), sort_by=("stock_a", "date"))
        return report(tbl.read(tbl.write(made[0].unionByName(made[1]))))


def q_signals_refreshed(spark, sf):
    """Signals after a night in which the newest days of some tickers were
    corrected: pairs of unchanged windows keep theirs."""
    stored = SummarizedBars(spark, scratch_path(spark, "bars"), schemas.BARS)
    src = bars(spark, sf)
    stored.upsert(ingest.load_bars(src, universe(spark, sf)))
    before = analysis.store_series(stored, STATS)
    tbl = store.VersionedTable(spark, scratch_path(spark, "signals"), sort_by=("stock_a", "date"))
    signals = tbl.read(tbl.write(analysis.stored_signals(before, STATS)))
    some = table(spark, sf, "supplier").where(F.col("s_nationkey").isin(list(CORRECTED_NATIONS))).select(
        F.col("s_suppkey").cast("string").alias("ticker"))
    stored.upsert(_corrected(ingest.refresh_batch(src, ingest.update_record(spark, AS_OF), some, OVERLAP_DAYS)))
    return report(analysis.refreshed_signals(analysis.store_series(stored, STATS), before, signals, STATS))


def q_windows_stream(spark, sf):
    """W2 by a stream with state: the newest bars of every ticker after the
    initial load and, from the checkpoint, the refresh."""
    from pairsignals.streaming.windows import run_windows_stream
    src, initial, meta = _initial_and_refresh(spark, sf)
    batch = ingest.refresh_batch(src, meta, universe(spark, sf), OVERLAP_DAYS)
    w = run_windows_stream(spark, [initial, _corrected(batch)], STATS.trim)
    return report(w.select("ticker", F.col("rk").cast("long").alias("rk"), "date", "close", "volume"))


QUERIES: dict[str, Query] = {
    "windows_stream": q_windows_stream,
    "stored_profile": q_stored_profile,
    "stored_window": q_stored_window,
    "stored_series_signals": q_stored_series_signals,
    "signals_refreshed": q_signals_refreshed,
    "universe_scan": q_universe_scan,
    "universe_first_n": q_universe_first_n,
    "bars_scan_range": q_bars_scan_range,
    "series_profile": q_series_profile,
    "filter_min_history": q_filter_min_history,
    "filter_min_volume": q_filter_min_volume,
    "series_ranked": q_series_ranked,
    "series_trimmed": q_series_trimmed,
    "analysis_window": q_analysis_window,
    "series_latest": q_series_latest,
    "series_scan": q_series_scan,
    "series_scan_whole": q_series_scan,
    "pairs_all": q_pairs_all,
    "pairs_aligned_rank": q_pairs_aligned_rank,
    "pairs_aligned_date": q_pairs_aligned_date,
    "pair_ols": q_pair_ols,
    "pair_residuals": q_pair_residuals,
    "pair_adf_t": q_pair_adf_t,
    "adf_critical_values": q_adf_critical_values,
    "pair_cointegration": q_pair_cointegration,
    "pair_spread_cross": q_pair_spread_cross,
    "pair_spread_aligned": q_pair_spread_aligned,
    "pair_zscore": q_pair_zscore,
    "pair_verdicts": q_pair_verdicts,
    "pair_verdicts_walk": q_pair_verdicts_walk,
    "pair_verdicts_walk_aligned": q_pair_verdicts_walk_aligned,
    "pair_verdicts_date": q_pair_verdicts_date,
    "pair_verdicts_pegged": q_pair_verdicts_pegged,
    "pairs_tradeable": q_pairs_tradeable,
    "pair_analysis": q_pair_analysis,
    "pair_analysis_walk": q_pair_analysis_walk,
    "signals_table": q_signals_table,
    "signals_write_tradeable": q_signals_write_tradeable,
    "signals_search": q_signals_search,
    "kv_scan_all": q_kv_scan_all,
    "kv_get": q_kv_get,
    "kv_get_stored": q_kv_get_stored,
    "kv_upsert": q_kv_upsert,
    "kv_delete": q_kv_delete,
    "kv_delete_confirm": q_kv_delete_confirm,
    "kv_delete_all": q_kv_delete_all,
    "kv_truncate": q_kv_truncate,
    "bars_documents": q_bars_documents,
    "index_search_eq": q_index_search_eq,
    "index_search_range": q_index_search_range,
    "scalar_calendar_key": q_scalar_calendar_key,
    "bars_upsert": q_bars_upsert,
    "bars_load_one_ticker": q_bars_load_one_ticker,
    "load_report": q_load_report,
    "load_report_whole": q_load_report,
    "load_report_files": q_load_report_files,
    "full_load_counts": q_full_load_counts,
    "full_load_counts_whole": q_full_load_counts,
    "watermark_write": q_watermark_write,
    "incremental_refresh": q_incremental_refresh,
    "nightly_pipeline": q_nightly_pipeline,
    "incremental_refresh_stream": q_incremental_refresh_stream,
}
