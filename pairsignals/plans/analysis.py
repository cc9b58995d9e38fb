"""The analysis job: bars -> eligible windows -> pair statistics -> verdicts.

One lazy DataFrame per call; nothing is collected. The physical plan is a
shuffle by ticker (eligibility aggregate and newest-first top-k), a block
equi-join of the per-ticker rows, and projections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsignals.config import AnalysisConfig
from pairsignals.functions.critical import CRIT_COEFFS, critical_value_py
from pairsignals.operators import signals as sig
from pairsignals.operators.kernels import DatePairFilter, PairFilter
from pairsignals.operators.pairs import block_count
from pairsignals.operators.series import analysis_window
from pairsignals.operators.stats import (date_aligned_unordered, date_block_sizes, date_block_stats, date_moment_stats,
                                         rank_aligned_unordered, stored_wide_series, two_pass_stats,
                                         wide_pair_stats, wide_stats, ZBound)
from pairsignals.operators.stored import StoredSeries, changed_tickers
from pairsignals.operators.summaries import SummarizedBars
from pairsignals.sources.universe import first_n


def window_for(bars: DataFrame, cfg: AnalysisConfig, universe: DataFrame | None = None) -> DataFrame:
    """Eligible, trimmed windows of the configured series."""
    cfg.validate()
    if universe is not None and cfg.universe_limit is not None:
        universe = first_n(universe, cfg.universe_limit)
    walk = cfg.walk_offset if cfg.series == "walk" else None
    return analysis_window(bars, cfg, universe, walk_offset=walk)


def pair_statistics(window: DataFrame, cfg: AnalysisConfig, method: str = "auto",
                    keep: PairFilter | DatePairFilter | None = None, columns: list[str] | None = None,
                    listed: bool = False) -> DataFrame:
    """Statistics of every ordered pair of eligible series, but for those
    that ``keep`` (see ``pair_filter``) rules out (one-pass kernels only).
    ``columns`` are the statistics that are read further on; the one-pass
    kernels send no others. ``listed`` (date alignment, ``adf_m`` alone): one
    row for each ticker and ``adf_m``, with an array of tickers as ``stock_b``.

    ``method``: ``two_pass`` (the readable long form) or ``auto``: for rank
    alignment the one-pass block kernel (``wide``), for any window length;
    for date alignment the one-pass block kernel
    (``date_block_stats``; ``moments`` is its Spark-operator cross-check).
    """
    spark = window.sparkSession
    b = block_count(spark, cfg)
    if listed:
        if cfg.align != "date" or set(columns or ()) != {*sig.PAIR, "adf_m"}:
            raise ValueError("only adf_m by date is listed")
        return date_block_sizes(window, b, cfg.min_overlap)
    if cfg.align == "date":
        if method == "two_pass":
            return two_pass_stats(date_aligned_unordered(window, b, cfg.min_overlap), "date", cfg.forward)
        if method == "moments":
            return date_moment_stats(window, b, cfg.min_overlap, cfg.forward)
        if method in ("auto", "wide"):
            return date_block_stats(window, b, cfg.min_overlap, cfg.forward, columns, keep)
        raise ValueError(f"unknown method {method!r}")
    n = cfg.window
    if method == "auto":
        method = "wide"
    if method == "wide":
        return wide_stats(window, n, b, cfg.forward, keep, columns)
    if method == "two_pass":
        return two_pass_stats(rank_aligned_unordered(window, b), "i", cfg.forward)
    raise ValueError(f"unknown method {method!r}")


def pair_verdicts(bars: DataFrame, cfg: AnalysisConfig, universe: DataFrame | None = None,
                  method: str = "auto") -> DataFrame:
    """A10/A11 for every ordered pair: statistics, date, closes and verdict."""
    return sig.verdicts(pair_statistics(window_for(bars, cfg, universe), cfg, method), cfg)


def tradeable_pairs(bars: DataFrame, cfg: AnalysisConfig, universe: DataFrame | None = None,
                    method: str = "auto") -> DataFrame:
    """The job's result: tradeable pairs only (P7, P8). The kernel already
    leaves out pairs that cannot be, so they are never sent from Python."""
    cfg.validate()
    return tradeable_of_window(window_for(bars, cfg, universe), cfg, method)


def tradeable_of_window(window: DataFrame, cfg: AnalysisConfig, method: str = "auto") -> DataFrame:
    """Tradeable pairs of windows that are formed already."""
    stats = pair_statistics(window, cfg, method, pair_filter(cfg), sig.verdict_reads(cfg))
    return sig.tradeable(sig.verdicts(stats, cfg))


def pair_filter(cfg: AnalysisConfig) -> PairFilter | DatePairFilter:
    """What the kernel may leave out where only tradeable pairs are asked for."""
    if cfg.align == "date":
        return DatePairFilter(CRIT_COEFFS[cfg.crit_level], cfg.z_thresh, cfg.spread)
    n = cfg.window
    return PairFilter(n, critical_value_py(cfg.crit_level, n - 1), cfg.z_thresh, cfg.spread, cfg.forward)


# --------------------------------------------------------------------------
# from the bar store and from stored series
# --------------------------------------------------------------------------

def store_series(bars: SummarizedBars, *cfgs: AnalysisConfig, universe: DataFrame | None = None,
                 path: str | None = None) -> StoredSeries:
    """The eligible series of stored bars, once for all of ``cfgs``: the
    filters read summaries, the windows read the months they need."""
    low = StoredSeries.loosest_of(*cfgs)
    ok = bars.eligible(low, universe)
    return StoredSeries.store(bars.spark, bars.newest(ok, low.trim), ok, low, path)


def stored_verdicts(series: StoredSeries, cfg: AnalysisConfig, keep: PairFilter | DatePairFilter | None = None,
                    ) -> DataFrame:
    """Every ordered pair's verdict (but for pairs that ``keep`` rules out)
    from stored series."""
    if cfg.align == "date":
        return sig.verdicts(pair_statistics(series.window(cfg), cfg, keep=keep), cfg)
    return sig.verdicts(_stored_statistics(series.select(cfg), cfg, keep), cfg)


def _stored_statistics(rows: DataFrame, cfg: AnalysisConfig, keep: PairFilter | None) -> DataFrame:
    """Rank statistics of stored rows. Where only tradeable pairs are asked
    for (``keep``), block pairs that hold none by their z are left out."""
    n, b = cfg.window, block_count(rows.sparkSession, cfg)
    wide = stored_wide_series(rows, n)
    bound = ZBound(wide, n, b, cfg.z_thresh) if keep is not None and cfg.spread == "cross" else None
    return wide_pair_stats(wide, n, b, cfg.forward, keep, bound)


def stored_tradeable(series: StoredSeries, cfg: AnalysisConfig) -> DataFrame:
    """Tradeable pairs (P7, P8) from stored series."""
    return sig.tradeable(stored_verdicts(series, cfg, pair_filter(cfg)))


def stored_signals(series: StoredSeries, cfg: AnalysisConfig) -> DataFrame:
    return sig.signal_rows(stored_tradeable(series, cfg))


def refreshed_signals(series: StoredSeries, before: StoredSeries, signals_before: DataFrame, cfg: AnalysisConfig,
                      ) -> DataFrame:
    """The signals of ``series``, given those of ``before`` under the same
    ``cfg``: signals of pairs whose windows both stayed are kept, and only
    pairs with a changed window are computed. Equal to ``stored_signals``.

    Rank alignment; by date, all pairs are computed."""
    if cfg.align == "date":
        return stored_signals(series, cfg)
    now = series.select(cfg)
    new, gone = changed_tickers(before.select(cfg), now)
    for side in ("stock_a", "stock_b"):
        signals_before = signals_before.join(gone.select(F.col("ticker").alias(side)), side, "left_anti")
    marked = now.join(new.withColumn("changed", F.lit(True)), "ticker", "left").withColumn(
        "changed", F.coalesce("changed", F.lit(False)))
    made = sig.signal_rows(sig.tradeable(sig.verdicts(_stored_statistics(marked, cfg, pair_filter(cfg)), cfg)))
    return signals_before.select(*made.columns).unionByName(made)


def signals(bars: DataFrame, cfg: AnalysisConfig, universe: DataFrame | None = None,
            method: str = "auto") -> DataFrame:
    """Typed, keyed signal rows ready for the signal table."""
    return sig.signal_rows(tradeable_pairs(bars, cfg, universe, method))
