"""Per-series operators: profile, eligibility filters, rank, trim, window.

Covers A1-A2 (bars and mean volume per ticker), P3-P4 (strict ``>`` filters
on the whole history), W1-W2 (newest-first rank and trim), P6 (analysis
window), W4 (latest bar) and S7 (series scan).

Every per-ticker step is an aggregate with map-side partial aggregation or a
``row_number`` top-k, which Spark turns into a partial ``WindowGroupLimit``
before the shuffle for trims of up to 1,000 bars
(``spark.sql.optimizer.windowGroupLimitThreshold``), so a ticker with a huge
history does not move whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsignals.config import AnalysisConfig
from pairsignals.functions.columns import gt_not_nan
from pairsignals.sources.bars import NULL_YEAR, WALK_DECIMAL, walk_step


def series_profile(bars: DataFrame) -> DataFrame:
    """A1 + A2: bars per ticker and mean volume over the whole history."""
    return bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.avg("volume").alias("mean_volume"),
    )


def filter_min_history(profile: DataFrame, min_days: int) -> DataFrame:
    """Tickers with strictly more than ``min_days`` bars."""
    return profile.where(F.col("n_bars") > F.lit(min_days))


def filter_min_volume(profile: DataFrame, min_mean_volume: float) -> DataFrame:
    """Tickers whose mean volume is strictly above the bound; a NaN mean
    never passes (Python comparison semantics)."""
    return profile.where(gt_not_nan(F.col("mean_volume"), min_mean_volume))


def eligible_tickers(bars: DataFrame, cfg: AnalysisConfig, universe: DataFrame | None = None) -> DataFrame:
    """Tickers passing both filters, optionally limited to a universe."""
    if universe is not None:
        bars = bars.join(universe.select("ticker"), "ticker", "left_semi")
    prof = series_profile(bars)
    return filter_min_volume(filter_min_history(prof, cfg.min_days), cfg.min_mean_volume)


def _year_bucket() -> F.Column:
    """The (ticker, year) bucket of a bar; a null date gets its own bucket,
    placed where Spark sorts a null date (last newest-first, first oldest-first)."""
    return F.coalesce(F.year("date"), F.lit(NULL_YEAR))


def rank_series(bars: DataFrame) -> DataFrame:
    """``rk`` = 1 for the newest bar of each ticker, 2 for the next...

    Over the whole history, in two levels so that no task sorts a ticker's
    whole history: bars per (ticker, year) (partial aggregate), the bars in
    newer years (a window over the small per-year table), plus the
    ``row_number`` inside the (ticker, year) group."""
    b = bars.withColumn("_yr", _year_bucket())
    newer_years = (Window.partitionBy("ticker").orderBy(F.col("_yr").desc())
                   .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (b.groupBy("ticker", "_yr").agg(F.count(F.lit(1)).alias("_ny"))
               .select("ticker", "_yr", F.coalesce(F.sum("_ny").over(newer_years), F.lit(0)).alias("_off")))
    in_year = Window.partitionBy("ticker", "_yr").orderBy(F.col("date").desc())
    return (b.join(offsets, ["ticker", "_yr"], "left")
            .select(*bars.columns, (F.col("_off") + F.row_number().over(in_year)).cast("int").alias("rk")))


def trim_series(bars: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` bars of each ticker (rank filter, top-k per group).

    A single ``row_number`` window: with the ``rk <= n`` filter Spark runs a
    partial ``WindowGroupLimit`` before the shuffle, so at most ``n`` rows per
    ticker and map task move."""
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    return bars.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= F.lit(n))


def series_latest(bars: DataFrame) -> DataFrame:
    """Latest date and its close per ticker (an aggregate, no sort)."""
    return bars.groupBy("ticker").agg(
        F.max("date").alias("date"),
        F.max_by("close", "date").alias("close"),
    )


def series_scan(bars: DataFrame, universe: DataFrame | None = None, ticker: str | None = None) -> DataFrame:
    """S7 + P1: (ticker, close, volume, date) of one ticker or of a universe."""
    out = bars
    if ticker is not None:
        out = out.where(F.col("ticker") == F.lit(ticker))
    if universe is not None:
        out = out.join(universe.select("ticker"), "ticker", "left_semi")
    return out.select("ticker", "close", "volume", "date")


def analysis_window(bars: DataFrame, cfg: AnalysisConfig, universe: DataFrame | None = None,
                    value: str = "close", walk_offset: float | None = None) -> DataFrame:
    """P3-P6 in order: filter, rank, trim, slice.

    Returns ``(ticker, i, date, v, volume)`` where ``i`` = 0 is the newest
    bar of the window (position ``begin_day`` of the trimmed series) and
    ``i`` < ``cfg.window``. Only the newest ``min(ndays, min_days)`` bars are
    ranked out, so the bars between ``ndays`` and ``min_days`` are never moved.

    With ``walk_offset`` the value is the running sum of ``close - offset``
    over the whole history, computed as the ticker's total (a partial
    aggregate) minus the sum over the newer bars of the trimmed window, in
    exact decimals: no window ever spans a ticker's full history.
    """
    cfg.validate()
    if universe is not None:
        bars = bars.join(universe.select("ticker"), "ticker", "left_semi")
    prof = bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.avg("volume").alias("mean_volume"),
        F.count("close").alias("_closes"),
        *([F.sum(walk_step(walk_offset)).alias("_total"), F.count(walk_step(walk_offset)).alias("_steps")]
          if walk_offset is not None else []),
    )
    # Counting closes makes this branch read the columns of the other one, so
    # both take the bars from one exchange. The count itself decides nothing.
    ok = filter_min_volume(filter_min_history(prof, cfg.min_days), cfg.min_mean_volume).where(F.col("_closes") >= 0)
    # Trim first, then keep eligible tickers: the join then sees only
    # ``trim`` rows per ticker.
    trimmed = trim_series(bars, cfg.trim)
    if walk_offset is None:
        trimmed = trimmed.join(ok.select("ticker"), "ticker", "left_semi")
        v = F.col(value)
    else:
        trimmed = trimmed.join(ok.select("ticker", "_total", "_steps"), "ticker", "inner")
        newer = (Window.partitionBy("ticker").orderBy("rk")
                 .rowsBetween(Window.unboundedPreceding, -1))
        step = walk_step(walk_offset)
        suffix = F.coalesce(F.sum(step).over(newer), F.lit(0).cast(WALK_DECIMAL))
        # NULL when no step up to this bar is non-NULL, like the running sum
        v = F.when(F.col("_steps") - F.count(step).over(newer) > 0, F.col("_total") - suffix).cast("double")
    return sliced(trimmed, v, cfg)


def sliced(trimmed: DataFrame, v: Column, cfg: AnalysisConfig) -> DataFrame:
    """The analysis window of trimmed series (with ``rk``), ``v`` its value."""
    # A NULL value counts as NaN (no number), as numpy reads a missing
    # value, so every statistics form propagates it the same way.
    v = F.coalesce(v, F.lit(float("nan")))
    return (trimmed.withColumn("_v", v).where(F.col("rk") > F.lit(cfg.begin_day))
            .select("ticker", (F.col("rk") - F.lit(cfg.begin_day + 1)).alias("i"), "date",
                    F.col("_v").alias("v"), "volume"))
