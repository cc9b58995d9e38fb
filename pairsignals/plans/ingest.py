"""Loading bars: full load, per-ticker report, update time, nightly refresh
(S4-S6, S19-S20) and the nightly sequence (refresh, then analysis).

The original fetched one ticker per task from a web service and wrote one
document per bar; here a load is one set-based read of bar files (or of a
DataFrame produced upstream), an upsert and one table write.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsignals import schemas
from pairsignals.config import AnalysisConfig
from pairsignals.operators.store import upsert_bars
from pairsignals.sources.bars import bars_in_range
from pairsignals.sources.universe import first_n

ADDED = "added"
NOT_ADDED = "not_added"
UPDATE_KEY = "update"


def load_bars(source: DataFrame, universe: DataFrame | None = None, start=None, end=None,
              ticker: str | None = None) -> DataFrame:
    """Bars of the universe (or one ticker) in ``[start, end]``."""
    out = bars_in_range(source, start, end, universe)
    if ticker is not None:
        out = out.where(F.col("ticker") == F.lit(ticker))
    return out.select(*schemas.BAR_COLUMNS)


def load_counts(loaded: DataFrame) -> DataFrame:
    """Rows loaded per ticker (a partial aggregate)."""
    return loaded.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"))


def load_report(loaded: DataFrame, universe: DataFrame, limit: int | None = None) -> DataFrame:
    """Every universe ticker (the first ``limit`` entries when given) with
    its row count (0 when nothing was loaded) and ``added`` / ``not_added``."""
    uni = first_n(universe, limit).select("ticker")
    return report_of_counts(load_counts(loaded.join(uni, "ticker", "left_semi")), uni)


def report_of_counts(counts: DataFrame, uni: DataFrame) -> DataFrame:
    """S5 from rows loaded per ticker (``n_rows``)."""
    return (uni.select("ticker").join(counts, "ticker", "left")
            .select("ticker", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))
            .withColumn("status", F.when(F.col("n_rows") > 0, F.lit(ADDED)).otherwise(F.lit(NOT_ADDED))))


def update_record(spark, updated_at: dt.datetime | None = None, source: DataFrame | None = None) -> DataFrame:
    """The one-row meta table ``(key, updated_at, value)``.

    ``updated_at`` is an argument so runs are repeatable; without it, the
    newest bar date of ``source`` (start of that day) is used.
    """
    if updated_at is not None:
        base = spark.range(1).select(F.lit(updated_at).cast("timestamp").alias("updated_at"))
    elif source is not None:
        base = source.agg(F.max("date").cast("timestamp").alias("updated_at"))
    else:
        raise ValueError("give updated_at or source")
    ts = F.col("updated_at")
    doc = F.to_json(F.struct(
        F.year(ts).alias("Year"), F.month(ts).alias("Month"), F.dayofmonth(ts).alias("Day"),
        F.hour(ts).alias("Hour"), F.minute(ts).alias("Minute")))
    return base.select(F.lit(UPDATE_KEY).alias("key"), ts, doc.alias("value"))


ANALYSIS_KEY = "analysis"


def analysis_record(spark, cfg: AnalysisConfig, series_version: int, signals_version: int, at: dt.datetime) -> DataFrame:
    """Meta row of an analysis: its parameters, and the versions of the
    series it read and of the signals it wrote."""
    doc = json.dumps({"config": asdict(cfg), "series": series_version, "signals": signals_version}, sort_keys=True)
    return spark.range(1).select(F.lit(ANALYSIS_KEY).alias("key"), F.lit(at).cast("timestamp").alias("updated_at"),
                                 F.lit(doc).alias("value"))


def last_analysis(meta: DataFrame | None) -> dict | None:
    row = meta.where(F.col("key") == F.lit(ANALYSIS_KEY)).select("value").first() if meta is not None else None
    return json.loads(row["value"]) if row else None


def last_update(meta: DataFrame) -> dt.date | None:
    """The day in the update record's document (one row)."""
    doc = F.from_json("value", schemas.UPDATE_DOCUMENT)
    day = F.make_date(doc["Year"], doc["Month"], doc["Day"])
    row = meta.where(F.col("key") == F.lit(UPDATE_KEY)).agg(F.max(day).alias("d")).first()
    return row["d"] if row else None


def refresh_start(meta: DataFrame, overlap_days: int = 5) -> dt.date | None:
    """The last update day minus the overlap."""
    d = last_update(meta)
    return None if d is None else d - dt.timedelta(days=overlap_days)


def refresh_batch(source: DataFrame, meta: DataFrame, universe: DataFrame | None = None,
                  overlap_days: int = 5, end=None) -> DataFrame:
    """Bars to re-load, from the last update less the overlap."""
    start = refresh_start(meta, overlap_days)
    if start is None:
        raise ValueError("no update record in the meta table")
    return load_bars(source, universe, start, end)


def incremental_refresh(stored: DataFrame, source: DataFrame, meta: DataFrame,
                        universe: DataFrame | None = None, overlap_days: int = 5) -> DataFrame:
    """S20 + S3: the stored bars with the refresh batch upserted (batch wins)."""
    return upsert_bars(stored, refresh_batch(source, meta, universe, overlap_days))
