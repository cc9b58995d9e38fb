"""Daily bar sources (S2) and the adapter from the driver tables.

A bar is one row ``(ticker, date, open, high, low, close, volume)``; the pair
(ticker, date) is the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairsignals import schemas

MONEY = "decimal(18,2)"
# Running sums are taken in decimal (exact, order-free), then back to double.
# 14 integer digits per step leave room for sums and differences of sums
# without Spark reducing the scale.
WALK_DECIMAL = "decimal(24,10)"
# The type of a sum of steps; carried sums are kept in it so adding the
# in-year sum stays at scale 10 (no precision-loss rounding).
WALK_SUM_DECIMAL = "decimal(34,10)"
# Year bucket of a null date: below every real year, as Spark sorts a null
# date first in ascending order (and last in descending order).
NULL_YEAR = -(2 ** 31)


def line_key() -> F.Column:
    """(l_orderkey, l_linenumber) as one fixed-width number with the same
    order, so the per-bar ``min_by`` keeps a fixed-width buffer and Spark can
    use hash aggregation (a struct key forces a sort aggregate). Holds any
    64-bit order key and any 32-bit line number."""
    line_numbers = F.lit(2 ** 32).cast("decimal(10,0)")
    return (F.col("l_orderkey").cast("decimal(19,0)") * line_numbers
            + F.col("l_linenumber").cast("int").cast("decimal(10,0)"))


def bars_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Adapter: one bar per (supplier, ship date).

    close = sum(price)/sum(quantity), volume = sum(quantity), low/high =
    min/max of the unit price, open = the unit price of the line with the
    smallest (l_orderkey, l_linenumber). Prices are summed as decimals, so
    the sum is exact and does not depend on the order rows arrive in.
    """
    lines = lineitem.select(
        F.col("l_suppkey").cast("string").alias("ticker"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_quantity").alias("qty"),
        F.try_divide("l_extendedprice", "l_quantity").alias("unit"),
        line_key().alias("line"),
    )
    return (lines.groupBy("ticker", "date")
            .agg(F.min_by("unit", "line").alias("open"),
                 F.max("unit").alias("high"),
                 F.min("unit").alias("low"),
                 F.try_divide(F.sum("price").cast("double"), F.sum("qty")).alias("close"),
                 F.sum("qty").cast("double").alias("volume"))
            .select(*schemas.BAR_COLUMNS))


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars from files in any Spark format with the bar schema."""
    reader = spark.read.format(fmt)
    if fmt in ("csv", "json"):
        reader = reader.schema(schemas.BARS)
        if fmt == "csv":
            reader = reader.option("header", "true")
    return reader.load(path).select(*schemas.BAR_COLUMNS)


def bars_in_range(bars: DataFrame, start=None, end=None, universe: DataFrame | None = None) -> DataFrame:
    """Bars with ``start <= date <= end`` (both optional), restricted to
    the tickers of ``universe`` when given (semi join, no columns added)."""
    out = bars
    if start is not None:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    if universe is not None:
        out = out.join(universe.select("ticker"), "ticker", "left_semi")
    return out


def walk_step(offset: float = 1500.0):
    """The exact increment of the running-sum series."""
    return (F.col("close") - F.lit(offset)).cast(WALK_DECIMAL)


def walk_bars(bars: DataFrame, offset: float = 1500.0) -> DataFrame:
    """Bars whose close is the running sum of ``close - offset`` by date.

    Used to get series that are not all cointegrated; other columns kept.
    Over the whole history, in two levels so that no task holds a ticker's
    whole history: the sum per (ticker, year) (partial aggregate), carried
    over the earlier years by a window on that small table, plus the running
    sum inside the (ticker, year) group. The steps are exact decimals, so the
    result equals the one-window running sum bit for bit. The analysis uses
    ``analysis_window(..., walk_offset=...)``, which needs only the trimmed
    rows and a per-ticker total.
    """
    step = walk_step(offset)
    b = bars.withColumn("_yr", F.coalesce(F.year("date"), F.lit(NULL_YEAR)))
    earlier = (Window.partitionBy("ticker").orderBy("_yr")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = (b.groupBy("ticker", "_yr").agg(F.sum(step).alias("_ys"))
             .select("ticker", "_yr", F.sum("_ys").over(earlier).cast(WALK_SUM_DECIMAL).alias("_carry")))
    in_year = (Window.partitionBy("ticker", "_yr").orderBy("date")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    so_far = F.sum(step).over(in_year)
    zero = F.lit(0).cast(WALK_SUM_DECIMAL)
    # NULL only when every step so far is NULL, like the one-window sum
    walked = F.when(F.col("_carry").isNull() & so_far.isNull(), F.lit(None)).otherwise(
        F.coalesce(F.col("_carry"), zero) + F.coalesce(so_far, zero)).cast("double")
    return (b.join(carry, ["ticker", "_yr"], "left")
            .select(*[walked.alias(c) if c == "close" else F.col(c) for c in bars.columns]))
