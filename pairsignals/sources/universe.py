"""Universe of tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsignals import schemas


def read_universe_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Header-less tab-separated file: column 0 ticker, column 1 name.

    ``pos`` keeps file order (increasing, not dense) so "first N" means the
    first N lines of the file. Blank tickers are dropped and a ticker listed
    twice keeps its first position.
    """
    raw = (spark.read.schema(schemas.UNIVERSE_FILE)
           .option("sep", "\t").option("header", "false").option("mode", "PERMISSIVE")
           .csv(path)
           .withColumn("pos", F.monotonically_increasing_id()))
    cleaned = raw.where(F.col("ticker").isNotNull() & (F.trim("ticker") != ""))
    return (cleaned.groupBy("ticker")
            .agg(F.min_by(F.struct("pos", "name"), "pos").alias("first"))
            .select(F.col("first.pos").alias("pos"), "ticker", F.col("first.name").alias("name")))


def universe_from_supplier(supplier: DataFrame) -> DataFrame:
    """Adapter: suppliers play tickers, ``s_suppkey`` order is file order."""
    return supplier.select(
        F.col("s_suppkey").cast("long").alias("pos"),
        F.col("s_suppkey").cast("string").alias("ticker"),
        F.col("s_name").alias("name"),
    )


def first_n(universe: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` tickers by file position (top-k, not a global sort)."""
    if n is None:
        return universe
    return universe.orderBy("pos").limit(n)
