"""Newest bars of each ticker as a stream with state (W2 over arriving bars).

Bars arrive in any order, corrections among them. The state of a ticker holds
its newest ``n`` bars by date (one value of arrays); a bar of a date that it
holds replaces it if its load is not older, a bar older than all ``n`` is of
no use, and the oldest goes when there are too many. Every batch emits the
whole window of the tickers it touched, so the last rows of a ticker are its
window now. State is bounded by tickers x n, and lives in the state store,
with a changelog in the checkpoint folder: a restart goes on from there. A NaN
value counts as NULL (pandas has one missing number), as in any window.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pairsignals.session import scratch_path
from pairsignals.streaming.refresh import LANDED, land

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOWS = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("rk", T.IntegerType()),
    T.StructField("date", T.DateType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
    T.StructField("load_id", T.LongType()),
])
#: The state of a ticker: its bars as one value of arrays, so a batch reads and writes it in one call each.
HELD = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in WINDOWS.fields[2:]])


class NewestBars(StatefulProcessor):
    """The newest ``n`` bars of one ticker."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("newest", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        stored = self.held.get()
        held = {date: tuple(row) for date, *row in zip(*stored)} if stored else {}
        before = dict(held)
        for batch in rows:
            if len(batch) > self.n:  # of one batch, too, only the newest n dates can stay
                last = sorted(set(batch["date"]), reverse=True)[:self.n][-1]
                batch = batch[(batch["date"] >= last).to_numpy()]
            for date, close, volume, load in zip(batch["date"], batch["close"], batch["volume"], batch["load_id"]):
                row = (none(close), none(volume), int(load))
                # Of one load, the larger values win, in whatever order they come.
                if date not in held or order(row) > order(held[date]):
                    held[date] = row
            if len(held) > 4 * self.n:
                held = newest(held, self.n)
        held = newest(held, self.n)
        if held != before:
            self.held.update(tuple(map(list, zip(*((date, *row) for date, row in held.items())))))
        yield pd.DataFrame([(key[0], rk, date, *held[date]) for rk, date in enumerate(sorted(held, reverse=True), 1)],
                           columns=WINDOWS.names)

    def close(self) -> None:
        pass


def none(value) -> float | None:
    return None if value is None or value != value else float(value)


def order(row: tuple) -> tuple:
    """Loads first, then the values, as the batch upsert orders them."""
    close, volume, load = row
    return load, close is not None, close or 0.0, volume is not None, volume or 0.0


def newest(held: dict, n: int) -> dict:
    return {d: held[d] for d in sorted(held, reverse=True)[:n]}


def start_windows_stream(spark: SparkSession, landing: str, out: str, checkpoint: str, n: int):
    """Start the stream (available-now): bar files that landed since the last
    run update the windows, which go to ``out``, one set of rows for each
    ticker and batch, with the batch's number."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    source = spark.readStream.schema(LANDED).option("recursiveFileLookup", "true").parquet(landing)
    windows = source.select("ticker", "date", "close", "volume", "load_id").groupBy("ticker").transformWithStateInPandas(
        NewestBars(n), WINDOWS, outputMode="Update", timeMode="None")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{out}/epoch-{epoch:09d}")

    return (windows.writeStream.foreachBatch(write).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_windows(spark: SparkSession, out: str) -> DataFrame:
    """Each ticker's window after the last batch that touched it."""
    rows = spark.read.schema(T.StructType([*WINDOWS.fields, T.StructField("epoch", T.LongType())])).option(
        "recursiveFileLookup", "true").parquet(out)
    last = rows.groupBy("ticker").agg(F.max("epoch").alias("epoch"))
    return rows.join(last, ["ticker", "epoch"], "left_semi").select(*WINDOWS.names)


def run_windows_stream(spark: SparkSession, loads: Sequence[DataFrame], n: int) -> DataFrame:
    """Land ``loads`` one by one, each followed by a run of the stream that
    goes on from the checkpoint of the run before; return the windows."""
    landing, out, checkpoint = (scratch_path(spark, name) for name in ("landing", "windows", "windows-ckpt"))
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, ROCKSDB)
    try:
        for i, df in enumerate(loads, 1):
            land(df, landing, i)
            query = start_windows_stream(spark, landing, out, checkpoint, n)
            query.awaitTermination()
            if query.exception() is not None:
                raise RuntimeError(str(query.exception()))
    finally:
        spark.conf.set(conf, before)
    return read_windows(spark, out)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
