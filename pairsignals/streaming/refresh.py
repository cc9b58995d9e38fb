"""Streaming form of the nightly refresh.

Bar files land in a folder; an available-now stream picks up what is new and
``foreachBatch`` upserts each micro-batch into the months of the bar table
that it touches. A replayed micro-batch upserts the same rows again, so a
retry after a lost executor or driver gives the same table. Every row keeps
its ``load_id``; a later load wins in whatever order the loads arrive.
No watermark or state store is needed: the key dedupe lives in the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsignals import schemas
from pairsignals.operators.store import PartitionedTable, upsert_by_load
from pairsignals.session import scratch_path

LANDED = T.StructType(schemas.BARS.fields + [T.StructField("load_id", T.LongType(), False)])


def land(batch: DataFrame, landing: str, load_id: int) -> None:
    """Write one load as files into the landing folder."""
    (batch.select(*schemas.BAR_COLUMNS).withColumn("load_id", F.lit(load_id).cast("long"))
     .write.mode("errorifexists").parquet(f"{landing.rstrip('/')}/load-{load_id:06d}"))


def start_refresh_stream(spark: SparkSession, landing: str, table: PartitionedTable, checkpoint: str):
    """Start the stream; returns the ``StreamingQuery`` (available-now)."""
    source = (spark.readStream.schema(LANDED).option("recursiveFileLookup", "true")
              .parquet(landing))

    def merge(batch: DataFrame, epoch_id: int) -> None:
        table.upsert(batch, merge=upsert_by_load)

    return (source.writeStream.foreachBatch(merge)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start())


def run_refresh_stream(spark: SparkSession, loads: Sequence[DataFrame]) -> DataFrame:
    """Land ``loads`` in order, run the stream to completion, return the table."""
    landing = scratch_path(spark, "landing")
    table = PartitionedTable(spark, scratch_path(spark, "bars"), LANDED)
    for i, df in enumerate(loads, start=1):
        land(df, landing, i)
    query = start_refresh_stream(spark, landing, table, scratch_path(spark, "stream-ckpt"))
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    out = table.read()
    if out is None:
        return spark.createDataFrame([], schemas.BARS)
    return out.select(*schemas.BAR_COLUMNS)
