"""Explicit schemas of every table; nothing is inferred."""

from pyspark.sql import types as T

UNIVERSE = T.StructType([
    T.StructField("pos", T.LongType(), False),
    T.StructField("ticker", T.StringType(), False),
    T.StructField("name", T.StringType(), True),
])

# Header-less tab-separated universe file: ticker, name.
UNIVERSE_FILE = T.StructType([
    T.StructField("ticker", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
])

BARS = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("open", T.DoubleType(), True),
    T.StructField("high", T.DoubleType(), True),
    T.StructField("low", T.DoubleType(), True),
    T.StructField("close", T.DoubleType(), True),
    T.StructField("volume", T.DoubleType(), True),
])

BAR_COLUMNS = [f.name for f in BARS.fields]

KV = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
])

# JSON document of the update time.
UPDATE_DOCUMENT = T.StructType([
    T.StructField("Year", T.IntegerType()),
    T.StructField("Month", T.IntegerType()),
    T.StructField("Day", T.IntegerType()),
    T.StructField("Hour", T.IntegerType()),
    T.StructField("Minute", T.IntegerType()),
])
