"""Bars from one file or several per ticker, with failures as rows.

A source of many files has broken ones: a truncated download, an error page in
place of a table. The original job swallows such a failure and counts the
ticker as not added. Here a file gives either all of its bars or one row with
the reason, and the load report names it; the other files load.

Files lie below ``<root>/ticker=<ticker>/`` as comma-separated lines of date,
open, high, low, close and volume, with or without a header line, plain or
gzipped. Spark lists and reads them (any store it knows) and packs them into
tasks; a file is parsed as a whole by the task that read it, so it must fit a
worker. An empty number is NULL; ``NaN`` is NaN. A file of no bytes counts as
none: Spark does not read it.
"""

from __future__ import annotations

import gzip
import io
import sys
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsignals import schemas
from pairsignals.session import scratch_path

NUMBERS = ["open", "high", "low", "close", "volume"]
FIELDS = ["date", *NUMBERS]
NO_FILE = "no file"
#: What a file gives: bars (``reason`` NULL) or one row with the reason.
PARSED = T.StructType([*(T.StructField(f.name, f.dataType) for f in schemas.BARS.fields),
                       T.StructField("reason", T.StringType())])


class BadFile(ValueError):
    """Why a file gives no bars."""


def parse(path: str, content: bytes) -> pd.DataFrame:
    """The bars of one file; raises ``BadFile``."""
    try:
        data = gzip.decompress(content) if path.endswith(".gz") else content
        text = data.decode("utf-8")
    except (OSError, EOFError, UnicodeDecodeError) as error:
        raise BadFile(f"unreadable: {type(error).__name__}") from None
    lines = text.splitlines()
    header = 1 if lines and lines[0].replace(" ", "").lower() == ",".join(FIELDS) else 0
    for i, line in enumerate(lines[header:], header + 1):
        if line.count(",") != len(NUMBERS):
            raise BadFile(f"line {i}: {line.count(',') + 1} fields instead of {len(FIELDS)}")
    if len(lines) == header:
        raise BadFile("no rows")
    rows = pd.read_csv(io.StringIO("\n".join(lines[header:])), header=None, names=FIELDS, dtype=str, keep_default_na=False)

    def check(name: str, wrong: pd.Series, given: pd.Series, kind: str) -> None:
        if wrong.any():
            at = int(wrong.to_numpy().argmax())
            raise BadFile(f"line {at + header + 1}: {name} is not a {kind}: '{given.iloc[at]}'")

    dates = pd.to_datetime(rows["date"], format="%Y-%m-%d", errors="coerce")
    check("date", dates.isna(), rows["date"], "date")
    out = pd.DataFrame({"date": dates.dt.date})
    for name in NUMBERS:
        numbers = pd.to_numeric(rows[name], errors="coerce")
        if not numbers.isna().any():
            out[name] = numbers.astype(float)
            continue
        given = rows[name].str.strip()
        numbers = pd.to_numeric(given, errors="coerce")
        check(name, numbers.isna() & (given != "") & (given.str.lower() != "nan"), given, "number")
        # NaN where NaN is written, NULL where nothing is.
        out[name] = numbers.astype(object).where(given != "", None)
    return out


def parsed_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each file (``path``, ``ticker``, ``content``) as its bars or its reason."""
    for batch in batches:
        for path, ticker, content in zip(batch["path"], batch["ticker"], batch["content"]):
            try:
                rows = parse(path, content)
                rows["reason"] = None
            except BadFile as error:
                rows = pd.DataFrame([[None] * len(FIELDS) + [str(error)]], columns=[*FIELDS, "reason"])
            rows.insert(0, "ticker", unquote(ticker))
            yield rows[PARSED.names]


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def load_bar_files(spark: SparkSession, root: str, staging: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Bars of all files, and failures (``ticker``, ``reason``; the first
    reason by the alphabet where several files of a ticker fail).

    A ticker with a failed file gives no bars: its other files could be half
    of a history. The files are read and parsed once, into ``staging``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.select("path", F.regexp_extract("path", r"/ticker=([^/]*)/", 1).alias("ticker"), "content")
    staging = staging or scratch_path(spark, "bar-files")
    named.mapInPandas(parsed_files, PARSED).write.parquet(staging)
    parsed = spark.read.schema(PARSED).parquet(staging)
    failures = parsed.where(F.col("reason").isNotNull()).groupBy("ticker").agg(F.min("reason").alias("reason"))
    bars = parsed.where(F.col("reason").isNull()).join(failures, "ticker", "left_anti").select(*schemas.BAR_COLUMNS)
    return bars, failures


def with_reasons(report: DataFrame, failures: DataFrame) -> DataFrame:
    """A load report with the ``reason`` of each ``not_added`` ticker."""
    return report.join(failures, "ticker", "left").withColumn("reason", F.when(
        F.col("status") == "not_added", F.coalesce("reason", F.lit(NO_FILE))))
