"""Command-line jobs for spark-submit: full load, refresh, analyze, nightly.

    spark-submit --py-files pairsignals.zip pairsignals/jobs.py full-load \\
        --store s3://bucket/pairs --source s3://bucket/bars --universe s3://bucket/tickers.tsv
    ... refresh  --store ... --source ...            (re-load from last update - 5 days)
    ... analyze  --store ... [--min-days 2000 --min-mean-volume 20000 --ndays 100 ...]
    ... nightly  --store ... --source ...            (refresh, then analyze)

The store root holds ``bars`` (partitioned by year and month, sorted by
ticker, with summaries by ticker and month) and three versioned tables,
``meta`` (update and analysis records), ``series`` (eligible series of the last
analyses) and ``signals`` (sorted by stock, so a search by stock skips row
groups).
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession

from pairsignals.config import AnalysisConfig
from pairsignals.operators.store import VersionedTable, upsert
from pairsignals.operators.summaries import SummarizedBars
from pairsignals.plans import ingest
from pairsignals.plans.nightly import analysis_job
from pairsignals.schemas import BARS
from pairsignals.sources.bars import read_bars
from pairsignals.sources.universe import first_n, read_universe_tsv


class Store:
    def __init__(self, spark: SparkSession, root: str):
        root = root.rstrip("/")
        self.bars = SummarizedBars(spark, f"{root}/bars", BARS)
        self.meta = VersionedTable(spark, f"{root}/meta")
        self.signals = VersionedTable(spark, f"{root}/signals", sort_by=("stock_a", "date"),
                                      bloom=("stock_a", "stock_b"))
        self.series = VersionedTable(spark, f"{root}/series", sort_by=("blk", "ticker"))


def _universe(spark, args):
    if not args.universe:
        return None
    return first_n(read_universe_tsv(spark, args.universe), args.limit)


def full_load(spark, args) -> int:
    st = Store(spark, args.store)
    src = read_bars(spark, args.source, args.format)
    loaded = ingest.load_bars(src, _universe(spark, args), args.start, _end(args))
    seen = st.bars.upsert(loaded)
    print(f"loaded {seen['rows']} bars from {seen['first']} to {seen['last']}")
    return st.meta.write(upsert(st.meta.read(), ingest.update_record(spark, _now(args)), ["key"]))


def refresh(spark, args) -> int:
    st = Store(spark, args.store)
    meta = st.meta.read()
    if not st.bars.exists() or meta is None:
        raise SystemExit("no stored bars or update record: run full-load first")
    src = read_bars(spark, args.source, args.format)
    st.bars.upsert(ingest.refresh_batch(src, meta, _universe(spark, args), args.overlap, _end(args)))
    return st.meta.write(upsert(meta, ingest.update_record(spark, _now(args)), ["key"]))


def analyze(spark, args) -> int:
    st = Store(spark, args.store)
    if not st.bars.exists():
        raise SystemExit("no stored bars: run full-load first")
    cfg = AnalysisConfig(min_days=args.min_days, min_mean_volume=args.min_mean_volume, ndays=args.ndays,
                         begin_day=args.begin_day, z_thresh=args.z_thresh, crit_level=args.level,
                         spread=args.spread, align=args.align, min_overlap=args.min_overlap).validate()
    return analysis_job(spark, st.bars, st.meta, st.signals, st.series, cfg, _universe(spark, args), _now(args))


def _end(args) -> str:
    return args.end or _now(args).date().isoformat()


def _now(args) -> dt.datetime:
    return dt.datetime.fromisoformat(args.now) if args.now else dt.datetime.now().replace(second=0, microsecond=0)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairsignals.jobs")
    p.add_argument("command", choices=["full-load", "refresh", "analyze", "nightly"])
    p.add_argument("--store", required=True)
    p.add_argument("--source")
    p.add_argument("--format", default="parquet")
    p.add_argument("--universe")
    p.add_argument("--limit", type=int, default=None, help="first N tickers of the universe")
    p.add_argument("--start")
    p.add_argument("--end", help="last day to load; default: the day of --now")
    p.add_argument("--overlap", type=int, default=5)
    p.add_argument("--now", help="update time to record (ISO); default: now")
    p.add_argument("--min-days", type=int, default=2000)
    p.add_argument("--min-mean-volume", type=float, default=20000.0)
    p.add_argument("--ndays", type=int, default=100)
    p.add_argument("--begin-day", type=int, default=0)
    p.add_argument("--z-thresh", type=float, default=2.0)
    p.add_argument("--level", default="5%")
    p.add_argument("--spread", default="cross")
    p.add_argument("--align", default="rank")
    p.add_argument("--min-overlap", type=int, default=10)
    return p


def run(spark: SparkSession, argv: list[str]) -> int:
    args = parser().parse_args(argv)
    if args.command in ("full-load", "refresh", "nightly") and not args.source:
        raise SystemExit("--source is required")
    if args.command == "full-load":
        return full_load(spark, args)
    if args.command == "refresh":
        return refresh(spark, args)
    if args.command == "analyze":
        return analyze(spark, args)
    refresh(spark, args)
    return analyze(spark, args)


DEBUGGING_CONF = "spark.python.sql.dataFrameDebugging.enabled"


def main() -> None:
    import sys
    spark = SparkSession.builder.appName("pairsignals").getOrCreate()
    if spark.conf.get(DEBUGGING_CONF, None) is None:
        # before any column is built: call-site capture is costly here
        spark.conf.set(DEBUGGING_CONF, "false")
    version = run(spark, sys.argv[1:])
    print(f"wrote version {version}")


if __name__ == "__main__":
    main()
