"""Pair formation (J1, J2, J5) without a cartesian product.

Tickers are hashed into ``B`` blocks. Every row of a ticker in block ``g`` is
sent, as the left side, to the block pairs ``(g, h)`` with ``h >= g`` and, as
the right side, to ``(h, g)`` with ``h <= g``. An equi-join on the block pair
(plus the alignment key, if any) then meets every unordered ticker pair
exactly once: across blocks all combinations, inside a block only
``a < b``. Each join key holds at most one block per side, so the work of a
task is bounded by the block size, never by the data, and the number of
independent tasks grows as ``B*(B+1)/2``.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsignals.config import AnalysisConfig
from pairsignals.operators.kernels import matched_rows, packed_pairs

if TYPE_CHECKING:
    from pairsignals.operators.stats import ZBound


#: Ticker blocks of ``pairs_all`` for each block of the other pair queries.
FINER = 8


def block_count(spark: SparkSession, cfg: AnalysisConfig | None = None) -> int:
    """``cfg.pair_blocks`` or the smallest B whose block pairs cover twice the
    configured shuffle parallelism (so the pair stage fills the cluster)."""
    if cfg is not None and cfg.pair_blocks:
        return cfg.pair_blocks
    try:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        parts = 200
    b = 1
    while b * (b + 1) // 2 < 2 * parts:
        b += 1
    return b


def _blocked(df: DataFrame, b: int, key: str) -> DataFrame:
    return df.withColumn("_blk", F.pmod(F.xxhash64(F.col(key)), F.lit(b)).cast("int"))


def unordered_pairs(df: DataFrame, b: int, key: str = "ticker", on: tuple[str, ...] = (),
                    tasks: int | None = None) -> DataFrame:
    """Every unordered pair of distinct ``key`` values, matched on ``on``.

    Columns of the left row get prefix ``a_``, of the right row ``b_``;
    the block columns are dropped. ``tasks`` fixes the number of join tasks
    (both sides hash-partitioned alike on the join keys), for joins whose
    output is much larger than their input.
    """
    cols = df.columns
    blk = _blocked(df, b, key)
    left = blk.select(
        *[F.col(c).alias(f"a_{c}") for c in cols],
        F.col("_blk").alias("_ga"),
        F.explode(F.sequence(F.col("_blk"), F.lit(b - 1))).alias("_gb"),
    )
    right = blk.select(
        *[F.col(c).alias(f"b_{c}") for c in cols],
        F.explode(F.sequence(F.lit(0), F.col("_blk"))).alias("_ga"),
        F.col("_blk").alias("_gb"),
    )
    if tasks:
        left = left.repartition(tasks, "_ga", "_gb", *[f"a_{c}" for c in on])
        right = right.repartition(tasks, "_ga", "_gb", *[f"b_{c}" for c in on])
    cond: Column = (left["_ga"] == right["_ga"]) & (left["_gb"] == right["_gb"])
    for c in on:
        cond = cond & (left[f"a_{c}"] == right[f"b_{c}"])
    cond = cond & ((left["_ga"] < left["_gb"]) | (left[f"a_{key}"] < right[f"b_{key}"]))
    return left.join(right, cond, "inner").drop("_ga", "_gb")


def both_orders(pairs: DataFrame, a_cols: list[tuple[str, str]], b_cols: list[tuple[str, str]],
                shared: list[str] = ()) -> DataFrame:
    """Emit each unordered pair twice, as (a, b) and as (b, a).

    ``a_cols``/``b_cols`` list (column in ``pairs``, output name) for the
    first and second member; ``shared`` columns are symmetric and kept as is.
    """
    first = F.struct(*[F.col(src).alias(dst) for src, dst in a_cols],
                     *[F.col(src).alias(dst) for src, dst in b_cols],
                     *[F.col(s) for s in shared])
    second = F.struct(*[F.col(src).alias(dst) for (src, _), (_, dst) in zip(b_cols, a_cols)],
                      *[F.col(src).alias(dst) for (src, _), (_, dst) in zip(a_cols, b_cols)],
                      *[F.col(s) for s in shared])
    return pairs.select(F.inline(F.array(first, second)))


def pairs_all(tickers: DataFrame, b: int) -> DataFrame:
    """All ordered pairs (a, b) with a <> b of the given tickers.

    Pairs without statistics are cheap to make, so blocks are finer than
    ``b``: a ticker goes as a row to the block pairs it comes first in, a
    block as one array to those it comes second in, and each row is set
    against the array. Spark holds the pairs of one row at a time, so a fine
    block bounds them. The number of tasks is fixed, each with as many block
    pairs: the rows sent are few, and AQE would leave them to a few tasks.
    """
    fine = b * FINER
    blk = _blocked(tickers.select("ticker").where("ticker IS NOT NULL"), fine, "ticker")
    every = F.explode(F.sequence(F.lit(0), F.lit(fine - 1)))
    rows = blk.select(F.col("ticker").alias("stock_a"), F.col("_blk").alias("_ga"), every.alias("_gb"))
    blocks = (blk.groupBy("_blk").agg(F.collect_list("ticker").alias("_block"))
              .select("_block", F.col("_blk").alias("_gb"), every.alias("_ga")))

    def placed(df: DataFrame) -> DataFrame:
        numbered = df.withColumn("_pair", F.col("_ga") * F.lit(fine) + F.col("_gb"))
        return numbered.repartitionById(b * (b + 1) // 2, "_pair")

    # A merge join, as the others may hold one side whole or broadcast it.
    met = placed(rows).join(placed(blocks).select("_pair", "_block").hint("merge"), "_pair")
    return (met.select("_ga", "_gb", "stock_a", F.explode("_block").alias("stock_b"))
            .where("_ga <> _gb OR stock_a <> stock_b").select("stock_a", "stock_b"))


def hash_block(b: int, key: str = "ticker") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(b)).cast("int")


def _fan_out(df: DataFrame, b: int, cols: list[str], hit: list[int] | None = None, bound: ZBound | None = None,
             ) -> DataFrame:
    """Rows of ticker block g go to block pairs (g, h >= g) as the left side
    (``_side`` 0) and (h <= g, g) as the right side (``_side`` 1). With
    ``hit``, an unchanged row goes only where the other block is one of these;
    with ``bound``, rows are blocked by it and go only where it allows."""
    g = hash_block(b) if bound is None else bound.block
    dest = F.concat(
        F.transform(F.sequence(F.col("_blk"), F.lit(b - 1)),
                    lambda h: F.struct(F.col("_blk").alias("_ga"), h.alias("_gb"), F.lit(0).alias("_side"))),
        F.transform(F.sequence(F.lit(0), F.col("_blk")),
                    lambda h: F.struct(h.alias("_ga"), F.col("_blk").alias("_gb"), F.lit(1).alias("_side"))))
    def other(d: Column) -> Column:
        return F.when(d["_side"] == 0, d["_gb"]).otherwise(d["_ga"])

    if hit is not None:
        new = F.array(*map(F.lit, hit)) if hit else F.array().cast("array<int>")
        dest = F.filter(dest, lambda d: F.col("changed") | F.array_contains(new, other(d)))
    if bound is not None:
        dest = F.filter(dest, lambda d: bound.goes_to(other(d)))
    return df.withColumn("_blk", g).select(F.inline(dest), *cols)

def _by_block_pair(fanned: DataFrame, b: int) -> GroupedData:
    # One task for each block pair, by its number: hashing would give some
    # tasks several and others none, and AQE would coalesce the (small) block
    # rows into a few tasks, while the work per block pair is large.
    ga, gb = F.col("_ga"), F.col("_gb")
    number = (ga * F.lit(b) - F.expr("_ga * (_ga - 1) div 2").cast("int") + gb - ga).cast("int")
    return fanned.withColumn("_pair", number).repartitionById(b * (b + 1) // 2, "_pair").groupBy("_pair")


def _per_block_pair(fanned: DataFrame, b: int, kernel, schema: T.StructType) -> DataFrame:
    return _by_block_pair(fanned, b).applyInPandas(kernel, schema)


def with_matches(pairs: DataFrame, window: DataFrame, on: str, cols: list[str], least: int = 1) -> DataFrame:
    """``pairs`` (with ``stock_a, stock_b``) and ``rows``: the bars of both
    members with the same ``on``, as an array of ``on``, ``a_<col>``, ``b_<col>``,
    for pairs with at least ``least`` of them.

    A pair goes once to the task of its two ticker blocks, where both windows
    are, packed with others; no rows of pairs x bars are shuffled, and none with windows."""
    b = block_count(window.sparkSession)
    arrays = window.where(F.col(on).isNotNull()).groupBy("ticker").agg(
        F.collect_list(F.struct(on, *cols)).alias("w"))
    windows = _fan_out(arrays, b, ["ticker", "w"]).where("_side = 0 OR _ga <> _gb")
    ga, gb = hash_block(b, "stock_a"), hash_block(b, "stock_b")
    asked = pairs.where("stock_a IS NOT NULL AND stock_b IS NOT NULL").select(
        F.least(ga, gb).alias("_ga"), F.greatest(ga, gb).alias("_gb"), *pairs.columns)
    # An empty window, not NULL: Spark's Arrow writer goes over all NULL arrays of a batch again with each row.
    packed = asked.mapInArrow(packed_pairs(pairs.columns), "_ga int, _gb int, _side int, pairs binary").withColumn(
        "w", F.array().cast(arrays.schema["w"].dataType))
    types = {f.name: f.dataType for f in window.schema.fields}
    row = T.StructType([T.StructField(on, types[on])]
                       + [T.StructField(f"{side}_{c}", types[c]) for side in "ab" for c in cols])
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in pairs.schema.fields),
                           T.StructField("rows", T.ArrayType(row))])
    return _by_block_pair(windows.unionByName(packed, allowMissingColumns=True), b).applyInArrow(
        matched_rows(on, cols, least), schema)


def pairs_aligned_rank(window: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bars of both members of the given pairs at the same window
    position ``i``.

    ``window`` is ``(ticker, i, date, v)``; output
    ``(stock_a, stock_b, i, date_a, date_b, close_a, close_b)``.
    """
    both = with_matches(pairs.select("stock_a", "stock_b"), window, "i", ["date", "v"])
    return both.select("stock_a", "stock_b", F.inline("rows")).where("a_v IS NOT NULL AND b_v IS NOT NULL").select(
        "stock_a", "stock_b", "i", F.col("a_date").alias("date_a"), F.col("b_date").alias("date_b"),
        F.col("a_v").alias("close_a"), F.col("b_v").alias("close_b"))


def pairs_aligned_date(window: DataFrame, pairs: DataFrame, min_overlap: int) -> DataFrame:
    """Bars of both members of the given pairs on the same date, for
    pairs sharing at least ``min_overlap`` dates of their windows.

    Output ``(stock_a, stock_b, date, close_a, close_b, n_overlap)``.
    """
    both = with_matches(pairs.select("stock_a", "stock_b"), window, "date", ["v"], min_overlap)
    return both.select("stock_a", "stock_b", F.inline("rows"), F.size("rows").cast("long").alias("n_overlap")).select(
        "stock_a", "stock_b", "date", F.col("a_v").alias("close_a"), F.col("b_v").alias("close_b"), "n_overlap")


def pair_residuals(window: DataFrame, stats: DataFrame) -> DataFrame:
    """A4: residual of every window position of the pairs in ``stats`` (with
    their ``alpha`` and ``beta``): ``(stock_a, stock_b, i, resid)``."""
    both = with_matches(stats.select("stock_a", "stock_b", "alpha", "beta"), window, "i", ["v"])
    return both.select("stock_a", "stock_b", "alpha", "beta", F.inline("rows")).select(
        "stock_a", "stock_b", "i", (F.col("a_v") - F.col("alpha") - F.col("beta") * F.col("b_v")).alias("resid"))
