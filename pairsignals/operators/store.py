"""Keyed tables: upsert, index search, key/value put/get/delete.

A bucket of the original key/value store becomes a table with a key column.
Small tables are replaced as a whole, by a new version folder beside the old
ones (``VersionedTable``); bars are kept by month, and an upsert replaces the
months it touches (``PartitionedTable``).

Upserts keep, per key, the row of the latest batch (then the largest
sequence value) with ``max`` - an aggregate with map-side partial
aggregation - so a key with very many versions never moves as one group.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsignals import schemas
from pairsignals.functions.calendar import bar_document, date_parts, iso_date, record_key


# --------------------------------------------------------------------------
# upsert
# --------------------------------------------------------------------------

def upsert(current: DataFrame | None, updates: DataFrame, keys: list[str],
           seq: Column | None = None) -> DataFrame:
    """Rows of ``current`` and ``updates`` merged by ``keys``; an update
    replaces the current row, and among several updates of one key the one
    with the largest ``seq`` (any orderable column) wins, then the one with
    the largest values, so the result never depends on the order of rows."""
    value_cols = [c for c in updates.columns if c not in keys and c != "_seq"]
    seq = seq if seq is not None else F.lit(0)
    new = updates.select(*keys, *value_cols, F.lit(1).alias("_batch"), seq.alias("_seq"))
    if current is not None:
        seq_type = new.schema["_seq"].dataType
        old = current.select(*keys, *value_cols, F.lit(0).alias("_batch"),
                             F.lit(None).cast(seq_type).alias("_seq"))
        new = old.unionByName(new)
    winner = F.max(F.struct("_batch", "_seq", *value_cols)).alias("_row")
    return new.groupBy(*keys).agg(winner).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in value_cols])


def upsert_by_load(current: DataFrame | None, updates: DataFrame, keys: list[str], load: str = "load_id") -> DataFrame:
    """As ``upsert``, but rows carry the number of their load, and the row of
    the latest load wins wherever it stands: a late load with a smaller
    number replaces nothing."""
    rows = updates if current is None else current.select(*updates.columns).unionByName(updates)
    value_cols = [c for c in updates.columns if c not in keys and c != load]
    winner = F.max(F.struct(load, *value_cols)).alias("_row")
    return rows.groupBy(*keys).agg(winner).select(*[F.col(c if c in keys else f"_row.{c}").alias(c)
                                                    for c in updates.columns])


def upsert_bars(current: DataFrame | None, batch: DataFrame, seq: Column | None = None) -> DataFrame:
    """S3: bars keyed by (ticker, date), the later batch wins."""
    return upsert(current, batch.select(*schemas.BAR_COLUMNS, *([] if seq is None else [seq.alias("_seq")])),
                  ["ticker", "date"], None if seq is None else F.col("_seq"))


# --------------------------------------------------------------------------
# bar documents and indexes
# --------------------------------------------------------------------------

def bar_documents(bars: DataFrame) -> DataFrame:
    """P10: key ``ticker_date``, JSON document and the index columns."""
    return bars.select(
        record_key(F.col("ticker"), iso_date(F.col("date"))).alias("key"),
        bar_document().alias("doc"),
        F.col("ticker").alias("ticker_bin"),
        F.year("date").cast("int").alias("year_int"),
        F.month("date").cast("int").alias("month_int"),
        F.dayofmonth("date").cast("int").alias("day_int"),
    )


def index_search_eq(table: DataFrame, term: str, value) -> DataFrame:
    """Rows whose index column equals ``value``."""
    return table.where(F.col(term) == F.lit(value))


def index_search_range(table: DataFrame, term: str, low, high) -> DataFrame:
    """Rows whose index column lies in ``[low, high]``."""
    return table.where(F.col(term).between(F.lit(low), F.lit(high)))


# --------------------------------------------------------------------------
# key/value buckets
# --------------------------------------------------------------------------

def kv_put(bucket: DataFrame | None, puts: DataFrame, seq: str) -> DataFrame:
    """Store (key, value) rows; the last put of a key (by the column
    ``seq``) wins."""
    return upsert(bucket, puts.select("key", "value", F.col(seq).alias("_seq")), ["key"], F.col("_seq"))


def kv_get(bucket: DataFrame, key: str, schema=None) -> DataFrame:
    """The value of one key, JSON-decoded when a schema is given."""
    out = bucket.where(F.col("key") == F.lit(key))
    if schema is not None:
        out = out.select("key", F.from_json("value", schema).alias("value"))
    return out


def kv_scan(bucket: DataFrame) -> DataFrame:
    """Every key and value."""
    return bucket.select("key", "value")


def kv_delete(bucket: DataFrame, keys: DataFrame) -> DataFrame:
    """The bucket without the given keys."""
    return bucket.join(keys.select("key"), "key", "left_anti")


def kv_delete_confirm(after: DataFrame, keys: DataFrame) -> DataFrame:
    """One status row per requested key, checked against the new version."""
    still = after.select("key").withColumn("_present", F.lit(True))
    return (keys.select("key").distinct().join(still, "key", "left")
            .select("key", F.when(F.col("_present"), F.lit("failed"))
                    .otherwise(F.lit("deleted")).alias("status")))


def kv_delete_all(table: VersionedTable) -> DataFrame:
    """Write an empty version; returns the keys that it no longer has."""
    before = table.read()
    after = table.read(kv_truncate(table))
    return before.select("key").join(after.select("key"), "key", "left_anti")


def kv_truncate(table: VersionedTable) -> int:
    """Write an empty version and return its number."""
    return table.write(table.read().limit(0))


# --------------------------------------------------------------------------
# versioned table folders
# --------------------------------------------------------------------------

def bloom_options(columns: tuple[str, ...]) -> dict[str, str]:
    """Parquet writer options for a Bloom filter on each of ``columns``: a
    search for one value skips the row groups that do not hold it, in
    whatever order the rows lie. Sized by the distinct values of a row group."""
    out = {}
    for c in columns:
        out |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.adaptive.enabled#{c}": "true"}
    return out


class VersionedTable:
    """A table folder with numbered versions ``v000001``, ``v000002``...

    ``write`` puts a complete new version next to the old ones, so a job may
    read the current version while writing the next. Works on any Hadoop
    file system (the path comes from the caller, e.g. the checkpoint folder).
    For tables that are replaced as a whole.
    """

    def __init__(self, spark: SparkSession, root: str, sort_by: tuple[str, ...] = (), keep: int = 3,
                 bloom: tuple[str, ...] = ()):
        self.spark = spark
        self.options = bloom_options(bloom)
        self.root = root.rstrip("/")
        self.sort_by = tuple(sort_by)
        self.keep = keep  # complete versions that stay; readers of an older one must be done

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def _version_folders(self) -> dict[int, bool]:
        """Every version folder and whether it is complete (has _SUCCESS)."""
        fs, jvm = self._fs()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        if not fs.exists(root):
            return {}
        out = {}
        for st in fs.listStatus(root):
            name = st.getPath().getName()
            if name.startswith("v") and name[1:].isdigit():
                out[int(name[1:])] = bool(fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")))
        return out

    def versions(self) -> list[int]:
        """Complete versions, oldest first (a failed write leaves no _SUCCESS)."""
        return sorted(v for v, done in self._version_folders().items() if done)

    def path(self, version: int) -> str:
        return f"{self.root}/v{version:06d}"

    def current_version(self) -> int | None:
        v = self.versions()
        return v[-1] if v else None

    def read(self, version: int | None = None, schema=None) -> DataFrame | None:
        version = version if version is not None else self.current_version()
        if version is None:
            return None
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(self.path(version))

    def write(self, df: DataFrame) -> int:
        """Write ``df`` as the next version and return its number. Numbers go
        past every folder, so a retry after a failed write never collides
        with the partial folder it left. Versions beyond ``keep`` go."""
        nxt = max(self._version_folders(), default=0) + 1
        out = df.sortWithinPartitions(*self.sort_by) if self.sort_by else df
        out.write.mode("errorifexists").options(**self.options).parquet(self.path(nxt))
        fs, jvm = self._fs()
        for old in self.versions()[:-self.keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(self.path(old)), True)
        return nxt


def in_months(months: list[tuple[int | None, int | None]]) -> Column:
    """Rows of the given (year, month) partitions."""
    hit = F.lit(False)
    for year, month in months:
        hit = hit | (F.col("year").eqNullSafe(F.lit(year)) & F.col("month").eqNullSafe(F.lit(month)))
    return hit


class PartitionedTable:
    """A Parquet folder partitioned by calendar columns of ``date``, of which
    an upsert reads and writes only the partitions that its batch touches.

    The merged partitions are first written beside the table, then replace
    the old ones by dynamic partition overwrite. A run that is broken off in
    between leaves old or new partitions, and is repeated: the same batch
    gives the same rows.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: tuple[str, ...] = ("ticker", "date"),
                 sort_by: tuple[str, ...] = ("ticker",), bloom: tuple[str, ...] = ("ticker",)):
        self.spark, self.root, self.schema, self.bloom = spark, root.rstrip("/"), schema, bloom
        self.keys, self.sort_by = list(keys), tuple(sort_by)

    PARTS = ("year", "month")

    def _path(self, *names: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        path, fs = self._path("rows")
        return fs.exists(path)

    def read(self, with_parts: bool = False) -> DataFrame | None:
        """All rows; with ``year`` and ``month`` to prune by if asked for."""
        if not self.exists():
            return None
        full = T.StructType([*self.schema.fields, *(T.StructField(c, T.IntegerType()) for c in self.PARTS)])
        rows = self.spark.read.schema(full).parquet(f"{self.root}/rows")
        return rows if with_parts else rows.select(*self.schema.names)

    def touched(self, batch: DataFrame) -> DataFrame | None:
        """Stored rows of the partitions that ``batch`` falls into. Their
        numbers come to the driver (a row for each month), so the scan is
        pruned when it is planned."""
        rows = self.read(with_parts=True)
        if rows is None:
            return None
        months = [(r.year, r.month) for r in batch.select(*date_parts(F.col("date"))[:2]).distinct().collect()]
        return rows.where(in_months(months)).select(*self.schema.names)

    def upsert(self, batch: DataFrame, merge=upsert) -> dict:
        """Merge ``batch`` into the partitions it touches; ``merge`` takes
        the stored rows, the batch and the keys. Returns what the write itself
        observed of the batch: its ``rows``, and their ``first`` and ``last``
        date."""
        seen = Observation()
        batch = batch.select(*self.schema.names).observe(
            seen, F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))
        if not self.exists():
            merged = merge(None, batch, self.keys)
            self._write(merged.select(*self.schema.names, *date_parts(F.col("date"))[:2]))
            self._replaced(self.read(with_parts=True))
            return seen.get
        # The batch is written first: its months are read from it, then it is merged.
        with self._beside(batch, "batch") as landed:
            merged = merge(self.touched(landed), landed, self.keys)
            with self._beside(merged.select(*self.schema.names, *date_parts(F.col("date"))[:2]), "merged") as rows:
                self._write(rows)
                self._replaced(rows)
        return seen.get

    @contextmanager
    def _beside(self, df: DataFrame, name: str) -> Iterator[DataFrame]:
        """``df`` as a table beside this one while it is in use."""
        beside = f"{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.root}/{beside}")
        yield self.spark.read.schema(df.schema).parquet(f"{self.root}/{beside}")
        path, fs = self._path(beside)
        fs.delete(path, True)

    def _replaced(self, rows: DataFrame) -> None:
        """Called with all rows of the partitions that were replaced."""

    def _write(self, rows: DataFrame) -> None:
        # Rebalanced by month: few files for a month, yet a large month is split.
        (rows.hint("rebalance", *self.PARTS).sortWithinPartitions(*self.PARTS, *self.sort_by).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").options(**bloom_options(self.bloom)).partitionBy(*self.PARTS)
         .parquet(f"{self.root}/rows"))
