"""Helpers shared by the corpus operators.

Row rules that hold for every operator: a NULL text is handled as the empty
text, tables may be empty, further columns are ignored (or carried through
unchanged by the pipeline stages), and rows that repeat a ``doc_id`` each get
their own output row.
"""

from __future__ import annotations

import ctypes
import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsignals.session import scratch_path

#: A-Z to a-z, everything else unchanged: the only lower-casing the contracts use.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Words of the phrase operators: every run without ASCII control characters,
#: white space and punctuation, in a text that is lower-cased first. (Spelled
#: by what it holds: Java matches that several times faster.)
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"

#: bytes.translate table for the same rule on UTF-8: A-Z lower-cased, a-z, 0-9
#: and every byte of a non-ASCII character kept, the rest turned into a space.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))

#: bytes.translate table that lower-cases A-Z only.
LOWER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z only. ``lower`` does just that to a text of ASCII bytes, and
    faster than the character map."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the
    rows are computed once, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a small table up to which it is broadcast (a row is at most a few hundred bytes).
BROADCAST_ROWS = 200_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ship(spark: SparkSession) -> None:
    """Let executors import this package, once for each Spark context: its
    source goes as an archive to the shared folder and from there to them."""
    sc = spark.sparkContext
    if getattr(sc, "_pairsignals_shipped", False):
        return
    root, made = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(made, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    path = scratch_path(spark, "package") + ".zip"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(made.getvalue()))
    out.close()
    sc.addPyFile(path)
    sc._pairsignals_shipped = True


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str,
              ) -> DataFrame:
    """``mapInArrow`` by a function that may use this package."""
    ship(df.sparkSession)

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(frugal, schema)


def give_back() -> None:
    """Hand freed memory back: Python workers are kept, and share their executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small parts of the batches, so that what is made from them stays small too."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def map_texts(df: DataFrame, columns: dict[str, str], text: str, fn: Callable[[bytes], tuple], out: dict[str, str],
              ) -> DataFrame:
    """Apply ``fn`` to the UTF-8 bytes of each whole ``text`` (NULL: empty) in
    Arrow batches. ``columns`` (name: type) pass through; ``out`` (name: type)
    are the values ``fn`` returns."""
    kinds = {**columns, **out}
    schema = ", ".join(f"`{k}` {v}" for k, v in kinds.items())
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [fn(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column(len(names))]
            arrays = [part.column(i) for i in range(len(names))]
            arrays += [pa.array(v, type=ARROW[k]) for v, k in zip(zip(*rows), out.values())]
            yield pa.RecordBatch.from_arrays(arrays, names=list(kinds))

    picked = [F.col(f"`{c}`").cast(k).alias(c) for c, k in columns.items()]
    return map_arrow(df.select(*picked, F.col(f"`{text}`").cast("binary").alias("__text")), run, schema)


#: Arrow types of the SQL types that operators return.
ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
}
