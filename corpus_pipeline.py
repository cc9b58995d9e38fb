"""The corpus pipeline, from raw documents to token ids.

Stages, each on all rows that the one before it kept: quality rules (rejected
documents go), line dedup (repeated lines go, and documents of which nothing
is left), SimHash near-dedup (one document of each group stays),
decontamination (documents with a benchmark passage go) and byte-level BPE.
All but the last return the columns of ``documents``; ``n_chars`` follows the
text where a stage changes it.

NULL texts are empty ones, which the quality rules reject. Empty tables pass
through. Further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsignals.llm import byte_bpe, decontaminate, line_dedup, quality, simhash
from pairsignals.llm.catalog import BYTE_BPE
from pairsignals.llm.common import table, written

#: Benchmark items of fewer words (a number, a name) are no passage; no document is dropped for holding one.
MIN_ITEM_WORDS = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.without_repeats(docs, counts="__lines")
    left = found.where((F.col("__lines.n_removed") == 0) | F.col("text").rlike(line_dedup.WORDED))
    return left.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c)
                         if c == "n_chars" else c for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    return decontaminate.without_matches(docs, items, min_words=MIN_ITEM_WORDS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode_documents(docs, BYTE_BPE)
    return byte_bpe.digests(encoded, keep=("ids",))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", token_ids),
]

#: SQL has no tokenizer, fingerprints or graph components of this kind; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
