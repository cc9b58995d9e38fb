"""Merkle manifest of a data set, with an inclusion proof for every row.

Each row is a leaf. The leaves of a language ascend by key and are hashed two
by two, level by level, to its subroot; the subroots, ordered by language, are
hashed the same way to the root. A last node without a partner is hashed alone.

Proofs come by pointer jumping: every node starts with its own sibling and its
parent, and each round joins the nodes with themselves, so that a node takes
over the segment of siblings of the ancestor it points to and points twice as
far. After as many rounds as the depth has bits, every leaf holds the siblings
up to the root.

A node is (``tree``, ``level``, ``at``). Tree -1 is the one over the subroots;
its leaf ``at`` is the subroot of tree ``at``. A language's place is its tree.
An ancestor at distance d has at most 2^d nodes at that distance below it, so a
join key of the round from d to 2d repeats at most 2^d times (256 times when 16
levels are reached), and the ancestors' side is smaller by the same factor: no
key is hot however large one language is.

Rows: NULL fields are written ``-``; a NULL language is a language of its own
and comes first, a NULL key comes first within its language. Rows that share a
key are ordered by their leaves, and each has its own leaf and proof. An empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsignals.llm.common import map_arrow, ship, slices, small, written

#: Levels that one group of nodes climbs at once: a group holds 2^LEVELS nodes at most.
LEVELS = 10
#: Where a segment's sibling stands: there is none, left of the path or right of it.
ALONE, LEFT, RIGHT = 0, 1, 2
#: Bytes of a segment's entry: the side and the sibling's digest.
ENTRY = 33
NODE = ("tree", "level", "at")


def field(value: Column) -> Column:
    """One field of a leaf: ``-`` or its length in bytes, a colon and its value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Hash of the fields, as lowercase hex."""
    return F.sha2(F.concat(*map(field, values)), 256)


def tampered(key: Column) -> Column:
    """Rows on which the audit tampers: their key's crc32 is a multiple of seven."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def digest(*parts: bytes) -> bytes:
    """Hash of digests, which count as their hex text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def placed(df: DataFrame, order: list[str], group: list[str], name: str) -> DataFrame:
    """``df`` with ``at``, each row's place (from 0) in its group when all rows
    are sorted by ``order``, which begins with ``group``.

    Rows are dealt by ranges, so a large group spreads over many tasks; what is
    summed to find where a task begins is one row for each task and group in it.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(c).asc_nulls_first() for c in order]
    rows = written(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(
        "__at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    parts = rows.groupBy("__part", *group).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1))
    parts = parts.select("__part", *[F.col(c).alias(f"__{c}") for c in group], "__first",
                         F.coalesce(before, F.lit(0)).alias("__before"))
    same = rows["__part"] == parts["__part"]
    for c in group:
        same &= rows[c].eqNullSafe(parts[f"__{c}"])
    return rows.join(small(parts), same).select(
        *df.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("at"))


def climbed(nodes: DataFrame, level: int) -> DataFrame:
    """Climb up to ``LEVELS`` levels from the nodes (``tree``, ``at``,
    ``digest``, ``n`` nodes of this tree) of ``level``.

    Returns every node passed, with the ``side`` and ``digest`` of its sibling
    and ``n`` zero, and the nodes arrived at, with their own ``digest`` and
    ``n``, the nodes of the tree on their level."""
    schema = "tree long, level int, at long, side int, digest binary, n long"

    def climb(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["at"].to_pylist(), table["digest"].to_pylist()))
        tree, n, first, here = table["tree"][0].as_py(), table["n"][0].as_py(), rows[0][0], [d for _, d in rows]
        out, up = [], 0
        while up < LEVELS and n > 1:
            for i, _ in enumerate(here):
                j = i ^ 1
                out.append((tree, level + up, first + i, ALONE, b"", 0) if j >= len(here) else
                           (tree, level + up, first + i, RIGHT if j > i else LEFT, here[j], 0))
            here = [digest(*here[i:i + 2]) for i in range(0, len(here), 2)]
            first, up, n = first >> 1, up + 1, (n + 1) // 2
        out += [(tree, level + up, first + i, ALONE, d, n) for i, d in enumerate(here)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
        return pa.table([pa.array(v, k) for v, k in zip(zip(*out), kinds)],
                        names=["tree", "level", "at", "side", "digest", "n"])

    ship(nodes.sparkSession)
    return nodes.groupBy("tree", F.shiftright("at", LEVELS).alias("__run")).applyInArrow(climb, schema)


def grown(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """All nodes below the roots of the trees over the leaves (``tree``,
    ``at``, ``digest``), each with its sibling, and the roots (``tree``,
    ``level``, ``digest``)."""
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n"))
    now = leaves.join(small(sizes), "tree").select("tree", F.lit(0).alias("level"), "at", "digest", "n")
    nodes = roots = None
    level = 0
    while True:
        step = written(climbed(now, level), name)
        below, tops = step.where("n = 0").drop("n"), step.where("n = 1").select("tree", "level", "digest")
        nodes = nodes.unionByName(below) if nodes else below
        roots = roots.unionByName(tops) if roots else tops
        now, level = step.where("n > 1"), level + LEVELS
        if now.isEmpty():
            return nodes, roots


def segments(nodes: DataFrame, heights: DataFrame) -> DataFrame:
    """Each node's first segment: its own sibling, and its parent as ``to_*``.

    The parent of a language's topmost nodes is the leaf that their subroot is
    in the tree over all languages. Nodes below the root point to nothing."""
    parent, top = F.col("level") + 1, F.col("tree") == -1
    entry = F.concat(F.unhex(F.lpad(F.hex("side"), 2, "0")), F.rpad(F.col("digest"), ENTRY - 1, F.lit(b"\x00")))
    joined = nodes.join(small(heights), "tree")
    crosses = ~top & (parent == F.col("height"))
    ends = F.when(crosses, F.col("whole") == 0).otherwise(top & (parent == F.col("height")))
    return joined.select(
        *NODE, entry.alias("segment"),
        F.when(~ends, F.when(crosses, F.lit(-1).cast("long")).otherwise(F.col("tree"))).alias("to_tree"),
        F.when(~ends, F.when(crosses, F.lit(0)).otherwise(parent)).alias("to_level"),
        F.when(~ends, F.when(crosses, F.col("tree")).otherwise(F.shiftright("at", 1))).alias("to_at"))


def jumped(first: DataFrame, depth: int) -> DataFrame:
    """Segments to the root for the leaves of all languages (and all nodes of
    the tree over them), by doubling.

    After a round of reach r only levels that are multiples of 2r are pointed
    from or to again, so the others are left out; the tree over the languages
    has levels of its own and stays whole."""
    now, reach = first, 1
    while reach < depth:
        top = F.col("tree") == -1
        left = now.where(top | (F.col("level") % (2 * reach) == 0))
        ahead = now.where(top | (F.col("level") >= reach)).select(
            *[F.col(c).alias(f"to_{c}") for c in NODE], F.col("segment").alias("__more"),
            *[F.col(f"to_{c}").alias(f"__{c}") for c in NODE])
        there = left.where(F.col("to_tree").isNull())  # these need no join, and would all have one key
        further = left.where(F.col("to_tree").isNotNull()).join(ahead, [f"to_{c}" for c in NODE]).select(
            *NODE, F.concat("segment", "__more").alias("segment"), *[F.col(f"__{c}").alias(f"to_{c}") for c in NODE])
        now, reach = written(there.unionByName(further), "merkle-proofs"), 2 * reach
    return now


def audited(rows: DataFrame, root: bytes) -> DataFrame:
    """Fold every leaf, or the one tampered with, along its proof."""
    names = [f.name for f in rows.schema if f.name not in ("tree", "at", "segment")]
    schema = (f"key {rows.schema['key'].dataType.simpleString()}, leaf string, subroot string, root string, "
              "proof_sha256 string, folded_root string, verified boolean")
    assert names == ["key", "leaf", "found", "subroot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for kept, found, subroot, segment in zip(*(part.column(c).to_pylist() for c in (
                    "leaf", "found", "subroot", "segment"))):
                proof, folded = hashlib.sha256(), bytes.fromhex(found)
                for i in range(0, len(segment), ENTRY):
                    side, sibling = segment[i], segment[i + 1:i + ENTRY]
                    if side == ALONE:
                        folded = digest(folded)
                    else:
                        folded = digest(sibling, folded) if side == LEFT else digest(folded, sibling)
                        proof.update(sibling.hex().encode())
                out.append((kept, subroot.hex(), root.hex(), proof.hexdigest(), folded.hex(), folded == root))
            kinds = [pa.string()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), *(pa.array(v, k) for v, k in zip(zip(*out), kinds))],
                names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return map_arrow(rows, run, schema)


def manifest(df: DataFrame, key: str = "doc_id", group: str = "lang",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             changed: str = "n_chars") -> DataFrame:
    """Of every row: its ``leaf``, its language's ``subroot``, the ``root``,
    the hash of its proof, and an audit: the root that its proof gives for the
    leaf found now (``folded_root``) and whether that is the root. The audit
    finds ``changed`` one larger in the rows that ``tampered`` names."""
    now = {c: F.col(c) for c in fields}
    other = now | {changed: F.col(changed) + 1}
    found = F.when(tampered(F.col(key)), leaf(*other.values())).otherwise(F.col("leaf"))
    # The texts are read once; the rows sorted below are a few hundred bytes each.
    hashed = written(df.withColumn("leaf", leaf(*now.values())).select(
        F.col(key).alias("key"), F.col(group).alias("name"), "leaf", found.alias("found")), "merkle-leaves")
    trees = placed(hashed.select("name").distinct(), ["name"], [], "merkle-trees").select(
        F.col("name").alias("__name"), F.col("at").alias("tree"))
    rows = placed(hashed, ["name", "key", "leaf"], ["name"], "merkle-order")
    rows = rows.join(small(trees), rows["name"].eqNullSafe(trees["__name"])).select("tree", "at", "key", "leaf", "found")
    nodes, subroots = grown(rows.select("tree", "at", F.unhex("leaf").alias("digest")), "merkle-nodes")
    over, top = grown(subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("at"), "digest"),
                      "merkle-top")
    root = top.first()
    if root is None:
        return df.sparkSession.createDataFrame([], (
            f"key {df.schema[key].dataType.simpleString()}, leaf string, subroot string, root string, "
            "proof_sha256 string, folded_root string, verified boolean"))
    heights = subroots.select("tree", F.col("level").alias("height")).union(
        top.select("tree", F.col("level").alias("height"))).withColumn("whole", F.lit(root["level"]))
    # A language of one row: its leaf is the subroot, with an empty segment of its own.
    single = subroots.where("level = 0").select(
        "tree", "level", F.lit(0).cast("long").alias("at"), F.lit(b"").alias("segment"),
        *[(F.lit(None) if root["level"] == 0 else v).cast(t).alias(f"to_{c}") for c, v, t in (
            ("tree", F.lit(-1), "long"), ("level", F.lit(0), "int"), ("at", F.col("tree"), "long"))])
    first = written(segments(nodes.unionByName(over), heights).unionByName(single), "merkle-proofs")
    depth = 1 + (subroots.agg(F.max("level")).first()[0] or 0) + root["level"]
    proofs = jumped(first, depth).where("tree >= 0 AND level = 0").select("tree", "at", "segment")
    whole = rows.join(small(subroots.select("tree", F.col("digest").alias("subroot"))), "tree").join(
        proofs, ["tree", "at"]).select("key", "leaf", "found", "subroot", "segment")
    return audited(whole, root["digest"]).withColumnRenamed("key", key)
