"""Keys of the suffix passes: both parts decide, in a batch and between batches."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from pairsignals.llm import suffix_dedup as sd


def batches_of(docs, size):
    """Tables of batches, of ``size`` documents each."""
    for i in range(0, len(docs), size):
        part = docs[i:i + size]
        rows = pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in part], pa.int64()), pa.array([False] * len(part)),
             pa.array([t.encode() for _, t in part], pa.binary())], names=["key", "null_key", "text"])
        yield pa.Table.from_batches(list(sd.gathered(1 << 20)(iter([rows]))))


def removed(docs, size):
    """The passes without Spark: one bucket, every batch asked in turn."""
    tables = list(batches_of(docs, size))
    told = pa.table({n: pa.array([], t) for n, t in zip(
        ("batch", "kind", "a", "b", "c"), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))})

    def of(table):
        number = table.column("batch")[0].as_py()
        return told.filter(pa.array([x == number for x in told.column("batch").to_pylist()], pa.bool_()))

    told = sd.merge(pa.concat_tables([sd.send_anchors(1)(t) for t in tables]))
    for send in (sd.send_stretches(1), sd.send_windows(1)):
        told = pa.concat_tables([told, sd.merge(pa.concat_tables([send(t, of(t)) for t in tables]))])
    out = pa.concat_tables([sd.remove(t, of(t)) for t in tables]).to_pylist()
    return sorted((r["key"], r["n_bytes"], sum(y - x for x, y in zip(r["starts"], r["stops"])), len(r["starts"]),
                   brute.sha(r["kept"])) for r in out)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    base = " ".join(rng.choice(words) for _ in range(60))
    # Stretches of one anchor that differ at their ends only.
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 8))) + base[s:s + rng.randint(60, 200)]
             + rng.choice("xyz") * rng.randint(0, 3)) for i, s in enumerate(rng.randint(0, 80) for _ in range(24))]


@pytest.mark.parametrize("size", [1, 5, 24])
@pytest.mark.parametrize("first", ["whole", "upper bits alike", "alike"])
def test_stretches_with_alike_first_parts_are_told_apart(docs, monkeypatch, size, first):
    keys = sd.Chunk.keys

    def weak(self, start, stop):
        a, b = keys(self, start, stop)
        return {"whole": a, "upper bits alike": a >> np.uint64(50), "alike": a & np.uint64(0)}[first], b

    monkeypatch.setattr(sd.Chunk, "keys", weak)
    docs = [d for d in docs if len(d[1]) >= sd.THRESHOLD]
    assert removed(docs, size) == sorted(brute.op10(docs))


def test_a_flag_is_no_part_of_a_key():
    rows = [(0, batch, sd.SEVERAL, *sd.packed(sd.WIDTHS[sd.SEVERAL], tuple(
        np.array([x], np.uint64) for x in (5 << 16, 7, second)))) for batch, second in ((1, 8), (2, 8))]
    assert sd.merge(sd.batch_of_entries(rows)).num_rows == 0
    rows.append((0, 3, sd.SEVERAL, *sd.packed(sd.WIDTHS[sd.SEVERAL], tuple(
        np.array([x], np.uint64) for x in (5 << 16, 7, 10)))))
    assert sorted(sd.merge(sd.batch_of_entries(rows)).column("batch").to_pylist()) == [1, 2, 3]
