"""Line dedup: brute force over odd rows, borders of partitions, clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from finsieve.llm import line_dedup as L

BLANKS = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def _by_hand(rows, min_chars=20, min_docs=3):
    """(doc_id, n_lines, n_dropped, digest) of every row."""
    holders = {}
    order = lambda d: L.NO_ID if d is None else d
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(_key(line), set()).add(order(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines
            if len(_key(x)) < min_chars or len(holders[_key(x)]) < min_docs or max(holders[_key(x)]) == order(doc)
        ]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def _rows():
    rng = random.Random(11)
    common = [f"Line number {i:02d} that is long enough" for i in range(12)]
    odd = ["", "  ", "short", "\tLINE NUMBER 00 that is long enough \r", "Zeile mit Ümlauten äöü 12345", "ẞ" * 20, "İ" * 19 + "A", "x" * 19, "x" * 20]
    rows = []
    for doc in range(120):
        rows.append((doc, "\n".join(rng.choice(common + odd) for _ in range(rng.randint(0, 9)))))
        # one line that every document holds, some several times
        rows[-1] = (doc, rows[-1][1] + "\nThe very same line in all of them" * rng.randint(1, 3))
    rows += [(None, "The very same line in all of them"), (None, None), (5, rows[5][1]), (5, "another text of five\n" + common[0]), (200, ""), (201, None), (-3, common[1])]
    rows += [(300, "\n".join(f"{i} unique enough to be long" for i in range(3000)) + "\n" + "\n".join(common * 50))]
    return rows


@pytest.mark.parametrize("partitions", ["1", "7", "97"])
def test_against_brute_force(spark, partitions):
    rows = _rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = [tuple(r) for r in L.line_digests(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=repr) == sorted(_by_hand(rows), key=repr)


def test_stream_in_tiny_batches():
    # one partition whose hashes span batches: b (two documents) stays open at the end, a is the head
    def batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([h.encode() * 16 for h, *_ in rows], pa.binary()), pa.array([d for _, d, _ in rows], pa.int64()), pa.array([0] * len(rows), pa.int64()),
             pa.array([p for *_, p in rows], pa.int32()), pa.array([9] * len(rows), pa.int32())],
            names=["h", "doc", "text_key", "pos", "n_lines"],
        )

    rows = [("a", 5, 0), ("a", 4, 0), ("b", 9, 0), ("b", 9, 1), ("b", 8, 0), ("b", 7, 0), ("b", 7, 3), ("b", 6, 1), ("c", 3, 0), ("c", 2, 0), ("c", 2, 1)]
    for size in (1, 2, 3, 20):
        parts = [batch(rows[i : i + size]) for i in range(0, len(rows), size)]
        out = pa.Table.from_batches(list(L._stream(3)(iter(parts)))).to_pylist()
        found = {k: sorted((r["doc"], r["pos"]) for r in out if r["kind"] == k) for k in (0, 1, 2)}
        assert found[0] == [(6, 1), (7, 0), (7, 3), (8, 0)]
        assert found[1] == [(2, 0), (2, 1), (3, 0), (4, 0), (5, 0)]
        assert found[2] == [(2, 0), (3, 0), (4, 0), (5, 0)]


def test_bitmaps_and_clashing_names(spark):
    same = "a line that three documents hold"
    rows = [(i, f"{same}\nown {i}", "x", "y", "z") for i in range(3)] + [(9, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, keep_bitmap string, h string")
    bitmaps = L.keep_bitmaps(docs)
    bits = {r["doc"]: np.unpackbits(np.frombuffer(zlib.decompress(r["keep_bitmap"]), np.uint8))[: r["n_lines"]].tolist() for r in bitmaps.collect()}
    assert bits == {0: [0, 1], 1: [0, 1]}
    kept = L.apply_bitmaps(docs, bitmaps)
    assert kept.columns == [*docs.columns, "_n_lines", "n_dropped"]
    assert {(r["doc_id"], r["text"], r["n_lines"], r["_n_lines"], r["n_dropped"]) for r in kept.collect()} == {
        (0, "own 0", "x", 2, 1), (1, "own 1", "x", 2, 1), (2, f"{same}\nown 2", "x", 2, 0), (9, "", None, 1, 0),
    }


def test_no_rows(spark):
    assert L.line_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
