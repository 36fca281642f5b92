"""Merkle manifest against a tree built by hand, proofs folded back, odd rows."""

import hashlib
import zlib

import pytest

from finsieve.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _leaf(row, text):
    doc, _, lang, source, n = row
    return _h([_field(v) for v in (doc, source, lang, n, text)])


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def _siblings(levels, at):
    found = []
    for level in levels[:-1]:
        first = at - at % 3
        found += [level[i] for i in range(first, min(first + 3, len(level))) if i != at]
        at //= 3
    return found


def _refolded(levels, at, digest):
    for level in levels[:-1]:
        first = at - at % 3
        run = [*level[first : first + 3]]
        run[at - first] = digest
        digest, at = _h(run), at // 3
    return digest


def _by_hand(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, _leaf(row, row[1]), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: _levels([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    top = _levels([levels[s][-1][0] for s in order])
    out = []
    for rank, s in enumerate(order):
        for at, (_, _, leaf, row) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            root = _refolded(top, rank, _refolded(levels[s], at, _leaf(row, text)))
            proof = _h(_siblings(levels[s], at) + _siblings(top, rank))
            out.append((row[0], leaf, levels[s][-1][0], top[-1][0], proof, root, root == top[-1][0]))
    return out


def _rows(n):
    rows = [(i * 7 % 1009, f"text {i}\nwith ä and\n{i}", "en" if i % 3 else None, "big" if i % 2 else f"s{i % 11}", i) for i in range(n)]
    rows += [(5000, None, None, None, None), (5001, "", "de", None, 0), (5001, "", "de", None, 0), (None, "a\nb", "x", "big", 3), (None, None, None, "", 1)]
    return rows + [rows[3], (9000, "long\n" * 40_000, "en", "Übersicht", 1), (-5, "no break", "en", "big", 1)]


@pytest.mark.parametrize("n", [0, 40, 1300])
def test_against_a_tree_by_hand(spark, n):
    rows = _rows(n) if n else [(4, "one\nrow", "en", "s", 7)]
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA + ", leaf string, tree int").repartition(5)
    got = [tuple(r) for r in M.manifest_digests(docs).collect()]
    assert sorted(got, key=repr) == sorted(_by_hand(rows), key=repr)


def test_many_sources(spark):
    rows = [(i, f"t{i}\n", "en", f"source {i % 400:03d}", i) for i in range(500)]
    got = [tuple(r) for r in M.manifest_digests(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(_by_hand(rows), key=repr)


def test_no_rows(spark):
    made = M.build_manifest(spark.createDataFrame([], SCHEMA))
    assert made.root is None and made.leaves.count() == 0


def test_rounds():
    assert [M._rounds(n) for n in (1, M.BLOCK, M.BLOCK + 1, M.BLOCK**2, M.BLOCK**2 + 1)] == [1, 1, 2, 2, 3]
