"""Source audit against whole-number arithmetic by hand, runs that spill, merging over batches."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from finsieve.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def _by_hand(rows, min_docs=3, ranks=200):
    docs, counts, groups = Counter(), {}, {}
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", _terms(text)
        groups.setdefault(lang, set()).add(source)
        docs.update({(lang, t) for t in terms})
        counts.setdefault((lang, source), Counter()).update(terms)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= min_docs)

        def share(found):
            total = sum(found[t] for t in kept)
            return {t: 1 + 10**9 * (found[t] + 1) // (total + len(kept)) for t in kept}

        q = share(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(found)[:most])]
    return out


def _rows():
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)] + ["Über", "ÜBER", "naïve", "日本", "don't", "x_y", "A1b2"]
    rows = []
    for i in range(240):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "a", "b", "Ü", None, f"s{i % 7}"])
        rows.append((" ".join(rng.choices(words, weights=[1 + 200 // (k + 1) for k in range(len(words))], k=rng.randint(0, 40))), lang, source))
    rows += [(None, "en", "only null"), ("", "fr", "alone"), ("12 34 !", "fr", "digits"), ("rare rare rare", "xx", "s"), ("rare", "xx", "t")]
    return rows + [rows[0], rows[0], ("Wort " * 30_000, "de", "long")]


@pytest.mark.parametrize("postings", [5, 2_000_000])
def test_against_brute_force(spark, postings):
    rows = _rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(4)
    got = [tuple(r) for r in D.source_audit(docs, postings=postings, term_ranks=20).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == sorted(_by_hand(rows, ranks=20))


def test_merge_over_batches():
    rows = sorted(("l", f"t{i % 3}", f"s{i % 5}", i, 1) for i in range(40)) + [("l", "z", "s", 1, 2), ("m", "z", "s", 1, 3)]
    whole = pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "term", "source", "n", "docs"]
    )
    expected = Counter()
    for lang, term, source, n, _ in rows:
        if (lang, term) != ("l", "z"):
            expected[lang, term, source] += n
    for size in (1, 2, 7, 100):
        parts = [whole.slice(i, size) for i in range(0, whole.num_rows, size)]
        out = pa.Table.from_batches(list(D._merge(3)(iter(parts)))).to_pylist()
        assert {(r["lang"], r["term"], r["source"]): r["n"] for r in out} == expected
        assert sum(r["first"] for r in out) == 4 and {r["lang_n"] for r in out if r["term"] == "t0"} == {sum(range(0, 40, 3))}


def test_shares_and_blocks_of_cells(monkeypatch):
    n, total = np.array([0, 5, 10**15 - 1]), np.array([10**15] * 3)
    assert D.shares(n, total, np.array([7, 7, 7])).tolist() == [1 + 10**9 * (x + 1) // (10**15 + 7) for x in n.tolist()]
    rng = np.random.default_rng(0)
    g = np.tile(np.array([3, 5, 9, 11]), (6, 1))
    p, p0 = rng.integers(1, 10**9, g.shape), rng.integers(1, 10**9, g.shape)

    def total_of(found):
        return {(a, b): hi * 2**32 + lo for a, b, hi, lo in zip(*[x.tolist() for x in D._reduced(list(found))])}

    whole = total_of(D._corrected(g, p, p0))
    f = lambda x, y: (x - y) ** 2 // y
    for (a, b), value in whole.items():
        i, j = g[0].tolist().index(a), g[0].tolist().index(b)
        assert value == sum(
            f(p[t, i].item(), p[t, j].item()) - f(p[t, i].item(), p0[t, j].item()) - f(p0[t, i].item(), p[t, j].item()) + f(p0[t, i].item(), p0[t, j].item()) for t in range(6)
        )
    monkeypatch.setattr(D, "_CELLS", 3)
    assert total_of(D._corrected(g, p, p0)) == whole and len(whole) == 12


def test_no_rows(spark):
    assert D.source_audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
