"""How far the sources of each language differ in their words, exactly.

Word counts come from single-pass in-memory indexing: a task keeps postings (a count
and a number of documents per language, source and term) until a bound is reached and
then spills them as a run sorted by term; runs are dealt to hash shards of (language,
term), where Spark's external sort merges them through a heap, and a stream adds up
equal postings and drops rare terms.

The divergence of two sources sums over all terms of the language, most of which
one or both of them lack. All terms are first taken as absent from both; what that
gets wrong is corrected: terms of one source from its histogram of counts, terms of
both from a stream over the postings, summed per pair within each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsieve.llm.batches import flat_words, slices, texts_of
from finsieve.session import materialize

#: Documents of a language that a term must be in to be kept.
MIN_DOCS = 3
#: Rows that a source has in part ``term``.
TERM_RANKS = 200
#: Probabilities are counted in such parts.
SCALE = 1_000_000_000
#: Postings that a task holds before it spills a run; those of each slice of texts count by themselves.
POSTINGS = 2_000_000
#: Pairs that a task holds, and table cells it computes at once.
PAIRS = 1_000_000
_CELLS = 500_000
#: Parts of a language's sources whose pairs are one task, and of a hot source's postings.
_PARTS = 16
_ROWS = 50_000

#: Bytes of a text: A-Z lower-cased, other ASCII that is no letter turned into spaces.
_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint8)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of letters and non-ASCII characters, A-Z lower-cased, and for each the row it is from."""
    _, offsets, data = texts.buffers()
    if data is None or data.size == 0:
        return pa.array([], pa.large_string()), np.zeros(0, dtype=np.int64)
    letters = pa.py_buffer(_LETTERS[np.frombuffer(data, dtype=np.uint8)])
    return flat_words(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, letters]))


def _summed(codes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct codes in order, and the sum of each of ``values`` over a code's rows."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], *[np.add.reduceat(v[order], starts) for v in values]


_RUN = "lang string, term string, source string, n long, docs long"


class _Postings:
    """Postings of a block of documents: a count and a number of documents per (group, term)."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        self.held = 0

    def add(self, batch: pa.RecordBatch) -> None:
        words, rows = words_of(texts_of(batch))
        if not len(words):
            return
        names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        group = np.array([self.groups.setdefault(name, len(self.groups)) for name in names], dtype=np.int64)
        coded = words.dictionary_encode()
        size = len(coded.dictionary)
        per_doc, n = np.unique(rows * size + coded.indices.to_numpy(), return_counts=True)
        codes, n, docs = _summed(group[per_doc // size] * size + per_doc % size, n, np.ones_like(n))
        self.parts.append((codes // size, codes % size, n, docs, coded.dictionary))
        self.held += len(codes)

    def run(self) -> Iterator[pa.RecordBatch]:
        """One row per posting, sorted by (term, language, source)."""
        if not self.parts:
            return
        group, _, n, docs = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        vocabulary = pa.concat_arrays([p[4] for p in self.parts]).dictionary_encode()
        ids, before = vocabulary.indices.to_numpy(), np.cumsum([0, *[len(p[4]) for p in self.parts]])
        term = np.concatenate([ids[first + p[1]] for first, p in zip(before, self.parts)])
        in_order = pc.array_sort_indices(vocabulary.dictionary).to_numpy()
        term_rank, group_rank = np.empty_like(in_order), np.empty(len(self.groups), dtype=np.int64)
        term_rank[in_order] = np.arange(len(in_order))
        names = sorted(self.groups, key=lambda name: (name[0].encode(), name[1].encode()))
        group_rank[[self.groups[name] for name in names]] = np.arange(len(names))
        codes, n, docs = _summed(term_rank[term].astype(np.int64) * len(names) + group_rank[group], n, docs)
        terms, langs, sources = vocabulary.dictionary, pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.string())
        for i in range(0, len(codes), _ROWS):
            part = slice(i, i + _ROWS)
            which = pa.array(codes[part] % len(names))
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(which),
                    terms.take(pa.array(in_order[codes[part] // len(names)])).cast(pa.string()),
                    sources.take(which),
                    pa.array(n[part], pa.int64()),
                    pa.array(docs[part], pa.int64()),
                ],
                names=["lang", "term", "source", "n", "docs"],
            )


def _index(limit: int):
    """Postings in memory until there are ``limit``, then a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Postings()
        for batch in batches:
            for part in slices(batch, "text"):
                block.add(part)
                if block.held >= limit:
                    yield from block.run()
                    block = _Postings()
        yield from block.run()

    return run


_KEPT = "lang string, term string, source string, n long, lang_n long, first boolean"


def _codes(table: pa.Table, names: list[str]) -> np.ndarray:
    """True where any of the columns differs from the row before; True for the first row."""
    change = np.zeros(len(table), dtype=bool)
    change[0] = True
    for name in names:
        ids = table.column(name).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        change[1:] |= ids[1:] != ids[:-1]
    return change


def _whole_terms(batches: Iterator[pa.RecordBatch], fold=None) -> Iterator[pa.Table]:
    """Tables that end where a term ends, of rows with a term's rows together; ``fold`` shrinks the rows of a term that goes on."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part]).combine_chunks()
        begin = int(np.flatnonzero(_codes(part, ["lang", "term"]))[-1])
        if begin:
            yield part.slice(0, begin)
        rest = part.slice(begin)
        rest = fold(rest) if fold else rest
    if rest is not None:
        yield rest


def _added(table: pa.Table) -> pa.Table:
    """Equal postings next to each other added up."""
    starts = np.flatnonzero(_codes(table, ["lang", "term", "source"]))
    kept = table.take(pa.array(starts))
    for name in ("n", "docs"):
        sums = np.add.reduceat(table.column(name).to_numpy(), starts)
        kept = kept.set_column(kept.schema.get_field_index(name), name, pa.array(sums, pa.int64()))
    return kept


def _merge(min_docs: int):
    """Frequencies of the terms of at least ``min_docs`` documents from sorted postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a term that goes on has no more rows than sources
        for table in _whole_terms(batches, _added):
            rows = _added(table)
            first = _codes(rows, ["lang", "term"])
            starts, number = np.flatnonzero(first), np.cumsum(first) - 1
            lang_n = np.add.reduceat(rows.column("n").to_numpy(), starts)[number]
            docs = np.add.reduceat(rows.column("docs").to_numpy(), starts)[number]
            out = rows.drop_columns(["docs"]).append_column("lang_n", pa.array(lang_n, pa.int64())).append_column("first", pa.array(first))
            yield from out.filter(pa.array(docs >= min_docs)).to_batches()

    return run


def term_frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, postings: int = POSTINGS) -> DataFrame:
    """``lang, term, source, n, lang_n, first``: the postings of kept terms, their counts in the whole language, and
    whether a posting is its term's first.

    ``docs`` has ``lang, source, text`` without nulls.
    """
    runs = docs.select("lang", "source", "text").mapInArrow(_index(postings), _RUN)
    shards = runs.repartition("lang", "term").sortWithinPartitions("term", "lang", "source")
    return shards.mapInArrow(_merge(min_docs), _KEPT)


def shares(n: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact for totals below 9e15."""
    whole, rest = np.zeros_like(n), n + 1
    divisor = total + terms
    for _ in range(3):
        rest = rest * 1000
        whole = whole * 1000 + rest // divisor
        rest = rest % divisor
    return whole + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed high part and low 32 bits; sums of either stay far from overflow."""
    return x >> 32, x & 0xFFFFFFFF


_SUMS = "a long, b long, hi long, lo long"


def _sums_batch(a, b, hi, lo) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, hi, lo)], names=["a", "b", "hi", "lo"])


def _reduced(parts: list[tuple]) -> tuple:
    """(a, b, hi, lo) arrays with one row per pair."""
    a, b, hi, lo = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((b, a))
    a, b, hi, lo = a[order], b[order], hi[order], lo[order]
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[starts], b[starts], np.add.reduceat(hi, starts), np.add.reduceat(lo, starts)


def _corrected(g: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[tuple]:
    """Corrections of terms that all ``m`` sources of a row have; arrays are (terms, m). Yields pairs with sums."""
    n_terms, m = g.shape
    rows = max(1, min(m, _CELLS // m))
    step = max(1, _CELLS // (rows * m))
    for t in range(0, n_terms, step):
        for r in range(0, m, rows):
            a, b = (slice(t, t + step), slice(r, r + rows), None), (slice(t, t + step), None)
            wrong = gaps(p[a], p0[b]) + gaps(p0[a], p[b]) - gaps(p0[a], p0[b])
            hi, lo = _halves(gaps(p[a], p[b]) - wrong)
            ga, gb = np.broadcast_to(g[a], hi.shape), np.broadcast_to(g[b], hi.shape)
            other = ga != gb
            if other.any():
                yield _reduced([(ga[other], gb[other], hi[other], lo[other])])


def _shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of each pair of sources for the terms both have, summed over the task."""
    parts: list[tuple] = []
    held = 0
    for table in _whole_terms(batches):
        first = _codes(table, ["lang", "term"])
        starts = np.flatnonzero(first)
        sizes = np.diff(np.r_[starts, len(table)])
        g, n, total, terms = (table.column(c).to_numpy() for c in ("g", "n", "total", "terms"))
        p, p0 = shares(n, total, terms), shares(np.zeros_like(n), total, terms)
        for m in np.unique(sizes[sizes > 1]).tolist():
            at = starts[sizes == m][:, None] + np.arange(m)
            for found in _corrected(g[at], p[at], p0[at]):
                parts.append(found)
                held += len(found[0])
                if held > PAIRS:
                    parts = [_reduced(parts)]
                    held = len(parts[0][0])
                    if held > PAIRS // 2:
                        yield _sums_batch(*parts[0])
                        parts, held = [], 0
    if parts:
        yield _sums_batch(*_reduced(parts))


def _one_sided(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums over all terms as if the other source had none: the part's sources against all sources of the language."""
    part = key[1].as_py()
    g, total, terms, parts = (groups.column(c).to_numpy() for c in ("g", "total", "terms", "own_part"))
    own, n, times = (counts.column(c).to_numpy() for c in ("g", "n", "times"))
    order = np.argsort(own, kind="stable")
    own, n, times = own[order], n[order], times[order]
    zero = np.zeros_like(g)
    if len(g) and terms[0] > 0:
        p0 = shares(zero, total, terms)
    out = []
    for i in np.flatnonzero(parts == part):
        if terms[i] == 0:
            out.append((np.full(len(g), g[i]), g, zero, zero))
            continue
        base, back = gaps(p0[i], p0), gaps(p0, p0[i])
        # every term absent from both
        hi, lo = _halves(base)
        hi, lo, back_hi, back_lo = hi * terms[i], lo * terms[i], zero.copy(), zero.copy()
        a, b = np.searchsorted(own, [g[i], g[i] + 1])
        step = max(1, _CELLS // len(g))
        for s in range(a, b, step):
            c, h = n[s : min(s + step, b)], times[s : min(s + step, b), None]
            p = shares(c, np.full(len(c), total[i]), np.full(len(c), terms[i]))[:, None]
            up, down = _halves(gaps(p, p0[None, :]) - base), _halves(gaps(p0[None, :], p) - back)
            hi, lo = hi + (up[0] * h).sum(0), lo + (up[1] * h).sum(0)
            back_hi, back_lo = back_hi + (down[0] * h).sum(0), back_lo + (down[1] * h).sum(0)
        out += [(np.full(len(g), g[i]), g, hi, lo), (g, np.full(len(g), g[i]), back_hi, back_lo)]
    if not out:
        return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "hi", "lo")})
    a, b, hi, lo = (np.concatenate([o[k] for o in out]) for k in range(4))
    other = a != b
    return pa.Table.from_batches([_sums_batch(a[other], b[other], hi[other], lo[other])])


def _share(n: Column, total: Column, terms: Column) -> Column:
    exact = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    wide = F.call_function("div", exact, (total + terms).cast("decimal(20,0)"))
    # a long holds the product up to here
    return F.when(n < (1 << 63) // SCALE - 1, F.call_function("div", (n + 1) * F.lit(SCALE).cast("long"), total + terms)).otherwise(wide) + 1


def source_audit(docs: DataFrame, min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS, postings: int = POSTINGS) -> DataFrame:
    """``lang, source, part, item, value, rank``: see the module text.

    Part ``pair`` ranks the other sources of the language by their divergence,
    part ``term`` the source's ``term_ranks`` most over-used terms. Null text,
    language and source count as empty; every row is a document, repeated ones
    too, whole however long; texts without terms still make their source a group. Ties are ordered by
    item. Only ``text``, ``lang`` and ``source`` are read, so other columns may
    have any name. An empty table gives no rows.
    """
    empty = F.lit("")
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")])
    counted = materialize(term_frequencies(plain, min_docs, postings), "term-frequencies")

    totals = counted.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = counted.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("terms"))
    none = F.lit(0).cast("long")
    groups = plain.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(whole, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "lang_total", "terms")])
    groups = materialize(groups.withColumn("g", F.monotonically_increasing_id()), "audit-groups")

    # a source with most postings is joined in parts
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    known = counted.withColumn("salt", F.pmod(F.hash("term"), F.lit(_PARTS))).join(salted, ["lang", "source", "salt"]).drop("salt")
    known = materialize(known, "audit-postings")

    by_group = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    p, q = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    over = known.withColumns({"p": p, "q": q}).filter("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    over = over.withColumn("rank", F.row_number().over(by_group)).filter(F.col("rank") <= term_ranks)

    part_of = F.pmod(F.xxhash64("g"), F.lit(_PARTS))
    counts = known.groupBy("lang", "g", "n").agg(F.count(F.lit(1)).alias("times")).withColumn("part_no", part_of)
    each = groups.select("lang", "g", "total", "terms", part_of.alias("own_part"))
    each = each.withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_PARTS - 1).cast("long"))))
    one_sided = counts.groupBy("lang", "part_no").cogroup(each.groupBy("lang", "part_no")).applyInArrow(_one_sided, _SUMS)
    shared = known.select("lang", "term", "g", "n", "total", "terms").repartition("lang", "term").sortWithinPartitions("term", "lang")
    sums = one_sided.unionByName(shared.mapInArrow(_shared_terms, _SUMS))
    wide = "decimal(38,0)"
    sums = sums.groupBy("a", "b").agg(F.sum(F.col("hi").cast(wide)).alias("hi"), F.sum(F.col("lo").cast(wide)).alias("lo"))
    value = (F.col("hi") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("lo")).cast("long")
    names = groups.select(F.col("g").alias("a"), "lang", "source").alias("x")
    others = groups.select(F.col("g").alias("b"), F.col("source").alias("item"))
    pairs = sums.join(names, "a").join(others, "b").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_group))
    return pairs.unionByName(over)


AUDIT_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), w AS (
    SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
    SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3
), c AS (
    SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), v AS (
    SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), g AS (
    SELECT x.lang, x.source, coalesce(v.terms, 0) AS terms, coalesce(v.lang_total, 0) AS lang_total, coalesce(t.total, 0) AS total
    FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v ON x.lang = v.lang
    LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t ON x.lang = t.lang AND x.source = t.source
), dense AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.terms) AS p,
           1 + 1000000000::HUGEINT * (k.lang_n + 1) // (g.lang_total + g.terms) AS q
    FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
        FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
    ) s ON a.lang = s.lang AND a.source = s.source AND b.source = s.other
), terms AS (
    SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM dense WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
