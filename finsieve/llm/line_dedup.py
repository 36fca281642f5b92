"""Repeated lines dropped by streaming sorted line hashes into keep bitmaps.

Lines that are long enough are hashed and range-partitioned by (hash, document
descending, position), so even the rows of one very common line are spread over
many tasks. Each task streams its sorted rows once: the first document of a hash
keeps its lines, the lines of the others go when the hash has enough documents.
What lies across a partition's borders is left open and settled from the largest
few documents of each border hash, a handful of rows per partition. Texts never
take part: the result is one compressed bitmap of kept lines per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finsieve.llm.names import fresh
from finsieve.session import materialize

#: Stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shorter keys are never dropped.
MIN_CHARS = 20
#: A line goes when at least so many documents hold it.
MIN_DOCS = 3

#: Stands for a null document id: the lowest of all.
NO_ID = -(1 << 63)
_DROP, _OPEN, _BORDER = 0, 1, 2
_STREAMED = "h binary, doc long, text_key long, pos int, n_lines int, kind int"
_SCHEMA = pa.schema([("h", pa.binary()), ("doc", pa.int64()), ("text_key", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32()), ("kind", pa.int32())])


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _doc(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line whose key has at least ``min_chars`` code points: 16 bytes of SHA-256, document, position."""
    lines = docs.select(_doc(F.col("doc_id")).alias("doc"), _text_key(F.col("text")).alias("text_key"), lines_of(F.col("text")).alias("lines"))
    each = lines.select("doc", "text_key", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keyed = each.select("doc", "text_key", "n_lines", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return keyed.select(F.substring(F.unhex(F.sha2("key", 256)), 1, 16).alias("h"), "doc", "text_key", "pos", "n_lines")


class _Rows:
    """Sorted rows as arrays; ``sent`` marks rows that are only kept as a reminder of their document."""

    def __init__(self, h, doc, text_key, pos, n_lines, sent):
        self.h, self.doc, self.text_key, self.pos, self.n_lines, self.sent = h, doc, text_key, pos, n_lines, sent

    @staticmethod
    def of(batch: pa.RecordBatch) -> _Rows:
        fixed = batch.column(0).cast(pa.binary(16))
        h = np.frombuffer(fixed.buffers()[1], dtype=">u8")[2 * fixed.offset : 2 * (fixed.offset + len(fixed))].reshape(-1, 2)
        return _Rows(h, *[batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)], np.zeros(batch.num_rows, dtype=bool))

    def fields(self):
        return self.h, self.doc, self.text_key, self.pos, self.n_lines, self.sent

    def take(self, which) -> _Rows:
        return _Rows(*[x[which] for x in self.fields()])

    def after(self, before: _Rows | None) -> _Rows:
        return self if before is None else _Rows(*[np.concatenate(pair) for pair in zip(before.fields(), self.fields(), strict=True)])

    def __len__(self) -> int:
        return len(self.doc)

    def out(self, kind: int) -> pa.RecordBatch:
        hashes = pa.array([None] * len(self), pa.binary()) if kind == _DROP else pa.array([row.tobytes() for row in np.ascontiguousarray(self.h)], pa.binary())
        numbers = [pa.array(x, t) for x, t in ((self.doc, pa.int64()), (self.text_key, pa.int64()), (self.pos, pa.int32()), (self.n_lines, pa.int32()))]
        return pa.RecordBatch.from_arrays([hashes, *numbers, pa.array(np.full(len(self), kind), pa.int32())], schema=_SCHEMA)


def _first_rows_of_docs(rows: _Rows, most: int) -> _Rows:
    """The first row of each of the first ``most`` documents of one hash."""
    starts = np.flatnonzero(np.r_[True, rows.doc[1:] != rows.doc[:-1]])[:most]
    return rows.take(starts)


def _stream(min_docs: int):
    """Decides the sorted rows of one partition; see the module text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = head_docs = carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Rows.of(batch)
            if head is None:
                head = rows.h[0].copy()
            # rows are sorted, so those of the partition's first hash come first
            n_head = int(np.argmin(np.r_[(rows.h == head).all(axis=1), False]))
            if n_head:
                first = rows.take(slice(0, n_head))
                yield first.out(_OPEN)
                head_docs = _first_rows_of_docs(first.after(head_docs), min_docs)
                rows = rows.take(slice(n_head, None))
            if not len(rows):
                continue
            rows = rows.after(carry)
            group = np.r_[True, (rows.h[1:] != rows.h[:-1]).any(axis=1)]
            new_doc = group | np.r_[True, rows.doc[1:] != rows.doc[:-1]]
            starts = np.flatnonzero(group)
            number = np.cumsum(group) - 1
            rank = np.cumsum(new_doc) - 1
            rank = rank - rank[starts][number]
            n_docs = rank[np.r_[starts[1:] - 1, len(rows) - 1]] + 1
            decided = (rank > 0) & (n_docs[number] >= min_docs) & ~rows.sent
            if decided.any():
                yield rows.take(decided).out(_DROP)
            # the last hash may go on: keep its undecided rows, or a reminder of its first documents
            last = rows.take(slice(int(starts[-1]), None))
            if n_docs[-1] >= min_docs:
                carry = _first_rows_of_docs(last, min_docs)
                carry.sent = np.ones(len(carry), dtype=bool)
            else:
                carry = last
        if carry is not None:
            if not carry.sent.all():
                yield carry.out(_OPEN)
            yield _first_rows_of_docs(carry, min_docs).out(_BORDER)
        if head_docs is not None:
            yield head_docs.out(_BORDER)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed, dropped = [], []
        for n, positions in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            gone = positions.values.to_numpy()
            keep = np.ones(n, dtype=bool)
            keep[gone] = False
            packed.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(len(gone))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(dropped, pa.int32()), pa.array(packed, pa.binary())],
            names=["doc", "text_key", "n_lines", "n_dropped", "keep_bitmap"],
        )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, text_key, n_lines, n_dropped, keep_bitmap`` of every document that loses lines.

    Reads ``doc_id`` and ``text`` only, so other columns may have any name. A
    line's key is the line without white space at its ends, A-Z lower-cased. Keys
    of at least ``min_chars`` code points held by at least ``min_docs`` documents
    lose their lines except in the largest ``doc_id``, which keeps all of its
    own. Rows with one ``doc_id`` count as one document, null ids together as the
    lowest one (``doc`` is then :data:`NO_ID`); rows equal in id and text share a
    bitmap. Null and empty texts have one empty line, which stays. A very long text is
    just many lines; its positions meet again in one row. The bitmap is
    a zlib stream of one bit a line, 1 for kept, padded to whole bytes. An empty
    table gives no rows.
    """
    # stored first: range partitioning reads its input once for the bounds and once to deal it out
    hashes = materialize(line_hashes(docs, min_chars), "line-hashes")
    placed = hashes.repartitionByRange("h", F.col("doc").desc(), "text_key", "pos")
    placed = placed.sortWithinPartitions("h", F.col("doc").desc(), "text_key", "pos")
    streamed = materialize(placed.mapInArrow(_stream(min_docs), _STREAMED), "line-decisions")
    # at most 2 * min_docs rows a partition
    borders = streamed.filter(F.col("kind") == _BORDER).groupBy("h").agg(F.max("doc").alias("best"), F.count_distinct("doc").alias("docs"))
    borders = borders.filter(F.col("docs") >= min_docs).select("h", "best")
    settled = streamed.filter(F.col("kind") == _OPEN).join(F.broadcast(borders), "h").filter(F.col("doc") != F.col("best"))
    columns = ["doc", "text_key", "n_lines", "pos"]
    dropped = streamed.filter(F.col("kind") == _DROP).select(*columns).unionByName(settled.select(*columns))
    # a document's positions are no more than its lines
    per_doc = dropped.groupBy("doc", "text_key", "n_lines").agg(F.collect_set("pos").alias("gone"))
    return per_doc.mapInArrow(_bitmaps, "doc long, text_key long, n_lines int, n_dropped int, keep_bitmap binary")


@F.pandas_udf(T.StringType())
def _kept_text(text: pd.Series, n_lines: pd.Series, bitmap: pd.Series) -> pd.Series:
    kept = []
    for t, n, bits in zip(text, n_lines, bitmap, strict=True):
        if bits is None:
            kept.append(None)
            continue
        keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), dtype=np.uint8), count=int(n))
        kept.append("\n".join(line for line, k in zip(t.split("\n"), keep.tolist(), strict=True) if k))
    return pd.Series(kept, dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the lines dropped from ``text``, and two columns more: ``n_lines`` (before) and ``n_dropped``.

    All rows and columns stay; where the caller has a column of such a name the
    new one gets underscores before its name. A text that loses nothing is
    unchanged (null stays null); one that loses all lines is empty.
    """
    lines, gone = fresh("n_lines", docs.columns), fresh("n_dropped", docs.columns)
    taken = [*docs.columns, lines, gone]
    doc, key, n, lost, bits = (fresh(f"bitmap_{name}", taken) for name in ("doc", "text_key", "n_lines", "n_dropped", "keep"))
    right = bitmaps.select(
        F.col("doc").alias(doc), F.col("text_key").alias(key), F.col("n_lines").alias(n), F.col("n_dropped").alias(lost), F.col("keep_bitmap").alias(bits)
    )
    joined = docs.join(right, (_doc(docs["doc_id"]) == right[doc]) & (_text_key(docs["text"]) == right[key]), "left")
    changed = F.col(bits).isNotNull()
    # rows without a bitmap hand no text to Python
    kept = F.when(changed, _kept_text(F.when(changed, F.col("text")), F.col(n), F.col(bits))).otherwise(F.col("text"))
    return joined.select(
        *[kept.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.size(lines_of(F.col("text"))).cast("long").alias(lines),
        F.coalesce(F.col(lost), F.lit(0)).cast("long").alias(gone),
    )


def line_digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_lines, n_dropped`` and the SHA-256 of the lines kept."""
    kept = apply_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


LINES_SQL = r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
    FROM documents
), k AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), g AS (
    SELECT key, max(doc_id) AS best FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
    SELECT k.*, coalesce(k.doc_id <> g.best, FALSE) AS gone FROM k LEFT JOIN g ON k.key = g.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
