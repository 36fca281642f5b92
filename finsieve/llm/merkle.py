"""Merkle manifest of a table by time-forward processing.

Every row is a leaf, every source a tree of runs of three, and the subroots of all
sources form one more tree. Nodes are labelled (tree, level, place). A digest is a
message from a node to its parent, taken from a priority queue in the order of
labels, so a parent finds its children's digests in a row when its time comes.

The queue is external: messages for labels further up than a block of levels are
rows of a stored table, and Spark's sort by label hands them to the task of the
block they belong to. Inside a block of ``3 ** LEVELS`` consecutive nodes the queue
is a heap. A source of any size is therefore many blocks, and a round climbs
``LEVELS`` levels. The reversed sweep goes the same way down: a block receives the
proof suffix of its topmost node and passes longer ones on, from parents to children,
until each leaf has its siblings' digests from the leaf to the root.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finsieve.operators.ordering import with_global_position
from finsieve.session import materialize

#: Children of a node.
ARITY = 3
#: Levels that one round climbs.
LEVELS = 5
BLOCK = ARITY**LEVELS
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# positions of one chunk when a source's place in the order is looked up
_CHUNK_BITS = 10


def field_bytes(value: Column) -> Column:
    """A field as hashed: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_bytes(f) for f in fields]), 256))


def _hash(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _above(n: int) -> int:
    return -(-n // ARITY)


class _Block:
    """Consecutive nodes of one tree, climbed by a queue of messages in the order of labels (level, place)."""

    def __init__(self, first: int, n: int, digests: list[bytes]):
        self.widths = [n]
        while len(self.widths) <= LEVELS and self.widths[-1] > 1:
            self.widths.append(_above(self.widths[-1]))
        top = len(self.widths) - 1
        self.runs: list[tuple[int, int, list[bytes]]] = []
        queue = [(0, first + i, d) for i, d in enumerate(digests)]
        while queue[0][0] < top:
            level, place, digest = heapq.heappop(queue)
            run = [digest]
            while queue and queue[0][0] == level and queue[0][1] // ARITY == place // ARITY:
                run.append(heapq.heappop(queue)[2])
            self.runs.append((level, place, run))
            heapq.heappush(queue, (level + 1, place // ARITY, _hash(run)))
        (_, self.place, self.digest), self.n = queue[0], self.widths[top]

    def proofs(self, first: int, count: int, suffix: bytes) -> list[bytes]:
        """Siblings' digests of every node of the block, lowest level first, then ``suffix``."""
        waiting = {(len(self.widths) - 1, self.place): suffix}
        for level, place, run in reversed(self.runs):
            after = waiting.pop((level + 1, place // ARITY))
            for i in range(len(run)):
                waiting[level, place + i] = b"".join(run[:i] + run[i + 1 :]) + after
        return [waiting[0, first + i] for i in range(count)]


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a block ends; rows come sorted by (tree, block)."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part]).combine_chunks()
        tree, block = part.column("tree").to_numpy(), part.column("block").to_numpy()
        begin = len(tree) - 1
        while begin and tree[begin - 1] == tree[-1] and block[begin - 1] == block[-1]:
            begin -= 1
        if begin:
            yield part.slice(0, begin)
        rest = part.slice(begin)
    if rest is not None:
        yield rest


def _starts(table: pa.Table) -> list[int]:
    """Where each block begins, and the end."""
    tree, block = table.column("tree").to_numpy(), table.column("block").to_numpy()
    change = (tree[1:] != tree[:-1]) | (block[1:] != block[:-1])
    return [0, *(change.nonzero()[0] + 1).tolist(), len(tree)]


_NODE = "tree long, place long, n long, digest binary"


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_blocks(batches):
        tree, place, n = (table.column(c).to_pylist() for c in ("tree", "place", "n"))
        digests = table.column("digest").to_pylist()
        starts = _starts(table)
        tops = [_Block(place[a], n[a], digests[a:b]) for a, b in zip(starts, starts[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([tree[a] for a in starts[:-1]], pa.int64()),
                pa.array([t.place for t in tops], pa.int64()),
                pa.array([t.n for t in tops], pa.int64()),
                pa.array([t.digest for t in tops], pa.binary()),
            ],
            names=["tree", "place", "n", "digest"],
        )


def _descend(sent: list[str], names: list[str]):
    """Gives the nodes of each block their proofs and the columns ``sent`` of the block's message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches):
            place, n = table.column("place").to_pylist(), table.column("n").to_pylist()
            digests, suffix = table.column("digest").to_pylist(), table.column("proof").to_pylist()
            starts = _starts(table)
            nodes, proofs, messages = [], [], []
            # the message sorts before the block's nodes
            for a, b in zip(starts, starts[1:]):
                first = a + 1
                if first == b:
                    continue
                block = _Block(place[first], n[first], digests[first:b])
                proofs += block.proofs(place[first], b - first, suffix[a])
                nodes += range(first, b)
                messages += [a] * (b - first)
            rows, above = table.take(pa.array(nodes, pa.int64())), table.take(pa.array(messages, pa.int64()))
            columns = [pa.array(proofs, pa.binary()) if c == "proof" else (above if c in sent else rows).column(c) for c in names]
            yield from pa.table(columns, names=names).to_batches()

    return run


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / BLOCK).cast("long"))


def _rounds(most: int) -> int:
    """Rounds until trees of at most ``most`` leaves are one node; one at least."""
    rounds = 1
    while most > BLOCK:
        most, rounds = -(-most // BLOCK), rounds + 1
    return rounds


def _climbed(leaves: DataFrame, most: int) -> list[DataFrame]:
    """The nodes that each round starts from; the last table holds one node per tree."""
    tables = [leaves]
    for _ in range(_rounds(most)):
        queue = _blocks(tables[-1].select("tree", "place", "n", "digest")).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
        tables.append(materialize(queue.mapInArrow(_climb, _NODE), "merkle-nodes"))
    return tables


def _descended(tables: list[DataFrame], messages: DataFrame) -> DataFrame:
    """``messages`` (``tree``, ``proof`` and more columns) of the topmost nodes carried down to the leaves of ``tables[0]``."""
    payload = [c for c in messages.columns if c not in ("tree", "block")]
    queue = messages.withColumn("block", F.lit(0).cast("long"))
    for round_no in range(len(tables) - 2, -1, -1):
        nodes = tables[round_no]
        both = _blocks(nodes).unionByName(queue.withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)
        names = [*nodes.columns, *payload]
        kinds = {f.name: f.dataType for f in both.schema.fields}
        schema = T.StructType([T.StructField(c, kinds[c]) for c in names])
        dealt = both.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
        down = dealt.mapInArrow(_descend(payload, names), schema)
        if round_no:
            queue = materialize(down.select("tree", F.col("place").alias("block"), *payload), "merkle-suffixes")
    return down


@dataclass
class Manifest:
    """``leaves``: a row per row of the input with ``doc_id``, ``leaf``, ``seen``, ``subroot``, ``root``, its place among the
    ``n`` leaves of its source, its source's ``rank`` among all ``n_trees``, and ``proof``, the siblings' digests from leaf to root.

    Digests are 32 bytes, a proof is several of them end to end.
    """

    leaves: DataFrame
    root: bytes | None


def build_manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, source: str = "source", key: str = "doc_id") -> Manifest:
    """Leaves, subroots, root and a proof for every row of ``docs``.

    A leaf hashes the columns ``fields``; other columns are ignored whatever
    their names. Trees are the values of ``source`` (null is one, and the first),
    their leaves ascend by ``key`` (null first); equal keys are ordered by their
    digests, so repeated rows are leaves of their own beside each other. Null and
    empty texts differ. A text of any length is one digest. ``tampered`` replaces
    fields in the digest ``seen``, which is what a reader would compute from the
    stored row; without it ``seen`` is the leaf. A table of one row is its own
    root, with an empty proof; an empty table has no leaves and no root.
    """
    leaf = leaf_digest([F.col(c) for c in fields])
    seen = leaf
    if tampered:
        # what is not touched is not hashed again
        changed = F.lit(False)
        for c, value in tampered.items():
            changed = changed | ~value.eqNullSafe(F.col(c))
        seen = F.when(changed, leaf_digest([tampered.get(c, F.col(c)) for c in fields])).otherwise(leaf)
    records = docs.select(F.col(source).cast("string").alias("source"), F.col(key).alias("doc_id"), leaf.alias("digest"), seen.alias("seen"))
    records = materialize(records, "merkle-records")
    # ascending puts nulls first, and strings compare by their bytes
    placed = with_global_position(records, ["source", "doc_id", "digest"], "at")
    leaves = materialize(_places_in_sources(placed), "merkle-leaves")
    widest = leaves.agg(F.max("n")).first()[0] or 1
    trees = _climbed(leaves, widest)

    # sources in order are the leaves of the last tree
    ranked = with_global_position(trees[-1].select(F.col("tree").alias("of"), "digest"), ["of"], "place")
    n_trees = ranked.count()
    subroots = materialize(ranked.select(F.lit(0).cast("long").alias("tree"), "place", F.lit(n_trees).cast("long").alias("n"), "digest", "of"), "merkle-subroots")
    top = _climbed(subroots, n_trees)
    root = top[-1].select("digest").first()
    root = bytes(root[0]) if root else None
    start = top[-1].select("tree", F.lit(b"").alias("proof"))
    sources = _descended(top, start)
    messages = sources.select(
        F.col("of").alias("tree"), "proof", F.col("digest").alias("subroot"), F.col("place").alias("rank"), F.col("n").alias("n_trees"), F.lit(root).cast("binary").alias("root")
    )
    down = _descended(trees, materialize(messages, "merkle-sources"))
    return Manifest(down.select("doc_id", F.col("digest").alias("leaf"), "seen", "subroot", "root", "place", "n", "rank", "n_trees", "proof"), root)


def _places_in_sources(placed: DataFrame) -> DataFrame:
    """``tree, place, n`` of each leaf: the position of its source's first leaf, its place in the source, the source's size.

    A source's rows are consecutive, so they are counted by (chunk of positions,
    source). Joining on that pair gives no key more rows than a chunk.
    """
    chunked = placed.withColumn("chunk", F.shiftright("at", _CHUNK_BITS)).withColumn("known", F.col("source").isNotNull())
    chunked = chunked.withColumn("source", F.coalesce("source", F.lit("")))
    by = ["chunk", "known", "source"]
    counts = materialize(chunked.groupBy(*by).agg(F.min("at").alias("tree"), F.count(F.lit(1)).alias("n")), "source-chunks")
    whole = counts.groupBy("known", "source").agg(F.min("tree").alias("tree"), F.sum("n").alias("n"))
    spread = counts.select(*by).join(whole, ["known", "source"])
    return chunked.join(spread, by).select("tree", (F.col("at") - F.col("tree")).alias("place"), "n", "digest", "doc_id", "seen")


def folded(digest: bytes, proof: bytes, paths: list[tuple[int, int]]) -> bytes:
    """The root that ``digest`` leads to: ``paths`` are (place, number of leaves) in each tree on the way up."""
    at = 0
    for place, n in paths:
        while n > 1:
            first = place - place % ARITY
            others = min(ARITY, n - first) - 1
            siblings = [proof[at + 32 * i : at + 32 * (i + 1)] for i in range(others)]
            at += 32 * others
            siblings.insert(place - first, digest)
            digest, place, n = _hash(siblings), place // ARITY, _above(n)
    return digest


@F.pandas_udf(T.BinaryType())
def fold(digest: pd.Series, proof: pd.Series, place: pd.Series, n: pd.Series, rank: pd.Series, n_trees: pd.Series) -> pd.Series:
    """:func:`folded` of a leaf through its source's tree and the tree of sources."""
    rows = zip(digest, proof, place.tolist(), n.tolist(), rank.tolist(), n_trees.tolist(), strict=True)
    return pd.Series([folded(d, p, [(i, m), (r, t)]) for d, p, i, m, r, t in rows], dtype=object)


def manifest_digests(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` with every second document's line breaks lost before it is verified."""
    lost = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    leaves = build_manifest(docs, {"text": F.when(lost, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}).leaves
    hexed = lambda c: F.lower(F.hex(c))
    checked = leaves.withColumn("found", fold("seen", "proof", "place", "n", "rank", "n_trees"))
    return checked.select(
        "doc_id",
        hexed("leaf").alias("leaf"),
        hexed("subroot").alias("subroot"),
        hexed("root").alias("root"),
        F.sha2(hexed("proof"), 256).alias("proof_sha256"),
        hexed("found").alias("folded_root"),
        (F.col("found") == F.col("root")).alias("verified"),
    )


def _sql_field(value: str) -> str:
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


def _sql_leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(_sql_field(v) for v in values) + ")"


#: CRC-32 (reflected polynomial 0xEDB88320) of a decimal number, bit by bit.
_SQL_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)))"""

MANIFEST_SQL = f"""
WITH RECURSIVE crc AS (
    SELECT *, coalesce({_SQL_CRC} % 2 = 0, FALSE) AS lost FROM documents
), rec AS (
    SELECT doc_id, source, {_sql_leaf("text")} AS leaf, CASE WHEN lost THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS seen FROM crc
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
           dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
    FROM rec
), up AS (
    SELECT tree, 0 AS lvl, idx, n, leaf AS digest FROM leaves
    UNION ALL
    SELECT tree, lvl + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY tree, lvl, idx // 3
), top AS (
    SELECT 0 AS lvl, tree AS idx, count(*) OVER () AS n, digest FROM up WHERE n = 1
    UNION ALL
    SELECT lvl + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 3
), nodes AS (
    SELECT tree, lvl, idx, n, digest FROM up UNION ALL SELECT -1, lvl, idx, n, digest FROM top
), sib AS (
    SELECT a.tree, a.lvl, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l,
           coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
    FROM nodes a LEFT JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 AND a.idx <> b.idx
    WHERE a.n > 1 GROUP BY a.tree, a.lvl, a.idx
), fold AS (
    SELECT row_number() OVER () AS row_no, doc_id, leaf, tree AS own, tree, 0 AS lvl, idx, n, seen AS digest, '' AS proof FROM leaves
    UNION ALL
    SELECT row_no, doc_id, leaf, own, CASE WHEN f.n = 1 THEN -1 ELSE f.tree END, CASE WHEN f.n = 1 THEN 0 ELSE f.lvl + 1 END,
           CASE WHEN f.n = 1 THEN f.tree ELSE f.idx // 3 END, CASE WHEN f.n = 1 THEN (SELECT max(n) FROM top) ELSE (f.n + 2) // 3 END,
           CASE WHEN f.n = 1 THEN f.digest ELSE sha256(s.l || f.digest || s.r) END, CASE WHEN f.n = 1 THEN f.proof ELSE f.proof || s.l || s.r END
    FROM fold f LEFT JOIN sib s ON f.tree = s.tree AND f.lvl = s.lvl AND f.idx = s.idx
    WHERE NOT (f.tree = -1 AND f.n = 1)
)
SELECT doc_id, leaf, u.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM fold f JOIN up u ON f.own = u.tree AND u.n = 1 JOIN top t ON t.n = 1
WHERE f.tree = -1 AND f.n = 1
"""
