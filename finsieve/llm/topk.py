"""Exact top-k inner products by aggregation without random access.

Each dimension of a block of vectors is a list sorted by value; a query reads
every list from the end that its weight prefers. What has been read bounds the
score of every vector from both sides: unread components lie between the list's
far end and the value at the reading position. A query stops when no vector
outside its best k can reach the k-th lower bound; the vectors that still can
qualify get their score resolved. The bounds of all vectors of a block for all its
queries are one matrix product over what has been read.

Vectors and queries are dealt into blocks of bounded size; a task takes one block
of each, and its k best per query go on to the final ranking.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finsieve.session import materialize

#: Rows of a block; a task holds one block of vectors and one of queries.
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 1_024
#: Rows and queries whose bounds are held at once.
ROW_STRIP, QUERY_STRIP = 16_384, 256
#: Share of each list read before the first and each further look at the bounds.
FIRST_READ, NEXT_READ = 0.25, 0.25


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id`` and ``v``, the components as floor(scale * x).

    Rows whose id or vector is null, or whose vector is empty or holds a null or
    non-finite component, are left out. Repeated rows and ids stay as they are.
    """
    x = F.col(vector_col)
    whole = F.forall(
        x,
        lambda c: c.isNotNull()
        & ~F.isnan(c.cast("double"))
        & (F.abs(c.cast("double")) != F.lit(float("inf"))),
    )
    usable = df.filter(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(whole)
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return usable.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def materialised(vectors: DataFrame) -> DataFrame:
    """``vectors`` as a stored table with a key ``row`` of every row: counted, filtered and joined without being built again."""
    return materialize(vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("row")), "vectors")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    array = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = array.value_lengths().to_numpy(zero_copy_only=False)
    flat = array.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _exact_type(x: np.ndarray, q: np.ndarray) -> type:
    """The fastest type in which every sum of products is exact."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if bound < 2**23 else np.float64 if bound < 2**52 else np.int64


class SortedLists:
    """One sorted list per dimension, read from both ends."""

    def __init__(self, x: np.ndarray):
        self.x = x
        n, d = x.shape
        order = np.argsort(x, axis=0, kind="stable")
        self.rank = np.empty((n, d), dtype=np.int32)
        np.put_along_axis(self.rank, order, np.broadcast_to(np.arange(n, dtype=np.int32)[:, None], (n, d)), axis=0)
        self.sorted = np.take_along_axis(x, order, axis=0)

    def read(self, depth: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What reading ``depth`` entries shows: per row the values read from the top and from the
        bottom end and the lists still unread, and the value at which each end stands."""
        n = len(self.x)
        top, bottom = self.rank >= n - depth, self.rank < depth
        seen_top, seen_bottom = np.where(top, self.x, 0).astype(kind), np.where(bottom, self.x, 0).astype(kind)
        return seen_top, seen_bottom, ~top, ~bottom, np.stack([self.sorted[n - depth], self.sorted[depth - 1]]).astype(kind)


def best_of_block(
    x: np.ndarray, ids: np.ndarray, rows_of: np.ndarray, q: np.ndarray, q_rows: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query of ``q`` its ``k`` best rows of ``x`` but itself (of the same row key): query position, row, score.

    Ties go to the smaller id, then to the smaller row key.
    """
    n = len(x)
    kind = _exact_type(x, q)
    lists = SortedLists(x)
    out_q, out_row, out_score = [], [], []
    for first in range(0, len(q), QUERY_STRIP):
        active = np.arange(first, min(first + QUERY_STRIP, len(q)))
        depth = max(1, int(np.ceil(n * FIRST_READ)))
        while len(active):
            depth = min(depth, n)
            # a positive weight reads its list from the top, a negative one from the bottom
            up, down = np.maximum(q[active], 0).astype(kind).T, np.minimum(q[active], 0).astype(kind).T
            seen_top, seen_bottom, open_top, open_bottom, stand = lists.read(depth, kind)
            known = seen_top @ up + seen_bottom @ down
            open_lists = np.concatenate([open_top, open_bottom], axis=1).astype(kind)
            high = known + open_lists @ np.concatenate([up * stand[0][:, None], down * stand[1][:, None]])
            low = known + open_lists @ np.concatenate(
                [up * lists.sorted[0].astype(kind)[:, None], down * lists.sorted[-1].astype(kind)[:, None]]
            )
            own = rows_of[:, None] == q_rows[active][None, :]
            least = np.iinfo(np.int64).min // 4 if kind is np.int64 else -np.inf
            high[own] = least
            low[own] = least
            take = min(k, n)
            kth = np.partition(low, n - take, axis=0)[n - take]
            # outsiders qualify while they can reach the k-th lower bound, ties included
            open_count = (high >= kth).sum(axis=0)
            done = (open_count <= 4 * k + 16) | (depth == n)
            for j in np.flatnonzero(done):
                rows = np.flatnonzero((high[:, j] >= kth[j]) & ~own[:, j])
                score = (x[rows] * q[active[j]]).sum(axis=1)
                rows = rows[np.lexsort((rows_of[rows], ids[rows], -score))][:k]
                out_q.append(np.full(len(rows), active[j]))
                out_row.append(rows)
                out_score.append((x[rows] * q[active[j]]).sum(axis=1))
            active = active[~done]
            depth += max(1, int(np.ceil(n * NEXT_READ)))
    if not out_q:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(out_q), np.concatenate(out_row), np.concatenate(out_score)


def _block_task(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([(c, pa.int64()) for c in ("query_id", "query_row", "vec_id", "row", "score")])
        if vectors.num_rows == 0 or queries.num_rows == 0:
            return schema.empty_table()
        width = max(
            int(max(c.value_lengths().to_numpy(zero_copy_only=False).max(initial=0) for c in t["v"].chunks)) for t in (vectors, queries)
        )
        ids, rows_of, q_ids, q_rows = (t[c].to_numpy() for t in (vectors, queries) for c in ("vec_id", "row"))
        at, rows, scores = best_of_block(_matrix(vectors["v"], width), ids, rows_of, _matrix(queries["v"], width), q_rows, k)
        return pa.table([q_ids[at], q_rows[at], ids[rows], rows_of[rows], scores.astype(np.int64)], schema=schema)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row of ``queries`` (both as :func:`materialised` stores them).

    Gives ``query_id, rank, vec_id, score``; the query's own row is no candidate,
    another row with its id or vector is one. Ties go to the smaller id, and a
    query with fewer candidates gets all of them. Missing components of shorter
    vectors count as zero. Empty tables give no rows; other columns are ignored.
    """
    n, m = vectors.count(), queries.count()
    n_blocks, m_blocks = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-m // QUERY_BLOCK))

    def blocked(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.select(
            "vec_id",
            "v",
            "row",
            F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other),
        )

    left = blocked(vectors, "v_block", n_blocks, "q_block", m_blocks)
    right = blocked(queries, "q_block", m_blocks, "v_block", n_blocks)
    found = (
        left.groupBy("v_block", "q_block")
        .cogroup(right.groupBy("v_block", "q_block"))
        .applyInArrow(_block_task(k), "query_id long, query_row long, vec_id long, row long, score long")
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOPK_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.row_no AS query_row, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.row_no <> c.row_no WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
