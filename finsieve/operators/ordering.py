"""Ordering primitives that never pull a whole table, or one key, into a task.

All of them cut the order into coarse buckets first. Bucket totals are small,
so positions and prefix sums over buckets are cheap; only the rows inside one
bucket are ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finsieve.session import materialize

# rows of one chunk of consecutive row numbers
CHUNK_BITS = 22
# hex digits of a draw key used as its bucket: 16^4 buckets
PREFIX_DIGITS = 4
#: Rows that one task sorts, about.
TASK_ROWS = 1 << 17


def parts_for(spark: SparkSession, rows: int) -> int:
    """Number of partitions for ``rows`` rows: one per core, or more where a task would get over ``TASK_ROWS``."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def with_global_position(
    df: DataFrame, order: list[str], name: str = "row_idx", partitions: int | None = None
) -> DataFrame:
    """Number all rows 0..N-1 by ``order``, which must be a total order.

    Range partitioning spreads the order over tasks, also inside a run of equal
    leading keys. Its bounds come from a sample, so the partitioned table is
    written once and both the per-partition counts and the result read that copy.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        # the low 33 bits of this id count rows within the partition
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    stored = materialize(placed, "positioned")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    starts = (
        stored.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        stored.join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + F.col("_pos")).cast("bigint"))
        .drop("_part", "_pos", "_start")
    )


def row_chunk(row_idx: str | Column, bits: int = CHUNK_BITS) -> Column:
    """Bucket of at most ``2**bits`` consecutive row numbers."""
    col = F.col(row_idx) if isinstance(row_idx, str) else row_idx
    return F.shiftright(col, bits)


def value_bucket(value: str | Column) -> Column:
    """Order-preserving bucket of a number: 64 buckets per power of two.

    A float32 column has at most 2^17 different values in one bucket. Doubles down
    to the smallest come in order, then infinity, then NaN as Spark sorts it.
    """
    v = F.col(value) if isinstance(value, str) else value
    v = v.cast("double")
    # exponents lie between -1075 and 1024, so this is positive for every finite number but 0
    size = F.abs(v)
    mag = F.when(size == F.lit(float("inf")), F.lit(200_000)).otherwise(F.floor(F.log2(size) * 64) + 80_000)
    return F.when(F.isnan(v), F.lit(300_000)).when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0)).cast("bigint")


def draw_key(seed: int, row_idx: str = "row_idx") -> Column:
    """Uniform pseudo-random text key of a row, the same on every engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_idx).cast("string")))


def prefix_sums(
    df: DataFrame, keys: list[str], value: str, sums: list[str], descending: bool = False
) -> DataFrame:
    """Inclusive running sums ``cum_<name>`` of ``sums`` along ``value``, and totals ``tot_<name>``, per key.

    ``df`` holds one row per (key, value). Rows are sorted only within a
    (key, value bucket) pair; the running totals of whole buckets are joined on.
    """
    inner = F.col(value).desc() if descending else F.col(value).asc()
    outer = F.col("_b").desc() if descending else F.col("_b").asc()
    b = df.withColumn("_b", value_bucket(value))
    totals = b.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(outer).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "_b",
        *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_c_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(whole).alias(f"tot_{c}") for c in sums],
    )
    local = (
        Window.partitionBy(*keys, "_b").orderBy(inner).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = b.withColumns({f"_l_{c}": F.sum(c).over(local) for c in sums})
    out = running.join(carried, [*keys, "_b"])
    return out.withColumns({f"cum_{c}": F.col(f"_l_{c}") + F.col(f"_c_{c}") for c in sums}).drop(
        "_b", *[f"_l_{c}" for c in sums], *[f"_c_{c}" for c in sums]
    )


def running_best(df: DataFrame, value: str, names: list[str]) -> DataFrame:
    """``top_<name>``: the greatest of each of ``names`` among the rows whose ``value`` is this row's or more.

    ``df`` holds one row per value; sorted in buckets, as in :func:`prefix_sums`.
    """
    b = df.withColumn("_b", value_bucket(value))
    higher = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket
    totals = b.groupBy("_b").agg(*[F.max(c).alias(f"_t_{c}") for c in names])
    carried = totals.select("_b", *[F.max(f"_t_{c}").over(higher).alias(f"_c_{c}") for c in names])
    local = Window.partitionBy("_b").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = b.withColumns({f"_l_{c}": F.max(c).over(local) for c in names}).join(carried, "_b")
    return out.withColumns({f"top_{c}": F.greatest(f"_l_{c}", f"_c_{c}") for c in names}).drop(
        "_b", *[f"_l_{c}" for c in names], *[f"_c_{c}" for c in names]
    )


def chunk_positions(df: DataFrame, row_idx: str = "row_idx", name: str = "pos", bits: int = CHUNK_BITS) -> DataFrame:
    """Positions 0..n-1 of a subset of numbered rows, in row order."""
    c = df.withColumn("_c", row_chunk(row_idx, bits))
    earlier = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    # one row per chunk
    starts = (
        c.groupBy("_c")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_c", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    local = Window.partitionBy("_c").orderBy(row_idx)
    return (
        c.withColumn("_k", F.row_number().over(local) - 1)
        .join(starts, "_c")
        .withColumn(name, (F.col("_start") + F.col("_k")).cast("bigint"))
        .drop("_c", "_k", "_start")
    )


def _cut_buckets(bucketed: DataFrame, key: str, quotas: dict) -> list:
    """Per group the bucket ``_cut`` that holds its ``quota``-th row, and how many rows of that bucket it takes (``_need``).

    ``bucketed`` has the bucket as ``_b``. A group with fewer rows than its quota gets its last bucket, whole.
    """
    wanted = bucketed.sparkSession.createDataFrame(list(quotas.items()), f"{key} {dict(bucketed.dtypes)[key]}, _want bigint")
    running = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = (
        bucketed.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_cum", F.sum("_n").over(running))
    )
    return (
        counts.join(F.broadcast(wanted), key)
        .withColumn("_short", F.col("_cum") < F.col("_want"))
        .groupBy(key)
        .agg(
            F.min(F.when(~F.col("_short"), F.col("_b"))).alias("_cut"),
            F.max(F.col("_b")).alias("_last"),
            F.max(F.when(F.col("_short"), F.col("_cum"))).alias("_below"),
            F.first("_want").alias("_want"),
        )
        .select(
            key,
            F.coalesce("_cut", "_last").alias("_cut"),
            F.when(F.col("_cut").isNull(), F.lit((1 << 62)))
            .otherwise(F.col("_want") - F.coalesce("_below", F.lit(0)))
            .alias("_need"),
        )
        # one row per group
        .collect()
    )


def last_taken(df: DataFrame, quotas: int | dict, bucket: Column, order: list[str], group: str | None = None) -> dict:
    """Per group the values of ``order`` in the last of its first ``quota`` rows; None where it has no more rows than that.

    A set of first rows is thereby a predicate (see :func:`up_to`), not a list of rows.
    ``bucket`` must not decrease along ``order``; only the bucket that holds the cut is ranked.
    """
    key = group or "_g"
    df = df if group else df.withColumn("_g", F.lit(0))
    quotas = {g: int(n) for g, n in (quotas if group else {0: quotas}).items() if int(n) > 0}
    b = df.select(key, *order, bucket.alias("_b"))
    found = {r[key]: r for r in _cut_buckets(b, key, quotas)} if quotas else {}
    out = {g: None for g in quotas}
    cut = [r for r in found.values() if r["_need"] < 1 << 62]
    if cut:
        marks = df.sparkSession.createDataFrame([(r[key], r["_cut"], r["_need"]) for r in cut], T.StructType([b.schema[key], T.StructField("_b", b.schema["_b"].dataType), T.StructField("_need", T.LongType())]))
        rank = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order))
        for r in b.join(F.broadcast(marks), [key, "_b"]).withColumn("_r", rank).filter("_r = _need").collect():
            out[r[key]] = tuple(r[c] for c in order)
    return out


def up_to(order: list[Column], last: tuple | None) -> Column:
    """Whether a row comes no later than ``last`` in ``order``; always for None."""
    if last is None:
        return F.lit(True)
    met = F.lit(True)
    for column, value in reversed(list(zip(order, last, strict=True))):
        met = (column < F.lit(value)) | ((column == F.lit(value)) & met)
    return met


def rows_at(df: DataFrame, positions: list[int], row_idx: str = "row_idx", bits: int = CHUNK_BITS) -> dict[int, int]:
    """The row numbers at ``positions`` (from 0, in row order) of a subset of numbered rows."""
    c = df.select(F.col(row_idx).alias("_row"), row_chunk(row_idx, bits).alias("_c"))
    so_far = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per chunk
    counts = c.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).withColumn("_end", F.sum("_n").over(so_far))
    wanted = df.sparkSession.createDataFrame([(p,) for p in sorted(set(positions))], "_at bigint")
    where = counts.join(F.broadcast(wanted), (F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_n")))
    marks = where.select("_c", "_at", (F.col("_at") - F.col("_end") + F.col("_n") + 1).alias("_need")).collect()
    if not marks:
        return {}
    chunks = df.sparkSession.createDataFrame(marks, "_c long, _at bigint, _need bigint")
    ranked = c.join(F.broadcast(chunks.select("_c").distinct()), "_c").withColumn("_r", F.row_number().over(Window.partitionBy("_c").orderBy("_row")))
    return {r["_at"]: r["_row"] for r in ranked.join(F.broadcast(chunks), "_c").filter("_r = _need").collect()}


def take_first(
    df: DataFrame,
    quotas: int | dict,
    bucket: Column,
    order: list[Column],
    group: str | None = None,
) -> DataFrame:
    """Exactly the first ``n`` rows by ``order``, per group when given.

    ``bucket`` must not decrease along ``order``. Whole buckets below the cut are
    kept by a filter; only the bucket that holds the cut is ranked. ``quotas`` is
    a count, or a count for each value of ``group``; groups without one are dropped.
    """
    if group is None:
        df, quotas, key = df.withColumn("_g", F.lit(0)), {0: int(quotas)}, "_g"
    else:
        key = group
    quotas = {g: int(n) for g, n in quotas.items() if int(n) > 0}
    if not quotas:
        return df.filter(F.lit(False)).drop("_g")
    b = df.withColumn("_b", bucket)
    # reading the cuts here lets both branches filter by them
    cut_rows = _cut_buckets(b, key, quotas)
    if not cut_rows:
        return df.filter(F.lit(False)).drop("_g")
    if len(cut_rows) == 1:
        r = cut_rows[0]
        marked = b.filter(F.col(key) == F.lit(r[key])).withColumns({"_cut": F.lit(r["_cut"]), "_need": F.lit(r["_need"])})
        edge_filter = F.col("_b") == F.lit(r["_cut"])
        below_filter = F.col("_b") < F.lit(r["_cut"])
    else:
        kinds = T.StructType([b.schema[key], T.StructField("_cut", b.schema["_b"].dataType), T.StructField("_need", T.LongType())])
        marked = b.join(F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in cut_rows], kinds)), key)
        edge_filter = F.col("_b") == F.col("_cut")
        below_filter = F.col("_b") < F.col("_cut")
    ranked = Window.partitionBy(key, "_b").orderBy(*order)
    edge = (
        marked.filter(edge_filter)
        .withColumn("_r", F.row_number().over(ranked))
        .filter(F.col("_r") <= F.col("_need"))
        .drop("_r")
    )
    return marked.filter(below_filter).unionByName(edge).drop("_g", "_b", "_cut", "_need")


def last_drawn(df: DataFrame, quotas: int | dict, seed: int, group: str | None = None, row_idx: str = "row_idx") -> dict:
    """Per group the draw key and row number of the last row that :func:`draw_exact` takes; None where it takes all."""
    keyed = df.withColumn("_key", draw_key(seed, row_idx))
    return last_taken(keyed, quotas, F.substring("_key", 1, PREFIX_DIGITS), ["_key", row_idx], group)


def drawn(df: DataFrame, n: int, seed: int, row_idx: str = "row_idx") -> Column:
    """The rows that :func:`draw_exact` takes, as a predicate on the row number."""
    if n <= 0:
        return F.lit(False)
    return up_to([draw_key(seed, row_idx), F.col(row_idx)], last_drawn(df, n, seed, row_idx=row_idx)[0])


def draw_exact(
    df: DataFrame, quotas: int | dict, seed: int, group: str | None = None, row_idx: str = "row_idx"
) -> DataFrame:
    """Uniform draw without replacement of exactly ``n`` rows, per group when given."""
    keyed = df.withColumn("_key", draw_key(seed, row_idx))
    drawn = take_first(
        keyed,
        quotas,
        F.substring("_key", 1, PREFIX_DIGITS),
        [F.col("_key"), F.col(row_idx)],
        group,
    )
    return drawn.drop("_key")
