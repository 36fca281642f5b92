"""Exact deduplication through a keyed streaming state on disk.

Documents arrive as a stream of digests. A streaming aggregation without a
watermark keeps one state row per digest for good, in RocksDB: the best row seen
(its length, stable identifier and locator) and the number of rows. Spark
combines the rows of a digest before the shuffle, so a text that makes up a third
of the corpus reaches its state as one row per task. The final state is read back
with the state data source. Every row that hit a state is then compared with the
kept row byte for byte; rows that share a digest but not the bytes are grouped by
the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.llm.scratch import discard
from finsieve.session import materialize, scratch_path

#: Deleted from a text before texts are compared.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Files that one micro-batch of the stream takes in.
FILES_PER_BATCH = 100_000

_STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # a task's store leaves the executor's disk when it is saved
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # availableNow ends by itself; an extra empty batch would only save the state again
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    """``text`` without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


@dataclass
class Deduplicated:
    """``landed``: the input rows plus ``_row``, ``_points`` and ``_digest``.

    ``decisions``: one row per input row with ``_row``, ``doc_id``, ``keep_id``,
    ``group_size``, ``kept`` and ``text_sha256``.
    """

    landed: DataFrame
    decisions: DataFrame

    def kept_documents(self) -> DataFrame:
        """The input rows that stay, with the columns of the input."""
        dropped = self.decisions.filter(~F.col("kept")).select("_row")
        columns = [c for c in self.landed.columns if c not in ("_row", "_points", "_digest")]
        return self.landed.join(dropped, "_row", "left_anti").select(*columns)


def land(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Input rows with a locator within the landed files, length and digest."""
    return materialize(
        docs.withColumns(
            {
                "_row": F.monotonically_increasing_id(),
                "_points": F.char_length(F.coalesce("text", F.lit(""))),
                "_digest": digest(normalised(F.col("text"))),
            }
        ),
        "landed",
    )


def digest_state(spark: SparkSession, arrivals: DataFrame, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """``_digest``, ``keep_row``, ``keep_id``, ``size`` of all rows of ``arrivals``.

    ``arrivals`` is read from its files as a stream, ``files_per_batch`` files at
    a time; the state outlives batches, restarts and lost executors in the
    checkpoint folder.
    """
    session = spark.newSession()
    for key, value in _STATE_SETTINGS.items():
        session.conf.set(key, value)
    # a new session starts from the application's settings, not from this session's
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    checkpoint = scratch_path(spark, "dedup-state")
    stream = session.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", files_per_batch)
    # doc_id is negated so that the largest struct has the smallest id; a null id is last among ties
    best = F.max(F.struct("_points", F.negative("doc_id").alias("minus_id"), F.negative("_row").alias("minus_row")))
    folders = {path.rsplit("/", 1)[0] for path in arrivals.inputFiles()}
    for folder in sorted(folders):
        (
            stream.parquet(folder)
            .groupBy("_digest")
            .agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
            .writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    if not folders:
        return spark.createDataFrame([], "_digest string, keep_row long, keep_id long, size long")
    state = spark.read.format("statestore").option("path", checkpoint).load()
    # the aggregation buffers are named after their functions
    return state.select(
        F.col("key._digest").alias("_digest"),
        (-F.col("value.max.minus_row")).alias("keep_row"),
        (-F.col("value.max.minus_id")).alias("keep_id"),
        F.col("value.count").alias("size"),
    )


def exact_dedup(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256_hex,
    files_per_batch: int = FILES_PER_BATCH,
) -> Deduplicated:
    """Groups the rows of ``docs`` by equal text after deleting white space.

    Of a group the row with the most code points in the original text stays,
    then the smallest ``doc_id`` (null ids last), then any one of fully equal
    rows. A null text counts as empty; empty texts are one group. Columns other
    than ``doc_id`` and ``text`` are carried, whatever their names (names that
    start with ``_row``, ``_points`` or ``_digest`` exactly are replaced). An
    empty input gives empty results.
    """
    spark = docs.sparkSession
    landed = land(docs, digest)
    slim = landed.select("_row", "doc_id", "_points", "_digest")
    arrivals = materialize(slim.select("_digest", "_points", "doc_id", "_row"), "arrivals")
    groups = materialize(digest_state(spark, arrivals, files_per_batch), "digest-groups")
    discard(arrivals)
    shared = groups.filter("size > 1")

    texts = landed.select("_row", "doc_id", "_points", "_digest", "text").join(shared, "_digest")
    texts = materialize(texts.withColumn("_text", normalised(F.col("text"))).drop("text"), "texts-of-groups")
    keepers = texts.filter("_row = keep_row").select("_digest", F.col("_text").alias("_keeper_text"))
    checked = texts.join(keepers, "_digest").withColumn("same", F.col("_text") == F.col("_keeper_text"))
    differing = checked.filter(~F.col("same")).select("_row", "doc_id", "_points", "_digest", "_text")
    differing = materialize(differing, "digest-collisions")
    discard(texts)

    joined = slim.join(shared.select("_digest", "keep_row", "keep_id", "size"), "_digest", "left")
    if not differing.isEmpty():
        joined = _with_collisions(joined, differing)
    alone = F.col("keep_row").isNull()
    decisions = joined.select(
        "_row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep_row") == F.col("_row"))).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )
    return Deduplicated(landed, decisions)


def _with_collisions(joined: DataFrame, differing: DataFrame) -> DataFrame:
    """Takes rows whose bytes differ from the kept row out of its group and groups them by bytes."""
    best = F.max(F.struct("_points", F.negative("doc_id").alias("minus_id"), F.negative("_row").alias("minus_row")))
    own = differing.groupBy("_digest", "_text").agg(best.alias("best"), F.count(F.lit(1)).alias("own_size"))
    own = differing.join(own, ["_digest", "_text"]).select(
        "_row",
        (-F.col("best.minus_row")).alias("own_row"),
        (-F.col("best.minus_id")).alias("own_id"),
        "own_size",
    )
    taken = differing.groupBy("_digest").agg(F.count(F.lit(1)).alias("taken"))
    apart = F.col("own_row").isNotNull()
    return (
        joined.join(taken, "_digest", "left")
        .join(own, "_row", "left")
        .select(
            "_row",
            "doc_id",
            "_digest",
            F.when(apart, F.col("own_row")).otherwise(F.col("keep_row")).alias("keep_row"),
            F.when(apart, F.col("own_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.when(apart, F.col("own_size")).otherwise(F.col("size") - F.coalesce("taken", F.lit(0))).alias("size"),
        )
    )


DEDUP_SQL = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
), g AS (
    SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY text_sha256) AS group_size
    FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM g
"""
