"""Queries on reading, typing, labelling and splitting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from finsieve.functions import cleaning as C
from finsieve.functions import scalars as S
from finsieve.operators import labels as L
from finsieve.operators.datasets import build_dataset
from finsieve.operators.ordering import with_global_position
from finsieve.operators.splitting import split_chronological, split_stats
from finsieve.plans import tables as T
from finsieve.plans.oracle_views import KEY, finite
from finsieve.plans.registry import query
from finsieve.schema import ACCOUNT_COLUMNS, RAW_COLUMNS
from finsieve.session import scratch_path
from finsieve.sources import patterns as P
from finsieve.sources import stored
from finsieve.sources import transactions as X

_TIME = "strftime({}, '%Y-%m-%d %H:%M')"


def _text_time(column="timestamp"):
    return F.date_format(column, "yyyy-MM-dd HH:mm")


_TYPED_COLUMNS = "from_bank, from_account, to_bank, to_account, amount_received, receiving_currency, amount_paid, payment_currency, payment_format"


@query(
    "scan_transactions",
    f"SELECT {_TIME.format('timestamp')} AS time, {_TYPED_COLUMNS}, is_laundering_csv FROM typed",
    ("typed",),
)
def scan_transactions(spark, sf_dir):
    path = scratch_path(spark, "transactions-csv")
    T.raw(spark, sf_dir).select(*RAW_COLUMNS).write.csv(path, header=True)
    df = X.load_transactions(spark, path)
    return df.select(_text_time().alias("time"), *[c for c in RAW_COLUMNS if c != "timestamp"])


@query(
    "scan_accounts",
    "SELECT concat('Bank ', bank_id) AS bank_name, bank_id, account_number, concat('E', account_number) AS entity_id, entity_name FROM accounts",
    ("accounts",),
)
def scan_accounts(spark, sf_dir):
    path = scratch_path(spark, "accounts-csv")
    T.accounts(spark, sf_dir).select(
        F.concat(F.lit("Bank "), "bank_id").alias("bank_name"), "bank_id", "account_number",
        F.concat(F.lit("E"), "account_number").alias("entity_id"), "entity_name",
    ).write.csv(path, header=True)
    return X.load_accounts(spark, path).drop("file_pos")


_PATTERN_KINDS = "(['FAN-IN', 'FAN-OUT', 'GATHER-SCATTER', 'SCATTER-GATHER', 'RANDOM', 'STACK', 'UNKNOWN'])"


def _pattern_lines(spark, sf_dir):
    """Positives as a pattern file: a block for each payer within a stretch of 4,096 rows."""
    kinds = ["FAN-IN", "FAN-OUT", "GATHER-SCATTER", "SCATTER-GATHER", "RANDOM", "STACK"]
    number = F.substring("from_bank", 2, 10).cast("int") % 7
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.least(number, F.lit(5)) + 1)
    cents = lambda c: F.format_string("%.2f", F.col(c) / 100)
    rows = T.txn(spark, sf_dir).filter("label = 1").select(
        F.date_format("timestamp", "yyyy/MM/dd HH:mm").alias("timestamp"),
        "from_bank", "from_account", "to_bank", "to_account",
        cents("received_cents").alias("amount_received"), "receiving_currency",
        cents("paid_cents").alias("amount_paid"), "payment_currency", "payment_format",
        F.lit("1").alias("is_laundering_csv"),
        F.concat_ws("#", "from_account", F.shiftright("row_idx", 12).cast("string")).alias("block"),
        "row_idx",
        F.when(number < 6, F.concat(F.lit(" - "), kind, F.lit(":  Max 3-degree"))).otherwise(F.lit("")).alias("head"),
    )
    forward, back = Window.partitionBy("block").orderBy("row_idx"), Window.partitionBy("block").orderBy(F.col("row_idx").desc())
    begin = F.concat(F.lit(C.BEGIN_MARKER), "head", F.lit("\n"))
    line = F.concat(
        F.when(F.row_number().over(forward) == 1, begin).otherwise(F.lit("")),
        F.concat_ws(",", *RAW_COLUMNS),
        F.when(F.row_number().over(back) == 1, F.lit(f"\n{C.END_MARKER}\n")).otherwise(F.lit("")),
    )
    return rows.select("block", "row_idx", line.alias("value")).sortWithinPartitions("block", "row_idx").select("value")


@query(
    "parse_pattern_blocks",
    f"""SELECT {_TIME.format('ts')} AS time, from_bank, from_account, to_bank, to_account, amount_paid, payment_currency, payment_format,
       {_PATTERN_KINDS}[CAST(substr(from_bank, 2) AS INTEGER) % 7 + 1] AS pattern_type,
       count(*) OVER (PARTITION BY from_account, row_idx // 4096) AS block_rows, 1 AS is_laundering_csv FROM txn WHERE label = 1""",
)
def parse_pattern_blocks(spark, sf_dir):
    path = scratch_path(spark, "patterns-txt")
    _pattern_lines(spark, sf_dir).write.text(path)
    parsed = P.parse_patterns(spark, path)
    sizes = parsed.groupBy("file_pos.file", "pattern_block_id").agg(F.count(F.lit(1)).alias("block_rows"))
    return (
        parsed.withColumn("file", F.col("file_pos.file"))
        .join(sizes, ["file", "pattern_block_id"])
        .select(
            _text_time().alias("time"), "from_bank", "from_account", "to_bank", "to_account", "amount_paid",
            "payment_currency", "payment_format", "pattern_type", "block_rows", "is_laundering_csv",
        )
    )


_IN_ORDER = ", ".join(f"{c} NULLS FIRST" for c in RAW_COLUMNS)


@query(
    "dataset_build",
    f""", placed AS (SELECT *, row_number() OVER (ORDER BY {_IN_ORDER}) - 1 AS pos, count(*) OVER () AS n FROM typed)
SELECT CASE WHEN pos < trunc(n * 0.70::DOUBLE) THEN 'train' WHEN pos < trunc(n * (0.70::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split,
       count(*) AS n_rows, CAST(sum(is_laundering_csv) AS BIGINT) AS n_positive, CAST(count(*) - sum(is_laundering_csv) AS BIGINT) AS n_negative,
       CAST(sum(pos) AS BIGINT) AS positions, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS date_start, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS date_end,
       (SELECT count(*) FROM listed) AS n_accounts FROM placed GROUP BY 1""",
    ("typed", "listed"),
)
def dataset_build(spark, sf_dir):
    """From a raw file to the stored splits in one call, read back split by split."""
    files, holders = scratch_path(spark, "raw-csv"), scratch_path(spark, "holders-csv")
    T.raw(spark, sf_dir).select(*RAW_COLUMNS).write.csv(files, header=True)
    listed = T.listed_accounts(spark, sf_dir)
    listed.select(*[F.col(c) if c in listed.columns else F.lit("x").alias(c) for c in ACCOUNT_COLUMNS]).write.csv(holders, header=True)
    made = build_dataset(spark, scratch_path(spark, "dataset"), files, holders)
    rows = made.split("train").unionByName(made.split("val")).unionByName(made.split("test"))
    positions = rows.groupBy("split").agg(F.sum("row_idx").alias("positions"))
    return split_stats(rows).drop("illicit_ratio").join(positions, "split").join(F.broadcast(made.summary.select("n_accounts")))


@query(
    "score_table_contiguity",
    """SELECT split, count(*) AS n, min(i) AS min_idx, max(i) AS max_idx, count(DISTINCT i) AS n_distinct,
       count(*) = max(i) + 1 AND min(i) = 0 AS contiguous
FROM (SELECT 'train' AS split, row_idx AS i FROM train UNION ALL SELECT 'test', row_idx FROM txn WHERE split = 'test') GROUP BY split""",
    ("train",),
)
def score_table_contiguity(spark, sf_dir):
    out = None
    for split in ("train", "test"):
        path = scratch_path(spark, f"scores-{split}")
        stored.save_scores(T.txn(spark, sf_dir).filter(F.col("split") == split), path)
        one = stored.score_contiguity(spark.read.parquet(path)).withColumn("split", F.lit(split))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "score_table_checksum",
    """SELECT bit_xor(CAST('0x' || substr(md5(concat(row_idx, '|', CAST(round(CAST(CAST(score AS FLOAT) AS DOUBLE) * 1000000) AS BIGINT))), 1, 15) AS BIGINT)) AS checksum,
       count(*) AS n FROM txn""",
)
def score_table_checksum(spark, sf_dir):
    path = scratch_path(spark, "scores")
    stored.save_scores(T.txn(spark, sf_dir), path)
    return stored.score_checksum(stored.load_scores(spark, path))


@query(
    "canonical_projection",
    f"SELECT {_TIME.format('ts')} AS timestamp, from_bank, from_account, to_bank, to_account, amount_paid, payment_currency, payment_format FROM txn",
)
def canonical_projection(spark, sf_dir):
    return C.canonical(T.txn(spark, sf_dir)).withColumn("timestamp", _text_time())


@query(
    "enforce_types",
    f"""SELECT row_idx, trim(from_bank) AS from_bank, trim(to_bank) AS to_bank, {finite('amount_received')} AS amount_received,
       {finite('amount_paid')} AS amount_paid, trim(payment_currency) AS payment_currency FROM raw""",
    ("raw",),
)
def enforce_types(spark, sf_dir):
    return C.enforce_types(T.raw(spark, sf_dir)).select(
        "row_idx", "from_bank", "to_bank", "amount_received", "amount_paid", "payment_currency"
    )


@query(
    "parse_timestamp",
    f"SELECT row_idx, {_TIME.format('''try_strptime(timestamp, '%Y/%m/%d %H:%M')''')} AS time FROM raw",
    ("raw",),
)
def parse_timestamp(spark, sf_dir):
    return T.raw(spark, sf_dir).select(
        "row_idx", F.date_format(C.to_timestamp(F.col("timestamp")), "yyyy-MM-dd HH:mm").alias("time")
    )


@query(
    "drop_bad_timestamps",
    """SELECT count(*) AS n_rows, count(try_strptime(timestamp, '%Y/%m/%d %H:%M')) AS n_kept,
       count(*) - count(try_strptime(timestamp, '%Y/%m/%d %H:%M')) AS n_dropped FROM raw""",
    ("raw",),
)
def drop_bad_timestamps(spark, sf_dir):
    return C.timestamp_quality(T.raw(spark, sf_dir))


@query(
    "coerce_label",
    f"SELECT row_idx, COALESCE(TRY_CAST({finite('is_laundering_csv')} AS INTEGER), 0) AS label FROM raw",
    ("raw",),
)
def coerce_label(spark, sf_dir):
    return T.raw(spark, sf_dir).select("row_idx", C.to_label(F.col("is_laundering_csv")).alias("label"))


@query(
    "label_ground_truth",
    """SELECT row_idx, is_laundering_csv AS label_existing_csv, is_laundering_csv AS label, 0 AS label_from_patterns,
       0 AS mismatch_flag, 'NONE' AS pattern_type, CAST(-1 AS BIGINT) AS pattern_block_id FROM typed""",
    ("typed",),
)
def label_ground_truth(spark, sf_dir):
    return L.create_labels(C.type_transactions(T.raw(spark, sf_dir))).select(
        "row_idx", "label_existing_csv", "label", "label_from_patterns", "mismatch_flag", "pattern_type", "pattern_block_id"
    )


@query(
    "match_key",
    f"SELECT row_idx, CASE WHEN ts IS NOT NULL AND amount_paid IS NOT NULL THEN {KEY} END AS match_key FROM (SELECT *, timestamp AS ts FROM typed)",
    ("typed",),
)
def match_key(spark, sf_dir):
    return C.type_transactions(T.raw(spark, sf_dir)).select("row_idx", C.match_key().alias("match_key"))


@query(
    "pattern_type_extract",
    """SELECT row_idx, CASE WHEN payment_format = 'NO' THEN 'UNKNOWN' ELSE payment_format END AS pattern_type FROM txn""",
)
def pattern_type_extract(spark, sf_dir):
    line = F.when(F.col("payment_format") == "NO", F.lit(C.BEGIN_MARKER)).otherwise(
        F.concat(F.lit(C.BEGIN_MARKER + " -  "), "payment_format", F.lit(" :  Max "), "to_bank")
    )
    return T.txn(spark, sf_dir).select("row_idx", C.pattern_type(line).alias("pattern_type"))


@query(
    "pattern_join",
    "SELECT row_idx, pattern_type, pattern_block_id, label_from_patterns FROM linked",
    ("linked",),
)
def pattern_join(spark, sf_dir):
    return L.attach_patterns(T.txn(spark, sf_dir), T.patterns(spark, sf_dir)).select(
        "row_idx", "pattern_type", "pattern_block_id", "label_from_patterns"
    )


def _linked(spark, sf_dir):
    t = T.txn(spark, sf_dir).withColumn("is_laundering_csv", F.col("label"))
    return L.create_labels(t, T.patterns(spark, sf_dir))


@query("pattern_mismatch", "SELECT row_idx, label, label_from_patterns FROM linked WHERE mismatch_flag = 1", ("linked",))
def pattern_mismatch(spark, sf_dir):
    return _linked(spark, sf_dir).filter("mismatch_flag = 1").select("row_idx", "label", "label_from_patterns")


@query(
    "labelling_summary",
    """SELECT 'all' AS part, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_illicit_csv, CAST(sum(label_from_patterns) AS BIGINT) AS n_illicit_patterns,
       CAST(sum(mismatch_flag) AS BIGINT) AS n_mismatch, round(CAST(sum(label) AS DOUBLE) / count(*), 8) AS illicit_ratio,
       count(DISTINCT CASE WHEN label_from_patterns = 1 THEN pattern_block_id END) AS n_blocks FROM linked
UNION ALL SELECT pattern_type, count(*), NULL, NULL, NULL, NULL, NULL FROM linked WHERE label_from_patterns = 1 GROUP BY pattern_type""",
    ("linked",),
)
def labelling_summary(spark, sf_dir):
    linked = _linked(spark, sf_dir)
    total = L.labelling_summary(linked).withColumns({"part": F.lit("all"), "illicit_ratio": F.round("illicit_ratio", 8)})
    kinds = L.pattern_type_counts(linked).select(F.col("pattern_type").alias("part"), F.col("n").alias("n_rows"))
    return total.unionByName(kinds, allowMissingColumns=True)


@query(
    "dedupe_first",
    "SELECT k AS match_key, pattern_type, pattern_block_id FROM pattern_keys",
    ("pattern_keys",),
)
def dedupe_first(spark, sf_dir):
    keyed = T.patterns(spark, sf_dir).select(C.match_key().alias("match_key"), "pattern_type", "pattern_block_id", "file_pos")
    return L.first_by_key(keyed, "match_key", "file_pos").select("match_key", "pattern_type", "pattern_block_id")


@query(
    "unmatched_patterns",
    f"SELECT DISTINCT k AS match_key FROM pattern_keys WHERE k NOT IN (SELECT {KEY} FROM txn)",
    ("pattern_keys", "txn"),
)
def unmatched_patterns(spark, sf_dir):
    return L.unmatched_keys(T.patterns(spark, sf_dir), T.txn(spark, sf_dir))


@query("row_index", "SELECT row_idx, from_account, to_account, paid_cents, received_cents FROM txn0", ("txn0",))
def row_index(spark, sf_dir):
    return T.numbered(spark, sf_dir).select("row_idx", "from_account", "to_account", "paid_cents", "received_cents")


@query("chrono_split", "SELECT row_idx, split, label FROM txn")
def chrono_split(spark, sf_dir):
    df = T.txn(spark, sf_dir).drop("split")
    return split_chronological(df).select("row_idx", "split", "label")


@query(
    "split_stats",
    """SELECT split, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_positive, CAST(count(*) - sum(label) AS BIGINT) AS n_negative,
       round(CAST(sum(label) AS DOUBLE) / count(*), 8) AS illicit_ratio, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS date_start,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS date_end FROM txn GROUP BY split""",
)
def split_stats_query(spark, sf_dir):
    return split_stats(T.txn(spark, sf_dir))


@query(
    "event_row_index",
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx FROM events",
    (),
)
def event_row_index(spark, sf_dir):
    events = T.read(spark, sf_dir, "events").select("event_id", "ts")
    return with_global_position(events, ["ts", "event_id"]).select("event_id", "row_idx")


@query(
    "run_id_build",
    """SELECT run_no, concat(model, '__', strategy, '__', tag, '__', stamp) AS run_id FROM runs,
       (SELECT strftime(max(ts), '%Y%m%d_%H%M%S') AS stamp FROM txn)""",
    ("runs", "txn"),
)
def run_id_build(spark, sf_dir):
    from finsieve.operators.runs import experiment_grid

    stamp = T.txn(spark, sf_dir).agg(F.date_format(F.max("timestamp"), "yyyyMMdd_HHmmss").alias("stamp"))
    grid = experiment_grid(spark).withColumn("run_no", F.col("run_no").cast("bigint"))
    named = grid.join(F.broadcast(stamp))
    return named.select("run_no", S.run_id(F.col("model"), F.col("strategy"), F.col("target_prevalence"), F.col("stamp")).alias("run_id"))


@query(
    "run_id_parse",
    """SELECT DISTINCT concat(payment_format, '__', payment_currency, '__p', lpad(CAST(CAST(substr(to_bank, 2) AS INTEGER) AS VARCHAR), 3, '0')) AS run_id,
       payment_format AS model, payment_currency AS strategy, concat('p', lpad(substr(to_bank, 2), 3, '0')) AS tag FROM txn""",
)
def run_id_parse(spark, sf_dir):
    number = F.substring("to_bank", 2, 10).cast("int")
    ids = T.txn(spark, sf_dir).select(S.run_id(F.col("payment_format"), F.col("payment_currency"), number / 1000).alias("run_id")).distinct()
    r = F.col("run_id")
    return ids.select("run_id", S.run_id_part(r, 0).alias("model"), S.run_id_part(r, 1).alias("strategy"), S.run_id_part(r, 2).alias("tag"))


