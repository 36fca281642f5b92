"""Transaction, account and raw tables derived from the star-schema parquet.

``txn`` is built once per session and data folder, numbered in time order, split
and written to the shared folder; every query scans that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.operators.ordering import parts_for, with_global_position
from finsieve.operators.splitting import split_chronological
from finsieve.session import materialize

_ORDER = [
    "timestamp", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    "l_quantity", "l_extendedprice", "l_shipdate",
]
_built: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        _built[key] = materialize(build(), name)
    return _built[key]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pin_utc(spark: SparkSession) -> None:
    """Source times carry no zone; read them as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


_SCAN, _DEFAULT_SCAN = "spark.sql.files.maxPartitionBytes", ("134217728", "134217728b", "128m", "128mb")


def small_scans(spark: SparkSession) -> None:
    """Tables of numbers are small on disk for the rows they hold: tasks that read and shuffle 128 MB of one would need much memory."""
    if spark.conf.get(_SCAN).lower() in _DEFAULT_SCAN:
        spark.conf.set(_SCAN, "16m")


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a transaction is made of, one row per line item: customer pays supplier. Keys and numbers only, so that little is shuffled."""
    pin_utc(spark)
    small_scans(spark)
    line = read(spark, sf_dir, "lineitem").select(*_ORDER[1:], "l_discount", "l_returnflag", "l_linestatus")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("timestamp"))
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # orders meet their customers before their lines, of which there are more; no task gets more than a share of the lines
    n = _parts(spark, sf_dir)
    paid = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey").repartition(n, "o_orderkey")
    joined = line.repartition(n, "l_orderkey").join(paid, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    return joined.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey")


def _parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the line items."""
    return parts_for(spark, read(spark, sf_dir, "lineitem").count())


def _transactions(rows: DataFrame, *keep: str) -> DataFrame:
    """Transactions from rows of :func:`unnumbered`."""
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    # nearest whole number of a positive value, without going through decimals
    whole = lambda x: (x + 0.5).cast("bigint")
    return rows.select(
        "timestamp",
        text("N", "c_nationkey").alias("from_bank"),
        text("C", "o_custkey").alias("from_account"),
        text("N", "s_nationkey").alias("to_bank"),
        text("S", "l_suppkey").alias("to_account"),
        whole(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).alias("received_cents"),
        F.concat(F.lit("CUR"), (F.col("s_nationkey") % 5).cast("string")).alias("receiving_currency"),
        whole(F.col("l_extendedprice") * 100).alias("paid_cents"),
        F.concat(F.lit("CUR"), (F.col("c_nationkey") % 5).cast("string")).alias("payment_currency"),
        F.concat("l_returnflag", "l_linestatus").alias("payment_format"),
        (
            (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09) & (F.col("l_quantity") >= 45)
        ).cast("int").alias("label"),
        whole(F.col("l_quantity") * 10 + F.col("l_discount") * 5000).alias("score_milli"),
        *keep,
    )


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transactions(with_global_position(unnumbered(spark, sf_dir), _ORDER, partitions=_parts(spark, sf_dir)), "row_idx")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered and split transactions."""
    pin_utc(spark)

    def build():
        df = split_chronological(numbered(spark, sf_dir))
        return df.withColumns(
            {
                "amount_paid": F.col("paid_cents") / 100,
                "amount_received": F.col("received_cents") / 100,
                "score": (F.col("score_milli") / 1000).cast("float"),
            }
        )

    return _once(spark, sf_dir, "txn", build)


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn(spark, sf_dir).filter(F.col("split") == "train")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as account holders, with their file position."""
    c = read(spark, sf_dir, "customer")
    s = read(spark, sf_dir, "supplier")

    def holder(kind_col, kinds, default, key):
        kind = F.lit(default)
        for value, name in reversed(kinds):
            kind = F.when(kind_col == value, F.lit(name)).otherwise(kind)
        return F.concat(kind, F.lit(" #"), F.col(key).cast("string"))

    customers = c.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("account_number"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("bank_id"),
        holder(
            F.col("c_mktsegment"),
            [("BUILDING", "Corporation"), ("HOUSEHOLD", "Partnership")],
            "Sole Proprietorship",
            "c_custkey",
        ).alias("entity_name"),
        F.col("c_custkey").alias("file_pos"),
    )
    suppliers = s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")),
        holder(F.col("s_nationkey") % 3, [(0, "Corporation"), (1, "Partnership")], "Country", "s_suppkey"),
        F.col("s_suppkey"),
    )
    return customers.union(suppliers)


def listed_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account file rows, in which holders at two banks are listed a second time."""
    base = accounts(spark, sf_dir)
    again = base.filter(F.col("bank_id").isin("N3", "N7")).select(
        "account_number",
        "bank_id",
        F.concat(F.lit("Corporation of "), F.col("account_number")).alias("entity_name"),
        F.lit(2).cast("bigint").alias("file_pos"),
    )
    return base.withColumn("file_pos", F.lit(1).cast("bigint")).unionByName(again)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as text, with the flaws a raw file has."""
    t = txn(spark, sf_dir)
    s = F.col("score_milli")

    def money(cents):
        return F.concat(F.expr(f"{cents} div 100").cast("string"), F.lit("."), F.lpad((F.col(cents) % 100).cast("string"), 2, "0"))

    return t.select(
        "row_idx",
        F.when(s == 500, "not a date").when(s == 490, "2020-01-01 10:00").when(s == 480, F.lit(None))
        .otherwise(F.date_format("timestamp", "yyyy/MM/dd HH:mm")).alias("timestamp"),
        F.when(F.col("payment_format") == "NO", F.concat(F.lit("  "), "from_bank", F.lit(" "))).otherwise(F.col("from_bank")).alias("from_bank"),
        "from_account",
        F.concat(F.lit("0"), "to_bank").alias("to_bank"),
        "to_account",
        F.when(s == 470, "n/a").when(s == 390, " Infinity").otherwise(money("received_cents")).alias("amount_received"),
        "receiving_currency",
        F.when(s == 460, F.lit(None)).when(s == 380, "nan").when(s == 370, "-inf").otherwise(F.concat(F.lit(" "), money("paid_cents"))).alias("amount_paid"),
        F.when(s == 450, F.lit(None)).otherwise(F.col("payment_currency")).alias("payment_currency"),
        F.upper("payment_format").alias("payment_format"),
        F.when(s == 440, "x").when(s == 430, F.lit(None)).when(s == 420, "nan").when(s == 410, "Infinity").when(s == 400, "99999999999").otherwise(F.col("label").cast("string")).alias("is_laundering_csv"),
    )


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern list: most positives, some twice, and some rows no transaction has."""
    pos = txn(spark, sf_dir).filter("label = 1")
    bank = F.substring("from_bank", 2, 10).cast("bigint")
    key = ["timestamp", "from_bank", "from_account", "to_bank", "to_account", "amount_paid", "payment_currency", "payment_format"]

    def part(rows, shift, kind, block, extra=0.0):
        return rows.select(
            (F.col("row_idx") + shift).alias("file_pos"),
            *[(F.col(c) + extra).alias(c) if c == "amount_paid" else F.col(c) for c in key],
            kind.alias("pattern_type"),
            (bank + block).alias("pattern_block_id"),
        )

    first = part(pos.filter("payment_currency <> 'CUR0'"), 0, F.concat(F.lit("TYPE"), (bank % 4).cast("string")), 1)
    second = part(pos.filter("payment_currency = 'CUR1'"), 10**12, F.lit("STACK"), 101)
    absent = part(pos.filter("payment_currency = 'CUR2'"), 2 * 10**12, F.lit("RANDOM"), 201, 0.5)
    return first.unionByName(second).unionByName(absent)


def _with_runs(rows: DataFrame, runs: list[tuple]) -> DataFrame:
    """Every row once per run; a fixed, short list of runs."""
    cells = F.array(
        *[
            F.struct(
                F.lit(no).alias("run_no"), F.lit(model).alias("model"), F.lit(strategy).alias("strategy"),
                F.lit(p).alias("target_prevalence"), F.lit(f"{model}__{strategy}__p{round(p * 1000):03d}").alias("run_id"),
                F.lit(w).alias("_w"), F.lit(shift).alias("_shift"),
            )
            for no, model, strategy, p, w, shift in runs
        ]
    )
    return rows.select(*rows.columns, F.inline(cells))


def _grid_runs() -> list[tuple]:
    from finsieve.operators.runs import GRID_MODELS, GRID_PREVALENCES, GRID_STRATEGIES

    out = []
    for s, strategy in enumerate(GRID_STRATEGIES):
        for m, model in enumerate(GRID_MODELS):
            for k, p in enumerate(GRID_PREVALENCES):
                # the baseline does not depend on the prevalence
                step = 0 if strategy == "baseline" else k
                out.append((len(out), model, strategy, p, 900 - 100 * s - 150 * m - 40 * step, (100 * s + 10 * m + step) * 104_729))
    return out


def _pool_runs() -> list[tuple]:
    from finsieve.operators.runs import GRID_PREVALENCES

    return [(100 + k, "xgboost", "three_pool", p, 700 + 50 * k, (900 + k) * 104_729) for k, p in enumerate(GRID_PREVALENCES)]


def _scored(spark: SparkSession, sf_dir: str, runs: list[tuple], keep: tuple[str, ...] = ()) -> DataFrame:
    rows = txn(spark, sf_dir).filter("split IN ('val', 'test')").select("row_idx", "split", "label", "score_milli", *keep)
    milli = F.expr("(_w * score_milli + (1000 - _w) * ((row_idx * 7919 + _shift) % 1000)) div 1000")
    return _with_runs(rows, runs).select(
        "row_idx", "split", "label", *keep, "run_no", "model", "strategy", "target_prevalence", "run_id",
        milli.alias("run_milli"),
        (milli / 1000).cast("float").alias("score"),
    )


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation and test rows scored by each of the thirty grid runs."""
    return _scored(spark, sf_dir, _grid_runs())


def pool_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows scored by the three three-pool runs."""
    return _scored(spark, sf_dir, _pool_runs())


def _board(scored: DataFrame, runs: list[tuple]) -> DataFrame:
    from finsieve.operators.ranking import curve_of_groups, record_of_curve, score_groups
    from finsieve.operators.runs import leaderboard
    from finsieve.operators.thresholds import reevaluate_groups

    # one row per run, split and distinct score: all that the metrics need
    groups = materialize(score_groups(scored, ["run_no", "split"]), "score-groups")
    keys = ["run_no", "split"]
    half = materialize(record_of_curve(curve_of_groups(groups, keys), keys, F.lit(0.5)), "metrics-default")
    best = materialize(reevaluate_groups(groups, keys=("run_no",)), "metrics-threshold")
    names = groups.select("run_no").distinct()
    config = scored.sparkSession.createDataFrame(
        [(no, m, s, p, f"{m}__{s}__p{round(p * 1000):03d}") for no, m, s, p, _, _ in runs],
        "run_no int, model string, strategy string, target_prevalence double, run_id string",
    ).join(F.broadcast(names), "run_no")
    named = lambda df: df.join(config.select("run_no", "run_id"), "run_no").drop("run_no")
    records = {
        "val": named(half.filter("split = 'val'")),
        "test": named(half.filter("split = 'test'")),
        "val_thresh": named(best.filter("split = 'val'")),
        "test_thresh": named(best.filter("split = 'test'")),
    }
    taus = named(best.filter("split = 'val'")).select(
        "run_id", F.col("threshold").alias("optimal_threshold"), F.col("criterion").alias("threshold_criterion")
    )
    return leaderboard(config, records, taus).join(config.select("run_id", "run_no"), "run_id")


def run_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaderboard rows of the thirty grid runs."""
    return _once(spark, sf_dir, "run-board", lambda: _board(run_scores(spark, sf_dir), _grid_runs()))


def pool_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaderboard rows of the three three-pool runs."""
    return _once(spark, sf_dir, "pool-board", lambda: _board(pool_scores(spark, sf_dir), _pool_runs()))


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table of importances: how far high scores of a run go with high feature values."""
    number = lambda c, start: F.substring(c, start, 10).cast("bigint")
    features = {
        "paid_units": F.expr("paid_cents div 100"),
        "received_units": F.expr("received_cents div 100"),
        "paid_digits": F.length(F.col("paid_cents").cast("string")),
        "hour": F.hour("timestamp"),
        "weekday": F.weekday("timestamp"),
        "day": F.dayofmonth("timestamp"),
        "month": F.month("timestamp"),
        "same_bank": (F.col("from_bank") == F.col("to_bank")).cast("int"),
        "currency_mismatch": (F.col("payment_currency") != F.col("receiving_currency")).cast("int"),
        "from_bank_no": number("from_bank", 2),
        "to_bank_no": number("to_bank", 2),
        "from_digits": F.length("from_account"),
        "to_digits": F.length("to_account"),
        "pay_currency_no": number("payment_currency", 4),
        "receive_currency_no": number("receiving_currency", 4),
        "score_milli": F.col("score_milli"),
        "row_parity": F.col("row_idx") % 2,
    }
    rows = txn(spark, sf_dir).select(
        "row_idx", "score_milli", *[e.cast("bigint").alias(f"v_{n}") for n, e in features.items()]
    )
    milli = F.expr("(_w * score_milli + (1000 - _w) * ((row_idx * 7919 + _shift) % 1000)) div 1000")
    scored = _with_runs(rows, _grid_runs()).withColumn("_m", milli)
    sums = scored.groupBy("run_no", "run_id", "model", "strategy", "target_prevalence").agg(
        F.sum("_m").alias("_total"), *[F.sum(F.col("_m") * F.col(f"v_{n}")).alias(n) for n in features]
    )
    long = sums.unpivot(["run_id", "model", "strategy", "target_prevalence", "_total"], list(features), "feature", "_sum")
    return long.select(
        "run_id", "model", "strategy", "target_prevalence", "feature",
        (F.col("_sum") / F.col("_total") / 1000).alias("importance"),
    )
