"""Derived tables in plain SQL, for checking results on another engine.

Each view is written independently of the Spark code that builds the same table.
"""

from __future__ import annotations

_DAY = 86_400_000_000
_HIT = "(p * (CAST(cp AS DOUBLE) / cn))"
_PARTS = f"sum(CAST(floor(({_HIT} - floor({_HIT})) * 9007199254740992) AS HUGEINT))"
#: Average precision of a curve; whole numbers are summed, so that no order of rows shows in the last digit.
AVERAGE_PRECISION = f"""CASE WHEN max(p_all) > 0 THEN (CAST(sum(CAST(floor({_HIT}) AS HUGEINT)) + {_PARTS} // 9007199254740992 AS DOUBLE)
         + CAST({_PARTS} % 9007199254740992 AS DOUBLE) / 9007199254740992) / max(p_all) ELSE 0 END"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

VIEWS["txn0"] = (
    (),
    """SELECT row_number() OVER (ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
                                l_quantity, l_extendedprice, l_shipdate) - 1 AS row_idx,
       o_orderdate AS ts,
       concat('N', CAST(c_nationkey AS VARCHAR)) AS from_bank, concat('C', CAST(o_custkey AS VARCHAR)) AS from_account,
       concat('N', CAST(s_nationkey AS VARCHAR)) AS to_bank, concat('S', CAST(l_suppkey AS VARCHAR)) AS to_account,
       CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS received_cents,
       concat('CUR', CAST(s_nationkey % 5 AS VARCHAR)) AS receiving_currency,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS paid_cents,
       concat('CUR', CAST(c_nationkey % 5 AS VARCHAR)) AS payment_currency,
       concat(l_returnflag, l_linestatus) AS payment_format,
       CASE WHEN l_returnflag = 'R' AND l_discount >= 0.09 AND l_quantity >= 45 THEN 1 ELSE 0 END AS label,
       CAST(round(l_quantity * 10 + l_discount * 5000) AS BIGINT) AS score_milli
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
)
VIEWS["txn"] = (
    ("txn0",),
    """SELECT *, epoch_us(ts) AS us,
       paid_cents / CAST(100 AS DOUBLE) AS amount_paid, received_cents / CAST(100 AS DOUBLE) AS amount_received,
       CAST(score_milli / CAST(1000 AS DOUBLE) AS FLOAT) AS score,
       CASE WHEN row_idx < CAST(floor(n_all * CAST(0.70 AS DOUBLE)) AS BIGINT) THEN 'train'
            WHEN row_idx < CAST(floor(n_all * (CAST(0.70 AS DOUBLE) + CAST(0.15 AS DOUBLE))) AS BIGINT) THEN 'val'
            ELSE 'test' END AS split
FROM (SELECT *, count(*) OVER () AS n_all FROM txn0)""",
)
VIEWS["train"] = (("txn",), "SELECT * FROM txn WHERE split = 'train'")
VIEWS["classes"] = (
    ("train",),
    "SELECT CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg FROM train",
)
VIEWS["accounts"] = (
    (),
    """SELECT concat('C', CAST(c_custkey AS VARCHAR)) AS account_number, concat('N', CAST(c_nationkey AS VARCHAR)) AS bank_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN concat('Corporation #', CAST(c_custkey AS VARCHAR))
                         WHEN 'HOUSEHOLD' THEN concat('Partnership #', CAST(c_custkey AS VARCHAR))
                         ELSE concat('Sole Proprietorship #', CAST(c_custkey AS VARCHAR)) END AS entity_name FROM customer
UNION ALL
SELECT concat('S', CAST(s_suppkey AS VARCHAR)), concat('N', CAST(s_nationkey AS VARCHAR)),
       CASE s_nationkey % 3 WHEN 0 THEN concat('Corporation #', CAST(s_suppkey AS VARCHAR))
                            WHEN 1 THEN concat('Partnership #', CAST(s_suppkey AS VARCHAR))
                            ELSE concat('Country #', CAST(s_suppkey AS VARCHAR)) END FROM supplier""",
)
# a holder listed again at the end of the file under a name of its own class
VIEWS["listed"] = (
    ("accounts",),
    """SELECT account_number, entity_name, 1 AS part FROM accounts
UNION ALL
SELECT account_number, concat('Corporation of ', account_number), 2 FROM accounts WHERE bank_id IN ('N3', 'N7')""",
)
VIEWS["entity"] = (
    ("listed",),
    """SELECT account_number AS account,
       CASE WHEN contains(name, 'Corporation') THEN 0 WHEN contains(name, 'Partnership') THEN 1 ELSE 2 END AS kind
FROM (SELECT account_number, arg_max(entity_name, part) AS name FROM listed GROUP BY account_number)""",
)
# the transaction table as text, with the flaws a raw file has
VIEWS["raw"] = (
    ("txn",),
    """SELECT row_idx,
       CASE score_milli WHEN 500 THEN 'not a date' WHEN 490 THEN '2020-01-01 10:00' WHEN 480 THEN NULL
            ELSE strftime(ts, '%Y/%m/%d %H:%M') END AS timestamp,
       CASE WHEN payment_format = 'NO' THEN concat('  ', from_bank, ' ') ELSE from_bank END AS from_bank,
       from_account,
       concat('0', to_bank) AS to_bank,
       to_account,
       CASE score_milli WHEN 470 THEN 'n/a' WHEN 390 THEN ' Infinity'
            ELSE concat(CAST(received_cents // 100 AS VARCHAR), '.', lpad(CAST(received_cents % 100 AS VARCHAR), 2, '0')) END AS amount_received,
       receiving_currency,
       CASE score_milli WHEN 460 THEN NULL WHEN 380 THEN 'nan' WHEN 370 THEN '-inf'
            ELSE concat(' ', CAST(paid_cents // 100 AS VARCHAR), '.', lpad(CAST(paid_cents % 100 AS VARCHAR), 2, '0')) END AS amount_paid,
       CASE WHEN score_milli = 450 THEN NULL ELSE payment_currency END AS payment_currency,
       upper(payment_format) AS payment_format,
       CASE score_milli WHEN 440 THEN 'x' WHEN 430 THEN NULL WHEN 420 THEN 'nan' WHEN 410 THEN 'Infinity' WHEN 400 THEN '99999999999'
            ELSE CAST(label AS VARCHAR) END AS is_laundering_csv
FROM txn""",
)


def finite(column: str) -> str:
    """A text column as a finite number, else null."""
    number = f"TRY_CAST(trim({column}) AS DOUBLE)"
    return f"CASE WHEN isfinite({number}) THEN {number} END"


VIEWS["typed"] = (
    ("raw",),
    f"""SELECT row_idx, try_strptime(timestamp, '%Y/%m/%d %H:%M') AS timestamp,
       trim(from_bank) AS from_bank, trim(from_account) AS from_account, trim(to_bank) AS to_bank, trim(to_account) AS to_account,
       {finite('amount_received')} AS amount_received, trim(receiving_currency) AS receiving_currency,
       {finite('amount_paid')} AS amount_paid, trim(payment_currency) AS payment_currency,
       trim(payment_format) AS payment_format,
       COALESCE(TRY_CAST({finite('is_laundering_csv')} AS INTEGER), 0) AS is_laundering_csv
FROM raw WHERE try_strptime(timestamp, '%Y/%m/%d %H:%M') IS NOT NULL""",
)


def _key(ts: str) -> str:
    return f"""concat(strftime({ts}, '%Y-%m-%d %H:%M'), '|', lower(trim(from_bank)), '|', lower(trim(from_account)), '|',
        lower(trim(to_bank)), '|', lower(trim(to_account)), '|', printf('%.2f', round(amount_paid, 2)), '|',
        COALESCE(lower(trim(payment_currency)), 'nan'), '|', lower(trim(payment_format)))"""


KEY = _key("ts")
# a pattern list: most positives, some of them a second time, and some rows no transaction has
VIEWS["patterns"] = (
    ("txn",),
    """SELECT row_idx AS file_pos, ts, from_bank, from_account, to_bank, to_account, amount_paid, payment_currency, payment_format,
       concat('TYPE', CAST(CAST(substr(from_bank, 2) AS INTEGER) % 4 AS VARCHAR)) AS pattern_type,
       CAST(substr(from_bank, 2) AS BIGINT) + 1 AS pattern_block_id
FROM txn WHERE label = 1 AND payment_currency <> 'CUR0'
UNION ALL
SELECT row_idx + 1000000000000, ts, from_bank, from_account, to_bank, to_account, amount_paid, payment_currency, payment_format,
       'STACK', CAST(substr(from_bank, 2) AS BIGINT) + 101
FROM txn WHERE label = 1 AND payment_currency = 'CUR1'
UNION ALL
SELECT row_idx + 2000000000000, ts, from_bank, from_account, to_bank, to_account, amount_paid + 0.5, payment_currency, payment_format,
       'RANDOM', CAST(substr(from_bank, 2) AS BIGINT) + 201
FROM txn WHERE label = 1 AND payment_currency = 'CUR2'""",
)
VIEWS["pattern_keys"] = (
    ("patterns",),
    f"""SELECT k, pattern_type, pattern_block_id FROM (
  SELECT {KEY} AS k, pattern_type, pattern_block_id, row_number() OVER (PARTITION BY {KEY} ORDER BY file_pos) AS rn FROM patterns)
WHERE rn = 1""",
)
VIEWS["linked"] = (
    ("txn", "pattern_keys"),
    f"""SELECT t.*, COALESCE(p.pattern_type, 'NONE') AS pattern_type, COALESCE(p.pattern_block_id, -1) AS pattern_block_id,
       CASE WHEN p.k IS NULL THEN 0 ELSE 1 END AS label_from_patterns,
       CASE WHEN t.label = 1 AND p.k IS NULL THEN 1 ELSE 0 END AS mismatch_flag
FROM (SELECT *, {KEY} AS mk FROM txn) t LEFT JOIN pattern_keys p ON t.mk = p.k""",
)


def _rolling(account: str, other: str) -> str:
    logs = "CAST(round(ln(1 + b.amount_paid) * 100000000) AS BIGINT)"
    week, month = f"b.us >= a.us - {7 * _DAY}", "b.row_idx IS NOT NULL"
    return f"""SELECT a.row_idx,
       count(b.row_idx) FILTER (WHERE b.us >= a.us - {_DAY}) AS n1,
       count(b.row_idx) FILTER (WHERE {week}) AS n7,
       count(b.row_idx) AS n30,
       CAST(COALESCE(sum({logs}) FILTER (WHERE {week}), 0) AS BIGINT) AS a7,
       CAST(COALESCE(sum({logs}) FILTER (WHERE {month}), 0) AS BIGINT) AS a30,
       count(DISTINCT CASE WHEN {week} THEN b.{other} END) AS u7,
       count(DISTINCT b.{other}) AS u30,
       CAST(COALESCE(sum(CASE WHEN b.from_bank <> b.to_bank THEN 1 ELSE 0 END) FILTER (WHERE {month}), 0) AS BIGINT) AS x30
FROM txn a LEFT JOIN txn b ON a.split = b.split AND a.{account} = b.{account}
     AND b.row_idx < a.row_idx AND b.us >= a.us - {30 * _DAY}
GROUP BY a.row_idx"""


VIEWS["sent"] = (("txn",), _rolling("from_account", "to_account"))
VIEWS["got"] = (("txn",), _rolling("to_account", "from_account"))


def role_columns(view: str, role: str) -> str:
    v = view
    return f"""{v}.n1 AS {role}_tx_count_1d, {v}.n7 AS {role}_tx_count_7d, {v}.n30 AS {role}_tx_count_30d,
       CASE WHEN {v}.n7 > 0 THEN CAST({v}.a7 AS DOUBLE) / {v}.n7 / 100000000 ELSE 0 END AS {role}_avg_amount_7d,
       CASE WHEN {v}.n30 > 0 THEN CAST({v}.a30 AS DOUBLE) / {v}.n30 / 100000000 ELSE 0 END AS {role}_avg_amount_30d,
       {v}.u7 AS {role}_unique_counterparties_7d, {v}.u30 AS {role}_unique_counterparties_30d,
       CASE WHEN {v}.n30 > 0 THEN CAST({v}.x30 AS DOUBLE) / {v}.n30 ELSE 0 END AS {role}_cross_bank_ratio_30d"""


# thirty scored runs over validation and test rows
VIEWS["runs"] = (
    (),
    """SELECT r AS run_no, (['baseline', 'random_undersampling', 'smote', 'adasyn', 'class_weighting'])[r // 6 + 1] AS strategy,
       (['random_forest', 'xgboost'])[(r // 3) % 2 + 1] AS model, ([CAST(0.010 AS DOUBLE), CAST(0.005 AS DOUBLE), CAST(0.001 AS DOUBLE)])[r % 3 + 1] AS target_prevalence,
       (['p010', 'p005', 'p001'])[r % 3 + 1] AS tag,
       900 - 100 * (r // 6) - 150 * ((r // 3) % 2) - CASE WHEN r >= 6 THEN 40 * (r % 3) ELSE 0 END AS w,
       ((r // 6) * 100 + ((r // 3) % 2) * 10 + CASE WHEN r >= 6 THEN r % 3 ELSE 0 END) * 104729 AS shift
FROM (SELECT CAST(unnest(range(0, 30)) AS BIGINT) AS r)""",
)
VIEWS["pool_runs"] = (
    (),
    """SELECT 100 + r AS run_no, 'three_pool' AS strategy, 'xgboost' AS model,
       ([CAST(0.010 AS DOUBLE), CAST(0.005 AS DOUBLE), CAST(0.001 AS DOUBLE)])[r + 1] AS target_prevalence,
       (['p010', 'p005', 'p001'])[r + 1] AS tag, 700 + 50 * r AS w, (900 + r) * 104729 AS shift
FROM (SELECT CAST(unnest(range(0, 3)) AS BIGINT) AS r)""",
)


def _run_views(prefix: str, runs: str) -> None:
    VIEWS[f"{prefix}_scores"] = (
        ("txn", runs),
        f"""SELECT r.run_no, t.split, t.label, (r.w * t.score_milli + (1000 - r.w) * ((t.row_idx * 7919 + r.shift) % 1000)) // 1000 AS s
FROM txn t CROSS JOIN {runs} r WHERE t.split IN ('val', 'test')""",
    )
    VIEWS[f"{prefix}_curve"] = (
        (f"{prefix}_scores",),
        f"""SELECT *, CAST(sum(n) OVER w AS BIGINT) AS cn, CAST(sum(p) OVER w AS BIGINT) AS cp,
       CAST(sum(n) OVER a AS BIGINT) AS n_all, CAST(sum(p) OVER a AS BIGINT) AS p_all
FROM (SELECT run_no, split, s, count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM {prefix}_scores GROUP BY run_no, split, s)
WINDOW w AS (PARTITION BY run_no, split ORDER BY s DESC), a AS (PARTITION BY run_no, split)""",
    )
    VIEWS[f"{prefix}_tau"] = (
        (f"{prefix}_curve",),
        f"""SELECT run_no, s AS tau FROM (
  SELECT run_no, s, row_number() OVER (PARTITION BY run_no ORDER BY CAST(2 * cp AS DOUBLE) / (cn + p_all) DESC, s) AS rn
  FROM {prefix}_curve WHERE split = 'val') WHERE rn = 1""",
    )
    for name, tau in (("at_half", "500"), ("at_tau", "x.tau")):
        VIEWS[f"{prefix}_{name}"] = (
            (f"{prefix}_curve", f"{prefix}_tau"),
            f"""SELECT run_no, split, tau, pr_auc, roc_auc, tp, fp, tn, fn,
       CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision,
       CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
       CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END AS f1,
       CASE WHEN 5 * tp + 4 * fn + fp > 0 THEN CAST(5 * tp AS DOUBLE) / (5 * tp + 4 * fn + fp) ELSE 0 END AS f2,
       CASE WHEN tp + fn > 0 THEN (CAST(tp AS DOUBLE) / (tp + fn) + CAST(tn AS DOUBLE) / (tn + fp)) / 2
            ELSE CAST(tn AS DOUBLE) / (tn + fp) END AS weighted_accuracy
FROM (SELECT c.run_no, c.split, max({tau}) AS tau,
        {AVERAGE_PRECISION} AS pr_auc,
        CASE WHEN max(p_all) > 0 THEN CAST(sum((n - p) * (2 * cp - p)) AS DOUBLE) / 2 / (CAST(max(p_all) AS DOUBLE) * (max(n_all) - max(p_all))) END AS roc_auc,
        CAST(COALESCE(sum(p) FILTER (WHERE s >= {tau}), 0) AS BIGINT) AS tp,
        CAST(COALESCE(sum(n - p) FILTER (WHERE s >= {tau}), 0) AS BIGINT) AS fp,
        CAST(COALESCE(sum(n - p) FILTER (WHERE s < {tau}), 0) AS BIGINT) AS tn,
        CAST(COALESCE(sum(p) FILTER (WHERE s < {tau}), 0) AS BIGINT) AS fn
      FROM {prefix}_curve c JOIN {prefix}_tau x ON c.run_no = x.run_no GROUP BY c.run_no, c.split)""",
        )
    wide = []
    for split, name, tag in (("val", "at_half", "val"), ("test", "at_half", "test"), ("val", "at_tau", "val_thresh"), ("test", "at_tau", "test_thresh")):
        cols = ["precision", "recall", "f1", "f2", "weighted_accuracy", "tp", "fp", "tn", "fn"]
        if name == "at_half":
            cols = ["pr_auc", "roc_auc", *cols]
        wide.append((f"{prefix}_{name}", split, tag, cols))
    select = ", ".join(f"m_{tag}.{c} AS {c}_{tag}" for _, _, tag, cols in wide for c in cols)
    joins = " ".join(
        f"LEFT JOIN (SELECT * FROM {view} WHERE split = '{split}') m_{tag} ON r.run_no = m_{tag}.run_no" for view, split, tag, _ in wide
    )
    VIEWS[f"{prefix}_board"] = (
        (runs, f"{prefix}_at_half", f"{prefix}_at_tau"),
        f"""SELECT r.run_no, concat(r.model, '__', r.strategy, '__', r.tag) AS run_id, r.model, r.strategy, r.target_prevalence, r.tag,
       {select}, CAST(CAST(m_val_thresh.tau / CAST(1000 AS DOUBLE) AS FLOAT) AS DOUBLE) AS optimal_threshold
FROM {runs} r {joins}""",
    )


_run_views("run", "runs")
_run_views("pool", "pool_runs")

# importance of a feature in a run: how far high scores go with high values
IMPORTANCE_FEATURES = {
    "paid_units": "paid_cents // 100",
    "received_units": "received_cents // 100",
    "paid_digits": "length(CAST(paid_cents AS VARCHAR))",
    "hour": "hour(ts)",
    "weekday": "(dayofweek(ts) + 6) % 7",
    "day": "day(ts)",
    "month": "month(ts)",
    "same_bank": "CASE WHEN from_bank = to_bank THEN 1 ELSE 0 END",
    "currency_mismatch": "CASE WHEN payment_currency <> receiving_currency THEN 1 ELSE 0 END",
    "from_bank_no": "CAST(substr(from_bank, 2) AS BIGINT)",
    "to_bank_no": "CAST(substr(to_bank, 2) AS BIGINT)",
    "from_digits": "length(from_account)",
    "to_digits": "length(to_account)",
    "pay_currency_no": "CAST(substr(payment_currency, 4) AS BIGINT)",
    "receive_currency_no": "CAST(substr(receiving_currency, 4) AS BIGINT)",
    "score_milli": "score_milli",
    "row_parity": "row_idx % 2",
}
VIEWS["importances"] = (
    ("txn", "runs"),
    "SELECT concat(model, '__', strategy, '__', tag) AS run_id, model, strategy, target_prevalence, feature, importance FROM ("
    "SELECT run_no, unnest(["
    + ", ".join(f"'{f}'" for f in IMPORTANCE_FEATURES)
    + "]) AS feature, unnest(["
    + ", ".join(f"CAST(sum(s * v_{f}) AS DOUBLE) / sum(s) / 1000" for f in IMPORTANCE_FEATURES)
    + "]) AS importance FROM (SELECT r.run_no, (r.w * t.score_milli + (1000 - r.w) * ((t.row_idx * 7919 + r.shift) % 1000)) // 1000 AS s, "
    + ", ".join(f"CAST({e} AS BIGINT) AS v_{f}" for f, e in IMPORTANCE_FEATURES.items())
    + " FROM txn t CROSS JOIN runs r) GROUP BY run_no) i JOIN runs USING (run_no)",
)
VIEWS["curve"] = (
    ("txn",),
    """SELECT *, CAST(sum(n) OVER w AS BIGINT) AS cn, CAST(sum(p) OVER w AS BIGINT) AS cp,
       CAST(sum(n) OVER a AS BIGINT) AS n_all, CAST(sum(p) OVER a AS BIGINT) AS p_all
FROM (SELECT split, score_milli AS s, count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM txn GROUP BY split, score_milli)
WINDOW w AS (PARTITION BY split ORDER BY s DESC), a AS (PARTITION BY split)""",
)


def with_views(names: tuple[str, ...], body: str) -> str:
    """``body`` behind the views it needs, in order of dependency."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for d in VIEWS[name][0]:
            visit(d)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        visit(n)
    if not ordered:
        return body
    # each view is read several times by some queries
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in ordered) + "\n" + body
