import math
import random

import pytest
from pyspark.sql import functions as F

from finsieve.operators.rolling import WINDOWS, event_chunks, hot_accounts, with_rolling

_DAY = WINDOWS["1d"]


def _rows(seed, n, heavy):
    """Rows in time order; account A takes a third or more, many at the same time."""
    rng = random.Random(seed)
    times = sorted(rng.choice([rng.randint(0, 60) * _DAY, rng.randint(0, 60 * _DAY)]) for _ in range(n))
    out = []
    for i, t in enumerate(times):
        acc = "A" if rng.random() < heavy else rng.choice(["B", "C", None])
        cp = rng.choice(["x", "y", "z", "w", None])
        out.append((i, 10**15 + t, acc, cp, rng.choice(["train", "val"]), float(rng.randint(0, 500)), rng.randint(0, 1)))
    return out


def _expected(rows, scoped):
    out = {}
    for i, us, acc, cp, split, amt, cross in rows:
        past = [r for r in rows[:i] if r[2] == acc and (not scoped or r[4] == split)]
        win = {w: [r for r in past if r[1] >= us - span] for w, span in WINDOWS.items()}
        mean = lambda rs: sum(round(math.log1p(r[5]) * 1e8) for r in rs) / len(rs) / 1e8 if rs else 0.0
        out[i] = (
            len(win["1d"]), len(win["7d"]), len(win["30d"]), mean(win["7d"]), mean(win["30d"]),
            len({r[3] for r in win["7d"]}), len({r[3] for r in win["30d"]}),
            sum(r[6] for r in win["30d"]) / len(win["30d"]) if win["30d"] else 0.0,
        )
    return out


@pytest.mark.parametrize("hot_rows,bits", [(10**6, 22), (40, 5), (5, 4), (0, 6)])
@pytest.mark.parametrize("scoped", [True, False])
def test_matches_brute_force(spark, hot_rows, bits, scoped):
    rows = _rows(1, 300, 0.5)
    df = spark.createDataFrame(
        rows, "row_idx bigint, us bigint, acc string, cp string, split string, amount double, cross_bank int"
    ).withColumn("log_paid", F.log1p("amount"))
    got = with_rolling(
        df.repartition(5), "acc", "cp", "s", ("split",) if scoped else (), hot_rows=hot_rows, chunk_bits=bits
    ).collect()
    want = _expected(rows, scoped)
    assert len(got) == len(rows)
    for r in got:
        mine = (
            r["s_tx_count_1d"], r["s_tx_count_7d"], r["s_tx_count_30d"], r["s_avg_amount_7d"], r["s_avg_amount_30d"],
            r["s_unique_counterparties_7d"], r["s_unique_counterparties_30d"], r["s_cross_bank_ratio_30d"],
        )
        assert mine == pytest.approx(want[r["row_idx"]], abs=1e-12), r["row_idx"]


def test_missing_amount_counts_but_adds_nothing(spark):
    rows = [(0, 10**15, "A", "x", None, 0), (1, 10**15 + 1, "A", "x", 3.0, 0), (2, 10**15 + 2, "A", "y", 3.0, 1)]
    df = spark.createDataFrame(rows, "row_idx bigint, us bigint, acc string, cp string, log_paid double, cross_bank int")
    got = {r["row_idx"]: r for r in with_rolling(df, "acc", "cp", "s").collect()}
    assert got[2]["s_tx_count_7d"] == 2
    assert got[2]["s_avg_amount_7d"] == pytest.approx(1.5)


def test_feature_table_with_chunked_accounts(spark, sf_dir):
    """Cutting accounts into chunks changes no feature of the whole table."""
    from finsieve.operators.features import feature_table
    from finsieve.plans import tables as T

    txn, accounts = T.txn(spark, sf_dir), T.listed_accounts(spark, sf_dir)
    whole = feature_table(txn, accounts)
    cut = feature_table(txn, accounts, hot_rows=40, chunk_bits=8)
    assert whole.exceptAll(cut).count() == 0 == cut.exceptAll(whole).count()


def test_chunks_hold_a_share_of_the_events(spark):
    """A burst a window ago leaves while few rows come: chunks cut by rows would take all of it at once."""
    rng = random.Random(2)
    burst = sorted(rng.sample(range(10**6), 3000))
    times = [10**15 + t for t in burst] + [10**15 + 3 * _DAY + 7 * _DAY * i // 20 for i in range(40)]
    rows = [(i, t, "A", rng.choice("xyz"), 1.0, 0) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "row_idx bigint, us bigint, acc string, cp string, log_paid double, cross_bank int")
    base = df.withColumns({"_us0": F.col("us"), "_idx": F.col("row_idx"), "_amt": F.lit(1).cast("bigint"), "_cross": F.lit(0).cast("bigint")})
    hot = hot_accounts(df, ["acc"], 100)
    events = event_chunks(base, ["acc"], "cp", df.columns, hot, 8)
    sizes = [r["count"] for r in events.groupBy("acc", "_chunk").count().collect()]
    # the burst leaves the shortest two windows; nothing is kept of what leaves after the last row
    assert sum(sizes) == len(rows) + sum(t + w < times[-1] for t in times for w in WINDOWS.values())
    assert max(sizes) <= 2 * 2**8


def test_tasks_hold_a_share_of_the_rows(spark, monkeypatch):
    """The sweep's partitions follow from the number of rows; the types of accounts are joined without another shuffle of the rows."""
    from finsieve.operators import ordering
    from finsieve.operators.features import account_features

    monkeypatch.setattr(ordering, "TASK_ROWS", 20)
    rows = _rows(3, 300, 0.3)
    df = spark.createDataFrame(
        [(i, us, acc, cp, split, amt, cross) for i, us, acc, cp, split, amt, cross in rows],
        "row_idx bigint, us bigint, from_account string, to_account string, split string, log_paid double, cross_bank int",
    )
    types = spark.createDataFrame([("A", 0), ("B", 1), ("x", 1)], "account string, entity_type int")
    for hot_rows in (10**6, 40):
        found = account_features(df, types, hot_rows=hot_rows, chunk_bits=5)
        kinds = {"A": 0, "B": 1, "x": 1}
        got = {r["row_idx"]: (r["sender_entity_type"], r["receiver_entity_type"]) for r in found.collect()}
        assert got == {r[0]: (kinds.get(r[2], 2), kinds.get(r[3], 2)) for r in rows}
        if hot_rows > 300:
            plan = found._jdf.queryExecution().toString()
            plan = plan[plan.index("== Physical Plan =="):]
            # rows by sender and by receiver, and the types by account for each
            initial = plan[plan.rindex("== Initial Plan =="):] if "== Initial Plan ==" in plan else plan
            assert initial.count("Exchange hashpartitioning") == 4 == initial.count(", 15), REPARTITION_BY_NUM")
