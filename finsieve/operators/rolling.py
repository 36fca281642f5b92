"""Per-account rolling windows over the account's own past.

The window of a row holds the rows of the same account that come earlier in
(time, row number) order and lie at most W back. Equal-time predecessors count,
the row itself does not.

Every transaction becomes one entering event and, per window length, one event
W later that takes its share out again. A running sum over the account's events
is then the window value, for all windows at once and in one linear pass: no
range frames, no collected sets. All summed values are integers, so taking out
exactly cancels putting in.

An account may hold a large share of all rows. The events of accounts above
``hot_rows`` rows are range-partitioned in the order of the sweep, so that a chunk
is a share of the events, entering or leaving, however unevenly they lie in time;
the running sums inside a chunk get the totals of the account's earlier chunks
added. Leaving events behind an account's last row say nothing and are dropped. No
task ever sees more of one account than a chunk, and of the other accounts about
``TASK_ROWS`` rows: the number of partitions follows from the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finsieve.operators.ordering import parts_for, row_chunk
from finsieve.session import materialize

_DAY = 86_400_000_000
# fixed values: window lengths in microseconds
WINDOWS = {"1d": _DAY, "7d": 7 * _DAY, "30d": 30 * _DAY}
# running sums kept per account
_SUMS = ["n_1d", "n_7d", "n_30d", "a_7d", "a_30d", "u_7d", "u_30d", "x_30d"]
# an account with more than 2^HOT_BITS rows is swept in chunks of so many events
HOT_BITS = 19
# log amounts are summed in units of 1e-8
FIXED_POINT = 100_000_000


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a missing key equals a missing key."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, match, how).drop(*[f"_r_{k}" for k in keys])


def _delta_struct(us, kind, values, payload):
    cols = [us.alias("_us"), kind.alias("_kind")]
    cols += [values.get(s, F.lit(0)).cast("bigint").alias(f"_d_{s}") for s in _SUMS]
    return F.struct(*cols, payload.alias("_row"))


def _unseen_and_last(prev_us, next_us):
    """Per window: 1 if the pair is new to the window, 1 if nothing renews it."""
    us = F.col("_us0")
    new, last = {}, {}
    for w in ("7d", "30d"):
        span = F.lit(WINDOWS[w])
        new[w] = F.when(prev_us.isNull() | (prev_us < us - span), 1).otherwise(0)
        last[w] = F.when(next_us.isNull() | (next_us > us + span), 1).otherwise(0)
    return new, last


def _entering(new):
    one, amt, x = F.lit(1), F.col("_amt"), F.col("_cross")
    return {
        "n_1d": one, "n_7d": one, "n_30d": one, "a_7d": amt, "a_30d": amt,
        "u_7d": new["7d"], "u_30d": new["30d"], "x_30d": x,
    }


def _leaving(w, last):
    amt = F.col("_amt")
    out = {f"n_{w}": F.lit(-1)}
    if w != "1d":
        out |= {f"a_{w}": -amt, f"u_{w}": -last[w]}
    if w == "30d":
        out["x_30d"] = -F.col("_cross")
    return out


def _finish(swept: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    """Feature columns from the running sums of the entering events."""
    v = {s: F.col(f"_s_{s}") - F.col(f"_d_{s}") for s in _SUMS}
    mean = lambda total, n: F.when(n > 0, total / n).otherwise(F.lit(0.0))
    return swept.filter("_kind = 0").select(
        *[F.col(f"_row.{c}").alias(c) for c in columns],
        v["n_1d"].alias(f"{prefix}_tx_count_1d"),
        v["n_7d"].alias(f"{prefix}_tx_count_7d"),
        v["n_30d"].alias(f"{prefix}_tx_count_30d"),
        (mean(v["a_7d"], v["n_7d"]) / FIXED_POINT).alias(f"{prefix}_avg_amount_7d"),
        (mean(v["a_30d"], v["n_30d"]) / FIXED_POINT).alias(f"{prefix}_avg_amount_30d"),
        v["u_7d"].alias(f"{prefix}_unique_counterparties_7d"),
        v["u_30d"].alias(f"{prefix}_unique_counterparties_30d"),
        mean(v["x_30d"], v["n_30d"]).alias(f"{prefix}_cross_bank_ratio_30d"),
    )


def _prepared(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "_us0": F.col("us"),
            "_idx": F.col("row_idx"),
            "_amt": F.coalesce(F.rint(F.col("log_paid") * FIXED_POINT).cast("bigint"), F.lit(0)),
            "_cross": F.col("cross_bank").cast("bigint"),
        }
    )


def _sweep_whole(df: DataFrame, keys: list[str], pair: str, columns: list[str], prefix: str, parts: int, facts: DataFrame | None) -> DataFrame:
    """Accounts that fit a task: one shuffle by account into ``parts`` partitions, then two sorts."""
    by_pair = Window.partitionBy(*keys, pair).orderBy("_idx")
    placed = df.repartition(parts, keys[-1])
    if facts is not None:
        # both sides lie by account, so the rows are not shuffled again
        side = facts.withColumnRenamed(facts.columns[0], "_acc").repartition(parts, "_acc").hint("shuffle_hash")
        placed = placed.join(side, F.col(keys[-1]) == F.col("_acc"), "left").drop("_acc")
    placed = _prepared(placed)
    seen = placed.withColumns(
        {"_prev": F.lag("_us0").over(by_pair), "_next": F.lead("_us0").over(by_pair)}
    )
    new, last = _unseen_and_last(F.col("_prev"), F.col("_next"))
    row = F.struct(*columns)
    nothing = F.lit(None).cast(seen.select(row.alias("r")).schema["r"].dataType)
    events = [_delta_struct(F.col("_us0"), F.lit(0), _entering(new), row)]
    events += [
        _delta_struct(F.col("_us0") + F.lit(span), F.lit(1), _leaving(w, last), nothing)
        for w, span in WINDOWS.items()
    ]
    stream = seen.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_idx", F.inline(F.array(*events)))
    along = (
        Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
        .orderBy("_us", "_kind", "_idx")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    swept = stream.withColumns({f"_s_{s}": F.sum(f"_d_{s}").over(along) for s in _SUMS})
    return _finish(swept, columns, prefix)


def event_chunks(df: DataFrame, keys: list[str], pair: str, columns: list[str], hot: DataFrame, bits: int) -> DataFrame:
    """The events of the accounts ``hot`` (with ``_rows`` and ``_end``, their last time), stored with ``_chunk``.

    Chunks ascend along (account, time, kind, row number) and hold about
    ``2 ** bits`` events each.
    """
    c = df.withColumn("_chunk", row_chunk("_idx", bits))
    pair_keys = [*keys, pair]

    # previous and next time of the pair, across chunk borders
    in_chunk = Window.partitionBy(*pair_keys, "_chunk").orderBy("_idx")
    across = Window.partitionBy(*pair_keys).orderBy("_chunk")
    borders = (
        c.groupBy(*pair_keys, "_chunk")
        .agg(F.min("_us0").alias("_first"), F.max("_us0").alias("_last"))
        .select(
            *pair_keys, "_chunk",
            F.lag("_last").over(across).alias("_before"),
            F.lead("_first").over(across).alias("_after"),
        )
    )
    seen = c.withColumns({"_p": F.lag("_us0").over(in_chunk), "_n": F.lead("_us0").over(in_chunk)})
    seen = _join(seen, borders, [*pair_keys, "_chunk"]).withColumns(
        {"_prev": F.coalesce("_p", "_before"), "_next": F.coalesce("_n", "_after")}
    )
    new, last = _unseen_and_last(F.col("_prev"), F.col("_next"))
    row = F.struct(*columns)
    row_type = seen.select(row.alias("r")).schema["r"].dataType

    entering = seen.select(
        *keys, "_idx", F.inline(F.array(_delta_struct(F.col("_us0"), F.lit(0), _entering(new), row))),
    )
    leaving = seen.select(
        *keys,
        F.inline(
            F.array(
                *[
                    _delta_struct(F.col("_us0") + F.lit(span), F.lit(1), _leaving(w, last), F.lit(None).cast(row_type))
                    for w, span in WINDOWS.items()
                ]
            )
        ),
    )
    # no row is left to see what leaves after the account's last one
    ends = hot.select(*keys, "_end")
    leaving = _join(leaving, ends, keys).filter("_us < _end")
    # one leaving event per account and time
    leaving = leaving.groupBy(*keys, "_us").agg(*[F.sum(f"_d_{s}").alias(f"_d_{s}") for s in _SUMS])
    leaving = leaving.withColumns({"_kind": F.lit(1), "_idx": F.lit(-1).cast("bigint"), "_row": F.lit(None).cast(row_type)})
    stream = entering.unionByName(leaving)
    # a row enters once and leaves three windows at most
    events = 4 * (hot.agg(F.sum("_rows")).first()[0] or 0)
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-events >> bits))
    along = [*keys, "_us", "_kind", "_idx"]
    return materialize(stream.repartitionByRange(n, *along).withColumn("_chunk", F.spark_partition_id()), "rolling-events")


def _sweep_chunked(df: DataFrame, keys: list[str], pair: str, columns: list[str], prefix: str, hot: DataFrame, bits: int) -> DataFrame:
    """Accounts too large for a task: the same sweep, chunk by chunk with carried totals."""
    stream = event_chunks(df, keys, pair, columns, hot, bits)

    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = stream.groupBy(*keys, "_chunk").agg(*[F.sum(f"_d_{s}").alias(f"_t_{s}") for s in _SUMS])
    carried = totals.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_c_{s}") for s in _SUMS]
    )
    along = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy("_us", "_kind", "_idx")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = stream.withColumns({f"_l_{s}": F.sum(f"_d_{s}").over(along) for s in _SUMS})
    swept = _join(running, carried, [*keys, "_chunk"]).withColumns(
        {f"_s_{s}": F.col(f"_l_{s}") + F.col(f"_c_{s}") for s in _SUMS}
    )
    return _finish(swept, columns, prefix)


def hot_accounts(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Accounts with more than ``hot_rows`` rows, their number and last time; at most one per ``hot_rows`` input rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.max("us").alias("_end")).filter(F.col("_rows") > hot_rows)


def with_rolling(
    df: DataFrame,
    account: str,
    counterparty: str,
    prefix: str,
    scope: tuple[str, ...] = (),
    keys_from: DataFrame | None = None,
    hot_rows: int = 1 << HOT_BITS,
    chunk_bits: int = HOT_BITS,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Add the eight rolling columns of one role.

    ``df`` needs ``us`` (time in microseconds), ``row_idx`` (position in time
    order), ``log_paid`` and ``cross_bank``. ``scope`` lists columns that
    separate histories, such as the split. ``keys_from`` may name a cheaper
    table with the same accounts, read to find the hot ones. ``facts`` may hold a
    row per account, the account first: its other columns are added to the account's
    rows where these lie together anyway, null for an unknown account.
    """
    keys = [*scope, account]
    columns = [*df.columns, *(facts.columns[1:] if facts is not None else [])]
    source = keys_from if keys_from is not None else df
    parts = parts_for(df.sparkSession, source.count())
    hot = hot_accounts(source, keys, hot_rows)
    if hot.isEmpty():
        return _sweep_whole(df, keys, counterparty, columns, prefix, parts, facts)

    hot = materialize(hot, "hot-accounts")
    stored = materialize(df, "rolling-input")
    hot_keys = hot.select(*keys)
    cold = _sweep_whole(_join(stored, hot_keys, keys, "left_anti"), keys, counterparty, columns, prefix, parts, facts)
    often = _join(stored, hot_keys, keys, "left_semi")
    if facts is not None:
        # one row per hot account
        known = facts.withColumnRenamed(facts.columns[0], "_acc").join(F.broadcast(hot.select(account).distinct()), F.col("_acc") == F.col(account), "left_semi")
        often = often.join(F.broadcast(known), F.col(account) == F.col("_acc"), "left").drop("_acc")
    large = _sweep_chunked(_prepared(often), keys, counterparty, columns, prefix, hot, chunk_bits)
    return cold.unionByName(large)
