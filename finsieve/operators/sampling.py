"""Class balancing of a training table.

Row draws are uniform and exact in size; they depend on the seed and the row
number alone, so they do not change with the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsieve.operators.ordering import (
    chunk_positions,
    draw_exact,
    draw_key,
    drawn,
    last_drawn,
    last_taken,
    row_chunk,
    rows_at,
    up_to,
    value_bucket,
)
from finsieve.session import materialize


@dataclass
class Balanced:
    """A balanced table and what is known about it.

    ``rows`` carries ``weight`` and ``is_synthetic`` next to the input columns.
    """

    rows: DataFrame
    strategy: str
    target_prevalence: float
    n_positive: int
    n_negative: int
    class_weight: dict[int, float] | None = None
    n_synthetic: int = 0
    notes: dict = field(default_factory=dict)

    @property
    def achieved_prevalence(self) -> float:
        n = self.n_positive + self.n_negative
        return self.n_positive / n if n else 0.0


def class_counts(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    n, p = F.count(F.lit(1)), F.coalesce(F.sum(F.col("label").cast("bigint")), F.lit(0))
    return df.groupBy(*(keys or [])).agg(
        n.alias("n_total"),
        p.alias("n_pos"),
        (n - p).alias("n_neg"),
        F.when(n > 0, p / n).otherwise(F.lit(0.0)).alias("prevalence"),
    )


def count_classes(df: DataFrame) -> tuple[int, int]:
    """Positives and negatives of a table."""
    r = class_counts(df).first()
    return r["n_pos"], r["n_neg"]


def check_prevalence(p: float) -> None:
    if not 0.0 < p < 1.0:
        raise ValueError(f"prevalence must lie in (0, 1): {p}")


def minority_ratio(p: float) -> float:
    check_prevalence(p)
    return p / (1.0 - p)


def target_weights(p: float) -> dict[int, float]:
    return {0: 1.0, 1: (1.0 - p) / p}


def observed_weights(n_pos: int, n_neg: int) -> dict[int, float]:
    if n_pos == 0:
        raise ValueError("no positive rows")
    return {0: 1.0, 1: n_neg / n_pos}


def undersample_target(n_pos: int, p: float) -> int:
    """Negatives kept by undersampling; truncates."""
    return int(n_pos / minority_ratio(p))


def oversample_budget(n_pos: int, n_neg: int, p: float) -> int:
    """Synthetic positives needed to reach ``p``; truncates."""
    return int(n_neg * minority_ratio(p) - n_pos)


def with_weight(df: DataFrame, weights: dict[int, float] | None) -> DataFrame:
    w = weights or {0: 1.0, 1: 1.0}
    return df.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(w[1]))).otherwise(F.lit(float(w[0]))))


def _original(df: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    return with_weight(df, weights).withColumn("is_synthetic", F.lit(0))


def baseline(df: DataFrame, p: float, seed: int = 42) -> Balanced:
    """Rows unchanged; the target is only recorded."""
    n_pos, n_neg = count_classes(df)
    return Balanced(_original(df), "baseline", p, n_pos, n_neg)


def _reached(n_pos: int, n_neg: int, p: float) -> bool:
    return p <= n_pos / (n_pos + n_neg)


def random_undersampling(df: DataFrame, p: float, seed: int = 42) -> Balanced:
    """All positives and exactly the negatives the target allows."""
    n_pos, n_neg = count_classes(df)
    if _reached(n_pos, n_neg, p):
        return baseline(df, p)
    keep = min(n_neg, undersample_target(n_pos, p))
    negatives = draw_exact(df.filter("label = 0"), keep, seed)
    rows = df.filter("label = 1").unionByName(negatives)
    return Balanced(_original(rows), "random_undersampling", p, n_pos, keep)


def class_weighting(df: DataFrame, p: float, seed: int = 42) -> Balanced:
    n_pos, n_neg = count_classes(df)
    w = target_weights(p)
    return Balanced(_original(df, w), "class_weighting", p, n_pos, n_neg, w)


def true_cost_weighting(df: DataFrame, p: float, seed: int = 42) -> Balanced:
    n_pos, n_neg = count_classes(df)
    w = observed_weights(n_pos, n_neg)
    return Balanced(_original(df, w), "true_cost_weighting", p, n_pos, n_neg, w)


# ---- three-pool selection -------------------------------------------------


def negative_target(n_pos: int, p: float) -> int:
    """Negatives that put ``n_pos`` positives at prevalence ``p``; rounds half to even."""
    if n_pos <= 0:
        raise ValueError(f"need positives, got {n_pos}")
    check_prevalence(p)
    return max(0, int(round(n_pos * (1.0 - p) / p)))


def pool_budgets(
    n_pos: int,
    n_neg: int,
    p: float,
    shares: tuple[float, float, float] = (0.50, 0.25, 0.25),
    hard_cap_multiplier: int | None = 20,
) -> dict[str, int]:
    """Planned size of each pool; what the cap takes from the hard pool goes to the other two in halves."""
    total = float(sum(shares))
    if total <= 0:
        raise ValueError("shares must sum to a positive value")
    hard_share, temporal_share = shares[0] / total, shares[1] / total
    want = negative_target(n_pos, p)
    planned = int(round(hard_share * want))
    temporal = int(round(temporal_share * want))
    rest = want - planned - temporal
    cap = hard_cap_multiplier * n_pos if hard_cap_multiplier is not None else planned
    hard = min(planned, cap, n_neg)
    freed = planned - hard
    return {
        "n_neg_target": want,
        "n_hard_planned": planned,
        "n_hard_cap": cap,
        "n_hard": hard,
        "n_temporal": temporal + freed // 2,
        "n_global": rest + freed - freed // 2,
    }


def _score_cut(rows: DataFrame, key: Column, n: int) -> tuple | None:
    """The value of ``key`` that the ``n``-th row from above has, and how many rows with it belong to the first ``n``."""
    counts = rows.groupBy(key.alias("_v")).agg(F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = counts.withColumn("_cum", F.sum("n").over(down)).filter(F.col("_cum") >= n).orderBy(F.col("_v").desc()).limit(1).first()
    return None if cut is None else (cut["_v"], n - (cut["_cum"] - cut["n"]), cut["n"])


def hard_rows(negatives: DataFrame, n: int, score: str = "score") -> Column:
    """Whether a row is of the ``n`` highest-scoring ones, as a predicate on its score and number; equal scores go by row number.

    The cut is found on scores grouped in ever finer steps: in buckets, in single
    precision, which bounds the values in a bucket, and for doubles again among
    those that are equal there. Rows exactly at it, however many, are cut by number.
    """
    if n <= 0:
        return F.lit(False)
    exact = F.col(score)
    steps = [value_bucket(exact.cast("float")), exact.cast("float")]
    above, same, need, step = F.lit(False), F.lit(True), n, 0
    while step < len(steps):
        key = steps[step]
        cut = _score_cut(negatives.filter(same), key, need)
        if cut is None:
            return F.lit(True)
        value, need, at = cut
        kind = negatives.select(key.alias("_v")).schema["_v"].dataType
        above = above | (same & (key > F.lit(value).cast(kind)))
        same = same & (key == F.lit(value).cast(kind))
        if at == need:
            return above | same
        step += 1
        if step == 2 and dict(negatives.dtypes)[score] == "double":
            # some thousands of buckets between one single-precision value and the next
            width = max(abs(value), 2.0**-126) * 2.0**-35
            steps += [F.floor((exact - F.lit(value)) / F.lit(width)), exact]
    last = last_taken(negatives.filter(same), need, row_chunk("row_idx"), ["row_idx"])[0]
    return above | (same & up_to([F.col("row_idx")], last))


def hard_negatives(negatives: DataFrame, n: int, score: str = "score") -> DataFrame:
    """Exactly the ``n`` highest-scoring rows; equal scores go by row number."""
    return negatives.filter(hard_rows(negatives, n, score))


def block_edges(n: int, blocks: int) -> list[int]:
    """Edges of ``blocks`` position ranges of near-equal size."""
    return [n * b // blocks for b in range(blocks + 1)]


def temporal_rows(candidates: DataFrame, n: int, n_candidates: int, blocks: int = 20, seed: int = 42) -> Column:
    """Whether a candidate is of a draw spread evenly over ``blocks`` equal stretches of the row order, as a predicate.

    Quotas are equal, the remainder goes to the first blocks; what a short block
    cannot give is drawn from the rows left over.
    """
    n = max(0, min(n, n_candidates))
    blocks = max(1, blocks)
    if n == 0:
        return F.lit(False)
    base, extra = divmod(n, blocks)
    quotas = {b: base + (1 if b < extra else 0) for b in range(blocks)}
    edges = block_edges(n_candidates, blocks)
    sizes = {b: edges[b + 1] - edges[b] for b in range(blocks)}
    # the row number that each block begins with
    begins = rows_at(candidates, [e for e in edges[1:-1] if e < n_candidates])
    starts = [begins[e] for e in edges[1:-1] if e in begins]
    block = F.size(F.filter(F.array(*map(F.lit, starts)), lambda first: first <= F.col("row_idx"))) if starts else F.lit(0)
    marked = candidates.select("row_idx", block.alias("_block"))
    last = last_drawn(marked, {b: min(q, sizes[b]) for b, q in quotas.items()}, seed, group="_block")
    # every draw key lies between the empty text and "g"
    cuts = [(last[b] or ("g", 0)) if b in last else ("", 0) for b in range(blocks)]
    at, key = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(r).cast("bigint").alias("row")) for k, r in cuts]), draw_key(seed)
    cut = F.get(at, block)
    taken = (key < cut["key"]) | ((key == cut["key"]) & (F.col("row_idx") <= cut["row"]))
    short = sum(max(0, quotas[b] - sizes[b]) for b in range(blocks))
    if short:
        taken = taken | (~taken & drawn(candidates.filter(~taken), short, seed + 1))
    return taken


def temporal_negatives(candidates: DataFrame, n: int, n_candidates: int, blocks: int = 20, seed: int = 42) -> DataFrame:
    """The candidates that :func:`temporal_rows` takes."""
    return candidates.filter(temporal_rows(candidates, n, n_candidates, blocks, seed))


def global_negatives(candidates: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Uniform draw of exactly ``n`` rows, or all when there are fewer."""
    return candidates.filter(drawn(candidates, n, seed))


def without_rows(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``df`` whose row number is not in ``chosen``."""
    return df.join(chosen.select("row_idx"), "row_idx", "left_anti")


def pool_overlap(selection: DataFrame) -> DataFrame:
    """Row numbers that occur in more than one pool; empty for a sound selection."""
    return selection.groupBy("row_idx").agg(F.count(F.lit(1)).alias("n_pools")).filter("n_pools > 1")


def three_pool_selection(
    scored: DataFrame,
    p: float,
    shares: tuple[float, float, float] = (0.50, 0.25, 0.25),
    blocks: int = 20,
    hard_cap_multiplier: int | None = 20,
    fill_from_global: bool = True,
    seed: int = 42,
) -> tuple[DataFrame, dict]:
    """All positives and three disjoint pools of negatives, as ``(row_idx, pool)``, and their counts.

    ``scored`` holds ``row_idx, label, score`` of the training rows. A pool is a
    predicate on score, row number and draw key, found from counts; one scan tags
    all rows, without lists of rows or joins.
    """
    facts = scored.agg(
        F.sum(F.col("label").cast("bigint")).alias("pos"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("score").isNull() | F.isnan("score")).alias("bad"),
    ).first()
    n_pos, n_neg = facts["pos"] or 0, facts["n"] - (facts["pos"] or 0)
    if facts["bad"]:
        raise ValueError(f"{facts['bad']} rows without a score")
    if n_pos == 0 or n_neg == 0:
        raise ValueError("need rows of both classes")
    slim = scored.select("row_idx", "label", "score")
    positives = slim.filter("label = 1").select("row_idx", F.lit("positive").alias("pool"))
    negatives = slim.filter("label = 0").select("row_idx", "score")
    want = negative_target(n_pos, p)
    if want >= n_neg:
        rows = positives.unionByName(negatives.select("row_idx", F.lit("hard").alias("pool")))
        counts = {
            "n_pos": n_pos, "n_neg_total_available": n_neg, "n_neg_target": n_neg,
            "n_hard": n_neg, "n_temporal": 0, "n_global": 0,
        }
        return rows, counts
    plan = pool_budgets(n_pos, n_neg, p, shares, hard_cap_multiplier)
    hard = hard_rows(negatives, plan["n_hard"])
    left = negatives.filter(~hard).select("row_idx")
    n_left = n_neg - plan["n_hard"]
    temporal = temporal_rows(left, plan["n_temporal"], n_left, blocks, seed)
    n_temporal = min(plan["n_temporal"], n_left)
    n_global = plan["n_global"] + (plan["n_temporal"] - n_temporal if fill_from_global else 0)
    n_global = min(n_global, n_left - n_temporal)
    rest = drawn(left.filter(~temporal), n_global, seed + 2)
    pool = F.when(F.col("label") == 1, "positive").when(hard, "hard").when(temporal, "temporal").when(rest, "global")
    rows = slim.select("row_idx", pool.alias("pool")).filter("pool IS NOT NULL")
    counts = {
        "n_pos": n_pos,
        "n_neg_total_available": n_neg,
        "n_neg_target": plan["n_neg_target"],
        "n_hard_planned": plan["n_hard_planned"],
        "n_hard_cap": plan["n_hard_cap"],
        "n_hard_actual": plan["n_hard"],
        "n_temporal_planned": plan["n_temporal"],
        "n_temporal_actual": n_temporal,
        "n_global_planned": plan["n_global"],
        "n_global_actual": n_global,
        "n_total_neg_actual": plan["n_hard"] + n_temporal + n_global,
    }
    return rows, counts


def sampling_manifest(
    selection: DataFrame, p: float, shares: tuple[float, float, float], seed: int, counts: dict, **facts
) -> DataFrame:
    """One row describing how a selection was made; ``facts`` are added as text."""
    n_pos, n_neg = counts["n_pos"], counts.get("n_total_neg_actual", counts["n_neg_target"])
    row = {
        "strategy": "three_pool",
        "target_prevalence": float(p),
        "hard_share": float(shares[0]),
        "temporal_share": float(shares[1]),
        "global_share": float(shares[2]),
        "random_seed": int(seed),
        "achieved_prevalence": n_pos / (n_pos + n_neg),
        **{k: int(v) for k, v in counts.items()},
        **{k: str(v) for k, v in facts.items()},
    }
    return selection.sparkSession.createDataFrame([row]).withColumn("created_at", F.current_timestamp())


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Rows redistributed in draw order, for learners that depend on it."""
    return rows.withColumn("_key", draw_key(seed)).repartitionByRange("_key").sortWithinPartitions("_key").drop("_key")


def align_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach scores by row number; fails unless the two tables cover the same rows."""
    n_rows, n_scores = rows.count(), scores.count()
    if n_rows != n_scores:
        raise ValueError(f"{n_rows} rows but {n_scores} scores")
    joined = rows.join(scores.select("row_idx", "score"), "row_idx")
    n_joined = joined.select("row_idx").count()
    if n_joined != n_rows:
        raise ValueError(f"only {n_joined} of {n_rows} rows have a score")
    return joined


def aligned_subsample(train: DataFrame, scores: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn at random, renumbered in their old order, with their scores.

    Columns: ``row_idx`` (new), ``orig_row_idx``, ``label``, ``score``. Fails
    when no positive row is drawn.
    """
    slim = train.select("row_idx", "label")
    drawn = slim if n >= slim.count() else draw_exact(slim, n, seed)
    drawn = materialize(chunk_positions(drawn, name="_new"), "subsample")
    if drawn.filter("label = 1").isEmpty():
        raise RuntimeError("the subsample holds no positive row; draw more rows or change the seed")
    return drawn.join(scores.select("row_idx", "score"), "row_idx").select(
        F.col("_new").alias("row_idx"), F.col("row_idx").alias("orig_row_idx"), "label", "score"
    )
