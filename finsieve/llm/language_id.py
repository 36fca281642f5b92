"""Language identification: first the family, then the language within it.

A text is a vector of hashed byte n-gram counts. Linear support vector machines,
one for every pair, choose the family of languages; within the chosen family
again one for every pair of its languages chooses the language. All are trained
here, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.llm.batches import SLICE_BYTES, slices, texts_of, worker_keeps
from finsieve.session import materialize

UNKNOWN = "und"
#: Bins of n-gram hashes, and lengths of n-grams in bytes.
BINS, LENGTHS = 4096, (2, 3, 4)
#: Labelled rows that the models are fitted on, in expectation, over all languages; rows are chosen by
#: their hash. Each gives its whole text and one short extract.
TRAINING_ROWS = 3_000
EXTRACT_BYTES = 60
#: Texts whose counts are held at once, and texts counted at once, which takes some 60 bytes for each of theirs.
TEXTS_AT_ONCE, COUNTED_AT_ONCE = 512, 64

#: Language families by language code (fixed values); any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tr uz",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)


def _ngram_counts(lower: pa.Array) -> np.ndarray:
    """How often every bin occurs in each of some texts' bytes."""
    lengths = pc.binary_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    # every text is set off by spaces, so the first and last word have edges too
    flat = np.frombuffer(b" " + b"  ".join(lower.to_pylist()) + b" ", dtype=np.uint8).astype(np.uint32)
    rows = np.repeat(np.arange(len(lower)), lengths + 2)
    counts = np.zeros(len(lower) * BINS, dtype=np.float32)
    rolled = flat.copy()
    for n in range(2, max(LENGTHS) + 1):
        if len(flat) < n:
            break
        rolled = rolled[:-1] * np.uint32(0x01000193) ^ (flat[n - 1 :] * np.uint32(0x9E3779B1))
        if n in LENGTHS:
            inside = rows[: len(rolled)] == rows[n - 1 :]
            bins = ((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(20)).astype(np.int64)
            counts += np.bincount(rows[: len(rolled)][inside] * BINS + bins[inside], minlength=len(counts)).astype(np.float32)
    return counts.reshape(len(lower), BINS)


def ngram_features(texts: pa.Array) -> np.ndarray:
    """Square roots of the n-gram counts of every text, of length one; letter case is ignored."""
    lower = pc.utf8_lower(texts).cast(pa.large_binary())
    features = np.zeros((len(lower), BINS), np.float32)
    for first in range(0, len(lower), COUNTED_AT_ONCE):
        features[first : first + COUNTED_AT_ONCE] = _ngram_counts(lower[first : first + COUNTED_AT_ONCE])
    np.sqrt(features, out=features)
    features /= np.maximum(np.linalg.norm(features, axis=1, keepdims=True), 1e-9)
    return features


def linear_svm(x: np.ndarray, positive: np.ndarray, cost: float = 20.0, steps: int = 150) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge support vector machine, by accelerated gradient descent."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    # both classes weigh the same
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    previous, rate = w.copy(), 1.0 / (1.0 / cost + 4.0)
    for t in range(steps):
        v = w + (t / (t + 3.0)) * (w - previous)
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        pull = 2 * weight * slack * y
        gradient = np.append(v[:-1] / cost - x.T @ pull, -pull.sum())
        previous, w = w, (v - rate * gradient).astype(np.float32)
    return w


@dataclass
class Voting:
    """One support vector machine for every pair of ``names``; the name with most wins, then the widest margins."""

    names: list[str]
    planes: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS + 1), np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the winner among ``names``, and its confidence from 0 to 1."""
        n, k = len(x), len(self.names)
        if k == 1:
            return np.zeros(n, np.int64), np.ones(n)
        margins = x @ self.planes[:, :-1].T + self.planes[:, -1]
        wins, sums, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for j, (a, b) in enumerate(combinations(range(k), 2)):
            m = margins[:, j]
            for i, own in ((a, m), (b, -m)):
                wins[:, i] += own > 0
                sums[:, i] += own
                least[:, i] = np.minimum(least[:, i], own)
        best = np.argmax(wins + sums / (1 + np.abs(sums).max(axis=1, keepdims=True)) / 2, axis=1)
        return best, 1 / (1 + np.exp(-4 * least[np.arange(n), best]))


@dataclass
class LanguageModel:
    """``families`` chooses among family names, ``languages`` within each."""

    families: Voting | None
    languages: dict[str, Voting]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
        at = np.flatnonzero(has_letter(texts))
        if self.families is None or not len(at):
            return names.tolist(), scores
        x = ngram_features(texts.take(pa.array(at)))
        chosen, sure = self.families.predict(x)
        for i, family in enumerate(self.families.names):
            own = np.flatnonzero(chosen == i)
            if len(own):
                voting = self.languages[family]
                best, within = voting.predict(x[own])
                names[at[own]] = np.array(voting.names, dtype=object)[best]
                scores[at[own]] = sure[own] * within
        return names.tolist(), scores


def _features_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of whole texts, and of a short extract of each, as bytes."""
    worker_keeps("language")
    for batch in batches:
        for part in slices(batch, "text"):
            texts = texts_of(part)
            n = len(texts)
            for first in range(0, n, TEXTS_AT_ONCE):
                some = texts[first : first + TEXTS_AT_ONCE]
                lang = part.column("lang").slice(first, len(some))
                # extracts start at different places so that all of a text can occur
                shift = [len(t) * (7 * i % 11) // 11 for i, t in enumerate(some.to_pylist())]
                short = pa.array([t[s : s + EXTRACT_BYTES] for t, s in zip(some.to_pylist(), shift, strict=True)], pa.large_string())
                for version in (some.take(pa.array(range(len(some)))), short):
                    x = ngram_features(version)
                    yield pa.RecordBatch.from_arrays([lang, pa.array([row.astype(np.float16).tobytes() for row in x], pa.binary())], names=["lang", "x"])


def _machines(langs: list[str]) -> tuple[dict[str, list[str]], dict[str, list[tuple[str, bool]]]]:
    """Names to choose from by level (the families, then the languages of each), and for every language the machines
    (``level|a|b``) that learn from it, with its side."""
    families = sorted({FAMILY_OF.get(code, code) for code in langs})
    levels = {"": families} | {f: [code for code in langs if FAMILY_OF.get(code, code) == f] for f in families}
    of: dict[str, list[tuple[str, bool]]] = {code: [] for code in langs}
    for level, names in levels.items():
        for a, b in combinations(names, 2):
            for code in langs:
                name = code if level else FAMILY_OF.get(code, code)
                if name in (a, b):
                    of[code].append((f"{level}|{a}|{b}", name == a))
    return levels, of


def _fit_machine(key: tuple, rows: pa.Table) -> pa.Table:
    """The weights of one machine, from its rows in the order of their bytes."""
    worker_keeps("language")
    positive = rows.column("positive").to_numpy()
    order = pc.sort_indices(rows, sort_keys=[("positive", "descending"), ("x", "ascending")]).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    matrix = np.empty((len(order), BINS), np.float32)
    # row by row, so that nothing but the matrix is as large as the rows
    for at, x in zip(place.tolist(), rows.column("x"), strict=True):
        matrix[at] = np.frombuffer(x.as_buffer(), dtype=np.float16)
    plane = linear_svm(matrix, positive[order])
    return pa.table({"machine": pa.array([key[0].as_py()]), "plane": pa.array([plane.astype(np.float32).tobytes()], pa.binary())})


def fit_language_model(labelled: DataFrame, rows: int = TRAINING_ROWS) -> LanguageModel:
    """A model from ``labelled`` (``doc_id``, ``text``, ``lang``), on about ``rows`` rows, as many of each language.

    Every machine is fitted in a task of its own, on the rows of its two names; the
    driver gets their weights. Rows without language, id or letter are not learned from.
    """
    labelled = labelled.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").filter(F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return LanguageModel(None, {})
    share = rows / len(counts)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2**32)) / F.lit(float(2**32))
    wanted = F.coalesce(*(F.when((F.col("lang") == lang) & (draw < share / n), True) for lang, n in counts.items()), F.lit(False))
    chosen = labelled.filter(wanted).select("text", "lang")
    found = materialize(chosen.mapInArrow(_features_task, "lang string, x binary"), "language-training", batch_bytes=SLICE_BYTES)
    levels, of = _machines(sorted(r["lang"] for r in found.select("lang").distinct().collect()))
    sides = [(lang, machine, positive) for lang, machines in of.items() for machine, positive in machines]
    planes = {}
    if sides:
        taught = found.join(F.broadcast(found.sparkSession.createDataFrame(sides, "lang string, machine string, positive boolean")), "lang")
        fitted = taught.select("machine", "positive", "x").groupBy("machine").applyInArrow(_fit_machine, "machine string, plane binary")
        planes = {r["machine"]: np.frombuffer(r["plane"], dtype=np.float32) for r in fitted.collect()}
    votings = {
        level: Voting(names, np.array([planes[f"{level}|{a}|{b}"] for a, b in combinations(names, 2)], dtype=np.float32).reshape(-1, BINS + 1))
        for level, names in levels.items()
    }
    return LanguageModel(votings.pop("") if levels[""] else None, votings)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) from the whole ``text``; both replace columns of that name.

    ``und`` with score 0 where the text is null or has no letter, or where the
    model has learned no language.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("language")
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part)
                names, scores = [], []
                for first in range(0, len(texts), TEXTS_AT_ONCE):
                    some = texts[first : first + TEXTS_AT_ONCE]
                    found, sure = shared.value.predict(some.take(pa.array(range(len(some)))))
                    names += found
                    scores += sure.tolist()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"]
                )

    return docs.select(*kept).mapInArrow(run, schema)
