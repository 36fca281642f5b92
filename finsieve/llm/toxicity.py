"""Toxicity of texts: a bidirectional GRU with attention pooling over windows.

A token enters as two vectors, one looked up by the whole word and one summed over
its character n-grams. A window of tokens runs through a gated recurrent unit in
both directions, attention pools the states, and a logistic output scores the
window. A text scores as its highest window; windows overlap by half and cover
every token. Everything is plain numpy, trained on a bounded sample of labelled
rows; only the word vectors' tables and the small matrices go to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.llm.batches import flat_words, slices, texts_of
from finsieve.session import materialize

#: Tokens of a window and of its step to the next.
WINDOW, STEP = 32, 16
#: Sizes: word and n-gram tables, their vectors, the state of one direction.
WORD_ROWS, CHAR_ROWS, WIDTH, STATE = 2**14, 2**15, 8, 8
CHAR_LENGTHS = (3, 4, 5)
#: A longer run without white space is several tokens.
TOKEN_CHARS = 64
#: Labelled rows of each class that the model is fitted on, in expectation; rows are chosen by their hash.
TRAINING_ROWS = 3_000
#: Times that the highest windows of the sample's other texts are learned as such, and the decay of the tables.
MINING_ROUNDS, DECAY = 2, 0.05
WORDS_AT_ONCE, WINDOWS_AT_ONCE = 16_384, 4_096
PUNCTUATION = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»“”„‘’…–—¿¡"


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words; the word of every token; the number of tokens of every text."""
    lower = pc.utf8_lower(texts)
    found, rows = flat_words(lower)
    if len(found) and pc.max(pc.utf8_length(found)).as_py() > TOKEN_CHARS:
        found, rows = flat_words(pc.replace_substring_regex(lower, rf"(\S{{{TOKEN_CHARS}}})", r"\1 "))
    coded = found.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.utf8_trim(coded.dictionary, PUNCTUATION), codes, np.bincount(rows, minlength=len(texts))


@dataclass
class Words:
    """Table rows of distinct words: one word row each, and n-gram rows ``chars`` with the word each belongs to."""

    word: np.ndarray
    chars: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, words: pa.Array) -> Words:
        raw = words.cast(pa.large_binary()).to_pylist()
        word = np.array([xxhash.xxh32_intdigest(w) % WORD_ROWS for w in raw], dtype=np.int64)
        lengths = np.array([len(w) for w in raw], dtype=np.int64) + 2
        # each word between marks, so that n-grams know its start and end
        flat = np.frombuffer(b"\x02" + b"\x03\x02".join(raw) + b"\x03", dtype=np.uint8).astype(np.uint32) if raw else np.empty(0, np.uint32)
        owner = np.repeat(np.arange(len(raw)), lengths)
        chars, owners = [], []
        rolled = flat.copy()
        for n in range(2, max(CHAR_LENGTHS) + 1):
            if len(flat) < n:
                break
            rolled = rolled[:-1] * np.uint32(0x01000193) ^ (flat[n - 1 :] * np.uint32(0x9E3779B1))
            if n in CHAR_LENGTHS:
                inside = owner[: len(rolled)] == owner[n - 1 :]
                mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                chars.append((mixed >> np.uint32(17)).astype(np.int64)[inside])
                owners.append(owner[: len(rolled)][inside])
        if not chars:
            return cls(word, np.empty(0, np.int64), np.empty(0, np.int64))
        chars, owners = np.concatenate(chars), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return cls(word, chars[order], owners[order])

    def scale(self) -> np.ndarray:
        """Per word, the factor of its summed n-gram vectors."""
        return 1 / np.sqrt(np.maximum(1, np.bincount(self.owner, minlength=len(self.word)))).astype(np.float32)[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The parameters, the score of windows, and its gradient."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def draw(*shape: int, size: float) -> np.ndarray:
            return (rng.standard_normal(shape) * size).astype(np.float32)

        self.p = {
            "words": draw(WORD_ROWS, WIDTH, size=0.1),
            "chars": draw(CHAR_ROWS, WIDTH, size=0.1),
            "into": draw(2 * WIDTH, 6 * STATE, size=0.3),
            "bias": np.zeros(6 * STATE, np.float32),
            "ahead": draw(STATE, 3 * STATE, size=0.3),
            "back": draw(STATE, 3 * STATE, size=0.3),
            "attend": draw(2 * STATE, size=0.3),
            "out": draw(2 * STATE, size=0.3),
            "base": np.zeros(1, np.float32),
        }

    def inputs(self, w: Words) -> np.ndarray:
        """The vector of every distinct word."""
        sums = np.zeros((len(w.word), WIDTH), np.float32)
        if len(w.chars):
            starts = np.flatnonzero(np.diff(w.owner, prepend=-1))
            sums[w.owner[starts]] = np.add.reduceat(self.p["chars"][w.chars], starts, axis=0)
        return np.concatenate([self.p["words"][w.word], sums * w.scale()], axis=1)

    def gates(self, x: np.ndarray) -> np.ndarray:
        return x @ self.p["into"] + self.p["bias"]

    @staticmethod
    def _run(gates: np.ndarray, idx: np.ndarray, u: np.ndarray, times: list[int], keep: list | None) -> np.ndarray:
        states = np.empty((len(times), len(idx), STATE), np.float32)
        h = np.zeros((len(idx), STATE), np.float32)
        for t in times:
            g = gates[idx[:, t]]
            a = h @ u
            rz = _sigmoid(g[:, : 2 * STATE] + a[:, : 2 * STATE])
            r, z = rz[:, :STATE], rz[:, STATE:]
            n = np.tanh(g[:, 2 * STATE :] + r * a[:, 2 * STATE :])
            if keep is not None:
                keep.append((t, h, r, z, n, a[:, 2 * STATE :]))
            h = n + z * (h - n)
            states[t] = h
        return states

    def score(self, gates: np.ndarray, idx: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logits of windows; ``idx`` has the word of every place."""
        times = list(range(idx.shape[1]))
        ahead, back = ([], []) if tape is not None else (None, None)
        states = np.concatenate(
            [
                self._run(gates[:, : 3 * STATE], idx, self.p["ahead"], times, ahead),
                self._run(gates[:, 3 * STATE :], idx, self.p["back"], times[::-1], back),
            ],
            axis=2,
        )
        weight = states @ self.p["attend"]
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        if tape is not None:
            tape.update(states=states, weight=weight, pooled=pooled, ahead=ahead, back=back)
        return pooled @ self.p["out"] + self.p["base"][0]

    def gradient(self, w: Words, idx: np.ndarray, target: np.ndarray, rare: float = 1.0) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradient; a window of target 1 weighs ``rare`` in the gradient."""
        p, tape = self.p, {}
        x = self.inputs(w)
        logit = self.score(self.gates(x), idx, tape)
        error = ((_sigmoid(logit) - target) * np.where(target == 1, rare, 1.0) / len(target)).astype(np.float32)
        loss = float(np.mean(np.logaddexp(0, logit) - target * logit))
        states, weight = tape["states"], tape["weight"]
        d = {"out": tape["pooled"].T @ error, "base": np.array([error.sum()], np.float32)}
        to_pooled = error[:, None] * p["out"]
        to_weight = (states * to_pooled).sum(axis=2)
        to_attend = weight * (to_weight - (weight * to_weight).sum(axis=0))
        d["attend"] = np.einsum("tn,tnk->k", to_attend, states)
        to_states = weight[:, :, None] * to_pooled + to_attend[:, :, None] * p["attend"]
        to_gates = np.zeros((len(w.word), 6 * STATE), np.float32)
        for name, first in (("ahead", 0), ("back", 1)):
            u, du = p[name], np.zeros_like(p[name])
            dh = np.zeros((len(idx), STATE), np.float32)
            for t, h, r, z, n, an in reversed(tape[name]):
                dh = dh + to_states[t, :, first * STATE : (first + 1) * STATE]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                da = np.concatenate([dr, dz, dn * r], axis=1)
                du += h.T @ da
                np.add.at(to_gates[:, first * 3 * STATE : (first + 1) * 3 * STATE], idx[:, t], np.concatenate([dr, dz, dn], axis=1))
                dh = dh * z + da @ u.T
            d[name] = du
        d["into"], d["bias"] = x.T @ to_gates, to_gates.sum(axis=0)
        dx = to_gates @ p["into"].T
        d["words"] = np.zeros_like(p["words"])
        np.add.at(d["words"], w.word, dx[:, :WIDTH])
        d["chars"] = np.zeros_like(p["chars"])
        np.add.at(d["chars"], w.chars, (dx[:, WIDTH:] * w.scale())[w.owner])
        return loss, d

    def fit(self, windows: list[list[str]], labels: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.01, seed: int = 7) -> None:
        """Adam over windows, in groups of equal length."""
        rng = np.random.default_rng(seed)
        rare = float(np.sqrt(max(1.0, (labels == 0).sum() / max(1, labels.sum()))))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        lengths = np.array([len(x) for x in windows])
        step = 0
        for _ in range(epochs):
            batches = []
            for n in np.unique(lengths):
                own = rng.permutation(np.flatnonzero(lengths == n))
                batches += [own[i : i + batch] for i in range(0, len(own), batch)]
            for j in rng.permutation(len(batches)):
                own = batches[j]
                coded = pa.array([w for i in own for w in windows[i]], pa.large_string()).dictionary_encode()
                idx = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(own), -1)
                _, d = self.gradient(Words.of(coded.dictionary), idx, labels[own].astype(np.float32), rare)
                step += 1
                for k, g in d.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    scale = rate / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
                    keep = 1 - rate * DECAY if k in ("words", "chars") else 1
                    self.p[k] = (keep * self.p[k] - scale * m[k]).astype(np.float32)


def window_starts(n: int) -> range | list[int]:
    """First tokens of the windows over ``n`` tokens; the last window ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STEP), n - WINDOW]


def _windows(counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Window length, text and first token of all windows, by length."""
    ends = np.cumsum(counts)
    full = np.flatnonzero(counts >= WINDOW)
    if len(full):
        starts = [np.array(window_starts(int(counts[i]))) + ends[i] - counts[i] for i in full]
        yield WINDOW, np.repeat(full, [len(s) for s in starts]), np.concatenate(starts)
    for n in np.unique(counts[(counts > 0) & (counts < WINDOW)]):
        own = np.flatnonzero(counts == n)
        yield int(n), own, ends[own] - n


def score_texts(net: Network, texts: pa.Array) -> np.ndarray:
    """The highest window score of every text, 0 to 1; 0 for a text without tokens."""
    words, codes, counts = tokens(texts)
    return _highest(net, words, codes, counts)[0]


def _highest(net: Network, words: pa.Array, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest window score of every text and the first token of that window (-1: no window)."""
    best, first = np.full(len(counts), -np.inf), np.full(len(counts), -1)
    if len(words):
        gates = np.concatenate([net.gates(net.inputs(Words.of(words[i : i + WORDS_AT_ONCE]))) for i in range(0, len(words), WORDS_AT_ONCE)])
    for n, owner, start in _windows(counts):
        for i in range(0, len(owner), WINDOWS_AT_ONCE):
            idx = codes[start[i : i + WINDOWS_AT_ONCE, None] + np.arange(n)]
            own, logit = owner[i : i + WINDOWS_AT_ONCE], net.score(gates, idx)
            np.maximum.at(best, own, logit)
            top = logit >= best[own]
            first[own[top]] = start[i : i + WINDOWS_AT_ONCE][top]
    return np.where(np.isfinite(best), _sigmoid(best), 0.0), first


def _evidence(words: pa.Array, log_odds: np.ndarray) -> np.ndarray:
    """The strongest n-gram of every word."""
    w = Words.of(words)
    out = np.zeros(len(w.word), np.float32)
    np.maximum.at(out, w.owner, log_odds[w.chars])
    return out


def _presence_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts of a slice each n-gram row occurs."""
    for batch in batches:
        for part in slices(batch, "text"):
            words, codes, counts = tokens(texts_of(part))
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            w = Words.of(words)
            first = np.searchsorted(w.owner, np.arange(len(words) + 1))
            seen = np.zeros((CHAR_ROWS, 2), np.int64)
            ends = np.cumsum(counts)
            for i, n in enumerate(counts.tolist()):
                own = np.unique(codes[ends[i] - n : ends[i]])
                rows = np.unique(np.concatenate([np.empty(0, np.int64), *(w.chars[first[c] : first[c + 1]] for c in own)]))
                seen[rows, toxic[i]] += 1
            at = np.flatnonzero(seen.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at, 0]), pa.array(seen[at, 1])], names=["row", "other", "toxic"])


def _window_task(log_odds: np.ndarray):
    """Of toxic texts the two windows with most evidence; of others the one with most, and one by the text's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, codes, counts = tokens(texts_of(part))
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                strength = np.maximum(0, _evidence(words, log_odds) - 1)
                names = words.to_pylist()
                ends = np.cumsum(counts)
                found, labels = [], []
                for i, n in enumerate(counts.tolist()):
                    own = codes[ends[i] - n : ends[i]]
                    starts = window_starts(n)
                    sums = np.concatenate([[0], np.cumsum(strength[own])])
                    value = np.array([sums[min(n, s + WINDOW)] - sums[s] for s in starts])
                    order = np.argsort(-value, kind="stable")
                    picked = {int(order[0])}
                    if toxic[i]:
                        picked |= {int(j) for j in order[1:2] if value[j] > 0.5 * value[order[0]]}
                    else:
                        picked.add((n * 7919) % len(starts))
                    for j in sorted(picked) if n else ():
                        found.append(" ".join(names[c] or "." for c in own[starts[j] : starts[j] + WINDOW]))
                        labels.append(int(toxic[i]))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(labels, pa.int32())], names=["window", "toxic"])

    return run


def _mining_task(net: Network):
    """The highest window of every text that is not toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, codes, counts = tokens(texts_of(part))
                names = words.to_pylist()
                _, first = _highest(net, words, codes, counts)
                size = np.minimum(counts, WINDOW)
                found = [" ".join(names[c] or "." for c in codes[a : a + n]) for a, n in zip(first.tolist(), size.tolist(), strict=True) if a >= 0]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["window"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Network:
    """A network from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic``), on about ``rows`` rows of each class.

    An id labelled both ways is toxic; rows without label, id or text are not
    learned from. The windows that a label is taken to stand for are chosen by how
    unevenly the n-grams of their words are spread over the two classes; afterwards
    the windows of other texts that score highest are learned too. Without rows the
    network is as drawn.
    """
    labels = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    net = Network()
    if not counts:
        return net
    draw = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2**32)) / F.lit(float(2**32))
    share = F.coalesce(*(F.when(F.col("toxic") == label, F.lit(rows / n)) for label, n in counts.items()))
    # about 2 x rows ids, whatever the number of labels
    drawn = F.broadcast(materialize(labels.filter(draw < share), "toxicity-labels"))
    sample = materialize(docs.filter("text IS NOT NULL").join(drawn, "doc_id").select("text", "toxic"), "toxicity-training")
    seen = sample.mapInArrow(_presence_task, "row long, other long, toxic long").groupBy("row").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()
    presence = np.zeros((CHAR_ROWS, 2))
    presence[seen["row"].to_numpy()] = np.stack([seen["other"].to_numpy(), seen["toxic"].to_numpy()], axis=1)
    n = np.array([max(1, min(rows, counts.get(0, 0))), max(1, min(rows, counts.get(1, 0)))])
    log_odds = (np.log((presence[:, 1] + 1) / n[1]) - np.log((presence[:, 0] + 1) / n[0])).astype(np.float32)
    found = sample.mapInArrow(_window_task(log_odds), "window string, toxic int").orderBy("window", "toxic").toArrow()
    windows = [w.split(" ") for w in found["window"].to_pylist()]
    labels = found["toxic"].to_numpy()
    net.fit(windows, labels)
    for _ in range(MINING_ROUNDS):
        mined = sample.filter("toxic = 0").mapInArrow(_mining_task(net), "window string").orderBy("window").toArrow()
        windows += [w.split(" ") for w in mined["window"].to_pylist()]
        labels = np.concatenate([labels, np.zeros(mined.num_rows, labels.dtype)])
        net.fit(windows, labels, epochs=3)
    return net


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` (with ``doc_id``, ``text``) as ``doc_id`` and ``score``, 0 to 1, over all windows of the whole text.

    A null text, or one without a token, scores 0. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                score = score_texts(shared.value, texts_of(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
