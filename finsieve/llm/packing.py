"""Documents packed into token sequences by length patterns.

A document is its token ids and an end id, cut into pieces only where it is longer
than a sequence. Packing sees the histogram of piece lengths alone, which has as
many bins as a sequence has tokens, however many documents there are:

1. patterns of up to three pieces that fill a sequence are enumerated over bins of
   lengths, and their repeat counts are fitted to the histogram by non-negative
   least squares and rounded down;
2. each pattern is carried out with real lengths that fill a sequence to the last token;
3. the residual pieces, longest first, go to the fullest sequences they fit in,
   whole groups of equal sequences at a time.

The plan says which ranks of each length go to which sequences; pieces find their
place by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement, product, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finsieve.llm.batches import SLICE_BYTES, flat_words, ragged, slices, texts_of, worker_keeps
from finsieve.session import materialize

TOKENIZER = "word_bpe_49k.json"
MAX_TOKENS = 2048
END_ID = 0
#: Bins of lengths that patterns are made of, and pieces in a pattern.
BINS, PATTERN_PIECES = 64, 3
#: Ranks within a length are counted in so many parts, so that no length is one task.
RANK_PARTS = 64
#: Words whose ids a worker keeps.
CACHED_WORDS = 500_000
#: Bytes of text encoded at once: the arrays made of it are many times as large.
TEXT_AT_ONCE = 2_000_000


class WordEncoder:
    """Token ids of words, each distinct word encoded once while it is kept.

    The tokenizer drops white space and joins nothing across it, so a text's ids
    are its words' ids one after another.
    """

    #: Words whose characters keep their number and class when composed and put in lower case,
    #: and the parts that the tokenizer then cuts them into.
    PLAIN = r"^[\x21-\x7EÀ-ÖØ-öø-ÿ]+$"
    PARTS = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    #: Words joined into one text for the tokenizer, which takes longer a word for long texts.
    TOGETHER = 500

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lengths, and ids one after another, of distinct words."""
        plain = pc.and_(pc.match_substring_regex(words, self.PLAIN), pc.invert(pc.match_substring(words, "<|")))
        plain = plain.to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(words), np.int64)
        at_plain, at_other = np.flatnonzero(plain), np.flatnonzero(~plain)
        own = words.take(pa.array(at_plain))
        texts = own.to_pylist()
        joined = [" ".join(texts[i : i + self.TOGETHER]) for i in range(0, len(texts), self.TOGETHER)]
        # the tokenizer's results are far larger than the ids taken from them
        some = (self.tokenizer.encode_batch_fast(joined[i : i + 10], add_special_tokens=False) for i in range(0, len(joined), 10))
        ids = np.concatenate([np.empty(0, np.uint32), *(np.array(e.ids, dtype=np.uint32) for found in some for e in found)])
        # a word ends with the last of its parts
        parts = pc.count_substring_regex(own, self.PARTS).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != parts.sum():
            raise ValueError("the tokenizer cuts words in another way than WordEncoder expects")
        last = ends[np.cumsum(parts) - 1] + 1 if len(parts) else np.empty(0, np.int64)
        lengths[at_plain] = np.diff(last, prepend=0)
        rest = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(words.take(pa.array(at_other)).to_pylist(), add_special_tokens=False)]
        lengths[at_other] = [len(x) for x in rest]
        flat = np.empty(int(lengths.sum()), np.uint32)
        starts = np.cumsum(lengths) - lengths
        flat[ragged(starts[at_plain], lengths[at_plain])] = ids
        if rest:
            flat[ragged(starts[at_other], lengths[at_other])] = np.concatenate(rest)
        return lengths, flat

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each distinct word's ids, and the ids they lie in."""
        texts = words.to_pylist()
        if len(self.known) + len(texts) > CACHED_WORDS:
            self._forget()
        at = np.fromiter(map(self.known.get, texts, repeat(-1)), np.int64, len(texts))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            lengths, flat = self._encode(words.take(pa.array(missing)))
            first = len(self.lengths)
            at[missing] = np.arange(first, first + len(missing))
            self.known.update(zip(map(texts.__getitem__, missing.tolist()), range(first, first + len(missing)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat])
        return self.starts[at], self.lengths[at], self.flat


def token_ids(texts: pa.Array, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, each with its end id; and the length of each."""
    encoder = worker_keeps(f"words of {path}", lambda: WordEncoder(path))
    words, rows = flat_words(texts)
    coded = words.dictionary_encode()
    starts, lengths, flat = encoder.encode(coded.dictionary)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = lengths[codes]
    ids = flat[ragged(starts[codes], own)]
    per_text = np.bincount(rows, weights=own, minlength=len(texts)).astype(np.int64)
    return np.insert(ids, np.cumsum(per_text), END_ID), per_text + 1


def _piece_task(path: str | None, max_tokens: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_AT_ONCE):
                ids, sizes = token_ids(texts_of(part), path)
                ends = np.cumsum(sizes)
                counts = -(-sizes // max_tokens)
                doc = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * max_tokens
                length = np.minimum(max_tokens, sizes[doc] - start)
                at = (ends - sizes)[doc] + start
                little = ids.astype("<u4")
                crc = [zlib.crc32(little[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([little[a : a + n].astype(np.int32) for a, n in zip(at.tolist(), length.tolist(), strict=True)], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(docs: DataFrame, tokenizer_path: str | None = None, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every piece of every row."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_piece_task(tokenizer_path, max_tokens, with_ids), schema)


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, np.abs(b).max(initial=0)) * a.shape[0]
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= tolerance:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            solved = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0
                x[at] = solved
                break
            # go as far towards the solution as no count turns negative, and give up what reached zero
            down = solved <= 0
            step = np.min(x[at][down] / np.maximum(x[at][down] - solved[down], 1e-300))
            x[at] += step * (solved - x[at])
            x[at[down & (x[at] <= 1e-12)]] = 0
            free &= x > 0
            if not free.any():
                break
    return x


def fitted_patterns(counts: np.ndarray, max_tokens: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of bins with their repeat counts, for ``counts`` by length."""
    width = -(-max_tokens // BINS)
    total = -(-max_tokens // width)
    in_bin = np.zeros(total + 1)
    np.add.at(in_bin, -(-np.arange(len(counts)) // width), counts)
    used = [b for b in range(1, total + 1) if in_bin[b]]
    # lengths lie half a bin below the edge on average, so one bin more still fills a sequence
    patterns = [p for n in range(1, PATTERN_PIECES + 1) for p in combinations_with_replacement(used, n) if total <= sum(p) <= total + (n > 1)]
    if not patterns:
        return []
    a = np.zeros((total + 1, len(patterns)))
    for j, p in enumerate(patterns):
        for b in p:
            a[b, j] += 1
    x = np.floor(nonnegative_least_squares(a, in_bin) + 1e-6).astype(np.int64)
    return sorted(((patterns[j], int(x[j])) for j in np.flatnonzero(x)), key=lambda found: -found[1])


def packing_plan(counts: np.ndarray, max_tokens: int = MAX_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths of their pieces, how many such sequences) for ``counts[length]``.

    Every counted piece is placed exactly once; each step works on all pieces or
    sequences of a kind, so the work depends on the number of lengths only.
    """
    left = counts.astype(np.int64).copy()
    width = -(-max_tokens // BINS)
    plan: dict[tuple[int, ...], int] = defaultdict(int)

    for pattern, repeat in fitted_patterns(left, max_tokens):
        *free, last = sorted(pattern, reverse=True)
        for chosen in product(*(range(min(b * width, max_tokens), (b - 1) * width, -1) for b in free)):
            # the last piece fits best where it fills the sequence; short of that the residual serves better
            n = max_tokens - sum(chosen)
            if not (last - 1) * width < n <= last * width:
                continue
            taken = (*chosen, n)
            times = min([repeat, *(int(left[m]) // taken.count(m) for m in set(taken))])
            if times:
                left[list(set(taken))] -= [times * taken.count(m) for m in set(taken)]
                plan[taken] += times
                repeat -= times
            if not repeat:
                break

    gaps: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for lengths, times in plan.items():
        gaps[max_tokens - sum(lengths)][lengths] = times
    sizes = sorted(gaps)

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = max_tokens - sum(lengths)
        if gap not in gaps or not gaps[gap]:
            bisect.insort(sizes, gap)
        gaps[gap][lengths] = gaps[gap].get(lengths, 0) + times

    for n in range(len(left) - 1, 0, -1):
        while left[n]:
            i = bisect.bisect_left(sizes, n)
            if i == len(sizes):
                fit = max_tokens // n
                full, rest = divmod(int(left[n]), fit)
                if full:
                    put((n,) * fit, full)
                if rest:
                    put((n,) * rest, 1)
                left[n] = 0
                break
            gap = sizes[i]
            lengths, times = gaps[gap].popitem()
            if not gaps[gap]:
                sizes.pop(i)
            fit = gap // n
            whole, rest = divmod(int(left[n]), fit)
            full = min(times, whole)
            if full:
                put(lengths + (n,) * fit, full)
                left[n] -= full * fit
            if times > full:
                rest = rest if full == whole else 0
                if rest:
                    put(lengths + (n,) * rest, 1)
                    left[n] -= rest
                if times - full - bool(rest):
                    put(lengths, times - full - bool(rest))
    return sorted((lengths, times) for group in gaps.values() for lengths, times in group.items())


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, end rank, first sequence, offset) of every place of the plan; the number of sequences."""
    used: dict[int, int] = defaultdict(int)
    out, first = [], 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            out.append((n, used[n], used[n] + times, first, offset))
            used[n] += times
            offset += n
        first += times
    return out, first


def pack(cut: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``sequence_id`` and ``offset`` for the rows of ``cut`` (``doc_id, piece, start, length`` and more).

    Offsets are gapless from 0 in every sequence. A full piece is a sequence of
    its own. Equal rows get places of their own; ids may be null; an empty table
    gives no rows. Lengths must lie between 1 and ``max_tokens``.
    """
    spark = cut.sparkSession
    stored = materialize(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces", batch_bytes=SLICE_BYTES)
    part = F.pmod(F.xxhash64("_row"), F.lit(RANK_PARTS)).cast("int")
    partial = stored.filter(F.col("length") < max_tokens).withColumn("_part", part)
    # at most max_tokens x RANK_PARTS rows
    counted = materialize(partial.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")), "piece-lengths")
    histogram = np.zeros(max_tokens + 1, dtype=np.int64)
    for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    slots, n_sequences = _slots(packing_plan(histogram, max_tokens))
    places = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "length long, first_rank long, end_rank long, first_sequence long, offset long")

    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "_row")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = (
        partial.withColumn("_rank", F.row_number().over(within) - 1)
        .join(F.broadcast(bases), ["length", "_part"])  # bounded by lengths x parts
        .withColumn("_rank", F.col("_rank") + F.col("base"))
        .drop("base", "_part")
    )
    placed = (
        ranked.join(F.broadcast(places), "length")  # bounded by the lengths, see packing_plan
        .filter((F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("end_rank")))
        .withColumn("sequence_id", F.col("first_sequence") + F.col("_rank") - F.col("first_rank"))
    )
    full = stored.filter(F.col("length") == max_tokens)
    full = full.withColumns({"sequence_id": F.lit(n_sequences) + F.col("_row"), "offset": F.lit(0).cast("long")})
    columns = [*cut.columns, "sequence_id", "offset"]
    return full.select(*columns).unionByName(placed.select(*columns))


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Every piece of every row of ``docs`` (``doc_id``, ``text``) with its place.

    A null text is empty and gives one piece, the end id; other columns are
    ignored. ``with_ids`` carries the token ids themselves.
    """
    return pack(pieces(docs, tokenizer_path, max_tokens, with_ids), max_tokens)
