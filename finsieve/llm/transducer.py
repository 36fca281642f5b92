"""SentencePiece encoding and decoding as shortest paths through a transducer.

The model is compiled into a weighted transducer of three parts. The normaliser
rewrites a space into the visible space mark and puts one in front. The pieces
spell the normalised characters; each piece is an arc with a weight. A character
that no piece spells is an arc to its UTF-8 bytes' pieces. Composed with an input
this is a graph whose states are positions together with the piece that ended
there, and the encoding is its shortest path in the tropical semiring (weights add
along a path, the least path wins).

Weights: in a unigram model a piece weighs its negative score. In a byte-pair model
a segmentation is the merge result exactly if every two neighbouring pieces, taken
alone, merge into just these two; so an arc weighs nothing after a piece that it
can follow and infinity after any other, and one path of finite weight remains.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsieve.llm.batches import ragged, slices, texts_of

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Units whose ids a worker keeps, and pairs of pieces whose weight it keeps.
CACHED_UNITS, CACHED_PAIRS = 300_000, 1_000_000
#: Weight that a unigram model's byte arcs have on top of its worst piece.
FALLBACK_WEIGHT = 10.0


class Transducer:
    """The compiled model."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(MODEL)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.unknown = model.unk_id()
        self.bytes: dict[int, int] = {}
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.text: list[str | None] = [None] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.id[piece], self.score[piece], self.text[i] = i, model.get_score(i), piece
        if model.normalize("ﬁ ½  a") != f"{SPACE}ﬁ{SPACE}½ {SPACE}a":
            raise ValueError("only models whose normaliser keeps characters and marks spaces are supported")
        # scores of byte-pair models are merge ranks: whole numbers
        self.merges = all(float(s).is_integer() for s in self.score.values())
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # weights of pairs: piece -> next piece -> whether finite
        self._forget()
        self.units: dict[str, tuple[int, ...]] = {}
        worst = min(self.score.values(), default=0.0)
        self.fallback = 0.0 if self.merges else FALLBACK_WEIGHT - worst
        if self.merges:
            # a piece that merges cannot make is no arc
            spelled = {p for p in self.id if len(p) == 1 or self._merged(p) == [p]}
            self.id = {p: i for p, i in self.id.items() if p in spelled}
        self.longest = max(map(len, self.id), default=1)

    def _forget(self) -> None:
        self.pairs: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self.n_pairs = 0
        # the last unit, and at each of its positions the start and the piece of the arc into it and that piece's row of pairs
        self.last: tuple[str, list[int], list[str], list[dict[str, bool]]] = ("", [0], [""], [self.pairs[""]])

    def _merged(self, text: str) -> list[str]:
        """The merge result of a short text: always the best-scored neighbouring pair, the first among equals."""
        parts = list(text)
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, piece: str, after: str) -> bool:
        """Whether the arc of ``piece`` has a finite weight behind ``after``; no merge reaches over a character without piece."""
        if not after or piece not in self.id or after not in self.id:
            return True
        return self._merged(after + piece) == [after, piece]

    def shortest_path(self, unit: str) -> tuple[int, ...]:
        """Ids of the least path over ``unit``, a normalised text."""
        starts, pieces = self._by_pairs(unit) if self.merges else self._by_scores(unit)
        path: list[int] = []
        end = len(unit)
        while end:
            known = self.id.get(pieces[end])
            path += self._ids(pieces[end])[::-1] if known is None else (known,)
            end = starts[end]
        return tuple(path[::-1])

    def _by_pairs(self, unit: str) -> tuple[list[int], list[str]]:
        """Start and piece of the one arc of finite weight into every position.

        Positions of the beginning shared with the last unit are kept, so units in order take few steps.
        """
        if self.n_pairs >= CACHED_PAIRS:
            self._forget()
        last, starts, pieces, rows = self.last
        kept = len(commonprefix((last, unit)))
        del starts[kept + 1 :], pieces[kept + 1 :], rows[kept + 1 :]
        known, pairs, longest = self.id, self.pairs, self.longest
        for end in range(kept + 1, len(unit) + 1):
            for start in range(end - 1, max(-1, end - 1 - longest), -1):
                piece = unit[start:end]
                if piece not in known and end - start > 1:
                    continue
                row = rows[start]
                finite = row.get(piece)
                if finite is None:
                    finite = row[piece] = self.follows(piece, pieces[start])
                    self.n_pairs += 1
                if finite:
                    break
            starts.append(start)
            pieces.append(piece)
            rows.append(pairs[piece])
        self.last = unit, starts, pieces, rows
        return starts, pieces

    def _by_scores(self, unit: str) -> tuple[list[int], list[str]]:
        """Start and piece of the least arc into every position."""
        weights, starts, pieces = [0.0], [0], [""]
        for end in range(1, len(unit) + 1):
            arcs = []
            for start in range(max(0, end - self.longest), end):
                piece = unit[start:end]
                if piece in self.id:
                    arcs.append((weights[start] - self.score[piece], start, piece))
                elif end - start == 1:
                    arcs.append((weights[start] + self.fallback, start, piece))
            weight, start, piece = min(arcs)
            weights.append(weight)
            starts.append(start)
            pieces.append(piece)
        return starts, pieces

    def _ids(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        raw = piece.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if len(self.bytes) == 256 else [self.unknown]

    def unit_ids(self, unit: str) -> tuple[int, ...]:
        found = self.units.get(unit)
        if found is None:
            if len(self.units) >= CACHED_UNITS:
                self.units = {}
            found = self.units[unit] = self.shortest_path(unit)
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        normal = SPACE + text.replace(" ", SPACE)
        return [i for unit in units(normal) for i in self.unit_ids(unit)]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD, control pieces nothing."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_text_of(bytes(run)))
                run.clear()
            out.append(self.text[i] or (" ⁇ " if i == self.unknown else ""))
        if run:
            out.append(_text_of(bytes(run)))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _text_of(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def units(normal: str) -> list[str]:
    """Parts of a normalised text that no piece reaches beyond: a piece has space marks at its start only, or nothing else."""
    return _UNIT.findall(normal)


_transducers: dict[str | None, Transducer] = {}


def compiled(path: str | None = None) -> Transducer:
    """The transducer of a model, compiled once in each worker."""
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def encode_texts(texts: pa.Array, path: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of each."""
    t = compiled(path)
    lists = pc.split_pattern(texts, " ")
    words, counts = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.dictionary_encode()
    # several spaces in a row, or space marks of the text's own, are units that words alone don't show
    unlike = pc.or_(pc.equal(coded.dictionary, ""), pc.match_substring(coded.dictionary, SPACE)).to_numpy(zero_copy_only=False)
    # in order, as words that begin alike share their steps
    order = pc.sort_indices(coded.dictionary)
    per_word = [t.unit_ids(SPACE + w) if w else () for w in coded.dictionary.take(order).to_pylist()]
    lengths = np.fromiter(map(len, per_word), np.int64, len(per_word))
    flat = np.fromiter(chain.from_iterable(per_word), np.int64, int(lengths.sum()))
    place = np.empty(len(per_word), np.int64)
    place[order.to_numpy()] = np.arange(len(per_word))
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    codes = place[at]
    odd = np.unique(np.repeat(np.arange(len(texts)), counts)[unlike[at]])
    own = lengths[codes]
    ids = flat[ragged((np.cumsum(lengths) - lengths)[codes], own)]
    sizes = np.bincount(np.repeat(np.arange(len(texts)), counts), weights=own, minlength=len(texts)).astype(np.int64)
    if not len(odd):
        return ids, sizes
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    for i in odd:
        parts[i] = np.array(t.encode(texts[int(i)].as_py()), dtype=np.int64)
    return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs`` (``doc_id``, ``text``); a null or empty text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                ids, sizes = encode_texts(texts_of(part), model_path)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, text`` of every row of ``encoded`` (``doc_id``, ``ids``); null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model_path)
        for batch in batches:
            texts = [t.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id, n_ids, ids_crc32`` (little-endian unsigned 32-bit ids) and ``text_sha256`` of the text decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                ids, sizes = encode_texts(texts_of(part), model_path)
                t = compiled(model_path)
                pieces = np.split(ids, np.cumsum(sizes)[:-1])
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in pieces]
                texts = [t.decode(x.tolist()) for x in pieces]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(texts, pa.string())],
                    names=["doc_id", "n_ids", "ids_crc32", "text"],
                )

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text string")
    return found.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))
