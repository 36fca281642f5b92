"""Copies, near copies, packing, tokens, search: small cases and brute force."""

import os
import random
import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from finsieve.llm import batches, exact_dedup, jaccard_join, language_id, packing, topk, transducer
from finsieve.llm.batches import SLICE_BYTES, slices, texts_of
from finsieve.llm.components import components
from finsieve.llm.queries import QUERIES
from finsieve.session import materialize, shared_dir

DOCS = "doc_id long, text string, size long, keep_id string"


def _strip(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def _dedup_by_hand(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[_strip(text)].append((-len(text or ""), doc is None, doc or 0, doc))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda text: F.substring(F.sha2(text, 256), 1, 1)], ids=["sha256", "colliding"])
def test_dedup(spark, digest):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ab \n", k=rng.randint(0, 5)))) for i in range(150)]
    rows += [(7, rows[7][1]), (None, "a b"), (None, None), (500, None), (501, ""), (502, "a b"), (503, "z" * 100_000), (504, "z" * 50_000 + " " + "z" * 50_000)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS).repartition(3)
    found = exact_dedup.exact_dedup(docs, digest, files_per_batch=1)
    got = found.decisions.collect()
    expected = _dedup_by_hand(rows)
    text_of = {d: t for d, t in rows if d is not None}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["keep_id"], r["group_size"]) == expected[_strip(text_of[r["doc_id"]])]
    assert sum(r["kept"] for r in got) == len(expected)
    kept = found.kept_documents()
    assert kept.columns == docs.columns and sorted(_strip(r["text"]) for r in kept.collect()) == sorted(expected)


def test_dedup_of_nothing(spark):
    found = exact_dedup.exact_dedup(spark.createDataFrame([], DOCS))
    assert found.decisions.count() == 0 and found.kept_documents().count() == 0


def _shingles(text, n):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def _linked_by_hand(rows, similarity):
    sets = [_shingles(t, similarity.words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= similarity.percent * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return [(doc, len(s), least[find(i)] if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("similarity", [jaccard_join.Similarity(4, 85), jaccard_join.Similarity(5, 80), jaccard_join.Similarity(2, 50)])
def test_jaccard_join(spark, similarity):
    rng = random.Random(similarity.percent)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = rng.choices(vocabulary, k=30)
    rows = []
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.randint(3, 60))
        if base % 3 == 0:
            words += passage
        for _ in range(rng.randint(1, 9)):
            edited = [rng.choice(vocabulary) if rng.random() < 0.02 else w for w in words]
            rows.append((len(rows), "  ".join(w.upper() if rng.random() < 0.1 else w for w in edited)))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "ONE\ttwo"), (904, "ONE\ttwo"), (905, "x " * 20_000), (906, "x " * 20_000 + "y")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], DOCS).withColumnRenamed("keep_id", "key").repartition(4)
    got = [tuple(r) for r in jaccard_join.linked_documents(docs, similarity).collect()]
    assert sorted(got) == sorted(_linked_by_hand(rows, similarity))


def test_jaccard_one_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (2, text + " more"), (None, text), (5, None), (6, None), (7, "other words altogether are here"), (2, text + " more")]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], DOCS)
    got = jaccard_join.one_of_each_group(docs, jaccard_join.Similarity(5, 80))
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [2, 5, 6, 7]
    assert jaccard_join.one_of_each_group(docs.limit(0), jaccard_join.Similarity()).count() == 0
    assert jaccard_join.linked_documents(docs.limit(0), jaccard_join.Similarity()).count() == 0


def test_prefix_length():
    s = jaccard_join.Similarity(4, 85)
    assert [s.prefix(n) for n in (1, 2, 6, 7, 20, 100)] == [1, 2, 3, 4, 6, 18]


def test_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
        sets = [np.unique(rng.choice(pool, rng.integers(1, 300), replace=False)) for _ in range(2)] + [np.empty(0, np.uint64)]
        rows = np.repeat(np.arange(3), [len(s) for s in sets])
        a, b, none = jaccard_join.parities(np.concatenate(sets), rows, 3)
        apart = sum(int(x ^ y).bit_count() for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist(), strict=True))
        differ = len(np.setxor1d(sets[0], sets[1]))
        assert apart <= differ and apart % 2 == differ % 2 and not none.any()


def test_jaccard_chain_of_near_copies(spark):
    """Neighbours link, distant ones do not: leaders find few of the links, the last step has to find the rest."""
    words = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        words[i] = f"other{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"x{j}" for j in range(i, i + 40))) for i in range(30)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], DOCS).repartition(7)
    similarity = jaccard_join.Similarity(5, 80)
    got = [tuple(r) for r in jaccard_join.linked_documents(docs, similarity).collect()]
    assert sorted(got) == sorted(_linked_by_hand(rows, similarity)) and len({r[2] for r in got}) == 2


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == got[101] == 100 and 200 not in got


def test_plan_places_every_piece():
    rng = np.random.default_rng(3)
    for draw in (rng.integers(1, 64, 500), np.full(300, 33), np.array([63, 1]), rng.integers(30, 40, 200), np.empty(0, int)):
        counts = np.bincount(draw, minlength=65)
        plan = packing.packing_plan(counts, 64)
        placed = np.zeros(65, int)
        for lengths, times in plan:
            assert times > 0 and sum(lengths) <= 64
            for n in lengths:
                placed[n] += times
        assert (placed == counts).all()
    many = np.bincount(rng.integers(1, 2048, 20_000), minlength=2049)
    sequences = sum(t for _, t in packing.packing_plan(many))
    assert sequences <= 1.01 * max((many * np.arange(2049)).sum() / 2048, many[1025:].sum())


def test_least_squares():
    rng = np.random.default_rng(4)
    a = rng.random((12, 8))
    x = packing.nonnegative_least_squares(a, b := rng.standard_normal(12))
    assert (x >= 0).all()
    gradient = a.T @ (b - a @ x)
    assert gradient.max() < 1e-6 and np.abs(gradient[x > 0]).max(initial=0) < 1e-6


def test_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(public.path(packing.TOKENIZER))
    rng = random.Random(6)
    parts = ["the", "It's", "don'T", "Über", "ß", "İ", "é", "Σας", "中文", "12a", "<|endoftext|>", "...", " ", "\n", "👍"]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(120)] + [(None, None), (5, ""), (6, "word " * 9_000), (6, "word " * 9_000)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS).withColumnRenamed("size", "length")
    got = packing.pack_documents(docs, max_tokens=256, with_ids=True).collect()
    expected = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, start in enumerate(range(0, len(ids), 256)):
            piece = ids[start : start + 256]
            expected.append((doc is None, doc or 0, k, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), piece))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in got) == sorted(expected)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_slices_are_read_right():
    batch = pa.RecordBatch.from_arrays([pa.array([f"AbC {i}" for i in range(50)] + [None])], names=["text"])
    lowered = [t for part in slices(batch, "text", 40) for t in pa.compute.ascii_lower(texts_of(part)).to_pylist()]
    assert lowered == [f"abc {i}" for i in range(50)] + [""]


def test_transducer_is_the_model(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    public = pytest.importorskip("public_tokenizers")
    model = sentencepiece.SentencePieceProcessor(model_file=public.path(transducer.MODEL))
    t = transducer.Transducer()
    rng = random.Random(7)
    signs = [*"abcdehrtnisoTHE .,\n▁éß中👍\tZ01<>'", "tion", "the", "  ", "     ", "<0x41>", "</s>"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(600)] + ["", " ", "a" * 3_000]
    for text in texts:
        assert t.encode(text) == model.encode(text)
        assert t.decode(t.encode(text)) == model.decode(model.encode(text)) == text.replace("▁", " ")
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(None, None), (0, texts[0])], "doc_id long, text string")
    encoded = transducer.encode_documents(frame)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: model.encode(x) for i, x in enumerate(texts)} | {None: []}
    assert {r["doc_id"]: r["text"] for r in transducer.decode_documents(encoded).collect()}[len(texts) - 1] == "a" * 3_000
    assert transducer.encode_documents(frame.limit(0)).count() == 0


def test_least_path_by_scores():
    t = transducer.Transducer()
    t.merges, t.fallback = False, 20.0
    t.id, t.score, t.longest = {"a": 1, "b": 2, "ab": 3, "aba": 4}, {"a": -1.0, "b": -1.5, "ab": -2.0, "aba": -3.5}, 3

    def least(text):
        if not text:
            return 0.0
        arcs = [(-t.score[text[:n]], n) for n in range(1, len(text) + 1) if text[:n] in t.id] or [(20.0, 1)]
        return min(w + least(text[n:]) for w, n in arcs)

    for text in ("ab", "aba", "abab", "abaab", "axb", "bbaba"):
        starts, pieces = t._by_scores(text)
        end, weight = len(text), 0.0
        while end:
            weight += -t.score[pieces[end]] if pieces[end] in t.id else 20.0
            end = starts[end]
        assert weight == least(text)


def test_decoded_bytes(spark, sf_dir):
    got = QUERIES["op7_sentencepiece"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("own"))
    assert got.join(docs, "doc_id").filter("own <> text_sha256").count() == 0 and got.count() == docs.count()


@pytest.mark.parametrize("kind", ["random", "ties", "wide", "few"])
def test_topk(spark, kind, monkeypatch):
    rng = np.random.default_rng(8)
    n = 4 if kind == "few" else 300
    x = rng.integers(-2, 3, (n, 6)) / 256 if kind == "ties" else rng.standard_normal((n, 6)) * (1e6 if kind == "wide" else 1)
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1001, [1.0, None], 1), (1002, [1.0, float("nan")], 1), (1003, [float("inf")], 1), (None, [1.0], 1), (1004, [], 1), (1005, [0.5, -0.25], 2), rows[0]]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score int")
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    # ids that occur again with the same and with another vector
    odd += [(7, [float(c) for c in -x[0]], 1), (2, [3.0] * 6, 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score int")
    vectors = topk.materialised(topk.quantised(frame))
    got = [tuple(r) for r in topk.top_k(vectors, vectors.filter("vec_id % 7 = 0")).collect()]
    whole = [(i, [int(np.floor(256 * c)) for c in v] + [0] * (6 - len(v))) for i, v, _ in rows + odd[-4:]]
    expected = []
    for at, (q, of_q) in enumerate(whole):
        if q % 7 == 0:
            scored = sorted((-sum(a * b for a, b in zip(of_q, v, strict=True)), i) for j, (i, v) in enumerate(whole) if j != at)
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert sorted(got) == sorted(expected)
    assert topk.top_k(vectors.limit(0), vectors).count() == 0


def test_topk_of_repeated_ids_is_as_the_sql_has_it(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(0, [8.0, 8.0]), (1, [1.0, 1.0]), (1, [9.0, 9.0]), (2, [5.0, 5.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0])]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    vectors = topk.materialised(topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    got = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score")
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(topk.TOPK_SQL).fetchall())


@pytest.mark.parametrize("words", [1, 2, 4, 5])
def test_ngrams_of_few_words(words):
    for n in range(8):
        text = " ".join("abcdefgh"[:n])
        assert [len(s) for s in jaccard_join.ngram_sets(pa.array([text], pa.large_string()), words)] == [max(n - words + 1, int(n > 0))]


def test_one_of_each_group_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z")], "doc_id long, text string, _row string")
    kept = jaccard_join.one_of_each_group(docs, jaccard_join.Similarity(words=5, percent=80))
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "a b c d e f", "x"), (3, None, "z")]


def test_words_go_to_the_tokenizer_in_short_texts():
    class Seen:
        def __init__(self, tokenizer):
            self.tokenizer, self.words = tokenizer, []

        def encode_batch_fast(self, texts, **options):
            self.words += [len(x.split()) for x in texts]
            return self.tokenizer.encode_batch_fast(texts, **options)

    encoder = packing.WordEncoder(None)
    whole = encoder.tokenizer
    encoder.tokenizer = seen = Seen(whole)
    words = pa.array([f"w{i}ord's" for i in range(3000)], pa.large_string())
    for some in (words.slice(0, 1800), words.slice(1000)):
        starts, lengths, flat = encoder.encode(some)
        for w, a, n in zip(some.to_pylist()[::97], starts[::97], lengths[::97], strict=True):
            assert flat[a : a + n].tolist() == whole.encode(w, add_special_tokens=False).ids
    assert sum(seen.words) == 3000 and max(seen.words) <= 500


def test_words_that_begin_alike_share_their_steps():
    class Counted(dict):
        asked = 0

        def __contains__(self, piece):
            Counted.asked += 1
            return super().__contains__(piece)

    t = transducer.Transducer()
    stem = "unbegreiflicherweise"
    words = [stem + a + b for a in "abcdefgh" for b in "abcdefgh"]
    t.id = Counted(t.id)
    transducer._transducers["counted"] = t
    try:
        ids, sizes = transducer.encode_texts(pa.array([" ".join(reversed(words)), stem], pa.large_string()), "counted")
    finally:
        del transducer._transducers["counted"]
    # the stem is walked once, not once a word
    assert Counted.asked < 20 * len(words)
    fresh = transducer.Transducer()
    alone = [fresh.encode(w) for w in reversed(words)]
    assert ids.tolist() == [i for x in alone for i in x] + fresh.encode(stem)
    assert sizes.tolist() == [sum(map(len, alone)), len(fresh.encode(stem))]


def test_pairs_meet_once_a_run(spark):
    """The same candidates as by meeting at every shared n-gram, from far fewer rows."""
    similarity, rng = jaccard_join.Similarity(4, 85), random.Random(3)
    base = list(range(400))
    sets = [sorted({rng.randrange(10_000, 90_000) if rng.random() < edits else g for g in base[: rng.randint(300, 400)]}) for edits in [0.03, 0.08, 0.15] * 12]
    sets += [[1], [1], [2, 5], [2, 5, 7], list(range(200, 210))]
    rows = []
    for i, own in enumerate(sets):
        bits = [0] * 256
        for g in own:
            bits[g * 7 % 256] ^= 1
        parity = [int("".join(map(str, bits[k : k + 64])), 2) - 2**63 for k in range(0, 256, 64)]
        rows += [(g, pos, i, len(own), *parity, i // 2) for pos, g in enumerate(own[: similarity.prefix(len(own))])]
    met = spark.createDataFrame(rows, "ngram long, pos long, set long, n long, p0 long, p1 long, p2 long, p3 long, label long")
    plain = jaccard_join._candidates(met, met, [F.col("a.ngram") == F.col("b.ngram"), F.col("a.set") < F.col("b.set")], similarity)
    wanted = {(r["a"], r["b"]): r["shared"] for r in plain.collect()}
    pairs, run = jaccard_join._run_pairs(met, similarity)
    got = {(r["a"], r["b"]) for r in jaccard_join._counted(pairs, run, similarity).collect()}
    for i, x in enumerate(sets):
        for j in range(i):
            shared = len({*x} & {*sets[j]})
            if 100 * shared >= 85 * (len(x) + len(sets[j]) - shared) and i // 2 != j // 2:
                assert (j, i) in got
    assert got >= set(wanted) and len(wanted) > 20
    assert 3 * pairs.count() < sum(wanted.values())


def test_stored_tables_go_when_read(spark):
    rows = [(i, f"word{i % 5} and some other words {i % 7}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = os.path.join(shared_dir(spark), spark.sparkContext.applicationId)
    there = {*os.listdir(folder)} if os.path.isdir(folder) else set()
    assert exact_dedup.exact_dedup(docs).kept_documents().count() == 35
    assert jaccard_join.one_of_each_group(docs, jaccard_join.Similarity(5, 80)).count() > 0
    left = {x.rsplit("-", 1)[0] for x in {*os.listdir(folder)} - there}
    assert not left & {"arrivals", "texts-of-groups", "ngram-sets", "row-components", "shared-ngrams"} and "numbered" in left


def test_packing_works_on_little_text_at_once(monkeypatch):
    words = [f"w{i % 977}" for i in range(30_000)]
    texts = pa.array([" ".join(words[i : i + 9_000]) for i in range(0, 20_000, 200)] + [None, "", "one"])
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["doc_id", "text"])
    alone = [row for i in range(len(texts)) for b in packing._piece_task(None, 256, True)([docs.slice(i, 1)]) for row in b.to_pylist()]
    seen, freed, whole = [], [], packing.token_ids
    monkeypatch.setattr(packing, "token_ids", lambda some, path: seen.append(sum(len(t) for t in some.to_pylist())) or whole(some, path))
    monkeypatch.setattr(pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: freed.append(len(seen))))
    together = [row for b in packing._piece_task(None, 256, True)([docs]) for row in b.to_pylist()]
    assert together == alone
    assert sum(seen) > max(seen) and max(seen) <= 2_000_000
    # a worker outlives its task
    assert freed == [len(seen)]


def test_sets_are_made_of_little_text_at_once(monkeypatch):
    texts = pa.array([" ".join(f"w{(i * 31 + j) % 977}" for j in range(12_000)) for i in range(90)] + [None, "one"])
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), texts], names=["doc_id", "text_hash", "text"])
    seen, made = [], jaccard_join.ngram_sets
    monkeypatch.setattr(jaccard_join, "ngram_sets", lambda some, words: seen.append(sum(len(t) for t in some.to_pylist())) or made(some, words))
    rows = [row for b in jaccard_join._sets_task(4)([docs]) for row in b.to_pylist()]
    assert max(seen) <= 2_000_000 < sum(seen) <= 8_000_000
    assert [row["n"] for row in rows] == [len(s) for s in made(texts_of(docs), 4)]
    # n-grams are counted over the whole slice still
    assert [row["ngrams"] is not None for row in rows] == [True] + [False] * (len(rows) - 1)
    members = [row for b in jaccard_join._members_task(4)([docs.rename_columns(["set", "text_hash", "text"])]) for row in b.to_pylist()]
    assert [len(row["members"]) for row in members] == [row["n"] for row in rows] and max(seen) <= 2_000_000


def test_tasks_over_texts_are_handed_slices(spark, monkeypatch):
    """A batch of 10,000 long texts takes many times its size in an executor and its worker."""
    bounds, stored = {}, jaccard_join.materialize

    def noted(df, tag, **more):
        bounds[tag] = more.get("batch_bytes")
        return stored(df, tag, **more)

    for module in (jaccard_join, packing, language_id):
        monkeypatch.setattr(module, "materialize", noted)
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{j}" for j in range(40)), "en" if i % 2 else "de") for i in range(20)], "doc_id long, text string, lang string")
    jaccard_join.jaccard_join(docs, jaccard_join.Similarity(5, 80))
    packing.pack_documents(docs).count()
    language_id.fit_language_model(docs)
    assert {bounds[tag] for tag in ("ngram-sets", "prefixes", "pieces", "language-training")} == {SLICE_BYTES}


def test_stored_tables_bound_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([part.nbytes])], names=["n", "size"])

    texts = spark.range(0, 3_000, 1, 1).select(F.rpad(F.col("id").cast("string"), 1_000, "x").alias("text"))
    rows = materialize(texts.mapInArrow(sizes, "n long, size long"), "sizes", batch_bytes=200_000).collect()
    assert sum(r["n"] for r in rows) == 3_000 and max(r["size"] for r in rows) < 210_000
    assert spark.conf.get(key) == before
    assert len(materialize(texts.mapInArrow(sizes, "n long, size long"), "sizes").collect()) == 1


def test_slices_end_by_giving_memory_back(monkeypatch):
    calls, batch = [], pa.RecordBatch.from_arrays([pa.array(["a" * 10] * 5)], names=["text"])
    monkeypatch.setattr(batches, "_libc", SimpleNamespace(malloc_trim=calls.append))
    assert [x.num_rows for x in slices(batch, "text", 20)] == [2, 2, 1] and calls == [0]
    monkeypatch.setattr(batches, "_libc", SimpleNamespace())
    assert [x.num_rows for x in slices(batch, "text", 20)] == [2, 2, 1]
