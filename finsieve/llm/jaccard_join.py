"""Exact n-gram Jaccard join by grouped prefixes.

Documents are sets of word n-grams, as 64-bit hashes. Equal sets are one class.
In an order of all n-grams that puts frequent ones last, two sets can only be
similar enough if the first few n-grams of both (the prefixes) share MATCHES;
classes with equal prefix and equal size are one group. Groups meet on the n-grams
of their prefixes, pairs are filtered by size, position, parity and shared
n-grams, and their classes are verified on whole sets.

The parity filter is exact: the n-grams of a set fall into PARITIES cells, and two
sets whose cells differ in parity at k places differ in k n-grams at least.

Copies in their thousands link all to all, but components need a few of these
links only. So in a few rounds every set is verified against one or two leaders
among those it meets; afterwards all remaining candidate pairs between different
components are verified, which leaves out nothing but links within a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finsieve.llm.batches import SLICE_BYTES, flat_words, slices, texts_of
from finsieve.llm.components import components
from finsieve.llm.names import fresh
from finsieve.llm.scratch import discard
from finsieve.session import materialize

#: Number of n-grams, the most frequent of those seen more than once in a slice, that the order
#: puts last by frequency. The rest is ordered by hash. A bound on the broadcast table; the order
#: decides only how many candidates there are, never which links are found.
ORDERED_NGRAMS = 524_288
#: Bytes of text made into sets at once: words and n-grams take many times as much.
TEXT_AT_ONCE = 2_000_000
#: N-grams that two prefixes must share; prefixes are longer by one less.
MATCHES = 3
#: Cells whose parity is kept of every set, and the names of their numbers of 64 bits.
PARITIES = 256
PARITY = ["p0", "p1", "p2", "p3"]
#: Rounds in which components are verified against leaders; they end early when one links nothing.
LEADER_ROUNDS = 4
#: Sets that lead at an n-gram in one round.
LEADERS = 8
#: Numbers of 64 bits in the broadcast filter of texts to be read again; the filter only saves shuffling.
MASKS = 131_072


@dataclass(frozen=True)
class Similarity:
    """N-gram length in words, and the least similarity in hundredths."""

    words: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        """Length of the prefix of a set of ``n``: sets this similar share ceil(percent n / 100) at least."""
        least = -(-self.percent * n // 100)
        return n - least + min(MATCHES, least)

    def matches(self, n: Column, m: Column) -> Column:
        """How many n-grams the prefixes of two linked sets share at least; tiny sets share fewer."""
        return F.least(F.lit(MATCHES), F.ceil(F.least(n, m) * self.percent / 100))

    def least_matches(self, n: Column) -> Column:
        """How many n-grams the prefix of a set shares at least with that of any set it is linked with."""
        return F.least(F.lit(MATCHES), F.ceil(n * self.percent * self.percent / 10_000))

    def needed(self, n: Column, m: Column) -> Column:
        """Whether sizes alone allow a link."""
        return F.least(n, m) * 100 >= F.greatest(n, m) * self.percent

    def linked(self, shared: Column, n: Column, m: Column) -> Column:
        return shared * 100 >= (n + m - shared) * self.percent


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def ngram_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every text.

    Words lie between ASCII white space and A-Z count as a-z. A text of fewer than
    ``words`` words has its whole sequence as its only n-gram, one without words none.
    """
    found, rows = flat_words(pa.compute.ascii_lower(texts))
    coded = found.dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
    h = own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else own
    counts = np.bincount(rows, minlength=len(texts))
    ends = np.cumsum(counts)
    starts = max(0, len(h) - words + 1)
    rolled = np.full(starts, words, dtype=np.uint64)
    for i in range(words):
        rolled = _mixed(rolled + h[i : i + starts])
    out = []
    for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(rolled[end - n : end - words + 1]))
        elif n:
            short = np.full(1, n, dtype=np.uint64)
            for w in h[end - n : end]:
                short = _mixed(short + w)
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def parities(flat: np.ndarray, rows: np.ndarray, sets: int) -> np.ndarray:
    """Per set, the parity of the number of its n-grams in each cell, as four numbers of 64 bits."""
    cells = np.bincount(rows * PARITIES + (flat >> np.uint64(56)).astype(np.int64), minlength=sets * PARITIES)
    return np.packbits((cells & 1).astype(np.uint8).reshape(sets, PARITIES), axis=1).view(np.int64)


def _key(ngrams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(ngrams.tobytes())


_SETS = "doc_id long, text_hash long, n long, key binary, ngrams array<long>, counts array<long>"


def _sets_task(words: int):
    """Size and key of every text's set; with the first row of a slice, the n-grams that several texts of it have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                # counted over a slice, but words of few texts at once
                sets = [s for some in slices(part, "text", TEXT_AT_ONCE) for s in ngram_sets(texts_of(some), words)]
                keys = [_key(s) for s in sets]
                first = {k: i for i, k in reversed(list(enumerate(keys)))}
                ngrams, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *(sets[i] for i in first.values())]), return_counts=True)
                shared = counts > 1
                rest = [None] * (len(sets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array([ngrams[shared].view(np.int64), *rest], pa.list_(pa.int64())),
                        pa.array([counts[shared].astype(np.int64), *rest], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n", "key", "ngrams", "counts"],
                )

    return run


def _prefix_task(similarity: Similarity, order: Broadcast):
    """Group, key, prefix and parities of every distinct set of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, frequency = order.value
        for batch in batches:
            for part in slices(batch, "text", TEXT_AT_ONCE):
                seen: dict[bytes, tuple[int, int, np.ndarray, int]] = {}
                sets = ngram_sets(texts_of(part), similarity.words)
                flat = np.concatenate([np.empty(0, np.uint64), *sets])
                at = np.searchsorted(ordered, flat)
                at[at == len(ordered)] = 0
                count = np.where(ordered[at] == flat, frequency[at], 0) if len(ordered) else np.zeros(len(flat), np.int64)
                parity = parities(flat, np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))
                end = 0
                for row, s in enumerate(sets):
                    end += len(s)
                    key = _key(s)
                    if not len(s) or key in seen:
                        continue
                    own, p = count[end - len(s) : end], similarity.prefix(len(s))
                    rare = np.flatnonzero(own == 0)[:p]
                    if len(rare) < p:
                        common = np.flatnonzero(own)
                        rare = np.concatenate([rare, common[np.lexsort((s[common], own[common]))][: p - len(rare)]])
                    prefix = s[rare]
                    group = xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=len(s)) - 2**63
                    seen[key] = (group, len(s), prefix.view(np.int64), row)
                parity = parity[[x[3] for x in seen.values()]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(seen), pa.binary()),
                        pa.array([x[0] for x in seen.values()], pa.int64()),
                        pa.array([x[1] for x in seen.values()], pa.int64()),
                        pa.array([x[2] for x in seen.values()], pa.list_(pa.int64())),
                        *(pa.array(np.ascontiguousarray(column)) for column in parity.T),
                    ],
                    names=["key", "group", "n", "prefix", *PARITY],
                )

    return run


def _members_task(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_AT_ONCE):
                sets = ngram_sets(texts_of(part), words)
                members = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("set"), members], names=["set", "members"])

    return run


@dataclass
class JaccardJoin:
    """``documents``: ``doc_id, text_hash, n, key`` per row; ``sets``: ``key``, its number ``set`` and ``least`` id; ``labels``: ``node`` (a set), ``label``."""

    documents: DataFrame
    sets: DataFrame
    labels: DataFrame

    def classes(self) -> DataFrame:
        """``key, component_id`` of every set: the smallest ``doc_id`` of its component."""
        labelled = self.sets.join(self.labels, F.col("set") == F.col("node"), "left")
        labelled = labelled.select("key", "least", F.coalesce("label", "set").alias("label"))
        smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
        return labelled.join(smallest, "label").select("key", "component_id")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams in ascending order, and their counts; ORDERED_NGRAMS at most."""
    pairs = sets.filter("ngrams IS NOT NULL").select(F.explode(F.arrays_zip("ngrams", "counts")).alias("x"))
    counted = pairs.groupBy(F.col("x.ngrams").alias("ngram")).agg(F.sum("x.counts").alias("n"))
    top = counted.orderBy(F.desc("n"), "ngram").limit(ORDERED_NGRAMS).toArrow()
    ngrams = top["ngram"].to_numpy().view(np.uint64)
    by_value = np.argsort(ngrams)
    return ngrams[by_value], top["n"].to_numpy()[by_value]


def jaccard_join(docs: DataFrame, similarity: Similarity = Similarity()) -> JaccardJoin:
    """Links the rows of ``docs`` (``doc_id``, ``text``) whose n-gram sets are similar enough.

    Null and empty texts have an empty set and link with nothing; rows with equal
    sets are linked. ``doc_id`` may be null or repeat. Other columns are ignored;
    an empty table gives empty results.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    sets = materialize(texts.mapInArrow(_sets_task(similarity.words), _SETS), "ngram-sets", batch_bytes=SLICE_BYTES)
    documents = sets.select("doc_id", "text_hash", "n", "key")
    order = spark.sparkContext.broadcast(_frequent(sets))
    columns = "key binary, group long, n long, prefix array<long>, " + ", ".join(f"{p} long" for p in PARITY)
    prefixes = materialize(texts.select("text").mapInArrow(_prefix_task(similarity, order), columns), "prefixes", batch_bytes=SLICE_BYTES)
    order.unpersist()
    # of each set its number, smallest id, and one row, by which its text is found again
    at = F.min(F.struct("text_hash", F.coalesce("doc_id", F.lit(-(2**63))).alias("id")))
    rows = documents.filter("n > 0").groupBy("key").agg(at.alias("at"), F.min("doc_id").alias("least"))
    rows = materialize(rows.select("key", "at.text_hash", "at.id", "least", F.monotonically_increasing_id().alias("set")), "set-rows")

    # n-grams that the prefixes of two groups share; sizes and positions go along in one number
    tokens = prefixes.select("group", (F.col("n") * 2**31).alias("base"), F.posexplode("prefix").alias("pos", "ngram"))
    tokens = tokens.select("ngram", "group", (F.col("base") + F.col("pos")).alias("size_pos"))
    # stored by itself, so that the two shuffles of all n-grams are not on disk together
    shared = tokens.groupBy("ngram").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("ngram")
    shared = materialize(shared, "shared-ngrams")
    meeting = materialize(tokens.join(shared, "ngram").distinct().withColumns({"n": F.shiftright("size_pos", 31), "pos": F.col("size_pos") % 2**31}).drop("size_pos"), "meeting")
    members = prefixes.select("group", "key", "n", *PARITY).distinct().join(rows.select("key", "set"), "key").drop("key")
    members = materialize(members, "group-members")
    discard(prefixes, shared)
    whole = spark.createDataFrame([], "set long, members array<long>")
    links = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "node long, label long")

    def verify(pairs: DataFrame) -> DataFrame:
        """Adds what is linked of ``pairs`` to ``links``, and the sets read for it to ``whole``."""
        nonlocal whole, links
        missing = _keys(pairs).join(whole.select("set"), "set", "left_anti")
        whole = whole.unionByName(_whole_sets(texts, rows.join(missing, "set"), similarity))
        found = _verified(pairs, whole, similarity)
        links = links.unionByName(found)
        return found

    several = members.groupBy("group").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("group")
    grouped = materialize(members.join(several, "group"), "grouped-sets")
    met = materialize(_meeting_sets(meeting, members, similarity), "open-sets")
    discard(meeting, members)
    for turn in range(LEADER_ROUNDS):
        pairs = materialize(_leader_pairs(met, _labelled(grouped, labels), similarity, turn), "leader-pairs")
        linked = not pairs.isEmpty() and not verify(pairs).isEmpty()
        discard(pairs)
        if not linked:
            break
        labels = components(links)
        still = materialize(_open_sets(met, labels), "open-sets")
        discard(met)
        met = still
    pairs = materialize(_remaining_pairs(met, _labelled(grouped, labels), similarity), "remaining-pairs")
    discard(met, grouped)
    if not pairs.isEmpty() and not verify(pairs).isEmpty():
        labels = components(links)
    return JaccardJoin(documents, rows.select("key", "set", "least"), labels)


def _may_link(similarity: Similarity, a: str, b: str) -> Column:
    """Whether size and parities allow a link between two sets of different components."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in PARITY), F.lit(0))
    most = F.shiftright(n + m - apart, 1)
    return (F.col(f"{a}.label") != F.col(f"{b}.label")) & similarity.needed(n, m) & similarity.linked(most, n, m)


def _may_reach(similarity: Similarity, a: str, b: str) -> Column:
    """At one of their first shared n-grams, two sets can still be similar enough by what follows it."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = similarity.matches(n, m) - 1 + F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return similarity.linked(F.least(most, n, m), n, m)


def _labelled(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """``sets`` with the ``label`` of each; one without a link is its own label."""
    joined = sets.join(labels, F.col("set") == F.col("node"), "left")
    return joined.withColumn("label", F.coalesce("label", "set")).drop("node")


def _meeting_sets(meeting: DataFrame, members: DataFrame, similarity: Similarity) -> DataFrame:
    """The sets at every n-gram with ``pos``, size, parities and ``label``, without those at too few n-grams to link."""
    at = meeting.groupBy("group", "n").agg(F.count(F.lit(1)).alias("ngrams"))
    enough = at.filter(F.col("ngrams") >= similarity.least_matches(F.col("n"))).select("group")
    sets = members.join(enough, "group").withColumn("label", F.col("set"))
    return meeting.select("ngram", "group", "pos").join(sets, "group").drop("group")


def _open_sets(met: DataFrame, labels: DataFrame) -> DataFrame:
    """``met`` under new labels, at the n-grams where several components meet; closed ones never open again."""
    labelled = _labelled(met.drop("label"), labels)
    several = labelled.groupBy("ngram").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("ngram")
    return labelled.join(several, "ngram")


def _counted(pairs: DataFrame, shared: Column, similarity: Similarity) -> DataFrame:
    """The pairs of rows ``a`` and ``b`` that share enough n-grams, with their number and the labels; ``shared`` is what a row of ``pairs`` adds."""
    counted = pairs.groupBy(F.col("a.set").alias("a"), F.col("b.set").alias("b")).agg(
        F.sum(shared).alias("shared"),
        *(F.first(f"{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in ("n", "label")),
    )
    return counted.filter(F.col("shared") >= similarity.matches(F.col("n_a"), F.col("n_b")))


def _candidates(met: DataFrame, others: DataFrame, on: list[Column], similarity: Similarity) -> DataFrame:
    """Pairs of ``met`` (``a``) and ``others`` (``b``) that pass all filters, with ``shared`` n-grams and labels."""
    pairs = met.alias("a").join(others.alias("b"), [*on, _may_link(similarity, "a", "b") & _may_reach(similarity, "a", "b")])
    return _counted(pairs, F.lit(1), similarity)


def _run_pairs(met: DataFrame, similarity: Similarity) -> tuple[DataFrame, Column]:
    """Pairs of ``met`` with itself, once for every run of n-grams that both hold side by side; and the length of the run.

    Two sets that hold the same n-gram before this one meet there already. A run
    counts up to MATCHES n-grams, no more of them are asked for.
    """
    along = Window.partitionBy("set").orderBy("pos", "ngram")
    after = [f"after_{i}" for i in range(1, MATCHES)]
    beside = {"before": F.lag("ngram").over(along)} | {c: F.lead("ngram", i).over(along) for i, c in enumerate(after, 1)}
    met = met.withColumns(beside)
    first = ~F.coalesce(F.col("a.before") == F.col("b.before"), F.lit(False))
    on = [F.col("a.ngram") == F.col("b.ngram"), F.col("a.set") < F.col("b.set")]
    pairs = met.alias("a").join(met.alias("b"), [*on, _may_link(similarity, "a", "b") & first & _may_reach(similarity, "a", "b")])
    run, goes_on = F.lit(1), F.lit(True)
    for c in after:
        goes_on = goes_on & F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(False))
        run = run + goes_on.cast("int")
    return pairs, run


def _leader_pairs(met: DataFrame, grouped: DataFrame, similarity: Similarity, turn: int) -> DataFrame:
    """Pairs ``a, b`` of sets in different components, two at most for each set and one for two components.

    At every n-gram and band of sizes LEADERS sets lead, others in every round.
    Sets of one group are paired with the group's leader.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / similarity.percent)))).cast("int")
    met = met.withColumn("band", band)
    turns = Window.partitionBy("ngram", "band").orderBy(F.xxhash64("set", F.lit(turn)), "set")
    leaders = met.withColumn("place", F.row_number().over(turns)).filter(F.col("place") <= LEADERS).drop("place")
    counted = _candidates(met, leaders, [F.col("a.ngram") == F.col("b.ngram"), F.col("a.band") == F.col("b.band")], similarity)
    counted = counted.groupBy("label_a", "label_b").agg(F.max_by(F.struct("a", "b", "shared"), F.struct("shared", "a", "b")).alias("x")).select("x.*")
    best = counted.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("most"), F.max_by("b", F.xxhash64("b")).alias("any"))
    across = best.select("a", F.explode(F.array_distinct(F.array("most", "any"))).alias("b"))
    first = grouped.groupBy("group").agg(F.min(F.struct("set", "label")).alias("leader"))
    within = grouped.join(first, "group").filter("label <> leader.label").select(F.col("leader.set").alias("a"), F.col("set").alias("b"))
    return _ordered_pairs(across.unionByName(within))


def _remaining_pairs(met: DataFrame, grouped: DataFrame, similarity: Similarity) -> DataFrame:
    """All candidate pairs ``a, b`` of sets in different components."""
    across = _counted(*_run_pairs(met, similarity), similarity).select("a", "b")
    a, b = grouped.alias("a"), grouped.alias("b")
    within = a.join(b, [F.col("a.group") == F.col("b.group"), F.col("a.set") < F.col("b.set"), _may_link(similarity, "a", "b")])
    return _ordered_pairs(across.unionByName(within.select(F.col("a.set").alias("a"), F.col("b.set").alias("b"))))


def _ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _keys(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()


def _whole_sets(texts: DataFrame, wanted: DataFrame, similarity: Similarity) -> DataFrame:
    """``set, members`` of the sets ``wanted`` (``text_hash``, ``id``, ``set``), from their texts again."""
    wanted = materialize(wanted.select("text_hash", "id", "set"), "wanted-rows")
    # one bit per hash, in MASKS numbers at most: keeps most other texts out of the shuffle of the exact join
    bit = F.pmod(F.col("text_hash"), F.lit(64 * MASKS))
    masks = wanted.select(F.floor(bit / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("one"))
    masks = masks.groupBy("word").agg(F.bit_or("one").alias("mask"))
    near = texts.withColumns({"id": F.coalesce("doc_id", F.lit(-(2**63))), "word": F.floor(bit / 64).cast("int"), "one": F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))})
    near = near.join(F.broadcast(masks), "word").filter(F.col("mask").bitwiseAND(F.col("one")) != 0).select("text_hash", "id", "text")
    found = near.join(wanted, ["text_hash", "id"]).dropDuplicates(["set"]).select("set", "text")
    members = materialize(found.mapInArrow(_members_task(similarity.words), "set long, members array<long>"), "members", batch_bytes=SLICE_BYTES)
    discard(wanted)
    return members


def _verified(pairs: DataFrame, whole: DataFrame, similarity: Similarity) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose whole sets are similar enough."""
    both = pairs.join(whole.select(F.col("set").alias("a"), F.col("members").alias("of_a")), "a")
    both = both.join(whole.select(F.col("set").alias("b"), F.col("members").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    linked = similarity.linked(shared, F.size("of_a").cast("long"), F.size("of_b").cast("long"))
    return materialize(both.filter(linked).select("a", "b"), "links")


def linked_documents(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``; see ``jaccard_join``."""
    found = jaccard_join(docs, similarity)
    joined = found.documents.join(found.classes(), "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, similarity: Similarity) -> DataFrame:
    """The rows of ``docs`` without those linked to one that stays: of each component one row with its smallest ``doc_id``.

    Rows without words are in no group and stay. All columns are kept. Of several
    rows with that id, or of rows without any id, exactly one stays.
    """
    row = fresh("_row", docs.columns)
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = jaccard_join(keyed.select(F.col(row).alias("doc_id"), "text"), similarity)
    component = found.documents.join(found.classes(), "key").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_component"))
    component = component.join(keyed.select(F.col(row).alias("_row"), F.col("doc_id").alias("_id")), "_row")
    component = materialize(component, "row-components")
    # null ids are last
    first = component.groupBy("_component").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first"))
    dropped = component.join(first, "_component").filter("_row <> first._row").select("_row")
    dropped = materialize(dropped.select(F.col("_row").alias(row)), "near-copies")
    discard(component, found.documents)
    return keyed.join(dropped, row, "left_anti").select(*docs.columns)
