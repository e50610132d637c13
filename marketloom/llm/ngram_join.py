"""Exact n-gram Jaccard self-join of documents, by inverted lists and set relations.

1. A scan makes each text's sorted set of shingle hashes; equal sets are one class from here
   on. The same scan counts shingles in ORDER_BUCKETS counters; rare buckets come first in
   the one order that all sets share.
2. A second scan emits the first shingles of every set (the prefix that any set of
   similarity MIN_PERCENT must meet) with set size and position. Those rows are the index
   lists, sorted by shingle in a shuffle and read as a stream: a list of one set is dropped,
   and so is a row whose size and position rule out all others of its list;
   the others, in order of set size, name a leader for every block of similar sizes. A list
   whose counter is far over the mean is salted, and the heads of its parts meet in a
   second, small step. So a list of any length gives as many rows as it has sets.
3. Each set is proposed to the leader it meets most often. A proposal is settled in three
   steps, the cheap ones first (``_settle``): what two prefixes share and how much can follow
   behind them bounds the overlap from above; overlaps with a leader that both were compared
   with bound it from both sides; the texts of what is left are compared. Linked sets form
   components.
4. Lists that still hold sets of different components draw other leaders in rounds, for as
   long as that links a good share of what is compared: a large group of near copies, not
   all similar to one of them, comes together in a few rounds of linear size.
5. What lists still hold sets of different components ask: a set asks the components, no
   smaller than its own, that stand in its lists. Blocks of set sizes are skipped by the
   join key, positions by the bound on what can follow, pairs of one component altogether.
   Small components are expanded and their pairs settled as before. Large components are
   asked in blocks: over a block's index lists the overlaps of an asker follow from those of
   a similar asker before it (``answers``). A list of more than CROWD components (texts that
   recombine common paragraphs are not similar and share whole prefixes) asks no pairs: lists
   with the same sets are one, its sets are dealt into blocks and answered block by block.

Every pair of similar sets is thus compared, derived, or already connected, so components
are complete, and no group is ever collected or expanded into its pairs.

6. Links are counted (``count_links``) within components, where all of them are: a component's
   sets are dealt into blocks, a task takes two blocks, and each set's answers over the index
   lists of a block follow from those of the similar set before it. Only counts come out.

Sets and shingles are told apart by 64-bit hashes: "the same" below always means the same hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm import textbatch as tb
from marketloom.llm.scratch import Steps, packed, table, write_through

WORDS = 5
MIN_PERCENT = 75
#: Counters for the common order; 8 bytes each go to every task.
ORDER_BUCKETS = 1 << 16
_SHIFT = np.uint64(48)
#: A counter over so many times the mean has its lists salted, a salt for each such multiple.
HOT_MEANS = 4
#: Keys, pairs and component labels are broadcast up to so many rows of two or three numbers
#: (about 100 bytes each as Spark holds them); beyond that the same joins shuffle.
BROADCAST_ROWS = 200_000
#: Beyond that number of keys, the scan for texts is thinned by a bit array of this size
#: before its rows are shuffled.
FILTER_BITS = 1 << 26
#: In a round, a set is compared with so many leaders of other components.
ROUND_LEADERS = 4
#: Rounds go on while at least one in so many of their pairs is a link, and there is a link
#: for so many of the sets that stand in lists.
ROUND_YIELD, ROUND_SHARE = 4, 50
#: Components of more sets than SMALL are asked in blocks of about BLOCK_SETS sets; where links
#: are counted, a block also has about BLOCK_SHINGLES shingles at most.
SMALL, BLOCK_SETS, BLOCK_SHINGLES = 4, 512, 1 << 21
#: Lists of more components are compared in blocks and not asked set by set, so the rows of a
#: list's asks are at most CROWD times its sets.
CROWD = 256


def signature(s: np.ndarray) -> int:
    """One 64-bit value of a set, whatever its order."""
    with np.errstate(over="ignore"):
        return int((tb.mix(s).sum() + tb.mix(np.array([len(s)], np.uint64))[0]).view(np.int64))


def prefix_length(n: int, percent: int) -> int:
    """So many first elements of a set of n meet those of any set it is similar to."""
    return n - (percent * n + 99) // 100 + 1


def _suffix(n: str, percent: int) -> str:
    """SQL: so many elements of a set of n follow its prefix."""
    return f"({n} * {percent}L + 99) div 100 - 1"


def _sets_pass(docs: DataFrame, words: int) -> DataFrame:
    """Rows of documents (id, key, n, sig) and rows of counters (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ORDER_BUCKETS, np.int64)
        for whole in batches:
            id_type = whole.schema.field("id").type
            for batch in tb.slices(whole, "text"):
                sets = tb.shingle_sets(*tb.flat(batch.column("text")), words)
                counts += np.bincount(np.concatenate(sets) >> _SHIFT if sets else [], minlength=ORDER_BUCKETS).astype(np.int64)
                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s) for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))],
                    ["id", "key", "n", "sig", "block", "counts"],
                )
        if counts.any():
            parts = counts.reshape(16, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(16, id_type), pa.nulls(16, pa.int64()), pa.nulls(16, pa.int32()), pa.nulls(16, pa.int64()), pa.array(range(16), pa.int32()), pa.array(parts.tolist(), pa.list_(pa.int64()))],
                ["id", "key", "n", "sig", "block", "counts"],
            )

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, key long, n int, sig long, block int, counts array<long>")


def _order(first: DataFrame) -> np.ndarray:
    """The counters of all documents: ORDER_BUCKETS numbers, whatever the input's size."""
    rows = first.where("block is not null").select("block", F.posexplode("counts").alias("p", "c")).groupBy("block", "p").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(ORDER_BUCKETS, np.int64)
    for r in rows:
        counts[r.block * (ORDER_BUCKETS // 16) + r.p] = r.c
    return counts


def _salts(counts: np.ndarray) -> np.ndarray:
    """By bucket: a hot one's lists are dealt into so many parts besides the first."""
    return (counts // max(1, int(HOT_MEANS * counts.mean()))).astype(np.int64)


def _prefix_rows(docs: DataFrame, counts: np.ndarray, words: int, percent: int) -> DataFrame:
    """(token, salt, cid, size, pos): the prefixes of all sets. salt is -1 for tokens that
    aren't hot. A task gives a set once, however many copies it meets."""
    sent = docs.sparkSession.sparkContext.broadcast((counts, _salts(counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, salts = sent.value
        seen: set[int] = set()
        for whole in batches:
            for batch in tb.slices(whole, "text"):
                out: list[tuple] = []
                for s in tb.shingle_sets(*tb.flat(batch.column("text")), words):
                    if not len(s) or (sig := signature(s)) in seen:
                        continue
                    seen.add(sig)
                    p = prefix_length(len(s), percent)
                    bucket = (s >> _SHIFT).astype(np.int64)
                    order = np.lexsort((s, counts[bucket]))[:p]
                    hot = salts[bucket[order]]
                    draw = tb.mix(np.array([sig & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] >> np.uint64(16)
                    salt = np.where(hot > 0, np.int64(draw) % (hot + 1), -1)
                    out.append((s[order].view(np.int64), salt, np.full(p, sig), np.full(p, len(s)), np.arange(p)))
                if out:
                    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["token", "salt", "cid", "size", "pos"])

    return docs.mapInArrow(run, "token long, salt int, cid long, size int, pos int")


def _has_partner(x: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether another row of the list has a size that the row's size allows; and one that its
    size and position allow, if nothing shared stands before.

    Rows are (token, salt, size, cid, pos) in order. The lists at both ends of a batch may go
    on outside of it, and salted ones elsewhere: their rows all stay.
    """
    number = np.cumsum(first) - 1
    n, left = x[:, 2], x[:, 2] - x[:, 4]
    low = -(-n * percent // 100)
    whole = n * 100 // percent
    span = np.int64(1) << 31
    key = number * span + n
    stays = (x[:, 1] >= 0) | (number == 0) | (number == number[-1])

    def within(high: np.ndarray) -> np.ndarray:
        others = np.searchsorted(key, number * span + high, side="right") - np.searchsorted(key, number * span + low, side="left")
        return others - ((n >= low) & (n <= high)) > 0

    by_size = within(whole) | stays
    return by_size, by_size & (within(np.minimum(whole, (left * (100 + percent) - n * percent) // percent)) | stays)


def _lists(prefixes: DataFrame, percent: int) -> DataFrame:
    """The index lists of two sets or more (or of salted tokens). A list stands in order of
    set size, cut into blocks of similar sizes; a block's first set leads it, and is itself
    led by the set before it, the last of the block below. Rows that are not ``starts`` can't
    be the first that two similar sets share; they only count for what their prefixes share."""
    ratio = np.log(100.0 / percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None  # the first row of the open list, not yet given
        tail: np.ndarray | None = None  # the last row before this batch
        lead: np.ndarray | None = None  # the row that leads the open block
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("token", "salt", "size", "cid", "pos")], axis=1)
            if tail is not None:
                x = np.concatenate((tail[None], x))
            if not len(x):
                continue
            fresh = np.ones(len(x), bool)  # not the row before once more
            fresh[1:] = (x[1:, :4] != x[:-1, :4]).any(axis=1)
            x = x[fresh]
            first = np.ones(len(x), bool)  # of a list
            first[1:] = (x[1:, :2] != x[:-1, :2]).any(axis=1)
            block = np.floor(np.log(np.maximum(x[:, 2], 1)) / ratio + 1e-9).astype(np.int64)
            start = first.copy()  # of a block
            start[1:] |= block[1:] != block[:-1]
            by = np.maximum.accumulate(np.where(start, np.arange(len(x)), 0))
            leads = x[by][:, [3, 2, 4]]
            if tail is not None and lead is not None:
                leads[by == 0] = lead  # the block that was open
            last_lead = leads[-1].copy()
            inner = start & ~first
            leads[inner] = x[np.flatnonzero(inner) - 1][:, [3, 2, 4]]
            alone = first & np.append(first[1:], True) & (x[:, 1] < 0)
            by_size, starts = _has_partner(x, first, percent)
            give = ~alone & by_size
            if tail is not None:
                # The row carried over is given now only if it was held back before.
                if held is None:
                    give[0] = False
                elif len(x) > 1 and first[1]:
                    give[0] = False
            # The last row stays back while it may be its list's only one.
            held = x[-1] if first[-1] and x[-1, 1] < 0 and not (held is None and tail is not None and len(x) == 1) else None
            if held is not None:
                give[-1] = False
            tail, lead = x[-1], last_lead
            if give.any():
                y, l, may = x[give], leads[give], starts[give]
                cols = [(y[:, 0], pa.int64()), (y[:, 1], pa.int32()), (y[:, 3], pa.int64()), (y[:, 2], pa.int32()), (y[:, 4], pa.int32()), (l[:, 0], pa.int64()), (l[:, 1], pa.int32()), (l[:, 2], pa.int32()), (may, pa.bool_())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["token", "salt", "cid", "size", "pos", "leader", "lead_size", "lead_pos", "starts"])

    dealt = prefixes.repartition("token", "salt").sortWithinPartitions("token", "salt", "size", "cid")
    return dealt.mapInArrow(run, "token long, salt int, cid long, size int, pos int, leader long, lead_size int, lead_pos int, starts boolean")


def row_key(id_col: Column, text: Column) -> Column:
    """What tells rows apart: a 64-bit hash of id and text. Rows of one key are repeated rows."""
    return F.xxhash64(id_col.isNull(), id_col, text)


def _empty(like: DataFrame, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema)


def _thinned(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without most of the rows whose key isn't among ``keys``: by FILTER_BITS bits,
    whatever the number of keys, so that the rest of the texts needn't be shuffled."""
    at = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    found = keys.select(at.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(h & 63))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, np.int64)
    bits[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy()
            yield b.filter(pa.array((sent.value[h >> 6] >> (h & 63)) & 1 == 1)).drop_columns(["h"])

    return docs.select("key", "text", at.alias("h")).mapInArrow(run, "key long, text string")


def _texts(steps: Steps, sigs: DataFrame, most: int, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, text), a row for each of the classes ``sigs``, ``most`` at most. The texts are read again where they
    are, by the key of a row that has the set; few keys are broadcast, many thin the scan and
    are joined by a shuffle. Of repeated rows the one with the lowest tag stays."""
    few = sigs.distinct()
    needed, wanted = steps.write_narrow(classes.select("sig", F.col("rep").alias("key")).join(F.broadcast(few) if most <= BROADCAST_ROWS else few, "sig"), "join-needed")
    if wanted <= BROADCAST_ROWS:
        rows = docs.select("key", "text").join(F.broadcast(needed), "key")
    else:
        rows = _thinned(docs, needed).join(needed, "key")
    tag = F.monotonically_increasing_id()  # fixed once written
    texts = steps.write(rows.select("sig", "text", tag.alias("tag")), "join-texts")
    if texts.count() == wanted:
        return texts.select("sig", "text")
    again = steps.write(texts.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.min("tag").alias("low")).where("k > 1").select("sig", "low"), "join-repeated")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    return texts.join(again, "sig", "left").where("low is null or low = tag").select("sig", "text")


def _compare(steps: Steps, pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """Exact overlaps of pairs (a, b) of classes: (a, b, o, na, nb)."""
    if not (many := pairs.count()):
        return _empty(docs, "a long, b long, o long, na long, nb long")
    texts = _texts(steps, pairs.select(F.explode(F.array("a", "b")).alias("sig")), 2 * many, docs, classes)
    pairs = pairs.select("a", "b")
    second = pairs.select("b").distinct()
    if many <= BROADCAST_ROWS:
        pairs, second = F.broadcast(pairs), F.broadcast(second)
    a = texts.select(F.col("sig").alias("a"), F.col("text").alias("ta"))
    # Many sets share a leader: only the texts that are second of a pair go to that side.
    b = texts.select(F.col("sig").alias("b"), F.col("text").alias("tb")).join(second, "b", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in tb.slices(whole, "ta"):
                keys_a, keys_b = (batch.column(c).to_numpy() for c in "ab")
                sets: list[dict[int, np.ndarray]] = []
                for keys, text, known in ((keys_a, "ta", {}), (keys_b, "tb", last)):
                    fresh, at = np.unique(keys, return_index=True)
                    take = np.array([k for k, x in zip(at, fresh, strict=True) if x not in known], np.int64)
                    made = tb.shingle_sets(*tb.flat(batch.column(text).take(pa.array(take))), words) if len(take) else []
                    sets.append(known | {int(keys[k]): s for k, s in zip(take, made, strict=True)})
                last = {int(keys_b[-1]): sets[1][int(keys_b[-1])]}
                rows = []
                for x, y in zip(keys_a.tolist(), keys_b.tolist(), strict=True):
                    s, t = sets[0][x], sets[1][y]
                    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                    rows.append((x, y, int((t[at] == s).sum()), len(s), len(t)))
                cols = np.array(rows, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cols[:, k]) for k in range(5)], ["a", "b", "o", "na", "nb"])

    return steps.write_narrow(a.join(pairs, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, o long, na long, nb long"), "join-overlaps")[0]


def _promising(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb): the pairs (a, b) that what their prefixes share lets be similar.

    Shared elements of one order: with k in both prefixes, the last at ia and jb, the others
    follow the prefix of the set whose prefix ends first, and stand behind ia and jb.
    """
    first, second = (prefixes.select(F.col("cid").alias(s), F.col("size").alias(f"n{s}"), F.col("tokens").alias(f"t{s}"), F.col("pos").alias(f"p{s}")) for s in "ab")
    pairs = pairs.select("a", "b")
    if pairs.count() <= BROADCAST_ROWS:
        second = second.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
        pairs = F.broadcast(pairs)
    x = first.join(pairs, "a").join(second, "b").withColumn("both", F.array_intersect("ta", "tb")).where("size(both) > 0")
    last = F.element_at("both", -1)
    x = x.withColumn("ia", F.element_at("pa", F.array_position("ta", last).cast("int"))).withColumn("jb", F.element_at("pb", F.array_position("tb", last).cast("int")))
    most = f"size(both) + greatest(least({_suffix('na', percent)}, nb - jb - 1), least({_suffix('nb', percent)}, na - ia - 1))"
    return x.where(F.expr(f"({most}) * {100 + percent}L >= (na + nb) * {percent}L")).select("a", "b", F.col("na").cast("long").alias("na"), F.col("nb").cast("long").alias("nb"))


def _prefix_arrays(lists: DataFrame) -> DataFrame:
    """(cid, size, tokens, pos): by set the elements of its prefix that stand in lists, in
    order. No longer than the set's prefix."""
    rows = lists.groupBy("cid", "size").agg(F.array_sort(F.collect_set(F.struct("pos", "token"))).alias("r"))
    return rows.select("cid", "size", F.col("r.token").alias("tokens"), F.col("r.pos").alias("pos"))


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _settle(steps: Steps, pairs: DataFrame, prefixes: DataFrame, done: DataFrame | None, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """Links (a, b) among ``pairs``; ``done`` with the overlaps that were counted; and how many
    pairs were left to be derived or counted."""
    open_, asked = steps.write_narrow(_promising(pairs, prefixes, percent), "join-promising")
    if done is None:
        open_ = open_.withColumn("sure", F.lit(None).cast("boolean"))
    elif asked:
        open_, _ = steps.write_narrow(_derived(open_, packed(done, done.count()), percent), "join-derived")
    else:
        return _empty(docs, "a long, b long"), done, 0
    more = _compare(steps, open_.where("sure is null"), docs, classes, words)
    links = open_.where("sure").select("a", "b").unionAll(more.where(F.expr(f"o * {100 + percent} >= (na + nb) * {percent}")).select("a", "b"))
    return links, more if done is None else done.unionAll(more), asked


def components(steps: Steps, links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the component's smallest node.

    Large-star and small-star rounds: each hangs every node's neighbours under the smallest
    of them until every node hangs under one that hangs under none. A round is two
    aggregations of the links, written to the shared folder.
    """
    edges, many = steps.write_narrow(packed(links, links.count()).where("a <> b").select("a", "b").distinct(), "join-links")
    near = F.broadcast if many <= BROADCAST_ROWS else lambda df: df

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        hung = both.join(near(low), "a")
        if large:
            return hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    while many:
        above = edges.select(F.col("b").alias("a")).distinct()
        loose = edges.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("a").unionAll(edges.join(near(above), "a", "left_semi").select("a"))
        if loose.isEmpty():
            break
        # Stars never make more edges than there are.
        before = edges
        edges, many = steps.write_narrow(star(star(edges, True), False), "join-links")
        steps.drop(before)
    tops = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionAll(tops.select("node", F.col("node").alias("comp")))


def _fits(na: str, nb: str, pa: str, pb: str, percent: int) -> str:
    """SQL: whether sets of na and nb elements can be similar if the first element they share
    stands at pa and pb."""
    return f"least({na}, {nb}) * 100L >= greatest({na}, {nb}) * {percent}L and least({na} - {pa}, {nb} - {pb}) * {100 + percent}L >= ({na} + {nb}) * {percent}L"


def _leader_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): each set with the leader that it meets in most lists; and, of salted
    lists, the head of each part with the head of the first part."""
    led = lists.where("starts and cid <> leader").where(_fits("size", "lead_size", "pos", "lead_pos", percent))
    most = led.groupBy("cid", "leader").agg(F.count(F.lit(1)).alias("k")).groupBy("cid").agg(F.max_by("leader", F.struct("k", "leader")).alias("b"))
    heads = lists.where("salt >= 0 and cid = leader").select("token", "cid").distinct()
    tops = heads.join(heads.groupBy("token").agg(F.min("cid").alias("b")), "token")
    return most.select(F.col("cid").alias("a"), "b").unionAll(tops.select(F.col("cid").alias("a"), "b")).where("a <> b").distinct()


def _sized(steps: Steps, comps: DataFrame) -> DataFrame:
    """(node, comp, members): components with the number of their sets."""
    comps = packed(comps, comps.count())
    return steps.write_narrow(comps.join(comps.groupBy("comp").agg(F.count(F.lit(1)).alias("members")), "comp"), "join-components")[0]


def _hot(spark: SparkSession, counts: np.ndarray) -> DataFrame:
    """(bucket, salts) of the hot buckets: ORDER_BUCKETS / HOT_MEANS rows at most."""
    salts = _salts(counts)
    hot = np.flatnonzero(salts)
    return spark.createDataFrame(pa.table({"bucket": pa.array(hot, pa.int32()), "salts": pa.array(salts[hot], pa.int32())}), "bucket int, salts int")


def _by_part(tokens: DataFrame, hot: DataFrame) -> DataFrame:
    """``tokens``, a row for each salted part of the token's list: hot lists are then joined
    part by part."""
    x = tokens.withColumn("bucket", F.shiftrightunsigned("token", 48).cast("int")).join(F.broadcast(hot), "bucket", "left")
    return x.withColumn("salt", F.explode(F.when(F.col("salts") > 0, F.sequence(F.lit(0), "salts")).otherwise(F.array(F.lit(-1))))).drop("bucket", "salts")


def _mixed(steps: Steps, lists: DataFrame, comps: DataFrame, hot: DataFrame) -> DataFrame:
    """(token, salt, cid, size, pos, comp, members) of the lists with sets of different
    components."""
    small = F.broadcast(comps) if comps.count() <= BROADCAST_ROWS else comps
    named = lists.join(small, lists.cid == comps.node, "left").select("token", "salt", "cid", "size", "pos", F.coalesce("comp", "cid").alias("comp"), F.coalesce("members", F.lit(1)).alias("members"))
    open_ = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    return steps.write(named.join(_by_part(open_, hot), ["token", "salt"], "left_semi"), "join-mixed")


def _round_pairs(mixed: DataFrame, tried: DataFrame, number: int, percent: int, hot: DataFrame) -> DataFrame:
    """Pairs (a, b): each set with a few sets that lead its lists in this round, of other
    components. A list's leader is drawn by hash, another one in each list and round."""
    draw = F.xxhash64("token", "cid", F.lit(number))
    led = mixed.groupBy("token").agg(F.max_by(F.struct("cid", "size", "pos", "comp"), F.struct(draw, "cid")).alias("l"))
    led = led.select("token", F.col("l.cid").alias("b"), F.col("l.size").alias("nb"), F.col("l.pos").alias("pb"), F.col("l.comp").alias("cb"))
    pairs = mixed.join(_by_part(led, hot), ["token", "salt"]).where("comp <> cb").where(_fits("size", "nb", "pos", "pb", percent)).groupBy(F.col("cid").alias("a"), "b").agg(F.count(F.lit(1)).alias("k"))
    fresh = pairs.join(_unordered(tried), ["a", "b"], "left_anti")
    # A set has no more leaders than its prefix has elements, so the ranking is of small groups.
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("k"), "b"))
    return fresh.withColumn("r", rank).where(F.col("r") <= ROUND_LEADERS).select("a", "b")


def _crowded(steps: Steps, mixed: DataFrame) -> DataFrame:
    """(token, comps, k, x): the lists of more than CROWD components; x tells their sets apart."""
    by = mixed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("cid")).alias("x"))
    lists = by.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.sum("k").alias("k"), F.bit_xor("x").alias("x"))
    return steps.write(lists.where(F.col("comps") > CROWD), "join-crowded")


def spanning_links(first: list[np.ndarray], second: list[np.ndarray] | None, comps: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of similar sets of two blocks (or of one) that join what is not joined yet: sets of
    one component are, and so is what earlier pairs have joined. ``comps`` has those of the first
    block and then of the second; so have the numbers of the pairs."""
    _, group = np.unique(comps, return_inverse=True)
    up = list(range(int(group.max(initial=-1)) + 1))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    out, shift = [], len(first) if second is not None else 0
    for k, similar in answers(first, first if second is None else second, percent):
        for m in similar.tolist():
            a, b = top(int(group[k + shift])), top(int(group[m]))
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((k + shift, m))
    return out


def _crowd_links(steps: Steps, mixed: DataFrame, crowded: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, hot: DataFrame) -> DataFrame:
    """Links (a, b) that join the sets of crowded lists as far as they are similar: a task takes two
    blocks of a list and gives fewer links than it has sets."""
    lists = crowded.groupBy("k", "comps", "x").agg(F.min("token").alias("token")).select("token")
    held = mixed.join(_by_part(lists, hot), ["token", "salt"]).select("token", F.col("cid").alias("sig"), "comp").distinct()
    x = steps.write(held.join(classes.select("sig", "n"), "sig"), "join-crowd")
    size = x.groupBy("token").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = x.join(size, "token").withColumn("block", F.pmod(F.xxhash64("sig"), "blocks").cast("int"))
    wanted = steps.write(x.select("sig").distinct(), "join-crowd-sets")
    texts = _texts(steps, wanted, wanted.count(), docs, classes)
    rows = dealt.select("token", "sig", "comp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).join(texts, "sig")
    rows = rows.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sig", "comp", "text")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sets = tb.shingle_sets(*tb.flat(group.column("text")), words)
        block, i, j = group.column("block").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        at, rest = np.flatnonzero(block == i), np.flatnonzero(block != i)
        order, pairs = np.concatenate((at, rest)), []
        if len(at) and (i == j or len(rest)):
            pairs = spanning_links([sets[k] for k in at], None if i == j else [sets[k] for k in rest], group.column("comp").to_numpy()[order], percent)
        sigs = group.column("sig").to_numpy()[order]
        return pa.table({"a": pa.array(sigs[[a for a, _ in pairs]], pa.int64()), "b": pa.array(sigs[[b for _, b in pairs]], pa.int64())})

    return rows.groupBy("token", "i", "j").applyInArrow(run, "a long, b long")


def _asks(steps: Steps, mixed: DataFrame, percent: int, hot: DataFrame) -> DataFrame:
    """(a, holder, members): sets and the components, no smaller than their own, that may hold
    a set similar to them. A list is taken by component, not by set."""
    # Sizes of similar sets are in the same block or the next; other blocks are skipped.
    block = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent + 0.01))).cast("int")
    held = mixed.withColumn("g", block).groupBy("token", "g", F.col("comp").alias("holder"), F.col("members").alias("mh")).agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.min("pos").alias("ph"))
    x = mixed.select("token", "salt", F.explode(F.array(block - 1, block, block + 1)).alias("g"), F.col("cid").alias("a"), F.col("size").alias("na"), F.col("pos").alias("pa"), "comp", "members")
    fits = F.expr(
        "comp <> holder and (members < mh or members = mh and comp < holder)"
        f" and hi * 100L >= na * {percent}L and na * 100L >= lo * {percent}L"
        f" and least(na - pa, hi - ph) * {100 + percent}L >= (na + lo) * {percent}L"
    )
    return steps.write(x.join(_by_part(held, hot), ["token", "salt", "g"]).where(fits).select("a", "holder", F.col("mh").alias("members")).distinct(), "join-asks")


def _pairs_of(asks: DataFrame, sized: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs (a, b) of asks of small components, without those tried before."""
    some = asks.join(sized.select(F.col("comp").alias("holder"), F.col("node").alias("b")), "holder", "left").select("a", F.coalesce("b", "holder").alias("b"))
    return some.where("a <> b").distinct().join(_unordered(tried), ["a", "b"], "left_anti")


def answers(members: list[np.ndarray], askers: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(asker, members) for every asker that members are similar to, with all of them.

    The members' index lists stand in order of set size, so an asker's lists are entered and
    left at the positions of the sizes it can be similar to. Askers that are much alike stand
    together: the overlaps of one follow from those of the one before by the lists of the
    elements in which they differ.
    """
    by_size = np.array(sorted(range(len(members)), key=lambda k: len(members[k])), np.int64)
    n = np.array([len(members[k]) for k in by_size])
    tokens, inverse = np.unique(np.concatenate([members[k] for k in by_size]), return_inverse=True)
    index = np.sort(inverse.astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n))

    def overlaps(s: np.ndarray, lo: int, hi: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        at = at[tokens[at] == s] * len(n)
        begin, end = np.searchsorted(index, at + lo), np.searchsorted(index, at + hi)
        many = end - begin
        rows = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.bincount(index[rows] % len(n), minlength=len(n))

    before: tuple | None = None
    for k in sorted((k for k in range(len(askers)) if len(askers[k])), key=lambda k: askers[k][:2].tolist()):
        s = askers[k]
        lo = int(np.searchsorted(n * 100, len(s) * percent, side="left"))
        hi = int(np.searchsorted(n * percent, len(s) * 100, side="right"))
        if lo >= hi:
            continue
        count = None
        if before is not None and before[1] <= lo and before[2] >= hi:
            gone, come = np.setdiff1d(before[0], s, assume_unique=True), np.setdiff1d(s, before[0], assume_unique=True)
            if len(gone) + len(come) < len(s):
                lo, hi = before[1], before[2]
                count = before[3] + overlaps(come, lo, hi) - overlaps(gone, lo, hi)
        if count is None:
            count = overlaps(s, lo, hi)
        before = (s, lo, hi, count)
        similar = np.flatnonzero(count * (100 + percent) >= (n + len(s)) * percent)
        similar = similar[(similar >= lo) & (similar < hi)]
        if len(similar):
            yield k, by_size[similar]


def _ask_blocks(steps: Steps, asks: DataFrame, sized: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b), one at most for each asker and block, of asks of large components.

    A component's sets are dealt into blocks by hash, its askers too; a task sees one block
    of each, so that neither a component nor its askers are ever in one place.
    """
    holders = asks.groupBy("holder").agg(F.max("members").alias("m"), F.count(F.lit(1)).alias("z"))
    holders = holders.select("holder", F.ceil(F.col("m") / BLOCK_SETS).cast("int").alias("mbs"), F.ceil(F.col("z") / BLOCK_SETS).cast("int").alias("zbs"))

    def each(c: str):
        return F.explode(F.sequence(F.lit(0), F.col(c) - 1))

    def dealt(c: str, n: str):
        return F.pmod(F.xxhash64(c), F.col(n)).cast("int")

    members = sized.join(holders, sized.comp == holders.holder).select("holder", F.col("node").alias("sig"), dealt("node", "mbs").alias("mb"), each("zbs").alias("zb"))
    askers = asks.join(holders, "holder").select("holder", F.col("a").alias("sig"), dealt("a", "zbs").alias("zb"), each("mbs").alias("mb"))
    every = steps.write(members.select("sig").unionAll(askers.select("sig")).distinct(), "join-blocks")
    texts = _texts(steps, every, every.count(), docs, classes)
    left, right = members.join(texts, "sig"), askers.join(texts, "sig")
    right = right.select(*(F.col(c).alias(f"{c}_z") for c in ("holder", "mb", "zb", "sig", "text")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a: list[int] = []
        b: list[int] = []
        if left.num_rows and right.num_rows:
            sets = [tb.shingle_sets(*tb.flat(x), words) for x in (left.column("text"), right.column("text_z"))]
            for z, m in answers(*sets, percent):
                a.append(right.column("sig_z")[z].as_py())
                b.append(left.column("sig")[int(m[0])].as_py())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    key = ["holder", "mb", "zb"]
    return left.groupBy(*key).cogroup(right.groupBy(*(f"{c}_z" for c in key))).applyInArrow(run, "a long, b long")


def weighted_links(first: list[np.ndarray], second: list[np.ndarray] | None, w1: np.ndarray, w2: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray | None]:
    """For the sets of two blocks (or of one, against each other) the weight of the sets that
    they are similar to."""
    one = np.zeros(len(first), np.int64)
    if second is None:
        for k, similar in answers(first, first, percent):
            one[k] += w1[similar].sum() - w1[k]  # a set is similar to itself
        return one, None
    two = np.zeros(len(second), np.int64)
    for k, similar in answers(first, second, percent):
        two[k] += w1[similar].sum()
        one[similar] += w2[k]
    return one, two


def count_links(steps: Steps, comps: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, links): for each set of a component of two or more the number of rows with another
    set that is similar. ``comps`` has node, comp; ``classes`` sig, rep, n_copies, n."""
    x = comps.join(classes.select(F.col("sig").alias("node"), "n", "n_copies"), "node")
    size = x.groupBy("comp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = steps.write(x.join(size, "comp").select("comp", F.col("node").alias("sig"), "n_copies", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")), "join-dealt")
    if not (many := dealt.count()):
        return _empty(docs, "sig long, links long")
    texts = _texts(steps, dealt.select("sig"), many, docs, classes)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = dealt.select("comp", "sig", "n_copies", "block", other.alias("other")).join(texts, "sig")
    rows = rows.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sig", "n_copies", "text")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sets = tb.shingle_sets(*tb.flat(group.column("text")), words)
        weight, block, i = group.column("n_copies").to_numpy(), group.column("block").to_numpy(), group.column("i")[0].as_py()
        at, rest = np.flatnonzero(block == i), np.flatnonzero(block != i)
        links = np.zeros(len(sets), np.int64)
        if len(at) and (len(rest) or group.column("j")[0].as_py() == i):
            pair = ([sets[k] for k in rest], weight[rest]) if len(rest) else (None, None)
            links[at], two = weighted_links([sets[k] for k in at], pair[0], weight[at], pair[1], percent)
            if two is not None:
                links[rest] = two
        return pa.table({"sig": group.column("sig"), "links": pa.array(links)})

    counted = rows.groupBy("comp", "i", "j").applyInArrow(run, "sig long, links long")
    return counted.groupBy("sig").agg(F.sum("links").alias("links"))


def _derived(pairs: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """``pairs`` with ``sure``: true or false where a leader's overlaps decide, else null."""
    by = done.select(F.col("a").alias("k"), F.col("b").alias("leader"), "o", F.col("nb").alias("nl"))
    # Of a's leaders the nearest one: a row for each pair, whatever the number of leaders.
    near = by.groupBy("k").agg(F.max_by(F.struct("leader", "o", "nl"), F.struct("o", "leader")).alias("l")).select(F.col("k").alias("a"), "l.leader", F.col("l.o").alias("oa"), "l.nl")
    p = pairs.join(near, "a").join(by.select(F.col("k").alias("b"), "leader", F.col("o").alias("ob")), ["b", "leader"])
    need = (F.col("na") + F.col("nb")) * percent
    low = (F.col("oa") + F.col("ob") - F.col("nl")) * (100 + percent) >= need
    high = (F.least("oa", "ob") + F.least(F.col("na") - F.col("oa"), F.col("nb") - F.col("ob"))) * (100 + percent) >= need
    sure = p.groupBy("a", "b").agg(F.max(low).alias("low"), F.min(high).alias("high")).where("low or not high").select("a", "b", F.col("low").alias("sure"))
    return pairs.join(sure, ["a", "b"], "left")


def join_components(docs: DataFrame, words: int = WORDS, percent: int = MIN_PERCENT, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False, counted: bool = False) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, n_shingles, component_id, n_copies``; with
    ``counted`` also ``n_links``, the number of other rows it links with; with ``keyed`` also ``row_key`` and ``component``, a number that a component has even without ids
    (null for a row without shingles).

    Texts link when 100 x intersection >= percent x union of their shingle sets;
    ``component_id`` is the smallest id reachable by links, ``n_copies`` the number of rows
    with the same set.

    * A null or empty text, or one of white space, has no shingles and links with nothing.
    * A text of fewer than ``words`` words is one shingle, its whole sequence.
    * Repeated rows have equal sets and so one component. Rows that share an id but not the
      text are compared by their own texts. Ids can be of any type that has an order. A null
      id never is a component's id unless no member has another. Other columns are left out.
      Empty tables give empty tables.
    * Sets and shingles are told apart by 64-bit hashes.
    """
    steps = Steps()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", row_key(F.col("id"), F.col("text")))
    first = write_through(_sets_pass(rows, words), "join-sets")
    sets = first.where("block is null").select("id", "key", "n", "sig")
    classes = write_through(sets.where("n > 0").groupBy("sig").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.max("n").alias("n")), "join-classes")
    counts = _order(first)
    hot = _hot(docs.sparkSession, counts)
    lists = steps.write(_lists(_prefix_rows(rows, counts, words, percent), percent), "join-lists")
    prefixes = steps.write(_prefix_arrays(lists), "join-prefixes")
    starts, listed = lists.where("starts"), prefixes.count()
    tried, _ = steps.write_narrow(_leader_pairs(lists, percent), "join-pairs")
    links, done, _ = _settle(steps, tried, prefixes, None, rows, classes, words, percent)
    sized, number = _sized(steps, components(steps, links)), 0
    mixed = _mixed(steps, starts, sized, hot)
    while True:
        number += 1
        pairs, _ = steps.write_narrow(_round_pairs(mixed, tried, number, percent, hot), "join-round")
        found, done, asked = _settle(steps, pairs, prefixes, done, rows, classes, words, percent)
        tried, links = tried.unionAll(pairs), links.unionAll(found)
        if not asked or not (linked := found.count()):
            break
        sized = _sized(steps, components(steps, links))
        before, mixed = mixed, _mixed(steps, mixed.drop("comp", "members"), sized, hot)
        steps.drop(before)
        # Another round pays if this one linked a good share of what it looked at, and of all.
        if linked * ROUND_YIELD < asked or linked * ROUND_SHARE < listed:
            break
    crowded = _crowded(steps, mixed)
    if not crowded.isEmpty():
        links = links.unionAll(steps.write(_crowd_links(steps, mixed, crowded, rows, classes, words, percent, hot), "join-crowd-links"))
        mixed = steps.write(mixed.join(_by_part(crowded.select("token"), hot), ["token", "salt"], "left_anti"), "join-mixed")
    asks = _asks(steps, mixed, percent, hot)
    pairs, _ = steps.write_narrow(_pairs_of(asks.where(f"members <= {SMALL}"), sized, tried), "join-last")
    found, _, _ = _settle(steps, pairs, prefixes, done, rows, classes, words, percent)
    links = links.unionAll(found)
    if (large := asks.where(f"members > {SMALL}")).count():
        links = links.unionAll(_ask_blocks(steps, large, sized, rows, classes, words, percent))
    comps = write_through(components(steps, links), "join-found")
    steps.drop_all()
    named = classes.join(comps, classes.sig == comps.node, "left").select("sig", "n_copies", F.coalesce("comp", "sig").alias("comp"))
    if counted:
        linked = write_through(count_links(steps, comps, classes, rows, words, percent), "join-links-of")
        steps.drop_all()
        named = named.join(linked, "sig", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).drop("links")
    low = sets.where("n > 0 and id is not null").groupBy("sig").agg(F.min("id").alias("low"))
    tops = named.join(low, "sig", "left").groupBy("comp").agg(F.min("low").alias("component_id"))
    known = named.join(tops, "comp").select("sig", "n_copies", *(["n_links"] if counted else []), "component_id", "comp")
    more = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if counted else []
    more += [F.col("key").alias("row_key"), F.col("comp").alias("component")] if keyed else []
    return sets.join(known, (sets.sig == known.sig) & (sets.n > 0), "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        *more,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``join_components`` over all documents, with the number of links of each."""
    return join_components(table(spark, sf_dir, "documents"), counted=True)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b, o = x.n AND o = y.n AS equal FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 175 * o >= 75 * (x.n + y.n)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
e AS (SELECT a, count(*) FILTER (WHERE equal) AS k, count(*) AS m FROM l GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, coalesce(k, 0)::BIGINT + 1 AS n_copies, coalesce(m, 0)::BIGINT AS n_links
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.a = w.doc_id LEFT JOIN e ON e.a = w.doc_id
"""
