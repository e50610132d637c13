"""Benchmark decontamination with an FM-index of every training shard.

A shard is a slice of a partition's documents. Its words become a sequence of benchmark
vocabulary ids; a word that no benchmark item has is a break, as is the end of a document,
and runs too short to hold any phrase are left out. The suffix array of that sequence
(prefix doubling in numpy) gives its Burrows-Wheeler transform, kept as a wavelet matrix.
All phrases are searched backwards together, a step being two ranks; occurrences are located
from suffix positions sampled every few symbols, and overlapping spans are merged.

Documents never move: only the benchmark goes to the tasks, as word ids and starts of phrases. A
shard is indexed once, over the vocabulary of all items, and the blocks of the benchmark are
searched in it one after another by the same worker. A benchmark beyond ``PASS_BYTES`` is searched
in several passes, each written before the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm import textbatch as tb
from marketloom.llm.scratch import table, write_through

WINDOW = 10
#: Bytes of benchmark text that are searched together (some 60 MB of phrases in a worker), and
#: that are sent to the tasks together (some 100 MB on the driver and in a worker).
BLOCK_BYTES, PASS_BYTES = 1 << 20, 32 << 20
SAMPLE = 8

_NOT_WORD = np.ones(256, bool)
_NOT_WORD[0x30:0x3A] = False
_NOT_WORD[0x41:0x5B] = False
_NOT_WORD[0x61:0x7B] = False
_NOT_WORD[0x80:] = False


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, offsets, word starts, ends, words by document, word hashes (A-Z as a-z)."""
    data, offs = tb.flat(column)
    starts, ends, woff = tb.word_bounds(data, offs, _NOT_WORD)
    bare = np.where(_NOT_WORD[data], np.uint8(0x20), data)
    return data, offs, starts, ends, woff, tb.word_hashes(bare, starts, ends)


class Phrases:
    """Distinct phrases of items, in blocks over one vocabulary.

    A block has the items' words as ids (1 and up) in a row, for every distinct phrase its
    place and length, and the items that have it.
    """

    def __init__(self, ids: list, texts: list, window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
        self.window, self.shortest = window, window
        groups: list[list[int]] = []
        size = block_bytes
        for k, t in enumerate(texts):
            if size >= block_bytes:
                groups.append([])
                size = 0
            groups[-1].append(k)
            size += len(t)
        hashed = []
        for group in groups:
            *_, woff, hashes = _words(pa.array([texts[k] for k in group], pa.string()))
            hashed.append(([str(ids[k]) for k in group], woff, hashes))
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for *_, h in hashed)]))
        self.blocks = [self._block(names, woff, (np.searchsorted(self.vocabulary, h) + 1).astype(np.int32)) for names, woff, h in hashed]

    def _block(self, names: list[str], woff: np.ndarray, seq: np.ndarray) -> tuple:
        found: dict[bytes, int] = {}
        start, length, having = [], [], []
        for item, (a, b) in enumerate(zip(woff[:-1].tolist(), woff[1:].tolist(), strict=True)):
            for at in range(a, max(b - self.window, a) + 1) if b > a else ():
                end = min(at + self.window, b)
                k = found.setdefault(seq[at:end].tobytes(), len(start))
                if k == len(start):
                    start.append(at)
                    length.append(end - at)
                    having.append([item])
                elif having[k][-1] != item:
                    having[k].append(item)
        self.shortest = min([self.shortest, *length])
        many = np.array([len(x) for x in having], np.int64)
        items = np.array([i for x in having for i in x], np.int32)
        return names, seq, np.array(start, np.int32), np.array(length, np.int8 if self.window < 128 else np.int64), np.concatenate(([0], np.cumsum(many))), items

    def rows(self, block: tuple) -> tuple[np.ndarray, np.ndarray]:
        """A block's phrases as rows of ids padded with 0, and their lengths."""
        _, seq, start, length, *_ = block
        at = start[:, None].astype(np.int64) + np.arange(self.window)
        inside = np.arange(self.window) < length[:, None]
        return np.where(inside, seq[np.minimum(at, max(len(seq) - 1, 0))] if len(seq) else 0, 0).astype(np.int64), length.astype(np.int64)


def suffix_array(v: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; each round sorts only what is still tied."""
    n = len(v)
    sa = np.argsort(v, kind="stable")
    head = np.concatenate(([True], v[sa[1:]] != v[sa[:-1]]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    tied = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(tied):
        idx = sa[tied]
        ahead = np.where(idx + step < n, rank[np.minimum(idx + step, n - 1)] + 1, 0)
        key = (rank[idx] << 32) | ahead
        order = np.argsort(key, kind="stable")
        idx, key = idx[order], key[order]
        sa[tied] = idx
        head = np.concatenate(([True], key[1:] != key[:-1]))
        rank[idx] = np.maximum.accumulate(np.where(head, tied, 0))
        tied = tied[~(head & np.append(head[1:], True))]
        step *= 2
    return sa


class FMIndex:
    """Of a sequence of symbols 1.. and breaks (0); the sequence ends in a break."""

    def __init__(self, seq: np.ndarray):
        breaks = seq == 0
        n_breaks = int(breaks.sum())
        # Breaks sort before all symbols and differ from each other, so no match crosses one.
        sa = suffix_array(np.where(breaks, np.cumsum(breaks) - 1, seq + n_breaks))
        self.bwt = seq[sa - 1]
        top = int(seq.max()) if len(seq) else 0
        self.first = np.searchsorted(np.sort(seq), np.arange(top + 2))
        self.top, self.n = top, len(seq)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        x = self.bwt
        for bit in reversed(range(max(1, top.bit_length()))):
            ones = (x >> bit) & 1
            count = np.concatenate(([0], np.cumsum(ones))).astype(np.int32)
            self.levels.append((bit, count, len(x) - int(count[-1])))
            x = np.concatenate((x[ones == 0], x[ones == 1]))
        # A sample wherever the text position is a multiple of SAMPLE or follows a break.
        marked = (sa % SAMPLE == 0) | (self.bwt == 0)
        self.marked, self.mark_rank, self.samples = marked, np.cumsum(marked) - 1, sa[marked]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first i symbols of the transform are c."""
        low = np.zeros_like(i)
        for bit, count, zeros in self.levels:
            one = ((c >> bit) & 1) == 1
            i = np.where(one, zeros + count[i], i - count[i])
            low = np.where(one, zeros + count[low], low - count[low])
        return i - low

    def search(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The phrases that occur and their suffix ranges [lo, hi)."""
        which = np.flatnonzero(rows.max(axis=1, initial=0) <= self.top)
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), self.n, np.int64)
        for k in range(rows.shape[1]):
            act = length[which] > k
            c = rows[which[act], length[which[act]] - 1 - k]
            lo[act] = self.first[c] + self.rank(c, lo[act])
            hi[act] = self.first[c] + self.rank(c, hi[act])
            live = lo < hi
            which, lo, hi = which[live], lo[live], hi[live]
        return which, lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking back to the nearest sample."""
        at, steps = at.copy(), np.zeros(len(at), np.int64)
        walk = np.flatnonzero(~self.marked[at])
        while len(walk):
            c = self.bwt[at[walk]]
            at[walk] = self.first[c] + self.rank(c, at[walk])
            steps[walk] += 1
            walk = walk[~self.marked[at[walk]]]
        return self.samples[self.mark_rank[at]] + steps


def _sequence(ids: np.ndarray, woff: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of vocabulary words of at least ``shortest`` words, a break after each, and
    the word number of every symbol."""
    n = len(ids)
    ok = ids > 0
    edge = np.zeros(n + 1, bool)
    edge[woff] = True
    begin = np.flatnonzero(ok & (edge[:-1] | ~np.concatenate(([False], ok[:-1]))))
    end = np.flatnonzero(ok & (edge[1:] | ~np.concatenate((ok[1:], [False])))) + 1
    long = end - begin >= shortest
    begin, end = begin[long], end[long]
    size = end - begin + 1
    base = np.cumsum(size) - size
    word = np.arange(size.sum()) - np.repeat(base - begin, size)
    seq = ids[np.minimum(word, n - 1)] if n else word
    seq[base + size - 1] = 0
    return seq, word


def search_shard(column: pa.Array, phrases: Phrases) -> tuple[np.ndarray, list[list[str]], list[np.ndarray], tuple]:
    """Words by document, items by document, merged spans of word numbers by document."""
    words = _words(column)
    data, offs, starts, ends, woff, hashes = words
    docs = len(offs) - 1
    items: list[set[str]] = [set() for _ in range(docs)]
    cover = np.zeros(len(starts) + 1, np.int64)
    if len(phrases.vocabulary) and len(starts):
        at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
        seq, word = _sequence(np.where(phrases.vocabulary[at] == hashes, at + 1, 0), woff, phrases.shortest)
        index = FMIndex(seq) if len(seq) else None
        for block in phrases.blocks if index else ():
            table_, length = phrases.rows(block)
            which, lo, hi = index.search(table_, length)
            many = hi - lo
            ranks = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
            place, phrase = word[index.locate(ranks)], np.repeat(which, many)
            np.add.at(cover, place, 1)
            np.add.at(cover, place + length[phrase], -1)
            names, *_, first, having = block
            pairs = np.unique(np.stack((np.searchsorted(woff, place, side="right") - 1, phrase), axis=1), axis=0) if len(place) else ()
            for d, p in pairs:
                items[d].update(names[i] for i in having[first[p] : first[p + 1]])
    hit = np.cumsum(cover[:-1]) > 0
    spans = []
    for a, b in zip(woff[:-1], woff[1:], strict=True):
        x = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))
        spans.append(np.stack((np.flatnonzero(x == 1), np.flatnonzero(x == -1)), axis=1))
    return np.diff(woff), [sorted(x) for x in items], spans, words


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
ADDED = ["n_words", "n_hit", "n_items", "item_ids", "spans", "clean_text"]


def _merged(old: list, new: np.ndarray) -> np.ndarray:
    """Union of spans (first, last + 1)."""
    x = sorted([(s["first"], s["last"] + 1) for s in old] + [tuple(s) for s in new.tolist()])
    out: list[list[int]] = []
    for a, b in x:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, np.int64).reshape(-1, 2)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", carry: list[str] | None = None, clean: bool = True, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The columns of ``docs`` (or ``carry`` of them) with what the benchmark items hit.

    Added: ``n_words``, ``n_hit`` (words inside any occurrence of a phrase), ``n_items``,
    ``item_ids`` (strings, sorted), ``spans`` (first and last word of each merged span, from
    0) and, with ``clean``, ``clean_text``: the text without the spans.

    A phrase is ``window`` consecutive words of an item, or all its words if it has fewer.

    * A null or empty text, or one without words, has 0 in all counts and no spans; its
      clean text is as it was. Items without words have no phrase. A null item id counts as
      an item named ``None``. Repeated items count once by id; equal rows are sent once.
    * Rows are judged alone. Columns of ``docs`` that are named like an added one give way.
      Either table may be empty. A very long text is a shard of its own.
    """
    spark = docs.sparkSession
    keep = [c for c in (carry if carry is not None else docs.columns) if c.lower() not in ADDED]
    bench = benchmark.select(F.col(item_col).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).distinct()
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-total // pass_bytes))
    hide = tb.free("__text_in", keep)
    out = docs.select(*keep, F.col(text_col).alias(hide))
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "item_ids": F.array().cast("array<string>"), "spans": F.array().cast(_SPANS), "clean_text": F.lit(None).cast("string")})
    for k in range(passes):
        if k:
            out = write_through(out, "decontaminate-pass")
        rows = (bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k) if passes > 1 else bench).collect()
        sent = spark.sparkContext.broadcast(Phrases([r.i for r in rows], [r.t for r in rows], window, block_bytes))
        last = clean and k == passes - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last, names=tuple(out.columns)) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in tb.slices(whole, hide):
                    n_words, items, spans, (data, offs, starts, ends, woff, _) = search_shard(batch.column(hide), sent.value)
                    old_items, old_spans = batch.column("item_ids").to_pylist(), batch.column("spans").to_pylist()
                    items = [sorted({*a, *b}) if a else b for a, b in zip(old_items, items, strict=True)]
                    spans = [_merged(a, b) if a else b for a, b in zip(old_spans, spans, strict=True)]
                    texts = batch.column(hide)
                    if last and any(map(len, spans)):
                        texts = texts.to_pylist()
                        for d, s in enumerate(spans):
                            if len(s):
                                cut, at, w = [], offs[d], woff[d]
                                for a, b in s:
                                    cut.append(data[at : starts[w + a]].tobytes())
                                    at = ends[w + b - 1]
                                texts[d] = b"".join([*cut, data[at : offs[d + 1]].tobytes()]).decode()
                        texts = pa.array(texts, batch.schema.field(hide).type)
                    new = {
                        "n_words": pa.array(n_words.astype(np.int64)),
                        "item_ids": pa.array(items, batch.schema.field("item_ids").type),
                        "spans": pa.array([[{"first": int(a), "last": int(b) - 1} for a, b in s] for s in spans], batch.schema.field("spans").type),
                        "clean_text": texts if last else batch.column("clean_text"),
                    }
                    yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], list(names))

        out = out.mapInArrow(run, out.schema)
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    out = out.select(*keep, "n_words", hits.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), "item_ids", "spans", "clean_text")
    return out if clean else out.drop("clean_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``decontaminate`` over all documents and all items."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"], clean=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, list_aggregate(ws[i:i + least(len(ws), 10) - 1], 'string_agg', ' ') AS phrase
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, i, n, list_aggregate(ws[i:i + n - 1], 'string_agg', ' ') AS phrase
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) CROSS JOIN lens WHERE i + n - 1 <= len(ws)),
o AS (SELECT DISTINCT g.doc_id, g.i, g.n, p.item_id FROM g JOIN p ON g.phrase = p.phrase AND g.n = p.n),
h AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
