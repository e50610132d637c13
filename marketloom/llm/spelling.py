"""Grouping of spelling variants: words that one edit parts, compared in dense blocks.

Two words differ by one inserted, deleted or replaced code point exactly if their common prefix
and common suffix together reach the longer length m less one. The prefix, cut off at m - 1, lies
in one of a few segments of 0..m-1; whichever it is, both words share all that lies outside that
segment. So a word is dealt once for each segment, and once more as the shorter word of a pair,
by what it has outside; words that meet are rows of padded code-point matrices, left-aligned for
prefixes and right-aligned for suffixes, and are compared block by block in numpy. A pair is
reported only in the segment that its prefix lies in, hence once.

A group of more words than a block is dealt again, position by position: then all but one code
point is shared, so a group has no more words than the alphabet has letters, and no task gets the
square of a large group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.line_dedup import fold_ascii
from marketloom.llm.scratch import table, write_through

#: Runs that are words: Latin letters.
RUN = "[A-Za-zÀ-ÿ]"
MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: One run in so many, by a checksum of document and run, loses a code point.
NOISE = 31
SEGMENTS = 4
#: Words of a group that are compared as they are; more are dealt by position.
GROUP = 1024
#: Cells of a matrix that is held at once.
CELLS = 1 << 22


def counted_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, noise: int = NOISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words (``word``) of all texts with at least ``min_chars`` code points and their number
    (``n``), if at least ``min_count``.

    A-Z are lower-cased. With h the checksum (crc32) of id, colon and run, a run whose h is
    divisible by ``noise`` loses its code point h % length.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(f"{RUN}{{{min_chars},}}"), F.lit(0))).alias("run"),
    )
    runs = runs.select("d", fold_ascii(F.col("run")).alias("run")).select("run", F.crc32(F.concat("d", F.lit(":"), "run")).alias("h"))
    cut = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % noise == 0, short).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _dealt(words: DataFrame) -> DataFrame:
    """Each word for both lengths m it can be compared at and each segment [lo, hi) of prefixes."""
    role = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m"))
    seg = role.select("*", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("k"))
    cut = lambda k: F.floor((F.col("m") - 1) * k / SEGMENTS).cast("int")
    return _keyed(seg.select("word", "n", "m", cut(F.col("k")).alias("lo"), F.when(F.col("k") == SEGMENTS - 1, F.col("m")).otherwise(cut(F.col("k") + 1)).alias("hi")).where("lo < hi"))


def _keyed(dealt: DataFrame) -> DataFrame:
    """With a key of all code points outside the segment.

    A prefix p in [lo, hi) means that ``lo`` leading and m - 1 - p, so at least m - hi, last
    code points are shared.
    """
    left = F.substring("word", F.lit(1), F.col("lo"))
    right = F.expr("right(word, m - hi)")
    return dealt.withColumn("key", F.xxhash64("m", "lo", "hi", left, right))


def _spread(dealt: DataFrame) -> DataFrame:
    """The same rows, one for each position of their segment."""
    each = dealt.select("word", "n", "m", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("lo"))
    return _keyed(each.withColumn("hi", F.col("lo") + 1))


def _matrices(words: list[str], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, left-aligned, and reversed so that their ends are aligned."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    if len(flat) and flat.max() < 256:
        flat = flat.astype(np.uint8)
    row = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left, right = np.zeros((len(words), width), flat.dtype), np.zeros((len(words), width), flat.dtype)
    left[row, at] = flat
    right[row, lengths[row] - 1 - at] = flat
    return left, right


def _blocks(starts: np.ndarray, ends: np.ndarray, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within the groups, in blocks: small groups together by distance of
    rows, large ones as squares of a block of rows against another."""
    few = max(1, CELLS // m)
    size = ends - starts
    small = size <= 32
    first = np.concatenate([np.arange(a, b) for a, b in zip(starts[small], ends[small], strict=True)]) if small.any() else np.zeros(0, np.int64)
    last = np.repeat(ends[small], size[small])
    for step in range(1, 32):
        ok = first + step < last
        first, last = first[ok], last[ok]
        if not len(first):
            break
        for at in range(0, len(first), few):
            yield first[at : at + few], first[at : at + few] + step
    side = max(1, math.isqrt(few))
    for a, b in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
        for x in range(a, b, side):
            for y in range(x, b, side):
                i, j = np.meshgrid(np.arange(x, min(x + side, b)), np.arange(y, min(y + side, b)), indexing="ij")
                ok = i < j if x == y else np.ones(i.shape, bool)
                yield i[ok], j[ok]


def near_in_groups(rows: pa.Table, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, of one length m and sorted by key, that differ by one edit."""
    key, lo, hi = (rows.column(c).to_numpy() for c in ("key", "lo", "hi"))
    words = rows.column("word").to_pylist()
    lengths = pc.utf8_length(rows.column("word")).to_numpy().astype(np.int64)
    left, right = _matrices(words, lengths, m)
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    starts, ends = cuts, np.r_[cuts[1:], len(key)]
    found_a, found_b = [], []
    for i, j in _blocks(starts, ends, m):
        longest = np.maximum(lengths[i], lengths[j])
        ok = (longest == m) & (lo[i] == lo[j]) & (hi[i] == hi[j])
        i, j = i[ok], j[ok]
        prefix = (left[i] != left[j]).argmax(axis=1)
        suffix = (right[i] != right[j]).argmax(axis=1)
        own = np.minimum(prefix, m - 1)
        ok = (prefix + suffix >= m - 1) & (own >= lo[i]) & (own < hi[i])
        found_a.append(i[ok])
        found_b.append(j[ok])
    return np.concatenate([*found_a, np.zeros(0, np.int64)]), np.concatenate([*found_b, np.zeros(0, np.int64)])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs, both ways, of rows that come sorted by m and key."""
    held: pa.Table | None = None

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        m = int(rows.column("m")[0].as_py())
        a, b = near_in_groups(rows, m)
        if len(a):
            one, other = pa.array(np.r_[a, b]), pa.array(np.r_[b, a])
            near = rows.take(other)
            out = pa.table({"word": rows.column("word").take(one), "near": near.column("word"), "near_n": near.column("n")})
            yield from out.combine_chunks().to_batches()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        held = rows
        m, key = rows.column("m").to_numpy(), rows.column("key").to_numpy()
        cuts = np.flatnonzero((m[1:] != m[:-1]) | (key[1:] != key[:-1])) + 1
        at = 0
        while at < len(m):  # whole groups of one length, as many as a matrix may have
            limit = min(int(np.searchsorted(m[at:], m[at], side="right")) + at, at + max(1, CELLS // int(m[at])))
            ends = cuts[(cuts > at) & (cuts <= limit)]
            if len(ends):
                to = int(ends[-1])
            else:  # one group beyond the matrix: it ends at the next cut, or with the input
                later = cuts[cuts > at]
                if not len(later):
                    break
                to = int(later[0])
            yield from done(rows.slice(at, to - at))
            at = to
        held = rows.slice(at)
    if held is not None and held.num_rows:
        yield from done(held)


def near_words(words: DataFrame) -> DataFrame:
    """All pairs of distinct words (``word``, ``n``) that differ by one edit, both ways, as
    ``word``, ``near`` and ``near_n``."""
    dealt = _dealt(words)
    large = write_through(dealt.groupBy("key").count().where(F.col("count") > GROUP).select("key"), "spelling-large")
    plain = dealt.join(large, "key", "left_anti")
    if large.isEmpty():
        every = dealt
    else:
        every = plain.unionByName(_spread(dealt.join(large, "key", "left_semi")))
    pairs = every.select("key", "m", "lo", "hi", "word", "n").repartition("key").sortWithinPartitions("m", "key")
    return pairs.mapInArrow(_compare, "word string, near string, near_n long")


def _roots(forms: DataFrame, largest: int) -> DataFrame:
    """The end of each word's chain of forms, by pointer jumping.

    Each form occurs ``RATIO`` times as often as its word, so a chain has few links.
    """
    links, n = 1, MIN_COUNT * RATIO
    while n * RATIO <= largest:
        links, n = links + 1, n * RATIO
    out = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(links))):
        step = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = write_through(out.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return out


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, noise: int = NOISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each counted word with the more frequent spelling it stands for.

    Returns ``word``, ``form`` (the near word of largest n, ties: smallest in code-point order,
    if that n is at least ``ratio`` times the word's; else null), ``root`` (the end of the chain
    of forms, the word itself if it has none), ``n``, ``n_near`` and ``form_n``.

    * A null or empty text has no words; a null id counts as an empty one.
    * Repeated rows count as often as they stand. An empty table gives no rows.
    * ``ratio`` is at least 2, so that chains end. Other columns of ``docs`` play no part.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    words = write_through(counted_words(docs, min_chars, min_count, noise, id_col, text_col), "spelling-words")
    every = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    found = near_words(words).select("word", F.lit(None).cast("long").alias("n"), "near", "near_n")
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))))
    merged = every.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    better = -F.col("best.n") >= ratio * F.col("n")
    out = merged.select("word", F.when(better, F.col("best.w")).alias("form"), "n", "n_near", F.when(better, -F.col("best.n")).alias("form_n"))
    out = write_through(out, "spelling-forms")
    largest = words.agg(F.max("n")).first()[0] or 0
    roots = _roots(out.where("form IS NOT NULL"), largest)
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spelling_variants`` over all documents."""
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The checksum is built from its rule: a table of 256 remainders, then a fold over the bytes.
SQL = r"""
WITH RECURSIVE rem(i, c, k) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM rem WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM rem WHERE k = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(x), 2), lambda p: ('0x' || x[p:p + 1])::BIGINT)),
         lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM coded, tab),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS p FROM words)),
near AS (
  SELECT a.word, b.word AS w, b.n FROM cuts a JOIN cuts b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(w, (-n, encode(w))) AS w, max(n) AS m FROM near GROUP BY word),
forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * words.n THEN w END AS form, CASE WHEN m >= 10 * words.n THEN m END AS form_n
  FROM words LEFT JOIN best ON words.word = best.word),
chain(word, place, next) AS (
  SELECT word, word, form FROM forms
  UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.place AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM forms f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""
