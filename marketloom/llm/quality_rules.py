"""Quality rules by repetition coverage.

One pass without a shuffle. Words of an Arrow batch are hashed together in numpy; for each
document rolling hashes of several n-gram lengths are sorted, windows that repeat an earlier
window are marked, and the characters of the words under marked windows are added up, each
word once however many windows cover it. Lines are compared as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.llm import textbatch as tb
from marketloom.llm.scratch import table

#: Fixed values, as published for web text: of the word characters, at most so many per cent
#: inside repeats of n-grams, by n; inside repeated lines; symbols per hundred words.
MAX_NGRAM_PERCENT = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
MAX_LINE_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_WS = b" \t\n\x0b\x0c\r"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup{n}_chars" for n in MAX_NGRAM_PERCENT)]
ADDED = [*COUNTS, "base_failed", "kept"]


def _covered(grams: np.ndarray, words: int, n: int, first_too: bool) -> np.ndarray:
    """Which words lie in an n-word window that repeats an earlier one (or is repeated)."""
    cover = np.zeros(words + 1, np.int64)
    if len(grams) > 1:
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        again = np.zeros(len(grams), bool)
        again[order[1:][same]] = True
        if first_too:
            again[order[:-1][same]] = True
        at = np.flatnonzero(again)
        cover[at] += 1
        cover[at + n] -= 1
    return np.cumsum(cover[:-1]) > 0


def measure(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The COUNTS of each document, a row each."""
    starts, ends, woff = tb.word_bounds(data, offs)
    rolling = tb.Rolling(tb.word_hashes(data, starts, ends, folded=False))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = points[ends] - points[starts]
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    out = np.zeros((len(offs) - 1, len(COUNTS)), np.int64)
    for d in range(len(offs) - 1):
        a, b = woff[d], woff[d + 1]
        c = chars[a:b]
        seen: set[bytes] = set()
        dup_lines = dup_line_chars = 0
        for line in data[offs[d] : offs[d + 1]].tobytes().split(b"\n"):
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(line.translate(None, _WS).decode("utf-8", "replace"))
            elif line.strip(_WS):
                seen.add(line)
        out[d] = [
            b - a, c.sum(), symbols[offs[d + 1]] - symbols[offs[d]], dup_lines,
            _covered(rolling.runs(a, b, 3), b - a, 3, True).sum(), dup_line_chars, *(c[_covered(rolling.runs(a, b, n), b - a, n, False)].sum() for n in MAX_NGRAM_PERCENT),
        ]
    return out


def quality_rules(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or ``carry`` of them) with ``ADDED``: counts and verdict.

    ``base_failed``: under 50 words, or over half of them in repeated 3-word windows.
    ``kept``: not failed, and no share over its limit (characters in repeats of 5- to 10-word
    windows and of lines, without first occurrences; symbols to words).

    * A null or empty text has no words: all counts 0, base_failed, not kept.
    * Rows are judged alone: repeated rows get equal results, ties don't arise.
    * Columns of ``docs`` that are named like an added one give way. An empty table gives an
      empty table. A very long text is worked on alone; memory is in proportion to it.
    """
    keep = [c for c in (carry if carry is not None else docs.columns) if c.lower() not in ADDED]
    hide = tb.free("__text_in", keep)
    frame = docs.select(*keep, F.col(text_col).alias(hide))
    schema = T.StructType([frame.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tb.slices(whole, hide):
                counts = measure(*tb.flat(batch.column(hide)))
                cols = [batch.column(c) for c in keep] + [pa.array(counts[:, k]) for k in range(len(COUNTS))]
                yield pa.RecordBatch.from_arrays(cols, [*keep, *COUNTS])

    counted = frame.mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    over = (F.col("n_symbols") * 100 > F.col("n_words") * MAX_SYMBOL_PERCENT) | (F.col("dup_line_chars") * 100 > F.col("word_chars") * MAX_LINE_PERCENT)
    for n, most in MAX_NGRAM_PERCENT.items():
        over = over | (F.col(f"dup{n}_chars") * 100 > F.col("word_chars") * most)
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quality_rules`` over all documents."""
    return quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])


def _sql() -> str:
    lengths = list(MAX_NGRAM_PERCENT)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id, l ORDER BY p) AS k FROM (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS p FROM d)),
dl AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) AS dup_line_chars
       FROM lines WHERE k > 1 AND regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word, len(ws) AS n_words FROM d),
n AS (SELECT unnest([3, {", ".join(map(str, lengths))}]) AS n),
g AS (SELECT w.doc_id, i, n, length(word) AS c, CASE WHEN i + n - 1 <= n_words THEN list_aggregate(ws[i:i + n - 1], 'string_agg', ' ') END AS gram
      FROM w JOIN d USING (doc_id) CROSS JOIN n),
m AS (SELECT *, CASE WHEN gram IS NULL THEN 0 WHEN n = 3 THEN (count(*) OVER (PARTITION BY doc_id, n, gram) > 1)::INT
      ELSE (row_number() OVER (PARTITION BY doc_id, n, gram ORDER BY i) > 1)::INT END AS again FROM g),
f AS (SELECT doc_id, i, n, c, sum(again) OVER (PARTITION BY doc_id, n ORDER BY i) AS run FROM m),
x AS (SELECT doc_id, n, c, run - coalesce(lag(run, n) OVER (PARTITION BY doc_id, n ORDER BY i), 0) > 0 AS covered FROM f),
y AS (SELECT doc_id, {", ".join(f"coalesce(sum(c) FILTER (WHERE n = {k} AND covered), 0)::BIGINT AS dup{k}_chars" for k in lengths)},
      count(*) FILTER (WHERE n = 3 AND covered) AS n_repeat_words FROM x GROUP BY doc_id),
z AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')), 0)::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
      {", ".join(f"coalesce(dup{k}_chars, 0)::BIGINT AS dup{k}_chars" for k in lengths)}
      FROM d LEFT JOIN dl USING (doc_id) LEFT JOIN y USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words OR 100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words
    OR 100 * dup_line_chars > {MAX_LINE_PERCENT} * word_chars {" ".join(f"OR 100 * dup{k}_chars > {v} * word_chars" for k, v in MAX_NGRAM_PERCENT.items())}) AS kept
FROM z
"""


SQL = _sql()
