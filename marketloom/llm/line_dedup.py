"""Line deduplication across documents, in DataFrame functions.

Lines are exploded, normalised and hashed (128 bits); documents are counted by hash with
partial aggregation, so that a line in every document costs a row a task. Hashes over the
threshold select the positions to drop, which come back to their document as one small
array; the text itself is shuffled once, by its own row key, and is reassembled by position
from the runs between dropped lines, in time linear in the number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import textbatch as tb
from marketloom.llm.scratch import table, write_through

#: The white space that is stripped: space and U+0009 to U+000D.
STRIP = " \t\n\x0b\x0c\r"
MIN_DOCS = 10
MIN_CHARS = 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. For a text of ASCII alone ``lower`` does that faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_keys(text: Column) -> Column:
    """The normalised lines of a text, in order."""
    return F.transform(F.split(fold_ascii(text), "\n", -1), lambda x: F.btrim(x, F.lit(STRIP)))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop every line whose key is in at least ``min_docs`` documents.

    Returns the columns of ``docs``, with the text that is kept, and the columns ``n_lines``
    (before dropping) and ``n_dropped``; columns of ``docs`` with those two names give way.

    * A null or empty text is one empty line; the kept text is then empty.
    * A key of fewer than ``min_chars`` code points is never dropped.
    * A document is a value of ``id_col``; repeated rows of one id count once, and rows with a
      null id count as one document. Each row gets its own result.
    * When all lines go, the text is empty. An empty table gives an empty table.
    """
    docs = docs.drop("n_lines", "n_dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("\x01")), text)))
    lines = (
        docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("\x01")).alias("d"), row.alias("r"), F.posexplode(line_keys(text)).alias("p", "k"))
        .where(F.char_length("k") >= min_chars)
        .select("d", "r", "p", F.unhex(F.md5("k")).alias("h"))
    )
    common = lines.select("h", "d").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h")
    # Written, its size is known: Spark then broadcasts it if it is small, and else shuffles
    # both sides as they are, so that it can split the rows of a very common line.
    common = write_through(common, "common-lines")
    gone = lines.select("r", "p", "h").join(common, "h", "left_semi").groupBy("r").agg(F.array_sort(F.collect_set("p")).alias("__gone"))
    parts = F.split(text, "\n", -1)
    key, left, every = (tb.free(c, docs.columns) for c in ("__r", "__gone", "__lines"))
    out = (
        docs.withColumn(key, row)
        .join(gone.select(F.col("r").alias(key), F.col("__gone").alias(left)), key, "left")
        .withColumn(left, F.coalesce(left, F.array().cast("array<int>")))
        .withColumn(every, parts)
    )
    # Run k lies between the dropped positions k - 1 and k.
    runs = F.expr(
        f"transform(sequence(0, size({left})), k -> slice({every},"
        f" if(k = 0, 0, {left}[k - 1] + 1) + 1,"
        f" if(k = size({left}), size({every}), {left}[k]) - if(k = 0, 0, {left}[k - 1] + 1)))"
    )
    kept = F.when(F.size(left) == 0, text).otherwise(F.array_join(F.flatten(runs), "\n"))
    return (
        out.withColumn(text_col, kept)
        .withColumn("n_lines", F.size(every).cast("long"))
        .withColumn("n_dropped", F.size(left).cast("long"))
        .drop(key, left, every)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dedup_lines`` over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, n, p, ln, translate(regexp_replace(ln, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, len(l) AS n, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS ln
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
common AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, c.k IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, max(n)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(ln, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
