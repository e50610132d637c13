"""From raw documents to a training mix, in five stages.

Quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, mixing. Each
stage takes what its predecessor kept. All but the last return the columns of documents;
the last returns the mix: how many words of which document it takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.decontaminate import decontaminate
from marketloom.llm.line_dedup import dedup_lines
from marketloom.llm.mixing import mix_sources
from marketloom.llm.ngram_join import join_components, row_key
from marketloom.llm.quality_rules import quality_rules
from marketloom.llm.scratch import table, write_through

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with ``text`` from that column and ``n_chars`` to match."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.char_length(text).cast("long").alias("n_chars"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null and empty texts fail the base rules and go."""
    return quality_rules(docs.select(*COLUMNS).withColumn("__text", F.col("text")), text_col="__text", carry=COLUMNS).where("kept").select(*COLUMNS)


def apply_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share. A document whose lines all
    go stays with an empty text; a null text becomes an empty one."""
    return _with_text(dedup_lines(docs.select(*COLUMNS)), "text")


def apply_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that with the smallest id, of rows that share this id one
    text, and of repeated rows one. Rows without an id stay only where no other row of their
    component does. Of rows without shingles one of each id stays, and all without an id."""
    docs = docs.select(*COLUMNS)
    found = join_components(docs, keyed=True)
    # Rows without an id come last.
    best = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("r")).select("r.row_key")
    bare = found.where("component is null and doc_id is not null").groupBy("doc_id").agg(F.min("row_key").alias("row_key")).select("row_key")
    rows = docs.withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    one = rows.join(best.unionByName(bare), "row_key", "left_semi").withColumn("__k", F.row_number().over(Window.partitionBy("row_key").orderBy("source", "lang", "n_chars")))
    nameless = found.where("component is null and doc_id is null").select("row_key").distinct()
    return one.where("__k = 1").select(*COLUMNS).unionByName(rows.join(nameless, "row_key", "left_semi").select(*COLUMNS))


def apply_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the spans of words that benchmark phrases occupy."""
    bench = table(spark, sf_dir, "benchmark")
    found = decontaminate(docs.select(*COLUMNS).withColumn("__text", F.col("text")), bench, text_col="__text", carry=COLUMNS)
    return found.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.when(F.size("spans") > 0, F.char_length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def apply_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each document of which it takes a word or more."""
    return mix_sources(docs).where("taken > 0")


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("line_dedup", apply_line_dedup),
    ("ngram_join", apply_ngram_join),
    ("decontaminate", apply_decontamination),
    ("mix_sources", apply_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_through(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def _oracle() -> str:
    """The stages' SQL, chained by views that stand in for the table documents."""
    from marketloom.llm import decontaminate as m9
    from marketloom.llm import line_dedup as m3
    from marketloom.llm import mixing as m10
    from marketloom.llm import ngram_join as m5
    from marketloom.llm import quality_rules as m6

    def on(sql: str, docs: str) -> str:
        return sql.strip().replace("FROM documents", f"FROM {docs}")

    lines = on(m3.SQL, "s6").rpartition("SELECT doc_id, max(n)")[0]
    spans = on(m9.SQL, "s5").rpartition("h AS (SELECT doc_id, count(DISTINCT w)")[0].rstrip().rstrip(",")
    return rf"""
WITH s6 AS MATERIALIZED (SELECT d.* FROM documents d JOIN ({on(m6.SQL, "documents")}) q USING (doc_id) WHERE q.kept),
s3 AS MATERIALIZED (SELECT d.doc_id, t.text, d.lang, d.source FROM s6 d JOIN (
  {lines} SELECT doc_id, coalesce(string_agg(ln, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY doc_id) t USING (doc_id)),
s5 AS MATERIALIZED (SELECT d.* FROM s3 d JOIN ({on(m5.SQL, "s3")}) c USING (doc_id) WHERE c.doc_id = c.component_id),
hit AS MATERIALIZED ({spans} SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS wi FROM o),
tok AS (SELECT doc_id, k, t, w, CASE WHEN w THEN sum(w::INT) OVER (PARTITION BY doc_id ORDER BY k) ELSE sum(w::INT) OVER (PARTITION BY doc_id ORDER BY k) END AS wi
  FROM (SELECT doc_id, k, t, regexp_matches(t, '^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]') AS w
    FROM (SELECT doc_id, unnest(range(len(ts))) AS k, unnest(ts) AS t FROM (SELECT doc_id,
      regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM s5)))),
cut AS (SELECT tok.doc_id, string_agg(t, '' ORDER BY k) AS text FROM tok
  LEFT JOIN hit a ON a.doc_id = tok.doc_id AND a.wi = tok.wi LEFT JOIN hit b ON b.doc_id = tok.doc_id AND b.wi = tok.wi + 1
  WHERE NOT CASE WHEN w THEN a.wi IS NOT NULL ELSE a.wi IS NOT NULL AND b.wi IS NOT NULL END GROUP BY tok.doc_id),
docs AS (SELECT s5.doc_id, cut.text, s5.source FROM s5 LEFT JOIN cut USING (doc_id)),
{m10.SQL_BODY.strip().rpartition("SELECT doc_id, size")[0].replace("run AS (SELECT s.doc_id,", "run AS (SELECT s.doc_id, s.source,")}
SELECT doc_id, source, size, source_size, target, (e * size + least(greatest(budget - e * source_size - before, 0), size))::BIGINT AS taken
FROM ep WHERE e * size + least(greatest(budget - e * source_size - before, 0), size) > 0
"""


ORACLE_SQL = _oracle()
