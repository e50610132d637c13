"""Mixing sources to target weights, in DataFrame functions.

Every document gets a hash-random key. Within its source the documents stand in key order,
which is a range sort: the key space is cut into equal ranges, sized by the number of rows,
so that a source with a third of all rows is spread over many ranges. Sums by (source, range)
are a small table whose prefix sums, added to the running sum inside a range, give each
document the number of words before it. A source's budget is then cut exactly: whole epochs
first, and of the last epoch the documents up to the budget, the last one in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.scratch import table, write_through

MAX_EPOCHS = 3
CYCLE = (1, 2, 3)
#: Rows that a key range holds on average.
RANGE_ROWS = 20_000
_WS = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, _WS))).cast("long")


def targets(sources: DataFrame, cycle: tuple[int, ...] = CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Sources by code point, null last, weigh ``cycle``, repeating, and share the sum of all
    sizes. A target stops at ``max_epochs`` times its source's size; what is over goes to the
    others by weight until none is above. In closed form: with sources in order of
    cap / weight, the first whose cap is above its share of what the ones before it leave
    open sets the level for itself and all after it.
    """
    named = sources.withColumn("__i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("__i") % len(cycle) + 1).cast("int"))
    x = named.withColumn("__w", weight.cast("double")).withColumn("__cap", (F.col("source_size") * max_epochs).cast("double"))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__i")
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__left", F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
    x = x.withColumn("__open", F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    x = x.withColumn("__level", F.when(F.col("__cap") * F.col("__open") >= F.col("__left") * F.col("__w"), F.col("__left") / F.col("__open")))
    x = x.withColumn("__level", F.first("__level", ignorenulls=True).over(Window.orderBy(F.col("__cap") / F.col("__w"), "__i").rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("target", F.coalesce(F.least("__cap", F.col("__level") * F.col("__w")), F.col("__cap"))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of each row: ``doc_id, source, size, source_size, target, taken``.

    * A null text has size 0 and is never taken; a null source is a source of its own.
    * Order is by (key, id, size); the key depends on the id alone, so reruns and other
      partitionings agree. Rows that tie on all three are equal, whichever comes first.
    * Repeated rows are rows of their own. Other columns are left out, so no name clashes.
    * An empty table gives an empty table; when all sizes are 0 all targets are 0.
    """
    spark = docs.sparkSession
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = write_through(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("__key"),
        ),
        "mix-sizes",
    )
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    width = -(-(1 << 60) // ranges)
    rows = rows.withColumn("__b", F.floor(F.col("__key") / F.lit(width)).cast("int") if ranges > 1 else F.lit(0))
    sums = rows.groupBy("source", "__b").agg(F.sum("size").alias("__sum"))
    # Both tables below have a row for each source, or for each source and range.
    starts = sums.withColumn(
        "__base",
        F.coalesce(F.sum("__sum").over(Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    aims = targets(sums.groupBy("source").agg(F.sum("__sum").alias("source_size")))
    plan = starts.alias("s").join(aims.alias("a"), F.col("s.source").eqNullSafe(F.col("a.source"))).select("s.source", "s.__b", "s.__base", "a.source_size", "a.target")
    inside = Window.partitionBy("source", "__b").orderBy("__key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.__b") == F.col("p.__b")))
    budget = F.floor(F.col("p.target")).cast("long")
    epochs = F.when(F.col("p.source_size") > 0, F.floor(budget / F.col("p.source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("p.source_size")
    part = F.least(F.greatest(rest - F.col("p.__base") - F.col("r.__in"), F.lit(0)), F.col("r.size"))
    return joined.select(
        F.col("r.doc_id").alias("doc_id"),
        F.col("r.source").alias("source"),
        F.col("r.size").alias("size"),
        F.col("p.source_size").alias("source_size"),
        F.col("p.target").alias("target"),
        (epochs * F.col("r.size") + part).cast("long").alias("taken"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix_sources`` over all documents."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The part of the SQL from a table ``docs`` (doc_id, text, source) on.
SQL_BODY = r"""
sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS k FROM docs),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM sized GROUP BY source),
caps AS (SELECT *, (i % 3 + 1)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM src),
lev AS (SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0) AS lft, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS opn
        FROM caps WINDOW b AS (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT *, CASE WHEN cap * opn >= lft * w THEN lft / opn END AS l0 FROM lev),
tgt AS (SELECT source, source_size, coalesce(least(cap, first_value(l0 IGNORE NULLS) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * w), cap) AS target FROM lvl),
run AS (SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
               coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id NULLS LAST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
ep AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS e FROM run)
SELECT doc_id, size, source_size, target, (e * size + least(greatest(budget - e * source_size - before, 0), size))::BIGINT AS taken FROM ep
"""

SQL = "WITH docs AS (SELECT doc_id, text, source FROM documents)," + SQL_BODY
