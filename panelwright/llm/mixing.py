"""Mixing sources to target weights: capped water-filling, seeded whole and fractional repetitions.

Only DataFrame functions run here.  A source's documents are spread over
``BUCKETS`` hash buckets; targets, whole repetitions and the fractional cut are
worked out on the table of (source, bucket) sizes, which also splits a source that
holds a third of all rows.  The cut takes whole buckets and decides the one it
crosses by the nearer side, so the words taken differ from the target by half a
bucket at most.  What is decided is one row per source, its whole repeats and its
last bucket taken once more, so documents meet the plan without being shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.operators.order import ordinal
from panelwright.session import cut_lineage

#: Three hexadecimal digits of a hash.  It sets how finely a source is cut; no row is dropped by it.
BUCKETS = 4096
#: Sources whose plan is sent to the documents; with more, documents are shuffled by source.
SOURCES_SENT = 100_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bucket(doc_id: str, seed: str) -> Column:
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 3), 16, 10).cast("int")


def water_fill(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Add ``target`` to (source, source_size, weight).

    All sources together get the sum of their sizes, by weight; a target stops at
    ``max_epochs`` times its source's size, and what exceeds it is shared again.
    Each round is one aggregate of the source table that returns two sums.  A
    source is clamped once the water level passes its cap, and the level only
    rises, so the level alone is the state.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    first = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weights = first[0] or 0, first[1] or 0
    level = total / weights if weights else 0.0
    while True:
        over = cap < F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(over, cap).otherwise(F.lit(0.0))), F.sum(F.when(over, F.lit(0)).otherwise(F.col("weight")))).first()
        clamped, free = row[0] or 0.0, row[1] or 0
        raised = (total - clamped) / free if free else float("inf")
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")) if level != float("inf") else cap)


def plan_mix(sized: DataFrame, weights: DataFrame | None = None, max_epochs: float = 3.0) -> DataFrame:
    """(source, source_size, target, whole, upto) from rows of (source, size, bucket).

    A row is repeated ``whole`` times, and once more up to bucket ``upto``.
    ``weights`` holds (source, weight); without it sources by code point, NULL
    last, weigh 1, 2, 3 and so on again.
    """
    cells = cut_lineage(sized.groupBy("source", "bucket").agg(F.sum("size").alias("cell")))
    sources = cells.groupBy("source").agg(F.sum("cell").alias("source_size"))
    if weights is None:
        sources = ordinal(sources, "_rank", F.col("source").asc_nulls_last()).withColumn("weight", F.col("_rank") % 3 + 1).drop("_rank")
    else:
        w = weights.select(F.col("source").alias("_s"), "weight")
        sources = sources.join(w, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    filled = water_fill(cut_lineage(sources), max_epochs)
    ratio = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    filled = filled.withColumn("whole", F.coalesce(F.floor(ratio), F.lit(0))).withColumn("cut", F.col("target") - F.col("whole") * F.col("source_size"))
    before = F.coalesce(F.sum("cell").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    f = filled.withColumnRenamed("source", "_s")
    joined = cells.withColumn("before", before).join(f, F.col("source").eqNullSafe(F.col("_s")))
    # the middles of buckets ascend, so the buckets taken are the first ones
    taken = F.col("before") + F.col("cell") / 2 < F.col("cut")
    return joined.groupBy("source").agg(
        *[F.first(c).alias(c) for c in ("source_size", "target", "whole")], F.coalesce(F.max(F.when(taken, F.col("bucket"))), F.lit(-1)).alias("upto"))


def with_repeats(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = 3.0, seed: str = "mix", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target and repeats of every row.

    NULL text has no words, NULL source is a source of its own, rows without words
    take nothing.  Repeated rows share a hash and so their repeats.  An empty table
    gives an empty table.  Other columns of ``docs`` are ignored unless named in ``extra``.
    """
    sized = docs.select("doc_id", "source", word_count().alias("size"), bucket("doc_id", seed).alias("bucket"), *extra)
    if not extra:
        sized = cut_lineage(sized)
    plan = cut_lineage(plan_mix(sized, weights, max_epochs).withColumnRenamed("source", "_s"))
    sent = F.broadcast(plan) if plan.count() <= SOURCES_SENT else plan
    joined = sized.join(sent, F.col("source").eqNullSafe(F.col("_s")))
    repeats = F.col("whole") + (F.col("bucket") <= F.col("upto")).cast("long")
    return joined.select("doc_id", "source", "size", *extra, "source_size", "target", repeats.alias("repeats"))


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mixed documents themselves: each row as often as its repeats say, columns unchanged."""
    keep = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    out = with_repeats(keep, weights, max_epochs, seed, extra=("_row",))
    return out.filter("repeats > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("_row.*")


def op3(spark, sf_dir: str) -> DataFrame:
    from panelwright.llm.common import read

    return with_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS INTEGER) AS bucket
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM r),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT max(level) FROM l) * w) AS target FROM l),
f AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole FROM t),
c AS (SELECT source, bucket, sum(size) AS cell FROM d GROUP BY source, bucket),
p AS (
  SELECT *, coalesce(sum(cell) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT d.doc_id, d.size, f.source_size, f.target,
       CAST(d.size * (f.whole + CASE WHEN p.before + p.cell / 2 < f.target - f.whole * f.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.bucket = p.bucket
       JOIN f ON d.source IS NOT DISTINCT FROM f.source"""
