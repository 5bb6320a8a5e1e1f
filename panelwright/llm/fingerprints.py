"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so the
sketch of a union is the union of sketches and containment can be estimated
between texts of very unequal length.  The smallest hash is kept in any case, which
merges the same way, so a text with words never has an empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WIDTH = 5
#: Hashes are eight hex digits; below this bound lies one sixteenth of them.
BOUND = "10000000"
#: Quantiles that cut the ids into ranges, and range cells per shuffle partition.
LEVELS, CELLS = 64, 4


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of ``width`` consecutive words; fewer words are one shingle, none give an empty list."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(
        F.array(words),
        lambda w: F.transform(
            F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1)))),
            lambda i: F.substring(F.md5(F.concat_ws(" ", F.slice(w, i, width)).cast("binary")), 1, 8),
        ),
    )[0]


def sketch(hashes: Column, bound: str = BOUND) -> Column:
    """Sorted distinct hashes below the bound, and the smallest of all."""
    return F.transform(
        F.array(hashes),
        lambda h: F.array_sort(F.array_union(F.filter(h, lambda x: x < bound), F.when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(F.array().cast("array<string>")))),
    )[0]


def merge(a: Column, b: Column, bound: str = BOUND) -> Column:
    """The sketch of the union of two shingle sets."""
    both = F.array_union(a, b)
    return F.array_sort(F.filter(both, lambda x: (x < bound) | (x == F.array_min(both))))


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two sketches; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Share of ``a`` found in ``b``; an empty sketch is contained in every other."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def _cell(ids: DataFrame, cells: int) -> Column:
    """Number of the range cell of doc_id, rising with the id, -1 for NULL.

    Quantiles, ``LEVELS`` at most, make a decision tree, and each of their ranges
    is cut evenly in as many cells as ``cells`` asks for.
    """
    cuts = sorted({int(c) for c in ids.approxQuantile("doc_id", [i / LEVELS for i in range(LEVELS)], 1 / (8 * LEVELS))})
    if not cuts:
        return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.lit(0))
    top = ids.agg(F.max("doc_id")).first()[0]
    fine = max(1, -(-cells // len(cuts)))
    widths = [(hi - lo) // fine + 1 for lo, hi in zip(cuts, [*cuts[1:], top + 1], strict=True)]

    def tree(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("doc_id") < cuts[mid], tree(lo, mid)).otherwise(tree(mid, hi))

    at = tree(0, len(cuts))
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]).cast("array<bigint>"), at + 1)
    inside = F.floor((F.col("doc_id") - of(cuts)) / of(widths)).cast("int")
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), inside)))


def with_next(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Add ``next_<c>`` of the following row by descending doc_id; the last is followed by the first.

    Rows go to range cells of the id, one shuffle; the greatest id of a cell, one
    row per cell, is copied to the cell above, where it follows the last row.  Rows
    without an id come last.  Rows of one id follow each other by the carried
    columns.  A table of only NULL ids has no next for its last row.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    cell = _cell(ids, CELLS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    tops = [(r["c"], r["m"]) for r in ids.select(cell.alias("c"), "doc_id").groupBy("c").agg(F.max("doc_id").alias("m")).orderBy("c").collect()]
    held = [c for c, _ in tops]
    goes = []
    for k, (c, m) in enumerate(tops):
        if m is not None:
            last = k == len(tops) - 1
            goes.append((m, held[0] if last else held[k + 1], 1 if last else 0))
    edges = spark.createDataFrame(goes or [(None, None, None)], "_top long, _to int, _wrap int")
    placed = docs.withColumn("_cell", cell).join(F.broadcast(edges), F.col("doc_id") == F.col("_top"), "left")
    here = F.struct(F.col("_cell").alias("cell"), F.lit(0).alias("wrap"), F.lit(0).alias("ghost"))
    there = F.struct(F.col("_to").alias("cell"), F.col("_wrap").alias("wrap"), F.lit(1).alias("ghost"))
    spread = placed.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    spread = spread.select(*docs.columns, F.col("_at.cell").alias("_cell"), F.col("_at.wrap").alias("_wrap"), F.col("_at.ghost").alias("_ghost"))
    w = Window.partitionBy("_cell").orderBy("_wrap", F.col("doc_id").desc_nulls_last(), *[F.col(c) for c in carry])
    out = spread.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
    return out.filter("_ghost = 0").drop("_cell", "_wrap", "_ghost")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts and of texts whose last half comes from the next document.

    NULL text is empty and has an empty fingerprint.  Repeated rows keep their own
    place in the order.  Columns other than doc_id and text are ignored.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("fp", F.concat_ws("", sketch(shingle_hashes(F.col("text")))))
    paired = with_next(base, ["text", "fp"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    out = paired.select("doc_id", "fp", "next_fp", n.cast("long").alias("n_chars"), edited.alias("edited"))
    out = out.withColumn("edited_sketch", sketch(shingle_hashes(F.col("edited"))))
    parts = lambda c: F.filter(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit("([0-9a-f]{8})"), F.lit(1)), lambda x: x != "")
    out = out.withColumn("sketch", parts("fp"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"),
        F.concat_ws("", "edited_sketch").alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), parts("next_fp")).alias("near_next"))


def op10(spark, sf_dir: str) -> DataFrame:
    from panelwright.llm.common import read

    return fingerprint_edits(read(spark, sf_dir, "documents"))


def _sketch_sql(text: str) -> str:
    words = rf"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    hashes = f"""list_transform(list_transform([{words}], lambda w: list_transform(
        CASE WHEN len(w) = 0 THEN CAST([] AS BIGINT[]) ELSE range(1, greatest(len(w) - 4, 1) + 1) END,
        lambda i: substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 8))), lambda h: h)[1]"""
    return f"""list_transform([{hashes}], lambda h: list_sort(list_distinct(list_concat(
        list_filter(h, lambda x: x < '10000000'), CASE WHEN len(h) > 0 THEN [list_min(h)] ELSE [] END))))[1]"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
x AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT *, substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2) AS edited FROM x),
k AS (
  SELECT doc_id, n, sha256(edited) AS edited_sha256, {_sketch_sql('text')} AS a, {_sketch_sql('edited')} AS b, {_sketch_sql('next_text')} AS c FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS near_edited,
       CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, c))::DOUBLE / len(list_distinct(list_concat(a, c))) END AS near_next
FROM k"""
