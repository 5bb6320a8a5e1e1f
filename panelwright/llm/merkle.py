"""Merkle manifest of a table: slot pivots build the tree, the same pivots give every leaf's siblings.

A parent's children sit in ``fanout`` columns, filled by conditional aggregates.
Their concatenation is hashed to the parent; leaving out a child's own column gives
its siblings.  Leaves are numbered inside their group by one sort by range, the tree
grows level by level in written tables, and paths come back down by joins on
(group, position / fanout), where no key has more than ``fanout`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelwright.llm.common import read, store

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else UTF-8 byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _places(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``_at``, the place in ``_group``, and ``_cnt``, the group's rows.

    One sort by range; what a group has in earlier ranges comes from a table of one
    row per (range, group).  Joined on both, so a large group stays spread.
    """
    ranged = leaves.repartitionByRange("_group", *order).sortWithinPartitions("_group", *order)
    placed = store(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    cells = placed.groupBy("_part", "_group").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    of = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("_part", "_group", "_first", before.alias("_before"), F.sum("_n").over(of).alias("_cnt"))
    out = placed.join(cells, ["_part", "_group"])
    return out.withColumn("_at", F.col("_id") - F.col("_first") + F.col("_before")).drop("_part", "_id", "_first", "_before")


def _slots(fanout: int) -> list[str]:
    return [f"_s{i}" for i in range(fanout)]


def _grow(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """Levels of all groups' trees from (_group, _at, _cnt, _hash): tables of nodes with their children's slots."""
    levels, level = [], leaves
    slot, parent = F.pmod(F.col("_at"), F.lit(fanout)), F.expr(f"_at div {fanout}")
    while not (many := level.filter("_cnt > 1")).isEmpty():
        spread = [F.max(F.when(slot == i, F.col("_hash"))).alias(s) for i, s in enumerate(_slots(fanout))]
        nodes = many.groupBy("_group", parent.alias("_at")).agg(F.max("_cnt").alias("_cnt"), *spread)
        joined = digest(*[F.coalesce(F.col(s), F.lit("")) for s in _slots(fanout)])
        level = store(nodes.withColumn("_cnt", F.expr(f"(_cnt + {fanout - 1}) div {fanout}")).withColumn("_hash", joined))
        levels.append(level)
    return levels


def _descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """Add ``_path`` and the columns of ``tops`` to leaves: the siblings beside each step up, then the path of ``tops``.

    ``tops`` has one row per group with ``_path``, the steps above the group's own root.
    """
    above = None
    given = [c for c in tops.columns if c not in ("_group", "_path")]
    for depth in range(len(levels), -1, -1):
        nodes = levels[depth - 1] if depth else leaves
        reached = nodes.filter("_cnt = 1").join(tops, "_group")
        if above is not None:
            up = above.select(F.col("_group").alias("_g"), F.col("_at").alias("_up"), F.col("_path").alias("_rest"), *given, *_slots_as(above, fanout))
            inner = nodes.filter("_cnt > 1").join(up, (F.col("_group") == F.col("_g")) & (F.expr(f"_at div {fanout}") == F.col("_up")))
            own = F.pmod(F.col("_at"), F.lit(fanout))
            beside = lambda keep: F.concat(*[F.when(keep(i), F.coalesce(F.col(f"_p{i}"), F.lit(""))).otherwise(F.lit("")) for i in range(fanout)])
            step = F.struct(beside(lambda i: F.lit(i) < own).alias("left"), beside(lambda i: F.lit(i) > own).alias("right"))
            inner = inner.withColumn("_path", F.concat(F.array(step), F.col("_rest"))).drop("_g", "_up", "_rest", *[f"_p{i}" for i in range(fanout)])
            reached = reached.select(inner.columns).unionAll(inner)
        # written level by level, so that no job holds the joins of all of them
        above = store(reached) if depth else reached
    return above


def _slots_as(nodes: DataFrame, fanout: int) -> list[Column]:
    return [F.col(s).alias(f"_p{i}") for i, s in enumerate(_slots(fanout))]


def prove(rows: DataFrame, group: str, order: str, leaf: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """Add ``subroot``, ``root`` and ``path`` to rows that have a leaf digest.

    Per group, NULL being a group and the first, leaves ascend by ``order``, NULL
    first; rows of one ``order`` follow each other by digest, equal digests in the
    order of the table read.  A run of fewer than ``fanout`` nodes is hashed as it
    is, a lone leaf is its group's root.  Roots of groups, by group in byte order,
    make the tree whose top is ``root``.  ``path`` lists (left, right), the joined
    digests of the siblings before and after, from the leaf's level to the root's.
    An empty table gives an empty table.  Other columns are carried along.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    held = rows.select(key.alias("_group"), F.col(order).alias("_order"), F.col(leaf).alias("_hash"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))
    held = store(held.withColumn("_nth", F.monotonically_increasing_id()))
    placed = store(_places(held, [F.col("_order").asc_nulls_first(), F.col("_hash"), F.col("_nth")]).select("_group", "_at", "_cnt", "_hash", "_row"))
    levels = _grow(placed.select("_group", "_at", "_cnt", "_hash"), fanout)
    ends = placed.filter("_cnt = 1").select("_group", "_hash")
    for level in levels:
        ends = ends.unionAll(level.filter("_cnt = 1").select("_group", "_hash"))
    roots = _places(store(ends.select(F.lit("").alias("_group"), F.col("_group").alias("_of"), "_hash")), [F.col("_of")])
    roots = store(roots)
    upper = _grow(roots.select("_group", "_at", "_cnt", "_hash"), fanout)
    last = (upper[-1] if upper else roots).select("_hash").first()
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    crown = rows.sparkSession.range(1).select(F.lit("").alias("_group"), nothing.alias("_path"))
    tops = _descend(roots, upper, crown, fanout).select(F.col("_of").alias("_group"), F.col("_hash").alias("_subroot"), "_path")
    found = _descend(placed, levels, store(tops), fanout)
    return found.select("_row.*", F.col("_subroot").alias("subroot"), F.lit(last[0] if last else None).cast("string").alias("root"), F.col("_path").alias("path"))


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf digest leads to along a path."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["left"], h, step["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def verify_documents(docs: DataFrame) -> DataFrame:
    """Manifest of documents, and what half of them fold to once their line feeds are gone.

    Documents whose crc32 of the decimal id is even are checked without line feeds in
    the text, the others as they are; a NULL id is not tampered with.  NULL columns
    hash as ``-``.  Repeated rows are leaves of their own.  Other columns are ignored.
    """
    lines = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaf = lambda text: digest(*[field(text if c == "text" else F.col(c)) for c in FIELDS])
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), leaf(lines).alias("checked"))
    proved = prove(rows, "source", "doc_id")
    out = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.col("path"), F.col("checked")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_documents(read(spark, sf_dir, "documents"))


def crc32_sql(text: str, table: str) -> str:
    """crc32 of a text in SQL; ``table`` holds the 256 remainders as a list."""
    parts = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"
    return f"xor(list_reduce({parts}, lambda c, b: xor(c >> 8, {table}[CAST((xor(c, b) & 255) + 1 AS INTEGER)]), 4294967295), 4294967295)"


CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t"""

_FIELD = lambda c, v=None: f"coalesce(strlen(CAST({v or c} AS VARCHAR)) || ':' || CAST({v or c} AS VARCHAR), '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD(c, text if c == "text" else None) for c in FIELDS) + ")"
_UP = "list_transform(range((len(h) + 2) // 3), lambda i: sha256(array_to_string(h[3 * i + 1:3 * i + 3], '')))"

SQL = f"""
WITH RECURSIVE k AS ({CRC_TABLE}),
d AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {_LEAF('text')} AS leaf,
         {_LEAF("CASE WHEN " + crc32_sql('CAST(doc_id AS VARCHAR)', 't') + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS checked
  FROM documents, k),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ord FROM d),
tree AS (
  SELECT g, 0 AS lv, list(leaf ORDER BY ord) AS h FROM p GROUP BY g
  UNION ALL SELECT g, lv + 1, {_UP} FROM tree WHERE len(h) > 1),
subroots AS (SELECT g, lv AS height, h[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM tree WHERE len(h) = 1),
crown AS (
  SELECT 0 AS lv, list(subroot ORDER BY place) AS h FROM subroots
  UNION ALL SELECT lv + 1, {_UP} FROM crown WHERE len(h) > 1),
steps AS (
  SELECT p.g, p.ord, tree.lv, h[3 * (p.ord // CAST(pow(3, tree.lv) AS BIGINT) // 3) + 1:3 * (p.ord // CAST(pow(3, tree.lv) AS BIGINT) // 3) + 3] AS run,
         p.ord // CAST(pow(3, tree.lv) AS BIGINT) % 3 AS slot
  FROM p JOIN tree USING (g) WHERE len(h) > 1
  UNION ALL
  SELECT p.g, p.ord, s.height + crown.lv, h[3 * (s.place // CAST(pow(3, crown.lv) AS BIGINT) // 3) + 1:3 * (s.place // CAST(pow(3, crown.lv) AS BIGINT) // 3) + 3],
         s.place // CAST(pow(3, crown.lv) AS BIGINT) % 3
  FROM p JOIN subroots s USING (g), crown WHERE len(h) > 1),
sides AS (SELECT g, ord, lv, array_to_string(run[1:slot], '') AS l, array_to_string(run[slot + 2:], '') AS r FROM steps),
paths AS (SELECT g, ord, list({{'l': l, 'r': r}} ORDER BY lv) AS path FROM sides GROUP BY g, ord),
f AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT h[1] FROM crown WHERE len(h) = 1) AS root,
         sha256(coalesce(array_to_string(list_transform(path, lambda x: x.l || x.r), ''), '')) AS proof_sha256,
         list_reduce(list_transform(coalesce(path, []), lambda x: [x.l, x.r]), lambda a, x: [sha256(x[1] || a[1] || x[2]), ''], [p.checked, ''])[1] AS folded_root
  FROM p JOIN subroots s USING (g) LEFT JOIN paths USING (g, ord))
SELECT *, folded_root = root AS verified FROM f"""
