"""Spelling variants: a trie as tables, walked by a frontier of (word, position, node, edits) states.

A trie node is a prefix; its row lists its children, at most one per letter.  The
frontier joins the node table level by level.  A state without edits follows its
word's own letter and opens states with one edit, an inserted or a replaced letter;
a state with one edit follows its word exactly.  States that reach a whole word with
one edit are neighbours.  A deletion is the insertion seen from the other word, so
walking each word against words of its length and one more finds both.

Two tries are kept, of words and of reversed words.  In each a word starts behind
its first half, which is a node for certain, and edits lie beyond it: an edit of the
first half is found in the reversed trie.  So edits are tried only where the trie
branches little.  A node with few words below is a bucket that lists them, and a
state that comes to it is compared with each, which spares the levels of unbranched
ends.  A walk takes as many levels as the trie branches; words longer than ``LONG``
letters are matched by the hashes of their one-letter deletions instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelwright.llm.common import read, store
from panelwright.llm.merkle import CRC_TABLE, crc32_sql

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
#: A run loses a letter where this divides its hash.
SLIP = 199
SHORTEST, LEAST = 6, 5
#: A form has at least this many times the count.
TIMES = 5
#: Words below a node that make it a bucket.
BUCKET = 4
#: Letters up to which words walk the trie.
LONG = 48
#: Nodes with this many words below are looked up in ``SALTS`` copies.
HOT, SALTS = 2000, 16


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of the runs of letters in whole texts after planted slips.

    A-Z are lower-cased, other letters stay.  A run loses the letter at its hash
    modulo its length where ``SLIP`` divides crc32 of ``<doc_id>:<run>``; a NULL id is
    empty there.  NULL text has no runs.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    # lower() of a run of one-byte letters changes A-Z only.
    plain = F.octet_length("run") == F.char_length("run")
    runs = runs.withColumn("run", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = runs.select(F.when(h % SLIP == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _letter(word: Column, at: Column) -> Column:
    """The letter at a place counted from 0, empty beyond the end."""
    return F.substring(word, at + 1, F.lit(1))


def trie(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Nodes (way, node, size, ends, children) of both tries from (way, w).

    ``children`` holds (letter, size, words, next, ends): the words are given up to
    ``bucket`` of them, else the letters that follow and whether the child is a word.
    Prefixes shorter than any walk starts with are left out.
    """
    length = F.char_length("w")
    first = F.greatest(F.floor(length / 2) - 1, F.lit(0)).cast("int")
    at = words.select("way", "w", F.explode(F.sequence(first, length)).alias("k"))
    prefix = at.select("way", "w", F.substring(F.col("w"), F.lit(1), F.col("k")).alias("node"), _letter(F.col("w"), F.col("k")).alias("c"))
    # One row per edge: its words below, and the words themselves while they are few.
    edges = prefix.groupBy("way", "node", "c").agg(F.count("*").alias("below"), F.min("w").alias("low"), F.max("w").alias("high"))
    nodes = edges.groupBy("way", "node").agg(
        F.sum("below").alias("size"), F.array_sort(F.collect_set("c")).alias("letters"))
    nodes = store(nodes.select("way", "node", "size", F.array_join(F.array_remove("letters", ""), "").alias("next"), F.array_contains("letters", "").alias("ends")))
    small = nodes.filter(F.col("size") <= bucket).select("way", "node")
    listed = prefix.join(small, ["way", "node"]).groupBy("way", "node").agg(F.array_sort(F.collect_set("w")).alias("words"))
    nodes = nodes.join(listed, ["way", "node"], "left").filter(F.length("node") > 0)
    # Children of nodes that are no buckets, put together at their parents.
    parent = F.substring(F.col("node"), F.lit(1), F.length("node") - 1)
    child = F.struct(F.substring(F.col("node"), F.length("node"), F.lit(1)).alias("c"), "size", "words", "next", "ends")
    grouped = nodes.select("way", parent.alias("node"), child.alias("child")).groupBy("way", "node").agg(F.collect_list("child").alias("children"))
    return grouped


def _walk(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way, w, other) with one insertion or replacement from w to other, from the starting states.

    Each round joins the frontier with the node table and writes neighbours and new
    states; hits of all rounds are read back at the end.
    """
    salted = nodes.withColumn("size", F.aggregate("children", F.lit(0).cast("long"), lambda s, c: s + c["size"]))
    salted = store(salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("size") >= HOT, F.lit(SALTS - 1)).otherwise(F.lit(0))))).drop("size"))
    length = F.char_length("w")
    near = lambda other: (F.levenshtein(F.col("w"), other, 1) == 1) & (F.char_length(other) >= length)
    rounds, states = [], starts
    while not rounds or not states.isEmpty():
        # The salt of a node that the table holds once is 0, of a hot one any; a state knows its node's size.
        spread = F.when(F.col("size") >= HOT, F.pmod(F.xxhash64("w"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        met = states.withColumn("salt", spread).join(salted, ["way", "node", "salt"])
        here, behind = _letter(F.col("w"), F.col("pos")), F.col("pos") + 1

        def moves(c: Column) -> Column:
            """What a state becomes at one child: (other, pos, edits), other set where it ends."""
            state = lambda pos, edits: F.struct(F.lit(None).cast("string").alias("other"), pos.alias("pos"), F.lit(edits).alias("edits"), c["c"].alias("c"), c["size"].alias("size"))
            ended = lambda other: F.struct(other.alias("other"), F.lit(0).alias("pos"), F.lit(0).alias("edits"), c["c"].alias("c"), c["size"].alias("size"))
            follows = lambda pos: F.when(pos < length, F.instr(c["next"], _letter(F.col("w"), pos)) > 0).otherwise(F.lit(False))
            whole = F.concat("node", c["c"])
            edit = lambda pos: F.array_compact(F.array(
                F.when((pos == length) & c["ends"], ended(whole)), F.when(follows(pos), state(pos, 1))))
            same = c["c"] == here
            exact = F.when(F.col("pos") < length, same).otherwise(F.lit(False))
            none = F.array().cast("array<struct<other:string,pos:int,edits:int,c:string,size:bigint>>")
            fresh = F.concat(
                F.when(exact, F.array(state(behind, 0))).otherwise(none),
                edit(F.col("pos")),
                F.when((F.col("pos") < length) & ~exact, edit(behind)).otherwise(none))
            stepped = F.when(F.col("edits") == 0, fresh).otherwise(F.when(exact, edit(behind)).otherwise(none))
            open_ = (F.col("edits") == 0) | exact
            listed = F.when(open_, F.transform(F.filter(c["words"], near), ended)).otherwise(none)
            return F.when(c["words"].isNotNull(), listed).otherwise(stepped)

        to = met.select("way", "w", "node", F.explode(F.flatten(F.transform("children", moves))).alias("m"))
        out = store(to.select("way", "w", F.col("m.other").alias("other"), F.concat("node", "m.c").alias("node"), F.col("m.pos").alias("pos"), F.col("m.edits").alias("edits"), F.col("m.size").alias("size")))
        rounds.append(out.filter("other IS NOT NULL").select("way", "w", "other"))
        states = out.filter("other IS NULL").drop("other")
    hits = rounds[0]
    for r in rounds[1:]:
        hits = hits.unionAll(r)
    return hits


def _by_deletions(words: DataFrame) -> DataFrame:
    """(word, other) one edit apart among long words, by equal hashes of one-letter deletions, then verified."""
    keyed = words.select("word", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("i"))
    cut = F.concat(F.substring(F.col("word"), F.lit(1), F.col("i")), F.substring(F.col("word"), F.col("i") + 2, F.char_length("word")))
    keyed = keyed.select("word", F.when(F.col("i") == F.char_length("word"), F.col("word")).otherwise(cut).alias("v")).select("word", F.sha2(F.col("v").cast("binary"), 256).alias("v"), F.xxhash64("v").alias("k")).distinct()
    other = keyed.select(F.col("word").alias("other"), "v", "k")
    pairs = keyed.join(other, ["k", "v"]).filter("word <> other").select("word", "other").distinct()
    return pairs.filter(F.levenshtein("word", "other", 1) == 1)


def neighbours(words: DataFrame, bucket: int = BUCKET, long: int = LONG) -> DataFrame:
    """All (word, other) pairs of distinct words one insertion, deletion or replacement apart, both ways."""
    short = words.filter(F.char_length("word") <= long)
    ways = store(short.select(F.lit(0).alias("way"), F.col("word").alias("w")).unionAll(short.select(F.lit(1), F.reverse("word"))))
    nodes = trie(ways, bucket)
    half = F.floor(F.char_length("w") / 2).cast("int")
    # The reversed trie starts behind the other half, so that every place of an edit lies beyond one of the starts.
    pos = F.when(F.col("way") == 0, half).otherwise(F.char_length("w") - half)
    starts = ways.select("way", "w", F.substring(F.col("w"), F.lit(1), pos).alias("node"), pos.alias("pos"), F.lit(0).alias("edits"))
    counted = nodes.select("way", "node", F.aggregate("children", F.lit(0).cast("long"), lambda s, c: s + c["size"]).alias("size"))
    hits = _walk(starts.join(counted, ["way", "node"]), nodes)
    plain = lambda c: F.when(F.col("way") == 0, F.col(c)).otherwise(F.reverse(F.col(c)))
    found = hits.select(plain("w").alias("word"), plain("other").alias("other"))
    far = _by_deletions(words.filter(F.char_length("word") >= long)).filter((F.char_length("word") > long) | (F.char_length("other") > long))
    return found.unionAll(found.select("other", "word")).unionAll(far).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form, by doubling; counts rise along forms, so every chain ends."""
    reach = store(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not reach.filter("open").isEmpty():
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        reach = store(reach.drop("open").join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("open")))
    return reach.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, form, root, n_near and form_n of every frequent word of the documents.

    The form is the near word of largest count, ties to the smallest in code-point
    order, if that count is ``TIMES`` the word's.  An empty table, or one without
    frequent words, gives no rows.  Repeated rows count each; other columns are ignored.
    """
    words = store(vocabulary(docs))
    near = neighbours(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    told = words.join(best, "word", "left")
    good = -F.col("best")["minus"] >= TIMES * F.col("n")
    told = store(told.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")["other"]).alias("form"), F.when(good, -F.col("best")["minus"]).alias("form_n")))
    roots = _roots(told.filter("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE k AS ({CRC_TABLE}),
o AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || translate(run, '{UPPER}', '{LOWER}') AS x, strlen(coalesce(CAST(doc_id AS VARCHAR), '')) + 1 AS skip, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT substr(x, skip + 1) AS run, n, {crc32_sql('x', 't')} AS h FROM o, k),
c AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
v AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
e AS (
  SELECT a.word, b.word AS other FROM v a JOIN v b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, w.word FROM v JOIN w ON v.v = w.word
  UNION SELECT w.word, v.word FROM v JOIN w ON v.v = w.word),
s AS (SELECT e.word, count(*) AS n_near, arg_min(e.other, (-w.n, e.other)) AS other, max(w.n) AS most FROM e JOIN w ON w.word = e.other GROUP BY e.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {TIMES} * w.n THEN other END AS form, CASE WHEN most >= {TIMES} * w.n THEN most END AS form_n FROM w LEFT JOIN s USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS steps FROM f
  UNION ALL SELECT chain.word, f.form, steps + 1 FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT arg_max(root, steps) FROM chain WHERE chain.word = f.word) AS root, n, n_near, form_n FROM f"""
