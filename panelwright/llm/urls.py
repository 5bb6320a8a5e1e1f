"""URL filter: a path-template tree per host, its templates judged by smoothed labelled purity.

Under a node of the tree, segments that hold a fair share of its rows stay literal;
others become a wildcard of their shape, rare shapes ``*``.  Labelled branches whose
blocked shares do not differ significantly are merged.  The blocked share of a
template is smoothed by that of its parent, of its host and of the whole table in
turn, and a template with half or more is rejected.

All statistics are sums with map-side combining.  What a node knows about its
branches is one bounded map (``2 * FANOUT + 1`` entries at most), which rows fetch by
a join; nodes of many rows are salted, so a hot host is spread.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelwright.llm.common import read, store

#: Segments told apart; what follows is one wildcard ``**``.
DEPTH = 4
#: A branch of its own has at least this many rows and one ``FANOUT``-th of its node's.
SUPPORT, FANOUT = 8, 64
#: Rows that a parent's share counts for, and the squared normal quantile of a significant difference.
PRIOR, Z2 = 4.0, 3.84
#: Nodes of this many rows are looked up in ``SALTS`` copies.
HOT, SALTS = 4096, 16
REJECT = 0.5


class Rule(NamedTuple):
    """Host and path start, as in ``example.org/es/``; it fits the host and all its subdomains."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host):]


#: Fixed values of the contract.
RULES = (
    Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"), Rule("com/de/", "block"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path; both empty for NULL and where ``://`` is absent."""
    part = lambda i: F.coalesce(F.regexp_extract(url, PARTS, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as (pattern, verdict), or NULL.  Rules are an expression, at most 1000 of them."""
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules; give them as labels instead")
    found = F.lit(None).cast("struct<pattern:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.pattern), len(r.host), r.verdict == "block")):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _literal(segment: Column) -> Column:
    """A segment as a token: the signs of wildcards and groups percent-encoded."""
    for sign in "*<{|}":
        segment = F.replace(segment, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return segment


def _shape(segment: Column) -> Column:
    """Wildcard of a segment's kind: runs of digits and of letters each become one sign."""
    return F.concat(F.lit("<"), F.regexp_replace(F.regexp_replace(_literal(segment), "[0-9]+", "0"), "[A-Za-z]+", "a"), F.lit(">"))


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("_n", "_allow", "_block")]


def _enough(n: Column, total: Column) -> Column:
    return (n >= SUPPORT) & (n * FANOUT >= total)


def _branches(rows: DataFrame, segment: Column) -> DataFrame:
    """One map per node of (_host, _pre): branch to its merged group's token and sums."""
    node = ["_host", "_pre", "_total"]
    children = rows.groupBy(*node, segment.alias("_seg")).agg(F.count("*").alias("_n"), F.sum("_allow").alias("_allow"), F.sum("_block").alias("_block"))
    own = F.when(_enough(F.col("_n"), F.col("_total")), _literal(F.col("_seg"))).otherwise(_shape(F.col("_seg")))
    typed = children.groupBy(*node, own.alias("_branch")).agg(*_sums())
    common = ~F.col("_branch").startswith("<") | _enough(F.col("_n"), F.col("_total"))
    branches = typed.groupBy(*node, F.when(common, F.col("_branch")).otherwise(F.lit("*")).alias("_branch")).agg(*_sums())
    seen = F.col("_allow") + F.col("_block")
    share = (F.col("_block") + F.lit(1.0)) / (seen + F.lit(2.0))
    branches = branches.withColumn("_share", F.when(seen > 0, share)).withColumn("_var", F.col("_share") * (F.lit(1.0) - F.col("_share")) / (seen + F.lit(3.0)))
    w = Window.partitionBy(*node).orderBy(F.col("_share").asc_nulls_last(), "_branch")
    gap = F.col("_share") - F.lag("_share").over(w)
    apart = F.col("_share").isNull() | F.coalesce(gap * gap >= F.lit(Z2) * (F.col("_var") + F.lag("_var").over(w)), F.lit(True))
    grouped = branches.withColumn("_apart", apart.cast("int")).withColumn("_group", F.sum("_apart").over(w))
    groups = grouped.groupBy(*node, "_group").agg(F.array_sort(F.collect_list("_branch")).alias("_members"), *_sums())
    token = F.when(F.size("_members") == 1, F.col("_members")[0]).otherwise(F.concat(F.lit("{"), F.array_join("_members", "|"), F.lit("}")))
    entry = F.struct(token.alias("token"), F.col("_n").alias("n"), F.col("_allow").alias("allow"), F.col("_block").alias("block"))
    entries = groups.select(*node, F.explode("_members").alias("_branch"), entry.alias("_entry"))
    return entries.groupBy(*node).agg(F.map_from_entries(F.collect_list(F.struct("_branch", "_entry"))).alias("_map"))


def _salted(nodes: DataFrame, total: Column) -> DataFrame:
    return nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(total >= HOT, F.lit(SALTS - 1)).otherwise(F.lit(0)))))


def templates(rows: DataFrame) -> DataFrame:
    """Add ``template`` and ``blocked_share`` to rows of _host, _path, _allow and _block.

    The last two are 1 where a row is labelled so, else 0.  A row without path or
    host stays at its host's node, template ``/``.  Other columns are carried along.
    """
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)).cast("int")
    held = store(rows.withColumn("_spread", salt).withColumn("_segs", F.split(F.substring(F.col("_path"), F.lit(2), F.length("_path")), "/")))
    held = held.withColumn("_segs", F.when(F.col("_path") == "", F.array().cast("array<string>")).otherwise(F.col("_segs")))
    sums = held.agg(F.sum("_allow"), F.sum("_block")).first()
    overall = ((sums[1] or 0) + 1.0) / ((sums[0] or 0) + (sums[1] or 0) + 2.0)
    hosts = held.groupBy("_host").agg(F.count("*").alias("_total"), F.sum("_allow").alias("_a"), F.sum("_block").alias("_b"))
    smooth = lambda block, seen, parent: (block + F.lit(PRIOR) * parent) / (seen + F.lit(PRIOR))
    hosts = hosts.select("_host", "_total", smooth(F.col("_b"), F.col("_a") + F.col("_b"), F.lit(overall)).alias("_p"))
    # A host's rows are not known before this join, so every host is in all copies: three numbers each.
    hosts = hosts.withColumn("_spread", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    state = store(held.join(hosts, ["_host", "_spread"]).withColumn("_pre", F.lit("")))
    for depth in range(DEPTH):
        open_rows = state.filter(F.size("_segs") > depth)
        if depth and open_rows.isEmpty():
            break
        segment = F.col("_segs")[depth]
        nodes = _salted(_branches(open_rows, segment), F.col("_total")).drop("_total")
        joined = open_rows.withColumn("_salt", F.when(F.col("_total") >= HOT, F.col("_spread")).otherwise(F.lit(0))).join(nodes, ["_host", "_pre", "_salt"])
        of = lambda key: F.try_element_at(F.col("_map"), key)
        joined = joined.withColumn("_hit", F.coalesce(of(_literal(segment)), of(_shape(segment)), of(F.lit("*"))))
        hit = F.col("_hit")
        joined = joined.withColumn("_pre", F.concat("_pre", F.lit("/"), hit["token"])).withColumn("_total", hit["n"]).withColumn(
            "_p", smooth(hit["block"], hit["allow"] + hit["block"], F.col("_p")))
        state = store(joined.select(state.columns).unionAll(state.filter(F.size("_segs") <= depth)))
    tail = F.when(F.size("_segs") > DEPTH, F.concat("_pre", F.lit("/**"))).when(F.col("_pre") == "", F.lit("/")).otherwise(F.col("_pre"))
    return state.withColumn("template", tail).withColumnRenamed("_p", "blocked_share").drop("_spread", "_segs", "_total", "_pre")


def judge(urls: DataFrame, rules: tuple[Rule, ...] = RULES, labels: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and blocked_share of rows with page_id and url.

    A fitting rule decides, and rows decided by rules are the labels of the tree;
    ``labels`` names a further column of ``allow``, ``block`` or NULL.  All other rows
    are judged by their template.  NULL url and url without ``://`` have empty host
    and path.  Repeated rows are rows of their own, an empty table gives an empty one,
    other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    given = F.col(labels) if labels else F.lit(None).cast("string")
    parsed = urls.select("page_id", host.alias("_host"), path.alias("_path"), given.alias("_given"))
    parsed = parsed.withColumn("_rule", matching_rule(F.col("_host"), F.col("_path"), rules))
    label = F.coalesce(F.col("_rule")["verdict"], F.col("_given"))
    rows = parsed.select(
        "page_id", "_host", "_path", F.col("_rule")["pattern"].alias("rule"), F.col("_rule")["verdict"].alias("_verdict"),
        F.coalesce((label == "allow").cast("long"), F.lit(0)).alias("_allow"), F.coalesce((label == "block").cast("long"), F.lit(0)).alias("_block"))
    verdict = F.coalesce("_verdict", F.when(F.col("blocked_share") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return templates(rows).select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", verdict.alias("verdict"), "template", "blocked_share")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


def _sql() -> str:
    """The tree in SQL, its levels unrolled."""
    def literal(x):
        for sign in "*<{|}":
            x = f"replace({x}, '{sign}', '%{ord(sign):02X}')"
        return x

    def shape(x):
        return f"'<' || regexp_replace(regexp_replace({literal(x)}, '[0-9]+', '0', 'g'), '[A-Za-z]+', 'a', 'g') || '>'"

    enough = f"n >= {SUPPORT} AND n * {FANOUT} >= total"
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in sorted(RULES, key=lambda r: -len(r.pattern))]
    case = lambda value: "CASE " + " ".join(f"WHEN {c} THEN '{value(r)}'" for c, r in fits) + " END"
    url = PARTS
    parts = [f"""
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{url}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{url}', 2), '') AS path FROM pages),
r AS (SELECT *, {case(lambda r: r.pattern)} AS rule, {case(lambda r: r.verdict)} AS ruled FROM u),
x AS (SELECT row_number() OVER () AS id, *, CASE WHEN path = '' THEN [] ELSE string_split(substr(path, 2), '/') END AS segs,
        CAST(coalesce(ruled = 'allow', false) AS BIGINT) AS a, CAST(coalesce(ruled = 'block', false) AS BIGINT) AS b FROM r),
s0 AS (SELECT x.*, '' AS pre, count(*) OVER h AS total,
         (sum(b) OVER h + {PRIOR}::DOUBLE * ((sum(b) OVER () + 1e0) / (sum(a) OVER () + sum(b) OVER () + 2e0))) / (sum(a) OVER h + sum(b) OVER h + {PRIOR}::DOUBLE) AS p
       FROM x WINDOW h AS (PARTITION BY host))"""]
    for d in range(DEPTH):
        seg = f"segs[{d + 1}]"
        parts.append(f"""
c{d} AS (SELECT host, pre, total, {seg} AS seg, count(*) AS n FROM s{d} WHERE len(segs) > {d} GROUP BY ALL),
y{d} AS (SELECT *, CASE WHEN {enough} THEN {literal('seg')} ELSE {shape('seg')} END AS own FROM c{d}),
z{d} AS (SELECT host, pre, total, own, sum(n) AS n FROM y{d} GROUP BY ALL),
w{d} AS (SELECT s.*, CASE WHEN NOT starts_with(y.own, '<') OR (z.n >= {SUPPORT} AND z.n * {FANOUT} >= z.total) THEN y.own ELSE '*' END AS branch
         FROM s{d} s JOIN y{d} y ON s.host = y.host AND s.pre = y.pre AND s.{seg} = y.seg JOIN z{d} z ON y.host = z.host AND y.pre = z.pre AND y.own = z.own),
b{d} AS (SELECT host, pre, branch, count(*) AS n, sum(a) AS a, sum(b) AS b FROM w{d} GROUP BY ALL),
p{d} AS (SELECT *, CASE WHEN a + b > 0 THEN (b + 1e0) / (a + b + 2e0) END AS q FROM b{d}),
v{d} AS (SELECT *, q * (1e0 - q) / (a + b + 3e0) AS var FROM p{d}),
l{d} AS (SELECT *, q - lag(q) OVER o AS gap, lag(var) OVER o AS last FROM v{d} WINDOW o AS (PARTITION BY host, pre ORDER BY q NULLS LAST, branch)),
g{d} AS (SELECT *, sum(CASE WHEN q IS NULL OR coalesce(gap * gap >= {Z2}::DOUBLE * (var + last), true) THEN 1 ELSE 0 END) OVER (PARTITION BY host, pre ORDER BY q NULLS LAST, branch) AS grp FROM l{d}),
m{d} AS (SELECT host, pre, grp, sum(n) AS n, sum(a) AS a, sum(b) AS b, CASE WHEN count(*) = 1 THEN min(branch) ELSE '{{' || string_agg(branch, '|' ORDER BY branch) || '}}' END AS token FROM g{d} GROUP BY ALL),
s{d + 1} AS (
  SELECT w.id, w.page_id, w.host, w.path, w.rule, w.ruled, w.segs, w.a, w.b, w.pre || '/' || m.token AS pre, m.n AS total, (m.b + {PRIOR}::DOUBLE * w.p) / (m.a + m.b + {PRIOR}::DOUBLE) AS p
  FROM w{d} w JOIN g{d} g ON w.host = g.host AND w.pre = g.pre AND w.branch = g.branch JOIN m{d} m ON g.host = m.host AND g.pre = m.pre AND g.grp = m.grp
  UNION ALL SELECT id, page_id, host, path, rule, ruled, segs, a, b, pre, total, p FROM s{d} WHERE len(segs) <= {d})""")
    return "WITH" + ",".join(parts) + f"""
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN p >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN len(segs) > {DEPTH} THEN pre || '/**' WHEN pre = '' THEN '/' ELSE pre END AS template, p AS blocked_share
FROM s{DEPTH}"""


SQL = _sql()
