"""Queries over tables of factor definitions.

The candidate table has one row per part: its definition text follows from the
part's attributes and its metrics from the part's order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.functions import text
from panelwright.operators import catalog, screen
from panelwright.plans import factors as f, recipes
from panelwright.plans.factors import factor_long, factor_wide, fld
from panelwright.session import cut_lineage
from panelwright.sources.panel import Panel, table, weekly_panel
from panelwright.suite.base import Check, LIBRARY, R, centred_sql, cte, daily, library_factors, r6, rank_corr_sql, rounded, sql, stored_panel
from panelwright.suite.evaluation import grade_sql

CHECKS: dict[str, Check] = {}
GATES = catalog.Gates(min_grade="C", min_rank_ic=0.02)


def _add(name: str, covers: str, run, query: str | None) -> None:
    CHECKS[name] = Check(run, query, covers)


# The definition texts candidates take, with n for a whole number.
TEMPLATES = [
    ("momentum", "rank(ts_return(close, {n}))", True),
    ("reversal", "winsorize(-ts_return(close, {n}), lower=0.01, upper=0.99)", True),
    ("volume", "rank(ts_rank(volume, {n}))", False),
    ("volume", "rank(delta(close, {n}) / (ts_mean(volume, {n}) + 1))", False),
    ("momentum", "neutralize_industry(rank(ts_return( close , {n})))", False),
    ("value_proxy", "rank(1 / market_cap)", False),
]


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    exact = F.col("l_discount").cast("decimal(6,2)")

    def mean(condition=None):
        value = exact if condition is None else F.when(condition, exact)
        return (F.sum(value).cast("double") / F.count(value) - 0.05) * 5

    metrics = lines.groupBy("l_partkey").agg(
        mean().alias("mean_rank_ic"),
        F.coalesce(mean(F.col("l_returnflag") == "A"), F.lit(0.0)).alias("validation_rank_ic"),
        F.coalesce(mean(F.col("l_returnflag") == "R"), F.lit(0.0)).alias("test_rank_ic"),
        F.coalesce(mean(F.col("l_returnflag") == "N"), F.lit(0.0)).alias("recent_rank_ic"),
        (F.sum(F.when(exact > 0.05, 1).otherwise(0)) / F.count("*")).alias("rank_ic_win_rate"),
        (F.sum(F.col("l_tax").cast("decimal(6,2)")).cast("double") / F.count("*") * 20).alias("turnover_estimate"),
        (F.sum(F.col("l_quantity").cast("decimal(8,0)")).cast("double") / F.count("*") / 50).alias("max_similarity"),
        (F.count("*") * 5).alias("valid_days"),
    )
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    which = key % len(TEMPLATES)

    def chosen(values):
        out = F.lit(None)
        for i, v in enumerate(values):
            out = F.when(which == i, v).otherwise(out)
        return out

    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("part_"), key.cast("string")).alias("factor_name"),
        F.when(key % 11 != 0, chosen([F.lit(t[0]) for t in TEMPLATES])).alias("family"),
        chosen([F.concat(*_pieces(t[1], size)) for t in TEMPLATES]).alias("expression"),
        F.when(which <= 1, F.array(F.lit("close"))).otherwise(F.array().cast("array<string>")).alias("required_fields"),
        F.when(which == 5, F.array().cast("array<int>")).otherwise(F.array("p_size")).alias("lookback_windows"),
        (F.col("p_size") + 5).alias("complexity_score"),
        F.round(F.col("p_retailprice") / 4000, 6).alias("novelty_score"),
        F.when(key % 17 == 0, "timeout").alias("error"),
        (key % 13 == 0).alias("diversity_rejected"),
        (F.col("p_size") % 4).alias("generation"),
    )
    joined = parts.join(metrics, F.col("p_partkey") == F.col("l_partkey")).drop("l_partkey")
    with_ratios = joined.withColumn("rank_ic_ir", F.col("mean_rank_ic") * 12).withColumn("ic_ir", F.col("mean_rank_ic") * 9)
    return screen.grade(with_ratios).drop("failed", "failed_criteria")


def _pieces(template: str, size):
    parts = []
    for i, piece in enumerate(template.split("{n}")):
        if i:
            parts.append(size)
        parts.append(F.lit(piece))
    return parts


def _mean_sql(flag: str | None = None) -> str:
    where = f" FILTER (l_returnflag = '{flag}')" if flag else ""
    return f"(CAST(sum(CAST(l_discount AS DECIMAL(6,2))){where} AS DOUBLE) / nullif(count(*){where}, 0) - 0.05) * 5"


def _case(values: list[str]) -> str:
    return f"CASE p_partkey % {len(TEMPLATES)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


cte("part_rows", (), f"""
  SELECT p_partkey, 'part_' || p_partkey AS factor_name,
         CASE WHEN p_partkey % 11 <> 0 THEN {_case([f"'{t[0]}'" for t in TEMPLATES])} END AS family,
         {_case(["replace('" + t[1] + "', '{n}', CAST(p_size AS VARCHAR))" for t in TEMPLATES])} AS expression,
         CASE WHEN p_partkey % 6 <= 1 THEN ['close'] ELSE CAST([] AS VARCHAR[]) END AS required_fields,
         CASE WHEN p_partkey % 6 = 5 THEN CAST([] AS INTEGER[]) ELSE [p_size] END AS lookback_windows,
         p_size + 5 AS complexity_score, round(p_retailprice / 4000, 6) AS novelty_score,
         CASE WHEN p_partkey % 17 = 0 THEN 'timeout' END AS error, p_partkey % 13 = 0 AS diversity_rejected, p_size % 4 AS generation
  FROM part""")
cte("candidate_metrics", ("part_rows",), f"""
  SELECT p.*, m.* EXCLUDE (l_partkey), mean_rank_ic * 12 AS rank_ic_ir, mean_rank_ic * 9 AS ic_ir FROM part_rows p JOIN (
    SELECT l_partkey, {_mean_sql()} AS mean_rank_ic, coalesce({_mean_sql('A')}, 0) AS validation_rank_ic, coalesce({_mean_sql('R')}, 0) AS test_rank_ic,
           coalesce({_mean_sql('N')}, 0) AS recent_rank_ic, count(*) FILTER (CAST(l_discount AS DECIMAL(6,2)) > 0.05) / count(*) AS rank_ic_win_rate,
           CAST(sum(CAST(l_tax AS DECIMAL(6,2))) AS DOUBLE) / count(*) * 20 AS turnover_estimate,
           CAST(sum(CAST(l_quantity AS DECIMAL(8,0))) AS DOUBLE) / count(*) / 50 AS max_similarity, count(*) * 5 AS valid_days
    FROM lineitem GROUP BY 1) m ON p.p_partkey = m.l_partkey""")
cte("graded", ("candidate_metrics",), grade_sql("candidate_metrics", "* EXCLUDE (quality_score, failed_criteria)"))
_POINTS = "CASE grade WHEN 'A' THEN 5 WHEN 'B' THEN 4 WHEN 'C' THEN 3 WHEN 'D' THEN 2 WHEN 'F' THEN 1 ELSE 0 END"
_PASS = (
    f"{_POINTS} >= 3 AND abs(mean_rank_ic) >= 0.02 AND (validation_rank_ic = 0 OR abs(validation_rank_ic) >= 0.01) "
    "AND (test_rank_ic = 0 OR abs(test_rank_ic) >= 0.01) AND complexity_score <= 60 AND error IS NULL AND NOT diversity_rejected"
)
_KEY = (
    f"{_POINTS} DESC, abs(validation_rank_ic) DESC, abs(test_rank_ic) DESC, abs(recent_rank_ic) DESC, novelty_score DESC, "
    "abs(mean_rank_ic) DESC, max_similarity, complexity_score, factor_name"
)
cte("cands", ("graded",), f"""
  SELECT *, {_PASS} AS passes, row_number() OVER (ORDER BY {_KEY}) AS ord,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(expression, '\\s+', '', 'g'), ',?lower=[+-]?\\d+(\\.\\d+)?', '', 'g'),
           ',?upper=[+-]?\\d+(\\.\\d+)?', '', 'g'), '([^A-Za-z_0-9])\\d+', '\\1N', 'g') AS structure_signature,
         list_sort(list_distinct(regexp_extract_all(expression, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1))) AS ops,
         list_sort(CASE WHEN len(required_fields) > 0 THEN required_fields ELSE list_filter(
           ['open', 'high', 'low', 'close', 'volume', 'amount', 'vwap', 'market_cap', 'industry'],
           lambda x: list_contains(regexp_extract_all(expression, '[A-Za-z_][A-Za-z0-9_]*'), x)) END) AS fields
  FROM graded""")


def described(spark, sf_dir):
    return catalog.describe(candidates(spark, sf_dir))


def _describe(spark, sf_dir):
    d = described(spark, sf_dir)
    return d.select("factor_name", "structure_signature", F.array_join("ops", "+").alias("ops"), F.array_join("fields", "+").alias("fields"), "code_hash")


_add("describe_definitions", "C1, C2, U6", _describe, sql(
    "SELECT factor_name, structure_signature, list_aggregate(ops, 'string_agg', '+') AS ops, list_aggregate(fields, 'string_agg', '+') AS fields, "
    "substring(md5(trim(expression)), 1, 12) AS code_hash FROM cands", "cands"))


def _spec_json(spark, sf_dir):
    specs = catalog.to_spec_json(candidates(spark, sf_dir)).select("spec")
    back = catalog.from_spec_json(specs)
    return back.select("factor_name", "family", "expression", F.size("required_fields").cast("long").alias("n_fields"),
                       F.coalesce(F.array_max("lookback_windows"), F.lit(0)).alias("longest"))


_add("definition_json", "json functions of 2.11", _spec_json, sql(
    "SELECT factor_name, family, expression, len(required_fields) AS n_fields, coalesce(list_max(lookback_windows), 0) AS longest FROM graded", "graded"))
_add("distinct_definitions", "U6, U2", lambda spark, sf_dir: catalog.distinct_definitions(described(spark, sf_dir)).select("factor_name", "structure_signature"), sql(
    "SELECT min(factor_name) AS factor_name, structure_signature FROM cands GROUP BY structure_signature", "cands"))
_NICHE = (
    "coalesce(family, 'unknown') AS niche_family, CASE WHEN len(lookback_windows) = 0 THEN 'static' WHEN list_max(lookback_windows) <= 10 THEN 'short' "
    "WHEN list_max(lookback_windows) <= 40 THEN 'medium' ELSE 'long' END AS niche_horizon, "
    "coalesce(list_aggregate(ops[1:3], 'string_agg', '+'), 'python') AS niche_ops, coalesce(list_aggregate(fields[1:3], 'string_agg', '+'), 'unknown') AS niche_fields"
)
cte("niches", ("cands",), f"SELECT *, {_NICHE} FROM cands")
_add("niche_key", "C4", lambda spark, sf_dir: catalog.niche_key(described(spark, sf_dir)).select(
    "factor_name", "niche_family", "niche_horizon", "niche_ops", "niche_fields"), sql(
    "SELECT factor_name, niche_family, niche_horizon, niche_ops, niche_fields FROM niches", "niches"))

_add("passes", "C8", lambda spark, sf_dir: candidates(spark, sf_dir).select("factor_name", "grade", catalog.passes(GATES).alias("passes")), sql(
    "SELECT factor_name, grade, passes FROM cands", "cands"))


def _direction(spark, sf_dir):
    return catalog.direction_and_recommendation(candidates(spark, sf_dir), GATES).select("factor_name", "alpha_direction", "recommendation")


_WARN = (
    "concat_ws(', ', CASE WHEN complexity_score > 60 THEN 'high complexity' END, "
    "CASE WHEN validation_rank_ic <> 0 AND abs(validation_rank_ic) < 0.01 THEN 'weak validation IC' END, "
    "CASE WHEN test_rank_ic <> 0 AND abs(test_rank_ic) < 0.01 THEN 'weak test IC' END, CASE WHEN turnover_estimate > 0.8 THEN 'high turnover' END)"
)
_add("direction_and_recommendation", "C9", _direction, sql(
    "SELECT factor_name, CASE WHEN mean_rank_ic < 0 THEN 'inverse_alpha' ELSE 'positive_alpha' END AS alpha_direction, "
    f"CASE WHEN passes THEN 'keep' WHEN {_WARN} <> '' THEN 'investigate: ' || {_WARN} ELSE 'reject' END AS recommendation FROM cands", "cands"))

_TOP = ["factor_name", "family", "grade", "quality_score", "mean_rank_ic", "validation_rank_ic", "test_rank_ic", "recent_rank_ic", "novelty_score", "complexity_score"]
_add("top_factor_table", "C11, O7", lambda spark, sf_dir: rounded(catalog.top_factor_table(candidates(spark, sf_dir), GATES, 50).select(*_TOP)), sql(
    "SELECT " + ", ".join(f"{R(c)} AS {c}" if c.endswith(("_ic", "novelty_score")) else c for c in _TOP) + " FROM cands WHERE passes ORDER BY ord LIMIT 50", "cands"))
_add("sort_by_strength", "O8, P14", lambda spark, sf_dir: rounded(screen.sort_by_strength(catalog.candidate_filter(
    candidates(spark, sf_dir), clean_only=True, families=["momentum", "volume"])).select("factor_name", "family", "mean_rank_ic")), sql(
    f"SELECT factor_name, family, {R('mean_rank_ic')} AS mean_rank_ic FROM cands WHERE error IS NULL AND family IN ('momentum', 'volume')", "cands"))
_add("leaderboard", "O4", lambda spark, sf_dir: rounded(screen.leaderboard(candidates(spark, sf_dir), 25).select("factor_name", "quality_score", "rank_ic_ir")), sql(
    f"SELECT factor_name, quality_score, {R('rank_ic_ir')} AS rank_ic_ir FROM cands ORDER BY cands.quality_score DESC, cands.rank_ic_ir DESC, factor_name LIMIT 25", "cands"))
_add("place_all", "O1 without a size bound", lambda spark, sf_dir: screen.place(candidates(spark, sf_dir).select("factor_name", "mean_rank_ic"), "mean_rank_ic", "factor_name", "place").select("factor_name", "place"), sql(
    "SELECT factor_name, row_number() OVER (ORDER BY mean_rank_ic DESC, factor_name) AS place FROM cands", "cands"))


def _reference(spark, sf_dir):
    d = described(spark, sf_dir)
    return d.filter("generation = 0"), d.filter("generation <> 0")


_SIM = (
    "0.35 * CASE WHEN c.structure_signature <> '' AND c.structure_signature = r.structure_signature THEN 1 ELSE 0 END "
    "+ 0.25 * len(list_intersect(c.ops, r.ops)) / len(list_distinct(list_concat(c.ops, r.ops))) "
    "+ 0.20 * len(list_intersect(c.fields, r.fields)) / len(list_distinct(list_concat(c.fields, r.fields))) "
    "+ 0.20 * CASE WHEN coalesce(c.family, 'unknown') = coalesce(r.family, 'unknown') THEN 1 ELSE 0 END"
)
cte("novel", ("cands",), f"""
  SELECT c.factor_name, greatest(0, least(1, 1 - max({_SIM}))) AS novelty FROM
    (SELECT * FROM cands WHERE generation <> 0) c, (SELECT * FROM cands WHERE generation = 0 AND passes) r GROUP BY c.factor_name""")


def _novelty(spark, sf_dir):
    ref, new = _reference(spark, sf_dir)
    return catalog.novelty(new.drop("novelty_score"), ref.filter(catalog.passes(GATES))).select("factor_name", r6("novelty_score").alias("novelty_score"))


_add("novelty", "C3", _novelty, sql(f"SELECT factor_name, {R('novelty')} AS novelty_score FROM novel", "novel"))


def _novelty_flags(spark, sf_dir):
    ref, new = _reference(spark, sf_dir)
    return catalog.novelty_flags(new.drop("novelty_score"), ref.withColumn("novelty_score", F.lit(1.0)), GATES).select("factor_name", "diversity_rejected", "most_similar_to")


_add("novelty_flags", "C7 without penalty", _novelty_flags, sql(
    "SELECT factor_name, diversity_rejected OR (error IS NULL AND novelty < 0.25) AS diversity_rejected, "
    "CASE WHEN error IS NULL AND novelty < 0.25 THEN 'low_structural_novelty' ELSE '' END AS most_similar_to FROM cands JOIN novel USING (factor_name)", "cands", "novel"))


def _survivors(spark, sf_dir):
    d = described(spark, sf_dir)
    return catalog.select_survivors(d, 60, GATES).select("factor_name", F.col("pick").cast("long").alias("pick"))


cte("good", ("niches",), "SELECT * FROM niches WHERE passes")
cte("firsts", ("good",), "SELECT factor_name, 1 AS stage, ord AS pos FROM (SELECT factor_name, ord, row_number() OVER (PARTITION BY niche_family, niche_horizon, niche_ops, niche_fields ORDER BY ord) AS k FROM good) WHERE k = 1 ORDER BY ord LIMIT 60")
cte("seconds", ("good",), "SELECT factor_name, 2 AS stage, 1 AS pos FROM good ORDER BY max_similarity, abs(mean_rank_ic) DESC, complexity_score, ord LIMIT 1")
cte("thirds", ("good",), "SELECT factor_name, 3 AS stage, 1 AS pos FROM good ORDER BY abs(CASE WHEN recent_rank_ic <> 0 THEN recent_rank_ic ELSE mean_rank_ic END) DESC, ord LIMIT 1")
cte("fourths", ("niches", "firsts", "seconds", "thirds"), """
  SELECT factor_name, 4 AS stage, 1 AS pos FROM niches WHERE error IS NULL AND NOT diversity_rejected
    AND factor_name NOT IN (SELECT factor_name FROM firsts UNION ALL SELECT factor_name FROM seconds UNION ALL SELECT factor_name FROM thirds)
  ORDER BY abs(recent_rank_ic) DESC, complexity_score, abs(mean_rank_ic) DESC, ord LIMIT 1""")
cte("picks", ("firsts", "seconds", "thirds", "fourths", "good"), """
  SELECT * FROM firsts UNION ALL SELECT * FROM seconds UNION ALL SELECT * FROM thirds UNION ALL SELECT * FROM fourths
  UNION ALL SELECT factor_name, 5, ord FROM good""")
_add("select_survivors", "C10", _survivors, sql(
    "SELECT factor_name, pick FROM (SELECT factor_name, row_number() OVER (ORDER BY stage, pos) AS pick FROM ("
    "SELECT factor_name, min(stage) AS stage, arg_min(pos, stage) AS pos FROM picks GROUP BY factor_name)) WHERE pick <= 60", "picks"))


# Thresholds no rank correlation of six or seven points can equal.
CLOSE = catalog.Gates(min_grade="C", min_rank_ic=0.02, value_corr=0.95, ic_corr=0.95)
# Texts name a style so that structures repeat a few times each.
STYLES = 300


def _rivals(spark, sf_dir):
    """Candidates whose texts name a style, with their value and day series."""
    named = table(spark, sf_dir, "part").select(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("factor_name"),
        F.concat(F.lit(" + style_"), F.translate((F.col("p_partkey") % STYLES).cast("string"), "0123456789", "abcdefghij")).alias("_more"))
    plain = candidates(spark, sf_dir).join(named, "factor_name").withColumn("expression", F.concat("expression", "_more")).drop("_more")
    lines = table(spark, sf_dir, "lineitem").withColumn("factor_name", F.concat(F.lit("part_"), F.col("l_partkey").cast("string")))
    values = lines.groupBy("factor_name", F.floor(F.col("l_quantity") / 8).cast("string").alias("entity"), F.lit("2000-01-01").cast("date").alias("date")).agg(
        (F.sum(F.col("l_tax").cast("decimal(6,2)")).cast("double") / F.count("*")).alias("value"))
    days = lines.groupBy("factor_name", F.trunc("l_shipdate", "year").alias("date")).agg(
        (F.sum(F.col("l_discount").cast("decimal(6,2)")).cast("double") / F.count("*")).alias("rank_ic"))
    return cut_lineage(catalog.describe(plain)), cut_lineage(values), cut_lineage(days)


def _diversity(spark, sf_dir):
    """Three generations judged against the first and against each other, on series of their own."""
    from panelwright.operators import similarity

    d, values, days = _rivals(spark, sf_dir)
    new, reference = d.filter("generation <> 0"), d.filter("generation = 0")
    asked, against = catalog.likeness_ends(new, reference, CLOSE)
    value_pairs = similarity.value_similarity(values, min_overlap=6, against=against, spread=False, asked=asked)
    day_pairs = similarity.ic_similarity(days, min_days=6, against=against, asked=asked)
    flagged = catalog.diversity_flags(new, reference, value_pairs, day_pairs, CLOSE)
    return flagged.select("factor_name", "diversity_rejected", r6("max_similarity").alias("max_similarity"),
                          r6("ic_series_max_similarity").alias("ic_series_max_similarity"), "most_similar_to", r6("novelty_score").alias("novelty_score"))


cte("rivals", ("cands",), f"""
  SELECT c.* REPLACE (c.structure_signature || '+style_' || translate(CAST(p_partkey % {STYLES} AS VARCHAR), '0123456789', 'abcdefghij') AS structure_signature),
         regexp_replace(c.expression || '+style_' || translate(CAST(p_partkey % {STYLES} AS VARCHAR), '0123456789', 'abcdefghij'), '\\s+', '', 'g') AS compact
  FROM cands c""")
cte("rival_values", (), """
  SELECT 'part_' || l_partkey AS factor_name, CAST(CAST(floor(l_quantity / 8) AS BIGINT) AS VARCHAR) AS entity, CAST(sum(CAST(l_tax AS DECIMAL(6,2))) AS DOUBLE) / count(*) AS value FROM lineitem GROUP BY 1, 2""")
cte("rival_days", (), """
  SELECT 'part_' || l_partkey AS factor_name, date_trunc('year', l_shipdate) AS date, CAST(sum(CAST(l_discount AS DECIMAL(6,2))) AS DOUBLE) / count(*) AS rank_ic
  FROM lineitem GROUP BY 1, 2""")


def _one_sided(source: str, key: str, value: str) -> str:
    """|Spearman| of every candidate with every passing one, in both directions."""
    pair = "name, other"
    return (
        f"SELECT name, other, abs({rank_corr_sql('rx', 'ry')}) AS sim FROM (SELECT name, other, {centred_sql('x', pair)} AS rx, {centred_sql('y', pair)} AS ry FROM ("
        f"SELECT a.factor_name AS name, b.factor_name AS other, a.{value} AS x, b.{value} AS y FROM {source} a JOIN {source} b ON a.{key} = b.{key} AND a.factor_name <> b.factor_name "
        "WHERE b.factor_name IN (SELECT factor_name FROM rivals WHERE passes))) GROUP BY 1, 2 HAVING count(*) >= 6"
    )


cte("value_near", ("rivals", "rival_values"), _one_sided("rival_values", "entity", "value"))
cte("day_near", ("rivals", "rival_days"), _one_sided("rival_days", "date", "rank_ic"))
# The references have places below 1; the fold walks the candidates in order and remembers the places accepted.
cte("turns", ("rivals",), """
  SELECT *, CASE WHEN generation = 0 THEN -ord ELSE row_number() OVER (PARTITION BY generation = 0, error IS NULL AND NOT diversity_rejected ORDER BY ord) END AS turn,
         generation <> 0 AND error IS NULL AND NOT diversity_rejected AS judged FROM rivals""")
cte("stoppers", ("turns", "value_near", "day_near"), """
  SELECT c.turn, coalesce(list(DISTINCT r.turn) FILTER (r.compact = c.compact), []) AS texts,
         coalesce(list(DISTINCT r.turn) FILTER (r.structure_signature = c.structure_signature), []) AS structures,
         coalesce(list(DISTINCT r.turn) FILTER (v.sim >= 0.95 OR d.sim >= 0.95), []) AS near, any_value(c.passes) AS passes
  FROM turns c LEFT JOIN turns r ON r.passes AND r.factor_name <> c.factor_name
  LEFT JOIN value_near v ON v.name = c.factor_name AND v.other = r.factor_name LEFT JOIN day_near d ON d.name = c.factor_name AND d.other = r.factor_name
  WHERE c.judged GROUP BY c.turn""")
cte("verdicts", ("turns", "stoppers"), """
  WITH RECURSIVE fold AS (
    SELECT CAST(0 AS BIGINT) AS turn, list(turn) FILTER (generation = 0 AND passes) AS held, '' AS state FROM turns
    UNION ALL
    SELECT turn, CASE WHEN state = 'accepted' AND passes THEN list_append(held, turn) ELSE held END, state FROM (
      SELECT s.turn, f.held, s.passes, CASE WHEN list_has_any(s.texts, f.held) THEN 'same_expression' WHEN list_has_any(s.structures, f.held) THEN 'same_structure'
             WHEN list_has_any(s.near, f.held) THEN 'similar' ELSE 'accepted' END AS state
      FROM fold f JOIN stoppers s ON s.turn = f.turn + 1))
  SELECT turn, state FROM fold WHERE turn > 0""")
cte("judged", ("turns", "verdicts"), "SELECT t.*, v.state FROM turns t LEFT JOIN verdicts v ON t.judged AND t.turn = v.turn")
cte("held", ("judged",), "SELECT * FROM judged WHERE passes AND (generation = 0 OR state = 'accepted')")
cte("nearest", ("judged", "held", "value_near", "day_near"), f"""
  SELECT c.factor_name, coalesce(max(v.sim), 0) AS value_sim, coalesce(max(d.sim), 0) AS day_sim, greatest(0, least(1, 1 - max({_SIM}))) AS novelty,
         arg_max(r.factor_name, (v.sim, -r.turn)) FILTER (v.sim > 0 AND r.generation <> 0) AS other,
         arg_min(r.factor_name, (-v.sim, r.factor_name)) FILTER (v.sim > 0 AND r.generation = 0) AS first_ref, max(v.sim) FILTER (r.generation = 0) AS ref_sim
  FROM (SELECT * FROM judged WHERE judged) c LEFT JOIN held r ON r.turn < c.turn
  LEFT JOIN value_near v ON v.name = c.factor_name AND v.other = r.factor_name LEFT JOIN day_near d ON d.name = c.factor_name AND d.other = r.factor_name
  GROUP BY 1""")
cte("flags", ("judged", "nearest"), """
  SELECT *, CASE WHEN ref_sim >= value_sim THEN first_ref ELSE other END AS who, state IN ('same_expression', 'same_structure') AS repeated FROM judged LEFT JOIN nearest USING (factor_name) WHERE generation <> 0""")
_add("diversity_flags", "C7 with references, C5 and C6 one-sided", _diversity, sql(
    f"SELECT factor_name, CASE WHEN judged THEN state <> 'accepted' ELSE diversity_rejected END AS diversity_rejected, "
    f"CASE WHEN NOT judged THEN {R('max_similarity')} WHEN repeated THEN 1.0 ELSE {R('value_sim')} END AS max_similarity, "
    f"CASE WHEN judged THEN CASE WHEN repeated THEN {R('0')} ELSE {R('day_sim')} END END AS ic_series_max_similarity, "
    "CASE WHEN judged THEN CASE WHEN repeated THEN state WHEN state = 'similar' AND value_sim < 0.95 THEN coalesce(who, 'similar_ic_series') ELSE coalesce(who, '') END END AS most_similar_to, "
    f"CASE WHEN judged AND NOT repeated THEN {R('coalesce(novelty, 1)')} ELSE {R('novelty_score')} END AS novelty_score FROM flags", "flags"))


def _sweep(spark, sf_dir):
    """Window, wrapper and swap variants as one job."""
    base = {"m": (lambda n: f.rank(f.ts_return(fld("close"), n)), (4,))}
    terms = recipes.sweep(base, windows=(2, 4, 8), wrappers=("zscore",), sign_flip=True, neutralisers=False)
    long = factor_long(weekly_panel(spark, sf_dir), terms)
    return rounded(long.groupBy("factor_name").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")))


_r = "rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0"


def _variant(name: str, x: str, outer: str = "v") -> str:
    return (
        f"SELECT '{name}' AS factor_name, entity, date, {outer} AS v FROM (SELECT *, CASE WHEN x IS NOT NULL THEN ({_r.format(x='x')}) / count(x) OVER (PARTITION BY date) END AS v "
        f"FROM (SELECT *, {x} AS x FROM grid WINDOW e AS (PARTITION BY entity ORDER BY date))) WHERE present AND v IS NOT NULL"
    )


def _ret(n: int) -> str:
    return f"close / nullif(lag(close, {n}) OVER e, 0) - 1"


_variants = [
    _variant("m__window_2", _ret(2)), _variant("m__window_8", _ret(8)),
    _variant("m__operator_ts_return_to_delta", "close - lag(close, 4) OVER e"),
    _variant("m__sign_flip", _ret(4), "-v"),
]
_all = (
    f"SELECT 'm__transform_zscore' AS factor_name, (v - avg(v) OVER d) / nullif(stddev_samp(v) OVER d, 0) AS v, present FROM ("
    f"SELECT date, present, CASE WHEN x IS NOT NULL THEN ({_r.format(x='x')}) / count(x) OVER (PARTITION BY date) END AS v "
    f"FROM (SELECT *, {_ret(4)} AS x FROM grid WINDOW e AS (PARTITION BY entity ORDER BY date))) WINDOW d AS (PARTITION BY date)"
)
_add("sweep", "C12", _sweep, sql(
    f"SELECT factor_name, count(*) AS n, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std FROM ("
    + " UNION ALL ".join(f"SELECT factor_name, v FROM ({v})" for v in _variants)
    + f" UNION ALL SELECT factor_name, v FROM ({_all}) WHERE present AND v IS NOT NULL) GROUP BY 1", "grid"))


def _crossover(spark, sf_dir):
    a, b = LIBRARY["momentum_4"], LIBRARY["liquidity_8"]
    terms = recipes.crossover([("momentum_4", a, "liquidity_8", b), ("liquidity_8", b, "momentum_4", a)])
    long = factor_long(weekly_panel(spark, sf_dir), terms)
    return rounded(long.select("factor_name", "entity", "date", "value"))


def _crossed(name: str, x: str) -> str:
    return (f"SELECT '{name}' AS factor_name, entity, date, present, CASE WHEN x IS NOT NULL THEN ({_r.format(x='x')}) / count(x) OVER (PARTITION BY date) END AS value "
            f"FROM (SELECT *, {x} AS x FROM wide)")


_add("crossover", "C12", _crossover, sql(
    f"SELECT factor_name, entity, date, {R('value')} AS value FROM (" + _crossed("crossover_momentum_4_liquidity_8", "momentum_4 + liquidity_8")
    + " UNION ALL " + _crossed("crossover_liquidity_8_momentum_4", "liquidity_8 - momentum_4") + ") WHERE present AND value IS NOT NULL", "wide"))


def _audit(spark, sf_dir):
    """All recipes on the whole panel against the panel cut at mid-calendar, and a planted peek."""
    panel = stored_panel(spark, sf_dir, ["close", "volume", "amount", "vwap", "market_cap", "industry"])
    short = {"5": 2, "10": 4, "20": 8, "60": 13, "1": 1}
    terms = {r.recipe_id: r.term(*[short[str(w)] for w in r.windows]) for r in recipes.RECIPES}
    cut = F.lit("1998-06-29").cast("date")
    before = Panel(panel.df.filter(F.col("date") <= cut), panel.names_bound)

    def with_planted(p):
        return factor_wide(p, terms, ["close"]).withColumn("planted_lead", F.lead("close").over(f.ts.entity_window())).drop("close")

    return catalog.lookahead_audit_wide(with_planted(panel), with_planted(before), [*terms, "planted_lead"], cut).select(
        "factor_name", (F.col("checked") > 0).alias("checked"), (F.col("mismatches") > 0).alias("looks_ahead"))


_add("lookahead_audit", "C13, F1", _audit, "SELECT unnest([" + ", ".join(f"'{r.recipe_id}'" for r in recipes.RECIPES)
     + ", 'planted_lead']) AS factor_name, (SELECT count(*) > 0 FROM lineitem) AS checked, factor_name = 'planted_lead' AS looks_ahead")

# -- names, registry, counts --------------------------------------------------


def _resolve(spark, sf_dir):
    """Part names found in longer composed names."""
    parts = table(spark, sf_dir, "part")
    baseline = parts.select(F.col("p_name").alias("factor_name")).distinct().unionByName(
        parts.select(F.col("p_brand").alias("factor_name")).distinct())
    names = parts.select(F.concat_ws("_", "p_type", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")), F.when(F.col("p_partkey") % 5 == 0, F.lit("x"))).alias("candidate")).distinct()
    return catalog.resolve_name(names, baseline).select("candidate", "resolved")


cte("baseline_names", (), "SELECT DISTINCT p_name AS b FROM part UNION SELECT DISTINCT p_brand FROM part")
cte("composed", (), "SELECT DISTINCT concat_ws('_', p_type, p_name, CASE WHEN p_partkey % 3 = 0 THEN p_brand END, CASE WHEN p_partkey % 5 = 0 THEN 'x' END) AS candidate FROM part")
_add("resolve_name", "J8", _resolve, sql(
    "SELECT candidate, coalesce(arg_min(b, row(CASE WHEN candidate = b THEN 0 WHEN ends_with(candidate, b) THEN 1 ELSE 2 END, -length(b), b)), candidate) AS resolved "
    "FROM composed LEFT JOIN baseline_names ON contains(candidate, b) GROUP BY candidate", "baseline_names", "composed"))


def _registry(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("factor_name"),
        F.col("o_totalprice").alias("quality_score"),
        F.struct("o_orderdate", "o_orderkey").alias("updated_at"))
    early = orders.filter(F.col("updated_at.o_orderkey") % 2 == 0)
    late = orders.filter(F.col("updated_at.o_orderkey") % 2 == 1)
    out = catalog.registry_upsert(early, late)
    return out.select("factor_name", r6("quality_score").alias("quality_score"), F.col("updated_at.o_orderkey").alias("order_key"))


_add("registry_upsert", "K6, U1, U2", _registry,
     f"SELECT 'cust_' || o_custkey AS factor_name, {R('arg_max(o_totalprice, row(o_orderdate, o_orderkey))')} AS quality_score, "
     "arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS order_key FROM orders GROUP BY 1")

_add("grade_distribution", "A37", lambda spark, sf_dir: screen.grade_distribution(candidates(spark, sf_dir)), sql(
    "SELECT g.grade, count(c.factor_name) AS n FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('F')) g(grade) LEFT JOIN cands c ON c.grade = g.grade GROUP BY 1", "cands"))
_add("family_distribution", "A37", lambda spark, sf_dir: screen.family_distribution(candidates(spark, sf_dir).filter(catalog.passes(GATES))), sql(
    "SELECT coalesce(family, 'unknown') AS family, count(*) AS n FROM cands WHERE passes GROUP BY 1", "cands"))
_add("generation_evolution", "A38", lambda spark, sf_dir: rounded(screen.generation_evolution(
    candidates(spark, sf_dir).filter(~catalog.has_error()).withColumn("passes", catalog.passes(GATES)))), sql(
    "SELECT generation, count(*) AS evaluated, count(*) FILTER (passes) AS passed, arg_max(factor_name, row(abs(mean_rank_ic), factor_name)) AS best_factor, "
    f"{R('arg_max(mean_rank_ic, row(abs(mean_rank_ic), factor_name))')} AS best_mean_rank_ic, arg_max(grade, row(abs(mean_rank_ic), factor_name)) AS best_grade "
    "FROM cands WHERE error IS NULL GROUP BY 1", "cands"))

def _select(spark, sf_dir):
    """Recipe picks for every family, with the definitions of one nation's suppliers already used."""
    catalog_table = recipes.catalog_frame(spark)
    used = candidates(spark, sf_dir).select("expression")
    out = None
    for family in ("momentum", "volume", "liquidity"):
        for index in (0, 5):
            one = recipes.select_recipe(catalog_table, family, index, used).select(
                F.lit(family).alias("family_hint"), F.lit(index).alias("pick_index"), "recipe_id")
            out = one if out is None else out.unionByName(one)
    return out


def _select_sql() -> str:
    rows = ", ".join(f"({i}, '{r.recipe_id}', '{r.family}', '{r.term().text}')" for i, r in enumerate(recipes.RECIPES))
    return sql(f"""
  SELECT family_hint, pick_index, recipe_id FROM (
    SELECT *, row_number() OVER (PARTITION BY family_hint, pick_index ORDER BY other, position) - 1 AS pos, count(*) OVER (PARTITION BY family_hint, pick_index) AS n FROM (
      SELECT *, min(CAST(used AS INTEGER)) OVER (PARTITION BY family_hint, pick_index) AS all_used FROM (
        SELECT h.family_hint, i.pick_index, r.*, r.family <> h.family_hint AS other,
               replace(r.expression, ' ', '') IN (SELECT replace(expression, ' ', '') FROM cands) AS used,
               sum(CAST(r.family = h.family_hint AS INTEGER)) OVER (PARTITION BY h.family_hint, i.pick_index) AS own
        FROM (VALUES ('momentum'), ('volume'), ('liquidity')) h(family_hint), (VALUES (0), (5)) i(pick_index), (VALUES {rows}) r(position, recipe_id, family, expression))
      WHERE NOT other OR own < 4) WHERE used = FALSE OR all_used = 1) WHERE pos = pick_index % n""", "cands")


_add("select_recipe", "catalog look-ups", _select, _select_sql())
