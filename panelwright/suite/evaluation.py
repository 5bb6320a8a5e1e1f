"""Queries that evaluate factors against returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.scalar import is_true
from panelwright.operators import ic, screen, similarity
from panelwright.functions import timeseries as ts
from panelwright.plans import batch, pipelines
from panelwright.plans.factors import factor_long
from panelwright.session import cut_lineage, store
from panelwright.sources import sinks
from panelwright.sources.panel import FLAGS, Panel, weekly_panel
from panelwright.suite.base import (
    Check, LIBRARY, R, centred_sql, corr_sql, cte, daily, library, library_factors, magnitude, magnitude_sql, r6, rank_corr_sql, rank_sql, rounded, scratch, sql, stored_library,
)

CHECKS: dict[str, Check] = {}
FACTORS = len(LIBRARY)


def _add(name: str, covers: str, run, text: str | None) -> None:
    CHECKS[name] = Check(run, text, covers)


# -- joins and filters -------------------------------------------------------


def _merge(spark, sf_dir):
    panel, factors = library_factors(spark, sf_dir)
    merged = ic.merge_factors(factors, panel.df.select("entity", "date", "close"))
    return rounded(merged.select("factor_name", "entity", "date", "value", "close"))


_add("merge_factors", "J1, P8", _merge,
     sql(f"SELECT factor_name, entity, date, {R('value')} AS value, {R('close')} AS close FROM merged", "merged"))


def _overlap(spark, sf_dir):
    panel, factors = library_factors(spark, sf_dir)
    traded = panel.df.filter(~is_true("suspended") & ~is_true("ST"))
    return rounded(ic.overlap_check(factors, traded))


_add("overlap_check", "P13", _overlap, sql(
    f"SELECT factor_name, count(*) AS factor_rows, count(*) FILTER (NOT suspended AND NOT ST) AS matched_rows, "
    f"{R('count(*) FILTER (NOT suspended AND NOT ST) / count(*)')} AS overlap, "
    "count(*) FILTER (NOT suspended AND NOT ST) / count(*) < 0.05 AS low_overlap FROM merged GROUP BY factor_name", "merged"))


def _clean(spark, sf_dir):
    _, merged = library(spark, sf_dir)
    return rounded(ic.clean_returns(merged).select("factor_name", "entity", "date", "value", "ret"))


_add("clean_returns", "P4, P5, P6, T13", _clean,
     sql(f"SELECT factor_name, entity, date, {R('value')} AS value, {R('ret')} AS ret FROM clean", "clean"))

# -- daily tables ------------------------------------------------------------


def _daily_ic(spark, sf_dir):
    return rounded(daily(spark, sf_dir))


_add("daily_rank_ic", "A1, A2, A3, A4, P10, P11", _daily_ic, sql(
    f"SELECT factor_name, date, {R('ic')} AS ic, {R('rank_ic')} AS rank_ic, {R('p_value')} AS p_value, "
    f"{R('ic_p_value')} AS ic_p_value, n_stocks FROM daily_p", "daily_p"))


def _same_day(spark, sf_dir):
    panel, merged = library(spark, sf_dir)
    out = ic.daily_ic(merged, panel.cross_section("factor_name"), next_day=False, exclude_limit_up=False)
    return rounded(out.select("factor_name", "date", "ic", "rank_ic", "n_stocks"))


cte("same_day", ("merged",), f"""
  SELECT *, {centred_sql('value', 'factor_name, date')} AS rx, {centred_sql('ret', 'factor_name, date')} AS ry FROM (
    SELECT * FROM (SELECT *, close / nullif(lag(close) OVER (PARTITION BY factor_name, entity ORDER BY date), 0) - 1 AS ret FROM merged)
    WHERE ret IS NOT NULL AND NOT coalesce(ST, false) AND NOT coalesce(limit_down_flag, false) AND NOT coalesce(suspended, false))""")
_add("same_day_rank_ic", "A3 with T10", _same_day, sql(
    f"SELECT factor_name, date, {R('ic')} AS ic, {R('rank_ic')} AS rank_ic, n FROM (SELECT factor_name, date, {corr_sql('value', 'ret')} AS ic, "
    f"{rank_corr_sql('rx', 'ry')} AS rank_ic, count(*) AS n FROM same_day GROUP BY 1, 2) WHERE n >= 50 AND ic IS NOT NULL AND rank_ic IS NOT NULL",
    "same_day").replace(" AS rank_ic, n FROM", " AS rank_ic, n AS n_stocks FROM", 1))

# -- summaries ---------------------------------------------------------------


def _on_daily(name: str, covers: str, apply, text: str, *needs: str, stored: bool = False) -> None:
    """``stored`` writes the daily table first, for operators that read it several times."""

    def run(spark, sf_dir):
        table = daily(spark, sf_dir)
        return rounded(apply(cut_lineage(table) if stored else table))

    _add(name, covers, run, sql(text, *(needs or ("daily",))))


def _share(condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END)"


_stat_columns = []
for c in ("ic", "rank_ic"):
    _stat_columns += [
        f"{R(f'avg({c})')} AS mean_{c}", f"{R(f'stddev_samp({c})')} AS std_{c}", f"{R(f'min({c})')} AS min_{c}",
        f"{R(f'max({c})')} AS max_{c}", f"{R(f'avg({c}) / nullif(stddev_samp({c}), 0)')} AS {c}_ir",
        f"{R(_share(f'{c} > 0'))} AS {c}_win_rate", f"{R(_share(f'{c} > 0.05'))} AS {c}_above_005",
        f"{R(_share(f'{c} < -0.05'))} AS {c}_below_005",
    ]
_on_daily("ic_statistics", "A5", ic.ic_statistics,
          f"SELECT factor_name, count(*) AS valid_days, {', '.join(_stat_columns)}, {R('avg(n_stocks)')} AS mean_stocks FROM daily GROUP BY factor_name")

_SUMMARY = (
    f"SELECT factor_name, {R('avg(ic)')} AS mean_ic, {R('avg(rank_ic)')} AS mean_rank_ic, {R('stddev_samp(ic)')} AS ic_std, "
    f"{R('stddev_samp(rank_ic)')} AS rank_ic_std, {R('avg(p_value)')} AS mean_p_value, {R('avg(ic_p_value)')} AS mean_ic_p_value, "
    f"{R('coalesce(avg(ic) / nullif(stddev_samp(ic), 0), 0)')} AS ic_ir, {R('coalesce(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0), 0)')} AS rank_ic_ir, "
    f"{R(_share('ic > 0'))} AS ic_win_rate, {R(_share('rank_ic > 0'))} AS rank_ic_win_rate, count(*) AS valid_days FROM daily_p GROUP BY factor_name"
)
_on_daily("factor_summary", "A6", ic.factor_summary, _SUMMARY, "daily_p")
_on_daily("mean_std_summary", "A7", ic.mean_std_summary,
          f"SELECT factor_name, {R('avg(rank_ic)')} AS mean_rank_ic, {R('stddev_samp(rank_ic)')} AS rank_ic_std, count(*) AS rows FROM daily GROUP BY factor_name")
_on_daily("run_metrics", "A8", ic.run_metrics,
          f"SELECT factor_name, valid_days AS rows, {R('mean_rank_ic')} AS mean_rank_ic, {R('rank_ic_std')} AS rank_ic_std, {R('rank_ic_ir')} AS rank_ic_ir, "
          f"{R('rank_ic_win_rate')} AS rank_ic_win_rate, {R('mean_ic')} AS mean_ic FROM stats", "stats")
_on_daily("screen_metrics", "A9", ic.screen_metrics,
          f"SELECT factor_name, {R('mean_rank_ic')} AS mean_rank_ic, {R('rank_ic_ir')} AS rank_ic_ir, {R('rank_ic_win_rate')} AS rank_ic_win_rate, "
          f"{R('coalesce(rank_ic_std, 0)')} AS rank_ic_std, {R('mean_ic')} AS mean_ic, {R('ic_ir')} AS ic_ir, valid_days FROM stats", "stats")
_on_daily("factor_stats", "A10", ic.factor_stats,
          f"SELECT factor_name, {R('mean_rank_ic')} AS mean_rank_ic, {R('rank_ic_std')} AS rank_ic_std, {R('rank_ic_ir')} AS rank_ic_ir, "
          f"{R('rank_ic_win_rate')} AS rank_ic_win_rate, valid_days FROM stats", "stats")
_on_daily("ic_t_stat", "A11", ic.ic_t_stat,
          f"SELECT factor_name, {R('coalesce(rank_ic_ir * sqrt(valid_days), 0)')} AS ic_t_stat, valid_days AS n_days FROM stats", "stats")
_on_daily("ic_by_year", "A12", ic.ic_by_year,
          f"SELECT factor_name, CAST(year(date) AS INTEGER) AS year, {R('avg(rank_ic)')} AS mean_rank_ic FROM daily GROUP BY 1, 2")


def _year_map(spark, sf_dir):
    mapped = ic.ic_by_year_map(daily(spark, sf_dir))
    entry = F.explode(F.map_entries("by_year_ic")).alias("_e")
    return mapped.select("factor_name", entry).select(
        "factor_name", F.col("_e.key").alias("year"), r6("_e.value").alias("mean_rank_ic"))


_add("ic_by_year_map", "A12 as map", _year_map,
     sql(f"SELECT factor_name, CAST(year(date) AS VARCHAR) AS year, {R('avg(rank_ic)')} AS mean_rank_ic FROM daily GROUP BY 1, 2", "daily"))

_WINDOWS = {"train": ("1995-01-01", "1997-12-31"), "validation": ("1998-01-01", "1999-06-30"), "test": ("1999-07-01", None)}


def _mean_between(lo: str, hi: str | None) -> str:
    upto = f" AND date <= DATE '{hi}'" if hi else ""
    return f"coalesce(avg(rank_ic) FILTER (date >= DATE '{lo}'{upto}), 0)"


_on_daily("walk_forward_ic", "A13, P12, T16", lambda d: ic.walk_forward(d, **_WINDOWS),
          "SELECT factor_name, " + ", ".join(f"{R(_mean_between(*w))} AS {n}_rank_ic" for n, w in _WINDOWS.items())
          + f", {R('CASE WHEN count(*) >= 60 THEN avg(rank_ic) FILTER (back <= 60) ELSE 0 END')} AS recent_rank_ic "
          "FROM (SELECT *, row_number() OVER (PARTITION BY factor_name ORDER BY date DESC) AS back FROM daily) GROUP BY factor_name")

# -- metrics of the factor itself -------------------------------------------

cte("grid_factors", ("wide",), " UNION ALL ".join(
    f"SELECT '{n}' AS factor_name, entity, date, {n} AS value FROM wide WHERE present" for n in LIBRARY))
cte("factors", ("merged",), "SELECT factor_name, entity, date, value FROM merged")


def _coverage(spark, sf_dir):
    from panelwright.plans.factors import factor_wide

    wide = factor_wide(weekly_panel(spark, sf_dir), LIBRARY)
    pairs = ", ".join(f"'{n}', `{n}`" for n in LIBRARY)
    long = wide.select("entity", "date", F.expr(f"stack({FACTORS}, {pairs}) as (factor_name, value)"))
    return rounded(ic.coverage(long))


_add("coverage", "A14, A15", _coverage, sql(
    f"SELECT factor_name, {R('sum(k) / sum(n)')} AS coverage, {R('avg(k / n)')} AS avg_cross_sectional_coverage FROM ("
    "SELECT factor_name, date, count(value) AS k, count(*) AS n FROM grid_factors GROUP BY 1, 2) GROUP BY 1", "grid_factors"))

cte("stepped", ("factors",), f"""
  SELECT f.factor_name, f.date, f.entity, f.value, f.p, b.value AS before, b.p AS p_before
  FROM (SELECT *, {rank_sql('value', 'factor_name, date')} AS p FROM factors) f
  JOIN (SELECT factor_name, date, lag(date) OVER (PARTITION BY factor_name ORDER BY date) AS prior
        FROM (SELECT DISTINCT factor_name, date FROM factors)) d USING (factor_name, date)
  LEFT JOIN (SELECT *, {rank_sql('value', 'factor_name, date')} AS p FROM factors) b
    ON b.factor_name = f.factor_name AND b.entity = f.entity AND b.date = d.prior""")


def _autocorr(spark, sf_dir):
    _, factors = library_factors(spark, sf_dir)
    return rounded(ic.factor_autocorr(factors))


_add("factor_autocorr", "A16", _autocorr, sql(
    f"SELECT factor_name, {R('avg(c)')} AS factor_autocorr FROM (SELECT factor_name, date, {corr_sql('value', 'before')} AS c FROM stepped "
    "WHERE before IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1", "stepped"))


def _turnover(spark, sf_dir):
    panel, factors = library_factors(spark, sf_dir)
    return rounded(ic.rank_turnover(factors, panel.cross_section("factor_name")))


_add("rank_turnover", "A17", _turnover, sql(
    f"SELECT factor_name, {R('avg(m)')} AS turnover_estimate FROM (SELECT factor_name, date, avg(abs(p - p_before)) AS m FROM stepped GROUP BY 1, 2) GROUP BY 1",
    "stepped"))


def _trade(spark, sf_dir):
    panel = weekly_panel(spark, sf_dir)
    # the next panel row counts here, whether or not the factor has a value there
    moved = Panel(panel.df.withColumn("ret_fwd", ts.forward_return("close", 1, ts.entity_window())), panel.names_bound, panel.days)
    merged = factor_long(moved, LIBRARY, carry=["close", *FLAGS, "ret_fwd"], ahead=True)
    out = ic.trade_metrics_carried(merged, panel.cross_section("factor_name"))
    return rounded(out.withColumn("max_drawdown_long_short", magnitude("max_drawdown_long_short")))


cte("turnover", ("stepped",), "SELECT factor_name, avg(m) AS t FROM (SELECT factor_name, date, avg(abs(p - p_before)) AS m FROM stepped GROUP BY 1, 2) GROUP BY 1")
cte("spreads", ("factors", "panel", "stats", "turnover"), f"""
  SELECT s.factor_name, s.date, CASE WHEN mean_rank_ic < 0 THEN -ls ELSE ls END AS ls,
         CASE WHEN mean_rank_ic < 0 THEN -ls ELSE ls END - 10.0 / 10000.0 * 2.0 * coalesce(t, 0) AS net
  FROM (SELECT factor_name, date, avg(ret_fwd) FILTER (p >= 0.9) - avg(ret_fwd) FILTER (p <= 0.1) AS ls FROM (
          SELECT f.factor_name, f.date, ret_fwd, {rank_sql('value', 'f.factor_name, f.date')} AS p FROM factors f JOIN (
            SELECT entity, date, lead(chg) OVER (PARTITION BY entity ORDER BY date) AS ret_fwd FROM (
              SELECT entity, date, close / nullif(lag(close) OVER (PARTITION BY entity ORDER BY date), 0) - 1 AS chg FROM panel)) r
          ON r.entity = f.entity AND r.date = f.date WHERE ret_fwd IS NOT NULL) GROUP BY 1, 2) s
  JOIN stats USING (factor_name) JOIN turnover USING (factor_name) WHERE ls IS NOT NULL""")
_add("trade_metrics", "A18, X13", _trade, sql(
    f"SELECT factor_name, {R('avg(ls)')} AS long_short_spread_return, {R('avg(net)')} AS cost_adjusted_long_short_return, {magnitude_sql('min(eq / peak - 1)')} AS max_drawdown_long_short FROM ("
    "SELECT *, max(eq) OVER w AS peak FROM (SELECT *, product(1 + coalesce(net, 0)) OVER w AS eq FROM spreads WINDOW w AS (PARTITION BY factor_name ORDER BY date)) "
    "WINDOW w AS (PARTITION BY factor_name ORDER BY date)) GROUP BY 1",
    "spreads"))

# -- decay -------------------------------------------------------------------

HORIZONS = (1, 2, 4, 8)


def _decay_table(spark, sf_dir):
    panel, merged = library(spark, sf_dir, horizons=HORIZONS)
    return ic.ic_decay(merged, panel.cross_section("factor_name", "horizon"), HORIZONS, names=list(LIBRARY))


_flag_ok = "NOT coalesce(ST, false) AND NOT coalesce(suspended, false) AND NOT coalesce(limit_up_flag, false) AND NOT coalesce(limit_down_flag, false)"
cte("decay_rows", ("merged",), f"""
  SELECT * FROM (
    SELECT factor_name, date, value, h AS horizon,
           CASE {' '.join(f"WHEN h = {h} THEN r{h}" for h in HORIZONS)} END AS ret
    FROM (SELECT *, {', '.join(f"lead(close, {h}) OVER w / nullif(close, 0) - 1 AS r{h}" for h in HORIZONS)}
          FROM merged WHERE {_flag_ok} WINDOW w AS (PARTITION BY factor_name, entity ORDER BY date)),
         (VALUES {', '.join(f"({h})" for h in HORIZONS)}) v(h)) WHERE ret IS NOT NULL""")
cte("decay_daily", ("decay_rows",), f"""
  SELECT factor_name, horizon, date, {corr_sql('value', 'ret')} AS ic, {rank_corr_sql('rx', 'ry')} AS rank_ic FROM (
    SELECT *, {centred_sql('value', 'factor_name, horizon, date')} AS rx, {centred_sql('ret', 'factor_name, horizon, date')} AS ry FROM decay_rows)
  GROUP BY 1, 2, 3 HAVING count(*) >= 30""")
cte("decay", ("decay_daily",), "SELECT factor_name, horizon, " + ", ".join(
    f"avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}, avg({c}) / nullif(stddev_pop({c}), 0) AS {c}_ir, {_share(f'{c} > 0')} AS {c}_win_rate"
    for c in ("ic", "rank_ic")) + ", count(*) AS n_valid_days FROM decay_daily GROUP BY 1, 2")
_DECAY_COLUMNS = [f"{p}_{c}" for c in ("ic", "rank_ic") for p in ("mean", "std")] + [f"{c}_{s}" for c in ("ic", "rank_ic") for s in ("ir", "win_rate")]
_add("ic_decay", "A19", lambda spark, sf_dir: rounded(_decay_table(spark, sf_dir)), sql(
    "SELECT factor_name, horizon, " + ", ".join(f"{R(c)} AS {c}" for c in _DECAY_COLUMNS) + ", n_valid_days FROM decay", "decay"))
_add("decay_grade", "A20", lambda spark, sf_dir: rounded(screen.decay_grade(_decay_table(spark, sf_dir))), sql(
    f"SELECT factor_name, CASE WHEN coalesce(peak, 0) = 0 THEN 'F' WHEN half IS NULL OR half >= 10 THEN 'A' WHEN half >= 5 THEN 'B' WHEN half >= 2 THEN 'C' ELSE 'D' END AS decay_grade, "
    f"{R('coalesce(peak, 0)')} AS peak_rank_ic, CASE WHEN peak > 0 THEN half END AS half_life, {R('h1')} AS h1_rank_ic FROM ("
    "SELECT factor_name, any_value(peak) AS peak, min(horizon) FILTER (abs(mean_rank_ic) < 0.5 * peak) AS half, max(mean_rank_ic) FILTER (horizon = 1) AS h1 "
    "FROM (SELECT *, max(abs(mean_rank_ic)) OVER (PARTITION BY factor_name) AS peak FROM decay) GROUP BY factor_name)", "decay"))

# -- grading and stability ---------------------------------------------------

_CRITERIA = {
    "mean_rank_ic": "coalesce(abs(mean_rank_ic) >= 0.02, false)",
    "rank_ic_ir": "coalesce(rank_ic_ir >= 0.3, false)",
    "rank_ic_win_rate": "coalesce(CASE WHEN coalesce(mean_rank_ic, 0) < 0 THEN rank_ic_win_rate <= 1 - 0.52 ELSE rank_ic_win_rate >= 0.52 END, false)",
    "valid_days": "coalesce(valid_days >= 100, false)",
    "ic_ir": "coalesce(ic_ir >= 0.2, false)",
}


def grade_sql(source: str, keep: str) -> str:
    score = " + ".join(f"CAST({c} AS INTEGER)" for c in _CRITERIA.values())
    failed = ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in _CRITERIA.items())
    return (
        f"SELECT {keep}, quality_score, failed_criteria, CASE quality_score WHEN 5 THEN 'A' WHEN 4 THEN 'A' WHEN 3 THEN 'B' WHEN 2 THEN 'C' WHEN 1 THEN 'D' ELSE 'F' END AS grade "
        f"FROM (SELECT *, {score} AS quality_score, concat_ws(', ', {failed}) AS failed_criteria FROM {source})"
    )


def _graded(spark, sf_dir):
    out = screen.grade(ic.screen_metrics(daily(spark, sf_dir)))
    return out.select("factor_name", "quality_score", "failed_criteria", "grade")


_add("grade", "A21, A22", _graded, sql(grade_sql("stats", "factor_name"), "stats"))

cte("segments", ("daily",), f"""
  SELECT factor_name, CAST(greatest(1, ceil(i * least(4, n) / nullif(n - 1, 0))) AS INTEGER) AS segment, min(date) AS start_date, max(date) AS end_date,
         count(*) AS n_days, avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS rank_ic_std,
         avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS rank_ic_ir, {_share('rank_ic > 0')} AS win_rate
  FROM (SELECT *, row_number() OVER (PARTITION BY factor_name ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY factor_name) AS n FROM daily)
  GROUP BY 1, 2""")
_on_daily("segment_table", "A26", screen.segment_table,
          f"SELECT factor_name, segment, start_date, end_date, n_days, {R('mean_rank_ic')} AS mean_rank_ic, {R('rank_ic_std')} AS rank_ic_std, "
          f"{R('rank_ic_ir')} AS rank_ic_ir, {R('win_rate')} AS win_rate FROM segments", "segments")
cte("stability", ("segments",), f"""
  SELECT factor_name, count(*) AS segment_count, {_share('mean_rank_ic > 0')} AS positive_segment_ratio, stddev_samp(mean_rank_ic) AS segment_mean_std,
         max(mean_rank_ic) - min(mean_rank_ic) AS segment_mean_range, avg(rank_ic_ir) AS segment_ir_mean, avg(win_rate) AS segment_win_rate_mean
  FROM segments GROUP BY 1""")
_on_daily("segment_stability", "A26", lambda d: screen.segment_stability(screen.segment_table(d)),
          "SELECT factor_name, segment_count, " + ", ".join(f"{R(c)} AS {c}" for c in (
              "positive_segment_ratio", "segment_mean_std", "segment_mean_range", "segment_ir_mean", "segment_win_rate_mean")) + " FROM stability", "stability")

cte("shared_days", ("daily",), f"""
  SELECT factor_name, date, {centred_sql('rank_ic', 'factor_name')} AS r FROM daily
  WHERE date IN (SELECT date FROM daily GROUP BY date HAVING count(*) = (SELECT count(DISTINCT factor_name) FROM daily))""")
cte("corr_matrix", ("shared_days",), f"""
  SELECT a.factor_name AS "left", b.factor_name AS "right", CASE WHEN a.factor_name = b.factor_name THEN 1.0 ELSE {rank_corr_sql('a.r', 'b.r')} END AS corr
  FROM shared_days a JOIN shared_days b USING (date) GROUP BY 1, 2""")
_on_daily("ic_corr_matrix", "A27, J11", similarity.ic_corr_matrix,
          f'SELECT "left", "right", CAST({R("corr")} AS DOUBLE) AS corr FROM corr_matrix', "corr_matrix", stored=True)
_on_daily("max_abs_corr", "A28", lambda d: similarity.max_abs_corr(similarity.ic_corr_matrix(d)),
          f'SELECT "left" AS factor_name, CAST({R("max(abs(corr))")} AS DOUBLE) AS max_abs_corr FROM corr_matrix WHERE "left" <> "right" GROUP BY 1', "corr_matrix", stored=True)


def _recommend(spark, sf_dir):
    d = cut_lineage(daily(spark, sf_dir))
    stats = (
        ic.factor_stats(d)
        .join(screen.segment_stability(screen.segment_table(d)), "factor_name")
        .join(similarity.max_abs_corr(similarity.ic_corr_matrix(d)), "factor_name", "left")
    )
    out = screen.recommend(stats)
    return out.select("factor_name", "decision", "score", F.array_join("reasons", "; ").alias("reasons"), r6("max_abs_corr").alias("max_abs_corr"))


_RULES = [
    [("rank_ic_ir >= 0.5", 35, "rank_ic_ir >= 0.50"), ("rank_ic_ir >= 0.3", 25, "rank_ic_ir in [0.30, 0.50)"), ("rank_ic_ir >= 0.15", 15, "rank_ic_ir in [0.15, 0.30)")],
    [("mean_rank_ic >= 0.03", 20, "mean_rank_ic >= 0.03"), ("mean_rank_ic >= 0.015", 12, "mean_rank_ic in [0.015, 0.03)"), ("mean_rank_ic > 0", 6, "mean_rank_ic > 0")],
    [("rank_ic_win_rate >= 0.58", 15, "rank_ic_win_rate >= 58%"), ("rank_ic_win_rate >= 0.54", 10, "rank_ic_win_rate in [54%, 58%)"), ("rank_ic_win_rate >= 0.51", 5, "rank_ic_win_rate in [51%, 54%)")],
    [("positive_segment_ratio >= 0.75", 12, "positive segment ratio >= 75%"), ("positive_segment_ratio >= 0.5", 6, "positive segment ratio in [50%, 75%)")],
    [("segment_mean_range <= 0.03", 8, "segment mean range <= 0.03")],
    [("c <= 0.5", 10, "max |corr| <= 0.50"), ("c <= 0.75", 6, "max |corr| in (0.50, 0.75]"), ("c >= 0.9", -8, "max |corr| >= 0.90 (high redundancy)")],
]
_points = " + ".join("(CASE " + " ".join(f"WHEN {c} THEN {p}" for c, p, _ in rule) + " ELSE 0 END)" for rule in _RULES)
_reasons = ", ".join("CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in rule) + " END" for rule in _RULES)
_add("recommend", "A29", _recommend, sql(
    f"SELECT factor_name, CASE WHEN score >= 70 THEN 'in_pool' WHEN score >= 50 THEN 'watchlist' ELSE 'eliminate' END AS decision, score, reasons, "
    f"CAST({R('c')} AS DOUBLE) AS max_abs_corr FROM (SELECT *, CAST(greatest(0, least(100, {_points})) AS DOUBLE) AS score, concat_ws('; ', {_reasons}) AS reasons FROM stats "
    'JOIN stability USING (factor_name) JOIN (SELECT "left" AS factor_name, max(abs(corr)) AS c FROM corr_matrix WHERE "left" <> "right" GROUP BY 1) USING (factor_name))',
    "stats", "stability", "corr_matrix"))

# -- similarity --------------------------------------------------------------

PAIR = '"left", "right"'


def _pairs_sql(source: str, keys: str, value: str, least: int) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    picked = ", ".join(f"a.{k}" for k in keys.split(", "))
    return (
        f'SELECT "left", "right", count(*) AS n, {R("abs(" + rank_corr_sql("rx", "ry") + ")")} AS similarity FROM ('
        f'SELECT "left", "right", {centred_sql("x", PAIR)} AS rx, '
        f'{centred_sql("y", PAIR)} AS ry FROM ('
        f'SELECT a.factor_name AS "left", b.factor_name AS "right", {picked}, a.{value} AS x, b.{value} AS y FROM {source} a JOIN {source} b ON {on} AND a.factor_name < b.factor_name)) '
        f"GROUP BY 1, 2 HAVING count(*) >= {least}"
    )


def _value_similarity(spark, sf_dir):
    _, factors = library_factors(spark, sf_dir)
    # no bound is known for the rows of one factor, so the split form ranks them; it reads the factors once
    return rounded(similarity.value_similarity(factors))


_add("value_similarity", "C5, J6", _value_similarity, sql(_pairs_sql("factors", "entity, date", "value", 10000), "factors"))
_on_daily("ic_similarity", "C6, J6", similarity.ic_similarity, _pairs_sql("daily", "date", "rank_ic", 30), stored=True)


def _sampled(spark, sf_dir):
    from panelwright.operators.crosssection import CrossSection

    _, factors = library_factors(spark, sf_dir)
    cross = CrossSection(["factor_name"], spread=True)
    sampled = similarity.sample_rows(factors, cross, 5000, 7, ["entity", "date"])
    return sampled.groupBy("factor_name").agg(F.count("*").alias("n"), F.countDistinct("entity", "date").alias("n_keys"))


_add("sample", "O9", _sampled, sql("SELECT factor_name, least(count(*), 5000) AS n, least(count(*), 5000) AS n_keys FROM factors GROUP BY 1", "factors"))


def _pooled(spark, sf_dir):
    panel, merged = library(spark, sf_dir)
    rows = ic.clean_returns(merged).withColumn(
        "split", F.when(F.col("date") < F.lit("1999-01-01").cast("date"), "train").otherwise("test"))
    from panelwright.operators.crosssection import CrossSection

    cross = CrossSection(["factor_name", "split"], spread=True)
    return rounded(ic.pooled_ic(rows, cross, ["factor_name", "split"]))


_add("pooled_ic", "A36", _pooled, sql(
    f"SELECT factor_name, split, count(*) AS n_stocks, {R(corr_sql('value', 'ret'))} AS ic, {R(rank_corr_sql('a', 'b'))} AS rank_ic FROM ("
    f"SELECT *, {centred_sql('value', 'factor_name, split')} AS a, {centred_sql('ret', 'factor_name, split')} AS b FROM ("
    "SELECT *, CASE WHEN date < DATE '1999-01-01' THEN 'train' ELSE 'test' END AS split FROM clean)) GROUP BY 1, 2", "clean"))

# -- rankings ----------------------------------------------------------------

cte("summary", ("daily_p",), "SELECT factor_name, avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS rank_ic_std, "
    f"coalesce(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0), 0) AS rank_ic_ir, {_share('rank_ic > 0')} AS rank_ic_win_rate, count(*) AS valid_days FROM daily_p GROUP BY 1")


def _summary(spark, sf_dir):
    return ic.factor_summary(daily(spark, sf_dir)).select(
        "factor_name", "mean_rank_ic", "rank_ic_std", "rank_ic_ir", "rank_ic_win_rate", "valid_days")


_add("rank_table", "O1", lambda spark, sf_dir: rounded(screen.rank_table(_summary(spark, sf_dir)).select("factor_name", "rank_ic_ir", "rank_ir")),
     sql(f"SELECT factor_name, {R('rank_ic_ir')} AS rank_ic_ir, row_number() OVER (ORDER BY rank_ic_ir DESC NULLS LAST, factor_name) AS rank_ir FROM summary", "summary"))
_add("top_factors", "O3", lambda spark, sf_dir: rounded(screen.top_factors(_summary(spark, sf_dir), 2)),
     sql("SELECT factor_name, " + ", ".join(f"{R(c)} AS {c}" for c in ("mean_rank_ic", "rank_ic_std", "rank_ic_ir", "rank_ic_win_rate"))
         + ", valid_days FROM summary ORDER BY summary.rank_ic_ir DESC NULLS LAST, factor_name LIMIT 2", "summary"))


def _newcomer(spark, sf_dir):
    # the newcomer re-enters with the strength of its mirrored series
    s = cut_lineage(_summary(spark, sf_dir))
    old = s.filter(F.col("factor_name") == "momentum_4")
    new = old.withColumn("mean_rank_ic", -F.col("mean_rank_ic")).withColumn("rank_ic_ir", -F.col("rank_ic_ir"))
    return s, new


cte("after", ("summary",), """
  SELECT factor_name, CASE WHEN factor_name = 'momentum_4' THEN -rank_ic_ir ELSE rank_ic_ir END AS rank_ic_ir,
         CASE WHEN factor_name = 'momentum_4' THEN -mean_rank_ic ELSE mean_rank_ic END AS mean_rank_ic, rank_ic_std, rank_ic_win_rate, valid_days FROM summary""")
cte("places", ("summary", "after"), """
  SELECT factor_name, b.rank_ic_ir AS rank_ic_ir_before, b.r AS rank_before, a.r AS rank_after, a.rank_ic_ir AS rank_ic_ir_after, a.mean_rank_ic, a.rank_ic_std, a.rank_ic_win_rate, a.valid_days
  FROM (SELECT *, row_number() OVER (ORDER BY rank_ic_ir DESC NULLS LAST, factor_name) AS r FROM summary) b
  FULL JOIN (SELECT *, row_number() OVER (ORDER BY rank_ic_ir DESC NULLS LAST, factor_name) AS r FROM after) a USING (factor_name)""")
_add("ranking_change", "O2", lambda spark, sf_dir: rounded(screen.ranking_change(*_newcomer(spark, sf_dir))), sql(
    f"SELECT factor_name, rank_before AS old_rank_ir, rank_after AS new_rank_ir, rank_before - rank_after AS rank_change, {R('mean_rank_ic')} AS mean_rank_ic, "
    f"{R('rank_ic_std')} AS rank_ic_std, {R('rank_ic_ir_after')} AS rank_ic_ir, {R('rank_ic_win_rate')} AS rank_ic_win_rate, valid_days FROM places WHERE factor_name = 'momentum_4'", "places"))
_add("ranking_shift", "O2, J5", lambda spark, sf_dir: rounded(screen.ranking_shift(*_newcomer(spark, sf_dir))), sql(
    f"SELECT factor_name, rank_before, {R('rank_ic_ir_before')} AS rank_ic_ir_before, rank_after, {R('rank_ic_ir_after')} AS rank_ic_ir_after, rank_before - rank_after AS rank_shift "
    "FROM places WHERE coalesce(rank_before - rank_after, 0) <> 0", "places"))


def _compare(spark, sf_dir):
    graded = screen.grade(ic.screen_metrics(daily(spark, sf_dir)))
    out = screen.leaderboard(graded.drop("quality_score"))
    return rounded(out.select("factor_name", "grade", "mean_rank_ic", "rank_ic_ir", "rank_ic_win_rate", "valid_days"))


_add("compare_factors", "O5", _compare, sql(
    f"SELECT factor_name, grade, {R('mean_rank_ic')} AS mean_rank_ic, {R('rank_ic_ir')} AS rank_ic_ir, {R('rank_ic_win_rate')} AS rank_ic_win_rate, valid_days FROM ("
    + grade_sql("stats", "factor_name, mean_rank_ic, rank_ic_ir, rank_ic_win_rate, valid_days") + ")", "stats"))

# -- whole runs ---------------------------------------------------------------


def _batch(spark, sf_dir):
    """Two runs into one folder: the second evaluates only what the first left out."""
    panel, factors = stored_library(spark, sf_dir)
    factors, out = store(factors), scratch(spark)
    pipelines.batch_analysis(panel, factors.filter(F.col("factor_name").isin("momentum_4", "reversal_2")), out)
    done = pipelines.batch_analysis(panel, factors, out)
    return rounded(done.select("factor_name", "mean_rank_ic", "rank_ic_ir", "valid_days", "quality_score", "grade"))


_add("batch_analysis", "whole run: K8, J1, A3, A6, K1, A22", _batch, sql(
    f"SELECT factor_name, {R('mean_rank_ic')} AS mean_rank_ic, {R('rank_ic_ir')} AS rank_ic_ir, valid_days, quality_score, grade FROM ("
    + grade_sql("stats", "factor_name, mean_rank_ic, rank_ic_ir, valid_days") + ")", "stats"))


def broken_batch(spark, sf_dir) -> str:
    """The folder of a batch run twice: stored library factors, an unreadable one, one of bad numbers, one without valid days."""
    panel, factors = stored_library(spark, sf_dir)
    source, out = scratch(spark), scratch(spark)
    factors.write.partitionBy("factor_name").parquet(f"{source}/library")
    paths = {n: f"{source}/library/factor_name={n}" for n in LIBRARY} | {n: f"{source}/{n}" for n in ("not_a_table", "bad_numbers", "constant")}
    one = spark.read.parquet(paths["momentum_4"])
    one.select(F.concat_ws(",", "entity", "value").alias("value")).write.text(f"{source}/not_a_table")
    one.select("entity", "date", F.when(F.col("value") > 0.5, F.lit("high")).otherwise(F.col("value").cast("string")).alias("value")).write.parquet(f"{source}/bad_numbers")
    one.select("entity", "date", F.lit(1.0).alias("value")).write.parquet(f"{source}/constant")
    sources = {n: (lambda s, p=p: s.read.parquet(p)) for n, p in paths.items()}
    for _ in range(2):
        batch.run_batch(panel, sources, out)
    return out


def _batch_errors(spark, sf_dir):
    """Every factor once, although the batch ran twice; why the failed ones failed, and the days of the others."""
    out = broken_batch(spark, sf_dir)
    entries = spark.read.parquet(f"{out}/manifest").groupBy("factor_name").agg(F.count("*").alias("entries"))
    reason = F.regexp_extract("error", r"\[([A-Z_]+)", 1)
    return batch.manifest(spark, out).join(entries, "factor_name").select(
        "factor_name", F.coalesce(F.nullif(reason, F.lit("")), "error").alias("reason"), "valid_days", "entries", (F.col("elapsed_sec") > 0).alias("timed"))


_FAILED = "('not_a_table', 'FAILED_READ_FILE'), ('bad_numbers', 'CAST_INVALID_INPUT'), ('constant', 'no valid days')"
_add("batch_errors", "K4, A39, K8, S5", _batch_errors, sql(
    "SELECT factor_name, CAST(NULL AS VARCHAR) AS reason, valid_days, CAST(1 AS BIGINT) AS entries, true AS timed FROM stats "
    f"UNION ALL SELECT *, CAST(0 AS BIGINT), CAST(1 AS BIGINT), true FROM (VALUES {_FAILED}) t", "stats"))


def _metadata(spark, sf_dir):
    out = sinks.run_metadata(batch.batch_summary(spark, broken_batch(spark, sf_dir)), {"panel": "weekly", "horizon": "1"})
    return rounded(out.select(F.col("inputs")["panel"].alias("panel"), "factor_count", "success_count", "error_count", "best_rank_ic_ir", "status"))


_add("run_metadata", "K4", _metadata, sql(
    f"SELECT 'weekly' AS panel, count(*) + 3 AS factor_count, count(*) AS success_count, CAST(3 AS BIGINT) AS error_count, "
    f"{R('max(rank_ic_ir)')} AS best_rank_ic_ir, 'partial' AS status FROM stats", "stats"))


def _counts(spark, sf_dir):
    counts = screen.run_counts(batch.batch_summary(spark, broken_batch(spark, sf_dir)))
    return rounded(counts.withColumn("mean_elapsed_sec", F.col("mean_elapsed_sec") > 0).withColumnRenamed("mean_elapsed_sec", "timed"))


_add("run_counts", "A39", _counts, sql(
    "SELECT count(*) AS success_count, CAST(3 AS BIGINT) AS error_count, true AS timed, arg_max(factor_name, row(rank_ic_ir, factor_name)) AS top_factor, "
    f"{R('max(rank_ic_ir)')} AS top_rank_ic_ir FROM stats", "stats"))


def _user_factor(spark, sf_dir):
    def compute(panel):
        w = ts.entity_window()
        moved = panel.select("entity", "date", ts.same_day_return("close", w).alias("chg"))
        return moved.select("entity", "date", ts.ts_std("chg", 20, w, min_count=15).alias("volatility_20")).dropna()

    panel = weekly_panel(spark, sf_dir)
    factor = pipelines.user_factor(panel, compute, "volatility_20")
    return rounded(ic.run_metrics(ic.daily_ic(
        ic.merge_factors(factor, panel.df.select("entity", "date", "close", *FLAGS)), panel.cross_section("factor_name"))))


cte("vol_merged", ("panel",), """
  SELECT * FROM (SELECT *, CASE WHEN count(chg) OVER w >= 15 THEN stddev_samp(chg) OVER w END AS value FROM (
    SELECT *, close / nullif(lag(close) OVER (PARTITION BY entity ORDER BY date), 0) - 1 AS chg FROM panel)
    WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE value IS NOT NULL""")
cte("vol_clean", ("vol_merged",), f"""
  SELECT date, value, ret FROM (SELECT *, lead(close) OVER w / nullif(close, 0) - 1 AS ret, coalesce(lead(limit_up_flag) OVER w, false) AS u,
    coalesce(lead(limit_down_flag) OVER w, false) AS d FROM vol_merged WINDOW w AS (PARTITION BY entity ORDER BY date))
  WHERE ret IS NOT NULL AND NOT u AND NOT d AND {_flag_ok}""")
cte("vol_daily", ("vol_clean",), f"""
  SELECT date, {corr_sql('value', 'ret')} AS ic, {rank_corr_sql('rx', 'ry')} AS rank_ic FROM (
    SELECT *, {centred_sql('value', 'date')} AS rx, {centred_sql('ret', 'date')} AS ry FROM vol_clean) GROUP BY date HAVING count(*) >= 50""")
_add("user_factor", "F1, R15", _user_factor, sql(
    f"SELECT 'volatility_20' AS factor_name, count(*) AS rows, {R('avg(rank_ic)')} AS mean_rank_ic, {R('stddev_samp(rank_ic)')} AS rank_ic_std, "
    f"{R('avg(rank_ic) / nullif(stddev_samp(rank_ic), 0)')} AS rank_ic_ir, {R(_share('rank_ic > 0'))} AS rank_ic_win_rate, {R('avg(ic)')} AS mean_ic FROM vol_daily "
    "WHERE ic IS NOT NULL AND rank_ic IS NOT NULL", "vol_daily"))


def _newcomer_verdict(spark, sf_dir):
    d = cut_lineage(daily(spark, sf_dir))
    baseline, new = d.filter("factor_name <> 'momentum_4'"), d.filter("factor_name = 'momentum_4'")
    out = pipelines.judge_newcomer(ic.factor_summary(baseline), baseline, new, top_k=2)
    return out.select("factor_name", "decision", "score", r6("max_abs_corr").alias("max_abs_corr"))


cte("top_two", ("stats",), "SELECT factor_name FROM stats WHERE factor_name <> 'momentum_4' ORDER BY rank_ic_ir DESC NULLS LAST, factor_name LIMIT 2")
cte("three", ("daily", "top_two"), """
  SELECT factor_name, date, rank_ic FROM daily WHERE factor_name = 'momentum_4' OR factor_name IN (SELECT factor_name FROM top_two)""")
cte("three_shared", ("three",), f"""
  SELECT *, {centred_sql('rank_ic', 'factor_name')} AS r FROM three WHERE date IN (SELECT date FROM three GROUP BY date HAVING count(*) = 3)""")
_add("judge_newcomer", "A26-A29, J7", _newcomer_verdict, sql(
    f"SELECT factor_name, CASE WHEN score >= 70 THEN 'in_pool' WHEN score >= 50 THEN 'watchlist' ELSE 'eliminate' END AS decision, score, CAST({R('c')} AS DOUBLE) AS max_abs_corr "
    f"FROM (SELECT *, CAST(greatest(0, least(100, {_points})) AS DOUBLE) AS score FROM stats JOIN stability USING (factor_name), "
    f"(SELECT max(abs(c)) AS c FROM (SELECT {rank_corr_sql('a.r', 'b.r')} AS c FROM three_shared a JOIN three_shared b USING (date) "
    "WHERE a.factor_name = 'momentum_4' AND b.factor_name <> 'momentum_4' GROUP BY b.factor_name)) WHERE factor_name = 'momentum_4')",
    "stats", "stability", "three_shared"))

