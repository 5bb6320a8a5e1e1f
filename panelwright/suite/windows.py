"""Time-series, cross-sectional and recipe queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions import scalar, timeseries as ts
from panelwright.plans import factors as f, recipes
from panelwright.plans.factors import factor_wide, fld
from panelwright.sources.panel import densify, monthly_panel, user_day_panel, weekly_panel
from panelwright.suite.base import Check, R, r6, rank_sql, rounded, sql

CHECKS: dict[str, Check] = {}
# Means and regressions over a date add prices in whatever order rows arrive; the
# noise of about 1e-11 would now and then cross a rounding border at six digits.
PRICE_DIGITS = 4

E = "WINDOW e AS (PARTITION BY entity ORDER BY date)"


def frame(n: int) -> str:
    return (
        "WINDOW e AS (PARTITION BY entity ORDER BY date), "
        f"w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    )


def _on_grid(name: str, covers: str, term: f.Term, expression: str, windows: str) -> None:
    """A calendar-step operator: evaluated on the grid, reported on real rows."""

    def run(spark, sf_dir):
        wide = factor_wide(weekly_panel(spark, sf_dir), {"value": term})
        return wide.select("entity", "date", r6("value").alias("value"))

    CHECKS[name] = Check(
        run,
        sql(f"SELECT entity, date, {R('value')} AS value FROM (SELECT entity, date, present, {expression} AS value "
            f"FROM grid {windows}) WHERE present", "grid"),
        covers,
    )


close, volume = fld("close"), fld("volume")

_on_grid("delay", "T1", f.delay(close, 4), "lag(close, 4) OVER e", E)
_on_grid("delta", "T2", f.delta(close, 4), "close - lag(close, 4) OVER e", E)
_on_grid("ts_return", "T3", f.ts_return(close, 4), "close / nullif(lag(close, 4) OVER e, 0) - 1", E)
_on_grid("ts_mean", "T4", f.ts_mean(close, 8), "CASE WHEN count(close) OVER w >= 4 THEN avg(close) OVER w END", frame(8))
_on_grid("ts_std", "T5", f.ts_std(close, 8), "CASE WHEN count(close) OVER w >= 4 THEN stddev_samp(close) OVER w END", frame(8))
_on_grid(
    "ts_rank", "T6", f.ts_rank(volume, 13),
    "CASE WHEN volume IS NOT NULL AND count(volume) OVER w >= 6 THEN "
    "(len(list_filter(list(volume) OVER w, lambda v: v < volume)) "
    "+ (len(list_filter(list(volume) OVER w, lambda v: v = volume)) + 1) / 2.0) / count(volume) OVER w END",
    frame(13),
)
_on_grid(
    "ts_zscore", "T7", f.ts_zscore(close, 8),
    "CASE WHEN count(close) OVER w >= 4 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END",
    frame(8),
)
_pair = "CASE WHEN close IS NOT NULL AND volume IS NOT NULL THEN {} END"
_px, _py = _pair.format("close"), _pair.format("volume")
_on_grid(
    "ts_corr", "T8", f.ts_corr(close, volume, 13),
    f"CASE WHEN count({_px}) OVER w >= 6 THEN covar_samp({_px}, {_py}) OVER w "
    f"/ nullif(stddev_samp({_px}) OVER w * stddev_samp({_py}) OVER w, 0) END",
    frame(13),
)
_on_grid(
    "log1p_abs", "X5", f.log1p_abs(f.delta(close, 2)),
    "sign(close - lag(close, 2) OVER e) * ln(1 + abs(close - lag(close, 2) OVER e))", E,
)
_on_grid(
    "signed_power", "X4", f.signed_power(f.ts_return(close, 2), 0.5),
    "sign(close / nullif(lag(close, 2) OVER e, 0) - 1) * pow(abs(close / nullif(lag(close, 2) OVER e, 0) - 1), 0.5)", E,
)
_on_grid(
    "term_arithmetic", "X14", (fld("high") - fld("low")) / (close + 1) * 2 - volume / fld("amount"),
    "(high - low) / nullif(close + 1, 0) * 2 - volume / nullif(amount, 0)", E,
)


def _densify(spark, sf_dir):
    grid = densify(weekly_panel(spark, sf_dir).select("entity", "date", "close"), leading=True)
    return rounded(grid.select("entity", "date", "close", "present"))


CHECKS["densify"] = Check(_densify, sql(f"SELECT entity, date, {R('close')} AS close, present FROM grid", "grid"), "J10")


def _densify_months(spark, sf_dir):
    grid = densify(monthly_panel(spark, sf_dir).select("entity", "date", "close"))
    w = ts.entity_window()
    return grid.select("entity", "date", "present", r6(ts.ts_return("close", 2, w)).alias("value")).filter("present").drop("present")


CHECKS["ts_return_monthly"] = Check(
    _densify_months,
    sql(f"SELECT entity, date, {R('value')} AS value FROM ("
        "SELECT e.entity, d.date, m.close, m.close / nullif(lag(m.close, 2) OVER (PARTITION BY e.entity ORDER BY d.date), 0) - 1 AS value "
        "FROM (SELECT DISTINCT entity FROM months) e CROSS JOIN (SELECT DISTINCT date FROM months) d "
        "LEFT JOIN months m ON m.entity = e.entity AND m.date = d.date) WHERE close IS NOT NULL", "months"),
    "T3 on a nearly dense panel",
)


# -- along the entity's own rows --------------------------------------------


def _rowwise(name: str, covers: str, build, expression: str, windows: str = E, source=weekly_panel, table: str = "panel",
             need: str = "entity, date, close") -> None:
    def run(spark, sf_dir):
        w = ts.entity_window()
        return source(spark, sf_dir).df.select("entity", "date", r6(build(w)).alias("value"))

    CHECKS[name] = Check(run, sql(f"SELECT entity, date, {R(expression)} AS value FROM {table} {windows}", table), covers)


_rowwise("forward_return", "T9", lambda w: ts.forward_return("close", 1, w), "lead(close) OVER e / nullif(close, 0) - 1")
_rowwise("forward_return_4", "T9", lambda w: ts.forward_return("close", 4, w), "lead(close, 4) OVER e / nullif(close, 0) - 1")
_rowwise("same_day_return", "T10", lambda w: ts.same_day_return("close", w), "close / nullif(lag(close) OVER e, 0) - 1")


def _forward_of_change(spark, sf_dir):
    w = ts.entity_window()
    moved = user_day_panel(spark, sf_dir).df.withColumn("chg", ts.same_day_return("close", w))
    return moved.select("entity", "date", r6(F.lead("chg").over(w)).alias("value"))


CHECKS["forward_return_of_change"] = Check(
    _forward_of_change,
    sql(f"SELECT entity, date, {R('lead(chg) OVER e')} AS value FROM (SELECT entity, date, "
        f"close / nullif(lag(close) OVER e, 0) - 1 AS chg FROM user_days {E}) {E}", "user_days"),
    "T11",
)


def _volatility(spark, sf_dir):
    w = ts.entity_window()
    rows = weekly_panel(spark, sf_dir).df.select("entity", "date", "close").withColumn("chg", ts.same_day_return("close", w))
    return rows.select("entity", "date", r6(ts.ts_std("chg", 20, w, min_count=15)).alias("value")).filter(F.col("value").isNotNull())


CHECKS["volatility_20"] = Check(
    _volatility,
    sql(f"SELECT entity, date, {R('value')} AS value FROM (SELECT entity, date, CASE WHEN count(chg) OVER w >= 15 THEN stddev_samp(chg) OVER w END AS value "
        f"FROM (SELECT entity, date, close / nullif(lag(close) OVER e, 0) - 1 AS chg FROM panel {E}) {frame(20)}) WHERE value IS NOT NULL", "panel"),
    "T12, R15",
)


def _next_flag(spark, sf_dir):
    w = ts.entity_window()
    return weekly_panel(spark, sf_dir).df.select("entity", "date", ts.next_flag("limit_up_flag", w).alias("value"))


CHECKS["next_flag"] = Check(
    _next_flag, sql(f"SELECT entity, date, lead(coalesce(limit_up_flag, false)) OVER e AS value FROM panel {E}", "panel"), "T13"
)


def _cum_return(spark, sf_dir):
    w = ts.entity_window()
    # compounded over months so that values stay in a comparable range
    rows = monthly_panel(spark, sf_dir).df.select("entity", "date", "close").withColumn("chg", ts.same_day_return("close", w))
    return rows.select("entity", "date", r6(ts.compound("chg", w)).alias("value"))


CHECKS["cum_return"] = Check(
    _cum_return,
    sql("SELECT entity, date, " + R("product(1 + coalesce(chg, 0)) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING) - 1")
        + f" AS value FROM (SELECT entity, date, close / nullif(lag(close) OVER e, 0) - 1 AS chg FROM months {E})", "months"),
    "T14",
)


def _drawdown(spark, sf_dir):
    w = ts.entity_window()
    rows = weekly_panel(spark, sf_dir).df
    return rows.select("entity", "date", r6(ts.drawdown("close", w)).alias("value"))


CHECKS["drawdown"] = Check(
    _drawdown,
    sql("SELECT entity, date, " + R("close / nullif(max(close) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING), 0) - 1")
        + " AS value FROM panel", "panel"),
    "T15",
)


# -- within one date ---------------------------------------------------------


def _cross(name: str, covers: str, apply, expression: str, extra: str = "", digits: int = 6) -> None:
    def run(spark, sf_dir):
        panel = weekly_panel(spark, sf_dir)
        out = apply(panel.cross_section(), panel.df)
        return out.select("entity", "date", r6(F.col("value").cast("double"), digits).alias("value"))

    CHECKS[name] = Check(run, sql(f"SELECT entity, date, {R(expression, digits)} AS value FROM panel {extra}", "panel"), covers)


_cross("rank", "X1", lambda cs, df: cs.rank(df, "volume", "value"), rank_sql("volume", "date"))
_cross("zscore", "X2", lambda cs, df: cs.zscore(df, "close", "value"),
       "(close - avg(close) OVER d) / nullif(stddev_samp(close) OVER d, 0)", "WINDOW d AS (PARTITION BY date)")
_cross("zscore_flat", "X2", lambda cs, df: cs.zscore(df, "volume", "value", flat=0.0, tiny=1e-9),
       "CASE WHEN stddev_samp(volume) OVER d > 1e-9 THEN (volume - avg(volume) OVER d) / stddev_samp(volume) OVER d ELSE 0 END",
       "WINDOW d AS (PARTITION BY date)")
_cross("winsorize", "X3", lambda cs, df: cs.winsorize(df, "close", "value", 0.05, 0.95),
       "greatest(least(close, hi), lo)",
       "JOIN (SELECT date, quantile_cont(close, 0.05) AS lo, quantile_cont(close, 0.95) AS hi FROM panel GROUP BY date) USING (date)")
_cross("neutralize_industry", "X6", lambda cs, df: cs.neutralize_industry(df, "close", "value"),
       "close - avg(close) OVER (PARTITION BY date, industry)", digits=PRICE_DIGITS)
_cross("cross_demean", "X8", lambda cs, df: cs.demean(df, "close", "value"), "close - avg(close) OVER (PARTITION BY date)",
       digits=PRICE_DIGITS)
_cross("industry_demean", "X10", lambda cs, df: cs.industry_demean(df, "volume", "value"),
       "volume - coalesce(avg(volume) OVER (PARTITION BY date, industry), 0)", digits=PRICE_DIGITS)


def _residual(size: str, guard: str) -> str:
    """SQL of the per-date regression residual as a join with per-date moments."""
    return (
        f"SELECT entity, date, close AS y, CASE WHEN {guard} THEN {size} END AS s FROM panel"
    )


def _size(method: str):
    def run(spark, sf_dir):
        panel = weekly_panel(spark, sf_dir)
        out = getattr(panel.cross_section(), method)(panel.df, "close", "value")
        return out.select("entity", "date", r6("value", PRICE_DIGITS).alias("value"))

    return run


CHECKS["neutralize_size"] = Check(
    _size("neutralize_size"),
    sql(f"SELECT entity, b.date, {R('CASE WHEN s IS NULL THEN NULL WHEN sv > 1e-12 THEN y - ym - cv / sv * (s - sm) ELSE y - ym END', PRICE_DIGITS)} AS value "
        f"FROM ({_residual('ln(1 + market_cap)', 'market_cap > -1')}) b JOIN (SELECT date, avg(y) FILTER (s IS NOT NULL) AS ym, avg(s) AS sm, "
        f"var_samp(s) AS sv, covar_samp(y, s) AS cv FROM ({_residual('ln(1 + market_cap)', 'market_cap > -1')}) GROUP BY date) m ON b.date = m.date", "panel"),
    "X7",
)
CHECKS["mktcap_residual"] = Check(
    _size("size_residual"),
    sql(f"SELECT entity, b.date, {R('CASE WHEN s IS NULL OR n < 5 THEN y ELSE y - ym - coalesce(cv / nullif(sv, 0), 0) * (s - sm) END', PRICE_DIGITS)} AS value "
        f"FROM ({_residual('ln(market_cap + 1e-10)', 'market_cap > 0')}) b JOIN (SELECT date, count(s) AS n, avg(y) FILTER (s IS NOT NULL) AS ym, avg(s) AS sm, "
        f"var_pop(s) AS sv, covar_pop(y, s) AS cv FROM ({_residual('ln(market_cap + 1e-10)', 'market_cap > 0')}) GROUP BY date) m ON b.date = m.date", "panel"),
    "X9",
)


def _neutralize(spark, sf_dir):
    panel = weekly_panel(spark, sf_dir)
    out = panel.cross_section().neutralize(panel.df, "close", "value", ["industry", "cross_demean"], size="no_such_column")
    return out.select("entity", "date", r6("value", PRICE_DIGITS).alias("value"))


CHECKS["neutralize"] = Check(
    _neutralize,
    sql(f"SELECT entity, date, {R('close - avg(close) OVER (PARTITION BY date, industry) - avg(close) OVER (PARTITION BY date)', PRICE_DIGITS)} AS value FROM panel", "panel"),
    "X11",
)

def edges_sql(x: str, source: str, keys: str, bins: int) -> str:
    """Exact quantile edges per group, duplicates dropped, as a sorted list."""
    at = (
        "l[CAST(k * (n - 1) // {b} AS BIGINT) + 1] + CASE WHEN k * (n - 1) % {b} > 0 THEN "
        "(l[CAST(k * (n - 1) // {b} AS BIGINT) + 2] - l[CAST(k * (n - 1) // {b} AS BIGINT) + 1]) * (k * (n - 1) % {b}) / {b}.0 ELSE 0 END"
    ).format(b=bins)
    return (
        f"SELECT {keys}, n, list_sort(list_distinct(list({at}))) AS edges FROM ("
        f"SELECT {keys}, list_sort(list({x} + 0.0)) AS l, count({x}) AS n FROM {source} WHERE {x} IS NOT NULL GROUP BY {keys}), "
        f"range({bins + 1}) r(k) GROUP BY {keys}, n"
    )


def _quantile_bin(spark, sf_dir):
    panel = weekly_panel(spark, sf_dir)
    out = panel.cross_section().quantile_bin(panel.df, "volume", "bin", 10)
    return out.select("entity", "date", F.col("bin").cast("long").alias("bin"))


CHECKS["quantile_bin"] = Check(
    _quantile_bin,
    sql(f"SELECT entity, p.date, CASE WHEN n >= 10 THEN CAST(greatest(len(list_filter(edges, lambda e: e < volume)), 1) - 1 AS BIGINT) END AS bin "
        f"FROM panel p JOIN ({edges_sql('volume', 'panel', 'date', 10)}) q ON p.date = q.date", "panel"),
    "X12",
)


def _extremes(spark, sf_dir):
    panel = weekly_panel(spark, sf_dir)
    return panel.cross_section().extreme_masks(panel.df, "close").select("entity", "date", "is_long", "is_short")


CHECKS["extreme_masks"] = Check(
    _extremes,
    sql(f"SELECT entity, date, p >= 0.9 AS is_long, p <= 0.1 AS is_short FROM (SELECT entity, date, {rank_sql('close', 'date')} AS p FROM panel)", "panel"),
    "X13",
)

# -- recipes -----------------------------------------------------------------

_rank = lambda x: rank_sql(x, "date")
_RET = "close / nullif(lag(close, {n}) OVER e, 0) - 1"


def _recipe(recipe_id: str, windows: tuple[int, ...], steps: list[str], value: str, covers: str) -> None:
    """``steps`` are nested selects over the grid, each seeing the previous columns."""

    def run(spark, sf_dir):
        term = recipes.by_id(recipe_id).term(*windows)
        wide = factor_wide(weekly_panel(spark, sf_dir), {"value": term})
        return wide.select("entity", "date", r6("value").alias("value")).filter(F.col("value").isNotNull())

    source = "grid"
    for step in steps:
        source = f"(SELECT *, {step[0]} FROM {source} {step[1]})"
    text = sql(f"SELECT entity, date, {R('value')} AS value FROM (SELECT *, {value} AS value FROM {source}) WHERE present AND value IS NOT NULL", "grid")
    CHECKS[f"recipe_{recipe_id}"] = Check(run, text, covers)


def _w(n: int) -> str:
    return frame(n)


def _roll(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER w >= {max(2, n // 2)} THEN {fn}({x}) OVER w END"


def _troll_rank(x: str, n: int) -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER w >= {max(2, n // 2)} THEN "
        f"(len(list_filter(list({x}) OVER w, lambda v: v < {x})) + (len(list_filter(list({x}) OVER w, lambda v: v = {x})) + 1) / 2.0) "
        f"/ count({x}) OVER w END"
    )


_clip = (
    "CASE WHEN a IS NOT NULL THEN greatest(least(a, hi), lo) END AS c",
    "JOIN (SELECT date, quantile_cont(a, 0.01) AS lo, quantile_cont(a, 0.99) AS hi FROM {src} GROUP BY date) USING (date)",
)

_recipe("momentum_20d_rank", (8,), [(f"{_RET.format(n=8)} AS a", E)], _rank("a"), "R1")
_recipe("momentum_60d_rank", (26,), [(f"{_RET.format(n=26)} AS a", E)], _rank("a"), "R2")
_recipe("ts_rank_return_20d", (2, 8), [(f"{_RET.format(n=2)} AS a", E), (f"{_troll_rank('a', 8)} AS b", _w(8))], _rank("b"), "R3")
_recipe("short_reversal_10d_rank", (4,), [(f"-({_RET.format(n=4)}) AS a", E)], _rank("a"), "R5")
_recipe("volatility_20d_lowvol_rank", (1, 8),
        [(f"{_RET.format(n=1)} AS a", E), (f"-({_roll('stddev_samp', 'a', 8)}) AS b", _w(8))], _rank("b"), "R6")
_recipe("volatility_zscore_60d", (1, 8, 26),
        [(f"{_RET.format(n=1)} AS a", E), (f"{_roll('stddev_samp', 'a', 8)} AS b", _w(8)),
         ("-((b - CASE WHEN count(b) OVER w >= 13 THEN avg(b) OVER w END) / nullif(CASE WHEN count(b) OVER w >= 13 THEN stddev_samp(b) OVER w END, 0)) AS c", _w(26))],
        _rank("c"), "R7")
_recipe("volume_rank_20d", (8,), [(f"{_troll_rank('volume', 8)} AS a", _w(8))], _rank("a"), "R8")
_recipe("amount_liquidity_20d", (8,), [(f"{_roll('avg', 'amount', 8)} AS a", _w(8))], _rank("a"), "R9")
_recipe("volume_price_divergence_10d", (4,),
        [(f"(close - lag(close, 4) OVER e) / nullif({_roll('avg', 'volume', 4)} + 1, 0) AS a", _w(4))], _rank("a"), "R10")
_recipe("small_cap_inverse_mcap", (), [("1 / nullif(market_cap, 0) AS a", "")], _rank("a"), "R11")
_recipe("vwap_close_reversal_5d", (), [("(vwap - close) / nullif(close, 0) AS a", "")], _rank("a"), "R12")
_recipe("industry_neutral_momentum_20d", (8,),
        [(f"{_RET.format(n=8)} AS a", E), (f"{_rank('a')} AS b", "")],
        "CASE WHEN industry IS NOT NULL THEN b - avg(b) OVER (PARTITION BY date, industry) END", "R13")


def _winsor_recipe(recipe_id: str, windows: tuple[int, ...], covers: str, sized: bool) -> None:
    def run(spark, sf_dir):
        term = recipes.by_id(recipe_id).term(*windows)
        wide = factor_wide(weekly_panel(spark, sf_dir), {"value": term})
        return wide.select("entity", "date", r6("value").alias("value")).filter(F.col("value").isNotNull())

    raw = f"SELECT *, -(close / nullif(lag(close, {windows[0]}) OVER e, 0) - 1) AS a FROM grid {E}"
    clipped = (
        f"SELECT entity, r.date, present, market_cap, CASE WHEN a IS NOT NULL THEN greatest(least(a, hi), lo) END AS y FROM ({raw}) r "
        f"JOIN (SELECT date, quantile_cont(a, 0.01) AS lo, quantile_cont(a, 0.99) AS hi FROM ({raw}) GROUP BY date) q ON r.date = q.date"
    )
    if not sized:
        text = sql(f"SELECT entity, date, {R('y')} AS value FROM ({clipped}) WHERE present AND y IS NOT NULL", "grid")
    else:
        base = f"SELECT entity, date, present, y, CASE WHEN market_cap > -1 THEN ln(1 + market_cap) END AS s FROM ({clipped})"
        both = f"SELECT * FROM ({base}) WHERE y IS NOT NULL AND s IS NOT NULL"
        value = "CASE WHEN sv > 1e-12 THEN y - ym - cv / sv * (s - sm) ELSE y - ym END"
        text = sql(
            f"SELECT entity, b.date, {R(value)} AS value FROM ({both}) b JOIN (SELECT date, avg(y) AS ym, avg(s) AS sm, var_samp(s) AS sv, "
            f"covar_samp(y, s) AS cv FROM ({both}) GROUP BY date) m ON b.date = m.date WHERE present", "grid")
    CHECKS[f"recipe_{recipe_id}"] = Check(run, text, covers)


_winsor_recipe("short_reversal_5d_winsor", (2,), "R4", False)
_winsor_recipe("size_neutral_reversal_5d", (2,), "R14", True)
