"""Shared inputs of the registered queries, once in Spark and once as SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.functions.scalar import col
from panelwright.operators import ic
from panelwright.plans import factors as f
from panelwright.plans.factors import Term, factor_long, factor_wide, fld
from panelwright.session import ensure_checkpoint_dir, store
from panelwright.sources.panel import FLAGS, KEY, Panel, weekly_panel


@dataclass(frozen=True)
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


NUDGE = 1e-8


def r6(x, digits: int = 6) -> Column:
    """Round for comparison; adding 0.0 folds -0.0 into 0.0.

    Prices here are whole cents over whole quantities, so many values lie exactly
    half-way at the seventh digit, where engines round differently.  A nudge far
    above float noise and far below the sixth digit settles them.
    """
    return F.round(col(x) + F.lit(NUDGE), digits) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column."""
    return df.select(
        *[r6(n).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    )


def magnitude(x) -> Column:
    """Sign and order of a number: compounded returns of this panel span hundreds of digits."""
    return r6(F.signum(col(x)) * F.log1p(F.abs(col(x))))


def magnitude_sql(expr: str) -> str:
    return R(f"sign({expr}) * ln(1 + abs({expr}))")


def R(expr: str, digits: int = 6) -> str:
    return f"round(({expr}) + {NUDGE!r}, {digits}) + 0.0"


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------
# SQL building blocks

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


def sql(select: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        deps, _ = CTES[name]
        for d in deps:
            visit(d)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return select
    parts = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    return f"WITH {parts}\n{select}"


def rank_sql(x: str, keys: str, pct: bool = True) -> str:
    """Average-tie rank of x within keys; NULL in, NULL out."""
    place = (
        f"(rank() OVER (PARTITION BY {keys} ORDER BY {x} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)"
    )
    share = f" / count({x}) OVER (PARTITION BY {keys})" if pct else ""
    return f"CASE WHEN {x} IS NOT NULL THEN {place}{share} END"


def centred_sql(x: str, keys: str) -> str:
    """Average-tie rank minus the mean rank of the group."""
    return f"({rank_sql(x, keys, False)}) - (count({x}) OVER (PARTITION BY {keys}) + 1) / 2.0"


def rank_corr_sql(x: str, y: str) -> str:
    """Correlation of centred ranks."""
    return f"sum({x} * {y}) / nullif(sqrt(sum({x} * {x}) * sum({y} * {y})), 0)"


def corr_sql(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def _bars(prefix: str, period: str) -> None:
    cte(f"{prefix}_lines", (), f"""
  SELECT l_suppkey, CAST(date_trunc('{period}', l_shipdate) AS DATE) AS date,
         l_extendedprice / l_quantity AS px, l_shipdate, l_orderkey, l_linenumber, l_partkey,
         l_quantity, l_extendedprice, l_discount, l_returnflag
  FROM lineitem""")
    cte(f"{prefix}_bars", (f"{prefix}_lines",), f"""
  SELECT l_suppkey, date,
         arg_min(px, row(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS open,
         max(px) AS high, min(px) AS low,
         arg_max(px, row(l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS close,
         sum(l_quantity) AS volume,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount,
         count(*) >= 3 AND bool_and(l_returnflag = 'R') AS ST,
         CASE WHEN NOT bool_and(l_returnflag = 'A')
              THEN max(l_discount) >= 0.095 AND bool_and(l_returnflag = 'R') END AS limit_up_flag,
         CASE WHEN NOT bool_and(l_returnflag = 'A')
              THEN min(l_discount) <= 0.005 AND bool_and(l_returnflag = 'R') END AS limit_down_flag,
         avg(l_quantity) < 4 AS suspended
  FROM {prefix}_lines GROUP BY 1, 2""")
    cte(prefix, (f"{prefix}_bars",), f"""
  SELECT CAST(l_suppkey AS VARCHAR) AS entity, date, open, high, low, close, volume, amount,
         amount / volume AS vwap, s_acctbal * close AS market_cap, r_name AS industry,
         ST, limit_up_flag, limit_down_flag, suspended
  FROM {prefix}_bars
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey""")


_bars("panel", "week")
_bars("months", "month")
cte("grid", ("panel",), """
  SELECT e.entity, d.date, p.* EXCLUDE (entity, date), p.entity IS NOT NULL AS present
  FROM (SELECT DISTINCT entity FROM panel) e
  CROSS JOIN (SELECT DISTINCT date FROM panel) d
  LEFT JOIN panel p ON p.entity = e.entity AND p.date = d.date""")
cte("user_days", (), """
  SELECT CAST(user_id AS VARCHAR) AS entity, CAST(ts AS DATE) AS date,
         arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2""")

# --------------------------------------------------------------------------
# A small factor library on the weekly panel

LIBRARY: dict[str, Term] = {
    "momentum_4": f.rank(f.ts_return(fld("close"), 4)),
    "reversal_2": f.winsorize(-f.ts_return(fld("close"), 2), 0.05, 0.95),
    "activity_8": f.rank(f.ts_rank(fld("volume"), 8)),
    "liquidity_8": f.rank(f.ts_mean(fld("amount"), 8)),
}
FAMILIES = {"momentum_4": "momentum", "reversal_2": "reversal", "activity_8": "volume", "liquidity_8": "liquidity"}

cte("raw_terms", ("grid",), """
  SELECT *, close / nullif(lag(close, 4) OVER e, 0) - 1 AS r4,
         -(close / nullif(lag(close, 2) OVER e, 0) - 1) AS rev2,
         CASE WHEN count(volume) OVER f8 >= 4 AND volume IS NOT NULL THEN
           (len(list_filter(list(volume) OVER f8, lambda v: v < volume))
            + (len(list_filter(list(volume) OVER f8, lambda v: v = volume)) + 1) / 2.0) / count(volume) OVER f8 END AS tr8,
         CASE WHEN count(amount) OVER f8 >= 4 THEN avg(amount) OVER f8 END AS am8
  FROM grid
  WINDOW e AS (PARTITION BY entity ORDER BY date),
         f8 AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
cte("limits", ("raw_terms",), """
  SELECT date, quantile_cont(rev2, 0.05) AS lo, quantile_cont(rev2, 0.95) AS hi FROM raw_terms GROUP BY date""")
cte("wide", ("raw_terms", "limits"), f"""
  SELECT g.*, {rank_sql('r4', 'g.date')} AS momentum_4,
         CASE WHEN rev2 IS NOT NULL THEN greatest(least(rev2, hi), lo) END AS reversal_2,
         {rank_sql('tr8', 'g.date')} AS activity_8,
         {rank_sql('am8', 'g.date')} AS liquidity_8
  FROM raw_terms g JOIN limits USING (date)""")
cte("merged", ("wide",), " UNION ALL ".join(
    f"SELECT '{n}' AS factor_name, entity, date, {n} AS value, close, market_cap, industry, ST, limit_up_flag, limit_down_flag, suspended"
    f" FROM wide WHERE present AND {n} IS NOT NULL" for n in LIBRARY))
cte("rets", ("merged",), """
  SELECT *, lead(close) OVER w / nullif(close, 0) - 1 AS ret,
         coalesce(lead(limit_up_flag) OVER w, false) AS next_up,
         coalesce(lead(limit_down_flag) OVER w, false) AS next_down
  FROM merged WINDOW w AS (PARTITION BY factor_name, entity ORDER BY date)""")
cte("clean", ("rets",), """
  SELECT factor_name, entity, date, value, ret FROM rets
  WHERE ret IS NOT NULL AND NOT coalesce(ST, false) AND NOT coalesce(limit_up_flag, false)
    AND NOT coalesce(limit_down_flag, false) AND NOT coalesce(suspended, false) AND NOT next_up AND NOT next_down""")
cte("clean_ranked", ("clean",), f"""
  SELECT *, {centred_sql('value', 'factor_name, date')} AS rx, {centred_sql('ret', 'factor_name, date')} AS ry
  FROM clean""")
cte("daily", ("clean_ranked",), f"""
  SELECT * FROM (
    SELECT factor_name, date, {corr_sql('value', 'ret')} AS ic, {rank_corr_sql('rx', 'ry')} AS rank_ic, count(*) AS n_stocks
    FROM clean_ranked GROUP BY factor_name, date)
  WHERE n_stocks >= 50 AND ic IS NOT NULL AND rank_ic IS NOT NULL""")
# p-values by Simpson's rule: the tail of Student's t is a ratio of integrals of cos^(df-1)
cte("p_points", (), """
  SELECT i, CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(2001) t(i)""")
cte("daily_p", ("daily", "p_points"), """
  SELECT d.factor_name, d.date, any_value(d.ic) AS ic, any_value(d.rank_ic) AS rank_ic, any_value(d.n_stocks) AS n_stocks,
         (any_value(pi() / 2 - t1) * sum(w * pow(cos(t1 + (pi() / 2 - t1) * i / 2000.0), n_stocks - 3)))
           / (any_value(pi() / 2) * sum(w * pow(cos(pi() / 2 * i / 2000.0), n_stocks - 3))) AS p_value,
         (any_value(pi() / 2 - t2) * sum(w * pow(cos(t2 + (pi() / 2 - t2) * i / 2000.0), n_stocks - 3)))
           / (any_value(pi() / 2) * sum(w * pow(cos(pi() / 2 * i / 2000.0), n_stocks - 3))) AS ic_p_value
  FROM (SELECT *, atan(abs(rank_ic) / sqrt(1 - rank_ic * rank_ic)) AS t1, atan(abs(ic) / sqrt(1 - ic * ic)) AS t2 FROM daily) d,
       p_points
  GROUP BY d.factor_name, d.date""")
cte("stats", ("daily",), """
  SELECT factor_name, avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS rank_ic_std,
         avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS rank_ic_ir,
         avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS rank_ic_win_rate,
         avg(ic) AS mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) AS ic_ir, count(*) AS valid_days
  FROM daily GROUP BY factor_name""")

CARRY = ["close", "market_cap", "industry", *FLAGS]


def library(spark: SparkSession, sf_dir: str, carry: list[str] = ["close", *FLAGS], horizons: tuple[int, ...] = ()) -> tuple[Panel, DataFrame]:
    """The weekly panel and its library factors joined with the panel's own columns."""
    panel = weekly_panel(spark, sf_dir)
    return panel, factor_long(panel, LIBRARY, carry=carry, ahead=not horizons and set(FLAGS) <= set(carry), horizons=horizons)


def library_factors(spark: SparkSession, sf_dir: str) -> tuple[Panel, DataFrame]:
    panel, merged = library(spark, sf_dir, carry=[])
    return panel, merged.select("factor_name", "entity", "date", "value")


def stored_panel(spark: SparkSession, sf_dir: str, fields: list[str]) -> Panel:
    """The weekly panel as if read from files, for queries that need it more than once."""
    panel = weekly_panel(spark, sf_dir)
    return Panel(store(panel.df.select(*KEY, *fields)), panel.names_bound)


def stored_library(spark: SparkSession, sf_dir: str) -> tuple[Panel, DataFrame]:
    panel = stored_panel(spark, sf_dir, ["close", "volume", "amount", *FLAGS])
    return panel, factor_long(panel, LIBRARY).select("factor_name", "entity", "date", "value")


def library_wide(spark: SparkSession, sf_dir: str, carry: list[str] = []) -> DataFrame:
    """The library's factors side by side, one row per entity and date."""
    return factor_wide(weekly_panel(spark, sf_dir), LIBRARY, carry)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel, merged = library(spark, sf_dir)
    return ic.daily_ic(merged, panel.cross_section("factor_name"))
