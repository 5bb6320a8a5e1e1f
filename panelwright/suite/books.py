"""Portfolio queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import ic, portfolio
from panelwright.plans import pipelines
from panelwright.sources.panel import monthly_panel
from panelwright.suite.base import Check, R, cte, library, library_factors, magnitude, magnitude_sql, rounded, sql
from panelwright.suite.windows import edges_sql

CHECKS: dict[str, Check] = {}
BINS = 5


def _add(name: str, covers: str, run, text: str | None) -> None:
    CHECKS[name] = Check(run, text, covers)


def _buckets(spark, sf_dir):
    panel, merged = library(spark, sf_dir)
    return portfolio.decile_returns(merged, panel.cross_section("factor_name"), BINS)


def binned_sql(source: str) -> str:
    return (
        f"SELECT c.*, CAST(greatest(len(list_filter(edges, lambda e: e < value)), 1) AS INTEGER) AS bucket FROM {source} c "
        f"JOIN ({edges_sql('value', source, 'factor_name, date', BINS)}) q ON q.factor_name = c.factor_name AND q.date = c.date WHERE n >= {BINS}"
    )


cte("buckets", ("clean",), f"SELECT factor_name, date, bucket, avg(ret) AS ret, count(*) AS n_names FROM ({binned_sql('clean')}) GROUP BY 1, 2, 3")
_add("decile_returns", "X12, A23", lambda spark, sf_dir: rounded(_buckets(spark, sf_dir).withColumn("bucket", F.col("bucket").cast("int"))), sql(
    f"SELECT factor_name, date, bucket, {R('ret')} AS ret, n_names FROM buckets", "buckets"))

_Q = ", ".join(f"max(ret) FILTER (bucket = {b}) AS Q{b}" for b in range(1, BINS + 1))
cte("bucket_wide", ("buckets",), f"""
  SELECT *, Q{BINS} - Q1 - 2.0 * 10 / 10000.0 AS LS FROM (SELECT factor_name, date, {_Q} FROM buckets GROUP BY 1, 2)""")
_COLUMNS = [f"Q{b}" for b in range(1, BINS + 1)] + ["LS"]


def _bucket_table(spark, sf_dir):
    return portfolio.bucket_table(_buckets(spark, sf_dir), BINS, 10.0)


_add("bucket_table", "A23, K2", lambda spark, sf_dir: rounded(_bucket_table(spark, sf_dir)), sql(
    "SELECT factor_name, date, " + ", ".join(f"{R(c)} AS {c}" for c in _COLUMNS) + " FROM bucket_wide", "bucket_wide"))


def _log_growth(df):
    """Compounded values span many orders of magnitude; compare sign and logarithm."""
    return df.select("factor_name", "date", *[magnitude(c).alias(c) for c in portfolio.series_columns(df)])


def _product(c: str) -> str:
    return f"product(1 + coalesce({c}, 0)) OVER (PARTITION BY factor_name ORDER BY date ROWS UNBOUNDED PRECEDING)"


_add("cumulative_table", "T14, K2", lambda spark, sf_dir: _log_growth(portfolio.cumulative_table(_bucket_table(spark, sf_dir))), sql(
    "SELECT factor_name, date, " + ", ".join(magnitude_sql(f"({_product(c)} - 1)") + f" AS {c}" for c in _COLUMNS) + " FROM bucket_wide", "bucket_wide"))


def _terminal(spark, sf_dir):
    out = portfolio.terminal_returns(portfolio.cumulative_table(_bucket_table(spark, sf_dir)))
    return out.select("factor_name", "valid_days", *[magnitude(c).alias(c) for c in _COLUMNS])


_add("terminal_returns", "A35", _terminal, sql(
    "SELECT factor_name, count(*) AS valid_days, " + ", ".join(
        magnitude_sql(f"(arg_max(p_{c}, date) - 1)") + f" AS {c}" for c in _COLUMNS)
    + " FROM (SELECT factor_name, date, " + ", ".join(f"{_product(c)} AS p_{c}" for c in _COLUMNS) + " FROM bucket_wide) GROUP BY 1", "bucket_wide"))


def _aligned(spark, sf_dir):
    # only the dates on which the long-short series gained, so that gaps differ by factor
    gains = _bucket_table(spark, sf_dir).filter(F.col("LS") > 0).select("factor_name", "date", "Q1", "LS")
    return rounded(portfolio.align_ffill(gains, ["Q1", "LS"]))


_add("align_ffill", "J9, U5", _aligned, sql(
    f"SELECT g.factor_name, g.date, {R('b.Q1')} AS Q1, {R('b.LS')} AS LS FROM (SELECT factor_name, date FROM (SELECT DISTINCT factor_name FROM bucket_wide WHERE LS > 0) "
    "CROSS JOIN (SELECT DISTINCT date FROM bucket_wide WHERE LS > 0)) g ASOF LEFT JOIN (SELECT * FROM bucket_wide WHERE LS > 0) b "
    "ON g.factor_name = b.factor_name AND g.date >= b.date", "bucket_wide"))

# -- holdings under trading blocks, as a recursive fold in SQL ----------------

cte("held_rows", ("rets",), """
  SELECT factor_name, entity, date, value, ret,
         NOT (coalesce(limit_up_flag, false) OR coalesce(suspended, false)) AS can_buy,
         NOT (coalesce(limit_down_flag, false) OR coalesce(suspended, false)) AS can_sell
  FROM rets WHERE ret IS NOT NULL AND NOT coalesce(ST, false)""")
cte("held_bins", ("held_rows",), binned_sql("held_rows"))
cte("open_buckets", ("held_bins",), "SELECT DISTINCT factor_name, date, bucket FROM held_bins")
cte("held_signals", ("held_bins", "open_buckets"), """
  SELECT h.factor_name, h.entity, h.date, o.bucket, h.ret,
         CASE WHEN h.bucket = o.bucket AND can_buy THEN 1 WHEN h.bucket <> o.bucket AND can_sell THEN 0 END AS s
  FROM held_bins h JOIN open_buckets o ON o.factor_name = h.factor_name AND o.date = h.date""")
cte("held_numbered", ("held_signals",), """
  SELECT *, row_number() OVER (PARTITION BY factor_name, entity, bucket ORDER BY date) AS step FROM held_signals""")
cte("held_state", ("held_numbered",), """
  WITH RECURSIVE fold AS (
    SELECT factor_name, entity, bucket, date, ret, step, coalesce(s, 0) AS held, 0 AS was FROM held_numbered WHERE step = 1
    UNION ALL
    SELECT n.factor_name, n.entity, n.bucket, n.date, n.ret, n.step, coalesce(n.s, f.held), f.held
    FROM fold f JOIN held_numbered n ON n.factor_name = f.factor_name AND n.entity = f.entity AND n.bucket = f.bucket AND n.step = f.step + 1)
  SELECT * FROM fold""")
cte("held_daily", ("held_state",), """
  SELECT *, sum(n_in - n_out) OVER (PARTITION BY factor_name, bucket ORDER BY date ROWS UNBOUNDED PRECEDING) AS n FROM (
    SELECT factor_name, bucket, date, count(*) FILTER (held = 1 AND was = 0) AS n_in, count(*) FILTER (held = 0 AND was = 1) AS n_out,
           coalesce(sum(ret) FILTER (held = 1), 0) AS gain FROM held_state GROUP BY 1, 2, 3)""")
cte("held_turns", ("held_daily",), """
  SELECT *, coalesce(1 / nullif(n, 0), 0) AS w1, coalesce(1 / nullif(before, 0), 0) AS w0 FROM (
    SELECT *, coalesce(lag(n) OVER (PARTITION BY factor_name, bucket ORDER BY date), 0) AS before FROM held_daily)""")


def _stateful(spark, sf_dir):
    panel, merged = library(spark, sf_dir)
    out = portfolio.stateful_backtest(merged, panel.cross_section("factor_name"), BINS, cost_bps=10.0)
    return rounded(out.withColumn("bucket", F.col("bucket").cast("int")))


_turn = "0.5 * (n_in * w1 + n_out * w0 + (n - n_in) * abs(w1 - w0))"
_add("stateful_backtest", "A24, P7, U3, U4", _stateful, sql(
    f"SELECT factor_name, date, bucket, {R(f'gain * w1 - {_turn} * 0.001')} AS ret, CAST(n AS BIGINT) AS n_held, {R(_turn)} AS turnover FROM held_turns",
    "held_turns"))


def _stats(spark, sf_dir):
    """Statistics of the monthly change of each industry's mean price."""
    w = ic.ts.entity_window("industry")
    levels = monthly_panel(spark, sf_dir).df.groupBy("industry", "date").agg(F.avg("close").alias("level"))
    series = levels.withColumn("ret", ic.ts.same_day_return("level", w))
    return rounded(portfolio.portfolio_stats(series, ["industry"]))


cte("month_series", ("months",), """
  SELECT industry, date, level / nullif(lag(level) OVER (PARTITION BY industry ORDER BY date), 0) - 1 AS ret FROM (
    SELECT industry, date, avg(close) AS level FROM months GROUP BY 1, 2)""")
_add("portfolio_stats", "A25, T14, T15", _stats, sql(
    f"SELECT industry, count(*) AS n_days, {R('product(1 + ret) - 1')} AS total_return, {R('pow(product(1 + ret), 252.0 / count(*)) - 1')} AS annualized_return, "
    f"{R('coalesce(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252), 0)')} AS sharpe_ratio, {R('min(dd)')} AS max_drawdown FROM ("
    "SELECT industry, ret, equity / max(equity) OVER (PARTITION BY industry ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM ("
    "SELECT industry, date, ret, product(1 + ret) OVER (PARTITION BY industry ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM month_series WHERE ret IS NOT NULL)) GROUP BY 1", "month_series"))


# -- a whole back-test run ----------------------------------------------------


def _backtest(spark, sf_dir):
    panel, factors = library_factors(spark, sf_dir)
    table, _ = pipelines.backtest(panel, factors, bins=BINS, cost_bps=10.0, realistic_execution=False)
    return rounded(table.groupBy("factor_name").agg(
        F.count("*").alias("n_days"), F.avg("LS").alias("mean_ls"), F.avg("Q1").alias("mean_q1"), F.max("Q5").alias("max_q5")))


_add("backtest", "whole run: J1, A23, K2", _backtest, sql(
    f"SELECT factor_name, count(*) AS n_days, {R('avg(LS)')} AS mean_ls, {R('avg(Q1)')} AS mean_q1, {R('max(Q5)')} AS max_q5 FROM bucket_wide GROUP BY 1", "bucket_wide"))
