"""End-to-end runs: evaluate a library, back-test it, screen it, judge a newcomer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from panelwright.operators import ic, portfolio, screen, similarity
from panelwright.plans import batch
from panelwright.session import cut_lineage
from panelwright.sources import sinks
from panelwright.sources.factor_files import normalise_factor
from panelwright.sources.panel import FLAGS, KEY, Panel


def user_factor(panel: Panel, compute: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run a user's ``panel -> (entity, date, one value column)`` function as a factor."""
    return normalise_factor(compute(panel.df), name)


def batch_analysis(
    panel: Panel,
    factors: DataFrame,
    out: str,
    min_names: int = ic.MIN_NAMES,
    next_day: bool = True,
) -> DataFrame:
    """Evaluate every factor that has no stored result and return the graded summary of all.

    Daily tables accumulate under ``out/daily``, a folder per factor that a repeated
    run replaces.  All new factors are one job; :func:`batch.run_batch` is the form
    that keeps failures apart and times them.
    """
    spark = factors.sparkSession
    daily_path = f"{out}/daily"
    new = factors
    if batch.stored(spark, daily_path) is not None:
        new = factors.join(sinks.stored_factors(spark, daily_path), "factor_name", "left_anti")
    merged = ic.merge_factors(new, panel.df.select(*KEY, "close", *FLAGS))
    daily = ic.daily_ic(merged, panel.cross_section("factor_name"), min_names=min_names, next_day=next_day)
    sinks.write_daily(daily, daily_path)
    return screen.grade(ic.factor_summary(spark.read.parquet(daily_path))).drop("failed")


def backtest(
    panel: Panel,
    factors: DataFrame,
    bins: int = 10,
    cost_bps: float = 0.0,
    realistic_execution: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Periodic and compounded bucket tables, with or without trading blocks."""
    merged = ic.merge_factors(factors, panel.df.select(*KEY, "close", *FLAGS))
    cross = panel.cross_section("factor_name")
    if realistic_execution:
        # costs are already in each bucket's net return
        buckets, fixed_cost = portfolio.stateful_backtest(merged, cross, bins, cost_bps), 0.0
    else:
        buckets, fixed_cost = portfolio.decile_returns(merged, cross, bins), cost_bps
    table = portfolio.bucket_table(buckets, bins, fixed_cost)
    return table, portfolio.cumulative_table(table)


def judge_newcomer(
    summary: DataFrame, baseline_daily: DataFrame, new_daily: DataFrame, top_k: int = 10, segments: int = 4
) -> DataFrame:
    """Recommendation for one new factor against the ``top_k`` of a baseline."""
    new_daily = cut_lineage(new_daily)
    top = screen.top_factors(summary, top_k).select("factor_name")
    peers = baseline_daily.join(top, "factor_name", "left_semi").select("factor_name", "date", "rank_ic")
    name = new_daily.select("factor_name").distinct()
    peers = peers.join(name, "factor_name", "left_anti")
    together = cut_lineage(peers.unionByName(new_daily.select("factor_name", "date", "rank_ic")))
    stats = (
        ic.factor_stats(new_daily)
        .join(screen.segment_stability(screen.segment_table(new_daily, segments)), "factor_name")
        .join(similarity.max_abs_corr(similarity.ic_corr_matrix(together)), "factor_name", "left")
    )
    return screen.recommend(stats)


def leaderboards(tables: Sequence[DataFrame], top: int | None = None) -> DataFrame:
    """One board from several graded summaries; later tables win per factor."""
    union = None
    for i, table in enumerate(tables):
        part = table.withColumn("_table", F.lit(i))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    return screen.leaderboard(screen.keep_last(union, "factor_name", "_table").drop("_table"), top)
