"""Evaluation of factors against forward returns.

Every function works on many factors at once: ``factor_name`` is part of each
grouping key, so a library is one job and parallelism grows with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions import timeseries as ts
from panelwright.functions.scalar import divide, is_true
from panelwright.functions.stats import centred_correlation, correlation, correlation_p_value, ratio_or, share
from panelwright.operators.crosssection import CrossSection
from panelwright.session import cut_lineage

# Smallest cross-sections that count, by kind of evaluation.
MIN_NAMES = 50
MIN_NAMES_DECAY = 30
MIN_PAIRS = 3
MIN_OVERLAP_SHARE = 0.05

FACTOR = ["factor_name"]
FACTOR_DAY = ["factor_name", "date"]


def merge_factors(factors: DataFrame, panel: DataFrame) -> DataFrame:
    """Inner join of a long factor table with panel rows; missing values drop out."""
    return factors.filter(F.col("value").isNotNull()).join(panel, ["entity", "date"], "inner")


def overlap_check(factors: DataFrame, panel: DataFrame) -> DataFrame:
    """Matched share of each factor's rows, and whether it is suspiciously low."""
    keys = panel.select("entity", "date").withColumn("_hit", F.lit(1))
    return (
        factors.filter(F.col("value").isNotNull())
        .join(keys, ["entity", "date"], "left")
        .groupBy("factor_name")
        .agg(F.count("*").alias("factor_rows"), F.count("_hit").alias("matched_rows"))
        .withColumn("overlap", divide("matched_rows", "factor_rows"))
        .withColumn("low_overlap", F.col("overlap") < MIN_OVERLAP_SHARE)
    )


def clean_returns(merged: DataFrame, next_day: bool = True, **exclusions: bool) -> DataFrame:
    """Attach ``ret`` and drop untradable rows.

    The return and the next day's flags follow the entity's own rows and are
    taken before any row is dropped: from the struct ``ahead`` where the rows carry
    one, else by a window over each factor's rows.
    """
    return marked_returns(merged, next_day, **exclusions).filter("_tradable").drop("_tradable")


def marked_returns(
    merged: DataFrame,
    next_day: bool = True,
    exclude_st: bool = True,
    exclude_limit_up: bool = True,
    exclude_limit_down: bool = True,
    exclude_suspended: bool = True,
) -> DataFrame:
    """All rows with ``ret``, and ``_tradable`` where :func:`clean_returns` keeps them."""
    w = ts.entity_window(["factor_name", "entity"])
    carried = next_day and "ahead" in merged.columns
    if carried:
        ahead = {"ret": divide("ahead.close", "close") - 1}
    else:
        ahead = {"ret": ts.forward_return("close", 1, w) if next_day else ts.same_day_return("close", w)}
    for wanted, flag, name in ((exclude_limit_up, "limit_up_flag", "_next_up"), (exclude_limit_down, "limit_down_flag", "_next_down")):
        if next_day and wanted:
            ahead[name] = F.coalesce(F.col(f"ahead.{flag}") if carried else ts.next_flag(flag, w), F.lit(False))
    rows = merged.withColumns(ahead)
    keep: Column = F.col("value").isNotNull() & F.col("ret").isNotNull()
    for peek in ("_next_up", "_next_down"):
        if peek in ahead:
            keep = keep & ~F.col(peek)
    for wanted, flag in (
        (exclude_st, "ST"),
        (exclude_limit_up, "limit_up_flag"),
        (exclude_limit_down, "limit_down_flag"),
        (exclude_suspended, "suspended"),
    ):
        if wanted:
            keep = keep & ~is_true(flag)
    return rows.withColumn("_tradable", keep).drop("_next_up", "_next_down", "ahead")


def correlations_by(
    rows: DataFrame, cross: CrossSection, x: str = "value", y: str = "ret"
) -> DataFrame:
    """Pearson and rank correlation per group of ``cross``, with the row count.

    Every row must have both values.
    """
    ranked = cross.centred_rank(cross.centred_rank(rows, x, "_rx"), y, "_ry")
    n = F.count("*")
    return (
        ranked.groupBy(*cross.keys)
        .agg(n.alias("n_stocks"), correlation(x, y).alias("ic"), centred_correlation("_rx", "_ry").alias("rank_ic"))
        .withColumn("ic", F.when(F.col("n_stocks") >= MIN_PAIRS, F.col("ic")))
        .withColumn("rank_ic", F.when(F.col("n_stocks") >= MIN_PAIRS, F.col("rank_ic")))
    )


def daily_ic(
    merged: DataFrame,
    cross: CrossSection,
    min_names: int = MIN_NAMES,
    next_day: bool = True,
    **exclusions: bool,
) -> DataFrame:
    """Daily correlation table of every factor.

    ``cross`` must be keyed by (factor_name, date).  Days with too few names or
    without both correlations are left out.
    """
    rows = clean_returns(merged, next_day=next_day, **exclusions).select(*FACTOR_DAY, "value", "ret")
    daily = correlations_by(rows, cross).filter(
        (F.col("n_stocks") >= min_names) & F.col("rank_ic").isNotNull() & F.col("ic").isNotNull()
    )
    return daily.select(
        *FACTOR_DAY,
        "ic",
        "rank_ic",
        correlation_p_value("rank_ic", "n_stocks").alias("p_value"),
        correlation_p_value("ic", "n_stocks").alias("ic_p_value"),
        "n_stocks",
    )


# --------------------------------------------------------------------------
# Summaries of a daily table


def ic_statistics(daily: DataFrame) -> DataFrame:
    """Distribution statistics of both correlations per factor."""
    columns = [F.count("*").alias("valid_days")]
    for c in ("ic", "rank_ic"):
        mean, std = F.avg(c), F.stddev_samp(c)
        columns += [
            mean.alias(f"mean_{c}"),
            std.alias(f"std_{c}"),
            F.min(c).alias(f"min_{c}"),
            F.max(c).alias(f"max_{c}"),
            ratio_or(None, mean, std).alias(f"{c}_ir"),
            share(F.col(c) > 0).alias(f"{c}_win_rate"),
            share(F.col(c) > 0.05).alias(f"{c}_above_005"),
            share(F.col(c) < -0.05).alias(f"{c}_below_005"),
        ]
    columns.append(F.avg("n_stocks").alias("mean_stocks"))
    return daily.groupBy(*FACTOR).agg(*columns)


def factor_summary(daily: DataFrame) -> DataFrame:
    """One row per factor for leaderboards; ratios are 0 where the spread is 0."""
    return daily.groupBy(*FACTOR).agg(
        F.avg("ic").alias("mean_ic"),
        F.avg("rank_ic").alias("mean_rank_ic"),
        F.stddev_samp("ic").alias("ic_std"),
        F.stddev_samp("rank_ic").alias("rank_ic_std"),
        F.avg("p_value").alias("mean_p_value"),
        F.avg("ic_p_value").alias("mean_ic_p_value"),
        ratio_or(0.0, F.avg("ic"), F.stddev_samp("ic")).alias("ic_ir"),
        ratio_or(0.0, F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("rank_ic_ir"),
        share(F.col("ic") > 0).alias("ic_win_rate"),
        share(F.col("rank_ic") > 0).alias("rank_ic_win_rate"),
        F.count("*").alias("valid_days"),
    )


def mean_std_summary(daily: DataFrame) -> DataFrame:
    return daily.groupBy(*FACTOR).agg(
        F.avg("rank_ic").alias("mean_rank_ic"),
        F.stddev_samp("rank_ic").alias("rank_ic_std"),
        F.count("*").alias("rows"),
    )


def run_metrics(daily: DataFrame) -> DataFrame:
    std = F.stddev_samp("rank_ic")
    return daily.groupBy(*FACTOR).agg(
        F.count("*").alias("rows"),
        F.avg("rank_ic").alias("mean_rank_ic"),
        std.alias("rank_ic_std"),
        ratio_or(None, F.avg("rank_ic"), std).alias("rank_ic_ir"),
        share(F.col("rank_ic") > 0).alias("rank_ic_win_rate"),
        F.avg("ic").alias("mean_ic"),
    )


def screen_metrics(daily: DataFrame) -> DataFrame:
    """Inputs of grading: every row counts as a day, a missing value as a loss."""
    any_ric = F.count("rank_ic") > 0
    return daily.groupBy(*FACTOR).agg(
        F.avg("rank_ic").alias("mean_rank_ic"),
        ratio_or(None, F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("rank_ic_ir"),
        F.when(any_ric, share(F.col("rank_ic") > 0)).alias("rank_ic_win_rate"),
        F.coalesce(F.stddev_samp("rank_ic"), F.lit(0.0)).alias("rank_ic_std"),
        F.avg("ic").alias("mean_ic"),
        ratio_or(None, F.avg("ic"), F.stddev_samp("ic")).alias("ic_ir"),
        F.count("*").alias("valid_days"),
    )


def factor_stats(daily: DataFrame) -> DataFrame:
    """Rank-correlation statistics over the days that have one."""
    known = daily.filter(F.col("rank_ic").isNotNull())
    return known.groupBy(*FACTOR).agg(
        F.avg("rank_ic").alias("mean_rank_ic"),
        F.stddev_samp("rank_ic").alias("rank_ic_std"),
        ratio_or(None, F.avg("rank_ic"), F.stddev_samp("rank_ic")).alias("rank_ic_ir"),
        share(F.col("rank_ic") > 0).alias("rank_ic_win_rate"),
        F.count("rank_ic").alias("valid_days"),
    )


def ic_t_stat(daily: DataFrame) -> DataFrame:
    n, std = F.count("rank_ic"), F.stddev_samp("rank_ic")
    return daily.groupBy(*FACTOR).agg(
        F.when((n > 1) & (std > 0), F.avg("rank_ic") / std * F.sqrt(n.cast("double")))
        .otherwise(F.lit(0.0))
        .alias("ic_t_stat"),
        n.alias("n_days"),
    )


def ic_by_year(daily: DataFrame) -> DataFrame:
    """Mean rank correlation per factor and calendar year."""
    return (
        daily.filter(F.col("rank_ic").isNotNull() & F.col("date").isNotNull())
        .groupBy(*FACTOR, F.year("date").alias("year"))
        .agg(F.avg("rank_ic").alias("mean_rank_ic"))
    )


def ic_by_year_map(daily: DataFrame) -> DataFrame:
    """The same as one map per factor; a map holds one entry per year."""
    entry = F.struct(F.col("year").cast("string").alias("key"), F.col("mean_rank_ic").alias("value"))
    return ic_by_year(daily).groupBy(*FACTOR).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_year_ic")
    )


def in_window(date, start: str | None, end: str | None) -> Column:
    """Inclusive date window; a blank side is open."""
    condition = F.lit(True)
    if start:
        condition = condition & (F.col(date) >= F.lit(start).cast("date"))
    if end:
        condition = condition & (F.col(date) <= F.lit(end).cast("date"))
    return condition


def window_mean(start: str | None, end: str | None) -> Column:
    """Mean rank correlation in a window; 0 when the window is unset or empty."""
    if not start and not end:
        return F.lit(0.0)
    return F.coalesce(F.avg(F.when(in_window("date", start, end), F.col("rank_ic"))), F.lit(0.0))


def walk_forward(
    daily: DataFrame,
    train: tuple[str | None, str | None] = (None, None),
    validation: tuple[str | None, str | None] = (None, None),
    test: tuple[str | None, str | None] = (None, None),
    recent: tuple[str | None, str | None] = (None, None),
    tail: int = 60,
) -> DataFrame:
    """Window means in one pass; without a recent window the last ``tail`` rows serve."""
    last = Window.partitionBy(*FACTOR).orderBy(F.col("date").desc())
    placed = daily.withColumn("_back", F.row_number().over(last))
    tail_mean = F.when(F.count("*") >= tail, F.avg(F.when(F.col("_back") <= tail, F.col("rank_ic"))))
    stats = placed.groupBy(*FACTOR).agg(
        window_mean(*train).alias("train_rank_ic"),
        window_mean(*validation).alias("validation_rank_ic"),
        window_mean(*test).alias("test_rank_ic"),
        window_mean(*recent).alias("_recent"),
        tail_mean.alias("_tail"),
    )
    recent_value = F.when(F.col("_recent") != 0, F.col("_recent")).otherwise(F.coalesce("_tail", F.lit(0.0)))
    return stats.withColumn("recent_rank_ic", recent_value).drop("_recent", "_tail")


# --------------------------------------------------------------------------
# Panel metrics of the factor itself


def coverage(factors: DataFrame) -> DataFrame:
    """Share of non-missing values, overall and as the mean over dates."""
    by_day = factors.groupBy(*FACTOR_DAY).agg(F.count("value").alias("_known"), F.count("*").alias("_rows"))
    return by_day.groupBy(*FACTOR).agg(
        (F.sum("_known") / F.sum("_rows")).alias("coverage"),
        F.avg(F.col("_known") / F.col("_rows")).alias("avg_cross_sectional_coverage"),
    )


def _previous_date_value(factors: DataFrame, column: str, out: str) -> DataFrame:
    """Value of the same entity on the factor's previous date, if it has one there.

    The entity's preceding row counts only when it lies on that date.  The date
    table joined for the comparison has one row per factor and date.
    """
    by_factor = Window.partitionBy("factor_name").orderBy("date")
    steps = factors.select(*FACTOR_DAY).distinct().withColumn("_prior", F.lag("date").over(by_factor))
    w = ts.entity_window(["factor_name", "entity"])
    lagged = factors.withColumns({"_last": F.lag(column).over(w), "_last_date": F.lag("date").over(w)})
    on_time = F.col("_last_date") == F.col("_prior")
    return (
        lagged.join(steps, FACTOR_DAY)
        .withColumn(out, F.when(on_time, F.col("_last")))
        .drop("_last", "_last_date", "_prior")
    )


def factor_autocorr(factors: DataFrame) -> DataFrame:
    """Mean over dates of the correlation between today's and the previous date's values."""
    x = F.col("value")
    paired = _previous_date_value(factors, "value", "_before").filter(x.isNotNull() & F.col("_before").isNotNull())
    daily = paired.groupBy(*FACTOR_DAY).agg(
        F.when(F.count("*") >= 2, correlation("value", "_before")).alias("_corr")
    )
    return daily.groupBy(*FACTOR).agg(F.avg("_corr").alias("factor_autocorr"))


def rank_turnover(factors: DataFrame, cross: CrossSection) -> DataFrame:
    """Mean over dates of the mean absolute change in percentile rank."""
    placed = cross.positions(factors, "value", "_rk_").select(*FACTOR_DAY, "entity", "_rk_lo", "_rk_hi", "_rk_n")
    daily = _moves_by_day(placed)
    return daily.groupBy(*FACTOR).agg(F.avg("_move").alias("turnover_estimate"))


def _moves_by_day(placed: DataFrame, **day: Column) -> DataFrame:
    """Per (factor, date) the mean absolute change in percentile rank since the factor's previous date, and the aggregates ``day``.

    An entity's preceding row counts only when it lies on that date.  Rows go to their
    entity with their places (:meth:`CrossSection.positions`), whole numbers that pack better than shares.
    """
    w = ts.entity_window(["factor_name", "entity"])
    twice = placed.withColumn("_twice", F.col("_rk_lo") + F.col("_rk_hi") + 1).drop("_rk_lo", "_rk_hi").repartition("factor_name", "entity")
    placed = twice.withColumn("_pct", F.col("_twice") / F.lit(2.0) / F.col("_rk_n"))
    lagged = placed.withColumns({"_last": F.lag("_pct").over(w), "_last_date": F.lag("date").over(w)})
    # By the date of an entity's last row: a factor's dates are then known without reading the rows again.
    change = F.col("_pct") - F.col("_last")
    moves = lagged.groupBy(*FACTOR_DAY, "_last_date").agg(F.sum(F.abs(change)).alias("_sum"), F.count(change).alias("_moved"), *[c.alias(n) for n, c in day.items()])
    # rows of pairs of dates, bounded by the calendar
    before = Window.partitionBy("factor_name").orderBy(F.unix_date("date")).rangeBetween(Window.unboundedPreceding, -1)
    on_time = F.col("_last_date") == F.max("date").over(before)
    paired = moves.withColumn("_move", F.when(on_time, F.try_divide("_sum", "_moved")))
    # one of a date's rows is on time at most
    return paired.groupBy(*FACTOR_DAY).agg(F.max("_move").alias("_move"), *[F.max(n).alias(n) for n in day])


def pooled_ic(rows: DataFrame, cross: CrossSection, keys: Sequence[str], x: str = "value", y: str = "ret") -> DataFrame:
    """Correlation and rank correlation over whole groups rather than dates."""
    return correlations_by(rows.select(*keys, x, y), cross.with_keys(*keys), x, y)


# --------------------------------------------------------------------------
# Decay


def ic_decay(
    merged: DataFrame,
    cross: CrossSection,
    horizons: Sequence[int] = (1, 2, 3, 5, 10, 20),
    min_names: int = MIN_NAMES_DECAY,
    apply_flags: bool = True,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Mean correlations by holding horizon.

    ``cross`` must be keyed by (factor_name, horizon, date).  All horizons come
    from one pass over the entity's rows, or from the array ``later`` where the rows
    carry one for these horizons.  ``names`` lists the factors that may occur; the
    rows are then read a second time only for those without a day at any horizon.
    """
    rows = merged
    if apply_flags:
        for flag in ("ST", "suspended", "limit_up_flag", "limit_down_flag"):
            if flag in rows.columns:
                rows = rows.filter(~is_true(flag))
    w = ts.entity_window(["factor_name", "entity"])
    carried = apply_flags and "later" in rows.columns
    rows = rows.withColumns({
        f"_r{h}": divide(F.col("later")[i]["close"], "close") - 1 if carried else ts.forward_return("close", h, w) for i, h in enumerate(horizons)})
    pairs = ", ".join(f"{h}, _r{h}" for h in horizons)
    long = rows.select(
        "factor_name", "date", "value", F.expr(f"stack({len(horizons)}, {pairs}) as (horizon, ret)")
    ).filter(F.col("value").isNotNull() & F.col("ret").isNotNull())
    daily = correlations_by(long, cross).filter(F.col("n_stocks") >= min_names)

    columns = []
    for c in ("ic", "rank_ic"):
        std = F.stddev_pop(c)
        columns += [
            F.avg(c).alias(f"mean_{c}"),
            std.alias(f"std_{c}"),
            ratio_or(None, F.avg(c), std).alias(f"{c}_ir"),
            share(F.col(c) > 0).alias(f"{c}_win_rate"),
        ]
    found = daily.groupBy("factor_name", "horizon").agg(*columns, F.count("*").alias("n_valid_days"))
    if names is None:
        present = merged.select("factor_name").distinct()
    else:
        found = cut_lineage(found)
        present = found.select("factor_name").distinct()
        absent = set(names) - {r["factor_name"] for r in present.collect()}
        if absent:
            present = present.union(merged.filter(F.col("factor_name").isin(list(absent))).select("factor_name").distinct())
    wanted = (
        present
        .withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    )
    return wanted.join(found, ["factor_name", "horizon"], "left").withColumn(
        "n_valid_days", F.coalesce("n_valid_days", F.lit(0).cast("long"))
    )


def trade_metrics(
    factors: DataFrame,
    panel: DataFrame,
    cross: CrossSection,
    summary: DataFrame,
    cost_bps: float = 10.0,
) -> DataFrame:
    """Long-short spread of the extreme tenths, after a turnover cost, and its drawdown.

    ``summary`` brings ``mean_rank_ic`` and ``turnover_estimate`` per factor; a
    negative mean flips the spread.  The forward return is the next row's change.
    """
    w = ts.entity_window()
    moves = panel.select("entity", "date", "close").withColumn("_chg", ts.same_day_return("close", w))
    returns = moves.select("entity", "date", F.lead("_chg").over(w).alias("ret_fwd"))
    rows = factors.join(returns, ["entity", "date"]).filter(F.col("value").isNotNull() & F.col("ret_fwd").isNotNull())
    masked = cross.extreme_masks(rows, "value")
    daily = (
        masked.groupBy(*FACTOR_DAY)
        .agg(
            (F.avg(F.when(F.col("is_long"), F.col("ret_fwd"))) - F.avg(F.when(F.col("is_short"), F.col("ret_fwd")))).alias("_ls")
        )
        .filter(F.col("_ls").isNotNull())
        .join(summary.select("factor_name", "mean_rank_ic", "turnover_estimate"), "factor_name")
    )
    return _spread_metrics(daily, cost_bps)


def trade_metrics_carried(merged: DataFrame, cross: CrossSection, cost_bps: float = 10.0, min_names: int = MIN_NAMES) -> DataFrame:
    """:func:`trade_metrics` with the summary of the same rows, in one pass over them.

    ``merged`` carries ``ahead`` (see :func:`clean_returns`) and ``ret_fwd``, the change to the entity's next panel row.
    Correlations, spreads and ranks come from the same cross-sections.  From there rows go to their
    entity for the turnover, with whole numbers for the rank, and the figures of a day go along on one of its rows.
    """
    known = F.col("ret_fwd").isNotNull()
    rows = marked_returns(merged).select(
        *FACTOR_DAY, "entity", "value", "ret_fwd", F.when(known, F.col("value")).alias("_fv"),
        F.when(F.col("_tradable"), F.col("value")).alias("_cv"), F.when(F.col("_tradable"), F.col("ret")).alias("_cr"))
    ranked = cross.centred_rank(cross.centred_rank(rows, "_cv", "_rx"), "_cr", "_ry")
    placed = cross.positions(cross.extreme_masks(ranked, "_fv"), "value", "_rk_")
    x, y = F.col("_rx"), F.col("_ry")
    days = cross.attach(
        placed, _one=F.min("entity"), _names=F.count("_cv"),
        _cov=F.covar_pop("_cv", "_cr"), _sx=F.stddev_pop("_cv"), _sy=F.stddev_pop("_cr"),
        _xy=F.sum(x * y), _xx=F.sum(x * x), _yy=F.sum(y * y),
        _long=F.avg(F.when(F.col("is_long"), F.col("ret_fwd"))), _short=F.avg(F.when(F.col("is_short"), F.col("ret_fwd"))),
    )
    own_ic, rank_ic = divide("_cov", F.col("_sx") * F.col("_sy")), divide("_xy", F.sqrt(F.col("_xx") * F.col("_yy")))
    counts = (F.col("_names") >= max(min_names, MIN_PAIRS)) & own_ic.isNotNull()
    one = F.col("entity") == F.col("_one")
    slim = days.select(
        *FACTOR_DAY, "entity", "_rk_lo", "_rk_hi", "_rk_n",
        F.when(one & counts, rank_ic).alias("_ric"), F.when(one, F.col("_long") - F.col("_short")).alias("_ls"))
    daily = _moves_by_day(slim, _ric=F.max("_ric"), _ls=F.max("_ls"))
    whole = Window.partitionBy("factor_name")
    rated = daily.withColumns({"mean_rank_ic": F.avg("_ric").over(whole), "turnover_estimate": F.avg("_move").over(whole)})
    # without a day that counts there is no summary
    return _spread_metrics(rated.filter(F.col("_ls").isNotNull() & F.col("mean_rank_ic").isNotNull()), cost_bps)


def _spread_metrics(daily: DataFrame, cost_bps: float) -> DataFrame:
    """Means and drawdown of the daily spreads ``_ls``, turned by ``mean_rank_ic`` and less the cost of ``turnover_estimate``."""
    cost = F.lit(cost_bps / 10000.0 * 2.0) * F.coalesce("turnover_estimate", F.lit(0.0))
    by_day = Window.partitionBy("factor_name").orderBy("date")
    curve = (
        daily.withColumn("_ls", F.when(F.col("mean_rank_ic") < 0, -F.col("_ls")).otherwise(F.col("_ls")))
        .withColumn("_net", F.col("_ls") - cost)
        .withColumn("_equity", ts.compound("_net", by_day) + 1)
        .withColumn("_dd", ts.drawdown("_equity", by_day))
    )
    return curve.groupBy(*FACTOR).agg(
        F.avg("_ls").alias("long_short_spread_return"),
        F.avg("_net").alias("cost_adjusted_long_short_return"),
        F.min("_dd").alias("max_drawdown_long_short"),
    )
