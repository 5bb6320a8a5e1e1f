"""Quantile portfolios: fixed membership, and holdings under trading blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions import timeseries as ts
from panelwright.functions.scalar import divide, is_true
from panelwright.operators.crosssection import CrossSection
from panelwright.operators.ic import FACTOR, FACTOR_DAY, clean_returns

# Fixed value: periods per year used when annualising.
PERIODS_PER_YEAR = 252


def decile_returns(merged: DataFrame, cross: CrossSection, bins: int = 10, next_day: bool = True, **exclusions: bool) -> DataFrame:
    """Equal-weight mean return per (factor, date, bucket); buckets count from 1."""
    rows = clean_returns(merged, next_day=next_day, **exclusions).select(*FACTOR_DAY, "value", "ret")
    binned = cross.quantile_bin(rows, "value", "bucket", bins).filter(F.col("bucket").isNotNull())
    return (
        binned.withColumn("bucket", F.col("bucket") + 1)
        .groupBy(*FACTOR_DAY, "bucket")
        .agg(F.avg("ret").alias("ret"), F.count("*").alias("n_names"))
    )


def bucket_table(bucket_returns: DataFrame, bins: int = 10, cost_bps: float = 0.0) -> DataFrame:
    """Wide table Q1..Qn and LS, the top minus the bottom bucket after a fixed cost."""
    wide = bucket_returns.groupBy(*FACTOR_DAY).pivot("bucket", list(range(1, bins + 1))).agg(F.first("ret"))
    named = wide.select(*FACTOR_DAY, *[F.col(str(b)).alias(f"Q{b}") for b in range(1, bins + 1)])
    return named.withColumn("LS", F.col(f"Q{bins}") - F.col("Q1") - F.lit(2.0 * cost_bps / 10000.0))


def series_columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in FACTOR_DAY]


def cumulative_table(table: DataFrame) -> DataFrame:
    """Compounded version of a wide bucket table, one factor per partition."""
    w = Window.partitionBy(*FACTOR).orderBy("date")
    return table.select(*FACTOR_DAY, *[ts.compound(c, w).alias(c) for c in series_columns(table)])


def terminal_returns(cumulative: DataFrame) -> DataFrame:
    """Last compounded value of every bucket and the number of days."""
    return cumulative.groupBy(*FACTOR).agg(
        F.count("*").alias("valid_days"),
        *[F.max_by(c, "date").alias(c) for c in series_columns(cumulative)],
    )


def align_ffill(series: DataFrame, values: Sequence[str]) -> DataFrame:
    """Put all factors on the union of dates, repeating each factor's last row.

    A factor's row is spread over the calendar up to its next row, so its missing
    values stay missing and dates before its first row stay empty.
    """
    from panelwright.sources.panel import calendar

    days = F.broadcast(calendar(series))
    by_factor = Window.partitionBy(*FACTOR).orderBy("position")
    first = F.lag("position").over(by_factor).isNull()
    stop = F.coalesce(F.lead("position").over(by_factor) - 1, F.col("last_position"))
    spread = (
        series.join(days, "date")
        .withColumn("_start", F.when(first, F.lit(1)).otherwise(F.col("position")))
        .withColumn("_stop", stop)
        .withColumn("_step", F.explode(F.sequence("_start", "_stop")))
    )
    back = F.broadcast(calendar(series).select(F.col("date").alias("_grid"), F.col("position").alias("_step")))
    started = F.col("_step") >= F.col("position")
    return spread.join(back, "_step").select(
        "factor_name", F.col("_grid").alias("date"), *[F.when(started, F.col(v)).alias(v) for v in values]
    )


# --------------------------------------------------------------------------
# Holdings under trading blocks


def blocked(df: DataFrame, *flags: str) -> Column:
    """True where any flag is explicitly set; an absent column never blocks."""
    out = F.lit(False)
    for flag in flags:
        if flag in df.columns:
            out = out | is_true(flag)
    return out


def stateful_backtest(
    merged: DataFrame,
    cross: CrossSection,
    bins: int = 10,
    cost_bps: float = 0.0,
    exclude_st: bool = True,
) -> DataFrame:
    """Net return of long-only buckets whose trades can be blocked.

    A name enters a bucket when it is a target and can be bought, leaves when it
    is no target and can be sold, and otherwise stays as it was.  Names do not
    interact, so each (bucket, name) is a chain of set and reset signals, and a
    holding is the stretch between a set and the next reset.  Held names without
    a row that day weigh in with return 0.
    """
    rows = clean_returns(
        merged, exclude_st=exclude_st, exclude_limit_up=False, exclude_limit_down=False, exclude_suspended=False
    )
    rows = rows.select(
        *FACTOR_DAY, "entity", "value", "ret",
        (~blocked(rows, "limit_up_flag", "suspended")).alias("_buy"),
        (~blocked(rows, "limit_down_flag", "suspended")).alias("_sell"),
    )
    binned = cross.quantile_bin(rows, "value", "_own", bins).filter(F.col("_own").isNotNull()).drop("value")
    # which buckets exist that day: a set of at most ``bins`` numbers
    binned = cross.attach(binned, _open=F.collect_set("_own"))

    numbers = range(bins)
    chain = Window.partitionBy("factor_name", "entity").orderBy("date")

    def signal(b: int) -> Column:
        exists = F.array_contains("_open", F.lit(b))
        target = F.col("_own") == b
        return F.when(exists & target & F.col("_buy"), F.lit(1)).when(exists & ~target & F.col("_sell"), F.lit(0))

    held = binned.select(
        *FACTOR_DAY, "ret", "entity", "_open",
        *[F.coalesce(F.last(signal(b), ignorenulls=True).over(chain), F.lit(0)).alias(f"_h{b}") for b in numbers],
    )
    stepped = held.select(
        "*", *[F.coalesce(F.lag(f"_h{b}").over(chain), F.lit(0)).alias(f"_w{b}") for b in numbers]
    )

    # A held name that is absent keeps its state, so the number held is a running
    # sum of entries and exits, and both happen only where the name has a row.
    sums = [F.first("_open").alias("_open")]
    for b in numbers:
        now, before = F.col(f"_h{b}"), F.col(f"_w{b}")
        sums += [
            F.sum(F.when((now == 1) & (before == 0), 1).otherwise(0)).alias(f"_in{b}"),
            F.sum(F.when((now == 0) & (before == 1), 1).otherwise(0)).alias(f"_out{b}"),
            F.sum(F.when(now == 1, F.col("ret")).otherwise(F.lit(0.0))).alias(f"_gain{b}"),
        ]
    by_day = stepped.groupBy(*FACTOR_DAY).agg(*sums)
    parts = ", ".join(f"{b}, _in{b}, _out{b}, _gain{b}" for b in numbers)
    daily = by_day.select(
        *FACTOR_DAY, "_open", F.expr(f"stack({bins}, {parts}) as (_b, _in, _out, _gain)")
    ).filter(F.array_contains("_open", F.col("_b")))

    order = Window.partitionBy("factor_name", "_b").orderBy("date")
    counted = daily.withColumn("_n", F.sum(F.col("_in") - F.col("_out")).over(order)).withColumn(
        "_n_before", F.coalesce(F.lag("_n").over(order), F.lit(0))
    )
    zero = F.lit(0.0)
    weight = F.coalesce(divide(F.lit(1.0), "_n"), zero)
    weight_before = F.coalesce(divide(F.lit(1.0), "_n_before"), zero)
    turnover = F.lit(0.5) * (
        F.col("_in") * weight
        + F.col("_out") * weight_before
        + (F.col("_n") - F.col("_in")) * F.abs(weight - weight_before)
    )
    net = F.col("_gain") * weight - turnover * F.lit(cost_bps / 10000.0)
    return counted.select(
        *FACTOR_DAY,
        (F.col("_b") + 1).alias("bucket"),
        net.alias("ret"),
        F.col("_n").cast("long").alias("n_held"),
        turnover.alias("turnover"),
    )


# --------------------------------------------------------------------------
# Statistics of one return series


def portfolio_stats(series: DataFrame, keys: Sequence[str], ret: str = "ret", date: str = "date") -> DataFrame:
    """Total and annualised return, Sharpe ratio and worst drawdown per series."""
    w = Window.partitionBy(*keys).orderBy(date)
    curve = (
        series.filter(F.col(ret).isNotNull())
        .withColumn("_equity", ts.compound(ret, w) + 1)
        .withColumn("_dd", ts.drawdown("_equity", w))
    )
    n, std = F.count("*"), F.stddev_pop(ret)
    total = F.max_by("_equity", date) - 1
    return curve.groupBy(*keys).agg(
        n.alias("n_days"),
        total.alias("total_return"),
        (F.pow(total + 1, F.lit(float(PERIODS_PER_YEAR)) / n) - 1).alias("annualized_return"),
        F.when(std > 0, F.avg(ret) / std * F.sqrt(F.lit(float(PERIODS_PER_YEAR)))).otherwise(F.lit(0.0)).alias("sharpe_ratio"),
        F.min("_dd").alias("max_drawdown"),
    )
