"""Per-entity window expressions.

Two lags exist and differ on a panel with gaps.  Factor operators step along the
*calendar*: run them on a densified panel.  Evaluation steps along the entity's
*own rows*: run the same builders on the panel as it is.  One entity has at most
one row per date, so a partition never exceeds the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec, functions as F

from panelwright.functions.scalar import col, divide, is_true

# Fixed value: longest look-back a factor definition may use.
MAX_WINDOW = 252


def entity_window(entity: str | Sequence[str] = "entity", date: str = "date") -> WindowSpec:
    keys = [entity] if isinstance(entity, str) else list(entity)
    return Window.partitionBy(*keys).orderBy(date)


def check_window(n: int, smallest: int = 1) -> int:
    if isinstance(n, bool) or not isinstance(n, int):
        raise ValueError(f"window must be a whole number, got {n!r}")
    if not smallest <= n <= MAX_WINDOW:
        raise ValueError(f"window {n} outside [{smallest}, {MAX_WINDOW}]")
    return n


def min_observations(n: int) -> int:
    """Observations a rolling statistic of width ``n`` needs."""
    return max(2, n // 2)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def delay(x, n: int, w: WindowSpec) -> Column:
    return F.lag(col(x), check_window(n)).over(w)


def delta(x, n: int, w: WindowSpec) -> Column:
    return col(x) - delay(x, n, w)


def ts_return(x, n: int, w: WindowSpec) -> Column:
    return divide(x, delay(x, n, w)) - 1


def ts_mean(x, n: int, w: WindowSpec) -> Column:
    frame = trailing(w, check_window(n, 2))
    x = col(x)
    return F.when(F.count(x).over(frame) >= min_observations(n), F.avg(x).over(frame))


def ts_std(x, n: int, w: WindowSpec, min_count: int | None = None) -> Column:
    frame = trailing(w, check_window(n, 2))
    x = col(x)
    need = min_observations(n) if min_count is None else min_count
    return F.when(F.count(x).over(frame) >= need, F.stddev_samp(x).over(frame))


def ts_zscore(x, n: int, w: WindowSpec) -> Column:
    return divide(col(x) - ts_mean(x, n, w), ts_std(x, n, w))


def ts_rank(x, n: int, w: WindowSpec) -> Column:
    """Percentile rank (average ties) of today's value within its own window."""
    frame = trailing(w, check_window(n, 2))
    x = col(x)
    values = F.collect_list(x).over(frame)
    below = F.size(F.filter(values, lambda v: v < x))
    equal = F.size(F.filter(values, lambda v: v == x))
    return F.when(
        x.isNotNull() & (F.size(values) >= min_observations(n)),
        (below + (equal + 1) / F.lit(2.0)) / F.size(values),
    )


def ts_corr(x, y, n: int, w: WindowSpec) -> Column:
    """Rolling Pearson correlation over the pairwise complete rows."""
    frame = trailing(w, check_window(n, 2))
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.when(
        F.count(px).over(frame) >= min_observations(n),
        divide(F.covar_samp(px, py).over(frame), F.stddev_samp(px).over(frame) * F.stddev_samp(py).over(frame)),
    )


def forward_return(price, h: int, w: WindowSpec) -> Column:
    return divide(F.lead(col(price), h).over(w), price) - 1


def same_day_return(price, w: WindowSpec) -> Column:
    return divide(price, F.lag(col(price), 1).over(w)) - 1


def next_flag(flag, w: WindowSpec) -> Column:
    return F.lead(is_true(flag), 1).over(w)


def compound(returns, w: WindowSpec) -> Column:
    """Running compounded return; a missing return counts as zero."""
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.product(F.lit(1.0) + F.coalesce(col(returns), F.lit(0.0))).over(frame) - 1


def drawdown(equity, w: WindowSpec) -> Column:
    """Equity against its running peak; the peak starts at the first value."""
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    return divide(equity, F.max(col(equity)).over(frame)) - 1
