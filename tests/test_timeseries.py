"""Calendar steps, warm-up, gaps and the grid."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import timeseries as ts
from panelwright.functions.stats import correlation, correlation_p_value
from panelwright.operators.ic import in_window, window_mean
from panelwright.plans import factors as f
from panelwright.plans.factors import fld
from panelwright.sources.panel import Panel, densify

DAY = dt.date(2020, 1, 1)


def panel(spark, series):
    """``series`` maps an entity to values by day; None is a day without a row."""
    rows = [(e, DAY + dt.timedelta(days=i), float(v)) for e, vs in series.items() for i, v in enumerate(vs) if v is not None]
    return Panel(spark.createDataFrame(rows, "entity string, date date, close double"))


def by_day(df, column="v"):
    return {(r["entity"], (r["date"] - DAY).days): r[column] for r in df.collect()}


def test_grid_covers_every_day_and_keeps_values(spark):
    p = panel(spark, {"a": [1, 2, 3, 4, 5], "b": [None, 7, None, None, 9], "c": [None, None, 3, None, None]})
    full = by_day(densify(p, leading=True), "close")
    assert len(full) == 15
    assert full["b", 1] == 7 and full["b", 2] is None and full["c", 4] is None and full["c", 0] is None
    tail = by_day(densify(p), "close")
    assert len(tail) == 5 + 4 + 3


def test_calendar_lag_differs_from_row_lag(spark):
    p = panel(spark, {"a": [1, 2, 3, 4], "b": [5, None, 7, 8]})
    w = ts.entity_window()
    on_grid = by_day(densify(p).withColumn("v", ts.delay("close", 1, w)).filter("present"))
    on_rows = by_day(p.df.withColumn("v", F.lag("close").over(w)))
    assert on_grid["b", 2] is None and on_rows["b", 2] == 5
    assert on_grid["b", 3] == on_rows["b", 3] == 7


def test_rolling_needs_half_the_window(spark):
    p = panel(spark, {"a": [1, 2, 3, 4]})
    w = ts.entity_window()
    got = by_day(p.df.withColumn("v", ts.ts_mean("close", 8, w)))
    assert got["a", 2] is None and got["a", 3] == 2.5


def test_rolling_rank_is_null_when_today_is(spark):
    p = panel(spark, {"a": [3, 1, 2, None, 5], "z": [1, 1, 1, 1, 1]})
    got = by_day(densify(p).withColumn("v", ts.ts_rank("close", 4, ts.entity_window())))
    assert got["a", 3] is None
    assert got["a", 2] == pytest.approx(2 / 3)
    assert got["z", 3] == pytest.approx(2.5 / 4)


def test_zero_denominators_give_null(spark):
    p = panel(spark, {"a": [0, 1, 2, 2, 2]})
    w = ts.entity_window()
    got = by_day(p.df.withColumn("v", ts.ts_return("close", 1, w)))
    assert got["a", 1] is None and got["a", 2] == 1
    flat = by_day(p.df.withColumn("v", ts.ts_zscore("close", 3, w)))
    assert flat["a", 4] is None


def test_drawdown_peak_is_the_first_value(spark):
    p = panel(spark, {"a": [0.9, 0.8, 1.0, 0.5]})
    got = by_day(p.df.withColumn("v", ts.drawdown("close", ts.entity_window())))
    assert got["a", 0] == 0 and got["a", 1] == pytest.approx(-1 / 9) and got["a", 3] == -0.5


def test_constant_group_has_no_correlation_and_no_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(correlation("x", "y")).first()[0] is None


def test_p_values_of_few_and_very_many_pairs(spark):
    """Against Simpson's rule on Student's density, up to ten million pairs."""
    cases = [(t / (n - 2 + t * t) ** 0.5, n) for n in (5, 8, 41, 700, 5_000, 10**5, 10**6, 10**7) for t in (0.0, 0.3, 1.7, 1.75, 2.5, 6.0, -1.0)]
    got = [r[0] for r in spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, r double, n long").orderBy("i").select(correlation_p_value("r", "n")).collect()]
    weights = np.where(np.arange(200_001) % 2, 4.0, 2.0)
    weights[[0, -1]] = 1.0

    def tail(start, df):
        angle = np.linspace(np.arctan(start / df**0.5), min(np.pi / 2, np.arctan(60 / df**0.5) if df > 100 else np.pi / 2), 200_001)
        return (weights * np.exp((df - 1) * np.log(np.maximum(np.cos(angle), 1e-300)))).sum() * (angle[-1] - angle[0])

    for (r, n), p in zip(cases, got, strict=True):
        df = n - 2
        t = abs(r) * (df / (1 - r * r)) ** 0.5
        assert p == pytest.approx(tail(t, df) / tail(0.0, df), abs=1e-9), (r, n)


def test_p_values_match_numeric_integration(spark):
    import numpy as np

    cases = [(r, n) for r in (0.0, 0.05, -0.3, 0.9) for n in (3, 4, 5, 10, 51, 200, 1001)]
    df = spark.createDataFrame([(float(r), n) for r, n in cases], "r double, n int")
    got = [row[0] for row in df.select(correlation_p_value("r", "n")).collect()]
    for (r, n), p in zip(cases, got):
        nu = n - 2
        theta = np.arctan(abs(r) / np.sqrt(1 - r * r))
        grid = np.linspace(0, np.pi / 2, 400001)
        density = np.cos(grid) ** (nu - 1)
        whole = np.trapezoid(density, grid)
        tail = np.linspace(theta, np.pi / 2, 400001)
        want = np.trapezoid(np.cos(tail) ** (nu - 1), tail) / whole
        assert p == pytest.approx(want, abs=1e-8)
    odd = spark.createDataFrame([(1.0, 9), (0.5, 2), (None, 9)], "r double, n int")
    assert [row[0] for row in odd.select(correlation_p_value("r", "n")).collect()] == [None, None, None]


def test_date_windows(spark):
    rows = [(DAY + dt.timedelta(days=i), float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "date date, rank_ic double")

    def mean(start, end):
        return df.agg(window_mean(start, end)).first()[0]

    assert mean("2020-01-02", "2020-01-03") == 1.5
    assert mean(None, "2020-01-02") == 0.5 and mean("2020-01-03", "") == 2.5
    assert mean("", None) == 0.0 and mean("2021-01-01", None) == 0.0
    assert df.filter(in_window("date", None, None)).count() == 4


def test_definitions_check_their_arguments():
    with pytest.raises(ValueError):
        fld("bid_size")
    with pytest.raises(ValueError):
        f.ts_mean(fld("close"), 999)
    with pytest.raises(ValueError):
        f.ts_mean(fld("close"), 1)
    with pytest.raises(ValueError):
        f.delay(fld("close"), 2.5)
    deep = fld("close")
    with pytest.raises(ValueError):
        for _ in range(9):
            deep = f.rank(deep)
    assert f.rank(f.ts_return(fld("close"), 20)).complexity == 7


def test_nested_terms_share_work_and_cross_back(spark):
    """A time step on top of a cross-section works, and equal parts are computed once."""
    p = panel(spark, {"a": [1, 2, 3, 4, 5], "b": [5, 4, 3, 2, 1], "c": [2, 2, 2, 2, 2]})
    ranked = f.rank(fld("close"))
    wide = f.factor_wide(p, {"v": f.ts_mean(ranked, 4), "u": f.ts_mean(ranked, 4) - ranked})
    rows = {(r["entity"], (r["date"] - DAY).days): (r["v"], r["u"]) for r in wide.collect()}
    # ranks of "a" by day: 1/3, 1.5/3, 2.5/3, 1, 1
    assert rows["a", 3][0] == pytest.approx((1 / 3 + 0.5 + 2.5 / 3 + 1) / 4)
    assert rows["a", 3][1] == pytest.approx(rows["a", 3][0] - 1)
