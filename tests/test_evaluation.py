"""Evaluation: flags, minimum counts, decay, holdings and similarity against plain folds."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import ic, portfolio, screen, similarity
from panelwright.operators.crosssection import CrossSection

DAY = dt.date(2020, 1, 1)
MERGED = ("factor_name string, entity string, date date, value double, close double, ST boolean, "
          "limit_up_flag boolean, limit_down_flag boolean, suspended boolean")
DAILY = CrossSection(["factor_name", "date"])


def day(i):
    return DAY + dt.timedelta(days=i)


def row(e, i, value, close, st=False, up=None, down=None, susp=False, name="f"):
    return (name, e, day(i), value, close, st, up, down, susp)


def test_three_valued_flags(spark):
    rows = []
    for e, flag in (("true", True), ("false", False), ("null", None)):
        rows += [row(e, 0, 1.0, 1.0, up=flag), row(e, 1, 1.0, 2.0)]
    kept = {r["entity"] for r in ic.clean_returns(spark.createDataFrame(rows, MERGED)).collect()}
    assert kept == {"false", "null"}


def test_limit_on_the_return_day_drops_the_signal_day(spark):
    rows = [row("a", 0, 1.0, 1.0), row("a", 1, 1.0, 2.0, up=True), row("a", 2, 1.0, 3.0)]
    rows += [row("b", 0, 1.0, 1.0), row("b", 1, 1.0, 2.0, st=True), row("b", 2, 1.0, 3.0)]
    kept = {(r["entity"], (r["date"] - DAY).days) for r in ic.clean_returns(spark.createDataFrame(rows, MERGED)).collect()}
    assert kept == {("b", 0)}


def test_returns_step_along_the_factors_own_rows(spark):
    rows = [row("a", 0, 1.0, 1.0), row("a", 5, 1.0, 3.0)]
    got = ic.clean_returns(spark.createDataFrame(rows, MERGED)).collect()
    assert [(r["date"], r["ret"]) for r in got] == [(DAY, 2.0)]


def test_days_below_the_minimum_and_constant_days_are_absent(spark):
    rows = []
    for n, i in ((49, 0), (50, 2), (60, 4)):
        for k in range(n):
            value = 1.0 if i == 4 else float(k)
            name = f"e{i}_{k}"
            rows += [row(name, i, value, 1.0), row(name, i + 1, None, 1.0 + (k * 7 % 5))]
    # the second row only brings the next price
    merged = spark.createDataFrame(rows, MERGED)
    daily = ic.daily_ic(merged, DAILY)
    assert [r["date"] for r in daily.collect()] == [day(2)]


def test_rank_ic_flips_with_the_factor(spark):
    rng = random.Random(5)
    rows = [row(f"e{k}", i, rng.random(), 1 + rng.random()) for k in range(60) for i in range(4)]
    merged = spark.createDataFrame(rows, MERGED)
    plus = {r["date"]: r["rank_ic"] for r in ic.daily_ic(merged, DAILY).collect()}
    minus = {r["date"]: r["rank_ic"] for r in ic.daily_ic(merged.withColumn("value", -F.col("value")), DAILY).collect()}
    assert len(plus) == 3 and all(plus[d] == pytest.approx(-minus[d]) for d in plus)


def test_rank_ic_equals_pandas(spark):
    rng = random.Random(6)
    rows = [row(f"e{k}", i, float(rng.randint(0, 9)), float(rng.randint(1, 5))) for k in range(70) for i in range(3)]
    got = {r["date"]: r for r in ic.daily_ic(spark.createDataFrame(rows, MERGED), DAILY).collect()}
    p = pd.DataFrame(rows, columns=[c.split()[0] for c in MERGED.split(", ")]).sort_values(["entity", "date"])
    p["ret"] = p.groupby("entity")["close"].shift(-1) / p["close"] - 1
    for d, g in p.dropna(subset=["ret"]).groupby("date"):
        assert got[d]["ic"] == pytest.approx(g["value"].corr(g["ret"]))
        assert got[d]["rank_ic"] == pytest.approx(g["value"].rank().corr(g["ret"].rank()))


# -- holdings ----------------------------------------------------------------


def fold_holdings(p: pd.DataFrame, bins: int, bps: float):
    """One date after another, as a plain loop."""
    held = {b: set() for b in range(1, bins + 1)}
    out = {}
    for d, g in p.groupby("date", sort=True):
        if len(g) < bins:
            continue
        x = np.sort(g["value"].to_numpy() + 0.0)
        n = len(x)
        edges = []
        for k in range(bins + 1):
            at, rest = divmod(k * (n - 1), bins)
            edges.append(x[at] + ((x[at + 1] - x[at]) * rest / bins if rest else 0.0))
        edges = sorted(set(edges))
        own = {r.entity: max(sum(e < r.value for e in edges), 1) for r in g.itertuples()}
        by_name = {r.entity: r for r in g.itertuples()}
        for b in sorted(set(own.values())):
            before = held[b]
            target = {e for e, k in own.items() if k == b}
            stay = {e for e in before if e in target or e not in by_name or not by_name[e].can_sell}
            now = stay | {e for e in target if by_name[e].can_buy}
            w1, w0 = (1 / len(now) if now else 0.0), (1 / len(before) if before else 0.0)
            turn = 0.5 * sum(abs((w1 if e in now else 0) - (w0 if e in before else 0)) for e in now | before)
            gain = sum(by_name[e].ret * w1 for e in now if e in by_name)
            out[d, b] = gain - turn * bps / 1e4
            held[b] = now
    return out


def test_holdings_equal_a_sequential_fold(spark):
    rng = random.Random(11)
    rows = []
    for k in range(12):
        price = 10.0
        for i in range(40):
            if rng.random() < 0.15:
                continue
            price *= 1 + rng.uniform(-0.1, 0.1)
            value = float(rng.randint(0, 5)) if i % 9 else 1.0
            rows.append(row(f"e{k}", i, value, price, st=rng.random() < 0.05,
                            up=rng.choice([True, False, False, None]), down=rng.choice([True, False, None]), susp=rng.random() < 0.1))
    merged = spark.createDataFrame(rows, MERGED)
    got = {(r["date"], r["bucket"]): r["ret"] for r in portfolio.stateful_backtest(merged, DAILY, 3, cost_bps=10.0).collect()}
    p = pd.DataFrame(rows, columns=["factor_name", "entity", "date", "value", "close", "ST", "up", "down", "susp"]).sort_values(["entity", "date"])
    p["ret"] = p.groupby("entity")["close"].shift(-1) / p["close"] - 1
    p = p[~p["ST"]].dropna(subset=["ret"])
    p["can_buy"] = ~((p["up"] == True) | p["susp"])  # noqa: E712
    p["can_sell"] = ~((p["down"] == True) | p["susp"])  # noqa: E712
    want = fold_holdings(p, 3, 10.0)
    assert len(want) > 60 and set(got) == set(want)
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-12)


# -- similarity --------------------------------------------------------------


@pytest.mark.parametrize("bound", [1000, 10**12])
def test_rank_correlation_of_every_pair(spark, bound):
    """Series with equal, nested and overlapping keys, ties and a constant."""
    rng = random.Random(3)
    supports = {"a": range(60), "b": range(60), "c": range(10, 60), "d": range(30), "e": range(25, 60), "g": range(60)}
    rows = [(n, day(i), 1.0 if n == "g" else float(rng.randint(0, 12))) for n, s in supports.items() for i in s]
    df = spark.createDataFrame(rows, "factor_name string, date date, rank_ic double")
    got = {(r["left"], r["right"]): (r["n"], r["corr"]) for r in similarity.rank_correlations(df, "factor_name", ["date"], "rank_ic", bound).collect()}
    wide = pd.DataFrame(rows, columns=["f", "d", "v"]).pivot(index="d", columns="f", values="v")
    names = sorted(supports)
    assert len(got) == len(names) * (len(names) - 1) // 2
    for i, x in enumerate(names):
        for y in names[i + 1:]:
            both = wide[[x, y]].dropna().rank()
            n, corr = got[x, y]
            assert n == len(both)
            if "g" in (x, y):
                assert corr is None
            else:
                assert corr == pytest.approx(both[x].corr(both[y]), abs=1e-12)


def test_blocks_of_a_large_class_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"s{k}", day(i), rng.random()) for k in range(7) for i in range(20)]
    df = spark.createDataFrame(rows, "factor_name string, date date, rank_ic double")

    def run():
        return {(r["left"], r["right"]): round(r["corr"], 12) for r in similarity.rank_correlations(df, "factor_name", ["date"], "rank_ic", 100).collect()}

    whole = run()
    monkeypatch.setattr(similarity, "BLOCK", 3)
    assert run() == whole and len(whole) == 21


def test_sampling_is_repeatable_and_exact(spark):
    df = spark.range(1000).select(F.lit("f").alias("factor_name"), F.col("id").alias("entity"), F.lit(1).alias("date"))
    for spread in (False, True):
        cs = CrossSection(["factor_name"], spread=spread)
        a = {r["entity"] for r in similarity.sample_rows(df, cs, 100, 7, ["entity", "date"]).collect()}
        b = {r["entity"] for r in similarity.sample_rows(df.repartition(3), cs, 100, 7, ["entity", "date"]).collect()}
        assert len(a) == 100 and a == b


# -- grading -----------------------------------------------------------------


def test_negative_factor_passes_the_win_rate_upside_down(spark):
    rows = [("n", -0.03, -0.5, 0.45, 200, None), ("p", 0.03, 0.5, 0.45, 200, 0.3), ("m", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "factor_name string, mean_rank_ic double, rank_ic_ir double, rank_ic_win_rate double, valid_days long, ic_ir double")
    got = {r["factor_name"]: (r["quality_score"], r["grade"], r["failed_criteria"]) for r in screen.grade(df).collect()}
    assert got["n"] == (3, "B", "rank_ic_ir, ic_ir")
    assert got["p"] == (4, "A", "rank_ic_win_rate")
    assert got["m"][:2] == (0, "F")


def test_half_life_is_the_first_weak_horizon(spark):
    rows = [("late", 1, 0.01), ("late", 5, 0.05), ("late", 10, 0.04), ("none", 1, None), ("none", 5, None),
            ("flat", 1, 0.05), ("flat", 5, -0.05), ("b", 1, 0.1), ("b", 5, 0.01)]
    df = spark.createDataFrame(rows, "factor_name string, horizon int, mean_rank_ic double")
    got = {r["factor_name"]: (r["decay_grade"], r["half_life"]) for r in screen.decay_grade(df).collect()}
    assert got == {"late": ("D", 1), "none": ("F", None), "flat": ("A", None), "b": ("B", 5)}


def test_empty_horizon_keeps_a_row(spark):
    rng = random.Random(1)
    rows = [row(f"e{k}", i, rng.random(), 1 + rng.random()) for k in range(40) for i in range(3)]
    cross = CrossSection(["factor_name", "horizon", "date"])
    got = {r["horizon"]: r["n_valid_days"] for r in ic.ic_decay(spark.createDataFrame(rows, MERGED), cross, [1, 2, 9]).collect()}
    assert got == {1: 2, 2: 1, 9: 0}


@pytest.mark.parametrize("n,k", [(7, 4), (8, 4), (100, 4), (103, 5), (3, 4), (2, 2), (41, 3)])
def test_segments_match_quantile_cut(spark, n, k):
    df = spark.createDataFrame([("f", day(i), 0.1 * i) for i in range(n)], "factor_name string, date date, rank_ic double")
    got = {r["segment"]: r["n_days"] for r in screen.segment_table(df, k).collect()}
    want = pd.Series(pd.qcut(np.arange(n), q=min(max(2, k), n), labels=False, duplicates="drop") + 1).value_counts().to_dict()
    assert got == want


def test_feature_rows_are_those_of_the_pivot_without_gathering_rows(spark):
    from panelwright.operators import composite
    from panelwright.plans.factors import to_long
    from panelwright.suite.base import LIBRARY, library_wide
    from panelwright.suite.learning import _features
    from panelwright.suite.tables import _drop_all_null

    sf, names = "/root/testdata/sf0.001", list(LIBRARY)
    wide = library_wide(spark, sf, carry=["close"]).cache()
    want = composite.feature_matrix(to_long(wide, names, ["entity", "date"]), composite.forward_returns(wide), names)
    got = _features(spark, sf)
    assert got.columns == want.columns and got.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    for df in (got, _drop_all_null(spark, sf)):
        assert "pivotfirst" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_rank_turnover_reads_its_rows_once(spark):
    from panelwright.operators import ic
    from panelwright.operators.crosssection import CrossSection

    rows = [("f", e, f"2024-01-0{d}", float(v)) for e, d, v in [("a", 1, 1), ("b", 1, 2), ("a", 3, 5), ("b", 3, 4), ("c", 3, 6), ("a", 4, 1), ("c", 4, 2)]]
    # entity b skips the date before its last row, and g has one date only
    rows += [("f", "b", "2024-01-06", 9.0), ("g", "a", "2024-01-01", 1.0)]
    df = spark.createDataFrame(rows, "factor_name string, entity string, date string, value double").withColumn("date", F.col("date").cast("date"))
    out = ic.rank_turnover(df, CrossSection(["factor_name", "date"]))
    got = {r["factor_name"]: r["turnover_estimate"] for r in out.collect()}
    moves = [(abs(2 / 3 - 1 / 2) + abs(1 / 3 - 1)) / 2, (abs(1 / 2 - 2 / 3) + abs(1 - 1)) / 2]
    assert got["g"] is None and got["f"] == pytest.approx(sum(moves) / 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
