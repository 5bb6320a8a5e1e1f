"""Cross-sectional operators: edge tables, and the split form against the window form."""

import pytest
from pyspark.sql import functions as F

from panelwright.operators.crosssection import CrossSection
from panelwright.operators.screen import place

WINDOW = dict()
SPLIT = dict(spread=True, range_rows=2)

OPERATORS = {
    "rank": lambda cs, df: cs.rank(df, "x", "out"),
    "centred_rank": lambda cs, df: cs.centred_rank(df, "x", "out"),
    "zscore": lambda cs, df: cs.zscore(df, "x", "out"),
    "zscore_flat": lambda cs, df: cs.zscore(df, "x", "out", flat=0.0, tiny=1e-9),
    "winsorize": lambda cs, df: cs.winsorize(df, "x", "out", 0.1, 0.9),
    "quantile_bin": lambda cs, df: cs.quantile_bin(df, "x", "out", 4),
    "demean": lambda cs, df: cs.demean(df, "x", "out"),
    "neutralize_industry": lambda cs, df: cs.neutralize_industry(df, "x", "out"),
    "neutralize_size": lambda cs, df: cs.neutralize_size(df, "x", "out"),
    "size_residual": lambda cs, df: cs.size_residual(df, "x", "out"),
    "industry_demean": lambda cs, df: cs.industry_demean(df, "x", "out"),
    "neutralize": lambda cs, df: cs.neutralize(df, "x", "out", ["mktcap", "cross_demean", "industry"]),
}


def collected(df):
    return {
        (r["entity"], r["date"]): None if r["out"] is None else round(float(r["out"]), 9)
        for r in df.select("entity", "date", "out").collect()
    }


@pytest.mark.parametrize("name", OPERATORS)
def test_split_form_equals_window_form(small_panel, name):
    by_window = collected(OPERATORS[name](CrossSection(["date"], **WINDOW), small_panel))
    by_split = collected(OPERATORS[name](CrossSection(["date"], **SPLIT), small_panel))
    assert len(by_window) == small_panel.count()
    assert by_window == pytest.approx(by_split, nan_ok=False)
    assert any(v is not None for v in by_window.values())


def test_split_form_never_sorts_a_whole_group(small_panel):
    """Windows of the split form are keyed by value range, or run over range totals."""
    plan = CrossSection(["date"], **SPLIT).rank(small_panel, "x", "out")._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line and "rank(" in line:
            raise AssertionError(line)
    assert "_range" in plan


def table(spark, rows):
    return spark.createDataFrame(rows, "date int, entity string, x double, industry string, market_cap double")


def values(df, column="out"):
    return [r[column] for r in df.orderBy("entity").collect()]


@pytest.fixture(params=["window", "split"])
def cross(request):
    return CrossSection(["date"], **(WINDOW if request.param == "window" else SPLIT))


def test_ties_share_the_average_rank(spark, cross):
    df = table(spark, [(1, "a", 1.0, None, None), (1, "b", 1.0, None, None), (1, "c", 3.0, None, None), (1, "d", None, None, None)])
    assert values(cross.rank(df, "x", "out")) == [0.5, 0.5, 1.0, None]


def test_signed_zeros_share_a_bin(spark, cross):
    df = table(spark, [(1, e, v, None, None) for e, v in zip("abcdef", [-0.0, 0.0, -0.0, 0.0, 1.0, 2.0])])
    bins = values(cross.quantile_bin(df, "x", "out", 3))
    assert len(set(bins[:4])) == 1


def test_heavy_ties_merge_bins_and_short_days_are_skipped(spark, cross):
    df = table(spark, [(1, e, v, None, None) for e, v in zip("abcdef", [1.0, 1.0, 1.0, 1.0, 1.0, 2.0])]
               + [(2, e, 1.0 * i, None, None) for i, e in enumerate("gh")])
    assert values(cross.quantile_bin(df, "x", "out", 3)) == [0, 0, 0, 0, 0, 0, None, None]


def test_missing_industry(spark, cross):
    df = table(spark, [(1, "a", 1.0, "p", None), (1, "b", 3.0, "p", None), (1, "c", 7.0, None, None)])
    assert values(cross.neutralize_industry(df, "x", "out")) == [-1.0, 1.0, None]
    assert values(cross.industry_demean(df, "x", "out")) == [-1.0, 1.0, 7.0]


def test_size_cases(spark, cross):
    constant = table(spark, [(1, e, v, None, 5.0) for e, v in zip("abcde", [1.0, 2.0, 3.0, 4.0, 5.0])])
    assert values(cross.neutralize_size(constant, "x", "out")) == [-2.0, -1.0, 0.0, 1.0, 2.0]
    assert values(cross.size_residual(constant, "x", "out")) == [-2.0, -1.0, 0.0, 1.0, 2.0]
    four = table(spark, [(1, e, v, None, v + 1) for e, v in zip("abcd", [1.0, 2.0, 3.0, 5.0])])
    assert values(cross.size_residual(four, "x", "out")) == [1.0, 2.0, 3.0, 5.0]
    negative = table(spark, [(1, e, v, None, -5.0 if e == "a" else v + 1) for e, v in zip("abcdef", [1.0, 2.0, 3.0, 5.0, 8.0, 13.0])])
    assert values(cross.neutralize_size(negative, "x", "out"))[0] is None
    assert values(cross.size_residual(negative, "x", "out"))[0] == 1.0


def test_constant_day_has_no_score_and_no_error(spark, cross):
    df = table(spark, [(1, "a", 2.0, None, None), (1, "b", 2.0, None, None)])
    assert values(cross.zscore(df, "x", "out")) == [None, None]
    assert values(cross.zscore(df, "x", "out", flat=0.0)) == [0.0, 0.0]


def test_rank_survives_a_monotone_change(small_panel):
    cs = CrossSection(["date"], **WINDOW)
    plain = collected(cs.rank(small_panel, "x", "out"))
    cubed = collected(cs.rank(small_panel.withColumn("x", F.col("x") ** 3), "x", "out"))
    assert plain == cubed


def test_neutralised_values_have_no_group_mean_and_no_size_slope(small_panel):
    cs = CrossSection(["date"], **WINDOW)
    by_group = cs.neutralize_industry(small_panel, "x", "out").filter("out is not null").groupBy("date", "industry").agg(F.avg("out").alias("m"))
    assert by_group.agg(F.max(F.abs("m"))).first()[0] < 1e-9
    sized = cs.neutralize_size(small_panel, "x", "out").withColumn("s", F.log1p("market_cap")).filter("out is not null")
    slope = sized.groupBy("date").agg(F.covar_samp("out", "s").alias("c")).agg(F.max(F.abs("c"))).first()[0]
    assert slope < 1e-6


def test_places_without_a_size_bound(spark):
    rows = [("a", 1.0), ("b", 3.0), ("c", None), ("d", 3.0), ("e", 2.0), ("f", None)]
    df = spark.createDataFrame(rows, "factor_name string, v double")
    want = {"b": 1, "d": 2, "e": 3, "a": 4, "c": 5, "f": 6}
    got = {r["factor_name"]: r["p"] for r in place(df, "v", "factor_name", "p").collect()}
    assert got == want
