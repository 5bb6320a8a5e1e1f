"""Work that queries share is done once, and with few shuffles."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from panelwright.operators import catalog, ic, similarity
from panelwright.operators.crosssection import CrossSection
from panelwright.plans import batch, factors, pipelines
from panelwright.sources import sinks
from panelwright.suite import base, books, evaluation, tables

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_daily_tables_shuffle_rows_twice(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = base.daily(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "Reused" not in line]
    # rows by entity and by date; bars so few that they are broadcast to the suppliers are dealt out by entity again
    assert sum("entity" in line for line in dealt) <= 2 and not any("factor_name" in line or "l_suppkey" in line for line in dealt)


def test_later_rows_are_the_same_before_and_after_cross_sections(spark):
    """Taken along with the steps along time, or on what the cross-sections leave, for factors with and without gaps."""
    panel, carry = base.weekly_panel(spark, SF), ["close", *base.FLAGS]
    late = {n: dataclasses.replace(t, keeps_nulls=False) for n, t in base.LIBRARY.items()}
    for more in ({"ahead": True}, {"horizons": (1, 3)}):
        a, b = (factors.factor_long(panel, terms, carry, **more) for terms in (base.LIBRARY, late))
        if "horizons" in more:
            a, b = (x.filter("NOT coalesce(ST, false) AND NOT coalesce(suspended, false) AND NOT coalesce(limit_up_flag, false) AND NOT coalesce(limit_down_flag, false)") for x in (a, b))
        assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_a_summary_is_worked_out_once(spark, monkeypatch):
    for df in evaluation._newcomer(spark, SF):
        assert "lineitem" not in plan_of(df) and "l_suppkey" not in plan_of(df)
    written = []
    monkeypatch.setattr(tables, "_write_summary", lambda s, df: written.append(plan_of(df)) or base.scratch(s))
    monkeypatch.setattr(tables.files, "scan_all_summaries", lambda s, paths: s.range(1))
    tables._summaries(spark, SF)
    assert len(written) == 2 and not any("l_suppkey" in p for p in written)


def test_a_bucket_table_is_worked_out_once(spark, monkeypatch, tmp_path):
    seen = []
    real = sinks.cumulative_table
    monkeypatch.setattr(sinks, "cumulative_table", lambda t: seen.append(plan_of(t)) or real(t))
    sinks.write_backtest(books._buckets(spark, SF), f"file://{tmp_path}/b", books.BINS)
    assert "l_suppkey" not in seen[0]


def test_a_batch_reads_a_stored_panel_and_factors(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pipelines, "batch_analysis", lambda panel, f, out: seen.append(plan_of(panel.df) + plan_of(f)) or spark.createDataFrame(
        [], "factor_name string, mean_rank_ic double, rank_ic_ir double, valid_days long, quality_score int, grade string"))
    evaluation._batch(spark, SF)
    assert len(seen) == 2 and not any("l_suppkey" in p or "Window" in p for p in seen)


def test_one_bad_factor_costs_no_second_evaluation(spark, monkeypatch, tmp_path):
    rows = [(f"e{i}", 1 + d, 10.0 + (i * 7 + d * d) % 11) for i in range(8) for d in range(4)]
    df = spark.createDataFrame(rows, "entity string, d int, close double").select(
        "entity", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("date"), "close", *[F.lit(None).cast("boolean").alias(c) for c in base.FLAGS])
    value = df.select("entity", "date", F.col("close").alias("value"))
    bad = value.withColumn("value", F.when(F.col("entity") == "e3", "high").otherwise("1"))
    calls = []
    real = ic.daily_ic
    monkeypatch.setattr(batch.ic, "daily_ic", lambda *a, **k: calls.append(1) or real(*a, **k))
    got = batch.run_batch(batch.Panel(df), {"a": lambda s: value, "bad": lambda s: bad, "b": lambda s: value}, f"file://{tmp_path}/r", min_names=3)
    assert {r["factor_name"] for r in got.filter("error IS NULL").collect()} == {"a", "b"} and len(calls) == 1


def test_series_of_different_keys_are_ranked_as_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_meetings", lambda *a: pytest.fail("ranked for whole classes"))
    rows = [(f"f{k}", f"e{i}", float((i * (7 + k)) % 13)) for k in range(3) for i in range(30 - k)]
    df = spark.createDataFrame(rows, "factor_name string, entity string, value double").withColumn("date", F.lit("2020-01-01").cast("date"))
    got = {(r["left"], r["right"]): (r["n"], r["similarity"]) for r in similarity.value_similarity(df, 2).collect()}
    p = df.toPandas().pivot(index="entity", columns="factor_name", values="value")
    for a, b in (("f0", "f1"), ("f0", "f2"), ("f1", "f2")):
        both = p[[a, b]].dropna().rank()
        assert got[a, b][0] == len(both) and got[a, b][1] == pytest.approx(abs(both[a].corr(both[b])), abs=1e-12)


def test_pooled_correlations_carry_only_what_they_need(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ic, "correlations_by", lambda rows, *a: seen.append(rows.columns))
    rows = spark.createDataFrame([("f", "s", "e", 1.0, 2.0)], "factor_name string, split string, entity string, value double, ret double")
    ic.pooled_ic(rows, CrossSection(["factor_name"], spread=True), ["factor_name", "split"])
    assert seen == [["factor_name", "split", "value", "ret"]]


def test_wide_audit_equals_the_long_one(spark):
    rows = [("a", 1, 1.0, None, 2.0), ("a", 2, 2.0, 5.0, None), ("b", 1, None, 1.0, 1.0)]
    cut = [("a", 1, 1.0, None, 2.5), ("b", 1, None, 1.0, 1.0), ("c", 1, 3.0, None, None)]
    wide, short = (spark.createDataFrame(r, "entity string, d int, x double, y double, z double").select(
        "entity", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("date"), "x", "y", "z") for r in (rows, cut))
    last = F.lit("2020-01-02").cast("date")
    long = catalog.lookahead_audit(*(factors.to_long(df, ["x", "y", "z"], ["entity", "date"]) for df in (wide, short)), last)
    got = catalog.lookahead_audit_wide(wide, short, ["x", "y", "z"], last)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, long.collect()))


def test_trade_metrics_read_the_lines_once_for_prices(spark):
    plan = evaluation._trade(spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("== Initial Plan ==")[-1].splitlines() if "FileScan" in line and "l_extendedprice" in line]
    assert len(scans) == 1


@pytest.mark.parametrize("least", [30, 1000])
def test_trade_metrics_in_one_pass_equal_those_from_a_summary(spark, least):
    """With gaps, ties and days of few names; where no day has enough names there is no factor."""
    panel, cross = base.weekly_panel(spark, SF.replace("0.001", "0.01")), CrossSection(["factor_name", "date"])
    panel = factors.Panel(panel.df.filter("pmod(xxhash64(entity, date), 5) <> 0").withColumn("close", F.round("close", -2)).cache())
    merged = factors.factor_long(panel, base.LIBRARY, ["close", *base.FLAGS], ahead=True)
    values = merged.select("factor_name", "entity", "date", "value")
    summary = ic.factor_summary(ic.daily_ic(merged, cross, least)).join(ic.rank_turnover(values, cross), "factor_name")
    want = {r["factor_name"]: r for r in ic.trade_metrics(values, panel.df, cross, summary).collect()}
    moved = factors.Panel(panel.df.withColumn("ret_fwd", ic.ts.forward_return("close", 1, ic.ts.entity_window())))
    carried = factors.factor_long(moved, base.LIBRARY, ["close", *base.FLAGS, "ret_fwd"], ahead=True)
    got = {r["factor_name"]: r for r in ic.trade_metrics_carried(carried, cross, min_names=least).collect()}
    assert set(got) == set(want) and len(want) == (4 if least == 30 else 0)
    for name, row in want.items():
        assert list(got[name])[1:] == pytest.approx(list(row)[1:], rel=1e-9)
