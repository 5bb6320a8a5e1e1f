"""Batches: failures stay with their factor, nothing is done twice, broken runs can be repeated."""

import pytest
from pyspark.sql import functions as F

from panelwright.plans import batch
from panelwright.sources.panel import Panel


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(f"e{i}", 1 + d, 10.0 + (i * 7 + d * d * (i % 3)) % 11) for i in range(12) for d in range(8)]
    df = spark.createDataFrame(rows, "entity string, d int, close double").select(
        "entity", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("date"), "close",
        *[F.lit(None).cast("boolean").alias(c) for c in ("ST", "limit_up_flag", "limit_down_flag", "suspended")])
    return Panel(df.cache())


def good(shift):
    return lambda spark: spark.range(12).select(
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity"), F.explode(F.sequence(F.lit("2020-01-02").cast("date"), F.lit("2020-01-09").cast("date"))).alias("date"),
        F.pmod(F.col("id") * 5 + shift, F.lit(7)).cast("double").alias("value"))


def raises(spark):
    raise ValueError("no such source\nand more")


def bad_number(spark):
    return good(1)(spark).withColumn("value", F.when(F.col("entity") == "e3", F.lit("high")).otherwise(F.lit("1")))


def two_columns(spark):
    return good(1)(spark).withColumn("other", F.lit(1.0))


def test_failures_stay_with_their_factor(spark, panel, tmp_path):
    out = f"file://{tmp_path}/run"
    sources = {"a": good(0), "b": good(2), "c": good(3), "raises": raises, "bad_number": bad_number, "two_columns": two_columns,
               "constant": lambda s: good(0)(s).withColumn("value", F.lit(1.0)), "strange": lambda s: good(0)(s).drop("date")}
    got = {r["factor_name"]: r for r in batch.run_batch(panel, sources, out, min_names=5).collect()}
    assert set(got) == set(sources) and {n for n, r in got.items() if r["error"] is None} == {"a", "b", "c"}
    assert got["raises"]["error"] == "ValueError: no such source"
    assert "CAST_INVALID_INPUT" in got["bad_number"]["error"] and "one value column" in got["two_columns"]["error"]
    assert got["constant"]["error"] == batch.NO_DAYS and all(r["elapsed_sec"] > 0 for r in got.values())
    assert all(got[n]["valid_days"] > 0 and got[n]["matched_rows"] >= 5 * got[n]["valid_days"] for n in "abc")
    alone = f"file://{tmp_path}/alone"
    batch.run_batch(panel, {"a": good(0)}, alone, min_names=5)
    rows = lambda p: sorted(map(tuple, batch.daily_results(spark, p).filter("factor_name = 'a'").select("date", "ic", "rank_ic").collect()))
    assert rows(out) == rows(alone)
    summary = {r["factor_name"]: r for r in batch.batch_summary(spark, out).collect()}
    assert len(summary) == len(sources) and summary["a"]["mean_rank_ic"] is not None and summary["constant"]["mean_rank_ic"] is None


def test_a_second_run_calls_nothing_and_failures_can_be_retried(spark, panel, tmp_path):
    out = f"file://{tmp_path}/run"
    calls = []

    def counted(name, source):
        return lambda s: calls.append(name) or source(s)

    batch.run_batch(panel, {"a": counted("a", good(0)), "late": counted("late", raises)}, out, min_names=5)
    batch.run_batch(panel, {"a": counted("a", good(0)), "late": counted("late", good(4)), "new": counted("new", good(5))}, out, min_names=5)
    assert calls == ["a", "late", "new"]
    got = {r["factor_name"]: r["error"] for r in batch.run_batch(panel, {"a": counted("a", raises), "late": counted("late", good(4))}, out, min_names=5, retry_failed=True).collect()}
    assert calls == ["a", "late", "new", "late"] and got == {"a": None, "late": None, "new": None}


def test_a_run_broken_before_its_manifest_is_replaced(spark, panel, tmp_path):
    out = f"file://{tmp_path}/run"
    batch.run_batch(panel, {"a": good(0)}, out, min_names=5)
    want = sorted(map(tuple, spark.read.parquet(f"{out}/daily").collect()))
    other = f"file://{tmp_path}/other"
    spark.read.parquet(f"{out}/daily").unionAll(spark.read.parquet(f"{out}/daily")).write.partitionBy("factor_name").parquet(f"{other}/daily")
    assert batch.manifest(spark, other).count() == 0 and batch.daily_results(spark, other).count() == 0
    batch.run_batch(panel, {"a": good(0)}, other, min_names=5)
    assert sorted(map(tuple, batch.daily_results(spark, other).select("date", "ic", "rank_ic", "p_value", "ic_p_value", "n_stocks", "factor_name").collect())) == sorted(
        map(tuple, spark.read.parquet(f"{out}/daily").select("date", "ic", "rank_ic", "p_value", "ic_p_value", "n_stocks", "factor_name").collect())) and want
