"""The registered queries: shape of the registry, plans, and a sample against SQL."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, differences
from panelwright.suite import all_checks

SF = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    queries, sql = contract.queries(), contract.oracle_sql()
    assert set(sql) <= set(queries)
    queries = set(all_checks())
    sql = queries & set(sql)
    assert len(queries) >= 115
    assert set(queries) - set(sql) == {"early_stopping", "composite_metrics", "composite_strategy"}


@pytest.mark.parametrize("pipeline_goes", [True, False])
def test_registry_without_the_optional_subpackage(tmp_path, pipeline_goes):
    home = Path(contract.__file__).parent
    optional = "llm"
    shutil.copytree(home / "panelwright", tmp_path / "panelwright", ignore=shutil.ignore_patterns(optional, "__pycache__"))
    names = ["__spark_entry__.py"] if pipeline_goes else ["__spark_entry__.py", "corpus_pipeline.py"]
    for name in names:
        if (home / name).exists():
            shutil.copy(home / name, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(all_checks()) and int(out[1]) > 100


def test_entry_returns_rows(spark):
    out = contract.entry(spark)
    assert out.columns == ["factor_name", "date", "ic", "rank_ic", "p_value", "ic_p_value", "n_stocks"]
    assert out.count() > 100


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


SAMPLE = [
    "densify", "ts_rank", "winsorize", "quantile_bin", "recipe_industry_neutral_momentum_20d", "clean_returns",
    "stateful_backtest", "rank_turnover", "novelty", "resolve_name", "registry_upsert", "price_stats", "place_all",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_sql(spark, con, name):
    got = contract.queries()[name](spark, SF).toPandas()
    assert differences(got, con.execute(contract.oracle_sql()[name]).df()) == ""


PLANS = ["densify", "daily_rank_ic", "ic_decay", "stateful_backtest", "quantile_bin", "novelty", "resolve_name", "value_similarity", "align_ffill", "price_stats", "place_all"]


@pytest.mark.parametrize("name", PLANS)
def test_no_products_of_tables(spark, name):
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_only_needed_columns_are_read(spark):
    plan = contract.queries()["ts_mean"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.splitlines() if "ReadSchema" in line and "l_" in line]
    assert reads and not any("l_tax" in r or "l_discount" in r or "l_returnflag" in r for r in reads)


def test_one_entity_and_one_date_shuffle_per_library(spark):
    """A factor costs one exchange by entity and one by date on top of the panel's own."""
    from panelwright.plans.factors import factor_wide
    from panelwright.sources.panel import weekly_panel
    from panelwright.suite.base import LIBRARY

    panel = weekly_panel(spark, SF)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = factor_wide(panel, LIBRARY)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "Reused" not in line]
    by = [line.split("hashpartitioning(")[1].split(")")[0] for line in exchanges]
    assert sum(b.startswith("entity") for b in by) == 1
    assert sum(b.startswith(("date", "_grid_date")) and b.count("#") == 1 for b in by) <= 2
