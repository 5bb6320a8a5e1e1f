"""Sinks and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

from panelwright.functions.scalar import finite, is_true
from panelwright.operators.portfolio import bucket_table, cumulative_table
from panelwright.session import cut_lineage


def write_ic(daily: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Daily correlation table, one folder per factor."""
    writer = daily.repartition("factor_name").write.mode(mode).partitionBy("factor_name")
    writer.option("header", True).format(fmt).save(path)


def write_daily(daily: DataFrame, path: str) -> None:
    """Daily tables by factor; only the folders of the written factors are replaced."""
    daily.repartition("factor_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("factor_name").parquet(path)


def write_backtest(bucket_returns: DataFrame, path: str, bins: int, cost_bps: float = 0.0, fmt: str = "parquet") -> None:
    """Periodic and compounded bucket tables under ``daily`` and ``cum``."""
    table = cut_lineage(bucket_table(bucket_returns, bins, cost_bps))  # one row per factor and date, written twice
    for name, df in (("daily", table), ("cum", cumulative_table(table))):
        df.write.mode("overwrite").partitionBy("factor_name").option("header", True).format(fmt).save(f"{path}/{name}")


def write_factor(factors: DataFrame, path: str) -> None:
    """Store factors by name; only the written factors' folders are replaced.

    Rows are rebalanced by factor at run time: small factors end up in one file,
    and a factor holding much of the table is cut into several.
    """
    (
        factors.select("factor_name", "entity", "date", "value")
        .hint("rebalance", F.col("factor_name"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("factor_name")
        .parquet(path)
    )


def null_out_non_finite(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            finite(f.name).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def run_metadata(summary: DataFrame, inputs: dict[str, str]) -> DataFrame:
    """One row describing a run: its inputs, counts and status."""
    ok = F.col("error").isNull()
    return summary.agg(
        F.count("*").alias("factor_count"),
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("error_count"),
        F.max("rank_ic_ir").alias("best_rank_ic_ir"),
    ).select(
        F.create_map(*[F.lit(v) for kv in inputs.items() for v in kv]).alias("inputs"),
        "factor_count", "success_count", "error_count",
        finite("best_rank_ic_ir").alias("best_rank_ic_ir"),
        F.when(F.col("error_count") == 0, "success").when(F.col("success_count") > 0, "partial").otherwise("failed").alias("status"),
    )


def write_run_metadata(summary: DataFrame, inputs: dict[str, str], path: str) -> None:
    run_metadata(summary, inputs).write.mode("overwrite").json(path)


def flat_export(panel: DataFrame, factor: DataFrame) -> DataFrame:
    """Panel with one factor, flags as 0/1, rows lacking price or value dropped."""
    joined = panel.join(factor.select("entity", "date", F.col("value").alias("factor_value")), ["entity", "date"], "left")
    return joined.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        "entity", "close", "factor_value",
        is_true("ST").cast("int").alias("is_st"),
        is_true("limit_up_flag").cast("int").alias("is_limit_up"),
        is_true("limit_down_flag").cast("int").alias("is_limit_down"),
        is_true("suspended").cast("int").alias("is_suspended"),
    ).dropna(subset=["close", "factor_value"])


def ledger_append(candidates: DataFrame, path: str) -> None:
    """Append evaluated candidates, without their code text."""
    candidates.drop("code").write.mode("append").parquet(path)


def todo_factors(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Factors whose output does not exist yet."""
    return wanted.join(done.select("factor_name").distinct(), "factor_name", "left_anti")


def stored_factors(spark: SparkSession, path: str) -> DataFrame:
    """Names present in a table partitioned by ``factor_name``."""
    return spark.read.parquet(path).select("factor_name").distinct()
