"""Descriptive tables of a panel or a factor store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelwright.operators.crosssection import CrossSection, one_group


def overview(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("entity").alias("n_entities"),
        F.countDistinct("date").alias("n_dates"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def price_stats(df: DataFrame, price: str = "close") -> DataFrame:
    """Moments and the exact median, found by position and not by collecting values."""
    whole = CrossSection(["_all"], spread=True)
    placed = whole.positions(df.select(price).withColumn("_all", one_group(price)), price, "_m_")
    last = F.col("_m_n") - 1
    low, high = F.floor(last / 2), F.ceil(last / 2)

    def at(position):
        return F.max(F.when((F.col("_m_lo") <= position) & (position < F.col("_m_hi")), F.col(price)))

    return placed.agg(
        F.count(price).alias("valid_count"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.avg(price).alias("mean_price"),
        ((at(low) + at(high)) / 2).alias("median_price"),
        F.stddev_samp(price).alias("std_price"),
    )


def histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Equal-width bins between the smallest and largest value; empty bins are absent."""
    limits = df.agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    # one row of limits, broadcast as a scalar
    low = limits.select("_min").scalar()
    high = limits.select("_max").scalar()
    width = (high - low) / F.lit(float(bins))
    bin_no = F.least(F.floor((F.col(value) - low) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    return (
        df.filter(F.col(value).isNotNull())
        .select(F.coalesce(bin_no, F.lit(0)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )


def price_histogram(df: DataFrame, price: str = "close", bins: int = 100, log_scale: bool = False) -> DataFrame:
    if not log_scale:
        return histogram(df, price, bins)
    positive = df.filter(F.col(price) > 0).select(F.log10(price).alias("_log"))
    return histogram(positive, "_log", bins)


def yearly_profile(df: DataFrame, price: str = "close") -> DataFrame:
    return df.groupBy(F.year("date").alias("year")).agg(
        F.avg(price).alias("mean_close"), F.countDistinct("entity").alias("n_entities")
    )


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Total, valid and missing counts per column, from one pass."""
    counted = df.agg(F.count("*").alias("_total"), *[F.count(c).alias(f"_{c}") for c in columns])
    pairs = ", ".join(f"'{c}', `_{c}`" for c in columns)
    return counted.select("_total", F.expr(f"stack({len(columns)}, {pairs}) as (column_name, valid)")).select(
        "column_name",
        F.col("_total").alias("total"),
        "valid",
        (F.col("_total") - F.col("valid")).alias("nulls"),
        F.try_divide((F.col("_total") - F.col("valid")).cast("double"), F.col("_total").cast("double")).alias("null_share"),
    )


def factor_inventory(factors: DataFrame, kind: str = "family") -> DataFrame:
    return factors.groupBy(kind, "factor_name").agg(
        F.count("*").alias("n_rows"), (F.count("value") > 0).alias("has_data")
    )


def inventory_by_kind(inventory: DataFrame, kind: str = "family") -> DataFrame:
    return inventory.groupBy(kind).agg(F.count("*").alias("n_factors"))


def latest_bar(bars: DataFrame) -> DataFrame:
    """Newest bar of every index."""
    rest = [c for c in bars.columns if c not in ("entity", "date")]
    return (
        bars.groupBy("entity")
        .agg(F.max("date").alias("date"), F.max_by(F.struct(*rest), "date").alias("_last"))
        .select("entity", "date", "_last.*")
    )
