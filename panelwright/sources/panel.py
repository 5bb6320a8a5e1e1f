"""The market panel: one row per (entity, date), and its calendar grid."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelwright.functions.scalar import divide, nulls_for_nans
from panelwright.operators.crosssection import CrossSection

KEY = ["entity", "date"]
FLAGS = ["ST", "limit_up_flag", "limit_down_flag", "suspended"]
# Columns evaluation cannot do without.
REQUIRED = KEY + ["close"] + FLAGS
# Accepted names for size and industry columns, in order of preference.
SIZE_COLUMNS = ["market_cap", "mkt_cap", "total_market_cap", "circulating_market_cap", "float_market_cap"]
INDUSTRY_COLUMNS = [
    "industry", "industry_code", "sw_industry", "sw_industry_code",
    "cs_industry", "cs_industry_code", "citics_industry",
]


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    return df


def first_existing(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)


@dataclass
class Panel:
    """A panel frame with what is known about its size.

    ``names_bound`` is an upper bound on entities per date, from which packed
    layouts take their number of packs; it is counted where it is not given.  ``days``
    may name a cheaper frame holding exactly the panel's dates.
    """

    df: DataFrame
    names_bound: int | None = None
    days: DataFrame | None = None
    _checked: int | None = field(default=None, repr=False)

    def largest_cross_section(self) -> int:
        if self.names_bound is not None:
            return self.names_bound
        if self._checked is None:
            row = self.df.select("entity").distinct().agg(F.count("*").alias("n")).first()
            self._checked = int(row["n"])
        return self._checked

    def cross_section(self, *extra_keys: str) -> CrossSection:
        return CrossSection([*extra_keys, "date"])

    def select(self, *columns: str) -> "Panel":
        return Panel(self.df.select(*columns), self.names_bound, self.days, self._checked)


def scan_market(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> Panel:
    """Read a stored panel, keep the wanted columns and normalise keys."""
    df = require(spark.read.parquet(path), KEY + ["close"])
    keep = [c for c in (columns or REQUIRED) if c in df.columns]
    return Panel(nulls_for_nans(normalise_keys(df.select(*dict.fromkeys(KEY + keep)))))


def normalise_keys(df: DataFrame, entity: str = "entity", date: str = "date") -> DataFrame:
    return df.withColumn(entity, F.col(entity).cast("string")).withColumn(date, F.to_date(date))


# --------------------------------------------------------------------------
# Panels derived from the given tables


# Stated schemas save a footer read per table before planning.
TABLE_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _supplier_bars(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
        F.col("l_suppkey").cast("string").alias("entity"),
    ).repartition("entity").withColumns({
        "date": F.trunc(F.to_date("l_shipdate"), period),
        "px": divide("l_extendedprice", "l_quantity"),
    })
    # dealt out by entity once: bars, gaps and windows along time need no further shuffle; what follows from a line's
    # own columns is worked out behind it
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    all_r = F.min(F.col("l_returnflag") == "R")
    all_a = F.min(F.col("l_returnflag") == "A")
    money = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    bars = lines.groupBy("entity", "date").agg(
        F.min_by("px", order).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", order).alias("close"),
        F.sum("l_quantity").alias("volume"),
        money.alias("amount"),
        ((F.count("*") >= 3) & all_r).alias("ST"),
        F.when(~all_a, (F.max("l_discount") >= 0.095) & all_r).alias("limit_up_flag"),
        F.when(~all_a, (F.min("l_discount") <= 0.005) & all_r).alias("limit_down_flag"),
        (F.avg("l_quantity") < 4).alias("suspended"),
    )
    return bars.withColumn("vwap", divide("amount", "volume"))


def _supplier_panel(spark: SparkSession, sf_dir: str, period: str) -> Panel:
    supplier = table(spark, sf_dir, "supplier")
    names = supplier.count()
    # nations are a fixed list; as a map they leave the size of the supplier table known, so that bars,
    # which are dealt out by entity already, are not the side to be broadcast
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    industries = nations.filter(F.col("n_nationkey").isNotNull()).agg(
        F.map_from_entries(F.collect_list(F.struct("n_nationkey", "r_name"))).alias("industries")).scalar()
    home = supplier.filter(F.map_contains_key(industries, F.col("s_nationkey"))).select(
        F.col("s_suppkey").cast("string").alias("entity"), "s_acctbal", F.try_element_at(industries, F.col("s_nationkey")).alias("industry"))
    df = (
        _supplier_bars(spark, sf_dir, period)
        .join(home, "entity")
        .select(
            "entity", "date",
            "open", "high", "low", "close", "volume", "amount", "vwap",
            (F.col("s_acctbal") * F.col("close")).alias("market_cap"),
            "industry", *FLAGS,
        )
    )
    days = table(spark, sf_dir, "lineitem").select(F.trunc(F.to_date("l_shipdate"), period).alias("date"))
    # every entity is a supplier, so the supplier table bounds a cross-section
    return Panel(df, names_bound=names, days=days)


def weekly_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """Supplier x week bars from ``lineitem``."""
    return _supplier_panel(spark, sf_dir, "week")


def monthly_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """Supplier x month bars; nearly dense."""
    return _supplier_panel(spark, sf_dir, "month")


def user_day_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """User x day bars from ``events``: last value as close, event count as volume."""
    events = table(spark, sf_dir, "events")
    df = (
        events.groupBy(F.col("user_id").cast("string").alias("entity"), F.to_date("ts").alias("date"))
        .agg(
            F.max_by("value", F.struct("ts", "event_id")).alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
    )
    return Panel(df)


# --------------------------------------------------------------------------
# Calendar grid


def calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates with their position; at most one row per calendar day.

    The numbering runs in one task, over days and not over rows: DateType itself
    bounds it to a few million values.
    """
    days = df.select(F.col(date).alias("date")).distinct()
    everything = Window.partitionBy(F.lit(0)).orderBy("date")
    return days.select(
        "date",
        F.row_number().over(everything).alias("position"),
        F.count("*").over(Window.partitionBy(F.lit(0))).cast("int").alias("last_position"),
    )


def densify(panel: Panel | DataFrame, leading: bool = False, carry: Sequence[str] | None = None) -> DataFrame:
    """Fill every entity's gaps up to the end of the calendar with NULL rows.

    Each row is repeated over the calendar positions until the entity's next row,
    so the grid costs one shuffle by entity and no product of dates and entities.
    ``leading`` also adds the positions before an entity's first row; trailing
    windows are NULL there, so factor operators do not need them.  ``present``
    tells real rows from filled ones.
    """
    df = panel.df if isinstance(panel, Panel) else panel
    known_days = panel.days if isinstance(panel, Panel) and panel.days is not None else df
    carry = [c for c in (carry or df.columns) if c not in KEY]
    # the calendar has at most one row per day, so its broadcast is bounded by the date type
    days = F.broadcast(calendar(known_days))
    by_entity = Window.partitionBy("entity").orderBy("position")
    start: Column = F.col("position")
    if leading:
        start = F.when(F.lag("position").over(by_entity).isNull(), F.lit(1)).otherwise(F.col("position"))
    stop = F.coalesce(F.lead("position").over(by_entity) - 1, F.col("last_position"))
    spread = (
        df.select(*KEY, *carry)
        .join(days, "date")
        .withColumn("_start", start)
        .withColumn("_stop", stop)
        .withColumn("_step", F.explode(F.sequence("_start", "_stop")))
    )
    present = F.col("_step") == F.col("position")
    back = F.broadcast(calendar(known_days).select(F.col("date").alias("_grid_date"), F.col("position").alias("_step")))
    return spread.join(back, "_step").select(
        "entity",
        F.col("_grid_date").alias("date"),
        *[F.when(present, F.col(c)).alias(c) for c in carry],
        present.alias("present"),
    )
