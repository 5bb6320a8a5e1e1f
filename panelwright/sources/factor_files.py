"""Scans of factor tables, packed arrays, series files and index bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelwright.functions import timeseries as ts
from panelwright.functions.scalar import nan_to_null, to_number
from panelwright.sources.panel import normalise_keys, require

# Fixed value: name endings of the per-factor files.
CUMULATIVE_SUFFIX = "_decile_cum"
DAILY_SUFFIX = "_decile_daily"
IC_SUFFIX = "_rankic"


def normalise_factor(df: DataFrame, factor_name: str | None = None) -> DataFrame:
    """Accept (entity, date, one value column) and return the long factor form."""
    keys = [c for c in ("factor_name", "entity", "date") if c in df.columns]
    values = [c for c in df.columns if c not in keys]
    require(df, ["entity", "date"])
    if len(values) != 1:
        raise ValueError(f"a factor needs exactly one value column, found {values}")
    name = F.lit(factor_name or values[0]) if "factor_name" not in keys else F.col("factor_name")
    return normalise_keys(df).select(
        name.alias("factor_name"), "entity", "date", nan_to_null(F.col(values[0]).cast("double")).alias("value")
    ).dropna(subset=["entity", "date"])


def scan_factor(spark: SparkSession, path: str, factor_name: str) -> DataFrame:
    """One factor of a table partitioned by ``factor_name``; other partitions are not read."""
    stored = spark.read.parquet(path).filter(F.col("factor_name") == factor_name)
    return normalise_factor(stored.select("factor_name", "entity", "date", "value"))


def scan_factor_set(
    spark: SparkSession, path: str, names: Sequence[str] | None = None, max_factors: int | None = None
) -> DataFrame:
    """Several factors of a stored table, by list and at most ``max_factors`` by name.

    An unreadable file stops the job, so that no factor comes out half complete;
    :func:`unreadable_factors` names such factors beforehand, to be left out by ``names``.
    """
    stored = spark.read.parquet(path)
    if names is not None:
        stored = stored.filter(F.col("factor_name").isin(list(names)))
    if max_factors is not None:
        first = stored.select("factor_name").distinct().orderBy("factor_name").limit(max_factors)
        stored = stored.join(first, "factor_name", "left_semi")
    return normalise_factor(stored.select("factor_name", "entity", "date", "value"))


def unreadable_factors(spark: SparkSession, path: str) -> DataFrame:
    """(factor_name, file, bytes) of stored files from which not one row can be read.

    Files are listed without their content, and those that give rows, of which
    only footers are read, are taken away.  A file damaged further inside stops the
    scan itself.  The layout is one folder per factor.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    readable = (
        spark.read.schema("value double").option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(path)
        .select(F.col("_metadata.file_path").alias("path")).distinct()
    )
    place = lambda c: F.regexp_replace(c, "^file:/+", "/")
    lost = files.withColumn("_p", place("path")).join(readable.select(place("path").alias("_p")), "_p", "left_anti")
    return lost.select(
        F.url_decode(F.regexp_extract("path", r"factor_name=([^/]+)/", 1)).alias("factor_name"),
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))


def scan_factor_csv(spark: SparkSession, path: str, factors: Sequence[str]) -> DataFrame:
    """Text export with date, entity, close and factor columns; bad numbers become NULL."""
    schema = "date string, entity string, close string, " + ", ".join(f"`{f}` string" for f in factors)
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return raw.select(
        F.to_date("date").alias("date"), "entity", to_number("close").alias("close"),
        *[to_number(f"`{f}`").alias(f) for f in factors],
    )


def pack_factor(factors: DataFrame, names_bound: int, pack_rows: int = 100_000) -> DataFrame:
    """Parallel arrays per (factor, date): the array layout, cut into bounded packs.

    ``names_bound`` bounds the names per date; a larger cross-section is dealt
    into several packs of about ``pack_rows`` by hash.
    """
    packs = -(-names_bound // pack_rows)
    ordered = F.array_sort(F.collect_list(F.struct("entity", "value")))
    return (
        factors.groupBy("factor_name", "date", F.pmod(F.xxhash64("entity"), F.lit(packs)).alias("_pack"))
        .agg(ordered.alias("_rows"))
        .select(
            "factor_name",
            F.col("_rows.value").alias("values"),
            F.col("_rows.entity").alias("index_entity"),
            F.transform("_rows", lambda _: F.col("date")).alias("index_date"),
        )
    )


def _even(packed: DataFrame) -> Column:
    return (F.size("values") == F.size("index_entity")) & (F.size("values") == F.size("index_date"))


def refused_factors(packed: DataFrame) -> DataFrame:
    """(factor_name, packs, uneven) of factors that have a pack whose arrays differ in length."""
    counted = packed.groupBy("factor_name").agg(
        F.count("*").alias("packs"), F.count_if(~F.coalesce(_even(packed), F.lit(False))).alias("uneven"))
    return counted.filter("uneven > 0")


def explode_packed_factor(packed: DataFrame) -> DataFrame:
    """Rows from parallel arrays.

    A factor with an uneven pack is refused as a whole, never left with holes;
    :func:`refused_factors` lists those.
    """
    return (
        packed.join(refused_factors(packed).select("factor_name"), "factor_name", "left_anti")
        .select("factor_name", F.explode(F.arrays_zip("values", "index_entity", "index_date")).alias("_r"))
        .select(
            "factor_name",
            F.col("_r.index_entity").alias("entity"),
            F.col("_r.index_date").alias("date"),
            nan_to_null(F.col("_r.values")).alias("value"),
        )
    )


def decode_dictionary_market(rows: DataFrame, codes: DataFrame, days: DataFrame) -> DataFrame:
    """Integer-coded market rows to (entity, date, return_next).

    ``codes`` holds ``stock_code_list`` arrays and ``days`` holds ``date_values``
    arrays of yyyymmdd numbers; an id is a position in them.  A long dictionary
    comes in several rows, each with the ``first_id`` of its slice.
    """

    def entries(df: DataFrame, values: str, key: str, out: str) -> DataFrame:
        first = F.col("first_id") if "first_id" in df.columns else F.lit(0)
        return df.select(first.alias("_first"), F.posexplode(values).alias("_at", out)).select(
            (F.col("_first") + F.col("_at")).alias(key), out
        )

    date = entries(days, "date_values", "date_id", "_ymd").select(
        "date_id", F.to_date(F.col("_ymd").cast("string"), "yyyyMMdd").alias("date")
    )
    return (
        rows.select("stock_id", "date_id", nan_to_null("return_next").alias("return_next"))
        .filter(F.col("return_next").isNotNull())
        .join(entries(codes, "stock_code_list", "stock_id", "entity"), "stock_id")
        .join(date, "date_id")
        .select("entity", "date", "return_next")
    )


def market_from_prices(prices: DataFrame, periods: int = 1) -> DataFrame:
    """The same table from closing prices."""
    w = ts.entity_window()
    return prices.select("entity", "date", ts.forward_return("close", periods, w).alias("return_next")).filter(
        F.col("return_next").isNotNull()
    )


def _file_stem(suffix: str):
    """Factor name of a row from the directory or file that holds it."""
    name = F.regexp_extract(F.col("_metadata.file_path"), rf"(?:^|/)(?:[^/=]+=)?([^/]+?){suffix}(?:\.csv)?(?:/|$)", 1)
    return F.url_decode(name)


def scan_bucket_series(spark: SparkSession, path: str, suffix: str = DAILY_SUFFIX, exclude: str = "composite_factor") -> DataFrame:
    """LS series of every ``*<suffix>`` file below a folder, except those of names that begin with ``exclude``."""
    raw = (
        spark.read.schema("date string, LS string")
        .option("header", True)
        .option("recursiveFileLookup", True)
        .csv(path)
    )
    return (
        raw.select(_file_stem(suffix).alias("factor_name"), F.to_date("date").alias("date"), to_number("LS").alias("LS"))
        .filter((F.col("factor_name") != "") & ~F.col("factor_name").startswith(exclude))
    )


def scan_ic_series(spark: SparkSession, path: str) -> DataFrame:
    """Daily rank-correlation file: numbers coerced, rows without one dropped."""
    raw = spark.read.option("header", True).csv(path)
    require(raw, ["date", "rank_ic"])
    return raw.select(
        *[c for c in raw.columns if c == "factor_name"],
        F.to_date("date").alias("date"), to_number("rank_ic").alias("rank_ic"),
    ).filter(F.col("rank_ic").isNotNull())


SUMMARY_COLUMNS = ["factor_name", "mean_rank_ic", "rank_ic_std", "rank_ic_ir", "rank_ic_win_rate", "valid_days"]


def scan_summary(spark: SparkSession, path: str) -> DataFrame:
    """Baseline summary: required columns, numbers coerced, nameless or IR-less rows dropped."""
    raw = spark.read.option("header", True).csv(path)
    require(raw, SUMMARY_COLUMNS)
    out = raw.select("factor_name", *[to_number(c).alias(c) for c in SUMMARY_COLUMNS[1:]])
    return out.filter(F.col("factor_name").isNotNull() & F.col("rank_ic_ir").isNotNull())


def scan_all_summaries(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of several summaries; the last file in order wins per factor."""
    from panelwright.operators.screen import keep_last

    union = None
    for i, path in enumerate(paths):
        part = scan_summary(spark, path).withColumn("_file", F.lit(i))
        union = part if union is None else union.unionByName(part)
    return keep_last(union, "factor_name", "_file").drop("_file")


# Raw names of index bars and the code rule of the two exchanges.
INDEX_RENAMES = {"pct_chg": "pct_change", "turnover": "total_turnover", "code": "entity"}
SECOND_EXCHANGE_PREFIXES = ("39", "40")
FIRST_EXCHANGE, SECOND_EXCHANGE = ".XSHG", ".XSHE"


def index_code(raw):
    """Exchange-suffixed code of a numeric index code."""
    code = F.lpad(F.col(raw).cast("string"), 6, "0")
    second = code.startswith(SECOND_EXCHANGE_PREFIXES[0]) | code.startswith(SECOND_EXCHANGE_PREFIXES[1])
    return F.concat(code, F.when(second, SECOND_EXCHANGE).otherwise(FIRST_EXCHANGE))


def normalise_index_bars(parts: Sequence[DataFrame]) -> DataFrame:
    """Rename, type and union landed index bars."""
    union = None
    numeric = ["open", "high", "low", "close", "volume", "total_turnover", "pct_change"]
    for part in parts:
        named = part.withColumnsRenamed({k: v for k, v in INDEX_RENAMES.items() if k in part.columns})
        typed = named.select(
            F.to_date("date").alias("date"), index_code("entity").alias("entity"),
            *[to_number(F.col(c)).alias(c) for c in numeric],
        )
        union = typed if union is None else union.unionByName(typed)
    return union
