"""Cross-sectional operators: statistics and order within groups.

Groups of one date hold the names of that date, and a window per group is the
cheapest plan: one shuffle serves every operator that follows, and sorted groups
spill.  Groups that pool dates grow with the whole table; for these, named by
``spread``, the same results come from partial aggregates joined back, and order
statistics from value ranges inside the group, so that no task ever needs a whole
group.  The caller's kind of key decides, never a row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions.scalar import clip, col, divide
from panelwright.session import cut_lineage


def one_group(column: str) -> Column:
    """A key that is the same for all rows but no constant, so that joins on it stay equi-joins."""
    return F.pmod(F.xxhash64(column), F.lit(1))


class CrossSection:
    """Operators over the groups named by ``keys``.

    ``spread`` says that a group may hold much of the table; its rows are then cut
    in value ranges of ``range_rows`` distinct values on average.
    """

    def __init__(self, keys: Sequence[str], spread: bool = False, range_rows: int = 500_000):
        self.keys = list(keys)
        self.spread = spread
        self.range_rows = range_rows

    def with_keys(self, *keys: str) -> "CrossSection":
        return CrossSection(keys, self.spread, self.range_rows)

    # -- building blocks ---------------------------------------------------

    def attach(self, df: DataFrame, extra_keys: Sequence[str] = (), **aggregates: Column) -> DataFrame:
        """Add one column per group aggregate."""
        keys = [*self.keys, *extra_keys]
        if not self.spread:
            group = Window.partitionBy(*keys)
            return df.select("*", *[agg.over(group).alias(name) for name, agg in aggregates.items()])
        stats = df.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggregates.items()])
        return _join_back(df, stats, keys)

    def positions(self, df: DataFrame, x: str, prefix: str = "_") -> DataFrame:
        """Add counts of values below and up to this one, and of all values.

        The three columns are ``{prefix}lo``, ``{prefix}hi`` and ``{prefix}n``;
        they are 0-based bounds of the value's place in its sorted group.  Rows
        with a NULL value get NULL bounds.
        """
        lo, hi, n = f"{prefix}lo", f"{prefix}hi", f"{prefix}n"
        # adding 0.0 folds -0.0 into 0.0; whole numbers and text are taken as they are
        value = F.col(x) + F.lit(0.0) if dict(df.dtypes)[x] in ("double", "float") else F.col(x)
        if not self.spread:
            ordered = Window.partitionBy(*self.keys).orderBy(value.asc_nulls_last())
            whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            upto = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
            known = F.col(x).isNotNull()
            return df.select(
                "*",
                F.when(known, F.rank().over(ordered).cast("long") - 1).alias(lo),
                F.when(known, F.count(x).over(upto)).alias(hi),
                F.count(x).over(whole).alias(n),
            )
        return self._split_positions(df, x, value, lo, hi, n)

    def _split_positions(self, df: DataFrame, x: str, value: Column, lo: str, hi: str, n: str) -> DataFrame:
        """Bounds from counts per value.

        The input and the counts are each worked out once and kept in the
        checkpoint folder, so nested calls do not multiply the plan.
        """
        keys = self.keys
        df = cut_lineage(df)
        # ties collapse before the shuffle, and the value is part of the key, so
        # neither a hot group nor a hot value reaches one task as rows
        values = cut_lineage(df.filter(F.col(x).isNotNull()).groupBy(*keys, value.alias("_v")).agg(F.count("*").alias("_c")))
        # split points: values picked by hash, one in range_rows; the same on every recomputation
        splits = (
            values.filter(F.pmod(F.xxhash64("_v"), F.lit(self.range_rows)) == 0)
            .groupBy(*keys)
            .agg(F.array_sort(F.collect_list("_v")).alias("_splits"))
        )
        ranged = cut_lineage(_join_back(values, splits, keys).withColumn(
            "_range", F.coalesce(F.size(F.filter("_splits", lambda s: s < F.col("_v"))), F.lit(0))
        ).drop("_splits"))
        totals = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_range_total"))
        over_ranges = Window.partitionBy(*keys).orderBy("_range")
        offsets = totals.select(
            *keys,
            "_range",
            (F.sum("_range_total").over(over_ranges) - F.col("_range_total")).alias("_offset"),
        )
        inside = Window.partitionBy(*keys, "_range").orderBy("_v")
        placed = _join_back(ranged, offsets, [*keys, "_range"], how="inner").select(
            *keys, "_v", (F.col("_offset") + F.sum("_c").over(inside)).alias(hi), "_c"
        )
        placed = placed.select(*keys, "_v", (F.col(hi) - F.col("_c")).alias(lo), hi)
        sizes = df.groupBy(*keys).agg(F.count(x).alias(n))
        out = _join_back(df.withColumn("_v", value), placed, [*keys, "_v"]).drop("_v")
        return _join_back(out, sizes, keys)

    # -- order statistics --------------------------------------------------

    def rank(self, df: DataFrame, x: str, out: str, pct: bool = True) -> DataFrame:
        """Average-tie rank, as a share of the non-NULL count when ``pct``."""
        placed = self.positions(df, x, "_rk_")
        average = (F.col("_rk_lo") + F.col("_rk_hi") + 1) / F.lit(2.0)
        value = average / F.col("_rk_n") if pct else average
        return placed.select(*[c for c in df.columns if c != out], value.alias(out))

    def centred_rank(self, df: DataFrame, x: str, out: str) -> DataFrame:
        """Average-tie rank minus the group's mean rank.

        These are halves of whole numbers, so sums of their products are exact and
        do not depend on the order in which tasks deliver rows.
        """
        placed = self.positions(df, x, "_rk_")
        value = (F.col("_rk_lo") + F.col("_rk_hi") - F.col("_rk_n")) / F.lit(2.0)
        return placed.select(*[c for c in df.columns if c != out], value.alias(out))

    def quantiles(self, df: DataFrame, x: str, marks: Sequence[tuple[str, Column, Column]], prefix: str = "_q_") -> DataFrame:
        """Attach linearly interpolated quantiles of ``x``.

        Each mark is ``(name, position, fraction)``: the value at 0-based
        ``position`` moved by ``fraction`` towards the next one.  Both may refer
        to ``{prefix}n``, the group's count.
        """
        placed = self.positions(df, x, prefix)
        lo, hi = F.col(f"{prefix}lo"), F.col(f"{prefix}hi")
        wanted = {}
        for name, position, _ in marks:
            for suffix, at in (("a", position), ("b", position + 1)):
                wanted[f"_{name}_{suffix}"] = F.max(F.when((lo <= at) & (at < hi), F.col(x) + F.lit(0.0)))
        found = self.attach(placed, **wanted)
        blended = []
        for name, _, fraction in marks:
            a, b = F.col(f"_{name}_a"), F.col(f"_{name}_b")
            blended.append(F.when(fraction > 0, a + (b - a) * fraction).otherwise(a).alias(name))
        return found.select(*df.columns, f"{prefix}n", *blended)

    def winsorize(self, df: DataFrame, x: str, out: str, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
        marks = []
        for name, p in (("_w_low", lower), ("_w_high", upper)):
            exact = (F.col("_q_n") - 1) * F.lit(float(p))
            marks.append((name, F.floor(exact), exact - F.floor(exact)))
        return (
            self.quantiles(df, x, marks)
            .withColumn(out, clip(x, "_w_low", "_w_high"))
            .drop("_w_low", "_w_high", "_q_n")
        )

    def quantile_bin(self, df: DataFrame, x: str, out: str, bins: int) -> DataFrame:
        """Right-closed quantile bins numbered from 0; equal edges merge.

        Edges sit at k(n-1)/bins exactly, in whole-number arithmetic.  Groups
        with fewer values than bins get NULL.
        """
        marks = []
        for k in range(bins + 1):
            exact = (F.col("_q_n") - 1) * F.lit(k)
            whole = F.floor(exact / F.lit(bins))
            marks.append((f"_edge_{k}", whole, (exact % F.lit(bins)) / F.lit(float(bins))))
        edged = self.quantiles(df, x, marks)
        value = F.col(x) + F.lit(0.0)
        passed = F.when(F.col("_edge_0") < value, F.lit(1)).otherwise(F.lit(0))
        for k in range(1, bins + 1):
            edge, before = F.col(f"_edge_{k}"), F.col(f"_edge_{k - 1}")
            passed = passed + F.when((edge > before) & (edge < value), F.lit(1)).otherwise(F.lit(0))
        usable = F.col(x).isNotNull() & (F.col("_q_n") >= bins)
        return edged.select(*df.columns, F.when(usable, F.greatest(passed, F.lit(1)) - 1).alias(out))

    def extreme_masks(self, df: DataFrame, x: str, top: float = 0.9, bottom: float = 0.1) -> DataFrame:
        """Add ``is_long`` and ``is_short`` by percentile rank."""
        ranked = self.rank(df, x, "_pct")
        return (
            ranked.withColumn("is_long", F.coalesce(F.col("_pct") >= top, F.lit(False)))
            .withColumn("is_short", F.coalesce(F.col("_pct") <= bottom, F.lit(False)))
            .drop("_pct")
        )

    # -- moments -----------------------------------------------------------

    def zscore(self, df: DataFrame, x: str, out: str, flat: float | None = None, tiny: float = 0.0) -> DataFrame:
        """Standard score; ``flat`` is the result where the spread is at most ``tiny``."""
        with_moments = self.attach(df, _z_mean=F.avg(x), _z_std=F.stddev_samp(x))
        score = F.when(
            F.col("_z_std") > tiny, (F.col(x) - F.col("_z_mean")) / F.col("_z_std")
        )
        if flat is not None:
            score = F.when(F.col(x).isNotNull(), F.coalesce(score, F.lit(float(flat))))
        return with_moments.withColumn(out, score).drop("_z_mean", "_z_std")

    def demean(self, df: DataFrame, x: str, out: str) -> DataFrame:
        return self.attach(df, _d_mean=F.avg(x)).withColumn(out, F.col(x) - F.col("_d_mean")).drop("_d_mean")

    def neutralize_industry(self, df: DataFrame, x: str, out: str, industry: str = "industry") -> DataFrame:
        """Subtract the industry mean of the date; no industry gives NULL."""
        if industry not in df.columns:
            return df.withColumn(out, F.col(x))
        return (
            self.attach(df, [industry], _i_mean=F.avg(x))
            .withColumn(out, F.when(F.col(industry).isNotNull(), F.col(x) - F.col("_i_mean")))
            .drop("_i_mean")
        )

    def neutralize_size(self, df: DataFrame, x: str, out: str, size: str = "market_cap") -> DataFrame:
        """Residual of a per-date regression on log(1 + size).

        A practically constant size leaves the demeaned value; a missing value or
        size gives NULL.
        """
        log_size = F.when(F.col(size) > -1, F.log1p(F.col(size)))
        both = F.col(x).isNotNull() & log_size.isNotNull()
        base = df.withColumn("_s", F.when(both, log_size)).withColumn("_y", F.when(both, F.col(x)))
        fitted = self.attach(
            base,
            _ym=F.avg("_y"), _sm=F.avg("_s"), _sv=F.var_samp("_s"), _cov=F.covar_samp("_s", "_y"),
        )
        slope = F.when(F.col("_sv") > 1e-12, F.col("_cov") / F.col("_sv")).otherwise(F.lit(0.0))
        residual = F.col("_y") - F.col("_ym") - slope * (F.col("_s") - F.col("_sm"))
        return fitted.withColumn(out, residual).drop("_s", "_y", "_ym", "_sm", "_sv", "_cov")

    def size_residual(self, df: DataFrame, x: str, out: str, size: str = "market_cap", fewest: int = 5) -> DataFrame:
        """Residual on log(size); rows or dates that cannot be fitted keep their value."""
        log_size = F.when(F.col(size) > 0, F.ln(F.col(size) + F.lit(1e-10)))
        both = F.col(x).isNotNull() & log_size.isNotNull()
        base = df.withColumn("_s", F.when(both, log_size)).withColumn("_y", F.when(both, F.col(x)))
        fitted = self.attach(
            base,
            _fn=F.count("_y"), _ym=F.avg("_y"), _sm=F.avg("_s"),
            _sv=F.var_pop("_s"), _cov=F.covar_pop("_s", "_y"),
        )
        slope = F.coalesce(divide("_cov", "_sv"), F.lit(0.0))
        residual = F.col("_y") - F.col("_ym") - slope * (F.col("_s") - F.col("_sm"))
        usable = F.col("_y").isNotNull() & (F.col("_fn") >= fewest)
        return fitted.withColumn(out, F.when(usable, residual).otherwise(F.col(x))).drop(
            "_s", "_y", "_fn", "_ym", "_sm", "_sv", "_cov"
        )

    def industry_demean(self, df: DataFrame, x: str, out: str, industry: str = "industry") -> DataFrame:
        """Subtract the industry mean; rows without an industry keep their value."""
        mean = F.when(F.col(industry).isNotNull(), F.col("_i_mean"))
        return (
            self.attach(df, [industry], _i_mean=F.avg(x))
            .withColumn(out, F.col(x) - F.coalesce(mean, F.lit(0.0)))
            .drop("_i_mean")
        )

    def neutralize(self, df: DataFrame, x: str, out: str, methods: Sequence[str] = ("cross_demean",),
                   size: str | None = "market_cap", industry: str | None = "industry") -> DataFrame:
        """Apply neutralisers in order, skipping those whose column is absent.

        ``cross_demean`` always subtracts the mean of the original values.
        """
        current = df.withColumn("_nv", F.col(x))
        for method in methods:
            if method == "cross_demean":
                current = self.attach(current, _om=F.avg(x)).withColumn("_nv", F.col("_nv") - F.col("_om")).drop("_om")
            elif method == "mktcap":
                if size in df.columns:
                    current = self.size_residual(current, "_nv", "_nv", size)
            elif method == "industry":
                if industry in df.columns:
                    current = self.industry_demean(current, "_nv", "_nv", industry)
            else:
                raise ValueError(f"unknown neutraliser {method!r}")
        return current.withColumn(out, F.col("_nv")).drop("_nv")


def _join_back(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi join of group results to rows; AQE splits skewed keys."""
    renamed = right
    condition = None
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_k_{k}")
        match = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        condition = match if condition is None else condition & match
    return left.join(renamed, condition, how).drop(*[f"_k_{k}" for k in keys])
