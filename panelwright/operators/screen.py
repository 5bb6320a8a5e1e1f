"""Grading, rankings and recommendations over factor summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions.stats import ratio_or, share
from panelwright.operators.order import ordinal
from panelwright.operators.ic import FACTOR

# Pass marks of the five grading criteria, and letters by score.
THRESHOLDS = {
    "mean_rank_ic": 0.020,
    "rank_ic_ir": 0.300,
    "rank_ic_win_rate": 0.520,
    "valid_days": 100,
    "ic_ir": 0.200,
}
GRADES = {5: "A", 4: "A", 3: "B", 2: "C", 1: "D", 0: "F"}
GRADE_ORDER = {"A": 5, "B": 4, "C": 3, "D": 2, "F": 1, "?": 0}
GRADE_LETTERS = ["A", "B", "C", "D", "F"]


def _criteria(thresholds: dict[str, float]) -> dict[str, Column]:
    """One boolean per criterion; a missing metric fails."""
    out = {}
    for name, mark in thresholds.items():
        value = F.col(name)
        if name == "mean_rank_ic":
            ok = F.abs(value) >= mark
        elif name == "rank_ic_win_rate":
            # a factor that works upside down should lose often
            negative = F.coalesce(F.col("mean_rank_ic"), F.lit(0.0)) < 0
            ok = F.when(negative, value <= 1 - mark).otherwise(value >= mark)
        else:
            ok = value >= mark
        out[name] = F.coalesce(ok, F.lit(False))
    return out


def grade(summary: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Add ``grade``, ``quality_score``, ``failed`` (array) and ``failed_criteria`` (text)."""
    passed = _criteria(thresholds or THRESHOLDS)
    score = sum((ok.cast("int") for ok in passed.values()), F.lit(0))
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in passed.items()]))
    letter = F.lit("F")
    for points, name in GRADES.items():
        letter = F.when(F.col("quality_score") == points, name).otherwise(letter)
    return (
        summary.withColumn("quality_score", score)
        .withColumn("failed", failed)
        .withColumn("failed_criteria", F.array_join("failed", ", "))
        .withColumn("grade", letter)
    )


def decay_grade(decay: DataFrame) -> DataFrame:
    """Half-life of a decay table and the letter it earns.

    The half-life is the first horizon whose mean rank correlation falls below
    half of the peak, in absolute value.
    """
    peak = F.max(F.abs("mean_rank_ic")).over(Window.partitionBy(*FACTOR))
    below = F.when(F.abs("mean_rank_ic") < F.lit(0.5) * F.col("_peak"), F.col("horizon"))
    stats = decay.withColumn("_peak", peak).groupBy(*FACTOR).agg(
        F.max("_peak").alias("_peak"),
        F.min(below).alias("_half"),
        F.max(F.when(F.col("horizon") == 1, F.col("mean_rank_ic"))).alias("h1_rank_ic"),
    )
    dead = F.col("_peak").isNull() | (F.col("_peak") == 0)
    half = F.when(~dead, F.col("_half"))
    return stats.select(
        *FACTOR,
        F.when(dead, "F").when(half.isNull(), "A").when(half >= 10, "A").when(half >= 5, "B")
        .when(half >= 2, "C").otherwise("D").alias("decay_grade"),
        F.coalesce("_peak", F.lit(0.0)).alias("peak_rank_ic"),
        half.alias("half_life"),
        F.when(~dead, F.col("h1_rank_ic")).alias("h1_rank_ic"),
    )


def segment_table(daily: DataFrame, segments: int = 4) -> DataFrame:
    """Equal-count spans of each factor's days with their statistics.

    Day i of n (from 0) falls in segment max(1, ceil(i * k / (n - 1))).
    """
    by_day = Window.partitionBy(*FACTOR).orderBy("date")
    whole = Window.partitionBy(*FACTOR)
    placed = (
        daily.filter(F.col("rank_ic").isNotNull())
        .withColumn("_i", F.row_number().over(by_day).cast("long") - 1)
        .withColumn("_n", F.count("*").over(whole))
    )
    k = F.least(F.lit(max(2, segments)).cast("long"), F.col("_n"))
    ceil_div = F.floor((F.col("_i") * k + F.col("_n") - 2) / F.greatest(F.col("_n") - 1, F.lit(1)))
    segment = F.when(F.col("_n") <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), ceil_div)).cast("int")
    std = F.stddev_samp("rank_ic")
    return (
        placed.withColumn("segment", segment)
        .groupBy(*FACTOR, "segment")
        .agg(
            F.min("date").alias("start_date"),
            F.max("date").alias("end_date"),
            F.count("*").alias("n_days"),
            F.avg("rank_ic").alias("mean_rank_ic"),
            std.alias("rank_ic_std"),
            ratio_or(None, F.avg("rank_ic"), std).alias("rank_ic_ir"),
            share(F.col("rank_ic") > 0).alias("win_rate"),
        )
    )


def segment_stability(table: DataFrame) -> DataFrame:
    mean = F.col("mean_rank_ic")
    return table.groupBy(*FACTOR).agg(
        F.count("*").alias("segment_count"),
        share(mean > 0).alias("positive_segment_ratio"),
        F.stddev_samp(mean).alias("segment_mean_std"),
        (F.max(mean) - F.min(mean)).alias("segment_mean_range"),
        F.avg("rank_ic_ir").alias("segment_ir_mean"),
        F.avg("win_rate").alias("segment_win_rate_mean"),
    )


# Points and reasons of the recommendation, checked top down.
IR_POINTS = [(0.5, 35, "rank_ic_ir >= 0.50"), (0.3, 25, "rank_ic_ir in [0.30, 0.50)"), (0.15, 15, "rank_ic_ir in [0.15, 0.30)")]
MEAN_POINTS = [(0.03, 20, "mean_rank_ic >= 0.03"), (0.015, 12, "mean_rank_ic in [0.015, 0.03)")]
WIN_POINTS = [(0.58, 15, "rank_ic_win_rate >= 58%"), (0.54, 10, "rank_ic_win_rate in [54%, 58%)"), (0.51, 5, "rank_ic_win_rate in [51%, 54%)")]
SEGMENT_POINTS = [(0.75, 12, "positive segment ratio >= 75%"), (0.5, 6, "positive segment ratio in [50%, 75%)")]


def recommend(stats: DataFrame) -> DataFrame:
    """Additive score from 0 to 100, the decision it implies and its reasons.

    ``stats`` holds one row per factor with ``rank_ic_ir``, ``mean_rank_ic``,
    ``rank_ic_win_rate``, ``positive_segment_ratio``, ``segment_mean_range`` and
    ``max_abs_corr``.
    """

    def ladder(value: Column, rungs) -> Column:
        out = None
        for mark, points, reason in rungs:
            step = F.struct(F.lit(points).alias("points"), F.lit(reason).alias("reason"))
            out = F.when(value >= mark, step) if out is None else out.when(value >= mark, step)
        return out

    def rule(condition: Column, points: int, reason: str) -> Column:
        return F.when(condition, F.struct(F.lit(points).alias("points"), F.lit(reason).alias("reason")))

    mean, corr = F.col("mean_rank_ic"), F.col("max_abs_corr")
    by_mean = ladder(mean, MEAN_POINTS).when(
        mean > 0, F.struct(F.lit(6).alias("points"), F.lit("mean_rank_ic > 0").alias("reason"))
    )
    by_corr = (
        rule(corr <= 0.5, 10, "max |corr| <= 0.50")
        .when(corr <= 0.75, F.struct(F.lit(6).alias("points"), F.lit("max |corr| in (0.50, 0.75]").alias("reason")))
        .when(corr >= 0.9, F.struct(F.lit(-8).alias("points"), F.lit("max |corr| >= 0.90 (high redundancy)").alias("reason")))
    )
    rules = F.array_compact(
        F.array(
            ladder(F.col("rank_ic_ir"), IR_POINTS),
            by_mean,
            ladder(F.col("rank_ic_win_rate"), WIN_POINTS),
            ladder(F.col("positive_segment_ratio"), SEGMENT_POINTS),
            rule(F.col("segment_mean_range") <= 0.03, 8, "segment mean range <= 0.03"),
            by_corr,
        )
    )
    total = F.aggregate("_rules", F.lit(0), lambda a, r: a + r["points"])
    score = F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("double")
    return (
        stats.withColumn("_rules", rules)
        .withColumn("score", score)
        .withColumn("reasons", F.transform("_rules", lambda r: r["reason"]))
        .withColumn(
            "decision",
            F.when(F.col("score") >= 70, "in_pool").when(F.col("score") >= 50, "watchlist").otherwise("eliminate"),
        )
        .drop("_rules")
    )


# --------------------------------------------------------------------------
# Rankings


def place(df: DataFrame, value: str, name: str, out: str) -> DataFrame:
    """1-based place by ``value`` descending, missing values last, names breaking ties."""
    rest = [c for c in df.columns if c != out]
    placed = ordinal(df.select(*rest), "_at", F.col(value).desc_nulls_last(), F.col(name).asc())
    return placed.select(*rest, (F.col("_at") + 1).cast("long").alias(out))


def rank_table(summary: DataFrame) -> DataFrame:
    return place(summary, "rank_ic_ir", "factor_name", "rank_ir")


def ranking_after(summary: DataFrame, newcomer: DataFrame) -> DataFrame:
    """The summary with the newcomer's row put in, replacing one of the same name."""
    kept = summary.join(newcomer.select("factor_name"), "factor_name", "left_anti")
    return kept.unionByName(newcomer, allowMissingColumns=True)


def ranking_change(summary: DataFrame, newcomer: DataFrame) -> DataFrame:
    """Old and new place of the newcomer itself."""
    before = rank_table(summary).select("factor_name", F.col("rank_ir").alias("old_rank_ir"))
    after = rank_table(ranking_after(summary, newcomer)).join(
        newcomer.select("factor_name"), "factor_name", "left_semi"
    )
    return after.join(before, "factor_name", "left").select(
        "factor_name",
        "old_rank_ir",
        F.col("rank_ir").alias("new_rank_ir"),
        (F.col("old_rank_ir") - F.col("rank_ir")).alias("rank_change"),
        "mean_rank_ic", "rank_ic_std", "rank_ic_ir", "rank_ic_win_rate", "valid_days",
    )


def ranking_shift(summary: DataFrame, newcomer: DataFrame) -> DataFrame:
    """Factors whose place moved when the newcomer came in."""
    before = rank_table(summary).select(
        "factor_name", F.col("rank_ir").alias("rank_before"), F.col("rank_ic_ir").alias("rank_ic_ir_before")
    )
    after = rank_table(ranking_after(summary, newcomer)).select(
        "factor_name", F.col("rank_ir").alias("rank_after"), F.col("rank_ic_ir").alias("rank_ic_ir_after")
    )
    both = before.join(after, "factor_name", "full").withColumn("rank_shift", F.col("rank_before") - F.col("rank_after"))
    return both.filter(F.coalesce("rank_shift", F.lit(0)) != 0)


def top_factors(summary: DataFrame, n: int = 10, by: str = "rank_ic_ir") -> DataFrame:
    return summary.orderBy(F.col(by).desc_nulls_last(), "factor_name").limit(n)


def leaderboard(tables: DataFrame, top: int | None = None) -> DataFrame:
    """Best first by quality score when there is one, else by IR; empty last."""
    by = "quality_score" if "quality_score" in tables.columns else "rank_ic_ir"
    tie = ["rank_ic_ir"] if by == "quality_score" and "rank_ic_ir" in tables.columns else []
    ordered = tables.orderBy(F.col(by).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in tie], "factor_name")
    return ordered.limit(top) if top else ordered


def keep_last(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the last in the given order.

    ``max_by`` combines before the shuffle, so a key with very many versions is cheap.
    """
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(key).agg(last).select(key, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*df.columns)


def sort_by_strength(summary: DataFrame, column: str = "mean_rank_ic") -> DataFrame:
    return summary.orderBy(F.abs(column).desc_nulls_last(), "factor_name")


# --------------------------------------------------------------------------
# Distributions


def grade_distribution(graded: DataFrame) -> DataFrame:
    """Count per letter, absent letters included."""
    letters = graded.sparkSession.createDataFrame([(g,) for g in GRADE_LETTERS], "grade string")
    counts = graded.groupBy("grade").agg(F.count("*").alias("n"))
    return letters.join(counts, "grade", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def family_distribution(passing: DataFrame) -> DataFrame:
    return passing.groupBy(F.coalesce("family", F.lit("unknown")).alias("family")).agg(F.count("*").alias("n"))


def generation_evolution(evaluated: DataFrame) -> DataFrame:
    """Per generation: how many were evaluated and passed, and the strongest one."""
    best = F.max_by(
        F.struct("factor_name", "mean_rank_ic", "grade"),
        F.struct(F.coalesce(F.abs("mean_rank_ic"), F.lit(-1.0)), "factor_name"),
    )
    return (
        evaluated.groupBy("generation")
        .agg(F.count("*").alias("evaluated"), F.count_if(F.col("passes")).alias("passed"), best.alias("_best"))
        .select(
            "generation", "evaluated", "passed",
            F.col("_best.factor_name").alias("best_factor"),
            F.col("_best.mean_rank_ic").alias("best_mean_rank_ic"),
            F.col("_best.grade").alias("best_grade"),
        )
    )


def run_counts(summary: DataFrame) -> DataFrame:
    """Success and error counts of a batch, mean time, and the top factor by IR."""
    ok = F.col("error").isNull()
    top = F.max_by(
        F.struct("factor_name", "rank_ic_ir"),
        F.struct(F.col("rank_ic_ir").isNotNull(), F.coalesce("rank_ic_ir", F.lit(0.0)), F.col("factor_name")),
    )
    return summary.agg(
        F.count_if(ok).alias("success_count"),
        F.count_if(~ok).alias("error_count"),
        F.avg("elapsed_sec").alias("mean_elapsed_sec"),
        top.alias("_top"),
    ).select(
        "success_count", "error_count", "mean_elapsed_sec",
        F.col("_top.factor_name").alias("top_factor"), F.col("_top.rank_ic_ir").alias("top_rank_ic_ir"),
    )
