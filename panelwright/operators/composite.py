"""Composite of many factors: feature matrix, scaled PCA, boosted trees, daily picks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions import timeseries as ts
from panelwright.operators.crosssection import CrossSection
from panelwright.operators.ic import pooled_ic
from panelwright.session import cut_lineage

# Learning settings of the composite.
LEARNING_RATE = 0.05
MAX_TREES = 200
TREE_DEPTH = 5
PATIENCE = 50
# Values each component is snapped to before the trees are grown, as many as the bins of Spark's trees.
LEVELS = 32
# Most cells of one partition while trees are grown.
CELLS = 50_000


def feature_matrix(factors: DataFrame, returns: DataFrame, names: Sequence[str]) -> DataFrame:
    """Complete rows (entity, date, one column per factor, return_next).

    One pivot replaces a chain of joins: each (entity, date) gathers its values
    in a single shuffle, and rows lacking any factor or the return drop out.
    """
    wide = factors.groupBy("entity", "date").pivot("factor_name", list(names)).agg(F.first("value"))
    return wide.join(returns.select("entity", "date", "return_next"), ["entity", "date"]).dropna(
        subset=[*names, "return_next"]
    )


def feature_rows(wide: DataFrame, names: Sequence[str], periods: int = 1) -> DataFrame:
    """:func:`feature_matrix` of rows that have all factors side by side and carry ``close``.

    No row has to be taken apart, gathered in a hash table and joined again: one sort
    by entity adds the return.
    """
    ahead = ts.forward_return("close", periods, ts.entity_window())
    return wide.select("entity", "date", *names, ahead.alias("return_next")).dropna(subset=[*names, "return_next"])


def forward_returns(panel: DataFrame, periods: int = 1) -> DataFrame:
    w = ts.entity_window()
    return panel.select("entity", "date", ts.forward_return("close", periods, w).alias("return_next")).filter(
        F.col("return_next").isNotNull()
    )


def series_matrix(series: DataFrame, names: Sequence[str], value: str = "LS") -> DataFrame:
    """Feature rows by date from one return series per factor.

    The target is the next date's mean over the series that have a value; missing
    features become 0 and dates without any value are left out.
    """
    wide = series.groupBy("date").pivot("factor_name", list(names)).agg(F.first(value)).dropna(how="all", subset=list(names))
    known = sum((F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names), F.lit(0))
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0))
    # one row per date: the date type bounds this single ordered partition
    by_date = Window.partitionBy(F.lit(0)).orderBy("date")
    with_target = wide.withColumn("_mean", total / known).withColumn("return_next", F.lead("_mean").over(by_date))
    return with_target.filter(F.col("return_next").isNotNull()).select(
        "date", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names], "return_next"
    )


def split_date(df: DataFrame, test_share: float = 0.2) -> Column:
    """Date at which the last ``test_share`` of the covered time begins."""
    limits = df.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = F.datediff("b", "a")
    # rounded up: rows strictly before the exact instant belong to the training part
    return limits.select(F.expr("a") .alias("a"), "b", days.alias("d")).select(
        F.date_add("a", F.ceil(F.col("d") * F.lit(1.0 - test_share)).cast("int")).alias("s")
    ).scalar()


def time_split(df: DataFrame, test_share: float = 0.2, test_start: str | None = None) -> tuple[DataFrame, DataFrame]:
    at = F.lit(test_start).cast("date") if test_start else split_date(df, test_share)
    return df.filter(F.col("date") < at), df.filter(F.col("date") >= at)


def projection(names: Sequence[str], components: int) -> list:
    """Scaling and projection on at most as many components as there are factors."""
    return standardiser(names) + [PCA(k=min(components, len(names)), inputCol="_scaled", outputCol="pcs")]


def standardiser(names: Sequence[str]) -> list:
    return [
        VectorAssembler(inputCols=list(names), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
    ]


class Boosted(NamedTuple):
    """A fitted composite, the loss on the tail after each tree, and the places (from 0) of the best and of the last tried."""

    model: PipelineModel
    losses: list[float]
    best: int
    stopped: int


def stopping_point(losses: Sequence[float], patience: int) -> tuple[int, int]:
    """Best iteration, and the one at which ``patience`` further ones had brought nothing better."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best, i
    return best, len(losses) - 1


def levels(rows: DataFrame, features: str, size: int) -> list[list[float]]:
    """For each place of a vector the values its rows are snapped to: quantiles, least and greatest among them."""
    parts = rows.select(*[vector_to_array(features)[j].alias(f"_{j}") for j in range(size)])
    found = parts.approxQuantile(parts.columns, [k / (LEVELS - 1) for k in range(LEVELS)], 0.001)
    return [sorted(set(values)) for values in found]


def cells(rows: DataFrame, at: list[list[float]], features: str, label: str) -> DataFrame:
    """(features, label, weight): rows whose components snap to the same levels as one, with mean label and count.

    A tree cuts half-way between two levels and a row snaps to the level on its side of
    every such cut, so rows of a cell share all leaves.  The spread of labels inside
    cells is the same on both sides of a gain and the residual of a mean is the mean of
    residuals: with squared loss the trees on cells are those on all rows, cut there.
    """
    part = vector_to_array(features)
    snapped = []
    for j, values in enumerate(at):
        level = F.lit(values[0])
        for low, high in zip(values, values[1:]):
            # the cut as the trees place it; what equals it goes left
            level = F.when(part[j] > (low + high) / 2.0, F.lit(high)).otherwise(level)
        snapped.append(level.alias(f"_{j}"))
    names = [f"_{j}" for j in range(len(at))]
    grouped = rows.select(*snapped, label).groupBy(*names).agg(F.avg(label).alias(label), F.count("*").cast("double").alias("weight"))
    return grouped.select(array_to_vector(F.array(*names)).alias(features), label, "weight")


def fit_boosted(
    train: DataFrame,
    names: Sequence[str],
    components: int = 5,
    trees: int = MAX_TREES,
    depth: int = TREE_DEPTH,
    stop_share: float = 0.2,
    patience: int = PATIENCE,
    seed: int = 42,
) -> Boosted:
    """Scale and project on the training part, boost on its start, stop by the loss on its tail.

    The tail is the last ``stop_share`` of the training time, so the test part takes
    no part in the fit.  The mean squared error on the tail is taken after every tree;
    the best iteration before ``patience`` ones without gain is kept.  With a single date
    there is no tail, and all trees are fitted on all rows.  Trees depend on
    the seed and their place only, so fitting anew up to that place gives the same ones.
    All rows are counted into :func:`cells` once; every level of every tree reads those,
    of which three components have 32,768 at most.
    """
    ready = Pipeline(stages=projection(names, components)).fit(train)
    at = split_date(train, stop_share)
    # read for the levels, the cells and the losses
    rows = cut_lineage(ready.transform(train).select((F.col("date") >= at).alias("_tail"), "pcs", "return_next"))
    start, tail = rows.filter(~F.col("_tail")), rows.filter("_tail")
    stopping = not (start.isEmpty() or tail.isEmpty())
    learnt = start if stopping else rows
    counted = cut_lineage(cells(learnt, levels(learnt, "pcs", min(components, len(names))), "pcs", "return_next"))
    n = counted.count()
    grown = counted.repartition(n // CELLS + 1)
    # Spark looks for cuts in maxBins ** 2 rows: with all cells it finds every one
    boost = GBTRegressor(
        featuresCol="pcs", labelCol="return_next", weightCol="weight", predictionCol="composite_score", stepSize=LEARNING_RATE, maxIter=trees, maxDepth=depth,
        maxBins=max(LEVELS, math.isqrt(n) + 1), seed=seed)
    if not stopping:
        return Boosted(PipelineModel([*ready.stages, boost.fit(grown)]), [], trees - 1, trees - 1)
    count = min(trees, patience + 1)
    while True:
        tried = boost.copy({boost.maxIter: count}).fit(grown)
        losses = list(tried.evaluateEachIteration(tail.withColumn("weight", F.lit(1.0)), "squared"))
        best, stopped = stopping_point(losses, patience)
        if count == trees or stopped - best >= patience:
            break
        # not decided yet: twice as many, of which the first are the same
        count = min(trees, 2 * count)
    kept = tried if best == len(losses) - 1 else boost.copy({boost.maxIter: best + 1}).fit(grown)
    return Boosted(PipelineModel([*ready.stages, kept]), losses[: stopped + 1], best, stopped)


def fit_composite(train: DataFrame, names: Sequence[str], **settings) -> PipelineModel:
    """The model of :func:`fit_boosted`."""
    return fit_boosted(train, names, **settings).model


def reconstructed(model: PipelineModel, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Scaled features put together again from their components; exact if all components are kept."""
    loadings = next(s for s in model.stages if hasattr(s, "explainedVariance")).pc.toArray()
    out = model.transform(df).withColumn("_p", vector_to_array("pcs"))
    back = lambda row: reduce(add, [F.col("_p")[j] * F.lit(float(w)) for j, w in enumerate(row)])
    return out.select(*[c for c in df.columns if c not in names], *[back(loadings[i]).alias(n) for i, n in enumerate(names)])


def explained_variance(model: PipelineModel) -> list[float]:
    pca = next(s for s in model.stages if hasattr(s, "explainedVariance"))
    return list(pca.explainedVariance.toArray())


def composite_scores(model: PipelineModel, df: DataFrame, keys: Sequence[str] = ("entity", "date")) -> DataFrame:
    return model.transform(df).select(*keys, "composite_score", "return_next")


def composite_metrics(scores: DataFrame, cross: CrossSection) -> DataFrame:
    """Pooled correlations per ``split``."""
    return pooled_ic(scores, cross, ["split"], "composite_score", "return_next")


def composite_daily(scores: DataFrame) -> DataFrame:
    """Date-level score and return with the sign strategy on top."""
    daily = scores.groupBy("date").agg(
        F.avg("composite_score").alias("composite_score"), F.avg("return_next").alias("return_next")
    )
    return daily.select(
        "date", "composite_score", "return_next",
        F.col("return_next").alias("daily_return_benchmark"),
        (F.signum("composite_score") * F.col("return_next")).alias("daily_return_strategy"),
    )


def strategy_series(daily: DataFrame) -> DataFrame:
    """Benchmark and strategy as one long table of return series."""
    return daily.select(
        "date",
        F.expr(
            "stack(2, 'benchmark_equal_weight', daily_return_benchmark, "
            "'strategy_long_short_by_score', daily_return_strategy) as (series, ret)"
        ),
    )


def daily_topk(factors: DataFrame, k: int = 5) -> DataFrame:
    """Per date the ``k`` factors with the highest mean value, in columns rank1..rankk."""
    means = factors.groupBy("date", "factor_name").agg(F.avg("value").alias("_mean")).filter(F.col("_mean").isNotNull())
    order = Window.partitionBy("date").orderBy(F.col("_mean").desc(), "factor_name")
    placed = means.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)
    columns = []
    for r in range(1, k + 1):
        at = F.col("_place") == r
        columns += [
            F.max(F.when(at, F.col("factor_name"))).alias(f"rank{r}_factor"),
            F.max(F.when(at, F.col("_mean"))).alias(f"rank{r}_value"),
        ]
    return placed.groupBy("date").agg(*columns)
