"""Early stopping: losses recomputed from stored predictions, the kept model is the best iteration's."""

import duckdb
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelwright.operators import composite


@pytest.mark.parametrize(
    ("losses", "patience", "want"),
    [([3.0, 2.0, 1.0], 2, (2, 2)), ([1.0, 2.0, 3.0, 0.5], 2, (0, 2)), ([2.0, 1.0, 1.0, 1.0, 0.5], 3, (4, 4)), ([2.0, 1.0, 1.0, 1.0, 1.0, 0.5], 3, (1, 4)), ([1.0], 5, (0, 0))])
def test_stopping_point(losses, patience, want):
    assert composite.stopping_point(losses, patience) == want


@pytest.fixture(scope="module")
def rows(spark):
    noise = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(2001)) / 1000.0 - 1)
    df = spark.range(1500).select(
        F.concat(F.lit("e"), (F.col("id") % 30).cast("string")).alias("entity"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 30).cast("int")).alias("date"),
        *[noise(k).alias(f"f{k}") for k in range(3)], noise(9).alias("_n"))
    return df.withColumn("return_next", F.col("f0") * F.col("f1") + 0.8 * F.col("_n")).drop("_n").cache()


def test_losses_equal_those_of_stored_predictions(spark, rows, tmp_path):
    names = ["f0", "f1", "f2"]
    fitted = composite.fit_boosted(rows, names, components=3, trees=30, depth=3, patience=6)
    assert len(fitted.losses) == fitted.stopped + 1 and fitted.losses[fitted.best] == min(fitted.losses)
    assert fitted.stopped == 29 or fitted.stopped - fitted.best == 6
    trees = fitted.model.stages[-1]
    assert trees.getNumTrees == fitted.best + 1
    at = composite.split_date(rows, 0.2)
    tail = rows.filter(F.col("date") >= at)
    ready = tail
    for stage in fitted.model.stages[:-1]:
        ready = stage.transform(ready)
    stored = ready.select("return_next", vector_to_array("pcs").alias("x"), "pcs")
    # the prediction after each tree, one column each
    for i, tree in enumerate(trees.trees):
        tree = tree.copy({tree.predictionCol: f"t{i}"})
        stored = tree.setFeaturesCol("pcs").transform(stored)
    path = f"{tmp_path}/predictions"
    stored.select("return_next", *[f"t{i}" for i in range(fitted.best + 1)]).write.parquet(f"file://{path}")
    for i, loss in enumerate(fitted.losses[: fitted.best + 1]):
        total = " + ".join(f"{trees.treeWeights[k]} * t{k}" for k in range(i + 1))
        again = duckdb.sql(f"SELECT avg((return_next - ({total})) ** 2) FROM '{path}/*.parquet'").fetchall()[0][0]
        assert again == pytest.approx(loss, rel=1e-9)


def test_trees_on_cells_are_those_on_all_rows(spark):
    """Every level of every tree reads cells; on rows that lie on their levels the trees are the library's own."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    value = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("double")
    raw = spark.range(6000).select(value(1, 6).alias("a"), value(2, 5).alias("b"), value(3, 101).alias("_n"))
    raw = raw.withColumn("return_next", F.col("a") * F.col("b") + F.col("_n") / 10)
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="pcs").transform(raw).cache()
    at = composite.levels(rows, "pcs", 2)
    assert at == [[float(x) for x in range(6)], [float(x) for x in range(5)]]
    few = composite.cells(rows, at, "pcs", "return_next")
    assert few.count() == 30 and few.agg(F.sum("weight")).first()[0] == 6000
    settings = dict(featuresCol="pcs", labelCol="return_next", predictionCol="p", maxIter=8, maxDepth=3, seed=1)
    plain, quick = GBTRegressor(**settings).fit(rows), GBTRegressor(weightCol="weight", **settings).fit(few)
    both = quick.setPredictionCol("q").transform(plain.transform(few))
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-9


def test_cuts_of_the_model_are_those_of_the_cells(spark, rows):
    fitted = composite.fit_boosted(rows, ["f0", "f1", "f2"], components=3, trees=30, depth=3, patience=6)
    ready = rows
    for stage in fitted.model.stages[:-1]:
        ready = stage.transform(ready)
    ready = ready.filter(F.col("date") < composite.split_date(rows, 0.2)).select("pcs", "return_next")
    at = composite.levels(ready, "pcs", 3)
    mids = [{(x + y) / 2.0 for x, y in zip(v, v[1:])} for v in at]
    few = composite.cells(ready, at, "pcs", "return_next").withColumn("id", F.monotonically_increasing_id()).cache()
    for tree in fitted.model.stages[-1].trees:
        node = [tree._call_java("rootNode")]
        while node:
            now = node.pop()
            if now.subtreeDepth():
                assert now.split().threshold() in mids[now.split().featureIndex()]
                node += [now.leftChild(), now.rightChild()]
    assert few.agg(F.sum("weight")).first()[0] == ready.count()


def test_no_tail_keeps_all_trees(spark, rows):
    fitted = composite.fit_boosted(rows.filter("date = DATE'2020-01-01'"), ["f0", "f1"], components=2, trees=3, depth=2, stop_share=0.0)
    assert fitted.losses == [] and fitted.model.stages[-1].getNumTrees == 3


def test_rows_come_back_from_all_components(spark, rows):
    from pyspark.ml import Pipeline

    names = ["f0", "f1", "f2"]
    model = Pipeline(stages=composite.projection(names, 3)).fit(rows)
    back = composite.reconstructed(model, rows, names).join(
        model.transform(rows).select("entity", "date", vector_to_array("_scaled").alias("s")), ["entity", "date"])
    off = back.select(*[F.max(F.abs(F.col(n) - F.col("s")[i])).alias(n) for i, n in enumerate(names)]).first()
    assert max(off) < 1e-9
