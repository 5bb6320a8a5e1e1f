"""Batches over many factor sources: a failure stays with its factor, a manifest says what is done.

Every factor is read once by itself, which costs no shuffle; those that cannot be read
to their end stand aside and all others are evaluated in one job.  Where that job
still fails, its factors are halved until the failing ones stand alone, and the
others keep their results.  Daily tables
replace whole folders per factor and are only believed once the manifest names them,
so a run that broke down can simply be run again.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from py4j.protocol import Py4JError

from panelwright.operators import ic, screen
from panelwright.sources import sinks
from panelwright.sources.factor_files import normalise_factor
from panelwright.sources.panel import FLAGS, KEY, Panel

Source = Callable[[SparkSession], DataFrame]
MANIFEST = (
    "factor_name string, error string, elapsed_sec double, valid_days long, matched_rows long, batch_factors int, "
    "run_id string, finished_at timestamp"
)
NO_DAYS = "no valid days"


def stored(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A Parquet table, or None where there is none yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The latest entry of every factor."""
    found = stored(spark, f"{out}/manifest", MANIFEST)
    return screen.keep_last(found if found is not None else spark.createDataFrame([], MANIFEST), "factor_name", "finished_at")


def daily_results(spark: SparkSession, out: str) -> DataFrame:
    """Daily tables of the factors that the manifest calls done."""
    done = manifest(spark, out).filter("error IS NULL").select("factor_name")
    return spark.read.parquet(f"{out}/daily").join(done, "factor_name", "left_semi")


def _told(error: Exception) -> str:
    """One line of a failure: the one with Spark's error condition where a trace holds one, else the first."""
    text = str(error).strip()
    condition = re.search(r"\[[A-Z0-9_]+(\.[A-Z0-9_]+)*\] [^\n]*", text)
    line = condition.group() if condition else text.partition("\n")[0]
    return f"{type(error).__name__}: {line}"[:500]


class Batch:
    """One run over named sources; see :func:`run_batch`."""

    def __init__(self, panel: Panel, out: str, min_names: int, next_day: bool):
        self.panel, self.out, self.min_names, self.next_day = panel, out, min_names, next_day
        self.rows: list[tuple] = []

    def note(self, name: str, error: str | None, elapsed: float, days: int = 0, matched: int = 0, factors: int = 1) -> None:
        self.rows.append((name, error, elapsed, days, matched, factors))

    def load(self, spark: SparkSession, sources: Mapping[str, Source]) -> dict[str, DataFrame]:
        """The sources that can be opened and have the form of a factor; the others are noted."""
        found = {}
        for name, source in sources.items():
            start = time.monotonic()
            try:
                df = normalise_factor(source(spark).drop("factor_name"), name)
                df.schema  # noqa: B018  resolves the plan here and not in the job of all
                found[name] = df
            except (PySparkException, Py4JError, ValueError, KeyError, OSError) as e:
                self.note(name, _told(e), time.monotonic() - start)
        return found

    def readable(self, factors: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """The factors whose rows can be read to the end; the others are noted."""
        found = {}
        for name, df in factors.items():
            start = time.monotonic()
            try:
                df.write.format("noop").mode("overwrite").save()
                found[name] = df
            except (PySparkException, Py4JError) as e:
                self.note(name, _told(e), time.monotonic() - start)
        return found

    def evaluate(self, spark: SparkSession, factors: Mapping[str, DataFrame]) -> None:
        """One job for all; on failure one for each half."""
        names = list(factors)
        if not names:
            return
        start = time.monotonic()
        try:
            merged = ic.merge_factors(reduce(DataFrame.unionByName, factors.values()), self.panel.df.select(*KEY, "close", *FLAGS))
            daily = ic.daily_ic(merged, self.panel.cross_section("factor_name"), min_names=self.min_names, next_day=self.next_day)
            sinks.write_daily(daily, f"{self.out}/daily")
        except (PySparkException, Py4JError) as e:
            if len(names) == 1:
                self.note(names[0], _told(e), time.monotonic() - start)
                return
            half = len(names) // 2
            for part in (names[:half], names[half:]):
                self.evaluate(spark, {n: factors[n] for n in part})
            return
        # one job did them all: each bears an equal share of its time
        elapsed = (time.monotonic() - start) / len(names)
        found = {r["factor_name"]: (r["days"], r["matched"]) for r in daily_counts(spark, f"{self.out}/daily", names).collect()}
        for name in names:
            self.note(name, None if name in found else NO_DAYS, elapsed, *found.get(name, (0, 0)), factors=len(names))


def daily_counts(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    found = stored(spark, path)
    if found is None or "factor_name" not in found.columns:
        return spark.createDataFrame([], "factor_name string, days long, matched long")
    return found.filter(F.col("factor_name").isin(list(names))).groupBy("factor_name").agg(F.count("*").alias("days"), F.sum("n_stocks").alias("matched"))


def run_batch(
    panel: Panel,
    sources: Mapping[str, Source],
    out: str,
    min_names: int = ic.MIN_NAMES,
    next_day: bool = True,
    retry_failed: bool = False,
    run_id: str | None = None,
) -> DataFrame:
    """Evaluate every source that the manifest below ``out`` does not list and return its manifest.

    A source gives (entity, date, one value column) when called; what it raises, and
    what fails in its tasks, becomes its ``error``, and so does a factor without a
    valid day.  ``elapsed_sec`` is the time of the job that settled the factor shared
    evenly by its ``batch_factors``; ``matched_rows`` are the rows behind its days.  With ``retry_failed``
    factors listed with an error are tried again.
    """
    spark = panel.df.sparkSession
    listed = manifest(spark, out)
    if retry_failed:
        listed = listed.filter("error IS NULL")
    done = {r["factor_name"] for r in listed.select("factor_name").collect()}
    batch = Batch(panel, out, min_names, next_day)
    batch.evaluate(spark, batch.readable(batch.load(spark, {n: s for n, s in sources.items() if n not in done})))
    if batch.rows:
        table = spark.createDataFrame(batch.rows, MANIFEST.partition(", run_id")[0])
        table = table.withColumn("run_id", F.lit(run_id or uuid.uuid4().hex)).withColumn("finished_at", F.current_timestamp())
        table.write.mode("append").parquet(f"{out}/manifest")
    return manifest(spark, out)


def batch_summary(spark: SparkSession, out: str) -> DataFrame:
    """Graded summary of all factors listed, those with an error having no metrics."""
    listed = manifest(spark, out).select("factor_name", "error", "elapsed_sec")
    graded = screen.grade(ic.factor_summary(daily_results(spark, out))).drop("failed")
    return listed.join(graded, "factor_name", "left")
