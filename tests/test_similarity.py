"""Close pairs found by bounds equal all pairs ranked exactly, and rank few rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import similarity

SCHEMA = "factor_name string, entity string, date date, value double"


def series(spark, n_items, n_keys, missing, seed, groups=4, noise=0.15, ties=False):
    """Items of a few common signals; of each, ``missing`` of the keys are left out."""
    rng = np.random.default_rng(seed)
    signals = rng.normal(size=(groups, n_keys))
    rows = []
    for i in range(n_items):
        v = signals[i % groups] * (-1) ** (i // groups % 2) + noise * (1 + i // groups) * rng.normal(size=n_keys)
        if ties:
            v = np.round(v)
        keep = rng.random(n_keys) >= missing
        rows += [(f"f{i:02d}", f"e{k % 40}", int(k // 40), float(v[k])) for k in np.flatnonzero(keep)]
    frame = spark.createDataFrame(rows, "factor_name string, entity string, day int, value double")
    return frame.select("factor_name", "entity", F.date_add(F.lit("2000-01-01").cast("date"), F.col("day")).alias("date"), "value").cache()


@pytest.mark.parametrize(("missing", "ties"), [(0.0, False), (0.1, False), (0.4, True)])
def test_pairs_above_a_threshold_equal_all_pairs(spark, missing, ties):
    factors = series(spark, 20, 320, missing, 1, ties=ties)
    everything = similarity.value_similarity(factors, min_overlap=50).collect()
    close = {(r["left"], r["right"]): (r["n"], r["similarity"]) for r in similarity.value_similarity(factors, min_overlap=50, at_least=0.8).collect()}
    want = {(r["left"], r["right"]): (r["n"], r["similarity"]) for r in everything if r["similarity"] >= 0.8}
    assert close == want and 0 < len(want) < len(everything)


def test_bounds_hold_for_every_pair(spark):
    factors = series(spark, 16, 200, 0.2, 2, ties=True)
    exact = {(r["left"], r["right"]): r for r in similarity.value_similarity(factors, min_overlap=2).collect()}
    known = factors.select(F.col("factor_name").alias("item"), "entity", "date", F.col("value").alias("v"))
    bounds = similarity.pair_bounds(known, ["entity", "date"], None, True).collect()
    assert len(bounds) == 16 * 15
    for b in bounds:
        r = exact[min(b["left"], b["right"]), max(b["left"], b["right"])]
        assert b["n"] == r["n"] and r["similarity"] <= b["most"] + 1e-9


def test_one_side_only(spark):
    factors = series(spark, 12, 120, 0.1, 3)
    names = spark.createDataFrame([("f01",), ("f05",), ("absent",)], "factor_name string")
    got = {(r["left"], r["right"], r["similarity"]) for r in similarity.value_similarity(factors, 30, against=names).collect()}
    everything = similarity.value_similarity(factors, 30).collect()
    assert got == {(r["left"], r["right"], r["similarity"]) for r in everything if {r["left"], r["right"]} & {"f01", "f05"}}
    assert similarity.value_similarity(factors.limit(0), 30, against=names).count() == 0


def test_fifty_supports_rank_few_rows(spark):
    """With every support different, at most three times the rows that equal supports rank."""

    def ranked_rows(missing):
        factors = series(spark, 50, 400, missing, 4, groups=25, noise=0.05)
        known = factors.select(F.col("factor_name").alias("item"), "entity", "date", F.col("value").alias("v"))
        classes = similarity.support_classes(known, "item", ["entity", "date"])
        near = similarity.pair_bounds(known, ["entity", "date"], None, True).filter("most >= 0.9")
        pairs = near.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()
        needed = similarity.needed_rankings(pairs, classes)
        met = similarity._meetings(known, classes, ["entity", "date"], needed)
        return known.count() + met.count(), classes.select("class").distinct().count()

    (equal, one), (different, fifty) = ranked_rows(0.0), ranked_rows(0.05)
    assert (one, fifty) == (1, 50) and different <= 3 * equal


@pytest.mark.parametrize(("range_rows", "most_items"), [(1_000_000, 60), (7, 60), (7, 3)])
def test_every_pair_by_one_sort_of_each_series(spark, monkeypatch, range_rows, most_items):
    """Equal and different key sets, ties, both zeros, many value ranges; more series than are sorted go the other way."""
    rng = np.random.default_rng(5)
    rows = []
    for i, missing in enumerate((0.0, 0.0, 0.3, 0.6, 1.0)):
        v = rng.normal(size=200).round(i % 3) * (1 if i else -1)
        keep = rng.random(200) >= missing
        rows += [(f"f{i}", f"e{k % 40}", int(k // 40), float(v[k])) for k in np.flatnonzero(keep)]
    frame = spark.createDataFrame(rows, "factor_name string, entity string, day int, value double")
    factors = frame.select("factor_name", "entity", F.date_add(F.lit("2000-01-01").cast("date"), F.col("day")).alias("date"), "value")
    monkeypatch.setattr(similarity, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(similarity, "SORTED_ITEMS", most_items)
    if most_items == 60:
        monkeypatch.setattr(similarity, "_meetings", lambda *a: pytest.fail("ranked once per class"))
        monkeypatch.setattr(similarity, "_pairs_alone", lambda *a: pytest.fail("ranked once per pair"))
    got = {(r["left"], r["right"]): (r["n"], r["similarity"]) for r in similarity.value_similarity(factors, 2).collect()}
    p = frame.toPandas().pivot(index=["entity", "day"], columns="factor_name", values="value")
    names = sorted(p.columns)
    want = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    assert set(got) == set(want) and len(want) == 6
    for a, b in want:
        both = p[[a, b]].dropna().rank()
        assert got[a, b][0] == len(both) and got[a, b][1] == pytest.approx(abs(both[a].corr(both[b])), abs=1e-12)
    assert similarity.value_similarity(factors.limit(0), 2).count() == 0


def test_keys_that_span_batches_are_added_once():
    """Sums do not depend on where batches are cut."""
    rng = np.random.default_rng(6)
    keys = np.sort(np.r_[np.arange(50), np.arange(0, 50, 2)])
    no = np.array([0 if i == 0 or keys[i] != keys[i - 1] else 1 for i in range(len(keys))])
    rows = pd.DataFrame({"row": keys, "no": no, "_t0": rng.integers(-9, 9, len(keys))})
    whole, cut = (pd.concat(similarity._row_sums(iter([rows.iloc[i: i + n] for i in range(0, len(rows), n)]), np.array([0, 0]))) for n in (len(rows), 1))
    assert whole.equals(cut) and whole["n"].tolist() == [25]
