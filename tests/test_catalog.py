"""Definition tables: text, novelty, the sequential diversity rule, survivors, names."""

import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import catalog
from panelwright.plans import recipes

CANDIDATE = (
    "factor_name string, family string, expression string, required_fields array<string>, lookback_windows array<int>, grade string, "
    "mean_rank_ic double, validation_rank_ic double, test_rank_ic double, recent_rank_ic double, novelty_score double, max_similarity double, "
    "complexity_score int, error string, diversity_rejected boolean"
)


def cand(name, expression="rank(close)", family="momentum", fields=("close",), windows=(5,), grade="A", ric=0.05, val=0.0, test=0.0,
         recent=0.0, novelty=1.0, similar=0.0, complexity=10, error=None, rejected=False):
    return (name, family, expression, list(fields), list(windows), grade, ric, val, test, recent, novelty, similar, complexity, error, rejected)


def table(spark, rows):
    return catalog.describe(spark.createDataFrame(rows, CANDIDATE))


def test_parameter_variants_share_a_structure(spark):
    a = "winsorize(-ts_return(close, 5), lower=0.01, upper=0.99)"
    b = " winsorize( -ts_return(close, 20), lower = 0.02, upper=0.98 ) ".replace(" = ", "=")
    got = table(spark, [cand("a", a), cand("b", b)]).select("structure_signature").distinct().collect()
    assert [r[0] for r in got] == ["winsorize(-ts_return(close,N))"]


def test_novelty_of_a_tweak_and_of_a_new_idea(spark):
    base = table(spark, [cand("base", "rank(ts_return(close, 20))")])
    new = table(spark, [
        cand("tweak", "rank(ts_return(close, 60))"),
        cand("fresh", "rank(delta(close, 10) / (ts_mean(volume, 10) + 1))", family="volume", fields=("close", "volume")),
        cand("alien", "abs(open)", family=None, fields=("open",)),
    ]).drop("novelty_score")
    got = {r["factor_name"]: r["novelty_score"] for r in catalog.novelty(new, base).collect()}
    assert got == pytest.approx({"tweak": 0.0, "fresh": 0.8375, "alien": 1.0})
    alone = catalog.novelty(new, base.limit(0)).select("novelty_score").distinct().collect()
    assert [r[0] for r in alone] == [1.0]


def test_novelty_counts_only_earlier_references(spark):
    both = table(spark, [cand("first", "rank(close)"), cand("second", "rank(close)")]).drop("novelty_score").withColumn(
        "at", F.when(F.col("factor_name") == "first", 1).otherwise(2))
    got = {r["factor_name"]: r["novelty_score"] for r in catalog.novelty(both, both, before="at").collect()}
    assert got == {"first": 1.0, "second": 0.0}


def sequential(rows, value, series, gates):
    """The rule as a loop over candidates, best first."""
    order = sorted(rows, key=lambda r: (-{"A": 5, "B": 4, "C": 3, "D": 2}[r["grade"]], -abs(r["mean_rank_ic"]), r["complexity_score"], r["factor_name"]))
    accepted, out = [], {}
    for r in order:
        text = r["expression"].replace(" ", "")
        if any(text == a["expression"].replace(" ", "") for a in accepted):
            out[r["factor_name"]] = (True, "same_expression")
            continue
        if any(r["structure_signature"] == a["structure_signature"] for a in accepted):
            out[r["factor_name"]] = (True, "same_structure")
            continue
        met = {a["factor_name"]: value.get(frozenset((r["factor_name"], a["factor_name"])), 0.0) for a in accepted}
        ic = {a["factor_name"]: series.get(frozenset((r["factor_name"], a["factor_name"])), 0.0) for a in accepted}
        best = max(met.items(), key=lambda kv: kv[1], default=("", 0.0))  # of equal ones the first accepted
        name = best[0] if best[1] > 0 else ""
        if best[1] >= gates.value_corr:
            out[r["factor_name"]] = (True, name)
        elif max(ic.values(), default=0.0) >= gates.ic_corr:
            out[r["factor_name"]] = (True, name or "similar_ic_series")
        else:
            out[r["factor_name"]] = (False, name)
            if r["grade"] in ("A", "B") and abs(r["mean_rank_ic"]) >= 0.02:
                accepted.append(r)
    return out


def test_diversity_rounds_equal_the_sequential_rule(spark):
    rng = random.Random(8)
    calls = ["rank(close)", "rank(delta(close, 5))", "zscore(volume)", "rank(ts_mean(close, 8))", "log1p_abs(amount)", "rank( close )"]
    rows = []
    for k in range(24):
        text = calls[k % 6] if k % 3 == 0 else f"rank(ts_mean(f{k}x, {k + 2}))"
        rows.append(cand(f"c{k:02d}", text, grade=rng.choice("AABC"), ric=rng.choice([0.01, 0.03, 0.05, -0.04]), complexity=rng.randint(3, 9)))
    names = [r[0] for r in rows]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    value = {frozenset(p): round(rng.random(), 3) for p in pairs if rng.random() < 0.7}
    series = {frozenset(p): round(rng.random(), 3) for p in pairs if rng.random() < 0.5}
    gates = catalog.Gates(value_corr=0.85, ic_corr=0.9)

    def frame(scores):
        return spark.createDataFrame([(*sorted(k), v) for k, v in scores.items()], "left string, right string, similarity double")

    described = table(spark, rows)
    got = {r["factor_name"]: (r["diversity_rejected"], r["most_similar_to"]) for r in catalog.diversity_flags(
        described, described.limit(0), frame(value), frame(series), gates).collect()}
    want = sequential([r.asDict() for r in described.collect()], value, series, gates)
    assert got == want
    assert {True, False} == {v[0] for v in got.values()}


def test_rows_turned_away_before_pass_unchanged(spark):
    rows = table(spark, [cand("a", "rank(close)", ric=0.05), cand("b", "rank(close)", ric=0.04), cand("c", "zscore(volume)", ric=0.03)])
    before = rows.withColumn("diversity_rejected", F.col("factor_name") == "c").withColumn("max_similarity", F.lit(0.97)).withColumn(
        "ic_series_max_similarity", F.lit(0.5)).withColumn("most_similar_to", F.lit("older"))
    pairs = spark.createDataFrame([("a", "c", 0.1)], "left string, right string, similarity double")
    got = {r["factor_name"]: (r["diversity_rejected"], r["max_similarity"], r["ic_series_max_similarity"], r["most_similar_to"])
           for r in catalog.diversity_flags(before, before.limit(0), pairs, pairs).collect()}
    assert got["c"] == (True, 0.97, 0.5, "older")
    assert got["b"] == (True, 1.0, 0.0, "same_expression") and got["a"][0] is False


def test_survivors_when_nobody_passes(spark):
    pool = table(spark, [cand("a", grade="F", ric=0.001), cand("b", grade="D", ric=0.002), cand("c", grade="F", ric=0.003)])
    got = [r["factor_name"] for r in catalog.select_survivors(pool, 2).orderBy("pick").collect()]
    assert got == ["b", "c"]


def test_survivors_take_each_niche_once_then_special_picks(spark):
    pool = table(spark, [
        cand("best", val=0.09, similar=0.9), cand("same_niche", val=0.08, similar=0.5),
        cand("other_niche", family="volume", val=0.02, similar=0.7), cand("lonely", val=0.03, similar=0.0),
        cand("recent", val=0.04, recent=0.5, similar=0.6), cand("outsider", grade="F", ric=0.001, recent=0.4),
    ])
    got = [r["factor_name"] for r in catalog.select_survivors(pool, 6).orderBy("pick").collect()]
    assert got == ["best", "other_niche", "lonely", "recent", "outsider", "same_niche"]


def test_names_resolve_by_suffix_then_substring(spark):
    names = spark.createDataFrame([("set_X_item_1",), ("item_1",), ("pre_item_2_post",), ("nothing",)], "candidate string")
    known = spark.createDataFrame([("item_1",), ("X_item_1",), ("item_2",), ("item",)], "factor_name string")
    got = {r["candidate"]: r["resolved"] for r in catalog.resolve_name(names, known).collect()}
    assert got == {"set_X_item_1": "X_item_1", "item_1": "item_1", "pre_item_2_post": "item_2", "nothing": "nothing"}


def test_odd_names_resolve_to_themselves(spark):
    names = spark.createDataFrame([("",), (None,), ("ab" * 3000,), ("ab",)], "candidate string")
    known = spark.createDataFrame([("",), (None,), ("bab",)], "factor_name string")
    got = {r["candidate"]: r["resolved"] for r in catalog.resolve_name(names, known).collect()}
    assert got == {"": "", None: None, "ab" * 3000: "bab", "ab": "ab"}
    nothing = {r["candidate"]: r["resolved"] for r in catalog.resolve_name(names, known.limit(0)).collect()}
    assert nothing == {"": "", None: None, "ab" * 3000: "ab" * 3000, "ab": "ab"}


def test_every_recipe_builds_and_reports_itself(spark):
    rows = recipes.catalog_frame(spark).collect()
    assert len(rows) == 14
    assert {r["recipe_id"] for r in rows} == {r.recipe_id for r in recipes.RECIPES}
    mean = recipes.by_id("volume_price_divergence_10d").term()
    assert mean.text == "rank(delta(close, 10) / (ts_mean(volume, 10) + 1))"
    assert mean.fields == ["close", "volume"] and mean.windows == [10]


def test_family_choices_are_padded_when_few(spark):
    table_ = recipes.catalog_frame(spark)
    assert recipes.recipes_for_family(table_, "momentum").count() == 4
    assert recipes.recipes_for_family(table_, "liquidity").count() == 14
    first = recipes.recipes_for_family(table_, "liquidity").filter("choice = 0").first()
    assert first["recipe_id"] == "amount_liquidity_20d"


def test_sweep_variants_are_distinct():
    base = {"m": (recipes.by_id("momentum_20d_rank").build, (20,))}
    found = recipes.sweep(base, sign_flip=True)
    texts = [t.text for t in found.values()]
    assert len(texts) == len(set(texts)) == 5 + 4 + 1 + 1 + 3
    assert found["m__operator_ts_return_to_delta"].text == "rank(delta(close, 20))"


def test_no_likeness_of_candidates_that_a_reference_settles(spark, monkeypatch):
    """Pairs were formed of all candidates and references with every passing one, which fills the disk on larger tables."""
    from panelwright.suite import definitions

    class Seen(Exception):
        pass

    def stop(candidates, reference, value_pairs, ic_pairs, gates):
        raise Seen(candidates, reference, value_pairs, ic_pairs, gates)

    monkeypatch.setattr(catalog, "diversity_flags", stop)
    with pytest.raises(Seen) as found:
        definitions._diversity(spark, "/root/testdata/sf0.001")
    candidates, reference, *pairs, gates = found.value.args
    kept = [r.asDict() for r in reference.filter(catalog.passes(gates)).select("factor_name", "compact_expression", "structure_signature").collect()]
    texts, structures = {r["compact_expression"] for r in kept}, {r["structure_signature"] for r in kept}
    rows = candidates.withColumn("_pass", catalog.passes(gates)).withColumn("_skip", catalog.has_error() | F.col("diversity_rejected")).collect()
    asked = {r["factor_name"] for r in rows if not r["_skip"] and r["compact_expression"] not in texts and r["structure_signature"] not in structures}
    held = {r["factor_name"] for r in kept} | {r["factor_name"] for r in rows if r["_pass"] and r["factor_name"] in asked}
    assert kept and asked and len(asked) < len(rows)
    for table_ in pairs:
        met = [(r["left"], r["right"]) for r in table_.select("left", "right").collect()]
        assert met and all((a in asked and b in held) or (b in asked and a in held) for a, b in met)
        # each pair of names once
        assert len(met) == len({frozenset(p) for p in met})
