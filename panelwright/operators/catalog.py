"""Operators over tables of factor definitions and their metrics.

A candidate table has one row per factor with ``factor_name``, ``family``,
``expression``, ``required_fields``, ``lookback_windows``, ``grade``, metric
columns, ``complexity_score``, ``error`` and ``diversity_rejected``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.functions import text
from panelwright.operators import acceptance
from panelwright.operators.screen import GRADE_ORDER
from panelwright.session import cut_lineage

# Weights of the likeness of two definitions, and the novelty below
# which a definition is turned away.
STRUCTURE_WEIGHT = 0.35
OPERATOR_WEIGHT = 0.25
FIELD_WEIGHT = 0.20
FAMILY_WEIGHT = 0.20
MIN_NOVELTY = 0.25


@dataclass(frozen=True)
class Gates:
    """Thresholds a candidate has to meet."""

    min_grade: str = "B"
    min_rank_ic: float = 0.02
    max_complexity: int = 60
    value_corr: float = 0.90
    ic_corr: float = 0.90


def _value(name: str, default=0.0) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _grade_points(grade: Column) -> Column:
    out = F.lit(0)
    for letter, points in GRADE_ORDER.items():
        out = F.when(grade == letter, points).otherwise(out)
    return out


def has_error(name: str = "error") -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def passes(gates: Gates = Gates()) -> Column:
    """Whether a candidate meets every gate; unset (zero) windows are not held against it."""
    half = gates.min_rank_ic * 0.5
    ok = _grade_points(F.col("grade")) >= GRADE_ORDER.get(gates.min_grade, 0)
    ok = ok & (F.abs(_value("mean_rank_ic")) >= gates.min_rank_ic)
    for window in ("validation_rank_ic", "test_rank_ic"):
        ok = ok & ((_value(window) == 0) | (F.abs(_value(window)) >= half))
    ok = ok & (_value("complexity_score", 0) <= gates.max_complexity)
    return ok & ~has_error() & ~F.coalesce(F.col("diversity_rejected"), F.lit(False))


def direction_and_recommendation(candidates: DataFrame, gates: Gates = Gates()) -> DataFrame:
    half = gates.min_rank_ic * 0.5

    def weak(name: str) -> Column:
        return (_value(name) != 0) & (F.abs(_value(name)) < half)

    warnings = F.array_compact(
        F.array(
            F.when(_value("complexity_score", 0) > gates.max_complexity, "high complexity"),
            F.when(weak("validation_rank_ic"), "weak validation IC"),
            F.when(weak("test_rank_ic"), "weak test IC"),
            F.when(_value("turnover_estimate") > 0.8, "high turnover"),
        )
    )
    return (
        candidates.withColumn(
            "alpha_direction", F.when(_value("mean_rank_ic") < 0, "inverse_alpha").otherwise("positive_alpha")
        )
        .withColumn("_warnings", warnings)
        .withColumn(
            "recommendation",
            F.when(passes(gates), F.lit("keep"))
            .when(F.size("_warnings") > 0, F.concat(F.lit("investigate: "), F.array_join("_warnings", ", ")))
            .otherwise(F.lit("reject")),
        )
        .drop("_warnings")
    )


# --------------------------------------------------------------------------
# Definition text


def describe(candidates: DataFrame) -> DataFrame:
    """Add ``structure_signature``, ``ops``, ``fields``, ``compact_expression`` and ``code_hash``."""
    declared = "required_fields" if "required_fields" in candidates.columns else None
    return candidates.select(
        "*",
        text.structure_signature("expression").alias("structure_signature"),
        text.operator_set("expression").alias("ops"),
        text.field_set("expression", declared).alias("fields"),
        text.compact("expression").alias("compact_expression"),
        text.short_hash("expression").alias("code_hash"),
    )


SPEC_SCHEMA = (
    "name string, family string, expression string, required_fields array<string>, lookback_windows array<int>"
)


def to_spec_json(candidates: DataFrame) -> DataFrame:
    """Add ``spec``: the definition as one JSON object."""
    spec = F.struct(
        F.col("factor_name").alias("name"), "family", "expression", "required_fields", "lookback_windows"
    )
    return candidates.withColumn("spec", F.to_json(spec))


def from_spec_json(specs: DataFrame) -> DataFrame:
    """Definition columns of JSON objects; objects without a name are left out."""
    parsed = specs.select(F.from_json("spec", SPEC_SCHEMA).alias("_s")).filter(F.col("_s.name").isNotNull())
    return parsed.select(F.col("_s.name").alias("factor_name"), *[f"_s.{c}" for c in ("family", "expression", "required_fields", "lookback_windows")])


def distinct_definitions(described: DataFrame, order: str = "factor_name") -> DataFrame:
    """First definition of every structure, which also covers equal texts."""
    rest = [c for c in described.columns if c != "structure_signature"]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_first")
    return described.groupBy("structure_signature").agg(first).select("structure_signature", "_first.*").select(
        *described.columns
    )


def niche_key(described: DataFrame) -> DataFrame:
    """Family, horizon band, and the first three operators and fields."""
    longest = F.coalesce(F.array_max("lookback_windows"), F.lit(0))
    band = (
        F.when(longest <= 0, "static").when(longest <= 10, "short").when(longest <= 40, "medium").otherwise("long")
    )

    def first_three(name: str, none: str) -> Column:
        return F.when(F.size(name) > 0, F.array_join(F.slice(F.array_sort(name), 1, 3), "+")).otherwise(F.lit(none))

    return (
        described.withColumn("niche_family", F.coalesce("family", F.lit("unknown")))
        .withColumn("niche_horizon", band)
        .withColumn("niche_ops", first_three("ops", "python"))
        .withColumn("niche_fields", first_three("fields", "unknown"))
    )


def novelty(described: DataFrame, reference: DataFrame, before: str | None = None) -> DataFrame:
    """1 minus the likeness to the nearest reference definition.

    Likeness depends only on structure, operator set, field set and family, and
    definitions repeat those, so both sides are reduced to distinct profiles
    first.  Profiles that share a token (an operator, a field or the family) meet
    in an equi join and their overlap is counted; sharing nothing means likeness 0.
    ``before`` names an order column: then only reference rows that come earlier
    than the candidate count.
    """
    shape = ["ops", "fields", "family"]

    def shaped(df: DataFrame) -> DataFrame:
        return df.withColumn("family", F.coalesce("family", F.lit("unknown"))).withColumn(
            "_profile", F.xxhash64(F.to_json(F.struct(*shape)))
        )

    cand, ref = shaped(described), shaped(reference)
    since = F.min(before) if before else F.min(F.lit(0))

    ref_profiles = ref.groupBy("_profile").agg(*[F.first(c).alias(c) for c in shape], since.alias("_since"))
    cand_profiles = cand.groupBy("_profile").agg(*[F.first(c).alias(c) for c in shape])

    def tokens(df: DataFrame) -> DataFrame:
        # empty sets are equal to each other, so they carry a token of their own
        def tagged(name: str, tag: str) -> Column:
            marked = F.transform(name, lambda v: F.concat(F.lit(tag), v))
            return F.when(F.size(name) > 0, marked).otherwise(F.array(F.lit(f"{tag}<none>")))

        all_tokens = F.concat(tagged("ops", "o:"), tagged("fields", "f:"), F.array(F.concat(F.lit("m:"), "family")))
        return df.withColumn("_token", F.explode(all_tokens))

    def ones(tag: str) -> Column:
        return F.sum(F.when(F.col("_token").startswith(tag), 1).otherwise(0))

    left = tokens(cand_profiles).select(
        F.col("_profile").alias("_cp"), "_token",
        F.greatest(F.size("ops"), F.lit(1)).alias("_co"), F.greatest(F.size("fields"), F.lit(1)).alias("_cf"),
    )
    right = tokens(ref_profiles).select(
        F.col("_profile").alias("_rp"), "_token", "_since",
        F.greatest(F.size("ops"), F.lit(1)).alias("_ro"), F.greatest(F.size("fields"), F.lit(1)).alias("_rf"),
    )
    overlap = left.join(right, "_token").groupBy("_cp", "_rp").agg(
        ones("o:").alias("_so"), ones("f:").alias("_sf"), ones("m:").alias("_sm"),
        F.first("_co").alias("_co"), F.first("_cf").alias("_cf"),
        F.first("_ro").alias("_ro"), F.first("_rf").alias("_rf"), F.first("_since").alias("_since"),
    )
    likeness = overlap.select(
        "_cp", "_rp", "_since",
        (
            F.lit(OPERATOR_WEIGHT) * F.col("_so") / (F.col("_co") + F.col("_ro") - F.col("_so"))
            + F.lit(FIELD_WEIGHT) * F.col("_sf") / (F.col("_cf") + F.col("_rf") - F.col("_sf"))
            + F.lit(FAMILY_WEIGHT) * F.col("_sm")
        ).alias("_like"),
    )

    # the structure bonus applies where a reference of that profile has the same structure
    structured = ref.filter(F.col("structure_signature") != "").groupBy("structure_signature", "_profile").agg(
        since.alias("_since")
    )
    keep = ["factor_name", "structure_signature", "_profile"] + ([before] if before else [])
    who = cand.select(*keep)
    earlier = (F.col("_since") < F.col(before)) if before else F.lit(True)
    plain = who.join(likeness, F.col("_profile") == F.col("_cp")).filter(earlier).select("factor_name", "_like")
    same = who.join(structured.withColumnRenamed("_profile", "_sp"), "structure_signature").filter(earlier)
    bonus = same.join(
        likeness.drop("_since"), (F.col("_profile") == F.col("_cp")) & (F.col("_sp") == F.col("_rp")), "left"
    ).select("factor_name", (F.lit(STRUCTURE_WEIGHT) + F.coalesce("_like", F.lit(0.0))).alias("_like"))
    nearest = plain.unionByName(bonus).groupBy("factor_name").agg(F.max("_like").alias("_like"))
    scored = described.join(nearest, "factor_name", "left")
    score = F.lit(1.0) - F.coalesce("_like", F.lit(0.0))
    return scored.withColumn("novelty_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).drop("_like")


# --------------------------------------------------------------------------
# Ordering, diversity and survivors


def rank_key() -> list[Column]:
    """Quality order of candidates, best first, names breaking ties."""
    return [
        _grade_points(F.col("grade")).desc(),
        F.abs(_value("validation_rank_ic")).desc(),
        F.abs(_value("test_rank_ic")).desc(),
        F.abs(_value("recent_rank_ic")).desc(),
        _value("novelty_score", 1.0).desc(),
        F.abs(_value("mean_rank_ic")).desc(),
        _value("max_similarity").asc(),
        _value("complexity_score", 0).asc(),
        F.col("factor_name").asc(),
    ]


def _rank_struct() -> Column:
    """The same order as one ascending sort value."""
    return F.struct(
        (-_grade_points(F.col("grade"))).alias("a"),
        (-F.abs(_value("validation_rank_ic"))).alias("b"),
        (-F.abs(_value("test_rank_ic"))).alias("c"),
        (-F.abs(_value("recent_rank_ic"))).alias("d"),
        (-_value("novelty_score", 1.0)).alias("e"),
        (-F.abs(_value("mean_rank_ic"))).alias("f"),
        _value("max_similarity").alias("g"),
        _value("complexity_score", 0).alias("h"),
        F.col("factor_name").alias("i"),
    )


def top_factor_table(candidates: DataFrame, gates: Gates = Gates(), n: int = 50) -> DataFrame:
    return candidates.filter(passes(gates)).orderBy(*rank_key()).limit(n)


def _seen(candidates: DataFrame, accepted_ref: DataFrame) -> DataFrame:
    """Add ``_skip``, and ``_ref_text`` and ``_ref_struct``: whether an accepted reference has the text or structure."""
    out = candidates.withColumn("_skip", has_error() | F.coalesce("diversity_rejected", F.lit(False)))
    for key, flag in (("compact_expression", "_ref_text"), ("structure_signature", "_ref_struct")):
        seen = accepted_ref.filter(F.col(key) != "").select(key).distinct().withColumn(flag, F.lit(True))
        out = out.join(seen, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out


def likeness_ends(candidates: DataFrame, reference: DataFrame, gates: Gates = Gates()) -> tuple[DataFrame, DataFrame]:
    """Names of the pairs that :func:`diversity_flags` reads: (asked, against).

    Asked are the candidates that are neither passed through nor repeat a reference's
    text or structure; all others are flagged without a likeness.  They are held
    against the accepted references and the passing ones among themselves.
    """
    accepted_ref = reference.filter(passes(gates))
    asked = cut_lineage(_seen(candidates, accepted_ref).filter(~(F.col("_skip") | F.col("_ref_text") | F.col("_ref_struct"))).select("factor_name", passes(gates).alias("_pass")))
    return asked.select("factor_name"), accepted_ref.select("factor_name").union(asked.filter("_pass").select("factor_name"))


def diversity_flags(
    candidates: DataFrame,
    reference: DataFrame,
    value_pairs: DataFrame,
    ic_pairs: DataFrame,
    gates: Gates = Gates(),
) -> DataFrame:
    """Turn away candidates too close to one accepted earlier or to the reference.

    Candidates are taken best first, and only passing ones that were not turned
    away count against later ones.  Rows with an error and rows turned away before
    pass through with the values they came with.  The sequence is settled by
    :func:`acceptance.settle`; equal texts and structures are groups there and
    correlations above their threshold pairs, so no pairs are formed inside a group.
    ``novelty_score`` is the novelty against the reference and what was accepted
    before, for every candidate that is not a repeated text or structure.

    ``candidates`` and ``reference`` are described tables (:func:`describe`);
    the pair tables hold ``left, right, similarity``, of which only the pairs of
    :func:`likeness_ends` matter.  A candidate flagged as
    too close in structure also covers novelty below the minimum: likeness above
    0.75 needs the structure weight.
    """
    # read several times below; one row per candidate or close pair
    candidates, reference = cut_lineage(candidates), cut_lineage(reference)
    value_pairs, ic_pairs = cut_lineage(value_pairs), cut_lineage(ic_pairs)
    ordered = candidates.withColumn("_order", _rank_struct()).withColumn("_pass", passes(gates))
    accepted_ref = reference.filter(passes(gates))

    def both_ways(pairs: DataFrame) -> DataFrame:
        flipped = pairs.select(F.col("right").alias("left"), F.col("left").alias("right"), "similarity")
        return pairs.select("left", "right", "similarity").unionByName(flipped)

    near = both_ways(value_pairs.filter(F.col("similarity") >= gates.value_corr)).unionByName(
        both_ways(ic_pairs.filter(F.col("similarity") >= gates.ic_corr))
    ).select("left", "right").distinct()
    ref_names = accepted_ref.select(F.col("factor_name").alias("right"))
    near_reference = near.join(ref_names, "right", "left_semi").select(F.col("left").alias("factor_name")).distinct()

    known = _seen(ordered, accepted_ref).join(near_reference.withColumn("_ref_near", F.lit(True)), "factor_name", "left")
    known = cut_lineage(
        known.select(
            "factor_name", "compact_expression", "structure_signature", "_order", "_pass", "_skip", "_ref_text", "_ref_struct",
            F.coalesce("_ref_near", F.lit(False)).alias("_ref_near"),
        )
    )
    # only passing candidates that the reference leaves open can stand in another's way
    open_ = ~(F.col("_skip") | F.col("_ref_text") | F.col("_ref_struct") | F.col("_ref_near"))
    contenders = known.filter(open_ & F.col("_pass")).select(
        F.col("factor_name").alias("name"), F.col("_order").alias("order"), "compact_expression", "structure_signature")
    orders = contenders.select("name", "order")
    conflicts = cut_lineage(
        near.join(orders.select(F.col("name").alias("left"), F.col("order").alias("_lo")), "left")
        .join(orders.select(F.col("name").alias("right"), F.col("order").alias("_ro")), "right")
        .filter(F.col("_ro") < F.col("_lo"))
        .select(F.col("left").alias("name"), F.col("right").alias("rival"))
    )
    settled, _ = acceptance.settle(contenders, conflicts, ["compact_expression", "structure_signature"])
    chosen = cut_lineage(settled.filter("accepted").join(known, F.col("name") == F.col("factor_name")).select(
        "factor_name", "compact_expression", "structure_signature", "_order"))

    # every candidate against what was accepted before it
    def first_of(key: str, out: str) -> DataFrame:
        return chosen.filter(F.col(key) != "").groupBy(key).agg(F.min("_order").alias(out))

    blocking = (
        near.join(known.select(F.col("factor_name").alias("left"), F.col("_order").alias("_lo")), "left")
        .join(chosen.select(F.col("factor_name").alias("right"), F.col("_order").alias("_ro")), "right")
        .filter(F.col("_ro") < F.col("_lo")).select(F.col("left").alias("factor_name")).distinct().withColumn("_near", F.lit(True))
    )
    judged = (
        known.join(first_of("compact_expression", "_text"), "compact_expression", "left")
        .join(first_of("structure_signature", "_struct"), "structure_signature", "left")
        .join(blocking, "factor_name", "left")
    )
    state = cut_lineage(judged.select(
        "factor_name", "_order", "_pass",
        F.when(F.col("_skip"), F.lit("skipped"))
        .when(F.col("_ref_text") | (F.col("_text") < F.col("_order")), F.lit("same_expression"))
        .when(F.col("_ref_struct") | (F.col("_struct") < F.col("_order")), F.lit("same_structure"))
        .when(F.col("_ref_near") | F.col("_near"), F.lit("similar"))
        .otherwise(F.lit("accepted")).alias("_state")))

    # novelty against the reference, which comes before all, and what was accepted before
    turn = lambda side, order: F.struct(F.lit(side).alias("side"), order.alias("order"))
    shape = ["factor_name", "structure_signature", "ops", "fields", "family"]
    asked = candidates.select(*shape).join(state.filter(F.col("_state").isin("similar", "accepted")).select("factor_name", turn(1, F.col("_order")).alias("_turn")), "factor_name")
    no_order = F.lit(None).cast(state.schema["_order"].dataType)
    held = accepted_ref.select(*shape, turn(0, no_order).alias("_turn")).unionByName(
        candidates.select(*shape).join(chosen.select("factor_name", turn(1, F.col("_order")).alias("_turn")), "factor_name"))
    novel = novelty(asked, held, before="_turn").select("factor_name", F.col("novelty_score").alias("_novelty"))

    # likeness to what was accepted before each candidate
    kept = state.filter((F.col("_state") == "accepted") & F.col("_pass")).select("factor_name", "_order")
    earlier_or_ref = kept.unionByName(
        accepted_ref.select("factor_name", F.lit(None).cast(state.schema["_order"].dataType).alias("_order"))
    )

    def strongest(pairs: DataFrame, out: str) -> DataFrame:
        met = (
            both_ways(pairs)
            .join(state.select(F.col("factor_name").alias("left"), F.col("_order").alias("_lo")), "left")
            .join(earlier_or_ref.select(F.col("factor_name").alias("right"), F.col("_order").alias("_ro")), "right")
            .filter(F.col("similarity").isNotNull() & (F.col("_ro").isNull() | (F.col("_ro") < F.col("_lo"))))
        )
        # of equal likeness the one accepted first counts, references before all
        best = F.min_by(F.struct("similarity", "right"), F.struct(-F.col("similarity"), F.col("_ro"), F.col("right")))
        return met.groupBy(F.col("left").alias("factor_name")).agg(best.alias(out))

    flags = {"diversity_rejected": "boolean", "max_similarity": "double", "ic_series_max_similarity": "double", "most_similar_to": "string", "novelty_score": "double"}
    old = [F.col(c).cast(t) if c in candidates.columns else F.lit(None).cast(t) for c, t in flags.items()]
    result = (
        candidates.select(*[c for c in candidates.columns if c not in flags], *[v.alias(f"_old_{c}") for v, c in zip(old, flags, strict=True)])
        .join(state.select("factor_name", "_state"), "factor_name")
        .join(strongest(value_pairs, "_value"), "factor_name", "left")
        .join(strongest(ic_pairs, "_ic"), "factor_name", "left")
        .join(novel, "factor_name", "left")
    )
    same_text = F.col("_state").isin("same_expression", "same_structure")
    best_value = F.coalesce(F.col("_value.similarity"), F.lit(0.0))
    best_ic = F.coalesce(F.col("_ic.similarity"), F.lit(0.0))
    by_ic = (F.col("_state") == "similar") & (best_value < gates.value_corr)
    new = {
        "diversity_rejected": same_text | (F.col("_state") == "similar"),
        "max_similarity": F.when(same_text, F.lit(1.0)).otherwise(best_value),
        "ic_series_max_similarity": F.when(same_text, F.lit(0.0)).otherwise(best_ic),
        "most_similar_to": F.when(same_text, F.col("_state"))
        .when(by_ic, F.coalesce(F.when(best_value > 0, F.col("_value.right")), F.lit("similar_ic_series")))
        .otherwise(F.coalesce(F.when(best_value > 0, F.col("_value.right")), F.lit(""))),
        "novelty_score": F.coalesce("_novelty", "_old_novelty_score"),
    }
    return result.select(
        *[c for c in candidates.columns if c not in flags],
        *[F.when(F.col("_state") == "skipped", F.col(f"_old_{c}")).otherwise(v).alias(c) for c, v in new.items()])


def novelty_flags(described: DataFrame, reference: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """The rule without the diversity penalty: only too little novelty rejects."""
    scored = novelty(described, reference.filter(passes(gates)))
    low = ~has_error() & (F.col("novelty_score") < MIN_NOVELTY)
    return scored.withColumn(
        "most_similar_to", F.when(low, F.lit("low_structural_novelty")).otherwise(F.lit(""))
    ).withColumn("diversity_rejected", low | F.coalesce("diversity_rejected", F.lit(False)))


def select_survivors(pool: DataFrame, k: int, gates: Gates = Gates()) -> DataFrame:
    """The ``k`` candidates that go on, in the order they are picked.

    Picks: the best of every niche in quality order, the one least like others,
    the strongest recent one, one outsider that failed the gates, then the rest in
    order.  When nobody passes, simply the best ``k``.  Every pick list is a
    distributed top-n; only those short lists are put together.
    """
    marked = niche_key(pool).withColumn("_pass", passes(gates)).withColumn("_key", _rank_struct())
    any_pass = pool.filter(passes(gates)).limit(1).count() > 0

    def numbered(df: DataFrame, stage: int, *order: Column) -> DataFrame:
        # at most a few times k rows reach this window
        return df.select(
            "factor_name",
            F.lit(stage).alias("_stage"),
            F.row_number().over(Window.orderBy(*order)).alias("_at"),
        )

    if not any_pass:
        best = marked.orderBy("_key").limit(k)
        return numbered(best.select("factor_name", "_key"), 1, F.col("_key")).select("factor_name", F.col("_at").alias("pick"))

    good = marked.filter("_pass")
    niche = ["niche_family", "niche_horizon", "niche_ops", "niche_fields"]
    winners = good.groupBy(*niche).agg(F.min("_key").alias("_key"), F.min_by("factor_name", "_key").alias("factor_name"))
    first = numbered(winners.orderBy("_key").limit(k).select("factor_name", "_key"), 1, F.col("_key"))

    strength = F.abs(_value("mean_rank_ic"))
    least_like = [_value("max_similarity").asc(), strength.desc(), _value("complexity_score", 0).asc(), F.col("_key").asc()]
    recent = F.abs(F.when(_value("recent_rank_ic") != 0, _value("recent_rank_ic")).otherwise(_value("mean_rank_ic")))
    second = numbered(good.orderBy(*least_like).limit(1).select("factor_name"), 2, F.lit(1))
    third = numbered(good.orderBy(recent.desc(), F.col("_key").asc()).limit(1).select("factor_name"), 3, F.lit(1))
    taken = first.unionByName(second).unionByName(third)

    free = marked.filter(~has_error() & ~F.coalesce("diversity_rejected", F.lit(False)))
    outsiders = free.join(taken.select("factor_name"), "factor_name", "left_anti").orderBy(
        F.abs(_value("recent_rank_ic")).desc(), _value("complexity_score", 0).asc(), strength.desc(), F.col("_key").asc()
    ).limit(1)
    fourth = numbered(outsiders.select("factor_name"), 4, F.lit(1))
    rest = numbered(good.orderBy("_key").limit(2 * k + 3).select("factor_name", "_key"), 5, F.col("_key"))

    picks = taken.unionByName(fourth).unionByName(rest)
    earliest = picks.groupBy("factor_name").agg(F.min(F.struct("_stage", "_at")).alias("_when"))
    return (
        earliest.withColumn("pick", F.row_number().over(Window.orderBy("_when")))
        .filter(F.col("pick") <= k)
        .select("factor_name", "pick")
    )


def candidate_filter(
    candidates: DataFrame,
    clean_only: bool = False,
    families: list[str] | None = None,
    survivors: DataFrame | None = None,
) -> DataFrame:
    """Browse filter: without errors, of given families, among the survivors."""
    out = candidates
    if clean_only:
        out = out.filter(~has_error())
    if families:
        out = out.filter(F.col("family").isin(families))
    if survivors is not None:
        out = out.join(survivors.select("factor_name"), "factor_name", "left_semi")
    return out


def resolve_name(names: DataFrame, baseline: DataFrame) -> DataFrame:
    """Map each ``candidate`` to a baseline ``factor_name``.

    An equal name wins, then the longest baseline name that ends the candidate,
    then the longest one inside it; otherwise the candidate keeps its own name.
    Substrings as long as some baseline name are matched by equality, so the pieces
    of a name grow with its length times the number of those lengths, and no product
    of the two tables is formed.  An empty or NULL name keeps itself; an empty
    baseline name matches nothing.
    """
    n = F.length("candidate")
    # one row: a baseline has no more lengths than its longest name has letters
    lengths = baseline.filter(F.length("factor_name") > 0).agg(F.collect_set(F.length("factor_name")).alias("_lengths"))
    pieces = (
        names.select("candidate").filter(n > 0).distinct()
        .withColumn("_lengths", lengths.scalar())
        .withColumn("_len", F.explode(F.filter("_lengths", lambda k: k <= n)))
        .withColumn("_from", F.explode(F.sequence(F.lit(1), n - F.col("_len") + 1)))
        .withColumn("_piece", F.expr("substring(candidate, _from, _len)"))
        .withColumn(
            "_class",
            F.when(F.col("_len") == n, 0).when(F.col("_from") + F.col("_len") - 1 == n, 1).otherwise(2),
        )
    )
    known = baseline.select(F.col("factor_name").alias("_piece")).distinct()
    best = (
        pieces.join(known, "_piece")
        .groupBy("candidate")
        .agg(F.min_by("_piece", F.struct("_class", -F.col("_len"), "_piece")).alias("_best"))
    )
    return names.join(best, "candidate", "left").withColumn("resolved", F.coalesce("_best", "candidate")).drop("_best")


def registry_upsert(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """Keep the newest row per factor; both sides carry ``updated_at``."""
    from panelwright.operators.screen import keep_last

    return keep_last(registry.unionByName(updates, allowMissingColumns=True), "factor_name", "updated_at")


def lookahead_audit(full: DataFrame, truncated: DataFrame, last_date: Column, tolerance: float = 1e-9) -> DataFrame:
    """Compare a factor on the whole panel with the same factor on a panel cut at ``last_date``.

    Values up to the cut must agree; a factor that reads later rows does not.
    """
    before = full.filter(F.col("date") <= last_date).select("factor_name", "entity", "date", F.col("value").alias("_full"))
    cut = truncated.select("factor_name", "entity", "date", F.col("value").alias("_cut"))
    a, b = F.col("_full"), F.col("_cut")
    scale = F.greatest(F.lit(1.0), F.abs(a))
    same = (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= F.lit(tolerance) * scale, F.lit(False))
    return (
        before.join(cut, ["factor_name", "entity", "date"], "full")
        .groupBy("factor_name")
        .agg(F.count("*").alias("checked"), F.count_if(~same).alias("mismatches"))
    )


def lookahead_audit_wide(full: DataFrame, truncated: DataFrame, names: Sequence[str], last_date: Column, tolerance: float = 1e-9) -> DataFrame:
    """The same for a library side by side: one row per (entity, date) with a column per factor is joined, not one per value.

    Rows on which a factor is missing on both sides are not counted for it.
    """
    before = full.filter(F.col("date") <= last_date).select("entity", "date", *[F.col(f"`{n}`").alias(f"_full_{n}") for n in names])
    met = before.join(truncated.select("entity", "date", *[F.col(f"`{n}`").alias(f"_cut_{n}") for n in names]), ["entity", "date"], "full")
    counts = []
    for n in names:
        a, b = F.col(f"`_full_{n}`"), F.col(f"`_cut_{n}`")
        there = a.isNotNull() | b.isNotNull()
        same = F.coalesce(F.abs(a - b) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(a)), F.lit(False))
        counts += [F.count_if(there).alias(f"_n_{n}"), F.count_if(there & ~same).alias(f"_off_{n}")]
    cells = ", ".join(f"'{n}', `_n_{n}`, `_off_{n}`" for n in names)
    return met.agg(*counts).select(F.expr(f"stack({len(names)}, {cells}) as (factor_name, checked, mismatches)"))
