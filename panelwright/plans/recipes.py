"""The ready-made factor library, its catalog table, and variant sweeps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelwright.plans import factors as f
from panelwright.plans.factors import Term, fld


@dataclass(frozen=True)
class Recipe:
    recipe_id: str
    family: str
    expected_sign: str
    hypothesis: str
    windows: tuple[int, ...]
    build: Callable[..., Term]
    risks: tuple[str, ...] = ()

    def term(self, *windows: int) -> Term:
        """The factor with its own windows, or with the given ones."""
        return self.build(*(windows or self.windows))


def _recent_rank(short: int, long: int) -> Term:
    return f.rank(f.ts_rank(f.ts_return(fld("close"), short), long))


def _low_volatility(step: int, n: int) -> Term:
    return f.rank(-f.ts_std(f.ts_return(fld("close"), step), n))


def _calm(step: int, n: int, history: int) -> Term:
    return f.rank(-f.ts_zscore(f.ts_std(f.ts_return(fld("close"), step), n), history))


# Identifiers, families, signs and windows of the ready-made library.
RECIPES: list[Recipe] = [
    Recipe("momentum_20d_rank", "momentum", "positive", "medium-term winners keep winning",
           (20,), lambda n: f.rank(f.ts_return(fld("close"), n))),
    Recipe("momentum_60d_rank", "momentum", "positive", "quarterly relative strength persists",
           (60,), lambda n: f.rank(f.ts_return(fld("close"), n))),
    Recipe("ts_rank_return_20d", "momentum", "positive", "returns high against their own history point to a trend",
           (5, 20), _recent_rank),
    Recipe("short_reversal_5d_winsor", "reversal", "positive", "short-term losers rebound",
           (5,), lambda n: f.winsorize(-f.ts_return(fld("close"), n), 0.01, 0.99),
           ("high turnover",)),
    Recipe("short_reversal_10d_rank", "reversal", "positive", "two-week overreaction reverts",
           (10,), lambda n: f.rank(-f.ts_return(fld("close"), n)), ("liquidity and size exposure",)),
    Recipe("volatility_20d_lowvol_rank", "volatility", "positive", "calm names are of higher quality",
           (1, 20), _low_volatility),
    Recipe("volatility_zscore_60d", "volatility", "positive", "unusually calm against own history",
           (1, 20, 60), _calm),
    Recipe("volume_rank_20d", "volume", "unknown", "unusual activity shows attention",
           (20,), lambda n: f.rank(f.ts_rank(fld("volume"), n))),
    Recipe("amount_liquidity_20d", "liquidity", "unknown", "traded amount measures investability",
           (20,), lambda n: f.rank(f.ts_mean(fld("amount"), n))),
    Recipe("volume_price_divergence_10d", "volume", "unknown", "price move per unit of volume shows imbalance",
           (10,), lambda n: f.rank(f.delta(fld("close"), n) / (f.ts_mean(fld("volume"), n) + 1))),
    Recipe("small_cap_inverse_mcap", "value_proxy", "positive", "small names earn a premium",
           (), lambda: f.rank(1 / fld("market_cap")), ("liquidity exposure and limited capacity",)),
    Recipe("vwap_close_reversal_5d", "reversal", "positive", "a close below the average price reverts",
           (), lambda: f.rank((fld("vwap") - fld("close")) / fld("close"))),
    Recipe("industry_neutral_momentum_20d", "momentum", "positive", "trend without the industry part",
           (20,), lambda n: f.neutralize_industry(f.rank(f.ts_return(fld("close"), n)))),
    Recipe("size_neutral_reversal_5d", "reversal", "positive", "reversal without the size part",
           (5,), lambda n: f.neutralize_size(f.winsorize(-f.ts_return(fld("close"), n), 0.01, 0.99))),
]


def by_id(recipe_id: str) -> Recipe | None:
    return next((r for r in RECIPES if r.recipe_id == recipe_id.strip()), None)


CATALOG_SCHEMA = (
    "position int, recipe_id string, family string, expression string, expected_sign string, "
    "economic_hypothesis string, required_fields array<string>, lookback_windows array<int>, "
    "risk_notes array<string>, complexity_score int"
)


def catalog_frame(spark: SparkSession, terms: dict[str, Term] | None = None) -> DataFrame:
    """The library (or other named terms) as a table of definitions."""
    if terms is not None:
        rows = [
            (i, name, "sweep", t.text, "unknown", "", t.fields, t.windows, [], t.complexity)
            for i, (name, t) in enumerate(terms.items())
        ]
        return spark.createDataFrame(rows, CATALOG_SCHEMA)
    rows = []
    for i, r in enumerate(RECIPES):
        t = r.term()
        rows.append(
            (i, r.recipe_id, r.family, t.text, r.expected_sign, r.hypothesis, t.fields, t.windows, list(r.risks), t.complexity)
        )
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def recipes_for_family(catalog: DataFrame, family: str, fewest: int = 4) -> DataFrame:
    """Definitions of a family, padded with the others when there are few.

    ``choice`` orders them: the family first, then the rest, each in catalog order.
    """
    family = (family or "").strip()
    if not family:
        return catalog.withColumn("choice", F.row_number().over(Window.orderBy("position")) - 1)
    own = F.col("family") == family
    sized = catalog.withColumn("_own", F.sum(F.when(own, 1).otherwise(0)).over(Window.partitionBy(F.lit(0))))
    kept = sized.filter(own | (F.col("_own") < fewest))
    order = Window.orderBy(F.when(own, 0).otherwise(1), "position")
    return kept.withColumn("choice", F.row_number().over(order) - 1).drop("_own")


def select_recipe(catalog: DataFrame, family: str, index: int, used: DataFrame | None = None) -> DataFrame:
    """One definition: ``index`` wraps around those whose text is not in ``used``.

    When everything was used, all of the family's choices come back into play.
    """
    choices = recipes_for_family(catalog, family).withColumn("_text", F.regexp_replace("expression", " ", ""))
    if used is None:
        marked = choices.withColumn("_used", F.lit(False))
    else:
        seen = used.select(F.regexp_replace("expression", " ", "").alias("_text")).distinct().withColumn("_used", F.lit(True))
        marked = choices.join(seen, "_text", "left").withColumn("_used", F.coalesce("_used", F.lit(False)))
    everything = Window.partitionBy(F.lit(0))
    live = marked.withColumn("_all_used", F.min("_used").over(everything)).filter(~F.col("_used") | F.col("_all_used"))
    return (
        live.withColumn("_at", F.row_number().over(Window.orderBy("choice")) - 1)
        .withColumn("_count", F.count("*").over(everything))
        .filter(F.col("_at") == F.lit(index) % F.col("_count"))
        .drop("_text", "_used", "_all_used", "_at", "_count", "choice")
    )


# --------------------------------------------------------------------------
# Variants


# Operator pairs a sweep exchanges.
SWAPS = {
    "ts_mean": "ts_rank", "ts_rank": "ts_mean",
    "delta": "ts_return", "ts_return": "delta",
    "ts_std": "ts_zscore", "ts_zscore": "ts_std",
}
_CALLS = {
    "ts_mean": f.ts_mean, "ts_rank": f.ts_rank, "delta": f.delta,
    "ts_return": f.ts_return, "ts_std": f.ts_std, "ts_zscore": f.ts_zscore,
}


def sweep(
    base: dict[str, tuple[Callable[..., Term], tuple[int, ...]]],
    windows: Sequence[int] = (5, 10, 20, 40, 60, 120),
    wrappers: Sequence[str] = ("rank", "zscore", "winsorize", "ts_rank"),
    rank_window: int = 20,
    sign_flip: bool = False,
    neutralisers: bool = True,
) -> dict[str, Term]:
    """Variants of each base definition, first spelling kept when two coincide."""
    wrap = {
        "rank": f.rank, "zscore": f.zscore, "winsorize": f.winsorize,
        "ts_rank": lambda t: f.ts_rank(t, rank_window),
    }
    found: dict[str, Term] = {}
    for name, (build, own) in base.items():
        variants: list[tuple[str, Term]] = []
        if own:
            primary = min(own)
            variants += [
                (f"window_{n}", build(*[n if w == primary else w for w in own])) for n in windows if n != primary
            ]
        term = build(*own)
        variants += [(f"transform_{w}", wrap[w](term)) for w in wrappers]
        variants += _swapped(term)
        if sign_flip:
            variants.append(("sign_flip", -term))
        if neutralisers:
            by_industry = "neutralize_industry(" not in term.text
            by_size = "neutralize_size(" not in term.text
            if by_industry:
                variants.append(("neutralize_industry", f.neutralize_industry(term)))
            if by_size:
                variants.append(("neutralize_size", f.neutralize_size(term)))
            if by_industry and by_size:
                variants.append(("neutralize_industry_size", f.neutralize_size(f.neutralize_industry(term))))
        for label, variant in variants:
            if all(variant.text != t.text for t in found.values()):
                found[f"{name}__{label}"] = variant
    return found


def _swapped(term: Term) -> list[tuple[str, Term]]:
    out = []
    for old, new in SWAPS.items():
        changed = _swap_first(term, old, new)
        if changed is not None:
            out.append((f"operator_{old}_to_{new}", changed))
    return out


def _swap_first(term: Term, old: str, new: str) -> Term | None:
    """Rebuild the term with its outermost, leftmost ``old`` call exchanged."""
    if term.is_call and term.text.startswith(f"{old}("):
        return _CALLS[new](*term.inputs, *term.own_windows)
    for i, t in enumerate(term.inputs):
        changed = _swap_first(t, old, new)
        if changed is not None:
            inputs = (*term.inputs[:i], changed, *term.inputs[i + 1 :])
            text = term.text.replace(t.text, changed.text, 1)
            return Term(text, term.kind, inputs, term.step, term.own_nodes, term.own_windows, term.is_call)
    return None


def crossover(pairs: Sequence[tuple[str, Term, str, Term]]) -> dict[str, Term]:
    """Ranked sum, difference or product of two definitions, signs taken in turn."""
    out = {}
    for i, (left_name, left, right_name, right) in enumerate(pairs):
        combined = [left + right, left - right, left * right][i % 3]
        out[f"crossover_{left_name}_{right_name}"] = f.rank(combined)
    return out
