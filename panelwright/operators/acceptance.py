"""Best-first acceptance over a conflict graph in few rounds.

Taken in order, a contender is accepted unless one accepted before it conflicts with
it.  Done one after the other this takes a step per link of a chain of conflicts.
Here every contender still open is written as a literal: that another one is
accepted, or that it is not.  A contender with a single open rival is the negation
of that rival's literal, and literals of literals are composed, so the length that a
chain still has to go halves each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.session import cut_lineage


def _literal(prefix: str = "") -> Column:
    """(who, flip): accepted exactly if ``who`` is, or is not where ``flip``."""
    return F.struct(
        F.coalesce(F.col(f"{prefix}link"), F.col(f"{prefix}name")).alias("who"), F.coalesce(F.col(f"{prefix}flip"), F.lit(False)).alias("flip"))


def _follow(state: DataFrame) -> DataFrame:
    """Resolve links: to the value of what they point at, or on to its own link."""
    target = state.select(F.col("name").alias("link"), F.col("value").alias("_value"), F.col("link").alias("_link"), F.col("flip").alias("_flip"))
    met = state.join(target, "link", "left")
    value = F.coalesce(F.col("value"), F.when(F.col("link").isNotNull(), F.col("_value") != F.col("flip")))
    link = F.coalesce("_link", "link")
    flip = F.when(F.col("_link").isNotNull(), F.col("flip") != F.col("_flip")).otherwise(F.col("flip"))
    return met.select(*[c for c in state.columns if c not in ("value", "link", "flip")], value.alias("value"), link.alias("link"), flip.alias("flip"))


def _group_rivals(state: DataFrame, key: str) -> DataFrame:
    """(name, blocked, who, flip, more): what a contender's group says of it.

    Groups are never paired.  A member waits for the first open one before it, and
    ``more`` says that others may stand between them.  The aggregates are minima and
    sums, so a group that holds most rows is combined before the shuffle.
    """
    opened = F.col("value").isNull()
    grouped = state.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(
        F.min(F.when(F.col("value"), F.col("order"))).alias("_accepted"),
        F.min(F.when(opened, F.struct("order", _literal().alias("lit")))).alias("_first"),
        F.max(F.when(opened, F.col("order"))).alias("_last"), F.sum(opened.cast("int")).alias("_open"))
    waiting = state.filter(opened & F.col("link").isNull()).join(grouped, key)
    later = F.col("_first.order") < F.col("order")
    # Alone with the first one: nothing else has to be waited for.
    alone = (F.col("_open") == 2) & (F.col("_last") == F.col("order"))
    return waiting.select(
        "name", F.coalesce(F.col("_accepted") < F.col("order"), F.lit(False)).alias("blocked"),
        F.when(later, F.col("_first.lit.who")).alias("who"), F.when(later, F.col("_first.lit.flip")).alias("flip"),
        (later & ~alone).alias("more"))


def settle(contenders: DataFrame, conflicts: DataFrame, groups: list[str]) -> tuple[DataFrame, int]:
    """(name, accepted) of every contender, and the rounds it took.

    ``contenders`` has a unique ``name``, a sortable ``order`` without ties and the
    columns of ``groups``: two members of a group conflict, NULL and empty keys are no
    group.  ``conflicts`` holds further pairs (name, rival) in which the rival comes
    earlier.  The first open contender has no open rival, so every round decides; a
    chain of n conflicts takes about log2(n) rounds.  The state of a round is kept in
    the checkpoint folder.
    """
    state = cut_lineage(contenders.select(
        "name", "order", *groups, F.lit(None).cast("boolean").alias("value"), F.lit(None).cast(contenders.schema["name"].dataType).alias("link"), F.lit(None).cast("boolean").alias("flip")))
    rounds = 0
    while not state.filter("value IS NULL").isEmpty():
        rounds += 1
        rival = state.select(F.col("name").alias("rival"), F.col("value").alias("_value"), _literal().alias("_lit"))
        waiting = state.filter("value IS NULL AND link IS NULL").select("name")
        met = conflicts.join(waiting, "name").join(rival, "rival")
        pairs = met.filter(F.col("_value").isNull() | F.col("_value")).select(
            "name", F.coalesce("_value", F.lit(False)).alias("blocked"), F.when(F.col("_value").isNull(), F.col("_lit.who")).alias("who"),
            F.when(F.col("_value").isNull(), F.col("_lit.flip")).alias("flip"), F.lit(False).alias("more"))
        for key in groups:
            pairs = pairs.unionByName(_group_rivals(state, key))
        # Each rival once, with both its signs; a rival that must and must not be accepted rules a contender out.
        signs = pairs.groupBy("name", "who").agg(
            F.max("blocked").alias("blocked"), F.max("more").alias("more"), F.min("flip").alias("low"), F.max("flip").alias("high"))
        said = signs.groupBy("name").agg(
            F.max(F.col("blocked") | F.coalesce(F.col("low") != F.col("high"), F.lit(False))).alias("_out"), F.max("more").alias("_more"),
            F.count("who").alias("_rivals"), F.max("who").alias("_who"), F.max(F.when(F.col("who").isNotNull(), F.col("high"))).alias("_sign"))
        step = state.join(said, "name", "left")
        free = F.col("value").isNull() & F.col("link").isNull()
        single = (F.col("_rivals") == 1) & ~F.col("_more")
        value = F.when(free & F.coalesce("_out", F.lit(False)), F.lit(False)).when(free & (F.coalesce("_rivals", F.lit(0)) == 0), F.lit(True)).otherwise(F.col("value"))
        linked = free & value.isNull() & F.coalesce(single, F.lit(False))
        step = step.select(
            "name", "order", *groups, value.alias("value"), F.when(linked, F.col("_who")).otherwise(F.col("link")).alias("link"),
            F.when(linked, ~F.col("_sign")).otherwise(F.col("flip")).alias("flip"))
        state = cut_lineage(_follow(step))
    return state.select("name", F.col("value").alias("accepted")), rounds
