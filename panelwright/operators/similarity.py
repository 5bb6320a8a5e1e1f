"""Pairwise rank correlation of many series without joining them pair by pair.

Spearman's correlation of two series is Pearson's correlation of ranks taken
*inside their overlap*.  Series with the same set of keys share one overlap, so
series are first put into classes of equal support.  A series is then ranked once
per class it meets instead of once per partner, and the pair sums of two classes
are a matrix product over their common keys, accumulated inside each task.

Few long series are sorted once each: places in all overlaps are running counts
along that one order (:func:`_pairs_sorted`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.operators.crosssection import CrossSection
from panelwright.operators.order import ordinal
from panelwright.session import cut_lineage, store

# Most series in one class block; larger classes are cut, which changes no result.
BLOCK = 256
# Partial sums a task holds before handing them on.
HELD_SUMS = 4_000_000
# Keys put side by side as dense rows at a time.
DENSE_KEYS = 2048
# Most series that are sorted once each: a bit of a whole number tells whether a key is in a key set.
SORTED_ITEMS = 60
# Rows of one series in a value range, on average; ranges are halved until they are as small.
RANGE_ROWS = 500_000
# Numbers put side by side when pair sums are taken.
DENSE_CELLS = 2_000_000
# Room for rounding when a bound is held against a threshold.
EDGE = 1e-9


def sample_rows(df: DataFrame, cross: CrossSection, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """At most ``n`` rows per group of ``cross``, chosen by hash and so repeatable."""
    marked = df.withColumn("_h", F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)))
    placed = cross.positions(marked, "_h", "_sm_")
    return placed.filter(F.col("_sm_lo") < n).drop("_h", "_sm_lo", "_sm_hi", "_sm_n")


def support_classes(series: DataFrame, item: str, row_keys: Sequence[str]) -> DataFrame:
    """(item, class, place): series with the same keys share a class.

    Two independent hash folds and the count identify a key set.
    """
    keys = [F.col(k) for k in row_keys]
    prints = series.groupBy(item).agg(
        F.bit_xor(F.xxhash64(*keys)).alias("_a"),
        F.bit_xor(F.xxhash64(F.lit("second"), *keys)).alias("_b"),
        F.count("*").alias("_c"),
    )
    same = Window.partitionBy("_a", "_b", "_c").orderBy(item)
    return prints.withColumn("_at", F.row_number().over(same) - 1).select(
        F.col(item),
        F.concat_ws("/", "_a", "_b", "_c", F.floor(F.col("_at") / BLOCK)).alias("class"),
        (F.col("_at") % BLOCK).cast("int").alias("place"),
    )


def _pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add up outer products of centred rank vectors per class pair.

    Centred ranks sum to zero, so the products are all a correlation needs.
    """
    held: dict[tuple[str, str], list] = {}
    size = 0

    def drain() -> pd.DataFrame:
        columns: dict[str, list] = {c: [] for c in ("left_place", "right_place", "sxy", "sxx", "syy")}
        counts, pairs, rows = [], [], []
        for (left, right), (n, width, gram, places) in held.items():
            diagonal = np.diag(gram)
            if left == right:
                a, b = np.triu_indices(width, 1)
            else:
                a, b = (g.ravel() for g in np.meshgrid(np.arange(width), np.arange(width, len(gram)), indexing="ij"))
            for c, v in zip(columns, (places[a], places[b], gram[a, b], diagonal[a], diagonal[b]), strict=True):
                columns[c].append(v)
            counts.append(n)
            pairs.append((left, right))
            rows.append(len(a))
        held.clear()
        names = np.array(pairs, dtype=object).repeat(rows, axis=0)
        return pd.DataFrame({"left_class": names[:, 0], "right_class": names[:, 1], "n": np.repeat(counts, rows), **{c: np.concatenate(v) for c, v in columns.items()}})[
            ["left_class", "right_class", "left_place", "right_place", "n", "sxy", "sxx", "syy"]]

    for batch in batches:
        for (left, right), part in batch.groupby(["left_class", "right_class"], sort=False):
            block = np.stack(part["ranks"].to_numpy())
            gram = block.T @ block
            width = int(part["width"].iloc[0])
            entry = held.get((left, right))
            if entry is None:
                # the same members meet at every key of two classes
                held[(left, right)] = [len(part), width, gram, np.asarray(part["places"].iloc[0], dtype="int32")]
                size += gram.size
            else:
                entry[0] += len(part)
                entry[2] += gram
        if size > HELD_SUMS:
            yield drain()
            size = 0
    if held:
        yield drain()


SUMS = ("n", "sxx", "syy", "sxy")


def _bound_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add up, per pair of blocks, what bounds a correlation: shared keys and products of own ranks."""
    held: dict[tuple[int, int], np.ndarray] = {}

    def drain() -> pd.DataFrame:
        parts = []
        for (left, right), sums in held.items():
            a, b = np.nonzero(sums[0])
            parts.append(pd.DataFrame({
                "left_block": left, "right_block": right, "left_place": a.astype("int32"), "right_place": b.astype("int32"),
                **{name: sums[i, a, b] for i, name in enumerate(SUMS)}}))
        held.clear()
        return pd.concat(parts, ignore_index=True)

    for batch in batches:
        for (left, right), rows in batch.groupby(["left_block", "right_block"], sort=False):
            for at in range(0, len(rows), DENSE_KEYS):
                part = rows.iloc[at: at + DENSE_KEYS]
                px, rx = _dense(part["left_places"], part["left_ranks"])
                py, ry = _dense(part["right_places"], part["right_ranks"])
                sums = np.stack([px.T @ py, (rx * rx).T @ py, px.T @ (ry * ry), rx.T @ ry])
                key = (left, right)
                held[key] = held[key] + sums if key in held else sums
            if len(held) * sums.size > HELD_SUMS:
                yield drain()
    if held:
        yield drain()


def _dense(places: pd.Series, ranks: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Presence and rank of every item of a block at each key."""
    present, value = (np.zeros((len(places), BLOCK)) for _ in range(2))
    row, at = np.repeat(np.arange(len(places)), [len(p) for p in places]), np.concatenate(places.to_list())
    present[row, at], value[row, at] = 1.0, np.concatenate(ranks.to_list())
    return present, value


def _blocks(names: DataFrame, out: str) -> DataFrame:
    """Number the items in blocks of ``BLOCK``."""
    placed = ordinal(names, "_at", F.col("item"))
    return placed.select("item", F.floor(F.col("_at") / BLOCK).cast("int").alias(out), (F.col("_at") % BLOCK).cast("int").alias("place"))


def _among(items: DataFrame, names: DataFrame | None) -> DataFrame:
    """The items that the first column of ``names`` holds; all, if it is None."""
    return items if names is None else items.join(names.select(F.col(names.columns[0]).alias("item")).distinct(), "item", "left_semi")


def pair_bounds(known: DataFrame, row_keys: Sequence[str], against: DataFrame | None, spread: bool, asked: DataFrame | None = None) -> DataFrame:
    """(left, right, n, most): shared keys and an upper bound of |rank correlation| of items (those ``asked``) and those of ``against``.

    ``known`` holds item, keys and v.  Every item is ranked once, among its own keys.
    Inside an overlap of n of its N keys a rank is smaller by 0 to N - n, so the
    difference of two overlap ranks is known up to half of both slacks, and with it,
    by Minkowski's inequality, the sum of squared differences that makes the
    correlation.  Ties are counted by the longest run of equal values of each item.
    The bound holds for every pair; with equal key sets and no ties it is exact.
    """
    items = known.select("item").distinct()
    cross = CrossSection(["item"], spread=spread)
    sizes = known.groupBy("item").agg(F.count("*").alias("_size"))
    longest = known.groupBy("item", "v").agg(F.count("*").alias("_same")).groupBy("item").agg(F.max("_same").alias("_ties"))
    facts = cut_lineage(sizes.join(longest, "item"))
    ranked = cut_lineage(cross.centred_rank(known, "v", "rank").select("item", *row_keys, "rank"))
    own, other = _blocks(_among(items, asked), "left_block"), _blocks(_among(items, against), "right_block")
    per_key = lambda blocks, block: ranked.join(blocks, "item").groupBy(block, *row_keys).agg(F.collect_list(F.struct("place", "rank")).alias("_cells"))
    left = per_key(own, "left_block").withColumnRenamed("_cells", "_left")
    right = per_key(other, "right_block").withColumnRenamed("_cells", "_right")
    met = left.join(right, list(row_keys)).select(
        "left_block", "right_block", F.col("_left.place").alias("left_places"), F.col("_left.rank").alias("left_ranks"),
        F.col("_right.place").alias("right_places"), F.col("_right.rank").alias("right_ranks"))
    sums = met.mapInPandas(_bound_sums, "left_block int, right_block int, left_place int, right_place int, n double, sxx double, syy double, sxy double")
    total = sums.groupBy("left_block", "right_block", "left_place", "right_place").agg(*[F.sum(c).alias(c) for c in SUMS])
    named = total.join(own.withColumnsRenamed({"item": "_l", "place": "left_place"}), ["left_block", "left_place"]).join(
        other.withColumnsRenamed({"item": "_r", "place": "right_place"}), ["right_block", "right_place"]).filter("_l <> _r")
    for side in ("l", "r"):
        named = named.join(facts.withColumnsRenamed({"item": f"_{side}", "_size": f"_{side}n", "_ties": f"_{side}t"}), f"_{side}")
    n = F.col("n")
    slack = ((F.col("_ln") - n) + (F.col("_rn") - n)) / 2
    # Both ranks are centred, each among its own keys, so they differ by half of the missing keys at most.
    same = F.col("sxx") + F.col("syy") - 2 * F.col("sxy")
    turned = F.col("sxx") + F.col("syy") + 2 * F.col("sxy")
    full = n * (n * n - 1) / 12
    floor_of = lambda ties: F.greatest(F.lit(0.0), n * (n * n - ties * ties) / 12)
    corners = [(a, b) for a in (floor_of(F.col("_lt")), full) for b in (floor_of(F.col("_rt")), full)]

    def most(squares: Column) -> Column:
        """Greatest (a + b - d) / (2 sqrt(a b)): spreads a, b at an end of their range each, d as small as it may be."""
        near = F.greatest(F.lit(0.0), F.sqrt(F.greatest(squares, F.lit(0.0))) - slack * F.sqrt(n))
        return F.greatest(*[F.coalesce(F.try_divide(a + b - near * near, 2 * F.sqrt(a * b)), F.lit(1.0)) for a, b in corners])

    return named.select(
        F.col("_l").alias("left"), F.col("_r").alias("right"), n.cast("long").alias("n"), F.least(F.lit(1.0), F.greatest(most(same), most(turned))).alias("most"))


def _meetings(known: DataFrame, classes: DataFrame, row_keys: Sequence[str], needed: DataFrame | None) -> DataFrame:
    """Rows to be ranked: every item at the keys it shares with a class it meets (``other``)."""
    # one series stands for the key set of its class
    stands = classes.filter(F.col("place") == 0).select("item", F.col("class").alias("other"))
    met = known.join(stands, "item").select(*row_keys, "other")
    rows = known.join(classes, "item").withColumnRenamed("class", "own")
    if needed is None:
        # the classes present at a key, bounded by the number of classes
        return rows.join(met, list(row_keys))
    return rows.join(needed, "item").join(met, [*row_keys, "other"])


def rank_correlations(
    series: DataFrame,
    item: str,
    row_keys: Sequence[str],
    value: str,
    spread: bool,
    min_overlap: int = 2,
    at_least: float = 0.0,
    against: DataFrame | None = None,
    asked: DataFrame | None = None,
) -> DataFrame:
    """(left, right, n, corr) for pairs of series with enough common keys.

    ``spread`` says that a series may hold much of the table, and so how it is
    ranked.  ``series`` is read once if it is so and all pairs are wanted; else it is
    read several times and should be a stored table.  Each pair appears once, with ``left < right``.  Series with constant
    ranks give a NULL correlation.

    ``against``, a column of names, keeps pairs with one of them; with ``asked``, another
    one, the other end is one of those, and no further series is ranked.  ``at_least`` keeps
    pairs with |corr| of that much; pairs whose bound (:func:`pair_bounds`) lies
    below are never ranked, so the rows ranked grow with the pairs that may be close.
    """
    known = series.filter(F.col(value).isNotNull()).select(F.col(item).alias("item"), *row_keys, F.col(value).alias("v"))
    if asked is not None and against is not None:
        known = cut_lineage(_among(known, asked.select(asked.columns[0]).union(against.select(against.columns[0]))))
    if spread and at_least <= 0 and against is None and asked is None:
        packed = packed_rows(known, row_keys)
        known, row_keys = packed.select("row", F.inline("cells")), ["row"]
        supports = _few_supports(known)
        if supports is not None:
            return _named(_pairs_sorted(packed, supports), min_overlap, at_least)
    # one row per series, used several times below
    classes = cut_lineage(support_classes(known, "item", row_keys))
    wanted = needed = None
    if at_least > 0 or against is not None or asked is not None:
        near = pair_bounds(known, row_keys, against, spread, asked).filter((F.col("n") >= min_overlap) & (F.col("most") >= at_least - EDGE))
        wanted = cut_lineage(near.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct())
        needed = needed_rankings(wanted, classes)
    if spread and classes.groupBy("class").count().filter("count > 1").isEmpty():
        return _named(_pairs_alone(known, row_keys, wanted), min_overlap, at_least)
    cross = CrossSection(["item", "other"], spread=spread)
    ranked = cross.centred_rank(_meetings(known, classes, row_keys, needed), "v", "rank")
    first, second = F.least("own", "other"), F.greatest("own", "other")
    vectors = (
        ranked.groupBy(first.alias("left_class"), second.alias("right_class"), *row_keys)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        F.when(F.col("own") == first, 0).otherwise(1).alias("side"), "place", "rank"
                    )
                )
            ).alias("_all"),
        )
        .withColumn("width", F.size(F.filter("_all", lambda e: e["side"] == 0)))
    )
    packed = vectors.select(
        "left_class", "right_class", "width", F.transform("_all", lambda e: e["rank"]).alias("ranks"), F.transform("_all", lambda e: e["place"]).alias("places")
    )
    sums = packed.mapInPandas(
        _pair_sums,
        "left_class string, right_class string, left_place int, right_place int, "
        "n long, sxy double, sxx double, syy double",
    )
    total = sums.groupBy("left_class", "right_class", "left_place", "right_place").agg(
        F.sum("n").alias("n"), F.sum("sxy").alias("sxy"), F.sum("sxx").alias("sxx"), F.sum("syy").alias("syy")
    )
    left = classes.select(F.col("class").alias("left_class"), F.col("place").alias("left_place"), F.col("item").alias("_l"))
    right = classes.select(F.col("class").alias("right_class"), F.col("place").alias("right_place"), F.col("item").alias("_r"))
    named = total.join(left, ["left_class", "left_place"]).join(right, ["right_class", "right_place"])
    if wanted is not None:
        pair = (F.least("_l", "_r") == F.col("left")) & (F.greatest("_l", "_r") == F.col("right"))
        named = named.join(wanted, pair, "left_semi")
    return _named(named, min_overlap, at_least)


def _named(sums: DataFrame, min_overlap: int, at_least: float) -> DataFrame:
    """(left, right, n, corr) from pair sums."""
    corr = F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))
    found = sums.filter(F.col("n") >= min_overlap).select(
        F.least("_l", "_r").alias("left"), F.greatest("_l", "_r").alias("right"), "n", corr.alias("corr")
    )
    return found.filter(F.abs("corr") >= at_least) if at_least > 0 else found


def packed_rows(known: DataFrame, row_keys: Sequence[str]) -> DataFrame:
    """(row, cells): the values at each key side by side, stored; a number stands for the key from here on."""
    cells = known.groupBy(*row_keys).agg(F.collect_list(F.struct("item", "v")).alias("cells"))
    return store(cells.select(F.monotonically_increasing_id().alias("row"), "cells"))


def _few_supports(known: DataFrame) -> list[tuple[str, int, int]] | None:
    """(item, number of its key set, size) of all items, or None if they are more than ``SORTED_ITEMS``."""
    prints = known.groupBy("item").agg(
        F.bit_xor(F.xxhash64("row")).alias("_a"), F.bit_xor(F.xxhash64(F.lit("second"), "row")).alias("_b"), F.count("*").alias("_c"))
    found = prints.limit(SORTED_ITEMS + 1).collect()
    if len(found) > SORTED_ITEMS:
        return None
    sets: dict[tuple, int] = {}
    return [(r["item"], sets.setdefault((r["_a"], r["_b"], r["_c"]), len(sets)), r["_c"]) for r in sorted(found, key=lambda r: r["item"])]


def _pairs_sorted(packed: DataFrame, supports: list[tuple[str, int, int]]) -> DataFrame:
    """Pair sums of few series, each sorted once whatever the number of key sets.

    The rank of a value inside an overlap is the number of keys of the other key set
    up to it in the series' own order, so running counts give the ranks of all
    overlaps along one sort.  Series are cut in value ranges; counts per range, a few
    numbers each, give the places where ranges begin.  Rows travel twice: to their
    range and, as ranks, back to their key.
    """
    if not supports:
        return packed.sparkSession.createDataFrame([], "n long, sxy double, sxx double, syy double, _l string, _r string")
    sets = range(1 + max(s for _, s, _ in supports))
    of_item = lambda values: F.create_map(*[F.lit(x) for (name, *_), v in zip(supports, values, strict=True) for x in (name, v)])
    bits = of_item([1 << s for _, s, _ in supports])
    mask = F.aggregate("cells", F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(bits[c["item"]].cast("long")))
    rows = packed.select("row", mask.alias("mask"), F.inline("cells")).select(
        "row", "mask", of_item(range(len(supports)))[F.col("item")].alias("no"), (F.col("v") + F.lit(0.0)).alias("v"))
    halvings = max(0, (max(c for *_, c in supports) - 1) // RANGE_ROWS).bit_length()
    if halvings:
        marks = [k / 2**halvings for k in range(1, 2**halvings)]
        splits = rows.groupBy("no").agg(F.percentile_approx("v", marks, max(10_000, 32 * 2**halvings)).alias("splits"))
        # at most as many rows as there are series here
        rows = rows.join(F.broadcast(cut_lineage(splits)), "no")
        steps = F.array(*[F.lit(2**h) for h in reversed(range(halvings))])
        beyond = lambda at, step: F.when(F.element_at("splits", at + step) < F.col("v"), at + step).otherwise(at)
        rows = rows.withColumn("range", F.aggregate(steps, F.lit(0), beyond)).drop("splits")
    else:
        rows = rows.withColumn("range", F.lit(0))
    shared = lambda s: F.col("mask").bitwiseAND(F.lit(1 << s)) != 0
    counts = cut_lineage(rows.groupBy("no", "range").agg(*[F.count_if(shared(s)).alias(f"_c{s}") for s in sets]))
    before = Window.partitionBy("no").orderBy("range")
    # counts before the range, doubled, less those of the whole series: what centres twice the rank
    whole = Window.partitionBy("no")
    offsets = counts.select("no", "range", *[(2 * (F.sum(f"_c{s}").over(before) - F.col(f"_c{s}")) - F.sum(f"_c{s}").over(whole)).alias(f"_o{s}") for s in sets])
    order = Window.partitionBy("no", "range").orderBy("v")
    upto, same = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, 0)
    counted = rows.select(
        "row", "mask", "no", "range", *[(2 * F.count_if(shared(s)).over(upto) - F.count_if(shared(s)).over(same)).alias(f"_t{s}") for s in sets])
    # a row per series and range
    placed = counted.join(F.broadcast(offsets), ["no", "range"]).select(
        "row", "no", *[F.when(shared(s), F.col(f"_t{s}") + F.col(f"_o{s}")).otherwise(F.lit(0)).alias(f"_t{s}") for s in sets])
    set_of = np.array([s for _, s, _ in supports])
    sums = placed.repartition("row").sortWithinPartitions("row").mapInPandas(
        lambda batches: _row_sums(batches, set_of), "_ln int, _rn int, n long, sxy double, sxx double, syy double")
    total = sums.groupBy("_ln", "_rn").agg(*[F.sum(c).alias(c) for c in ("n", "sxy", "sxx", "syy")])
    names = lambda side: F.element_at(F.lit([name for name, *_ in supports]), F.col(f"_{side}n") + 1).alias(f"_{side}")
    return total.select("n", "sxy", "sxx", "syy", names("l"), names("r"))


def _row_sums(batches: Iterator[pd.DataFrame], set_of: np.ndarray) -> Iterator[pd.DataFrame]:
    """Add up products of centred ranks of all pairs; rows come in order of their key."""
    items, sets = len(set_of), int(set_of.max()) + 1
    count, sxy, sxx = (np.zeros((items, items)) for _ in range(3))

    def add(part: pd.DataFrame) -> None:
        key = part["row"].to_numpy()
        new = np.r_[True, key[1:] != key[:-1]]
        at, no = np.cumsum(new) - 1, part["no"].to_numpy()
        ranks, there = np.zeros((at[-1] + 1, items, sets)), np.zeros((at[-1] + 1, items))
        there[at, no] = 1.0
        for s in range(sets):
            ranks[at, no, s] = part[f"_t{s}"].to_numpy() / 2.0
        # of every series its ranks among the keys of each other one
        met = ranks[:, :, set_of]
        count[:] += there.T @ there
        sxy[:] += np.einsum("kxy,kyx->xy", met, met)
        sxx[:] += np.einsum("kxy,kxy->xy", met, met)

    rest, most = None, max(1, DENSE_CELLS // items**2)
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        # the last key may go on in the next batch
        key = batch["row"].to_numpy()
        whole = np.searchsorted(key, key[-1]) if len(key) else 0
        starts = np.flatnonzero(np.r_[True, key[1:whole] != key[: whole - 1]])[::most] if whole else []
        for a, b in zip(starts, [*starts[1:], whole]):
            add(batch.iloc[a:b])
        rest = batch.iloc[whole:]
    if rest is not None and len(rest):
        add(rest)
    left, right = np.triu_indices(items, 1)
    met = count[left, right] > 0
    left, right = left[met], right[met]
    yield pd.DataFrame({
        "_ln": left.astype("int32"), "_rn": right.astype("int32"), "n": count[left, right].astype("int64"),
        "sxy": sxy[left, right], "sxx": sxx[left, right], "syy": sxx[right, left]})


def _pairs_alone(known: DataFrame, row_keys: Sequence[str], wanted: DataFrame | None) -> DataFrame:
    """Pair sums where no two series have the same keys, so that a ranking serves one pair only.

    Both values of a pair go along in one slim row, ranked first by one and then by
    the other; keys are needed to bring them together and no longer.
    """
    numbers = cut_lineage(ordinal(known.select("item").distinct(), "_no", F.col("item")))
    own = known.join(numbers, "item").select(*row_keys, F.col("_no").cast("int").alias("_no"), "v")
    met = own.withColumnsRenamed({"_no": "_ln", "v": "_x"}).join(own.withColumnsRenamed({"_no": "_rn", "v": "_y"}), list(row_keys)).filter("_ln < _rn").select("_ln", "_rn", "_x", "_y")
    name = lambda side, out: numbers.select(F.col("_no").cast("int").alias(f"_{side}n"), F.col("item").alias(out))
    if wanted is not None:
        pairs = wanted.join(name("l", "left"), "left").join(name("r", "right"), "right").select("_ln", "_rn")
        met = met.join(pairs, ["_ln", "_rn"], "left_semi")
    cross = CrossSection(["_ln", "_rn"], spread=True)
    ranked = cross.centred_rank(cross.centred_rank(met, "_x", "_rx"), "_y", "_ry")
    x, y = F.col("_rx"), F.col("_ry")
    sums = ranked.groupBy("_ln", "_rn").agg(F.count("*").alias("n"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"))
    return sums.join(name("l", "_l"), "_ln").join(name("r", "_r"), "_rn")


def needed_rankings(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(item, other): the classes each item has to be ranked against for the pairs."""
    ends = pairs.unionByName(pairs.select(F.col("right").alias("left"), F.col("left").alias("right")))
    return ends.join(classes.select(F.col("item").alias("right"), F.col("class").alias("other")), "right").select(F.col("left").alias("item"), "other").distinct()


def value_similarity(
    factors: DataFrame, min_overlap: int = 10_000, at_least: float = 0.0, against: DataFrame | None = None, spread: bool = True,
    asked: DataFrame | None = None,
) -> DataFrame:
    """|Spearman| of factor values on shared (entity, date) keys; the rest as above."""
    pairs = rank_correlations(factors, "factor_name", ["entity", "date"], "value", spread, min_overlap, at_least, against, asked)
    return pairs.select("left", "right", "n", F.abs("corr").alias("similarity"))


def ic_similarity(
    daily: DataFrame, min_days: int = 30, at_least: float = 0.0, against: DataFrame | None = None, asked: DataFrame | None = None
) -> DataFrame:
    """|Spearman| of daily rank-correlation series on shared dates; the rest as above."""
    pairs = rank_correlations(daily, "factor_name", ["date"], "rank_ic", False, min_days, at_least, against, asked)
    return pairs.select("left", "right", "n", F.abs("corr").alias("similarity"))


def common_dates(daily: DataFrame) -> DataFrame:
    """Rows on dates that every series has."""
    series = daily.filter(F.col("rank_ic").isNotNull())
    wanted = series.select("factor_name").distinct().agg(F.count("*").alias("_want"))
    per_date = series.groupBy("date").agg(F.count("*").alias("_have"))
    # one row against one row per date
    full = per_date.filter(F.col("_have") == wanted.scalar())
    return series.join(full.select("date"), "date", "left_semi")


def ic_corr_matrix(daily: DataFrame) -> DataFrame:
    """Symmetric Spearman matrix in long form over the dates all factors share."""
    shared = common_dates(daily)
    pairs = rank_correlations(shared, "factor_name", ["date"], "rank_ic", False)
    half = pairs.select("left", "right", "corr")
    mirrored = half.select(F.col("right").alias("left"), F.col("left").alias("right"), "corr")
    own = shared.select("factor_name").distinct().select(
        F.col("factor_name").alias("left"), F.col("factor_name").alias("right"), F.lit(1.0).alias("corr")
    )
    return half.unionByName(mirrored).unionByName(own)


def max_abs_corr(matrix: DataFrame) -> DataFrame:
    """Largest |correlation| of each factor with another one."""
    return (
        matrix.filter(F.col("left") != F.col("right"))
        .groupBy(F.col("left").alias("factor_name"))
        .agg(F.max(F.abs("corr")).alias("max_abs_corr"))
    )
