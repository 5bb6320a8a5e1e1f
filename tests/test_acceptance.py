"""Acceptance in rounds equals acceptance one by one."""

import random

import pytest

from panelwright.operators import acceptance


def one_by_one(order, groups, conflicts):
    accepted, used = {}, set()
    for name in sorted(order, key=order.get):
        keys = {(i, k) for i, k in enumerate(groups[name]) if k}
        ok = not keys & used and not any(accepted[r] for r in conflicts.get(name, ()))
        accepted[name] = ok
        used |= keys if ok else set()
    return accepted


def settle(spark, order, groups, conflicts):
    rows = [(n, o, *groups[n]) for n, o in order.items()]
    pairs = [(n, r) for n, rs in conflicts.items() for r in rs]
    table = spark.createDataFrame(rows, "name string, order int, g string, h string").repartition(4)
    state, rounds = acceptance.settle(table, spark.createDataFrame(pairs, "name string, rival string"), ["g", "h"])
    return {r["name"]: r["accepted"] for r in state.collect()}, rounds


def test_a_chain_of_a_thousand_takes_few_rounds(spark):
    names = [f"n{i:04d}" for i in range(1000)]
    order = {n: i for i, n in enumerate(names)}
    groups = dict.fromkeys(names, (None, ""))
    conflicts = {b: [a] for a, b in zip(names, names[1:], strict=False)}
    got, rounds = settle(spark, order, groups, conflicts)
    assert got == {n: i % 2 == 0 for n, i in order.items()} and rounds <= 13


def test_a_chain_through_small_groups_takes_few_rounds(spark):
    names = [f"n{i:03d}" for i in range(200)]
    order = {n: i for i, n in enumerate(names)}
    groups = {n: (f"g{i // 2}", f"h{(i + 1) // 2}") for i, n in enumerate(names)}
    got, rounds = settle(spark, order, groups, {})
    assert got == one_by_one(order, groups, {}) and rounds <= 12


@pytest.mark.parametrize("seed", range(3))
def test_random_conflicts_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:03d}" for i in range(150)]
    order = dict(zip(names, rng.sample(range(1000), 150), strict=True))
    groups = {n: (rng.choice([None, "", *"abcdefghijklmnop"]), rng.choice([None, *map(str, range(60))])) for n in names}
    conflicts = {}
    for a in names:
        conflicts[a] = [b for b in rng.sample(names, 3) if order[b] < order[a]]
    got, _ = settle(spark, order, groups, conflicts)
    assert got == one_by_one(order, groups, conflicts)


def test_nothing_to_settle(spark):
    got, rounds = settle(spark, {}, {}, {})
    assert got == {} and rounds == 0
