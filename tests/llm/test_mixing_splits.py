import itertools
import random

import pytest
from pyspark.sql import functions as F

from slatework.llm import mixing, splits


def test_shares_positions_and_repeats(spark):
    rnd = random.Random(1)
    docs = [(i, "big" if i % 3 else "small", rnd.randint(1, 20)) for i in range(6000)]
    docs += [(9001, None, 5), (9002, "big", 0), (9003, "other", 5)]
    targets = [("big", 0.5, 2), ("small", 0.5, 2), ("absent", 0.2, 3)]
    placed, report = mixing.mixed(spark.createDataFrame(docs, "id long, source string, tokens long"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    rep = {r.source: r for r in report.collect()}
    assert rep["big"].reached_share == pytest.approx(0.5, abs=0.005)
    assert rep["small"].repeats == 2
    assert (rep["absent"].used_tokens, rep["absent"].reached_share) == (0, 0.0)
    rows = placed.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert len({(r.id, r.repeat) for r in rows}) == len(rows)
    assert {r.source for r in rows} == {"big", "small"}
    # The curriculum: the smaller source's weight falls while the other's rises.
    total = max(r.position for r in rows)
    early, late = ([r for r in rows if (r.position < total / 4) == first and (first or r.position > 3 * total / 4)] for first in (True, False))
    share = lambda part: sum(r.tokens for r in part if r.source == "small") / sum(r.tokens for r in part)
    assert share(early) > 0.55 > 0.45 > share(late)


def test_running_totals_equal_a_plain_sum(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    df = spark.createDataFrame([(i, "s" if i < 150 else "t", i % 7 + 1) for i in range(200)], "id long, source string, tokens long")
    got = mixing.running_totals(df, 42, 200).collect()
    for s in ("s", "t"):
        part = sorted((r for r in got if r.source == s), key=lambda r: r.before)
        assert [r.before for r in part] == [0, *itertools.accumulate(r.tokens for r in part)][:-1]


def test_empty_mix(spark):
    placed, report = mixing.mixed(spark.createDataFrame([], "id long, source string, tokens long"), spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert placed.count() == 0
    assert report.first()["reached_share"] == 0.0


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_components_equal_union_find(spark):
    rnd = random.Random(4)
    edges = [(f"n{rnd.randint(0, 120):03d}", f"n{rnd.randint(0, 120):03d}") for _ in range(90)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)] + [("p003", "p003"), ("z", "z")] + edges[:5]
    rnd.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, "x"), ("y", None)], "a string, b string")
    assert {r.node: r.component for r in splits.components(df).collect()} == union_find(edges)


def test_choose_is_closest():
    rnd = random.Random(2)
    for _ in range(60):
        sizes = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(4)}
        goal = rnd.randint(1, 60)
        got = splits.choose(list(sizes.items()), goal)
        assert all(0 < n <= sizes[s] for s, n in got.items())
        sums = {sum(s * k for s, k in zip(sizes, ks, strict=True)) for ks in itertools.product(*[range(n + 1) for n in sizes.values()])}
        best = min(abs(x - goal) for x in sums)
        assert abs(sum(s * n for s, n in got.items()) - goal) == best
    assert splits.choose([], 5) == {}


def test_assign_in_units(monkeypatch):
    monkeypatch.setattr(splits, "BITS", 100)
    sizes = {1: 900, 7: 30, 500: 3, 333: 4}
    total = sum(s * n for s, n in sizes.items())
    plan = splits.assign(sizes, [("train", 0.8), ("val", 0.1), ("holdout", 0.1)])
    used = {k: sum(s * n for s, n in v.items()) for k, v in plan.items()}
    assert sum(used.values()) == total
    assert used["val"] == pytest.approx(total * 0.1, abs=total / 100)
    assert all(sum(v.get(s, 0) for v in plan.values()) == n for s, n in sizes.items())


@pytest.mark.parametrize("sizes", [{3: 200_000}, {29: 340_000}, {29: 20_000, 31: 900, 4001: 7}])
def test_assign_is_exact_without_singletons(sizes):
    total = sum(s * n for s, n in sizes.items())
    plan = splits.assign(sizes, [("train", 0.8), ("val", 0.1), ("holdout", 0.1)])
    for name in ("val", "holdout"):
        assert abs(sum(s * n for s, n in plan[name].items()) - round(total * 0.1)) <= min(sizes) // 2
    assert all(sum(v.get(s, 0) for v in plan.values()) == n for s, n in sizes.items())


def test_choice_is_the_same_however_many_bits_are_kept(monkeypatch):
    rnd = random.Random(6)
    cases = [({rnd.randint(2, 90): rnd.randint(1, 40) for _ in range(12)}, rnd.randint(1, 900)) for _ in range(20)]
    whole = [splits.choose(list(sizes.items()), goal) for sizes, goal in cases]
    monkeypatch.setattr(splits, "BITS", 1)
    assert [splits.choose(list(sizes.items()), goal) for sizes, goal in cases] == whole


def test_records_that_share_a_key_stay_together(spark):
    rnd = random.Random(3)
    rows = [(i, f"a{rnd.randint(0, 60)}" if i % 9 else None, f"b{rnd.randint(0, 200)}" if i % 4 == 0 else None) for i in range(600)]
    rows += [(1000 + i, "hot", None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, author string, entity string").withColumn("split", F.lit("old"))
    out = {r.id: r for r in splits.grouped_splits(df, "id", ["author", "entity"], [("train", 0.8), ("val", 0.1), ("holdout", 0.1)]).collect()}
    assert len(out) == len(rows)
    for k in (1, 2):
        seen = {}
        for r in rows:
            if r[k] is not None:
                assert seen.setdefault(r[k], out[r[0]].split) == out[r[0]].split
    assert splits.grouped_splits(df.where("false"), "id", ["author"], [("train", 1.0)]).count() == 0
