"""Queries without SQL read whole tables: brute force over the smallest ones."""

import pandas as pd

from slatework.plans.catalogue import QUERIES


def test_stable_assignment_has_all_customers(spark, sf):
    customers = pd.read_parquet(f"{sf}/customer.parquet")["c_custkey"].tolist()
    sites = [(k, (k * 6971 + 13) % 1000, k * 15485 % 1000) for k in pd.read_parquet(f"{sf}/supplier.parquet")["s_suppkey"].tolist()]
    near = []
    for k in customers:
        x, y = k * 7919 % 1100, k * 104729 % 1100
        for s, cx, cy in sites:
            boundary = (max(abs(x - cx) - 15, 0) ** 2 + max(abs(y - cy) - 15, 0) ** 2) ** 0.5
            if boundary <= 40:
                near.append((boundary, s, ((x - cx) ** 2 + (y - cy) ** 2) ** 0.5, k))
    want = {}
    while near:
        picks = {}
        for boundary, s, centre, k in sorted(near, key=lambda c: c[:2]):
            picks.setdefault(k, (s, centre))
        won = {}
        for k, (s, centre) in picks.items():
            won[s] = min(won.get(s, (centre, k)), (centre, k))
        want |= {k: s for s, (_, k) in won.items()}
        near = [c for c in near if c[3] not in want and c[1] not in won]
    got = {r.pid: r.bid for r in QUERIES["stable_assignment"](spark, sf).collect()}
    assert got == want
    assert any(k % 5 for k in got)


def test_stable_assignment_of_one_place_needs_no_job_for_every_pair(spark, tmp_path):
    pd.DataFrame({"c_custkey": [1100 * i for i in range(1, 301)], "c_nationkey": 1}).to_parquet(tmp_path / "customer.parquet")  # all at (0, 0)
    pd.DataFrame({"s_suppkey": [1000 * i for i in range(1, 41)]}).to_parquet(tmp_path / "supplier.parquet")  # all at (13, 0)
    spark.sparkContext.setJobGroup("one-place", "")
    try:
        got = {r.pid: r.bid for r in QUERIES["stable_assignment"](spark, str(tmp_path)).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one-place"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {1100 * i: 1000 * i for i in range(1, 41)}
    assert jobs <= 40  # a round makes one pair, and had two jobs and more
