"""Components of few links and of many parts (F3)."""

from __future__ import annotations

import numpy as np

from tallyspark.llm import components as cc


def test_few_links_take_few_jobs(spark):
    """Links that fit one part need no rounds, whatever the path's length."""
    n = 3000
    order = np.random.default_rng(3).permutation(n).tolist()
    edges = spark.createDataFrame([*zip(order, order[1:], strict=False), (n + 1, n), (n + 2, n + 2)], "a long, b long")
    spark.sparkContext.setJobGroup("few-links", "")
    got = cc.components(edges)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.node: r.root for r in got.collect()} == {**dict.fromkeys(range(n), 0), n: n, n + 1: n}
    assert jobs <= 6


def test_links_of_many_parts(spark, monkeypatch):
    """Stars of parts go on by rounds, which find the same components; nodes are binary, as the operator's are."""
    monkeypatch.setattr(cc, "PART", 50)
    rng = np.random.default_rng(4)
    pairs = rng.integers(0, 900, (600, 2)).tolist()
    least = {x: x for p in pairs for x in p}
    for _ in range(900):
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    name = lambda k: k.to_bytes(2, "big")
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in cc.components(edges).collect()}
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {name(x): name(least[x]) for x in touched}
