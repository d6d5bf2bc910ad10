"""Components against a union-find, in both plans."""

import random

import pytest

from tracklake.llm import components as c


@pytest.mark.parametrize("small", [300_000, 0])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(c, "SMALL_NODES", small)
    rng = random.Random(0)
    links = [(i, i + 1) for i in range(1000, 1040)] + [(5, k) for k in range(6, 60)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(220)] + [(7, 7), (6, 5)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in c.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in link and link[0] != link[1] for link in links)}
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0
