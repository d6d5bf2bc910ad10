"""What a group of op10 holds in memory, and that holding less loses nothing."""

import tracemalloc

import numpy as np

from tracklake.llm import neighbours


def best(ids, x, query_ids, queries, k):
    """Plain comparison; scores are sums in the order of the components."""
    out = set()
    rows = {(int(i), tuple(v)) for i, v in zip(ids, x)}
    for q, a in {(int(i), tuple(v)) for i, v in zip(query_ids, queries)}:
        found = sorted((-sum(m * n for m, n in zip(a, b)), i) for i, b in rows if i != q)
        out |= {(q, i, -s) for s, i in found[:k]}
    return out


def test_memory_of_a_group_is_bounded():
    """All found pairs of 4,000 queries with their vectors took 731 MB."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(7_000, 64))
    ids = np.arange(7_000)
    tracemalloc.start()
    found = neighbours.best_in_shard(ids[:3_000], x[:3_000], ids[3_000:], x[3_000:], 20, neighbours.FACTOR)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) == 80_000
    assert peak < 150e6


def test_held_pairs_are_cut_to_the_best(monkeypatch):
    """Hundreds of equal scores, copies, and ids that stand at several vectors, while a walk holds few pairs."""
    monkeypatch.setattr(neighbours, "HELD_PAIRS", 300)
    monkeypatch.setattr(neighbours, "WALK_QUERIES", 7)
    monkeypatch.setattr(neighbours, "COPIED_NUMBERS", 64)
    rng = np.random.default_rng(1)
    x = rng.integers(-1, 2, (900, 5)).astype(float)
    x = x[(x != 0).any(axis=1)]
    x[x == 0] *= -1.0  # 0.0 and -0.0 are equal
    ids = rng.integers(0, 500, len(x))
    ids[:40] = 20
    asks = ids % 20 == 0
    # one vector per query id: rows that share one are ranked apart from here
    query_ids, at = np.unique(ids[asks], return_index=True)
    queries = x[asks][at]
    for k in (1, 6, 30):
        got = list(zip(*neighbours.best_in_shard(ids, x, query_ids, queries, k, 1.0)))
        want = best(ids, x, query_ids, queries, k)
        assert {(int(q), int(i), float(s)) for q, i, s in got} == want


def test_floats_travel_as_floats(spark):
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    frames = [spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>") for kind in ("float", "double")]
    rows = [neighbours.nearest(df, neighbours.every(20), k=5, factor=1.0, shard_rows=40, block_queries=6) for df in frames]
    a, b = (sorted(map(tuple, r.collect())) for r in rows)
    assert a == b and len(a) == 75
    plans = [r._jdf.queryExecution().analyzed().toString() for r in rows]
    assert "as array<double>" not in plans[0]
