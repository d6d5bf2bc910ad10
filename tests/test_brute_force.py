"""Queries without SQL, against plain loops on a small fixture."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import fixtures
from tracklake.operators import features, labels, simplify, workload
from tracklake.operators.ranges import query_hits

from .conftest import SF


@pytest.fixture(scope="module")
def data(spark):
    p = fixtures.points(spark, SF).withColumn("score", (F.col("report_id") * 7919 % 1000) / 1000.0)
    pdf = p.toPandas().sort_values(["traj_id", "pos"])
    return p, {k: g.reset_index(drop=True) for k, g in pdf.groupby("traj_id")}


def kept_of(df):
    out = {}
    for r in df.select("traj_id", "pos").collect():
        out.setdefault(r["traj_id"], set()).add(r["pos"])
    return out


def budget(n, ratio):
    return min(n, max(2, math.ceil(ratio * n)))


def spaced(n, k):
    if k <= 0:
        return []
    return list(range(n)) if k >= n else [int(v) for v in np.rint(np.arange(k) * (n - 1) / max(1, k - 1))]


def test_local_swap(data):
    p, groups = data
    got = kept_of(simplify.simplify_hybrid(p, 0.4, 0.5, mode="local_swap"))
    for tid, g in groups.items():
        n, s = len(g), g["score"].tolist()
        k = budget(n, 0.4)
        base = spaced(n, k)
        free = [b for b in base if b not in (0, n - 1)]
        m = max(0, min(k - min(k, max(2, math.ceil(k * 0.5))), n - k, len(free)))
        keep = set(base)
        for a in sorted((i for i in range(n) if i not in base), key=lambda i: (-s[i], i))[:m]:
            out = min(free, key=lambda b: (abs(b - a), b))
            free.remove(out)
            keep = keep - {out} | {a}
        assert got[tid] == keep


def test_local_delta_swap(data):
    p, groups = data
    got = kept_of(simplify.simplify_hybrid(p, 0.4, 0.5, mode="local_delta_swap"))
    for tid, g in groups.items():
        n, s = len(g), g["score"].tolist()
        k = budget(n, 0.4)
        base = spaced(n, k)
        free = [b for b in base if b not in (0, n - 1)]
        cand = [i for i in range(n) if i not in base]
        keep = set(base)
        for _ in range(max(0, min(k - min(k, max(2, math.ceil(k * 0.5))), n - k, len(free)))):
            if not free or not cand:
                break
            options = [(s[c] - s[min(free, key=lambda b: (abs(b - c), b))], -c) for c in cand]
            gain, c = max(options)
            if gain <= 0:
                break
            out = min(free, key=lambda b: (abs(b + c), b))
            free.remove(out)
            cand.remove(-c)
            keep = keep - {out} | {-c}
        assert got[tid] == keep


def test_segment_budget_spends_the_budget(data):
    p, groups = data
    rows = simplify.simplify_segment_budget(p, 0.3).collect()
    total = sum(budget(len(g), 0.3) for g in groups.values())
    assert len(rows) == len({(r["traj_id"], r["pos"]) for r in rows}) == total
    ends = {(r["traj_id"], r["pos"]) for r in rows if r["reason"] == "skeleton"}
    assert ends == {(t, e) for t, g in groups.items() for e in (0, len(g) - 1)}


@pytest.mark.parametrize("second, size", [(None, 8), ("other", 20)])
def test_segment_budget_picks(data, second, size):
    p, groups = data
    p = p.withColumn("other", (F.col("report_id") * 104729 % 97) / 97.0)
    other = {(r["traj_id"], r["pos"]): r["other"] for r in p.select("traj_id", "pos", "other").collect()}
    got = {(r["traj_id"], r["pos"]) for r in simplify.simplify_segment_budget(p, 0.4, second, size=size).collect() if r["reason"] != "fallback"}
    total = sum(budget(len(g), 0.4) for g in groups.values())
    blocks = simplify.block_scores(p, second or "score", size)
    value = {(r["traj_id"], r["block"]): r["block_score"] for r in blocks.collect()}
    slots = {(r["traj_id"], r["block"]): r["slots"] for r in simplify.allocate_slots(blocks, total - 2 * len(groups), total, size=size).collect()}

    def km(g, i, j):
        shrink = max(0.1, abs(math.cos(math.radians((g["lat"][i] + g["lat"][j]) / 2))))
        return 111.32 * math.sqrt((g["lat"][i] - g["lat"][j]) ** 2 + ((g["lon"][i] - g["lon"][j]) * shrink) ** 2)

    def stretched(v):
        low, high = min(v.values()), max(v.values())
        return {i: 0.0 if high - low <= 1e-12 else (x - low) / (high - low) for i, x in v.items()}

    want = set()
    for tid, g in groups.items():
        n = len(g)
        kept = {0, n - 1}
        for block in sorted((b for t, b in slots if t == tid), key=lambda b: (-value[tid, b], b)):
            inside = range(block * size, min(n, block * size + size))
            open_ = set(inside) - kept
            for _ in range(slots[tid, block]):
                if not open_:
                    break
                worth = {i: g["score"][i] for i in open_}
                if second:
                    one, two = stretched(worth), stretched({i: other[tid, i] for i in open_})
                    worth = {i: 0.95 * one[i] + 0.05 * two[i] for i in open_}
                gain = {}
                for i in open_:
                    a, b = max(k for k in kept if k < i), min(k for k in kept if k > i)
                    gain[i] = max(0.0, km(g, a, i) + km(g, i, b) - km(g, a, b))
                worth, gain = stretched(worth), stretched(gain)
                best = max(sorted(open_), key=lambda i: round(0.88 * worth[i] + 0.12 * gain[i], 12))
                kept.add(best)
                open_ = {i for i in open_ if abs(i - best) > len(inside) // 10}
        want |= {(tid, i) for i in kept}
    assert got == want and len(want) > 2 * len(groups)


def test_slots_match_one_by_one_picking(data):
    p, groups = data
    size, total = 8, sum(budget(len(g), 0.5) for g in groups.values())
    blocks = simplify.block_scores(p, size=size)
    remaining = total - 2 * len(groups)
    got = {(r["traj_id"], r["block"]): r["slots"] for r in simplify.allocate_slots(blocks, remaining, total, size=size).collect()}
    rows = [r.asDict() for r in blocks.collect()]
    lo, hi = min(r["block_score"] for r in rows), max(r["block_score"] for r in rows)
    cap = max(1, math.ceil(total * 0.2), math.ceil(total / len(groups)))
    ship = {t: 2 for t in groups}
    given, left = {}, remaining
    for r in rows:
        last = (r["n_points"] - 1) // size
        r["room"] = r["block_length"] - (r["block"] == 0) - (r["block"] == last)
        r["w"] = 0.5 + (r["block_score"] - lo) / (hi - lo)
    if left >= len(groups):
        for t in groups:
            best = max((r for r in rows if r["traj_id"] == t), key=lambda r: (r["block_score"], -r["block"]))
            if best["room"] > 0 and ship[t] < cap:
                given[t, best["block"]] = 1
                ship[t] += 1
                left -= 1
    while left > 0:
        live = [r for r in rows if ship[r["traj_id"]] < cap and given.get((r["traj_id"], r["block"]), 0) < r["room"]]
        if not live:
            break
        def key(r):
            j = given.get((r["traj_id"], r["block"]), 0)
            return (math.log(r["w"]) - math.log(j + 1), -j, r["block_score"], -r["traj_id"], -r["block"])
        best = max(live, key=key)
        k = best["traj_id"], best["block"]
        given[k] = given.get(k, 0) + 1
        ship[k[0]] += 1
        left -= 1
    assert got == given


def test_marginal_coverage(data):
    p, groups = data
    lab = p.select("traj_id", "pos", F.col("score").alias("label"))
    got = kept_of(labels.marginal_coverage(p, lab, 0.3))
    for tid, g in groups.items():
        n, s = len(g), g["score"].to_numpy()
        k = budget(n, 0.3)
        base = spaced(n, min(k, max(2, math.ceil(k * 0.5))))
        radius = math.ceil(0.5 * n / k)
        keep, rest = set(base), s.copy()
        for b in base:
            rest[max(0, b - radius) : b + radius + 1] = 0
        while len(keep) < k:
            gain = np.array([rest[max(0, i - radius) : i + radius + 1].sum() for i in range(n)])
            open_ = [i for i in range(n) if i not in keep]
            if not any(gain[i] > 1e-12 for i in open_):
                gain = np.array([float(min(abs(i - j) for j in keep)) for i in range(n)])
            gain = gain + 1e-3 * s
            best = max(open_, key=lambda i: (round(gain[i], 12), -i))
            keep.add(best)
            rest[max(0, best - radius) : best + radius + 1] = 0
        assert len(got[tid]) == len(keep)
        assert got[tid] == keep


@pytest.mark.parametrize("block_rows", [50_000, 150])
def test_knn(data, block_rows):
    p, _ = data
    h = p.select("traj_id", "pos", F.col("score").alias("target"), "speed", (F.col("heading") / 360.0).alias("course"))
    got = features.knn_prior_score(h, h, ["speed", "course"], k=4, leave_one_out=True, block_rows=block_rows).collect()
    pdf = h.toPandas()
    x, y = pdf[["speed", "course"]].to_numpy(), pdf["target"].to_numpy()
    at = {(a, b): i for i, (a, b) in enumerate(zip(pdf["traj_id"], pdf["pos"]))}
    assert len(got) == len(pdf)
    for r in got:
        i = at[r["traj_id"], r["pos"]]
        d2 = ((x - x[i]) ** 2).sum(axis=1)
        d2[i] = np.inf
        best = np.lexsort((y, d2))[:4]
        w = 1 / (d2[best] + 1e-4)
        assert r["score"] == pytest.approx(float((w * y[best]).sum() / w.sum()))


def test_generated_workload_keeps_its_promises(spark, data):
    p, _ = data
    limits = workload.Limits(3, 1, 0.5, None, None, 0.65)
    w = workload.generate_workload(p, 4, seed=1, profile_id="free", target_coverage=0.2, coverage_tolerance=0.3, max_queries=12,
                                   spatial_km=60.0, time_hours=120.0, limits=limits)
    stats = w.stats.first()
    hits = query_hits(p, w.queries)
    counts = [r["count"] for r in hits.groupBy("query_id").count().collect()]
    assert len(counts) == stats["queries"] and min(counts) >= 3 and max(counts) <= 0.5 * p.count()
    covered = hits.select("traj_id", "pos").distinct().count() / p.count()
    assert covered == pytest.approx(stats["coverage"]) and covered <= 0.5 + 1e-9
    again = workload.generate_workload(p, 4, seed=1, profile_id="free", target_coverage=0.2, coverage_tolerance=0.3, max_queries=12,
                                       spatial_km=60.0, time_hours=120.0, limits=limits, batch=8)
    assert sorted(map(tuple, w.queries.select("lat_min", "t_start").collect())) == sorted(map(tuple, again.queries.select("lat_min", "t_start").collect()))


def test_swaps_and_covering_on_random_tracks():
    """The array and heap forms against plain loops, with many ties."""
    from tracklake.operators.labels import _covering_picks
    from tracklake.operators.simplify import _local_delta_swap, _local_swap

    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(2, 40))
        score = rng.integers(0, 5, n) / 4.0
        order = rng.permutation(n)
        cut = int(rng.integers(0, n + 1))
        base, others = np.sort(order[:cut]), np.sort(order[cut:])
        free, gone, added = base.tolist(), [], []
        for a in sorted(others.tolist(), key=lambda p: (-score[p], p)):
            if free:
                out = min(free, key=lambda p: (abs(p - a), p))
                free.remove(out)
                gone.append(out)
                added.append(a)
        assert _local_swap(score, base, others) == (added, gone)

        free, cand, gone, added, count = base.tolist(), others.tolist(), [], [], int(rng.integers(0, n))
        while free and cand and len(added) < count:
            near = {c: min(free, key=lambda p: (abs(p - c), p)) for c in cand}
            best = max(cand, key=lambda c: (score[c] - score[near[c]], -c))
            if score[best] - score[near[best]] <= 0:
                break
            added.append(best)
            gone.append(near[best])
            free.remove(near[best])
            cand.remove(best)
        assert _local_delta_swap(score, base, others, count) == (added, gone)

        kept, radius, want = np.zeros(n, dtype=bool), int(rng.integers(0, 4)), int(rng.integers(0, n))
        kept[base[: int(rng.integers(0, 3))]] = True
        got, rest, mine = _covering_picks(score, kept, radius, want), score.copy(), kept.copy()
        for b in np.flatnonzero(mine):
            rest[max(0, b - radius) : b + radius + 1] = 0
        for _ in range(min(want, int((~kept).sum()))):
            gain = np.array([rest[max(0, i - radius) : i + radius + 1].sum() for i in range(n)])
            if not (gain[~mine] > 1e-12).any():
                gain = np.array([min([abs(i - j) for j in np.flatnonzero(mine)], default=1) for i in range(n)], dtype=float)
            best = max(np.flatnonzero(~mine), key=lambda i: (round(gain[i] + 1e-3 * score[i], 12), -i))
            mine[best] = True
            rest[max(0, best - radius) : best + radius + 1] = 0
        assert (got == mine).all()
