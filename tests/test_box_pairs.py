"""Overlapping pairs of boxes: a plain comparison of all pairs, and the time for many of them."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklake.operators import diagnostics
from tracklake.plans import boxpairs

SCHEMA = "query_id int, lat_min double, lat_max double, lon_min double, lon_max double, t_start double, t_end double"


def brute(rows):
    out = {}
    for q in rows:
        for e in rows:
            if e[0] < q[0] and None not in (*q, *e):
                vq, ve = (max(b[2] - b[1], 0) * max(b[4] - b[3], 0) * max(b[6] - b[5], 0) for b in (q, e))
                shared = 1.0
                for i in (1, 3, 5):
                    shared *= max(min(q[i + 1], e[i + 1]) - max(q[i], e[i]), 0.0)
                if shared > 0 and max(vq, ve) > 1e-12 and not (vq + ve - shared) <= 1e-12:
                    iou = shared / (vq + ve - shared)
                    if not iou <= 0:
                        out[q[0], e[0]] = iou
    return out


def mixed(n):
    """Boxes of very different spans, in one place and apart, with equal starts, borders that touch, and odd ones."""
    draw = random.Random(3)
    rows = []
    for i in range(n):
        wide = 4.0 ** draw.randint(-4, 1)
        long = 4.0 ** draw.randint(0, 5)
        lat, lon = draw.choice([-0.5, 0.0]) + draw.random() * wide, draw.choice([-0.1, 0.0]) + draw.random() * wide
        t = draw.choice([-50.0, 0.0, 0.0, 1.7e9]) + draw.randint(0, 3) * long / 2
        rows.append((i, lat, lat + wide, lon, lon + wide * draw.choice([0.3, 1.0]), t, t + long))
    inf = float("inf")
    rows += [(n, -inf, inf, 0.0, 1.0, 0.0, 5.0), (n + 1, 0.0, 1.0, 0.0, 1.0, -inf, 100.0), (n + 2, 0.0, 1.0, 0.0, 1.0, 5.0, 4.0)]
    rows += [(n + 3, 0.0, 1.0, 0.0, 1.0, None, 4.0), (n + 4, 0.0, 0.0, 0.0, 1.0, 0.0, 5.0), (n + 5, 0.0, 1.0, 0.0, 1.0, 100.0, inf)]
    rows += [(n + 6 + i, 0.0, 1.0, 0.0, 1.0, 0.0, 4.0) for i in range(12)] + [(n + 18, 1.0, 2.0, 0.0, 1.0, 0.0, 4.0), (n + 19, 0.0, 1.0, 0.0, 1.0, 4.0, 8.0)]
    return rows


@pytest.mark.parametrize("kind,cell_boxes,pairs_at_once", [("int", 3_000, 250_000), ("bigint", 5, 12)])
def test_pairs_like_a_plain_comparison(spark, monkeypatch, kind, cell_boxes, pairs_at_once):
    monkeypatch.setattr(boxpairs, "CELL_BOXES", cell_boxes)
    monkeypatch.setattr(boxpairs, "PAIRS_AT_ONCE", pairs_at_once)
    rows = mixed(300)
    random.Random(4).shuffle(rows)
    want = brute(rows)
    boxes = spark.createDataFrame(rows, SCHEMA.replace("query_id int", f"query_id {kind}")).repartition(3)
    got = boxpairs.overlaps(boxes)
    assert dict(got.dtypes) == {"query_id": kind, "earlier_id": kind, "iou": "double"}
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(want) > 500 and {r[:2] for r in got} == set(want)
    for q, e, iou in got:
        assert iou == want[q, e] or (math.isnan(iou) and math.isnan(want[q, e]))
    assert boxpairs.overlaps(boxes.limit(0)).count() == 0


def test_time_of_many_pairs(spark):
    """8,000 boxes like those around track starts; with 4 threads the join by cells took 25 s, this one under 6."""
    n = 8_000
    rng = np.random.default_rng(5)
    lat, lon, t = 54 + 3 * rng.random(n) ** 2, 9 + 4 * rng.random(n) ** 2, 1.704e9 + 2.5e6 * rng.random(n) ** 2
    sides = [(x - w * j, x + w * j) for x, w, j in ((v, w, rng.uniform(0.75, 1.25, n)) for v, w in ((lat, 0.15), (lon, 0.19), (t, 2.4e5)))]
    columns = [np.arange(n).tolist(), *[c.tolist() for side in sides for c in side]]
    boxes = spark.createDataFrame(list(zip(*columns)), SCHEMA).repartition(4).localCheckpoint()
    start = time.time()
    found = diagnostics.box_iou(boxes).filter("iou > 1e-6").agg(F.count("iou"), F.sum(F.round("iou", 8))).first()
    took = time.time() - start
    pairs = sum(np.logical_and.reduce([(lo[i + 1 :] < hi[i]) & (lo[i] < hi[i + 1 :]) for lo, hi in sides]).sum() for i in range(n))
    assert 0.999 * pairs < found[0] <= pairs
    assert took < 15
