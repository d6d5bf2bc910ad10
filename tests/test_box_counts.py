"""Counts in boxes and first duplicates against plain loops, with cells and blocks cut small."""

import random

import pytest

from checks import fixtures
from checks.workload import starts
from tracklake.operators import diagnostics, ranges
from tracklake.plans import boxcount

from .conftest import SF

SCHEMA = "query_id int, lat_min double, lat_max double, lon_min double, lon_max double, t_start double, t_end double"
AXES = (("lat", "lat_min", "lat_max"), ("lon", "lon_min", "lon_max"), ("t", "t_start", "t_end"))


def odd_boxes(spark):
    """Close copies, a box of everything, one without end, flat ones and one that is turned round."""
    draw = random.Random(3)
    rows = []
    for i in range(60):
        at = 55 + draw.random(), 10 + 2 * draw.random(), 1704067200.0 + 2e6 * draw.random()
        span = 0.2 * 3.0 ** -draw.randrange(4)
        rows.append((i * 3, at[0], at[0] + span, at[1], at[1] + span, at[2], at[2] + 4e5))
    rows += [(r[0] + 1, r[1], r[2], r[3], r[4], r[5] + 1000.0, r[6]) for r in rows[::2]]
    rows += [(500, 50.0, 65.0, 5.0, 25.0, 0.0, 2e9), (501, 54.0, 56.0, 9.0, 12.0, -float("inf"), float("inf")), (502, 55.0, 55.0, 10.0, 10.0, 1.7e9, 1.7e9), (503, 55.0, 55.0, 10.0, 11.0, 1.7e9, 1.8e9), (504, 56.0, 55.0, 9.0, 12.0, 1.7e9, 1.8e9)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("small", [False, True])
def test_counts_cover_and_duplicates(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(boxcount, "CELL_POINTS", 30)
        monkeypatch.setattr(boxcount, "CELL_BOXES", 7)
        monkeypatch.setattr(boxcount, "PAIRS_AT_ONCE", 20)
    p = fixtures.points(spark, SF)
    pts = [r.asDict() for r in p.select("traj_id", "pos", "t", "lat", "lon").collect()]
    boxes = odd_boxes(spark)
    bxs = sorted((r.asDict() for r in boxes.collect()), key=lambda b: b["query_id"])
    held = {b["query_id"]: [(q["traj_id"], q["pos"]) for q in pts if all(b[lo] <= q[a] <= b[hi] for a, lo, hi in AXES)] for b in bxs}
    got = {r["query_id"]: (r["point_hits"], r["track_hits"]) for r in boxcount.count_in_boxes(p, boxes).collect()}
    assert {q: got.get(q, (0, 0)) for q in held} == {q: (len(h), len({t for t, _ in h})) for q, h in held.items()}
    some = boxes.filter("query_id < 500")
    assert ranges.union_coverage(p, some).first()["covered_points"] == len({x for q, h in held.items() if q < 500 for x in h})

    pairs: dict = {}
    for r in diagnostics.box_iou(boxes.filter("query_id <> 501")).collect():
        pairs.setdefault(r["query_id"], []).append((r["earlier_id"], r["iou"]))
    want = {}
    for q, found in pairs.items():
        found.sort()
        first = next((e for e, v in found if v >= 0.3), None)
        want[q] = (first, max(v for e, v in found if first is None or e <= first))
    near = diagnostics.near_duplicates(boxes, 0.3, first_block=4 if small else 4096).collect()
    assert len({v[0] for v in want.values()}) > 5
    assert {r["query_id"]: (r["near_duplicate_of"], pytest.approx(r["near_duplicate_iou"], abs=1e-12)) for r in near} == want
    # no pair of a point and a box is moved: the diagnostics hold no join on cells of many keys
    plan = boxcount.count_in_boxes(p, starts(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan
