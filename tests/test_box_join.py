"""The shuffled and the broadcast plan of the box join, and a plain comparison of all pairs."""

import pytest

from checks import fixtures
from checks.workload import starts
from tracklake.operators import diagnostics, ranges
from tracklake.plans import boxjoin

from .conftest import SF


@pytest.mark.parametrize("limit", [0, 500_000])
def test_hits_crossings_and_overlaps(spark, monkeypatch, limit):
    monkeypatch.setattr(boxjoin, "BROADCAST_KEYS", limit)
    p = fixtures.points(spark, SF)
    boxes = starts(spark, SF)
    pts = [r.asDict() for r in p.select("traj_id", "pos", "t", "lat", "lon").collect()]
    bxs = [r.asDict() for r in boxes.collect()]
    want = {
        (b["query_id"], q["traj_id"], q["pos"])
        for b in bxs
        for q in pts
        if b["t_start"] <= q["t"] <= b["t_end"] and b["lat_min"] <= q["lat"] <= b["lat_max"] and b["lon_min"] <= q["lon"] <= b["lon_max"]
    }
    rows = ranges.query_hits(p, boxes).select("query_id", "traj_id", "pos").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    crossings = ranges.segment_crossings(p, boxes).collect()
    assert len(crossings) == len(set(crossings)) > 0

    def overlap(a, b):
        out = 1.0
        for lo, hi in (("lat_min", "lat_max"), ("lon_min", "lon_max"), ("t_start", "t_end")):
            out *= max(0.0, min(a[hi], b[hi]) - max(a[lo], b[lo]))
        return out

    pairs = {(a["query_id"], b["query_id"]) for a in bxs for b in bxs if b["query_id"] < a["query_id"] and overlap(a, b) > 0}
    got = diagnostics.box_iou(boxes).select("query_id", "earlier_id").collect()
    assert len(got) == len(pairs) and {tuple(r) for r in got} == pairs


def test_few_boxes_need_no_keys(spark):
    """Up to ``FEW_BOXES`` boxes are compared directly; one more goes by cell, with the same rows."""
    p = fixtures.points(spark, SF)
    boxes = starts(spark, SF).orderBy("query_id").limit(boxjoin.FEW_BOXES + 1)
    few = boxes.orderBy("query_id").limit(boxjoin.FEW_BOXES)
    last = boxes.agg({"query_id": "max"}).first()[0]
    for make in (ranges.hits_with_boundary, ranges.segment_crossings):
        by_cell, direct = make(p, boxes), make(p, few)
        plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in (by_cell, direct)]
        assert "Generate" in plans[0] and "Generate" not in plans[1]
        names = [c for c in ("query_id", "traj_id", "pos", "is_boundary") if c in direct.columns]
        assert sorted(map(tuple, direct.select(*names).collect())) == sorted(map(tuple, by_cell.filter(f"query_id <> {last}").select(*names).collect()))
