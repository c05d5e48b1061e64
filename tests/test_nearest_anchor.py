"""Nearest anchors by two neighbours equal the nearest of all pairs, and pairs are never built."""

import random

from spanforge.operators import intervals


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(5)
    for wide in (60, 4_000):
        # repeated moments and ids, edges of the tolerance and of buckets, missing times
        points = [(rng.randrange(150), rng.choice([rng.randrange(-wide, wide), 10 * rng.randrange(-wide // 10, wide // 10)])) for _ in range(200)] + [(500, None)]
        anchors = [(rng.randrange(1000), rng.choice([rng.randrange(-wide, wide), 10 * rng.randrange(-wide // 10, wide // 10)])) for _ in range(120)] + [(2000, None)]
        found = intervals.nearest(spark.createDataFrame(points, "event_id long, at long"), spark.createDataFrame(anchors, "anchor_id long, anchor_at long"), 10)
        best = {}
        for k, at in points:
            for a, where in anchors:
                if at is not None and where is not None and abs(at - where) <= 10:
                    best[k] = min(best.get(k, (11, 0)), (abs(at - where), a))
        assert {r.event_id: (r.distance, r.anchor_id) for r in found.collect()} == best
        assert found.count() == len(best) > 10


def test_pairs_are_not_built(spark):
    """2 000 points and 2 000 anchors of one moment are 4 000 000 pairs."""
    points, anchors = spark.range(2000).selectExpr("id as event_id", "5L as at"), spark.range(2000).selectExpr("id as anchor_id", "5L as anchor_at")
    found = intervals.nearest(points, anchors, 10)
    assert {(r.anchor_id, r.distance) for r in found.collect()} == {(0, 0)} and found.count() == 2000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
