"""Interval algebra over ``(key, start, stop)`` rows with integer times.

Every operator is a window or a join over one key; integer times make merges exact where
floating ones need a tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Gap up to which neighbours are one, least length kept, and sliver absorbed (microseconds).
JOIN_GAP, LEAST_CUT, SLIVER = 1, 20_000, 40_000
#: Width of the time buckets that joins of points with spans are made on (microseconds): a day.
BUCKET = 86_400_000_000


def ordered(key: str, *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)


def earlier(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def clamp(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """Cut spans to [low, high] and drop what is empty."""
    out = df.withColumn("start", F.greatest("start", low)).withColumn("stop", F.least("stop", high))
    return out.where("stop > start")


def islands(df: DataFrame, key: str, gap: int = JOIN_GAP) -> DataFrame:
    """Number the runs of spans that touch or overlap: ``island``."""
    w = ordered(key, "start", "stop", "event_id")
    reach = F.max("stop").over(earlier(w))
    fresh = F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)
    return df.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def coalesce_spans(df: DataFrame, key: str, gap: int = JOIN_GAP) -> DataFrame:
    """One row for each island: its bounds and number of members."""
    return islands(df, key, gap).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("members"))


def shrink(df: DataFrame, before: int, after: int, least: int = LEAST_CUT) -> DataFrame:
    """Pad inwards after merging, then drop what is shorter than ``least``."""
    out = df.withColumn("start", F.col("start") + before).withColumn("stop", F.col("stop") - after)
    return out.where(F.col("stop") - F.col("start") >= least)


def complement(merged: DataFrame, key: str, sliver: int = SLIVER) -> DataFrame:
    """Uncovered spans between merged ones, those shorter than ``sliver`` absorbed."""
    after = F.lead("start").over(ordered(key, "start"))
    return merged.select(key, F.col("stop").alias("start"), after.alias("stop")).where(F.col("stop").isNotNull() & (F.col("stop") - F.col("start") >= sliver))


def union_measure(df: DataFrame, key: str) -> DataFrame:
    """Covered time with overlaps counted once, without building the union."""
    reach = F.max("stop").over(earlier(ordered(key, "start", "stop", "event_id")))
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(reach, F.col("start"))))
    return df.withColumn("new", new).groupBy(key).agg(F.sum("new").alias("covered"), F.sum(F.col("stop") - F.col("start")).alias("gross"))


def totals(df: DataFrame, key: str) -> DataFrame:
    """Original, covered and uncovered time and number of pieces for each key."""
    merged = coalesce_spans(df, key)
    return merged.groupBy(key).agg(
        F.count("*").alias("pieces"), F.sum("members").alias("spans"),
        (F.max("stop") - F.min("start")).alias("original"), F.sum(F.col("stop") - F.col("start")).alias("covered"),
    ).withColumn("uncovered", F.col("original") - F.col("covered"))


def conflicts(df: DataFrame, key: str) -> DataFrame:
    """Spans that begin before the one in front of them has ended (touching is allowed)."""
    w = ordered(key, "start", "stop", "event_id")
    return df.withColumn("prev_id", F.lag("event_id").over(w)).withColumn("prev_stop", F.lag("stop").over(w)).where("prev_stop > start")


def bucketed(spans: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``spans`` once for each time bucket ``b`` that they meet, their last moment included."""
    return spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket))))


def split_at(merged: DataFrame, markers: DataFrame, key: str, bucket: int = BUCKET) -> DataFrame:
    """Cut spans at the markers strictly inside them; pieces are numbered in order.

    Markers meet the spans of their key and time bucket alone; a marker lies in one bucket, so
    no pair comes twice. The cuts of a span, which this gathers, become consecutive pieces.
    """
    spans = merged.select(key, "island", "start", "stop")
    points = markers.withColumn("b", F.floor(F.col("mark") / bucket))
    pairs = bucketed(spans, bucket).join(points, [key, "b"]).where("mark > start and mark < stop").select(key, "island", "start", "stop", "mark")
    grouped = spans.withColumn("mark", F.lit(None).cast("long")).unionByName(pairs).groupBy(key, "island", "start", "stop").agg(F.array_sort(F.collect_set("mark")).alias("cuts"))
    bounds = F.concat(F.array("start"), F.col("cuts"), F.array("stop"))
    pieces = grouped.select(key, "island", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("cuts") + 1), lambda i: F.struct(F.get(bounds, i - 1).alias("start"), F.get(bounds, i).alias("stop")))).alias("piece", "p"))
    return pieces.select(key, "island", "piece", F.col("p.start").alias("start"), F.col("p.stop").alias("stop"))


def timeline(pieces: DataFrame, key: str, speed: Column) -> DataFrame:
    """Output places of kept pieces laid end to end, each played at its speed (percent)."""
    length = F.floor((F.col("stop") - F.col("start")) * 100 / speed).cast("long")
    out = pieces.withColumn("length", length)
    return out.withColumn("out_start", F.coalesce(F.sum("length").over(earlier(ordered(key, "start"))), F.lit(0))).withColumn("speed", speed)


def remap(points: DataFrame, laid: DataFrame, key: str, bucket: int = BUCKET) -> DataFrame:
    """Source time to output time; null inside a cut; the earlier piece wins a shared edge."""
    pieces = bucketed(laid.select(F.col(key).alias("t_key"), "start", "stop", "out_start", "speed"), bucket)
    near = (F.col(key) == F.col("t_key")) & (F.col("p_b") == F.col("b")) & (F.col("at") >= F.col("start")) & (F.col("at") <= F.col("stop"))
    hit = points.withColumn("p_b", F.floor(F.col("at") / bucket)).join(pieces, near, "left")
    place = F.col("out_start") + F.floor((F.col("at") - F.col("start")) * 100 / F.col("speed")).cast("long")
    return hit.groupBy(key, "event_id", "at").agg(F.min_by(place, F.col("start")).alias("out_at"))


def shifted(df: DataFrame, key: str, is_insert: Column, length: Column) -> DataFrame:
    """Add the length of all inserts that start at or before the row (ties included)."""
    w = Window.partitionBy(key).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    added = F.sum(F.when(is_insert, length).otherwise(0)).over(w)
    own = F.when(is_insert, length).otherwise(0)
    return df.withColumn("moved", F.col("start") + added - own)


def containment(outer: DataFrame, inner: DataFrame, key: str, bucket: int = BUCKET) -> DataFrame:
    """Inner spans inside an outer one; ``inner`` rows without any keep a null."""
    o = bucketed(outer.select(key, "island", "start", "stop"), bucket).alias("o")
    i = inner.withColumn("b", F.floor(F.col("start") / bucket)).alias("i")
    near = (F.col(f"i.{key}") == F.col(f"o.{key}")) & (F.col("i.b") == F.col("o.b")) & (F.col("i.start") >= F.col("o.start")) & (F.col("i.stop") <= F.col("o.stop"))
    return i.join(o, near, "left").select(f"i.{key}", "i.event_id", F.col("o.island").alias("island"))


def point_in_window(points: DataFrame, windows: DataFrame, bucket: int) -> DataFrame:
    """Half-open range join by equal buckets: each window lists the buckets it meets, so the
    join is an equality and not a nested loop; then the bounds are checked."""
    w = windows.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("stop") - 1) / bucket))))
    p = points.withColumn("b", F.floor(F.col("at") / bucket))
    return p.join(w, "b").where("at >= start and at < stop").drop("b")


def band(points: DataFrame, anchors: DataFrame, tolerance: int) -> DataFrame:
    """Pairs no further apart than the tolerance, by neighbouring buckets of its width."""
    a = anchors.withColumn("b", F.floor(F.col("anchor_at") / tolerance)).withColumn("b", F.explode(F.array(F.col("b") - 1, "b", F.col("b") + 1)))
    return points.withColumn("b", F.floor(F.col("at") / tolerance)).join(a, "b").where(F.abs(F.col("at") - F.col("anchor_at")) <= tolerance).drop("b")


def nearest(points: DataFrame, anchors: DataFrame, tolerance: int) -> DataFrame:
    """``event_id, anchor_id, distance``: the nearest anchor of each point within the tolerance, the smallest id of equals.

    Points meet no anchors but the last one before and the first one behind them, by two windows
    over a bucket of the tolerance's width; a bucket knows the last anchor of the bucket before
    and the first one of the bucket behind. Anchors of one moment are one.
    """
    bucket = lambda at: F.floor(F.col(at) / tolerance)
    marks = anchors.where("anchor_at is not null").groupBy("anchor_at").agg(F.min("anchor_id").alias("anchor_id")).select(bucket("anchor_at").alias("b"), F.struct("anchor_at", "anchor_id").alias("mark"))
    ends = marks.groupBy("b").agg(F.min("mark").alias("first"), F.max("mark").alias("last"))
    known = marks.unionByName(ends.select((F.col("b") - 1).alias("b"), F.col("first").alias("mark"))).unionByName(ends.select((F.col("b") + 1).alias("b"), F.col("last").alias("mark")))
    own = points.where("at is not null").select(bucket("at").alias("b"), "at", F.lit(True).alias("point"), "event_id")
    rows = own.unionByName(known.select("b", F.col("mark.anchor_at").alias("at"), F.lit(False).alias("point"), "mark"), allowMissingColumns=True)
    # anchors come before the points of their moment, in both directions
    upto = lambda at: F.last("mark", True).over(Window.partitionBy("b").orderBy(at, "point").rowsBetween(Window.unboundedPreceding, 0))
    near = lambda mark: F.struct(F.abs(F.col("at") - F.col(mark)["anchor_at"]).alias("distance"), F.col(mark)["anchor_id"].alias("anchor_id"))
    met = rows.withColumn("before", upto(F.asc("at"))).withColumn("behind", upto(F.desc("at"))).where("point")
    best = met.select("event_id", F.array_min(F.filter(F.array(near("before"), near("behind")), lambda x: x["distance"] <= tolerance)).alias("best")).where("best is not null")
    return best.groupBy("event_id").agg(F.min("best").alias("best")).select("event_id", "best.anchor_id", "best.distance")


def dark_gaps(merged: DataFrame, key: str, ceiling: Column) -> DataFrame:
    """Uncovered spans longer than a ceiling that may depend on where they begin."""
    return complement(merged, key, 0).where(F.col("stop") - F.col("start") > ceiling)
