"""Shot planning: where scenes are cut, which shots share an asset, what a shot is shown with.

Times are whole milliseconds. Folds run over one scene's offsets inside a row, or stream a
sorted partition, so no scene's shots are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Media of shot types, with what is usual for the rest, and how a type fills the frame.
MEDIA = {"view": "video", "click": "image", "purchase": "image"}
FITS = {"purchase": "contain"}


def emphasis_segments(offsets: Column, length: Column, least: int) -> Column:
    """Array of ``start, stop, on_beat``: a scene cut at its emphasis offsets.

    A cut keeps ``least`` from the cut before it, moving later where it must; one that leaves
    less than that to the scene's end is dropped.
    """
    cuts = F.expr("cast(array(0) as array<bigint>)")

    def step(a: Column, x: Column) -> Column:
        at = F.greatest(x, F.element_at(a, -1) + least)
        return F.when(at < length - least, F.concat(a, F.array(at))).otherwise(a)

    found = F.concat(F.aggregate(offsets, cuts, step), F.array(length))
    part = lambda k: F.struct(F.get(found, k).alias("start"), F.get(found, k + 1).alias("stop"), (k > 0).alias("on_beat"))
    return F.transform(F.sequence(F.lit(0), F.size(found) - 2), part)


def shot_rows(segments: DataFrame, keys: list[str], ideal: int, low: int, high: int) -> DataFrame:
    """Each segment as its shots, of nearly equal whole lengths with the exact sum; the first keeps the beat."""
    span = F.col("stop") - F.col("start")
    n = F.greatest(F.least(F.round(span / ideal), F.floor(span / low)), F.ceil(span / high), F.lit(1)).cast("int")
    rows = segments.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda k: (F.col("start") + F.floor(span * k / F.col("n"))).cast("long")
    return rows.select(*keys, "k", at(F.col("k")).alias("start"), at(F.col("k") + 1).alias("stop"), (F.col("on_beat") & (F.col("k") == 0)).alias("on_beat"))


def cyclic_scales(rows: DataFrame, key: str, order: list[str], scales: tuple[str, ...]) -> DataFrame:
    """Scales in turn, each key beginning at a place of its own: neighbours never have the same."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1 + F.pmod(F.col(key), F.lit(len(scales)))
    return rows.withColumn("scale", F.get(F.array(*map(F.lit, scales)), F.pmod(turn, F.lit(len(scales))).cast("int")))


def medium_of(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in MEDIA.items()), F.lit("card"))


def fit_of(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in FITS.items()), F.lit("cover"))


def motion_of(scale: Column, draw: Column) -> Column:
    """Move and bias of a scale; ``draw``, a digest, settles the open choices."""
    side = F.when(F.pmod(draw, F.lit(2)) == 0, "left").otherwise("right")
    corner = F.get(F.array(*map(F.lit, ("top", "bottom", "left", "right"))), F.pmod(draw, F.lit(4)).cast("int"))
    move = F.when(scale == "wide", F.lit("zoom_in")).when(scale == "medium", F.concat(F.lit("pan_"), side)).when(scale == "close", F.lit("zoom_out"))
    return F.struct(move.alias("motion"), F.when(scale == "medium", side).when(scale == "detail", corner).otherwise("center").alias("bias"))


def parameter_map(**columns: Column) -> Column:
    """Parameters by name; those that are null are left out, and no row is the empty map."""
    every = F.create_map(*(x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))))
    return F.map_filter(F.coalesce(every, F.expr("cast(map() as map<string,string>)")), lambda _, v: v.isNotNull())


def direction_inputs(shots: DataFrame, events: DataFrame, luma: DataFrame) -> DataFrame:
    """What the direction of a shot may read: its own columns, its text zone and its asset's brightness.

    events: shot_id, zone (the first of a shot counts); luma: asset_id, luma.
    """
    zones = events.groupBy("shot_id").agg(F.min_by("zone", "at").alias("zone"))
    return shots.join(zones, "shot_id", "left").join(luma, "asset_id", "left").withColumn("emphasis", F.col("zone").isNotNull())


def detached_id(shot_id: Column) -> Column:
    """Id of an asset that one shot has for itself."""
    return F.concat(F.lit("asset-"), shot_id.cast("string"), F.lit("-own"))


def regrouped(shots: DataFrame, key: str) -> DataFrame:
    """Shots whose type left that of their asset's first shot get an asset of their own type.

    ``shots``: key, idx, shot_id, asset_id, type. The first such shot of a type in its group
    lends its detached id to the others.
    """
    group = Window.partitionBy(key, "asset_id").orderBy("idx")
    of_type = Window.partitionBy(key, "asset_id", "type").orderBy("idx")
    own = F.when(F.col("type") == F.first("type").over(group), F.col("asset_id")).otherwise(detached_id(F.first("shot_id").over(of_type)))
    return shots.withColumn("asset_id", own)


def inherited(sentences: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Each sentence with the largest importance of the rows that it covers; rows in none are left out.

    sentences: key, sentence, start, stop; rows: key, start, importance.
    """
    inside = rows.select(F.col(key).alias("__k"), F.col("start").alias("at"), "importance")
    hit = sentences.join(inside, (F.col(key) == F.col("__k")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop")))
    return hit.groupBy(key, "sentence").agg(F.max("importance").alias("importance"), F.count("*").alias("covered"))


def avoiding_last(rows: DataFrame, key: str, order: str, options: tuple[str, ...], memory: int = 2) -> DataFrame:
    """For each row the first option, from a place of its own on, that none of the last ``memory`` rows had.

    Rows stream by in order; a task remembers ``memory`` choices.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, begun = None, [], False
        for batch in batches:
            chosen = []
            for own, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun or own != at:
                    at, last, begun = own, [], True
                turned = [options[(place + k) % len(options)] for k in range(len(options))]
                pick = next((x for x in turned if x not in last[-memory:]), turned[0])
                last = [*last[-memory:], pick]
                chosen.append(pick)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(chosen, pa.string())], [key, order, "choice"])

    ordered = rows.select(F.col(key).cast("long"), F.col(order).cast("long")).repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInArrow(fold, f"{key} long, {order} long, choice string")


def states_of(treatment: Column) -> Column:
    """States of a treatment as shares of its length."""
    state = lambda *items: F.array(*(F.struct(F.lit(n).alias("state"), F.lit(p).alias("share")) for n, p in items))
    return (
        F.when(treatment == "view", state(("hold", 100))).when(treatment == "click", state(("enter", 30), ("hold", 70)))
        .when(treatment == "purchase", state(("enter", 25), ("hold", 50), ("leave", 25))).otherwise(state(("cut", 100)))
    )


def state_look(state: Column, base: Column, medium: Column, preserve: Column) -> Column:
    """Composition and motion of a state: what must keep its frame stays still, entering images come closer."""
    composition = F.when(preserve, "full").when((state == "enter") & (medium == "image"), "close").otherwise(base)
    motion = F.when(preserve | (medium == "card"), "still").when(state == "enter", "push_in").when(state == "leave", "pull_out").otherwise("drift")
    return F.struct(composition.alias("composition"), motion.alias("motion"))
