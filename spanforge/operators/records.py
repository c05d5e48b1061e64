"""Checks of nested records, lineage records, reports: structs and arrays in, issue rows or JSON out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_of(entry: Column) -> Column:
    """``start, stop`` of a JSON entry that is an object or a list of two; null for anything else."""
    at = lambda path: F.get_json_object(entry, path).try_cast("double")
    start, stop = F.coalesce(at("$.start"), at("$[0]")), F.coalesce(at("$.end"), at("$[1]"))
    return F.when(start.isNotNull() & stop.isNotNull() & F.get_json_object(entry, "$[2]").isNull(), F.struct(start.alias("start"), stop.alias("stop")))


def first_video(streams: Column) -> Column:
    """The first video stream of a probe record."""
    return F.get(F.filter(streams, lambda s: s["kind"] == "video"), F.lit(0))


def has_audio(streams: Column) -> Column:
    return F.exists(streams, lambda s: s["kind"] == "audio")


def within(value: Column, wanted: Column, tolerance: int) -> Column:
    return F.abs(value - wanted) <= tolerance


def event_issues(events: Column, length: Column, modes: tuple[str, ...]) -> Column:
    """What is wrong with a layer's events ``id, start, stop, mode``, as an array of names."""
    ids = F.transform(events, lambda e: e["id"])
    starts = F.transform(events, lambda e: e["start"])
    rules = [
        (F.size(events) == 0, "no events"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "repeated id"),
        (F.exists(events, lambda e: (e["start"] < 0) | (e["stop"] > length)), "outside the timeline"),
        (F.exists(events, lambda e: e["stop"] <= e["start"]), "empty span"),
        (starts != F.array_sort(starts), "not in order"),
        (F.exists(events, lambda e: ~F.coalesce(e["mode"].isin(*modes), F.lit(False))), "unknown mode"),
    ]
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in rules)))


def cues_of(parameters: Column) -> Column:
    """The cues of a layer's JSON parameters that are whole: id, text, and a span that isn't empty."""
    schema = "array<struct<id:string,text:string,start:bigint,stop:bigint>>"
    found = F.from_json(F.get_json_object(parameters, "$.cues"), schema)
    return F.filter(found, lambda c: c["id"].isNotNull() & (F.coalesce(c["text"], F.lit("")) != "") & (c["stop"] > c["start"]))


def lineage(plan_id: Column, sources: Column, outputs: Column, tool: str) -> Column:
    """Lineage record of a run as canonical JSON: sorted keys, sorted files, and a digest of all of it."""
    body = F.to_json(F.struct(F.array_sort(outputs).alias("outputs"), plan_id.alias("plan"), F.array_sort(sources).alias("sources"), F.lit(tool).alias("tool")))
    return F.struct(body.alias("record"), F.sha2(body, 256).alias("digest"))


def locked_files(lock: DataFrame, found: DataFrame) -> DataFrame:
    """Exact file set: what the lock has and the folder lacks, the other way round, and other digests.

    Both: path, digest.
    """
    there = found.select(F.col("path").alias("__p"), F.col("digest").alias("__d"))
    both = lock.join(there, F.col("path") == F.col("__p"), "full_outer")
    state = F.when(F.col("__p").isNull(), "missing").when(F.col("path").isNull(), "unlocked").when(F.col("digest") != F.col("__d"), "changed")
    return both.select(F.coalesce("path", "__p").alias("path"), state.alias("state")).where("state is not null")


def clamped(events: DataFrame, length: Column) -> DataFrame:
    """Events cut to the timeline; what is empty then goes."""
    out = events.withColumn("start", F.greatest("start", F.lit(0))).withColumn("stop", F.least("stop", length))
    return out.where("stop > start")


def scene(events: DataFrame, key: str) -> DataFrame:
    """One scene document a key: its events by start and id, as JSON. ``events``: key, id, start, stop, text."""
    row = F.struct("start", "id", "stop", "text")
    return events.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(row))).alias("scene"))


def html_sheet(rows: DataFrame, key: str, title: str) -> DataFrame:
    """A self-contained page a key: rows ``place, name, state`` as a table, text escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit("<tr><td>"), F.col("place").cast("string"), F.lit("</td><td>"), safe(F.col("name")), F.lit("</td><td>"), safe(F.col("state")), F.lit("</td></tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("r")))), lambda x: x["r"]), "\n")
    return rows.groupBy(key).agg(F.concat(F.lit(f"<!doctype html>\n<title>{title}</title>\n<table>\n"), body, F.lit("\n</table>\n")).alias("content"))
