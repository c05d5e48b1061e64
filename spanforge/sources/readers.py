"""Readers: scripts, subtitles, JSON documents with closed schemas, media catalogues.

All read whole files through Spark, so any store that Spark reaches will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from spanforge.functions import text as T

#: Extensions of media types.
MEDIA = {"image": ("jpg", "jpeg", "png", "webp"), "video": ("mp4", "mov", "webm", "mkv"), "audio": ("mp3", "wav", "m4a", "flac")}
_CLOCK = r"(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{1,3})"


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def script_blocks(files: DataFrame) -> DataFrame:
    """``path, idx, text``: blocks between blank lines, in order, trimmed, empties dropped."""
    parts = F.filter(F.transform(F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), r"\n[ \t]*\n\s*"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return files.select("path", F.posexplode(parts).alias("idx", "text"))


def _ms(line: Column, group: int) -> Column:
    """Milliseconds of the first or second clock of a timing line."""
    form = rf"{_CLOCK}\s*-->\s*{_CLOCK}"
    part = lambda k: F.regexp_extract(line, form, 4 * group + k)
    whole = F.coalesce(part(1).try_cast("long"), F.lit(0)) * 3_600_000 + part(2).try_cast("long") * 60_000 + part(3).try_cast("long") * 1000
    return whole + F.rpad(part(4), 3, "0").try_cast("long")


def subtitle_cues(files: DataFrame) -> DataFrame:
    """``path, idx, start, stop, text, issue`` of SubRip or WebVTT records.

    Records stand between blank lines; headers and notes have no timing line and go. A cue
    with markup or a span that isn't positive carries an issue instead of being mended.
    """
    records = F.split(F.regexp_replace(F.replace("content", F.lit("\r\n"), F.lit("\n")), "^﻿", ""), r"\n[ \t]*\n+")
    rows = files.select("path", F.posexplode(records).alias("place", "record")).where(F.col("record").rlike(r"-->"))
    lines = F.split(F.trim(F.regexp_replace("record", r"^\s+|\s+$", "")), "\n")
    timing = F.get(F.filter(lines, lambda x: F.contains(x, F.lit("-->"))), F.lit(0))
    body = F.array_join(F.slice(lines, F.array_position(lines, timing).cast("int") + 1, F.size(lines)), "\n")
    cues = rows.select("path", "place", _ms(timing, 0).alias("start"), _ms(timing, 1).alias("stop"), F.trim(body).alias("text"))
    issue = F.when(F.col("start").isNull() | F.col("stop").isNull(), "bad clock").when(F.col("stop") <= F.col("start"), "empty span").when(F.col("text") == "", "no text").when(F.col("text").rlike(r"<[^>]*>|\{\\"), "markup")
    return cues.withColumn("issue", issue).withColumn("idx", F.row_number().over(Window.partitionBy("path").orderBy("place")) - 1).drop("place")


def cue_issues(cues: DataFrame, most: int = 500, longest: int = 160) -> DataFrame:
    """Order, overlap, length and number of cues, as issue rows."""
    before = F.lag("stop").over(Window.partitionBy("path").orderBy("idx"))
    count = F.count("*").over(Window.partitionBy("path"))
    found = F.coalesce(F.col("issue"), F.when(before > F.col("start"), "overlap").when(F.length("text") > longest, "too long").when(count > most, "too many"))
    return cues.withColumn("issue", found).where("issue is not null").select("path", "idx", "issue")


def closed_json(files: DataFrame, schema: StructType) -> DataFrame:
    """Typed documents and the keys their schema doesn't know (a JSON reader drops them)."""
    known = F.array(*map(F.lit, schema.fieldNames()))
    unknown = F.array_except(F.json_object_keys("content"), known)
    return files.select("path", F.from_json("content", schema).alias("doc"), unknown.alias("unknown"), F.json_object_keys("content").isNull().alias("broken"))


def media_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    found = F.lit(None).cast("string")
    for kind, names in MEDIA.items():
        found = F.when(ext.isin(*names), kind).otherwise(found)
    return found


def catalogue(paths: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Media files with their sidecars: ``name.json`` first, ``name.ext.json`` else."""
    media = paths.select("path", media_type(F.col("path")).alias("media_type")).where("media_type is not null")
    short, long = F.concat(F.regexp_replace("path", r"\.[A-Za-z0-9]+$", ""), F.lit(".json")), F.concat("path", F.lit(".json"))
    side = lambda n: sidecars.select(F.col("path").alias(f"{n}_path"), F.col("content").alias(f"{n}_content"))
    joined = media.join(side("a"), short == F.col("a_path"), "left").join(side("b"), long == F.col("b_path"), "left")
    return joined.select("path", "media_type", F.coalesce("a_content", "b_content").alias("sidecar"))


def silence_spans(log: DataFrame) -> DataFrame:
    """Pair start and end lines of a detector's log; an open last span is dropped. ``log``: source, idx, line."""
    number = lambda name: F.regexp_extract("line", rf"{name}:\s*([0-9.]+)", 1).try_cast("double")
    rows = log.select("source", "idx", number("silence_start").alias("start"), number("silence_end").alias("stop"))
    after = F.lead("stop").over(Window.partitionBy("source").orderBy("idx"))
    return rows.withColumn("stop", after).where("start is not null and stop is not null").select("source", "start", "stop")


def remote_hits(payloads: DataFrame, kind: str) -> DataFrame:
    """Candidates of a recorded search answer: the widest rendition of each, first on ties."""
    schema = "struct<hits: array<struct<id: bigint, title: string, author: string, renditions: array<struct<url: string, width: int, height: int>>>>>"
    rows = payloads.select("query", F.from_json("payload", schema).alias("p")).select("query", F.explode("p.hits").alias("h"))
    each = rows.select("query", F.col("h.id").alias("id"), F.col("h.title").alias("title"), F.col("h.author").alias("author"), F.posexplode("h.renditions").alias("pos", "r"))
    best = F.row_number().over(Window.partitionBy("query", "id").orderBy(F.desc("r.width"), "pos"))
    found = each.withColumn("best", best).where("best = 1")
    return found.select("query", F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("candidate_id"), "title", "author", "r.url", "r.width", "r.height", T.orientation(F.col("r.width"), F.col("r.height")).alias("orientation"))


def providers(names: list[str], known: dict[str, Callable[[], DataFrame] | None]) -> DataFrame | None:
    """Union of the readers that are there; names without one (no key, no library) disappear."""
    found = None
    for name in names:
        read = known.get(name)
        if read is not None:
            rows = read().withColumn("source_kind", F.lit(name))
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    return found


def first_of_each(candidates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Distinct by id, the first provider's row kept."""
    return candidates.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
