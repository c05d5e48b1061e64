"""Sinks: subtitles, reports, canonical JSON and publication that never overwrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text as T


def subrip(cues: DataFrame, key: str) -> DataFrame:
    """``key, content``: ordered cues as SubRip text; ``cues``: key, idx, start, stop, text (ms)."""
    record = F.concat((F.col("idx") + 1).cast("string"), F.lit("\n"), T.srt_clock(F.col("start")), F.lit(" --> "), T.srt_clock(F.col("stop")), F.lit("\n"), "text", F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct("idx", record.alias("r"))))
    return cues.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["r"]), "\n").alias("content"))


def markdown(rows: DataFrame, key: str, title: str) -> DataFrame:
    """A table of reviewed rows for each document, in order."""
    line = F.concat(F.lit("| "), T.clock(F.col("start")), F.lit(" | "), T.clock(F.col("stop")), F.lit(" | "), "suggestion", F.lit(" | "), F.regexp_replace("reasons", r"\|", "/"), F.lit(" |"))
    parts = F.array_sort(F.collect_list(F.struct("start", "stop", line.alias("r"))))
    head = f"# {title}\n\n| from | to | suggestion | reasons |\n|-|-|-|-|\n"
    return rows.groupBy(key).agg(F.concat(F.lit(head), F.array_join(F.transform(parts, lambda p: p["r"]), "\n")).alias("content"))


def operation(kind: str, rows: DataFrame, key: str, order: str, fields: list[str], operation_id: str) -> DataFrame:
    """Rows of a key as one operation of a plan."""
    events = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("e")))), lambda x: x["e"])
    return rows.groupBy(key).agg(F.struct(F.lit(operation_id).alias("operation_id"), F.lit(kind).alias("kind"), events.alias("events")).alias("operation"))


def canonical_json(columns: list[str]) -> Column:
    """Sorted keys and a final line feed."""
    return F.concat(F.to_json(F.struct(*sorted(columns))), F.lit("\n"))


def publish(df: DataFrame, path: str) -> None:
    """Write once: an existing target is an error, and the commit makes it appear whole."""
    df.write.mode("errorifexists").json(path)
