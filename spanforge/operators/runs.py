"""Runs, sessions and streaks: gaps-and-islands over one key and one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by(key: str, *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)


def run_id(df: DataFrame, value: Column, window: WindowSpec, name: str = "run") -> DataFrame:
    """Number consecutive rows of equal value."""
    before = F.lag(value).over(window)
    fresh = F.when(F.row_number().over(window) == 1, 1).when(before.eqNullSafe(value), 0).otherwise(1)
    return df.withColumn("fresh", fresh).withColumn(name, F.sum("fresh").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def consecutive_groups(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """One row for each run: its value, length, summed value and first and last row."""
    numbered = run_id(df, F.col(value), by(key, *order))
    return numbered.groupBy(key, "run", value).agg(F.count("*").alias("length"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.sum("seconds").alias("seconds"))


def violations(groups: DataFrame, limit: int) -> DataFrame:
    return groups.where(F.col("length") > limit)


def longest(groups: DataFrame, key: str) -> DataFrame:
    return groups.groupBy(key).agg(F.max("length").alias("longest"), F.max("seconds").alias("longest_seconds"))


def adjacent_equal(df: DataFrame, key: str, value: str, besides: str, *order: str) -> DataFrame:
    """Neighbouring rows of equal value, one value not counted."""
    same = (F.lag(value).over(by(key, *order)) == F.col(value)) & (F.col(value) != besides)
    return df.withColumn("same", same).groupBy(key).agg(F.count_if("same").alias("repeats"))


def gap_rows(df: DataFrame, key: str, longer: int) -> DataFrame:
    """Silences strictly inside the span of a key: from the furthest end so far to the next start."""
    w = by(key, "start", "stop", "event_id")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.select(key, reach.alias("gap_start"), F.col("start").alias("gap_stop")).where(F.col("gap_stop") - F.col("gap_start") > longer)


def confidence_ramp(gap: Column, longer: int, ceiling: float = 0.95) -> Column:
    """Sureness that grows with the gap and is capped."""
    return F.least(F.lit(0.5) + 0.05 * (gap / longer), F.lit(ceiling))


def sessions(df: DataFrame, key: str, flagged: Column, gap: int) -> DataFrame:
    """Flagged rows joined while they start within ``gap`` of the previous row's end.

    Unflagged rows break a session. This is not a batch session window: that one measures
    from starts and knows no breaking rows.
    """
    w = by(key, "start", "event_id")
    marked = df.withColumn("flagged", flagged)
    fresh = F.when(~F.col("flagged"), 0).when(~F.coalesce(F.lag("flagged").over(w), F.lit(False)), 1).when(F.col("start") - F.lag("stop").over(w) > gap, 1).otherwise(0)
    numbered = marked.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("flagged").drop("fresh")


def dominant(rows: DataFrame, keys: list[str], category: str, weight: str) -> DataFrame:
    """Category of a group by (count, summed weight), the name breaking ties."""
    counted = rows.groupBy(*keys, category).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    return counted.groupBy(*keys).agg(F.min_by(category, F.struct(-F.col("n"), -F.col("w"), F.col(category))).alias("dominant"), F.sum("n").alias("rows"))


def blocks(df: DataFrame, key: str, flagged: Column, gap: int, least: int, rows: int) -> DataFrame:
    """Sessions that last ``least`` or hold ``rows`` rows, with bounds and dominant category."""
    own = sessions(df, key, flagged, gap)
    size = own.groupBy(key, "session").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_rows"))
    kinds = dominant(own, [key, "session"], "kind", "value").select(key, "session", "dominant")
    return size.where((F.col("stop") - F.col("start") >= least) | (F.col("n_rows") >= rows)).join(kinds, [key, "session"])


def monotonic(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Clamp overlapping words: none starts before the furthest end so far."""
    reach = F.max("stop").over(by(key, *order).rowsBetween(Window.unboundedPreceding, -1))
    start = F.greatest(F.col("start"), F.coalesce(reach, F.col("start")))
    return df.withColumn("start", start).withColumn("stop", F.greatest("start", "stop"))
