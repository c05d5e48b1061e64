"""Allocation along a timeline: proportional shares, offsets, splits, ordered bins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as T


def proportional(df: DataFrame, key: str, order: list[str], weight: str, total: int) -> DataFrame:
    """[0, total] by weight, in whole units; consecutive, the last ends exactly at the end."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upto, whole = F.sum(weight).over(w), F.sum(weight).over(Window.partitionBy(key))
    return df.withColumn("stop", F.floor(upto * total / whole).cast("long")).withColumn("start", F.floor((upto - F.col(weight)) * total / whole).cast("long"))


def offsets(df: DataFrame, key: str, order: list[str], length: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("stop", F.sum(length).over(w)).withColumn("start", F.col("stop") - F.col(length))


def split_states(df: DataFrame, shares: Column, length: str) -> DataFrame:
    """Consecutive windows of percentages; the last has what is left."""
    before = lambda s, i: F.aggregate(F.slice(s, F.lit(1), i), F.lit(0), lambda a, x: a + x)
    rows = df.withColumn("shares", shares).withColumn("state", F.explode(F.sequence(F.lit(0), F.size("shares") - 1)))
    start = F.floor(before(F.col("shares"), F.col("state")) * F.col(length) / 100)
    stop = F.when(F.col("state") + 1 == F.size("shares"), F.col(length)).otherwise(F.floor(before(F.col("shares"), F.col("state") + 1) * F.col(length) / 100))
    return rows.withColumn("start", start.cast("long")).withColumn("stop", stop.cast("long"))


def words_over_cue(df: DataFrame, key: str, text: Column, total: int) -> DataFrame:
    """Spread a cue over its words by their length."""
    rows = df.select(key, F.posexplode(T.words(text)).alias("pos", "word")).withColumn("length", F.length("word"))
    return proportional(rows, key, ["pos"], "length", total)


def greedy_bins(df: DataFrame, key: str, order: str, length: str, limit: int) -> DataFrame:
    """Fill bins in order up to a limit.

    Rows are sorted by key and order inside a partition and folded as they stream by: a task
    holds one batch and three numbers, however many rows a key has.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, filled, bin_ = None, 0, 0
        for batch in batches:
            bins = []
            for own, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not bins and at is None or own != at:
                    at, filled, bin_ = own, n, 0
                elif filled + n > limit:
                    filled, bin_ = n, bin_ + 1
                else:
                    filled += n
                bins.append(bin_)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(bins, pa.int32())], [key, order, "bin"])

    rows = df.select(F.col(key).cast("long"), F.col(order).cast("long"), F.col(length)).repartition(key).sortWithinPartitions(key, order, length)
    return rows.mapInArrow(fold, f"{key} long, {order} long, bin int")
