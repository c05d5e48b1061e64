"""Readers of the test tables, and the records that the operators read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds of a zone-less timestamp (the session's zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, event_id, kind, start, stop, value``: activity spans in microseconds."""
    e = table(spark, sf_dir, "events")
    start = micros(F.col("ts"))
    return e.select("user_id", "event_id", F.col("event_type").alias("kind"), start.alias("start"), (start + F.bround(F.col("value") * 60).cast("long") * 1_000_000).alias("stop"), "value")


#: Lines of one block of running lengths.
_BLOCK = 256


def placed_lines(text: Column) -> Column:
    """Array of ``text, start, stop``: the lines of a text and their running lengths, inside the row.

    Lengths are summed by blocks of lines, then inside a block, so that a text of n lines takes
    n * (_BLOCK + n / _BLOCK^2) steps and nothing is shuffled. A lambda's variable is computed
    once; columns named inside a lambda would be computed for every element.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    whole = F.struct(F.split(text, "\n").alias("t"))
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def sized(w: Column) -> Column:
        return F.struct(w["t"].alias("t"), F.transform(w["t"], lambda x: F.length(x)).alias("n"))

    def summed(w: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(w["n"]) - 1) / _BLOCK).cast("int")), lambda k: total(F.slice(w["n"], k * _BLOCK + 1, _BLOCK)))
        return F.struct(w["t"].alias("t"), w["n"].alias("n"), blocks.alias("sums"))

    def based(w: Column) -> Column:
        bases = F.transform(w["sums"], lambda x, k: total(F.slice(w["sums"], F.lit(1), k)))
        return F.struct(w["t"].alias("t"), w["n"].alias("n"), bases.alias("base"))

    def line(w: Column, x: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        start = F.get(w["base"], block) + total(F.slice(w["n"], block * _BLOCK + 1, i % _BLOCK))
        return F.struct(x.alias("text"), start.alias("start"), (start + F.get(w["n"], i)).alias("stop"))

    return once(once(once(once(whole, sized), summed), based), lambda w: F.transform(w["t"], lambda x, i: line(w, x, i)))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, idx, text, start, stop``: lines of documents as phrases; a character lasts 1 ms."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(placed_lines(F.col("text"))).alias("idx", "l"))
    return rows.select("doc_id", "idx", "l.text", "l.start", "l.stop")


def bare_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, idx, text``: the lines alone, for what needs no times."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))


def by_id(rows: DataFrame, key: str, *columns: Column) -> DataFrame:
    """``key, texts``: one row for each key, its rows' columns as structs of an array.

    A key has one row as a rule, and such rows stay where they are: what is shuffled are the keys
    alone, to find those that repeat, and the rows of these.
    """
    again = F.broadcast(rows.groupBy(key).count().where("count > 1").select(F.col(key).alias("again")))
    same = F.col(key).eqNullSafe(F.col("again"))
    lone = rows.join(again, same, "left_anti").select(key, F.array(F.struct(*columns)).alias("texts"))
    several = rows.join(again, same, "left_semi").groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("texts"))
    return lone.unionByName(several)
