"""Reading a whole script: what each line is about, given what all lines are about."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import beats
from spanforge.functions import text as T

#: A term in more than this share of a text's lines (of four or more) is its subject, not a line's.
DOMINANT = 0.25


def candidates(lines: DataFrame, key: str) -> DataFrame:
    """``key, idx, text, options``: each line's content terms without the dominant ones; all where none is left."""
    own = lines.withColumn("terms", T.content_terms(F.col("text")))
    size = own.groupBy(key).agg(F.count("*").alias("n_lines"))
    df = own.select(key, "idx", F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("df"))
    subject = df.join(size, key).where((F.col("n_lines") >= 4) & (F.col("df") > DOMINANT * F.col("n_lines"))).groupBy(key).agg(F.collect_set("term").alias("subject"))
    rows = own.join(subject, key, "left")
    left = F.array_except("terms", F.coalesce("subject", F.expr("cast(array() as array<string>)")))
    return rows.select(key, "idx", "text", F.when(F.size(left) > 0, left).otherwise(F.col("terms")).alias("options"))


def concepts(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``key, order, concept``: the first option that the row before did not take; its own where it has no other.

    Rows stream by in order; a task remembers one choice. Rows without options take none and
    leave the memory as it is.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, begun = None, None, False
        for batch in batches:
            chosen = []
            for own, options in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not begun or own != at:
                    at, last, begun = own, None, True
                pick = next((x for x in options if x != last), options[0] if options else None)
                last = pick if pick is not None else last
                chosen.append(pick)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(chosen, pa.string())], [key, order, "concept"])

    ordered = rows.select(F.col(key).cast("long"), F.col(order).cast("long"), F.slice("options", 1, 2)).repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInArrow(fold, f"{key} long, {order} long, concept string")


def composed(text: Column) -> Column:
    """``words, role`` of a line on screen: a figure, a turn, two words of unlike stems, or one word; null for none."""
    look = lambda words, role: F.struct(words.alias("words"), F.lit(role).alias("role"))

    def chosen(line: Column) -> Column:
        figure = F.get(F.filter(line["low"], lambda w: w.rlike("^[0-9]+$")), F.lit(0))
        turn = F.arrays_overlap(line["low"], F.array(*map(F.lit, beats.CONTRASTS)))
        second = F.get(F.filter(line["terms"], lambda t: T.stem(t) != T.stem(line["first"])), F.lit(0))
        return (
            F.when(figure.isNotNull(), look(figure, "figure")).when(turn & line["first"].isNotNull(), look(F.get(line["terms"], F.size(line["terms"]) - 1), "turn"))
            .when(second.isNotNull(), look(F.concat_ws(" ", line["first"], second), "pair")).when(line["first"].isNotNull(), look(line["first"], "word"))
        )

    low = F.transform(T.words(text), lambda w: beats.bare(w))
    first = lambda line: F.struct(line["low"].alias("low"), line["terms"].alias("terms"), F.get(line["terms"], F.lit(0)).alias("first"))
    return T.once(T.once(F.struct(low.alias("low"), T.content_terms(text).alias("terms")), first), chosen)
