"""Narration: breaths, pauses and units of a script; captions anchored on heard words; chains of fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as T

#: Sentences up to SHORT characters run together up to RUN; a paragraph of at most two sentences
#: and BEAT characters stands alone as a beat.
SHORT, RUN, BEAT = 46, 110, 60
#: Pauses in milliseconds: after a sentence, a paragraph, a colon, more after a question, around a beat.
PAUSE = {"sentence": 350, "paragraph": 700, "colon": 500, "question": 150, "before": 900, "after": 1100}
#: Speeds in per cent.
SPEED = {"line": 100, "run": 106, "beat": 92}
HOLD = 1_200


def breaths(sentences: Column) -> Column:
    """Array of ``text, n``: runs of short sentences joined up to RUN characters, long ones alone."""
    none = F.expr("cast(array() as array<struct<text:string,n:int,open:boolean>>)")

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        short = F.length(x) <= SHORT
        joined = F.concat_ws(" ", last["text"], x)
        own = F.struct(x.alias("text"), F.lit(1).alias("n"), short.alias("open"))
        grown = F.struct(joined.alias("text"), (last["n"] + 1).alias("n"), F.lit(True).alias("open"))
        fits = short & (F.size(a) > 0) & last["open"] & (F.length(joined) <= RUN)
        return F.when(fits, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(grown))).otherwise(F.concat(a, F.array(own)))

    # an empty array has no last element: element_at would fail under ANSI rules, get would not
    return F.aggregate(F.slice(sentences, F.lit(2), F.greatest(F.size(sentences) - 1, F.lit(0))), F.when(F.size(sentences) > 0, F.array(F.struct(F.get(sentences, F.lit(0)).alias("text"), F.lit(1).alias("n"), (F.length(F.get(sentences, F.lit(0))) <= SHORT).alias("open")))).otherwise(none), step)


def base_pause(text: Column, ends_paragraph: Column) -> Column:
    """Pause after a unit by its last mark and its place, in milliseconds."""
    base = F.when(ends_paragraph, PAUSE["paragraph"]).otherwise(PAUSE["sentence"])
    last = F.right(F.rtrim(text), F.lit(1))
    return F.when(last == "?", base + PAUSE["question"]).when(last == ":", F.greatest(base, F.lit(PAUSE["colon"]))).otherwise(base)


def units(blocks: DataFrame, key: str) -> DataFrame:
    """``key, place, text, role, speed, pause``: units of the paragraphs of a script, in order.

    ``blocks``: key, idx, text. A short paragraph that stands alone is a beat, slower and with
    silence around it; joined short sentences are a run, a little faster; nothing hangs after the last.
    """
    rows = blocks.select(key, "idx", breaths(T.sentences(F.col("text"))).alias("b")).where(F.size("b") > 0)
    beat = (F.size("b") == 1) & (F.get("b", F.lit(0))["n"] <= 2) & (F.length(F.get("b", F.lit(0))["text"]) <= BEAT)
    each = rows.select(key, "idx", beat.alias("beat"), F.size("b").alias("n_groups"), F.posexplode("b").alias("pos", "u"))
    w = Window.partitionBy(key).orderBy("idx", "pos")
    role = F.when(F.col("beat"), "beat").when(F.col("u.n") > 1, "run").otherwise("line")
    after = F.when(F.col("beat"), PAUSE["after"]).otherwise(base_pause(F.col("u.text"), F.col("pos") == F.col("n_groups") - 1))
    next_beat = F.lead("beat").over(w)
    pause = F.when(next_beat.isNull(), 0).when(next_beat, F.greatest(after, F.lit(PAUSE["before"]))).otherwise(after)
    speed = F.create_map(*(F.lit(x) for kv in SPEED.items() for x in kv))
    return each.select(key, (F.row_number().over(w) - 1).alias("place"), F.col("u.text").alias("text"), role.alias("role"), speed[role].alias("speed"), pause.alias("pause"))


def anchored(chunks: DataFrame, heard: DataFrame, key: str) -> DataFrame:
    """``key, chunk, start, stop``: chunks of a script on the words that were heard.

    chunks: key, chunk, first, last (word numbers); heard: key, word, start, stop (ms), some words
    missing. A chunk begins with its first heard word and ends with its last; one without any
    takes the time between its neighbours. A chunk holds until the next begins, HOLD at most.
    """
    own = heard.select(F.col(key).alias("__k"), "word", F.col("start").alias("w_start"), F.col("stop").alias("w_stop"))
    hit = chunks.join(own, (F.col(key) == F.col("__k")) & (F.col("word") >= F.col("first")) & (F.col("word") <= F.col("last")), "left")
    found = hit.groupBy(key, "chunk").agg(F.min("w_start").alias("a"), F.max("w_stop").alias("b"))
    w = Window.partitionBy(key).orderBy("chunk")
    before, behind = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    found = found.withColumn("a2", F.coalesce("a", F.last("b", ignorenulls=True).over(before), F.lit(0)))
    found = found.withColumn("b2", F.coalesce("b", F.first("a", ignorenulls=True).over(behind), F.col("a2")))
    found = found.withColumn("start", F.max("a2").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    until = F.coalesce(F.lead("start").over(w), F.greatest("start", "b2"))
    stop = F.greatest("start", F.least(until, F.greatest("start", "b2") + HOLD))
    return found.select(key, "chunk", "start", stop.alias("stop"))


def fragments(text: Column, most: int) -> Column:
    """A sentence broken at its clause marks, up to ``most`` fragments; what is over goes to the last."""
    parts = F.filter(F.transform(F.split(text, r"[,;:]\s+"), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.array_join(F.slice(parts, F.lit(most), F.greatest(F.size(parts) - most + 1, F.lit(1))), ", ")
    return F.when(F.size(parts) <= most, parts).otherwise(F.concat(F.slice(parts, 1, most - 1), F.array(rest)))


def blocks_of(fragment: Column) -> Column:
    """One or two content words of a fragment that stand for it; null where it has none."""
    own = F.slice(T.content_terms(fragment), 1, 2)
    return F.when(F.size(own) > 0, own)


def equal_windows(n: Column, start: Column, stop: Column, least: int) -> Column:
    """Array of ``start, stop``: consecutive equal slices of a window, none shorter than ``least`` unless the window is."""
    fit = F.greatest(F.least(n, F.floor((stop - start) / least).cast("int")), F.lit(1))
    edge = lambda k: (start + F.floor((stop - start) * k / fit)).cast("long")
    return F.transform(F.sequence(F.lit(0), fit - 1), lambda k: F.struct(edge(k).alias("start"), edge(k + 1).alias("stop")))


def intent_of_role(role: Column, importance: Column) -> Column:
    return F.when(role == "beat", "punch").when((role == "run") | (importance >= 70), "drive").otherwise("carry")
