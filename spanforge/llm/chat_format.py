"""Chat formatting: every participant's view of a dialogue.

For each participant of a conversation the whole dialogue is rendered with that speaker as
``assistant`` and all others as ``user`` with their name; system turns stay system turns and
are nobody's. The mask lists the spans (first and last-but-one character, 0-based) of the
speaker's own words in the rendered text, the ones to learn.

A view is stored in pieces of ``PIECE`` turns, in order, so that a conversation with a third
of all rows is neither gathered in one task nor put in one string. ``start`` and the mask
count characters of the whole view, not of the piece: pieces put one behind the other are the
whole dialogue, and their masks its mask. With ``whole``, a view is one row; that is for
dialogues that fit one.

Turns are numbered by three levels of counts (turn numbers in bands, turn numbers, ties in
slices of a digest), each pre-aggregated, and pieces are placed by two; no window holds a
whole conversation.

Defined results: null text is empty text; a null speaker is the name ``unknown``; null turns
stand first; turns of equal number are ordered by the digest of speaker and text, and rows
that are alike in conversation, turn, speaker and text are one turn. A null conv_id is a
conversation. A conversation without participants (system turns alone) has no views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm.common import cleared, published

#: Turns of one piece.
PIECE = 64
#: Consecutive turn numbers, or pieces, of one band.
BAND = 256
#: Turns of a conversation that one key of the join with its participants takes.
BLOCK = 1024
SYSTEM = "system"


def numbered(turns: DataFrame) -> DataFrame:
    """Distinct turns with their place ``at`` (from 0) in the conversation."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    rows = rows.withColumn("digest", F.md5(F.concat(F.col("speaker"), F.lit("\x1f"), F.col("text"))))
    rows = rows.withColumns({"conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "t": F.coalesce("turn", F.lit(-(1 << 62))), "slice": F.substring("digest", 1, 3)})
    rows = published(rows.withColumn("band", F.floor(F.col("t") / BAND)), "chat-turns")
    sizes = rows.groupBy("conv", "band", "t", "slice").agg(F.count("*").alias("n"))
    before = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = sizes.groupBy("conv", "band").agg(F.sum("n").alias("n")).withColumn("band_at", before(["conv"], ["band"])).drop("n")
    numbers = sizes.groupBy("conv", "band", "t").agg(F.sum("n").alias("n")).withColumn("turn_at", before(["conv", "band"], ["t"])).drop("n")
    slices = sizes.withColumn("slice_at", before(["conv", "t"], ["slice"])).drop("n")
    starts = slices.join(numbers, ["conv", "band", "t"]).join(bands, ["conv", "band"]).select("conv", "t", "slice", (F.col("slice_at") + F.col("turn_at") + F.col("band_at")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("conv", "t", "slice").orderBy("digest", "speaker", "text")) - 1
    return rows.join(starts, ["conv", "t", "slice"]).select("conv", "conv_id", "speaker", "text", (F.col("start") + inside).alias("at"))


def _starts(sizes: DataFrame) -> DataFrame:
    """``conv, perspective, piece, start`` from ``n``, the characters of each piece: by bands, then inside them."""
    banded = sizes.withColumn("band", F.floor(F.col("piece") / BAND))
    before = lambda keys, order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    view = ["conv", "perspective"]
    bands = banded.groupBy(*view, "band").agg(F.sum("n").alias("n")).withColumn("band_at", before(view, "band")).drop("n")
    return banded.withColumn("at", before([*view, "band"], "piece")).join(bands, [*view, "band"]).select(*view, "piece", (F.col("at") + F.col("band_at")).alias("start"))


def perspectives(turns: DataFrame, whole: bool = False) -> DataFrame:
    """``conv_id, perspective, piece, start, n_turns, text, mask``: a row for each view's piece, or for each ``whole`` view."""
    with cleared(turns.sparkSession):
        return published(_perspectives(turns, whole), "chat-views", keep=True)


def _perspectives(turns: DataFrame, whole: bool) -> DataFrame:
    rows = numbered(turns).withColumns({"piece": F.floor(F.col("at") / PIECE), "block": F.floor(F.col("at") / BLOCK)})
    rows = published(rows, "chat-numbered")
    people = rows.where(F.col("speaker") != SYSTEM).select("conv", F.col("speaker").alias("perspective")).distinct()
    # However many turns a conversation has, a key of the join takes BLOCK of them.
    blocks = rows.select("conv", "block").distinct()
    views = rows.join(blocks.join(people, "conv"), ["conv", "block"])
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, "<|assistant|>\n").when(F.col("speaker") == SYSTEM, "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), F.col("speaker"), F.lit("|>\n")))
    views = views.select("conv", "conv_id", "perspective", "piece", "at", own.alias("own"), F.length(head).alias("head"), F.length("text").alias("body"), F.concat(head, "text", F.lit("\n<|end|>\n")).alias("part"))
    # A group has PIECE rows at most: gathering it is bounded.
    group = Window.partitionBy("conv", "perspective", "piece").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = views.withColumn("from", F.coalesce(F.sum(F.length("part")).over(group), F.lit(0)) + F.col("head"))
    span = F.when(F.col("own") & (F.col("body") > 0), F.struct(F.col("from").alias("a"), (F.col("from") + F.col("body")).alias("b")))
    gathered = placed.groupBy("conv", "conv_id", "perspective", "piece").agg(F.count("*").alias("n_turns"), F.sum(F.length("part")).alias("n"), F.array_sort(F.collect_list(F.struct("at", "part", span.alias("span")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "")
    spans = F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull())
    gathered = published(gathered.select("conv", "conv_id", "perspective", "piece", "n_turns", "n", text.alias("text"), spans.alias("spans")), "chat-pieces")
    starts = _starts(gathered.where("piece > 0").select("conv", "perspective").distinct().join(gathered.select("conv", "perspective", "piece", "n"), ["conv", "perspective"]))
    found = gathered.join(starts, ["conv", "perspective", "piece"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    mask = F.array_join(F.transform("spans", lambda s: F.concat(F.col("start") + s["a"], F.lit("-"), F.col("start") + s["b"])), ",")
    found = found.select("conv_id", "perspective", "piece", "start", "n_turns", "text", mask.alias("mask"))
    if not whole:
        return found
    every = found.groupBy("conv_id", "perspective").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("piece", "text", "mask"))).alias("parts"))
    joined = lambda name, by: F.array_join(F.filter(F.transform("parts", lambda p: p[name]), lambda x: x != ""), by).alias(name)
    none = F.lit(0).cast("long")
    return every.select("conv_id", "perspective", none.alias("piece"), none.alias("start"), "n_turns", joined("text", ""), joined("mask", ","))
