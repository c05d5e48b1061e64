"""Queries of sequential decisions and of the review that merges detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import intervals, rank, sequential, terms
from spanforge.plans import retrieval
from spanforge.plans import text as text_plan
from spanforge.sources.catalog import bare_lines, spans, table

MINUTE = 60_000_000


def repetition_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = bare_lines(spark, d).select("doc_id", "idx", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))
    return sequential.streamed(rows, "doc_id", ["idx"], sequential.repetition, "doc_id long, idx long, suggestion string, similarity double")


def tangent_runs(spark: SparkSession, d: str) -> DataFrame:
    marked = F.transform(F.split("text", "\n"), lambda x: x.rlike("(?i)^(by|for|that|pour|para|nicht)\\b"))
    return terms.tangent_runs(text_plan.read(spark, d, marked.alias("marked")), "doc_id")


#: What the detectors propose: ``suggestion, category, confidence, level``.
PROPOSALS = (("CUT", "notice", 0.9, 2), ("REVIEW", "filler", 0.6, 1), ("REVIEW", "shout", 0.5, 1), ("CUT", "nothing new", 0.7, 2))


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Every place of the documents with the proposals of the detectors, ``p``, in their order."""
    spoken = F.transform(F.split("text", "\n"), lambda x: T.once(text_plan.intent_of(x), lambda i: F.when(i == "legal", 0).when(i == "reaction", 2)))
    made = F.array(*(F.struct(F.lit(level).alias("level"), F.lit(-k).alias("rank"), F.lit(what).alias("suggestion"), F.lit(why).alias("category"), F.lit(share).alias("confidence")) for k, (what, why, share, level) in enumerate(PROPOSALS)))
    docs = text_plan.read(spark, d, text_plan.line_lengths().alias("lengths"), spoken.alias("spoken"))
    return terms.reviewed(docs, "doc_id").withColumn("p", F.transform("found", lambda k: F.get(made, k)))


def review_merge(spark: SparkSession, d: str) -> DataFrame:
    """Proposals of the detectors, merged: strongest suggestion, its first category, all reasons."""
    top = F.array_max("p")
    sure = F.array_max(F.transform(F.filter("p", lambda x: x["level"] == F.col("top.level")), lambda x: x["confidence"]))
    found = _reviewed(spark, d).where(F.size("p") > 0).withColumn("top", top)
    return found.select("doc_id", "idx", "top.suggestion", "top.category", F.array_join(F.transform("p", lambda x: x["category"]), "; ").alias("reasons"), sure.alias("confidence"))


def review_summary(spark: SparkSession, d: str) -> DataFrame:
    """Removable time of a document: cuts whole, reviews half, and counts by suggestion."""
    none = F.col("doc_id").isNull() | (F.size("p") == 0)
    rows = _reviewed(spark, d).withColumn("suggestion", F.when(~none, F.array_max("p")["suggestion"]))
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    out = rows.groupBy("doc_id").agg(
        count(F.col("suggestion") == "CUT").alias("n_cut"), count(F.col("suggestion") == "REVIEW").alias("n_review"), count(F.col("suggestion").isNull()).alias("n_keep"),
        F.sum(F.when(F.col("suggestion") == "CUT", 2 * F.col("length")).when(F.col("suggestion") == "REVIEW", F.col("length")).otherwise(0)).alias("twice"), F.max("stop").alias("duration"),
    )
    return out.select("doc_id", "n_cut", "n_review", "n_keep", (F.col("duration") - F.floor(F.col("twice") / 2)).cast("long").alias("estimate"))


def greedy_gap_select(spark: SparkSession, d: str) -> DataFrame:
    rows = spans(spark, d).select("user_id", "event_id", (F.col("start") / 1_000_000).alias("start"), F.round(F.col("value") / 500, 3).alias("importance"))
    step = lambda x: sequential.gap_select(x, 86_400.0, 15)
    return sequential.streamed(rows, "user_id", [F.desc("importance"), "start", "event_id"], step, "user_id long, event_id long, start double, importance double")


def greedy_anchor_match(spark: SparkSession, d: str) -> DataFrame:
    all_ = spans(spark, d)
    points = all_.where("kind = 'click'").select("user_id", "event_id", F.col("start").alias("at"))
    anchors = all_.where("kind = 'purchase'").select(F.col("user_id").alias("a_user"), F.col("event_id").alias("anchor_id"), F.col("start").alias("anchor_at"))
    pairs = intervals.band(points, anchors, 720 * MINUTE).where("user_id = a_user").select("user_id", "event_id", "anchor_id", F.abs(F.col("at") - F.col("anchor_at")).alias("distance"))
    return sequential.streamed(pairs, "user_id", ["distance", "event_id", "anchor_id"], sequential.match_anchors, "user_id long, event_id long, anchor_id long, distance long")


def word_alignment(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return sequential.streamed(turns, "conv_id", ["turn"], sequential.align_words, "conv_id long, turn long, matched long, n_words long")


def direction_plan(spark: SparkSession, d: str) -> DataFrame:
    weights = {"wide": 3.0, "medium": 4.0, "close": 2.0, "detail": 1.0}
    step = lambda x: sequential.direct(x, weights, "direction")
    return sequential.streamed(spans(spark, d).select("user_id", "event_id", "start", "value"), "user_id", ["start", "event_id"], step, "user_id long, event_id long, composition string")


def treatment_plan(spark: SparkSession, d: str) -> DataFrame:
    weights = {"hold": 3.0, "push": 2.0, "cut": 2.0, "split": 1.0}
    step = lambda x: sequential.treat(x, weights, "treatment")
    return sequential.streamed(spans(spark, d).select("user_id", "event_id", "start", "value"), "user_id", ["start", "event_id"], step, "user_id long, event_id long, treatment string")


def resolve_stateful(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a plan in order; what was chosen before lowers the score of what comes."""
    scored = rank.ranked(retrieval._scored(spark, d).where(F.size("reasons") == 0), rank.LIMIT)
    rows = scored.select(F.floor(F.col("req") / 20).alias("plan"), "req", "cand", "score", "family")
    return sequential.streamed(rows, "plan", ["req", "cand"], sequential.resolve, "plan long, req long, cand long, score double")


QUERIES = {
    f.__name__: f
    for f in (
        repetition_flags, tangent_runs, review_merge, review_summary, greedy_gap_select, greedy_anchor_match, word_alignment, direction_plan, treatment_plan, resolve_stateful,
    )
}

_IN = text_plan._in
_REVIEW = text_plan.ORACLES["filler_density"], text_plan.ORACLES["intent_class"], text_plan.ORACLES["fresh_terms"]
_MERGED = f"""fi as ({_REVIEW[0]}), ic as ({_REVIEW[1]}), fr as ({_REVIEW[2]}),
ev as (select doc_id, idx, 1 as detector, 'REVIEW' as suggestion, 'filler' as category, 0.6::double as confidence from fi union all select doc_id, idx, 0, 'CUT', 'notice', 0.9::double from ic where intent = 'legal'
union all select doc_id, idx, 2, 'REVIEW', 'shout', 0.5::double from ic where intent = 'reaction' union all select doc_id, idx, 3, 'CUT', 'nothing new', 0.7::double from fr where fresh = 0),
lv as (select *, case suggestion when 'CUT' then 2 else 1 end as level from ev), tp as (select *, max(level) over (partition by doc_id, idx) as top from lv),
mg as (select doc_id, idx, arg_min(suggestion, detector - 10 * level) as suggestion, arg_min(category, detector - 10 * level) as category, string_agg(category, '; ' order by detector) as reasons, max(confidence) filter (level = top) as confidence from tp group by 1, 2)"""
ORACLES = {
    "review_merge": f"with {_MERGED} select * from mg",
    "review_summary": f"""with {text_plan._LINES}, {_MERGED}, j as (select l.doc_id, l.start, l.stop, mg.suggestion from l left join mg on mg.doc_id = l.doc_id and mg.idx = l.idx)
select doc_id, count(*) filter (suggestion = 'CUT') as n_cut, count(*) filter (suggestion = 'REVIEW') as n_review, count(*) filter (suggestion is null) as n_keep,
  (max(stop) - sum(case suggestion when 'CUT' then 2 * (stop - start) when 'REVIEW' then stop - start else 0 end)::bigint // 2)::bigint as estimate from j group by 1""",
}
ORACLES["tangent_runs"] = f"""with recursive {text_plan._SUBJ}, tr as (select l.doc_id, l.idx, regexp_matches(text, '(?i)^(by|for|that|pour|para|nicht)($|[^0-9A-Za-z_À-ÿ])') as marked, coalesce(round(hits / terms, 6), 0) as overlap
  from l left join so on so.doc_id = l.doc_id and so.idx = l.idx),
ru(doc_id, idx, first_idx, n) as (select doc_id, idx, case when marked then idx end, case when marked then 1 else 0 end from tr where idx = 0 union all
  select tr.doc_id, tr.idx, case when ru.n between 1 and 10 and overlap < 0.3 then ru.first_idx when marked then tr.idx end, case when ru.n between 1 and 10 and overlap < 0.3 then ru.n + 1 when marked then 1 else 0 end
  from ru join tr on tr.doc_id = ru.doc_id and tr.idx = ru.idx + 1)
select doc_id, first_idx, max(idx) as last_idx, max(n) as n_rows from ru where n > 0 group by doc_id, first_idx"""
