"""Queries of retrieval and ranking: benchmark items ask, documents answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import text as T
from spanforge.operators import rank
from spanforge.plans import text as text_plan
from spanforge.sources.catalog import table

_LANGS = ("en", "fr", "de", "es")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    lang = F.get(F.array(*map(F.lit, _LANGS)), (F.col("item_id") % 4).cast("int"))
    return rank.sanitized(b, F.col("text")).select(F.col("item_id").alias("req"), lang.alias("type"), "terms", "usable", F.length("text").alias("needed"))


def _bags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("cand"), F.col("lang").alias("type"), T.content_terms(F.col("text")).alias("bag"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    toxic = table(spark, d, "labels").select(F.col("doc_id").alias("cand"), "toxic")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("cand"), "n_chars", "source", rank.family(F.col("text")).alias("family"))
    return docs.join(toxic, "cand", "left").withColumn("toxic", F.coalesce("toxic", F.lit(0)))


def _found(spark: SparkSession, d: str) -> DataFrame:
    requests, bags = _requests(spark, d), _bags(spark, d)
    return rank.with_fallback(requests, bags, rank.matches(requests, bags))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    requests = _requests(spark, d).select("req", F.size("terms").alias("n_terms"), "needed")
    pairs = _found(spark, d).join(requests, "req").join(_facts(spark, d), "cand").withColumn("preferred", F.col("source").isin("src0", "src1", "src2", "src3", "src4"))
    return rank.scored(pairs).withColumn("reasons", rank.refusals(F.col("toxic"), F.col("n_chars"), F.col("family")))


def sanitize_query(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).select("req", F.array_join("terms", " ").alias("terms"), "usable")


def search_any_term_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d)


def score_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("req", "cand", "matched", "score")


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("req", "cand", F.when(F.size("reasons") > 0, "refused").otherwise("admitted").alias("verdict"), F.array_join("reasons", ",").alias("reasons"))


def hard_veto(spark: SparkSession, d: str) -> DataFrame:
    """How often each reason refused a candidate."""
    return _scored(spark, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rank.ranked(_scored(spark, d).where(F.size("reasons") == 0), rank.ATTEMPTS).select("req", "cand", "score", "rank")


def semantic_floor(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where(F.col("query_match") > rank.FLOOR).groupBy("req").agg(F.count("*").alias("supported"))


def query_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Of three ever shorter queries of an item, the first that finds anything in its type."""
    requests = _requests(spark, d)
    each = requests.select("req", "type", F.posexplode(F.array(F.col("terms"), F.slice("terms", 1, 3), F.slice("terms", 1, 1))).alias("query", "terms"))
    need = F.when(F.col("query") == 0, 3).otherwise(1)
    each = each.withColumn("n_min", need)
    bags = _bags(spark, d).select("cand", "type", F.explode("bag").alias("term"))
    hits = each.select("req", "type", "query", "n_min", F.explode("terms").alias("term")).join(bags, ["type", "term"]).groupBy("req", "query", "n_min", "cand").agg(F.count("*").alias("n")).where("n >= n_min")
    return hits.groupBy("req").agg(F.min("query").alias("query"))


def comparative_refusal(spark: SparkSession, d: str) -> DataFrame:
    admitted = _scored(spark, d).where(F.size("reasons") == 0)
    return rank.comparative(admitted, F.col("family") != "prose").select("req", "cand", "family", "refused")


def reuse_review(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    uses = docs.select(F.concat("source", F.lit("/"), "lang", F.lit("/"), (F.col("doc_id") % 50).cast("string")).alias("grp"), "doc_id", T.content_terms(F.col("text")).alias("terms"))
    first = uses.groupBy("grp").agg(F.min("doc_id").alias("first_id"))
    placed = uses.join(first, "grp").withColumn("pos", F.col("doc_id") - F.col("first_id"))
    return rank.reuse_review(placed.select("grp", "doc_id", "pos", "terms")).select("grp", "doc_id", "keeps")


def visual_family(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(rank.family(F.col("text")).alias("family"), "lang").groupBy("family", "lang").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (sanitize_query, search_any_term_fallback, score_candidates, verdicts, hard_veto, topk_candidates, semantic_floor, query_fallback, comparative_refusal, reuse_review, visual_family)
}

_CT = f"""(select id, term, min(pos) as pos from (select id, {text_plan._FOLD_B % 'unnest(t)'} as term, generate_subscripts(t, 1) as pos from (select %s as id, regexp_extract_all(text, '[0-9A-Za-zÀ-ÿ]+') as t from %s)) where length(term) >= 4 and term not in {text_plan._in(T.STOPWORDS + T.GENERIC)} group by all)"""
_FAMILY = "case when regexp_matches(text, '[#$%&*]{2}') then 'symbols' when contains(text, '|') then 'table' when contains(text, '!!') then 'shouting' when regexp_matches(text, '[0-9]{5}') then 'numbers' else 'prose' end"
_BASE = f"""rt as {_CT % ('item_id', 'benchmark')}, dt as {_CT % ('doc_id', 'documents')},
rq as (select item_id as req, (['en', 'fr', 'de', 'es'])[1 + item_id % 4] as type, length(text) as needed from benchmark),
hits as (select rq.req, dt.id as cand, count(*) as matched from rq join rt on rt.id = rq.req join dt on dt.term = rt.term join documents d on d.doc_id = dt.id and d.lang = rq.type group by 1, 2),
head as (select lang as type, doc_id as cand from documents qualify row_number() over (partition by lang order by doc_id) <= 24),
found as (select * from (select req, cand, matched from hits qualify row_number() over (partition by req order by cand) <= 24) union all select rq.req, head.cand, 0 from rq join head using (type) where rq.req not in (select req from hits)),
sc as (select f.req, f.cand, f.matched, d.n_chars, rq.needed, {_FAMILY} as family, coalesce(l.toxic, 0) as toxic,
  0.6::double * (f.matched / greatest((select count(*) from rt where rt.id = f.req), 1)) as query_match, d.source in ('src0', 'src1', 'src2', 'src3', 'src4') as preferred
  from found f join rq on rq.req = f.req join documents d on d.doc_id = f.cand left join labels l on l.doc_id = f.cand),
ss as (select *, round(query_match + case when n_chars >= needed then 0.25::double else 0.25::double * n_chars / needed end + case when preferred then 0.15::double else 0 end, 6) as score,
  list_filter([case when toxic = 1 then 'toxic' end, case when n_chars < 50 then 'too short' end, case when family = 'symbols' then 'symbol noise' end], lambda x: x is not null) as reasons from sc)"""

ORACLES = {
    "sanitize_query": f"with rt as {_CT % ('item_id', 'benchmark')} select item_id as req, coalesce(string_agg(term, ' ' order by pos), '') as terms, count(term) >= 2 as usable from benchmark left join rt on rt.id = item_id group by 1",
    "search_any_term_fallback": f"with {_BASE} select req, cand, matched from found",
    "score_candidates": f"with {_BASE} select req, cand, matched, score from ss",
    "verdicts": f"with {_BASE} select req, cand, case when len(reasons) > 0 then 'refused' else 'admitted' end as verdict, array_to_string(reasons, ',') as reasons from ss",
    "hard_veto": f"with {_BASE} select reason, count(*) as n from (select unnest(reasons) as reason from ss) group by 1",
    "topk_candidates": f"with {_BASE} select req, cand, score, row_number() over (partition by req order by score desc, cand) as rank from ss where len(reasons) = 0 qualify rank <= 6",
    "semantic_floor": f"with {_BASE} select req, count(*) as supported from ss where query_match > 0.1 group by 1",
    "query_fallback": f"""with {_BASE}, o as (select id, term, row_number() over (partition by id order by pos) as k from rt), q as (select id, 0 as query, 3 as n_min, term from o union all select id, 1, 1, term from o where k <= 3 union all select id, 2, 1, term from o where k = 1),
h as (select rq.req, q.query, q.n_min, dt.id, count(*) as n from q join rq on rq.req = q.id join dt on dt.term = q.term join documents d on d.doc_id = dt.id and d.lang = rq.type group by all) select req, min(query) as query from h where n >= n_min group by 1""",
    "comparative_refusal": f"with {_BASE}, a as (select * from ss where len(reasons) = 0) select req, cand, family, family <> 'prose' and bool_or(family = 'prose') over (partition by req) as refused from a",
    "reuse_review": f"""with dt as {_CT % ('doc_id', 'documents')}, u as (select source || '/' || lang || '/' || (doc_id % 50) as grp, doc_id from documents), f as (select grp, min(doc_id) as first_id from u group by 1),
n as (select u.grp, u.doc_id, f.first_id, (select count(*) from dt a join dt b on a.term = b.term where a.id = u.doc_id and b.id = f.first_id) as shared from u join f using (grp)) select grp, doc_id, shared >= 2 or doc_id = first_id as keeps from n""",
    "visual_family": f"select {_FAMILY} as family, lang, count(*) as n from documents group by 1, 2",
}
