"""Queries of text functions and term statistics, bound to documents and their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as T
from spanforge.operators import terms
from spanforge.sources.catalog import bare_lines, by_id, lines, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def fold_tokens(spark: SparkSession, d: str) -> DataFrame:
    found = _docs(spark, d).withColumn("t", T.tokens(F.col("text")))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def content_terms(spark: SparkSession, d: str) -> DataFrame:
    found = _docs(spark, d).withColumn("t", T.content_terms(F.col("text")))
    return found.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_rows(bare_lines(spark, d), ["doc_id", "idx"], T.content_bag(F.col("text")))


def read(spark: SparkSession, d: str, *besides: Column) -> DataFrame:
    """Documents for what compares their lines: their tokens, and columns besides."""
    return by_id(_docs(spark, d), "doc_id", T.token_lines(F.col("text")).alias("tokens"), *besides)


def line_lengths() -> Column:
    return F.transform(F.split("text", "\n"), lambda x: F.length(x))


def term_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return terms.document_frequency(terms.term_rows(_docs(spark, d), ["doc_id"], T.tokens(F.col("text"))), "doc_id")


def top_keywords(spark: SparkSession, d: str) -> DataFrame:
    rows = terms.term_rows(_docs(spark, d), ["doc_id"], T.content_bag(F.col("text")))
    return terms.top_terms(rows, "doc_id", 5, F.col("pos")).select("doc_id", "term", "n", "place")


def dominant_vocab(spark: SparkSession, d: str) -> DataFrame:
    return terms.dominant_vocab(read(spark, d), "doc_id")


def dominant_terms_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Terms in more than a quarter of a document's lines."""
    size = bare_lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines")).where("n_lines >= 4")
    df = _terms(spark, d).groupBy("doc_id", "term", "idx").count().groupBy("doc_id", "term").agg(F.count("*").alias("df"))
    return df.join(size, "doc_id").where("df * 4 > n_lines").select("doc_id", "term", "df", "n_lines")


def filler_density(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose surroundings are dense in fillers and that have two of their own."""
    return terms.filler_density(read(spark, d, line_lengths().alias("lengths")), "doc_id")


def syllable_weight(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).groupBy("doc_id").agg(F.round(F.sum(T.chunk_weight(F.col("text"))), 3).alias("weight"))


def clause_weight(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).groupBy("doc_id").agg(F.round(F.sum(T.block_weight(F.col("text"))), 3).alias("weight"))


def cosine_prev8(spark: SparkSession, d: str) -> DataFrame:
    return terms.best_predecessor(read(spark, d), "doc_id").select("doc_id", "idx", "cosine")


def fresh_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.fresh_terms(read(spark, d), "doc_id")


def subject_overlap(spark: SparkSession, d: str) -> DataFrame:
    return terms.subject_overlap(read(spark, d), "doc_id")


def intro_outro(spark: SparkSession, d: str) -> DataFrame:
    """First and last line that touches the subject; long leads and tails are flagged."""
    return terms.intro_outro(read(spark, d, line_lengths().alias("lengths")), "doc_id")


def first_mention(spark: SparkSession, d: str) -> DataFrame:
    """First line of a document that has each keyword, with its time by character offset."""
    keywords = F.explode(F.array(*map(F.lit, ("license", "apache", "reserved")))).alias("keyword")
    rows = lines(spark, d).select("doc_id", "idx", "text", "start", keywords).withColumn("at", F.expr("locate(keyword, lower(text))"))
    hit = rows.where("at > 0").withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "keyword").orderBy("idx")))
    return hit.where("place = 1").select("doc_id", "keyword", "idx", (F.col("start") + F.col("at") - 1).alias("at_ms"))


def sentence_units(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with their pause: long after a question or exclamation, none at the end."""
    rows = _docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.regexp_replace("text", "\n", " "))).alias("idx", "s"))
    last = F.lead("idx").over(Window.partitionBy("doc_id").orderBy("idx")).isNull()
    pause = F.when(last, 0).when(F.col("s").rlike(r"[!?]$"), 450).when(F.col("s").rlike(r"\.$"), 350).otherwise(200)
    return rows.withColumn("pause", pause).groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sum("pause").cast("long").alias("pause_ms"))


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Words that are capitalised inside a sentence and never in lower case there."""
    rows = _docs(spark, d).select("doc_id", F.explode(T.sentences(F.regexp_replace("text", "\n", " "))).alias("s"))
    each = rows.select("doc_id", F.posexplode(F.regexp_extract_all("s", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("pos", "w"))
    cased = each.withColumn("upper", F.substring("w", 1, 1) != F.lower(F.substring("w", 1, 1)))
    found = cased.groupBy("doc_id", T.fold_b(F.col("w")).alias("name")).agg(F.bool_or(F.col("upper") & (F.col("pos") > 0)).alias("inside"), F.bool_or(~F.col("upper")).alias("lower"))
    return found.where("inside and not lower").select("doc_id", "name")


def intent_of(text: Column) -> Column:
    """The class of a line: the first rule that fits names it."""
    low = F.lower(text)
    first = F.when(low.rlike("[0-9]{4}"), "data").when(low.contains("license"), "legal").when(low.contains("!"), "reaction")
    return first.when(F.length(text) < 20, "title").when(low.contains(","), "explanation").otherwise("statement")


def importance_of(text: Column, idx: Column) -> Column:
    """Additive score of a line, capped at 1."""
    part = lambda test, value: F.when(test, value).otherwise(0.0)
    score = F.lit(0.2) + part(text.rlike("[0-9]"), 0.3) + part(F.size(T.words(text)) <= 8, 0.2) + part(text.contains("!"), 0.2) + part(idx == 0, 0.3)
    return F.round(F.least(score, F.lit(1.0)), 3)


def intent_class(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", intent_of(F.col("text")).alias("intent"))


def importance(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", importance_of(F.col("text"), F.col("idx")).alias("importance"))


def intensity(spark: SparkSession, d: str) -> DataFrame:
    """Bands by importance, raised by cues, on ordinals."""
    rows = lines(spark, d).withColumn("importance", importance_of(F.col("text"), F.col("idx")))
    level = F.when(F.col("importance") >= 0.8, 3).when(F.col("importance") >= 0.5, 2).when(F.col("importance") >= 0.3, 1).otherwise(0)
    raised = F.greatest(level, F.when(F.col("text").contains("!"), 2).otherwise(0), F.when(F.col("start") < 200, 1).otherwise(0))
    return rows.select("doc_id", "idx", F.get(F.array(*map(F.lit, ("quiet", "normal", "strong", "impact"))), raised).alias("intensity"))


QUERIES = {
    f.__name__: f
    for f in (
        fold_tokens, content_terms, term_document_frequency, top_keywords, dominant_vocab, dominant_terms_ratio, filler_density, syllable_weight, clause_weight,
        cosine_prev8, fresh_terms, subject_overlap, intro_outro, first_mention, sentence_units, entities, intent_class, importance, intensity,
    )
}


def _in(words: list[str] | tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_FOLD_B = f"translate(lower(%s), '{T.ACCENTED}', '{T.PLAIN}')"
_TOK = "regexp_extract_all(trim(replace(" + _FOLD_B + ", 'ß', 'ss')), '[a-z0-9]+')"
_STOP = _in(T.STOPWORDS)
_LINES = """l0 as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as idx, unnest(string_split(text, chr(10))) as text from documents),
l as (select *, (sum(length(text)) over (partition by doc_id order by idx))::bigint as stop, (sum(length(text)) over (partition by doc_id order by idx))::bigint - length(text) as start from l0)"""
_TERMS = _LINES + f""",
tk as (select doc_id, idx, {_TOK % 'text'} as t from l), tu as (select doc_id, idx, unnest(t) as term, generate_subscripts(t, 1) - 1 as p0 from tk),
tf as (select *, row_number() over (partition by doc_id, idx order by p0) - 1 as pos from tu where length(term) > 1 and term not in {_STOP}),
cn as (select doc_id, idx, term, count(*) as n from tf group by all)"""
_DOM = _TERMS + """,
sz as (select doc_id, count(*) as n_lines from l group by 1),
dc as (select doc_id, term, count(*) as df, sum(n)::bigint as total, min((idx, pos)) as first from (select doc_id, term, idx, count(*) as n, min(pos) as pos from tf group by all) group by all),
dv as (select doc_id, term, df, total, row_number() over (partition by doc_id order by total desc, first) as place from dc join sz using (doc_id) where df >= greatest(2, round_even(n_lines * 0.15, 0)) qualify place <= 15)"""
_SUBJ = _DOM + """,
so as (select c.doc_id, c.idx, count(*) as terms, count(dv.term) as hits from cn c left join dv on dv.doc_id = c.doc_id and dv.term = c.term group by 1, 2)"""
_LET = "lower(regexp_replace(w, '[^\\p{L}]', '', 'g'))"
_SYL = f"case when {_LET} = '' then 0 else greatest(len(regexp_extract_all({_LET}, '%s')) - case when {_LET} like '%%e' and len(regexp_extract_all({_LET}, '%s')) > 1 then 1 else 0 end, 1) end"
_V1, _V2 = "[aeiouy]+", "[aeiouyàáâãäåèéêëìíîïòóôõöùúûü]+"
_WORDS = "list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')"
_SENT = "ss as (select doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?…])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda x: trim(x)), lambda x: x <> '') as t from documents)"
_IMP = _LINES + f", im as (select doc_id, idx, text, start, round(least(0.2::double + case when regexp_matches(text, '[0-9]') then 0.3::double else 0 end + case when len({_WORDS}) <= 8 then 0.2::double else 0 end + case when contains(text, '!') then 0.2::double else 0 end + case when idx = 0 then 0.3::double else 0 end, 1.0::double), 3) as importance from l)"

ORACLES = {
    "fold_tokens": f"with t as (select doc_id, {_TOK % 'text'} as t from documents) select doc_id, len(t) as n_tokens, md5(array_to_string(t, ' ')) as digest from t",
    "content_terms": f"""with t as (select doc_id, regexp_extract_all(text, '[0-9A-Za-zÀ-ÿ]+') as t from documents), u as (select doc_id, {_FOLD_B % 'unnest(t)'} as term, generate_subscripts(t, 1) as pos from t),
g as (select doc_id, term, min(pos) as pos from u where length(term) >= 4 and term not in {_in(T.STOPWORDS + T.GENERIC)} group by all), a as (select doc_id, count(*) as n_terms, string_agg(term, ' ' order by pos) as s from g group by 1)
select d.doc_id, coalesce(n_terms, 0) as n_terms, md5(coalesce(s, '')) as digest from documents d left join a using (doc_id)""",
    "term_document_frequency": f"with t as (select doc_id, unnest({_TOK % 'text'}) as term from documents) select term, count(distinct doc_id) as df, count(*) as total from t group by 1",
    "top_keywords": f"""with t as (select doc_id, {_TOK % 'text'} as t from documents), u as (select doc_id, unnest(t) as term, generate_subscripts(t, 1) as pos from t),
c as (select doc_id, term, count(*) as n, min(pos) as first from u where length(term) > 1 and term not in {_STOP} group by all) select doc_id, term, n, row_number() over (partition by doc_id order by n desc, first) as place from c qualify place <= 5""",
    "dominant_vocab": f"with {_DOM} select doc_id, term, df, total, place from dv",
    "dominant_terms_ratio": f"with {_DOM} select dc.doc_id, term, df, n_lines from dc join sz using (doc_id) where n_lines >= 4 and df * 4 > n_lines",
    "filler_density": f"""with {_LINES}, t as (select doc_id, idx, start, stop, {_TOK % 'text'} as t from l),
f as (select doc_id, idx, start, stop, (start + stop) // 2 as mid, len(t) as n_tokens, len(list_filter(t, lambda x: x in {_in(T.FILLERS)})) + len(list_filter(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1] in {_in(T.FILLER_PAIRS)})) as hits from t)
select a.doc_id, a.idx, a.hits, sum(b.hits)::bigint as window_hits, sum(b.n_tokens)::bigint as window_tokens from f a join f b on b.doc_id = a.doc_id and b.stop > a.mid - 12500 and b.start < a.mid + 12500 group by 1, 2, 3
having sum(b.n_tokens) >= 12 and sum(b.hits) * 100 >= 15 * sum(b.n_tokens) and a.hits >= 2""",
    "syllable_weight": f"""with {_LINES}, w as (select doc_id, idx, text, unnest(case when len({_WORDS}) = 0 then [''] else {_WORDS} end) as w from l),
s as (select doc_id, idx, text, sum({_SYL % (_V1, _V1)}) as n from w group by all) select doc_id, round(sum(greatest(n, 1)::double + case when right(trim(text), 1) in ('.', '!', '?', '…') then 3.0::double when right(trim(text), 1) in (',', ';', ':') then 1.2::double else 0 end), 3) as weight from s group by 1""",
    "clause_weight": f"""with {_LINES}, w as (select doc_id, idx, text, unnest(case when len({_WORDS}) = 0 then [''] else {_WORDS} end) as w from l),
s as (select doc_id, idx, text, sum({_SYL % (_V2, _V2)}) as n from w group by all) select doc_id, round(sum(n::double + 3.0::double * len(regexp_extract_all(text, '[.!?…]')) + 1.2::double * len(regexp_extract_all(text, '[,;:]'))), 3) as weight from s group by 1""",
    "cosine_prev8": f"""with {_TERMS}, no as (select doc_id, idx, sqrt(sum(n * n)::double) as norm from cn group by 1, 2),
dt as (select a.doc_id, a.idx, b.idx as prev, sum(a.n * b.n) as dot from cn a join cn b on a.doc_id = b.doc_id and a.term = b.term and b.idx < a.idx and b.idx >= a.idx - 8 group by 1, 2, 3)
select d.doc_id, d.idx, max(round(dot::double / (x.norm * y.norm), 6)) as cosine from dt d join no x on x.doc_id = d.doc_id and x.idx = d.idx join no y on y.doc_id = d.doc_id and y.idx = d.prev group by 1, 2""",
    "fresh_terms": f"with {_TERMS} select a.doc_id, a.idx, sum(greatest(0, a.n - coalesce(b.n, 0)))::bigint as fresh from cn a left join cn b on b.doc_id = a.doc_id and b.term = a.term and b.idx = a.idx - 1 group by 1, 2",
    "subject_overlap": f"with {_SUBJ} select doc_id, idx, terms, hits, round(hits::double / terms, 6) as overlap from so",
    "intro_outro": f"""with {_SUBJ}, tc as (select l.*, so.hits > 0 as touch from l left join so on so.doc_id = l.doc_id and so.idx = l.idx),
e as (select doc_id, min(start) filter (touch) as lead, min(idx) filter (touch) as lead_rows, max(stop) filter (touch) as last, max(stop) as total from tc group by 1)
select doc_id, lead, total - last as tail, lead > 2500 and lead_rows >= 3 as long_intro, total - last > 2000 as long_outro from e where lead is not null""",
    "first_mention": f"with {_LINES}, k as (select unnest(['license', 'apache', 'reserved']) as keyword), h as (select doc_id, keyword, idx, start + instr(lower(text), keyword) - 1 as at_ms from l, k where instr(lower(text), keyword) > 0) select * from h qualify row_number() over (partition by doc_id, keyword order by idx) = 1",
    "sentence_units": f"with {_SENT}, u as (select doc_id, unnest(t) as s, generate_subscripts(t, 1) as i, len(t) as n from ss) select doc_id, count(*) as n_units, sum(case when i = n then 0 when regexp_matches(s, '[!?]$') then 450 when regexp_matches(s, '\\.$') then 350 else 200 end)::bigint as pause_ms from u group by 1",
    "entities": f"""with {_SENT}, u as (select doc_id, unnest(t) as s from ss), w as (select doc_id, regexp_extract_all(s, '[A-Za-zÀ-ÿ]+') as t from u), x as (select doc_id, unnest(t) as w, generate_subscripts(t, 1) - 1 as pos from w)
select doc_id, {_FOLD_B % 'w'} as name from x group by 1, 2 having bool_or(substr(w, 1, 1) <> lower(substr(w, 1, 1)) and pos > 0) and not bool_or(substr(w, 1, 1) = lower(substr(w, 1, 1)))""",
    "intent_class": f"with {_LINES} select doc_id, idx, case when regexp_matches(text, '[0-9]{{4}}') then 'data' when contains(lower(text), 'license') then 'legal' when contains(text, '!') then 'reaction' when length(text) < 20 then 'title' when contains(text, ',') then 'explanation' else 'statement' end as intent from l",
    "importance": f"with {_IMP} select doc_id, idx, importance from im",
    "intensity": f"""with {_IMP} select doc_id, idx, (['quiet', 'normal', 'strong', 'impact'])[1 + greatest(case when importance >= 0.8 then 3 when importance >= 0.5 then 2 when importance >= 0.3 then 1 else 0 end, case when contains(text, '!') then 2 else 0 end, case when start < 200 then 1 else 0 end)] as intensity from im""",
}
