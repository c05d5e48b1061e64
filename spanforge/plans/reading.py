"""Queries that read whole scripts, and small numeric rules of planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import beats, editorial
from spanforge.functions import text as T
from spanforge.operators import captions, reading
from spanforge.plans.binding import LINES, Plans, content, fold_b, listed, words
from spanforge.sources.catalog import bare_lines, table

query = Plans()
_CAND = f"""ct as (select doc_id, idx, text, {content('text')} as c from l), cd as (select doc_id, idx, text, list_filter(c, lambda x, i: list_position(c, x) = i) as t from ct),
sz as (select doc_id, count(*) as n from cd group by 1), dt as (select doc_id, idx, unnest(t) as term from cd), df as (select doc_id, term, count(*) as df from dt group by all),
su as (select doc_id, list(term) as s from df join sz using (doc_id) where n >= 4 and df > 0.25 * n group by 1),
cn as (select cd.doc_id, idx, text, t, list_filter(t, lambda x: not list_contains(coalesce(s, []), x)) as o from cd left join su on su.doc_id = cd.doc_id),
op as (select doc_id, idx, text, (case when len(o) > 0 then o else t end)[1:2] as o from cn)"""


@query(f"""with recursive {LINES}, {_CAND}, r(doc_id, idx, concept, last) as (select doc_id, idx, o[1], o[1] from op where idx = 0 union all
  select op.doc_id, op.idx, coalesce(case when o[1] <> r.last or r.last is null then o[1] end, o[2], o[1]), coalesce(case when o[1] <> r.last or r.last is null then o[1] end, o[2], o[1], r.last) from r join op on op.doc_id = r.doc_id and op.idx = r.idx + 1)
select doc_id, idx, concept from r""")
def line_concepts(spark: SparkSession, d: str) -> DataFrame:
    """What each line is about: not the text's subject, and not what the line before took."""
    return reading.concepts(reading.candidates(bare_lines(spark, d), "doc_id"), "doc_id", "idx")


_BARES = "list_transform(" + words("text") + ", lambda y: " + fold_b("regexp_replace(y, '^[^0-9A-Za-zÀ-ÿ]+|[^0-9A-Za-zÀ-ÿ]+$', '', 'g')") + ")"


@query(f"""with {LINES}, ct as (select doc_id, idx, {content('text')} as c, {_BARES} as b from l), k as (select doc_id, idx, b, list_filter(c, lambda x, i: list_position(c, x) = i) as t from ct),
s as (select doc_id, idx, list_filter(b, lambda x: regexp_matches(x, '^[0-9]+$'))[1] as fig, list_has_any(b, {listed(beats.CONTRASTS)}) as turn, t, list_filter(t, lambda x: substr(x, 1, 5) <> substr(t[1], 1, 5))[1] as two from k),
y as (select doc_id, idx, case when fig is not null then fig when turn and len(t) > 0 then t[len(t)] when two is not null then t[1] || ' ' || two else t[1] end as words,
  case when fig is not null then 'figure' when turn and len(t) > 0 then 'turn' when two is not null then 'pair' when len(t) > 0 then 'word' end as role from s) select * from y where words is not null""")
def composed_lines(spark: SparkSession, d: str) -> DataFrame:
    found = bare_lines(spark, d).select("doc_id", "idx", reading.composed(F.col("text")).alias("c")).where("c is not null")
    return found.select("doc_id", "idx", "c.words", "c.role")


@query(f"""with {LINES}, r as (select doc_id, idx, text, regexp_extract_all(text, '[0-9A-Za-zÀ-ÿ]+') as r, regexp_extract(text, '[0-9]+([.,][0-9]+)*%?') as fig from l where len({words('text')}) > 1),
c as (select *, list_filter(r, lambda x: length(x) >= 4 and not list_contains({listed(T.STOPWORDS + T.GENERIC)}, {fold_b('x')})) as c from r),
p as (select doc_id, idx, text, case when fig <> '' then fig else list_filter(c, lambda x: length(x) = list_max(list_transform(c, lambda y: length(y))))[1] end as p from c)
select doc_id, idx, (instr(text, p) - 1)::int as start, (instr(text, p) - 1 + length(p))::int as stop, p as part from p where p is not null""")
def highlight_spans(spark: SparkSession, d: str) -> DataFrame:
    """The accent of a line as character offsets, and the characters there."""
    rows = bare_lines(spark, d).select("doc_id", "idx", "text", editorial.highlight(F.col("text")).alias("h")).where("h is not null")
    return rows.select("doc_id", "idx", "h.start", "h.stop", F.col("text").substr(F.col("h.start") + 1, F.col("h.stop") - F.col("h.start")).alias("part"))


@query("""with s as (select event_id, case event_id % 3 when 0 then 'SEQ ' || (event_id % 90) || ' -> A' when 1 then ' SEQ ' || (event_id % 9000) || ' -> PENDING ' else 'SEQ x -> B' end as line from events)
select event_id, regexp_extract(line, 'SEQ ([0-9]+)', 1)::int as sequence, regexp_extract(line, '-> ([A-Z]+)', 1) as choice from s where regexp_matches(line, '^\\s*SEQ\\s+[0-9]{1,3}\\s*->\\s*([A-Z]|REGENERATE|PENDING)\\s*$')""")
def approval_lines(spark: SparkSession, d: str) -> DataFrame:
    number = lambda n: (F.col("event_id") % n).cast("string")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("SEQ "), number(90), F.lit(" -> A"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" SEQ "), number(9000), F.lit(" -> PENDING "))).otherwise("SEQ x -> B")
    return table(spark, d, "events").select("event_id", editorial.approvals(line).alias("a")).where("a is not null").select("event_id", "a.*")


@query("""select event_id, round(case when event_id % 3 = 0 then value when event_id % 3 = 1 then 100.0 * (event_id % 40) / 50 else greatest((event_id % 40) * 60.0 / 150, 1.0) end, 6) as seconds from events""")
def declared_durations(spark: SparkSession, d: str) -> DataFrame:
    """Declared, else a share of what remains, else words at a pace with a floor."""
    key, n = F.col("event_id") % 3, (F.col("event_id") % 40).cast("int")
    found = editorial.declared_or_share(F.when(key == 0, F.col("value")), n, F.when(key == 1, F.lit(100.0)).otherwise(0.0), F.lit(50))
    return table(spark, d, "events").select("event_id", F.round(found, 6).alias("seconds"))


@query("select event_id, greatest(least(round_even(value / 4.0, 0), floor(value / 1.5)), ceil(value / 10.0), 1)::int as n from events")
def shot_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", editorial.shot_count(F.col("value"), 4.0, 1.5, 10.0).alias("n"))


@query("""select event_id, 'lift' as name, unnest(['contrast', 'gain', 'gamma']) as parameter, unnest([1.0 + (event_id % 5) * 0.02::double, 0.9::double, 1.1::double]) as value from events where value < 175""")
def grade_parameters(spark: SparkSession, d: str) -> DataFrame:
    """A grade as rows of its parameters; grades that change nothing have none."""
    name = editorial.grade_for(F.col("value") / 500)
    part = lambda n, v: F.struct(F.lit(n).alias("parameter"), v.alias("value"))
    parts = F.array(part("contrast", 1.0 + (F.col("event_id") % 5) * 0.02), part("gain", F.lit(0.9)), part("gamma", F.lit(1.1)))
    rows = table(spark, d, "events").select("event_id", name.alias("name"), F.explode(parts).alias("p")).where("name = 'lift'")
    return rows.select("event_id", "name", "p.*")


@query(f"""with {LINES}, w as (select doc_id, idx, {words('text')} as w from l), n as (select *, lead(w[1]) over (partition by doc_id order by idx) as a from w)
select doc_id, idx, case when list_position(w[3:], a) > 0 then (list_position(w[3:], a) + 1)::int else 2 end as place from n where a is not null and len(w) > 2""")
def anchor_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first place, from the third word on, at which a line has the next line's first word; else the third."""
    from pyspark.sql.window import Window

    rows = bare_lines(spark, d).withColumn("w", T.words(F.col("text")))
    rows = rows.withColumn("a", F.lead(F.get("w", F.lit(0))).over(Window.partitionBy("doc_id").orderBy("idx"))).where("a is not null and size(w) > 2")
    at = F.array_position(F.slice("w", F.lit(3), F.size("w")), F.col("a"))
    return rows.select("doc_id", "idx", F.when(at > 0, at + 1).otherwise(2).cast("int").alias("place"))


@query(None)
def caption_lines(spark: SparkSession, d: str) -> DataFrame:
    """Caption pieces of every text. A fold with look-back per sentence: tested by its properties."""
    flat = table(spark, d, "documents").where("text is not null").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    return captions.caption_chunks(flat, "doc_id", "text")


QUERIES, ORACLES = query.queries, query.oracles
