"""Queries of narration units, captions and chains. Paragraphs are pairs of a document's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as T
from spanforge.operators import narration
from spanforge.plans.binding import LINES, Plans, content, words
from spanforge.sources.catalog import bare_lines, table

query = Plans()
_SENT = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(30), 'g'), chr(30)), lambda x: trim(x)), lambda x: x <> '')"
_BREATHS = f"""l2 as (select doc_id, idx // 2 as idx, string_agg(text, ' ' order by idx) as text from l group by all), se as (select doc_id, idx, {_SENT} as t from l2),
br(doc_id, idx, t, k, txt, n, op, outs) as (select doc_id, idx, t, 2, t[1], 1, length(t[1]) <= 46, cast([] as struct("text" varchar, n integer)[]) from se where len(t) > 0 union all
  select doc_id, idx, t, k + 1, case when op and length(t[k]) <= 46 and length(txt || ' ' || t[k]) <= 110 then txt || ' ' || t[k] else t[k] end, case when op and length(t[k]) <= 46 and length(txt || ' ' || t[k]) <= 110 then n + 1 else 1 end,
  length(t[k]) <= 46, case when op and length(t[k]) <= 46 and length(txt || ' ' || t[k]) <= 110 then outs else list_append(outs, {{'text': txt, 'n': n}}) end from br where k <= len(t)),
gr as (select doc_id, idx, list_append(outs, {{'text': txt, 'n': n}}) as g from br where k = len(t) + 1),
un as (select doc_id, idx, len(g) = 1 and g[1].n <= 2 and length(g[1].text) <= 60 as beat, len(g) as n_groups, generate_subscripts(g, 1) - 1 as pos, unnest(g) as u from gr)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    pair = F.floor(F.col("idx") / 2).alias("idx")
    return bare_lines(spark, d).groupBy("doc_id", pair).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), "text"))), lambda x: x["text"]), " ").alias("text"))


@query(f"with recursive {LINES}, {_BREATHS} select doc_id, idx, pos, u.text as text, u.n as n from un")
def breaths(spark: SparkSession, d: str) -> DataFrame:
    """Runs of short sentences of one paragraph, joined."""
    rows = _blocks(spark, d).select("doc_id", "idx", F.posexplode(narration.breaths(T.sentences(F.col("text")))).alias("pos", "u"))
    return rows.select("doc_id", "idx", "pos", "u.text", "u.n")


@query(f"""with {LINES} select doc_id, idx, case right(rtrim(text), 1) when '?' then b + 150 when ':' then greatest(b, 500) else b end as pause from (select *, case when idx % 3 = 0 then 700 else 350 end as b from l)""")
def pause_rule(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", narration.base_pause(F.col("text"), F.col("idx") % 3 == 0).alias("pause"))


_UNITS = _BREATHS + """,
ro as (select *, case when beat then 'beat' when u.n > 1 then 'run' else 'line' end as role, lead(beat) over w as nb, row_number() over w - 1 as place,
  case when beat then 1100 else case right(rtrim(u.text), 1) when '?' then case when pos = n_groups - 1 then 850 else 500 end when ':' then case when pos = n_groups - 1 then 700 else 500 end else case when pos = n_groups - 1 then 700 else 350 end end end as after
  from un window w as (partition by doc_id order by idx, pos))"""


@query(f"""with recursive {LINES}, {_UNITS} select doc_id, place, u.text as text, role, case role when 'beat' then 92 when 'run' then 106 else 100 end as speed,
  case when nb is null then 0 when nb then greatest(after, 900) else after end as pause from ro""")
def narration_units(spark: SparkSession, d: str) -> DataFrame:
    return narration.units(_blocks(spark, d), "doc_id")


@query(f"""with recursive {LINES}, {_UNITS} select doc_id, place, case when role = 'beat' then 'punch' when role = 'run' or place % 10 >= 7 then 'drive' else 'carry' end as intent from ro""")
def unit_intents(spark: SparkSession, d: str) -> DataFrame:
    rows = narration.units(_blocks(spark, d), "doc_id")
    return rows.select("doc_id", "place", narration.intent_of_role(F.col("role"), F.col("place") % 10 * 10).alias("intent"))


_HEARD = f"""w as (select doc_id, {words("replace(text, chr(10), ' ')")} as w from documents), h0 as (select doc_id, generate_subscripts(w, 1) - 1 as word, length(unnest(w)) * 50 as n from w),
h1 as (select *, (sum(n) over (partition by doc_id order by word))::bigint as stop from h0), h as (select doc_id, word, stop - n as start, stop from h1 where word % 7 <> 3 and (word // 20) % 4 <> 2),
c as (select doc_id, word // 6 as chunk, min(word) as first, max(word) as last from h1 group by all)"""


@query(f"""with {_HEARD}, f as (select c.doc_id, chunk, min(start) as a, max(stop) as b from c left join h on h.doc_id = c.doc_id and word between first and last group by all),
g as (select *, coalesce(a, last_value(b ignore nulls) over (partition by doc_id order by chunk rows between unbounded preceding and 1 preceding), 0) as a2, first_value(a ignore nulls) over (partition by doc_id order by chunk rows between 1 following and unbounded following) as na from f),
k as (select *, coalesce(b, na, a2) as b2, max(a2) over (partition by doc_id order by chunk rows between unbounded preceding and current row) as start from g),
m as (select *, coalesce(lead(start) over (partition by doc_id order by chunk), greatest(start, b2)) as til from k)
select doc_id, chunk, start, greatest(start, least(til, greatest(start, b2) + 1200)) as stop from m""")
def anchored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of six words on the words that were heard; every seventh and whole stretches were not."""
    each = table(spark, d, "documents").select("doc_id", F.posexplode(T.words(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("word", "w"))
    stop = F.sum(F.length("w") * 50).over(Window.partitionBy("doc_id").orderBy("word").rowsBetween(Window.unboundedPreceding, 0))
    placed = each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("w") * 50)
    chunks = each.groupBy("doc_id", F.floor(F.col("word") / 6).alias("chunk")).agg(F.min("word").alias("first"), F.max("word").alias("last"))
    heard = placed.where("word % 7 <> 3 and floor(word / 20) % 4 <> 2").select("doc_id", "word", "start", "stop")
    return narration.anchored(chunks, heard, "doc_id")


_PARTS = "list_filter(list_transform(string_split_regex(text, '[,;:]\\s+'), lambda x: trim(x)), lambda x: x <> '')"
_FRAG = f"""fp as (select doc_id, idx, {_PARTS} as p from l), fr as (select doc_id, idx, case when len(p) <= 2 then p else list_append(p[1:1], array_to_string(p[2:], ', ')) end as f from fp)"""


@query(f"with {LINES}, {_FRAG} select doc_id, idx, generate_subscripts(f, 1) - 1 as part, unnest(f) as fragment from fr")
def chain_fragments(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", F.posexplode(narration.fragments(F.col("text"), 2)).alias("part", "fragment"))


@query(f"""with {LINES}, c as (select doc_id, idx, {content('text')} as c from l), k as (select doc_id, idx, list_filter(c, lambda x, i: list_position(c, x) = i)[1:2] as b from c)
select doc_id, idx, array_to_string(b, '/') as blocks from k where len(b) > 0""")
def fragment_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = bare_lines(spark, d).select("doc_id", "idx", F.array_join(narration.blocks_of(F.col("text")), "/").alias("blocks"))
    return rows.where("blocks is not null")


@query("""with s as (select event_id, (event_id % 5 + 1)::int as n, floor(value * 10)::bigint as stop from events), f as (select *, greatest(least(n, stop // 400), 1)::int as fit from s), k as (select *, unnest(range(fit)) as k from f)
select event_id, k as part, stop * k // fit as start, stop * (k + 1) // fit as stop from k""")
def equal_windows(spark: SparkSession, d: str) -> DataFrame:
    """Fragments own equal slices of their sentence's window."""
    slices = narration.equal_windows((F.col("event_id") % 5 + 1).cast("int"), F.lit(0).cast("long"), F.floor(F.col("value") * 10).cast("long"), 400)
    return table(spark, d, "events").select("event_id", F.posexplode(slices).alias("part", "x")).select("event_id", "part", "x.*")


QUERIES, ORACLES = query.queries, query.oracles
