"""Queries of shot planning. Scenes are users, shots their events in order of id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as T
from spanforge.operators import alloc, planning, shots
from spanforge.plans.binding import LINES, Plans, content, listed, tokens, words
from spanforge.sources.catalog import bare_lines, lines, table

query = Plans()
SHOTS = """s as (select user_id as scene_id, event_id as shot_id, row_number() over (partition by user_id order by event_id) - 1 as idx, event_type as type,
  floor(value * 1000)::bigint as ms, 'a' || (event_id % 97) as asset_id from events)"""


def _shots(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    asset = F.concat(F.lit("a"), (F.col("event_id") % 97).cast("string"))
    return table(spark, d, "events").select(F.col("user_id").alias("scene_id"), F.col("event_id").alias("shot_id"), place.alias("idx"), F.col("event_type").alias("type"), F.floor(F.col("value") * 1000).cast("long").alias("ms"), asset.alias("asset_id"))


@query(f"""with {SHOTS} select asset_id, arg_min(type, shot_id) as query, arg_min(type, shot_id) as type, max(ms)::double + 0.5 as needed_s, md5(string_agg(shot_id::varchar, ',' order by shot_id)) as used_by,
  case when count(distinct type) > 1 then 'mixed types' end as issue from s group by 1""")
def asset_requirements(spark: SparkSession, d: str) -> DataFrame:
    given = _shots(spark, d).select("asset_id", F.col("shot_id").alias("idx"), "shot_id", "type", F.col("type").alias("query"), F.col("ms").cast("double").alias("seconds"))
    found = planning.asset_requirements(given)
    return found.select("asset_id", "query", "type", "needed_s", F.md5(F.array_join(F.transform("used_by", lambda x: x.cast("string")), ",")).alias("used_by"), "issue")


@query(f"""with {SHOTS}, b as (select 'a' || k as asset_id, '/media/' || (k % 10) as path from range(80) r(k))
select shot_id, path, case when path is not null then coalesce(sum(ms::double) over (partition by path order by shot_id rows between unbounded preceding and 1 preceding), 0) end as "offset", case when path is null then 'unbound asset' end as issue
from s left join b using (asset_id)""")
def bound_clips(spark: SparkSession, d: str) -> DataFrame:
    bindings = spark.range(80).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("asset_id"), F.concat(F.lit("/media/"), (F.col("id") % 10).cast("string")).alias("path"))
    given = _shots(spark, d).select("asset_id", "shot_id", F.col("shot_id").alias("idx"), F.col("ms").cast("double").alias("seconds"))
    return planning.bound_clips(given, bindings).select("shot_id", "path", "offset", "issue")


@query(f"""with {SHOTS} select shot_id, lag(type) over w as prev_type, lead(type) over w as next_type, case when count(*) over (partition by scene_id) > 1 then round(idx / (count(*) over (partition by scene_id) - 1), 6) else 0 end as position
from s window w as (partition by scene_id order by idx)""")
def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    return planning.with_neighbours(_shots(spark, d), "scene_id", "idx", "type").select("shot_id", "prev_type", "next_type", F.round("position", 6).alias("position"))


@query(f"""with d as (select doc_id, {tokens('text')} as a from documents), p as (select x.doc_id, x.a, y.a as b from d x join d y on y.doc_id = x.doc_id + 1),
k as (select doc_id, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) as i, greatest(len(a), len(b)) as n from p)
select doc_id, round(count(*) filter (a[i] = b[i]) / max(n), 6) as alignment from k group by 1""")
def positional_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Each text with the one of the next id, place by place."""
    texts = table(spark, d, "documents").select("doc_id", T.token_lines(F.col("text")).alias("tokens"))
    return planning.alignment_with_next(texts, "doc_id").select("doc_id", F.round("alignment", 6).alias("alignment"))


_SELF = ("rights reserved", "of the", "license")
_BAG = f"list_filter({tokens('text')}, lambda b: length(b) > 1 and not list_contains({listed(T.STOPWORDS)}, b))"


@query(f"""with {LINES}, t as (select doc_id, idx, ' ' || array_to_string({tokens('text')}, ' ') || ' ' as t, len({_BAG}) as n from l)
select doc_id, idx, case when n <= 6 then 'CUT' else 'REVIEW' end as suggestion from t where {' or '.join(f"contains(t, ' {p} ')" for p in _SELF)}""")
def self_commentary(spark: SparkSession, d: str) -> DataFrame:
    return planning.self_commentary(bare_lines(spark, d), list(_SELF)).select("doc_id", "idx", "suggestion")


@query(f"""with {LINES}, t as (select doc_id, idx, text, {_BAG} as bag, regexp_matches(lower(ltrim(text)), '^(the|for) ') as restart from l),
n as (select *, lead(restart) over w as nr, lead(bag) over w as nb from t window w as (partition by doc_id order by idx)),
y as (select doc_id, idx, case when restart then 'restart' when nr then 'before a restart' when len(bag) <= 5 and not regexp_matches(text, '[.!?…]\\s*$') and nb is not null and not list_has_any(bag, nb) then 'fragment' end as why from n)
select doc_id, idx, why from y where why is not null""")
def failed_takes(spark: SparkSession, d: str) -> DataFrame:
    return planning.failed_takes(bare_lines(spark, d), "doc_id", "idx", ["the ", "for "]).select("doc_id", "idx", "why")


@query(f"""with {SHOTS} select shot_id, concat_ws(',', case when ms < 20000 then 'pan:too short' when type = 'view' then 'pan:view' end, case when ms > 300000 then 'zoom:too long' end) as blocked from s""")
def gated_options(spark: SparkSession, d: str) -> DataFrame:
    """Blocked moves with their first reason."""
    rules = {"pan": [(F.col("ms") < 20_000, "too short"), (F.col("type") == "view", "view")], "zoom": [(F.col("ms") > 300_000, "too long")]}
    entries = F.transform(F.map_entries(planning.gates(rules)), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return _shots(spark, d).select("shot_id", F.array_join(entries, ",").alias("blocked"))


@query(f"with {SHOTS} select shot_id, 0.25::double * ms >= 20000 as viable from s")
def viable_states(spark: SparkSession, d: str) -> DataFrame:
    """Does every state of a three-part treatment last its minimum."""
    return _shots(spark, d).select("shot_id", planning.viable(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25)), F.col("ms"), F.lit(20_000)).alias("viable"))


@query("""with o as (select doc_id as sequence, chr((65 + doc_id % 3)::int) as option, 'p' || doc_id as path from documents), a as (select doc_id as sequence, case quality when 1 then 'A' else 'PENDING' end as choice from labels),
g as (select 'p' || doc_id as path, md5(text) as digest from documents where doc_id % 7 <> 0)
select o.sequence, option, o.path, choice, digest, case when choice is null then 'no answer' when choice = 'PENDING' then 'pending' when digest is null then 'file missing' end as issue
from o left join a on a.sequence = o.sequence left join g on g.path = o.path where choice is null or length(choice) <> 1 or choice = option""")
def locked_options(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("p"), F.col("doc_id").cast("string"))
    decisions = docs.select(F.col("doc_id").alias("sequence"), F.char(F.lit(65) + F.col("doc_id") % 3).alias("option"), path.alias("path"))
    answers = table(spark, d, "labels").select(F.col("doc_id").alias("sequence"), F.when(F.col("quality") == 1, "A").otherwise("PENDING").alias("choice"))
    digests = docs.where("doc_id % 7 <> 0").select(path.alias("path"), F.md5("text").alias("digest"))
    return planning.locked(decisions, answers, digests)


@query(f"""with {SHOTS}, t as (select scene_id, sum(ms) as filled from s where type <> 'signup' group by 1), e as (select scene_id, sum(ms) as wanted, scene_id % 5 as k from s group by 1)
select e.scene_id, case when filled is null then 'no shots' else 'sum differs' end as issue from e left join t using (scene_id) where filled is null or filled <> wanted""")
def scene_sums(spark: SparkSession, d: str) -> DataFrame:
    """Scenes whose shots without one kind don't add up to them."""
    rows = _shots(spark, d)
    scenes = rows.groupBy("scene_id").agg(F.sum("ms").alias("seconds"))
    return planning.scene_issues(scenes, rows.where("type <> 'signup'").select("scene_id", F.col("ms").alias("seconds")))


@query(f"""with {SHOTS}, m as (select scene_id, asset_id, idx, idx - lag(idx) over (partition by scene_id, asset_id order by idx) as apart, count(*) over (partition by scene_id, asset_id) as uses from s)
select scene_id as plan, asset_id, idx, case when uses > 3 then 'used too often' else 'again too soon' end as issue from m where uses > 3 or apart < 30""")
def reuse_distance(spark: SparkSession, d: str) -> DataFrame:
    return planning.reuse_issues(_shots(spark, d).withColumnRenamed("scene_id", "plan"), 3, 30)


@query(f"with {SHOTS} select shot_id, (['left', 'right', 'center'])[idx % 3 + 1] as option from s")
def rotated_options(spark: SparkSession, d: str) -> DataFrame:
    return planning.rotated(_shots(spark, d), "scene_id", "idx", F.array(*map(F.lit, ("left", "right", "center")))).select("shot_id", "option")


_WANTED = {"law": ["license", "rights", "reserved"], "small": ["of", "in", "de"]}


@query(f"""with {LINES}, t as (select doc_id, idx, {tokens('text')} as t from l)
select doc_id, idx, least(1.0, len(list_intersect({listed(_WANTED['law'])}, t)) / 2) as law, least(1.0, len(list_intersect({listed(_WANTED['small'])}, t)) / 2) as small from t""")
def affinity_scores(spark: SparkSession, d: str) -> DataFrame:
    found = bare_lines(spark, d).select("doc_id", "idx", planning.affinities(T.tokens(F.col("text")), _WANTED).alias("a"))
    return found.select("doc_id", "idx", F.col("a.law").alias("law"), F.col("a.small").alias("small"))


@query(f"""with {LINES}, t as (select doc_id, idx, {tokens('text')} as t, list_distinct({tokens('lag(text) over (partition by doc_id order by idx)')}) as b from l)
select doc_id, idx, round(case when len(b) > 0 then len(list_intersect(b, t)) / len(b) end, 6) as again from t""")
def signal_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of the line before that a line says again; unknown where there is none."""
    before = F.lag("text").over(Window.partitionBy("doc_id").orderBy("idx"))
    rows = bare_lines(spark, d).withColumn("b", F.array_distinct(F.coalesce(T.tokens(before), F.expr("cast(array() as array<string>)"))))
    return rows.select("doc_id", "idx", F.round(planning.signals(T.tokens(F.col("text")), {"again": F.col("b")})["again"], 6).alias("again"))


@query(f"""with {SHOTS}, z as (select shot_id, (['top', 'bottom', 'left'])[shot_id % 3 + 1] as zone from s where type = 'purchase'), u as (select 'a' || k as asset_id, k % 11 / 10 as luma from range(60) r(k))
select s.shot_id, s.asset_id, zone, round(luma, 6) as luma, zone is not null as emphasis from s left join z using (shot_id) left join u on u.asset_id = s.asset_id""")
def direction_inputs(spark: SparkSession, d: str) -> DataFrame:
    rows = _shots(spark, d)
    zone = F.get(F.array(*map(F.lit, ("top", "bottom", "left"))), (F.col("shot_id") % 3).cast("int"))
    events = rows.where("type = 'purchase'").select("shot_id", zone.alias("zone"), F.col("idx").alias("at"))
    luma = spark.range(60).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("asset_id"), F.round(F.col("id") % 11 / 10, 6).alias("luma"))
    return shots.direction_inputs(rows, events, luma).select("shot_id", "asset_id", "zone", "luma", "emphasis")


_CUTS = """c as (select scene_id, list(cut order by cut) as o, 3600000 as length from (select distinct scene_id, ms * 7 % 3600000 as cut from s) group by 1),
f(scene_id, o, length, k, cuts) as (select scene_id, o, length, 1, [0::bigint] from c union all select scene_id, o, length, k + 1,
  case when greatest(o[k], cuts[len(cuts)] + 60000) < length - 60000 then list_append(cuts, greatest(o[k], cuts[len(cuts)] + 60000)) else cuts end from f where k <= len(o)),
b as (select scene_id, list_append(cuts, length) as b from f where k = len(o) + 1), g as (select scene_id, unnest(range(1, len(b))) as i, b from b),
seg as (select scene_id, i - 1 as segment, b[i] as start, b[i + 1] as stop, i > 1 as on_beat from g)"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    offsets = _shots(spark, d).groupBy("scene_id").agg(F.array_sort(F.collect_set(F.col("ms") * 7 % 3_600_000)).alias("o"))
    cut = offsets.select("scene_id", F.posexplode(shots.emphasis_segments(F.col("o"), F.lit(3_600_000).cast("long"), 60_000)).alias("segment", "x"))
    return cut.select("scene_id", "segment", "x.*")


@query(f"with recursive {SHOTS}, {_CUTS} select scene_id, segment, start, stop, on_beat from seg")
def emphasis_segments(spark: SparkSession, d: str) -> DataFrame:
    """An hour cut at each scene's emphasis offsets, a minute apart at least."""
    return _segments(spark, d)


@query(f"""with recursive {SHOTS}, {_CUTS}, n as (select *, greatest(least(round((stop - start) / 40000), (stop - start) // 15000), ceil((stop - start) / 80000), 1)::int as n from seg), k as (select *, unnest(range(n)) as k from n)
select scene_id, segment, k, start + (stop - start) * k // n as start, start + (stop - start) * (k + 1) // n as stop, on_beat and k = 0 as on_beat from k""")
def shot_layout(spark: SparkSession, d: str) -> DataFrame:
    return shots.shot_rows(_segments(spark, d), ["scene_id", "segment"], 40_000, 15_000, 80_000)


@query(f"with {SHOTS} select shot_id, (['wide', 'medium', 'close', 'detail'])[(idx + scene_id % 4) % 4 + 1] as scale from s")
def cyclic_scales(spark: SparkSession, d: str) -> DataFrame:
    return shots.cyclic_scales(_shots(spark, d), "scene_id", ["idx"], ("wide", "medium", "close", "detail")).select("shot_id", "scale")


@query(f"with {SHOTS} select shot_id, case type when 'view' then 'video' when 'click' then 'image' when 'purchase' then 'image' else 'card' end as medium, case type when 'purchase' then 'contain' else 'cover' end as fit from s")
def media_and_fits(spark: SparkSession, d: str) -> DataFrame:
    return _shots(spark, d).select("shot_id", shots.medium_of(F.col("type")).alias("medium"), shots.fit_of(F.col("type")).alias("fit"))


@query(f"""with {SHOTS}, m as (select shot_id, (['wide', 'medium', 'close', 'detail'])[idx % 4 + 1] as scale, ms as u from s)
select shot_id, case scale when 'wide' then 'zoom_in' when 'medium' then 'pan_' || case when u % 2 = 0 then 'left' else 'right' end when 'close' then 'zoom_out' end as motion,
  case scale when 'medium' then case when u % 2 = 0 then 'left' else 'right' end when 'detail' then (['top', 'bottom', 'left', 'right'])[u % 4 + 1] else 'center' end as bias from m""")
def scale_motions(spark: SparkSession, d: str) -> DataFrame:
    scale = F.get(F.array(*map(F.lit, ("wide", "medium", "close", "detail"))), F.col("idx") % 4)
    return _shots(spark, d).select("shot_id", shots.motion_of(scale, F.col("ms")).alias("m")).select("shot_id", "m.*")


@query(f"with {SHOTS} select shot_id, concat_ws(',', 'type=' || type, case when ms > 100000 then 'long=' || ms end) as parameters from s")
def parameter_maps(spark: SparkSession, d: str) -> DataFrame:
    found = shots.parameter_map(type=F.col("type"), long=F.when(F.col("ms") > 100_000, F.col("ms")))
    entries = F.transform(F.map_entries(found), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _shots(spark, d).select("shot_id", F.array_join(entries, ",").alias("parameters"))


@query(f"""with {SHOTS}, f as (select *, first(type) over (partition by scene_id, asset_id order by idx) as ft, first(shot_id) over (partition by scene_id, asset_id, type order by idx) as fs from s)
select shot_id, case when type = ft then asset_id else 'asset-' || fs || '-own' end as asset_id from f""")
def regrouped_assets(spark: SparkSession, d: str) -> DataFrame:
    return shots.regrouped(_shots(spark, d), "scene_id").select("shot_id", "asset_id")


@query(f"""with {LINES}, p as (select *, (sum(length(text)) over (partition by doc_id order by idx))::bigint - length(text) as start from l),
r as (select doc_id, start, length(text) % 10 as importance from p), e as (select doc_id, start // 200 as sentence, importance from r)
select doc_id, sentence, max(importance)::int as importance, count(*) as covered from e group by all""")
def inherited_importance(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of 200 ms take the largest importance of the lines that begin in them."""
    rows = lines(spark, d).select("doc_id", "start", (F.length("text") % 10).alias("importance"))
    found = rows.select("doc_id", F.floor(F.col("start") / 200).alias("sentence")).distinct().select("doc_id", "sentence", (F.col("sentence") * 200).alias("start"), (F.col("sentence") * 200 + 200).alias("stop"))
    return shots.inherited(found, rows, "doc_id")


@query(f"""with {SHOTS} select shot_id, scene_id, unnest(case type when 'view' then [('hold', 100)] when 'click' then [('enter', 30), ('hold', 70)] when 'purchase' then [('enter', 25), ('hold', 50), ('leave', 25)] else [('cut', 100)] end) as x from s""".replace("select shot_id, scene_id, unnest", "select shot_id, x[1] as state, x[2]::int as share from (select shot_id, unnest") + ")")
def state_lists(spark: SparkSession, d: str) -> DataFrame:
    return _shots(spark, d).select("shot_id", F.explode(shots.states_of(F.col("type"))).alias("x")).select("shot_id", "x.state", "x.share")


@query(f"""with {SHOTS}, t as (select shot_id, (['enter', 'hold', 'leave'])[idx % 3 + 1] as state, case type when 'view' then 'video' when 'click' then 'image' when 'purchase' then 'image' else 'card' end as medium, type = 'purchase' as keep from s)
select shot_id, case when keep then 'full' when state = 'enter' and medium = 'image' then 'close' else 'wide' end as composition,
  case when keep or medium = 'card' then 'still' when state = 'enter' then 'push_in' when state = 'leave' then 'pull_out' else 'drift' end as motion from t""")
def state_overrides(spark: SparkSession, d: str) -> DataFrame:
    state = F.get(F.array(*map(F.lit, ("enter", "hold", "leave"))), F.col("idx") % 3)
    look = shots.state_look(state, F.lit("wide"), shots.medium_of(F.col("type")), F.col("type") == "purchase")
    return _shots(spark, d).select("shot_id", look.alias("x")).select("shot_id", "x.*")


@query(f"""with recursive {SHOTS}, r(scene_id, idx, choice, a, b) as (select scene_id, -1::bigint, '', '', '' from (select distinct scene_id from s)
  union all select r.scene_id, r.idx + 1, x.choice, r.b, x.choice from r join s on s.scene_id = r.scene_id and s.idx = r.idx + 1,
  lateral (select list_filter(list_transform(range(4), lambda k: (['up', 'down', 'in', 'out'])[(s.idx + k) % 4 + 1]), lambda o: o <> r.a and o <> r.b)[1] as choice) x)
select scene_id, idx, choice from r where idx >= 0""")
def choices_avoiding_last(spark: SparkSession, d: str) -> DataFrame:
    return shots.avoiding_last(_shots(spark, d), "scene_id", "idx", ("up", "down", "in", "out"))


@query(f"""with {SHOTS} select scene_id, count(*) as shots, count(distinct asset_id) as assets, sum(ms)::bigint as ms, count(*) filter (type = 'view') as views, arg_min(shot_id, idx) as first_shot from s group by 1""")
def plan_counters(spark: SparkSession, d: str) -> DataFrame:
    found = _shots(spark, d).groupBy("scene_id")
    return found.agg(F.count("*").alias("shots"), F.countDistinct("asset_id").alias("assets"), F.sum("ms").alias("ms"), F.count_if(F.col("type") == "view").alias("views"), F.min_by("shot_id", "idx").alias("first_shot"))


@query(f"""with {SHOTS} select scene_id, md5(string_agg(asset_id || '=' || type, ',' order by asset_id)) as bindings from (select scene_id, asset_id, arg_min(type, idx) as type from s group by all) group by 1""")
def binding_maps(spark: SparkSession, d: str) -> DataFrame:
    """Asset to the type of its first shot, as one map a scene."""
    first = _shots(spark, d).groupBy("scene_id", "asset_id").agg(F.min_by("type", "idx").alias("type"))
    found = first.groupBy("scene_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset_id", "type")))).alias("m"))
    return found.select("scene_id", F.md5(F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")).alias("bindings"))


@query(f"""with {LINES}, t as (select doc_id, {content('text')} as c from l), u as (select distinct doc_id, unnest(c) as x from t) select doc_id, count(*) as n_terms, md5(string_agg(x, ',' order by x)) as digest from u group by 1""")
def term_unions(spark: SparkSession, d: str) -> DataFrame:
    """Union of the term sets of a document's lines."""
    every = bare_lines(spark, d).select("doc_id", F.explode(T.content_terms(F.col("text"))).alias("x")).distinct()
    return every.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.md5(F.array_join(F.array_sort(F.collect_list("x")), ",")).alias("digest"))


@query(f"""with {LINES}, w as (select doc_id, idx, {words('text')} as w from l), k as (select doc_id, idx, generate_subscripts(w, 1) as pos, length(unnest(w)) as n from w),
r as (select *, sum(n) over (partition by doc_id, idx order by pos) as upto, sum(n) over (partition by doc_id, idx) as total from k)
select doc_id, idx, (pos - 1)::int as pos, ((upto - n) * 1000 // total)::bigint as start, (upto * 1000 // total)::bigint as stop from r""")
def words_over_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each word's place in its line's second."""
    rows = bare_lines(spark, d).select(F.struct("doc_id", "idx").alias("cue"), "text")
    found = alloc.words_over_cue(rows, "cue", F.col("text"), 1_000)
    return found.select("cue.doc_id", "cue.idx", "pos", "start", "stop")


QUERIES, ORACLES = query.queries, query.oracles
