"""Queries of readers, sinks and record checks, on records made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from spanforge.operators import integrity, records
from spanforge.plans import grammar
from spanforge.plans.binding import LINES, Plans
from spanforge.sources import readers, sinks
from spanforge.sources.catalog import bare_lines, table

query = Plans()


@query("""with b as (select doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\\n[ \\t]*\\n\\s*'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as b from documents)
select doc_id, generate_subscripts(b, 1) - 1 as idx, unnest(b) as text from b""")
def script_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of texts whose lines are parted by blank ones."""
    files = table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.replace("text", F.lit("\n"), F.lit("\n \n")).alias("content"))
    return readers.script_blocks(files).withColumnRenamed("path", "doc_id")


_CUES = """cu as (select conv_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as idx, trim(regexp_replace(replace(text, '<', ''), '\\s+', ' ', 'g')) as text from conversations),
ct as (select conv_id, idx, idx * 2345 as start, idx * 2345 + 1500 as stop, text from cu where text <> '')"""


def _cues(spark: SparkSession, d: str) -> DataFrame:
    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    text = F.trim(F.regexp_replace(F.replace("text", F.lit("<"), F.lit("")), r"\s+", " "))
    rows = table(spark, d, "conversations").select("conv_id", idx.alias("idx"), text.alias("text")).where("text <> ''")
    return rows.select("conv_id", "idx", (F.col("idx") * 2345).alias("start"), (F.col("idx") * 2345 + 1500).alias("stop"), "text")


@query(f"with {_CUES} select conv_id, row_number() over (partition by conv_id order by idx) - 1 as idx, start, stop, text from ct")
def subtitle_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Cues written as SubRip and read again are the same cues."""
    files = sinks.subrip(_cues(spark, d), "conv_id").select(F.col("conv_id").cast("string").alias("path"), "content")
    found = readers.subtitle_cues(files).where("issue is null")
    return found.select(F.col("path").cast("long").alias("conv_id"), "idx", "start", "stop", "text")


@query(f"""with {_CUES}, o as (select conv_id, idx, start, stop + case when idx % 3 = 0 then 900 else 0 end as stop, text, lag(stop + case when idx % 3 = 1 then 900 else 0 end) over (partition by conv_id order by idx) as before from ct),
p as (select conv_id, idx, start, lag(stop) over (partition by conv_id order by idx) as before, text from o)
select conv_id::varchar as path, idx, case when before > start then 'overlap' when length(text) > 160 then 'too long' end as issue from p where before > start or length(text) > 160""")
def cue_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = _cues(spark, d).withColumn("stop", F.col("stop") + F.when(F.col("idx") % 3 == 0, 900).otherwise(0))
    given = rows.select(F.col("conv_id").cast("string").alias("path"), "idx", "start", "stop", "text", F.lit(None).cast("string").alias("issue"))
    return readers.cue_issues(given).select("path", "idx", "issue")


_PATHS = """pa as (select page_id, '/m/' || page_id || (['.jpg', '.mp4', '.txt', '.WAV'])[page_id % 4 + 1] as path from pages)"""


@query(f"""with {_PATHS}, t as (select *, case page_id % 4 when 0 then 'image' when 1 then 'video' when 3 then 'audio' end as media_type from pa)
select path, media_type, case when page_id % 3 = 0 then 'short ' || page_id when page_id % 5 = 0 then 'long ' || page_id end as sidecar from t where media_type is not null""")
def media_catalogue(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "pages").select("page_id")
    path = F.concat(F.lit("/m/"), F.col("page_id").cast("string"), F.get(F.array(*map(F.lit, (".jpg", ".mp4", ".txt", ".WAV"))), (F.col("page_id") % 4).cast("int")))
    side = lambda test, name, label: ids.where(test).select(name.alias("path"), F.concat(F.lit(label), F.col("page_id").cast("string")).alias("content"))
    short = side("page_id % 3 = 0", F.concat(F.lit("/m/"), F.col("page_id").cast("string"), F.lit(".json")), "short ")
    long = side("page_id % 5 = 0", F.concat(path, F.lit(".json")), "long ")
    return readers.catalogue(ids.select(path.alias("path")), short.unionByName(long))


@query("""with l as (select user_id as source, row_number() over (partition by user_id order by event_id) as idx, event_type, round_even(value, 2) as v from events),
r as (select source, idx, case when event_type = 'view' then v end as start, lead(case when event_type = 'click' then v end) over (partition by source order by idx) as stop from l)
select source, start, stop from r where start is not null and stop is not null""")
def silence_pairs(spark: SparkSession, d: str) -> DataFrame:
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("[x] silence_start: "), F.bround("value", 2).cast("string"))).when(F.col("event_type") == "click", F.concat(F.lit("silence_end: "), F.bround("value", 2).cast("string"), F.lit(" | silence_duration: 1"))).otherwise("frame")
    return readers.silence_spans(table(spark, d, "events").select(F.col("user_id").alias("source"), idx.alias("idx"), line.alias("line")))


@query("""with p as (select p_partkey, p_size * 10 as a, p_partkey % 50 * 10 as b from part)
select 'q' || p_partkey as query, 'shop:' || p_partkey as candidate_id, 't' as title, 'u' as author, case when a >= b then 'small' else 'large' end as url, greatest(a, b)::int as width, 240 as height,
  case when greatest(a, b) > 240 then 'landscape' when greatest(a, b) < 240 then 'portrait' else 'square' end as orientation from p""")
def remote_widest(spark: SparkSession, d: str) -> DataFrame:
    """The widest rendition of each hit of a recorded answer, the first on ties."""
    one = '{"url":"%s","width":%d,"height":240}'
    form = '{"hits":[{"id":%d,"title":"t","author":"u","renditions":[' + one + "," + one + "]}]}"
    payload = F.format_string(form, "p_partkey", F.lit("small"), F.col("p_size") * 10, F.lit("large"), F.col("p_partkey") % 50 * 10)
    return readers.remote_hits(table(spark, d, "part").select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("query"), payload.alias("payload")), "shop")


@query("""with u as (select doc_id % 400 as id, 'en' as source_kind, 0 as rank, doc_id from documents where lang = 'en' union all select doc_id % 400, 'fr', 1, doc_id from documents where lang = 'fr'),
n as (select *, row_number() over (partition by id order by rank, doc_id) as n from u) select id, source_kind, doc_id from n where n = 1""")
def provider_union(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the readers that are there, the first provider's row of each id."""
    docs = table(spark, d, "documents")
    read = lambda lang, rank: lambda: docs.where(F.col("lang") == lang).select((F.col("doc_id") % 400).alias("id"), "doc_id", F.lit(rank).alias("rank"))
    found = readers.providers(["en", "none", "fr"], {"en": read("en", 0), "none": None, "fr": read("fr", 1)})
    return readers.first_of_each(found, "id", ["rank", "doc_id"]).select("id", "source_kind", "doc_id")


_REV = """r as (select user_id, event_id, floor(value * 1000)::bigint as start, floor(value * 1000)::bigint + 500 as stop, upper(event_type) as suggestion, case when event_id % 5 = 0 then 'a|b' else 'c' end as reasons from events)"""


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    start = F.floor(F.col("value") * 1000).cast("long")
    reasons = F.when(F.col("event_id") % 5 == 0, "a|b").otherwise("c")
    return table(spark, d, "events").select("user_id", "event_id", start.alias("start"), (start + 500).alias("stop"), F.upper("event_type").alias("suggestion"), reasons.alias("reasons"))


_CLK = "printf('%02d:%02d.%03d', {0} // 60000, {0} // 1000 % 60, {0} % 1000)"


@query(f"""with {_REV}, k as (select user_id, start, stop, '| ' || {_CLK.format('start')} || ' | ' || {_CLK.format('stop')} || ' | ' || suggestion || ' | ' || replace(reasons, '|', '/') || ' |' as line from r)
select user_id, md5('# Review' || chr(10) || chr(10) || '| from | to | suggestion | reasons |' || chr(10) || '|-|-|-|-|' || chr(10) || string_agg(line, chr(10) order by start, stop, line)) as digest from k group by 1""")
def markdown_report(spark: SparkSession, d: str) -> DataFrame:
    return sinks.markdown(_reviewed(spark, d), "user_id", "Review").select("user_id", F.md5("content").alias("digest"))


@query(f"""with {_REV} select user_id, md5('<!doctype html>' || chr(10) || '<title>Sheet</title>' || chr(10) || '<table>' || chr(10) || string_agg('<tr><td>' || event_id || '</td><td>' || suggestion || ' &lt;x&gt;' || '</td><td>' || reasons || '</td></tr>', chr(10) order by event_id) || chr(10) || '</table>' || chr(10)) as digest from r group by 1""")
def html_sheet(spark: SparkSession, d: str) -> DataFrame:
    rows = _reviewed(spark, d).select("user_id", F.col("event_id").alias("place"), F.concat("suggestion", F.lit(" <x>")).alias("name"), F.col("reasons").alias("state"))
    return records.html_sheet(rows, "user_id", "Sheet").select("user_id", F.md5("content").alias("digest"))


@query(f"""with {_REV} select user_id, md5('{{"operation_id":"op","kind":"review","events":[' || string_agg('{{"start":' || start || ',"suggestion":"' || suggestion || '"}}', ',' order by event_id) || ']}}') as digest from r group by 1""")
def operation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a user as one operation of a plan."""
    found = sinks.operation("review", _reviewed(spark, d), "user_id", "event_id", ["start", "suggestion"], "op")
    return found.select("user_id", F.md5(F.to_json("operation")).alias("digest"))


@query("select event_id, (props::json ->> 'k')::bigint as k, '' as unknown, false as broken from events")
def closed_props(spark: SparkSession, d: str) -> DataFrame:
    """Properties by a closed schema, with the keys it doesn't know."""
    files = table(spark, d, "events").select(F.col("event_id").alias("path"), F.col("props").alias("content"))
    found = readers.closed_json(files, StructType([StructField("k", LongType())]))
    return found.select(F.col("path").alias("event_id"), F.col("doc.k").alias("k"), F.array_join("unknown", ",").alias("unknown"), "broken")


@query("""select event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' || chr(10)) as digest from events""")
def canonical_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.sha2(sinks.canonical_json(["user_id", "event_id", "event_type"]), 256).alias("digest"))


@query("""with b as (select doc_id, md5(text) as m, unnest(range(16)) as i from documents where text is not null)
select doc_id, round(sum(instr('0123456789abcdef', substr(m, 2 * i + 1, 1)) * 16 - 16 + instr('0123456789abcdef', substr(m, 2 * i + 2, 1)) - 1) / 16 / 255, 4) as luma from b group by 1""")
def mean_of_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Mean of sampled bytes on a scale from 0 to 1; the samples are a digest's."""
    byte = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(F.md5("text"), 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(F.aggregate(byte, F.lit(0), lambda a, x: a + x) / 16 / 255, 4).alias("luma"))


@query("select event_id, event_id % 100 + 0.5::double as start, event_id % 100 + 2.0::double as stop from events where event_id % 4 in (0, 1)")
def accepted_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Spans given as an object or a list of two; a list of three and a bare number are none."""
    n = (F.col("event_id") % 100).cast("int")
    entry = (
        F.when(F.col("event_id") % 4 == 0, F.format_string('{"start": %d.5, "end": %d}', n, n + 2)).when(F.col("event_id") % 4 == 1, F.format_string("[%d.5, %d]", n, n + 2))
        .when(F.col("event_id") % 4 == 2, F.format_string("[%d, %d, 9]", n, n + 2)).otherwise(n.cast("string"))
    )
    return table(spark, d, "events").select("event_id", records.pair_of(entry).alias("p")).where("p is not null").select("event_id", "p.*")


@query("""with i as (select l_orderkey, l_returnflag, l_quantity::int as q, l_partkey, l_suppkey, l_linenumber from lineitem)
select l_orderkey, arg_min(q, (l_linenumber, l_partkey, l_suppkey, q)) filter (l_returnflag = 'A') as video, count(*) filter (l_returnflag = 'R') > 0 as audio, abs(sum(q) - 100) <= 20 as fits from i group by 1""")
def stream_checks(spark: SparkSession, d: str) -> DataFrame:
    """Items stand for streams: the first video one, any audio one, and the length within a tolerance."""
    kind = F.when(F.col("l_returnflag") == "A", "video").when(F.col("l_returnflag") == "R", "audio").otherwise("data")
    stream = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), kind.alias("kind"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(stream)).alias("s"), F.sum(F.col("l_quantity").cast("int")).alias("total"))
    return rows.select("l_orderkey", records.first_video(F.col("s"))["q"].alias("video"), records.has_audio(F.col("s")).alias("audio"), records.within(F.col("total"), F.lit(100), 20).alias("fits"))


@query("select l_orderkey, count(*) filter (l_returnflag = 'R') as external, count(*) filter (l_returnflag <> 'N') = 0 as only_real from lineitem group by 1")
def material_counts(spark: SparkSession, d: str) -> DataFrame:
    """Conditional count and all-of over nested rows: options of a decision, each with its assets."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.collect_list("l_returnflag").alias("assets")).groupBy("l_orderkey").agg(F.collect_list("assets").alias("options"))
    every = F.flatten("options")
    return rows.select("l_orderkey", F.size(F.filter(every, lambda a: a == "R")).cast("long").alias("external"), F.forall(every, lambda a: a == "N").alias("only_real"))


@query("""with f as (select l_orderkey, list_sort(list(distinct 's' || l_suppkey)) as s, list_sort(list(distinct 'p' || l_partkey)) as o from lineitem group by 1)
select l_orderkey, sha256('{"outputs":["' || array_to_string(o, '","') || '"],"plan":' || l_orderkey || ',"sources":["' || array_to_string(s, '","') || '"],"tool":"t1"}') as digest from f""")
def lineage_records(spark: SparkSession, d: str) -> DataFrame:
    named = lambda mark, column: F.collect_set(F.concat(F.lit(mark), F.col(column).cast("string")))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(named("s", "l_suppkey").alias("s"), named("p", "l_partkey").alias("p"))
    return rows.select("l_orderkey", records.lineage(F.col("l_orderkey"), F.col("s"), F.col("p"), "t1").alias("l")).select("l_orderkey", "l.digest")


_LAYER = """e as (select user_id, event_id % 200 as id, floor(value)::bigint as start, floor(value)::bigint + event_id % 4 as stop, event_type as mode, event_id from events where event_id % 6 = 0)"""


@query(f"""with {_LAYER}, a as (select user_id, count(*) as n, count(distinct id) as d, bool_or(stop > 480) as outside, bool_or(stop <= start) as empty, bool_or(mode not in ('view', 'click', 'purchase')) as odd from e group by 1),
o as (select user_id, bool_or(start < before) as unordered from (select user_id, start, lag(start) over (partition by user_id order by event_id) as before from e) group by 1)
select user_id, concat_ws(',', case when d < n then 'repeated id' end, case when outside then 'outside the timeline' end, case when empty then 'empty span' end, case when unordered then 'not in order' end, case when odd then 'unknown mode' end) as issues from a join o using (user_id)""")
def layer_checks(spark: SparkSession, d: str) -> DataFrame:
    """Structural checks of a layer's events: ids, order, spans, timeline, modes."""
    event = F.struct("event_id", (F.col("event_id") % 200).alias("id"), F.floor("value").cast("long").alias("start"), (F.floor("value").cast("long") + F.col("event_id") % 4).alias("stop"), F.col("event_type").alias("mode"))
    rows = table(spark, d, "events").where("event_id % 6 = 0").groupBy("user_id").agg(F.array_sort(F.collect_list(event)).alias("e"))
    found = records.event_issues(F.col("e"), F.lit(480), ("view", "click", "purchase"))
    return rows.select("user_id", F.array_join(found, ",").alias("issues"))


@query("""with l as (select 'd' || doc_id as path, md5(coalesce(text, '')) as digest from documents where doc_id % 11 <> 0), f as (select 'd' || doc_id as path, md5(coalesce(text, '') || case when doc_id % 7 = 0 then 'x' else '' end) as digest from documents where doc_id % 13 <> 0)
select coalesce(l.path, f.path) as path, case when f.path is null then 'missing' when l.path is null then 'unlocked' else 'changed' end as state from l full join f on l.path = f.path where f.path is null or l.path is null or l.digest <> f.digest""")
def file_lock(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    lock = docs.where("doc_id % 11 <> 0").select("path", F.md5("text").alias("digest"))
    there = docs.where("doc_id % 13 <> 0").select("path", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("digest"))
    return records.locked_files(lock, there)


@query("""with p as (select event_id, event_id % 5 as n, event_id % 3 as bad from events), k as (select event_id, n, bad, unnest(range(n)) as i from p)
select event_id, i::int as pos, 'c' || i as id, i * 100 as start, i * 100 + 50 as stop from k where not (bad = 1 and i = 0) and not (bad = 2 and i = 1)""")
def layer_cues(spark: SparkSession, d: str) -> DataFrame:
    """Cues read from a layer's JSON parameters; one without text or with an empty span is left out."""
    cue = lambda i: F.concat(F.lit('{"id":"c'), i.cast("string"), F.lit('","text":"'), F.when((F.col("event_id") % 3 == 1) & (i == 0), "").otherwise("x"), F.lit('","start":'), (i * 100).cast("string"), F.lit(',"stop":'), (i * 100 + F.when((F.col("event_id") % 3 == 2) & (i == 1), 0).otherwise(50)).cast("string"), F.lit("}"))
    n = (F.col("event_id") % 5).cast("int")
    items = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), cue)).otherwise(F.expr("cast(array() as array<string>)"))
    parameters = F.concat(F.lit('{"cues":['), F.array_join(items, ","), F.lit("]}"))
    rows = table(spark, d, "events").select("event_id", F.explode(records.cues_of(parameters)).alias("c"))
    return rows.select("event_id", F.substring("c.id", 2, 9).cast("int").alias("pos"), "c.id", "c.start", "c.stop")


def _plans(spark: SparkSession, d: str) -> DataFrame:
    """A plan for each order: its items as clips, then layers by the order's key."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"), "l_discount")
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    clip = F.transform("items", lambda x: F.struct(F.lit("clip").alias("kind"), F.when(x["l_discount"] < 0.095, F.concat(F.lit("p"), x["l_partkey"].cast("string"))).alias("source"), F.lit(0.0).alias("start"), F.when(x["q"] > 2, x["q"]).otherwise(0.0).alias("stop"), F.lit("{}").alias("parameters")))
    layer = lambda kind, parameters: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("stop"), F.lit(parameters).alias("parameters")))
    music, fade = layer("music", '{"gain_db": -6}'), layer("fade", '{"seconds": 20}')
    key = F.col("l_orderkey") % 4
    return orders.select(F.col("l_orderkey").alias("plan_id"), F.when(key == 0, F.concat(clip, music)).when(key == 1, F.concat(clip, music, fade)).when(key == 2, F.concat(clip, fade, music)).otherwise(clip).alias("operations"))


@query("""with i as (select l_orderkey as plan_id, bool_or(l_quantity <= 2) as empty, bool_or(l_discount >= 0.095) as lost from lineitem group by 1)
select plan_id, unnest(list_filter([case when plan_id % 4 = 2 then 'order' end, case when empty then 'empty clip' end, case when lost then 'clip without source' end, case when plan_id % 4 in (1, 2) then 'fade.seconds out of range' end], lambda x: x is not null)) as issue from i""")
def plan_issues(spark: SparkSession, d: str) -> DataFrame:
    """Order grammar, empty clips, missing sources and ranges of plans."""
    return grammar.plan_issues(_plans(spark, d))


@query("""with c as (select l_orderkey as plan_id, row_number() over w - 1 as pos, case when l_discount < 0.095 then 'p' || l_partkey end as source, case when l_quantity > 2 then l_quantity else 0 end as length,
  l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount))
select plan_id, pos, source, sum(length) over (partition by plan_id order by pos) - length as "at", length from c""")
def plan_clips(spark: SparkSession, d: str) -> DataFrame:
    return grammar.clips(_plans(spark, d))


@query(f"""with {LINES}, p as (select doc_id, idx, text, (sum(length(text)) over (partition by doc_id order by idx))::bigint as stop from l), b as (select doc_id, idx // 3 as scene, string_agg(text, ' ' order by idx) as narration, max(stop) as stop, count(*) as n from p group by all),
j as (select b.doc_id, scene, b.n, b.stop - lag(b.stop, 1, 0) over (partition by b.doc_id order by scene) as length, length(replace(narration, ' ', '')) as chars from b)
select doc_id, scene, n, length, chars from j""")
def scene_cover(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of three lines: their joined narration and their part of the text's length cover it."""
    rows = bare_lines(spark, d).withColumn("stop", F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("idx")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ")
    found = rows.groupBy("doc_id", F.floor(F.col("idx") / 3).alias("scene")).agg(joined.alias("narration"), F.max("stop").alias("stop"), F.count("*").alias("n"))
    before = F.lag("stop", 1, 0).over(Window.partitionBy("doc_id").orderBy("scene"))
    return found.select("doc_id", "scene", "n", (F.col("stop") - before).alias("length"), F.length(F.replace("narration", F.lit(" "), F.lit(""))).alias("chars"))


@query(f"""with {_REV}, c as (select user_id, event_id, greatest(start - 1000, 0) as start, least(stop, 400000) as stop, suggestion from r where event_id % 4 = 0)
select user_id, md5('[' || string_agg('{{"start":' || start || ',"id":' || event_id || ',"stop":' || stop || ',"text":"' || suggestion || '"}}', ',' order by start, event_id) || ']') as digest from c where stop > start group by 1""")
def scene_documents(spark: SparkSession, d: str) -> DataFrame:
    """Events clamped to the timeline, one document a user."""
    given = _reviewed(spark, d).where("event_id % 4 = 0").select("user_id", F.col("event_id").alias("id"), (F.col("start") - 1000).alias("start"), "stop", F.col("suggestion").alias("text"))
    return records.scene(records.clamped(given, F.lit(400_000)), "user_id").select("user_id", F.md5("scene").alias("digest"))


@query("""with a as (select user_id, event_id as id, event_id * 10 + case event_type when 'view' then 3 else 0 end as at_ms from events where event_id % 3 = 0 and event_type in ('click', 'view'))
select user_id, id, at_ms - 5 as place, coalesce(lag(at_ms) over (partition by user_id order by at_ms, id) + 40 > at_ms, false) as overlaps from a""")
def layer_union(spark: SparkSession, d: str) -> DataFrame:
    """Found and given events together, remapped, in order, with a check of overlaps."""
    rows = table(spark, d, "events").where("event_id % 3 = 0")
    part = lambda kind, shift: rows.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("id"), (F.col("event_id") * 10 + shift).alias("at"))
    both = part("click", 0).unionByName(part("view", 3))
    before = F.lag("at").over(Window.partitionBy("user_id").orderBy("at", "id"))
    return both.select("user_id", "id", (F.col("at") - 5).alias("place"), F.coalesce(before + 40 > F.col("at"), F.lit(False)).alias("overlaps"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', case when l_returnflag not in ('N', 'A') then 'flag' end, case when l_linestatus <> 'O' then 'status' end) as bad from lineitem""")
def enum_checks(spark: SparkSession, d: str) -> DataFrame:
    rules = {"flag": ~F.col("l_returnflag").isin("N", "A"), "status": F.col("l_linestatus") != "O"}
    names = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(names, ",").alias("bad"))


@query("""select o_orderkey as key, 'status' as issue from orders where o_orderstatus not in ('O', 'F') union all select o_orderkey, 'price' from orders where o_totalprice > 400000""")
def order_issues(spark: SparkSession, d: str) -> DataFrame:
    rules = {"status": ~F.col("o_orderstatus").isin("O", "F"), "price": F.col("o_totalprice") > 400_000}
    found = integrity.issues(table(spark, d, "orders"), F.col("o_orderkey"), rules)
    return found.select(F.col("key").cast("long").alias("key"), "issue")


QUERIES, ORACLES = query.queries, query.oracles
