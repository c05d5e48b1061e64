"""Queries of formats, phrases and the reading of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import beats, editorial
from spanforge.functions import text as T
from spanforge.plans.binding import LINES, Plans, content, fold_b, joined, listed, tokens, words
from spanforge.sources.catalog import bare_lines, table

query = Plans()
_MS = "floor(value * 1000)::bigint"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.floor(F.col("value") * 1000).cast("long").alias("ms"))


@query(f"select event_id, printf('%02d:%02d.%03d', {_MS} // 60000, {_MS} // 1000 % 60, {_MS} % 1000) as clock from events")
def clock_text(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", T.clock(F.col("ms")).alias("clock"))


@query(f"select event_id, printf('%02d:%02d:%02d,%03d', 60 * {_MS} // 3600000, 60 * {_MS} // 60000 % 60, 60 * {_MS} // 1000 % 60, 60 * {_MS} % 1000) as clock from events")
def srt_clock_text(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", T.srt_clock(60 * F.col("ms")).alias("clock"))


@query(f"select event_id, printf('%d:%02d:%02d.%02d', 60 * {_MS} // 3600000, 60 * {_MS} // 60000 % 60, 60 * {_MS} // 1000 % 60, 60 * {_MS} // 10 % 100) as clock from events")
def centisecond_clock_text(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("event_id", editorial.centisecond_clock(60 * F.col("ms")).alias("clock"))


@query(f"select event_id, {_MS} as ms from events")
def clock_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A clock written and read again gives the milliseconds back."""
    return _events(spark, d).select("event_id", F.bround(1000 * T.clock_seconds(T.clock(F.col("ms")))).cast("long").alias("ms"))


@query("""select p_partkey, case when p_size * 16 > 400 then 'landscape' when p_size * 16 < 400 then 'portrait' else 'square' end as orientation from part""")
def orientation_of_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.orientation(16 * F.col("p_size"), F.lit(400)).alias("orientation"))


@query("""with s as (select p_partkey, p_size * 16 as w, (p_partkey % 40 + 10) * 9 as h from part)
select p_partkey, case when w * 9 = h * 16 then '16:9' when w * 16 = h * 9 then '9:16' when w = h then '1:1' else w || ':' || h end as aspect from s""")
def aspect_of_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", editorial.aspect(16 * F.col("p_size"), 9 * (F.col("p_partkey") % 40 + 10)).alias("aspect"))


@query("""with n as (select page_id, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-.') as n from pages)
select page_id, case when n = '' then 'item' else n end as name from n""")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("""with e as (select page_id, lower(regexp_extract(url, '(\\.[A-Za-z0-9]{1,5})(?:[?#].*)?$', 1)) as e from pages)
select page_id, case when e = '' then '.html' else e end as extension from e""")
def file_extensions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", editorial.extension(F.col("url"), F.lit(".html")).alias("extension"))


@query("select event_id, greatest(least(round_even(round(value) / 250 * 0.92::double, 3), 2.0), 0.5) as speed from events")
def unit_speeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", editorial.unit_speed(F.round("value") / 250, 0.92).alias("speed"))


_FORMAT = "(p_size * 20) || 'x' || (p_partkey % 90 + 5) || case p_partkey % 3 when 0 then '' when 1 then ':cover' else ':fill' end"


@query(f"""with f as (select p_partkey, {_FORMAT} as f from part)
select p_partkey, regexp_extract(f, '^([0-9]+)x', 1)::int as width, regexp_extract(f, 'x([0-9]+)', 1)::int as height, case when f like '%:%' then 'cover' else 'contain' end as fit
from f where regexp_matches(f, '^[0-9]{{2,5}}x[0-9]{{2,5}}(:(contain|cover))?$')""")
def target_formats(spark: SparkSession, d: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, ":cover").otherwise(":fill")
    given = F.concat((20 * F.col("p_size")).cast("string"), F.lit("x"), (F.col("p_partkey") % 90 + 5).cast("string"), tail)
    return table(spark, d, "part").select("p_partkey", editorial.target_format(given).alias("f")).where("f is not null").select("p_partkey", "f.width", "f.height", "f.fit")


@query("select doc_id, '&H00' || upper(substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2)) as colour from (select doc_id, md5(doc_id::varchar) as m from documents)")
def colours_bgr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.bgr(F.concat(F.lit("#"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6))).alias("colour"))


@query(f"""with {LINES}, w as (select doc_id, idx, {words('text')} as w from l), k as (select doc_id, idx, w, generate_subscripts(w, 1) as i, unnest(w) as x from w),
s as (select doc_id, idx, x, i, sum(length(x)) over (partition by doc_id, idx order by i) + i - 1 as n from k),
m as (select doc_id, idx, string_agg(x, ' ' order by i) as short from s where n <= 30 group by all)
select l.doc_id, l.idx, coalesce(m.short, '') as short from l left join m on m.doc_id = l.doc_id and m.idx = l.idx""")
def shortened_lines(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", T.shorten(T.words(F.col("text")), 30).alias("short"))


_FIRST4 = f"{words('text')}[1:4]"


@query(f"""with {LINES}, w as (select doc_id, idx, {_FIRST4} as w from l)
select doc_id, idx, concat_ws(' ', array_to_string(list_filter({listed(('the', 'old', 'in', 'house'))}, lambda x: not list_contains(w, x)), ' '), array_to_string(w, ' ')) as phrase from w""")
def prefixed_phrases(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", editorial.join_prefix(F.lit("the old in house"), F.array_join(F.slice(T.words(F.col("text")), 1, 4), " ")).alias("phrase"))


@query(f"""with {LINES}, q as (select doc_id, idx, {words('text')}[1:idx % 9] as w from l)
select doc_id, idx, case when len(w) < 2 or len(w) >= 7 then {joined('w')} else concat_ws(' ', {joined("['night', 'close'][1:least(2, 7 - len(w))]")}, {joined('w')}) end as query from q""")
def refined_queries(spark: SparkSession, d: str) -> DataFrame:
    own = F.array_join(F.slice(T.words(F.col("text")), F.lit(1), F.col("idx") % 9), " ")
    return bare_lines(spark, d).select("doc_id", "idx", editorial.refined(own, F.array(F.lit("night"), F.lit("close"))).alias("query"))


_LEXICON = {"the": "this", "of": "from", "license": "permit", "und": "and", "de": "of"}


@query(f"""with {LINES}, t as (select doc_id, idx, {tokens('text')}[1] as t from l)
select doc_id, idx, case t {' '.join(f"when '{k}' then '{v}'" for k, v in _LEXICON.items())} else t end as word from t""")
def substituted_words(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", editorial.substituted(F.get(T.tokens(F.col("text")), F.lit(0)), _LEXICON).alias("word"))


@query(f"""with {LINES}, c as (select doc_id, idx, {content('text')} as c from l), k as (select doc_id, idx, list_filter(c, lambda x, i: list_position(c, x) = i) as c from c)
select doc_id, idx, trim((['wide', 'medium', 'close'])[idx % 3 + 1] || ' scene ' || {joined('c[1:3]')}) as query from k""")
def template_queries(spark: SparkSession, d: str) -> DataFrame:
    scale = F.get(F.array(*map(F.lit, ("wide", "medium", "close"))), F.col("idx") % 3)
    return bare_lines(spark, d).select("doc_id", "idx", editorial.template_query(scale, F.lit("scene"), F.slice(T.content_terms(F.col("text")), 1, 3)).alias("query"))


@query(f"""with w as (select doc_id, {words("replace(text, chr(10), ' ')")} as w from documents),
s as (select doc_id, w, unnest([0, 1, 2]) as part, round_even(len(w) * 0.25::double, 0)::int as a, round_even(len(w) * 0.75::double, 0)::int as b from w)
select doc_id, part, md5({joined("w[case part when 0 then 1 when 1 then a + 1 else b + 1 end : case part when 0 then a when 1 then b else len(w) end]")}) as digest from s""")
def narration_slices(spark: SparkSession, d: str) -> DataFrame:
    """A text cut into three slices of 1, 2 and 1 parts of its words."""
    own = T.words(F.replace("text", F.lit("\n"), F.lit(" ")))
    cut = editorial.slices(own, F.array(F.lit(1.0), F.lit(2.0), F.lit(1.0)))
    return table(spark, d, "documents").select("doc_id", F.posexplode(cut).alias("part", "s")).select("doc_id", "part", F.md5("s").alias("digest"))


_PHRASES = ("all rights reserved", "the", "of the", "public license", "cc by")


def _hits(t: str, phrases: tuple[str, ...]) -> str:
    return f"list_sort(list_filter({listed(phrases)}, lambda p: contains(' ' || {joined(t)} || ' ', ' ' || p || ' ')))"


@query(f"with {LINES}, t as (select doc_id, idx, {tokens('text')} as t from l) select doc_id, idx, array_to_string({_hits('t', _PHRASES)}, ',') as hits from t")
def phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", F.array_join(T.phrase_hits(F.col("text"), list(_PHRASES)), ",").alias("hits"))


_MARKERS = ("de", "la", "und", "der", "el")


@query(f"""with {LINES}, t as (select doc_id, idx, text, {tokens('text')} as t from l)
select doc_id, idx, concat_ws(',', case when lower(text) <> {fold_b('text')} then 'diacritics' end, case when len({_hits('t', _MARKERS)}) > 0 then 'foreign words' end, case when len({words('text')}) < 4 then 'too short' end) as reasons from t""")
def foreign_query_reasons(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", F.array_join(editorial.foreign_reasons(F.col("text"), list(_MARKERS)), ",").alias("reasons"))


_VOCAB = ("license", "apache", "reserved", "rights", "copyright")


@query(f"""with {LINES}, t as (select doc_id, idx, list_filter({tokens('text')}, lambda x: length(x) > 1) as t from l)
select doc_id, idx, array_to_string(list_sort(list_distinct(list_filter(t, lambda x: list_contains({listed(_VOCAB)}, x) and x <> 'rights'))), ',') as words from t""")
def unjustified_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    found = editorial.unjustified(T.content_bag(F.col("text")), list(_VOCAB), F.array(F.lit("rights")))
    return bare_lines(spark, d).select("doc_id", "idx", F.array_join(F.array_sort(found), ",").alias("words"))


@query(f"""with {LINES}, t as (select doc_id, idx, text, {tokens('text')} as t from l),
r as (select doc_id, idx, list_concat(case when text = '' then ['empty'] else [] end, case when len(t) < 3 then ['short'] else [] end) as old, list_concat(case when len(t) < 3 then ['short'] else [] end, case when contains(text, '!') then ['shout'] else [] end) as new from t)
select doc_id, idx, array_to_string(list_filter(list_concat(old, new), lambda x, i: list_position(list_concat(old, new), x) = i), ',') as reasons from r""")
def merged_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Ordered distinct union of the reasons of two checks."""
    short = (F.size(T.tokens(F.col("text"))) < 3, "short")
    both = editorial.with_reasons(editorial.reasons((F.col("text") == "", "empty"), short), editorial.reasons(short, (F.col("text").contains("!"), "shout")))
    return bare_lines(spark, d).select("doc_id", "idx", F.array_join(both, ",").alias("reasons"))


@query("""with k as (select o_orderkey, coalesce(list(distinct l_returnflag) filter (l_returnflag is not null), []) as m, count(distinct l_suppkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1)
select o_orderkey, case when list_contains(m, 'R') then true when len(list_filter(m, lambda x: x <> 'N')) = 0 then false else n > 1 end as approval from k""")
def approval_rule(spark: SparkSession, d: str) -> DataFrame:
    """R stands for generated material, N for real one: the first always needs approval, the second never."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("modes"), F.countDistinct("l_suppkey").alias("n"))
    rows = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    kinds = F.transform(F.coalesce("modes", F.expr(editorial.NO_STRINGS)), lambda m: F.when(m == "R", "generated").when(m == "N", "real").otherwise("stock"))
    return rows.select("o_orderkey", editorial.needs_approval(kinds, F.coalesce("n", F.lit(0))).alias("approval"))


@query(f"""with {LINES}, n as (select doc_id, idx, text, lead(text) over (partition by doc_id order by idx) as nxt from l), f as (select *, {fold_b('ltrim(nxt)')} as s, {fold_b('nxt')} as b, {fold_b('text')} as a from n where nxt is not null)
select doc_id, idx, regexp_matches(s, '^(but|however|yet|instead)[ ,]') or (contains(b, ' not ') and not contains(a, ' not ')) as turns from f""")
def contrast_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = bare_lines(spark, d).withColumn("next", F.lead("text").over(Window.partitionBy("doc_id").orderBy("idx"))).where("next is not null")
    return rows.select("doc_id", "idx", editorial.opposes(F.col("text"), F.col("next")).alias("turns"))


_STEMS = f"list_transform({content('%s')}, lambda s: substr(s, 1, 5))"


@query(f"""with {LINES}, n as (select doc_id, idx, text, lead(text) over (partition by doc_id order by idx) as nxt from l)
select doc_id, idx, not list_has_any({_STEMS % 'text'}, {_STEMS % 'nxt'}) as apart from n where nxt is not null""")
def stems_apart(spark: SparkSession, d: str) -> DataFrame:
    rows = bare_lines(spark, d).withColumn("next", F.lead("text").over(Window.partitionBy("doc_id").orderBy("idx"))).where("next is not null")
    return rows.select("doc_id", "idx", editorial.no_shared_stem(F.col("text"), F.col("next")).alias("apart"))


@query(f"""with {LINES}, t as (select doc_id, idx, {tokens('text')} as t from l), c as (select *, list_concat(t[1:2], t[4:5]) as c from t)
select doc_id, idx, not contains(' ' || {joined('t')} || ' ', ' ' || {joined('c')} || ' ') and len(c) <= 0.6::double * len(t) as derived from c""")
def derived_captions(spark: SparkSession, d: str) -> DataFrame:
    own = T.tokens(F.col("text"))
    composed = F.array_join(F.concat(F.slice(own, 1, 2), F.slice(own, 4, 2)), " ")
    return bare_lines(spark, d).select("doc_id", "idx", editorial.derived(composed, F.col("text")).alias("derived"))


@query(f"""with {LINES} select doc_id, idx, nullif(regexp_extract(text, '[0-9]+'), '') as number from l""")
def first_numbers(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", beats.first_number(F.col("text")).alias("number"))


@query(f"with {LINES} select doc_id, idx, list_has_any({tokens('text')}, {listed(beats.CONCLUSIONS)}) as concludes from l")
def conclusion_cues(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", beats.has_cue(T.tokens(F.col("text")), beats.CONCLUSIONS).alias("concludes"))


_PROPS = ("river", "house", "license", "rights", "the", "apache")


@query(f"""with {LINES}, t as (select doc_id, idx, {tokens('text')} as t from l), h as (select doc_id, idx, list_filter(t, lambda x: list_contains({listed(_PROPS)}, x)) as h from t)
select doc_id, idx, array_to_string(list_filter(h, lambda x, i: list_position(h, x) = i), ',') as hits from h""")
def ordered_lexicon_hits(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", F.array_join(beats.ordered_hits(T.tokens(F.col("text")), _PROPS), ",").alias("hits"))


_MOODS = {"reserved": "calm", "license": "dry", "the": "plain", "und": "plain"}


@query(f"""with {LINES}, t as (select doc_id, idx, list_filter({tokens('text')}, lambda x: list_contains({listed(list(_MOODS))}, x))[1] as t from l)
select doc_id, idx, case t {' '.join(f"when '{k}' then '{v}'" for k, v in _MOODS.items())} end as mood from t""")
def first_moods(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", beats.first_value(T.tokens(F.col("text")), _MOODS).alias("mood"))


_KNOWN = ("the", "of", "and", "a", "to", "in", "it", "is")


@query(f"""with {LINES}, t as (select doc_id, idx, {tokens('text')} as t from l)
select doc_id, idx, len(list_distinct(list_filter(t, lambda x: not list_contains({listed(_KNOWN)}, x)))) as n_outside from t""")
def outside_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", F.size(beats.outside(T.tokens(F.col("text")), _KNOWN)).cast("long").alias("n_outside"))


_FIELDS = {"law": ["license", "rights", "reserved", "copyright"], "code": ["apache", "software"], "words": ["the", "of", "und", "de", "la"]}
_IDEAS = {"law": "paper,seal", "code": "screen", "words": "ink,page"}


@query(f"""with {LINES}, t as (select doc_id, idx, list_distinct({tokens('text')}) as t from l),
f as (select doc_id, idx, unnest([{', '.join(f"{{'n': -len(list_intersect(t, {listed(v)})), 's': {len(v)}, 'k': {k}, 'name': '{n}'}}" for k, (n, v) in enumerate(_FIELDS.items()))}]) as f from t),
b as (select doc_id, idx, min(f) as f from f group by all)
select doc_id, idx, f.name as field, case f.name {' '.join(f"when '{k}' then '{v}'" for k, v in _IDEAS.items())} end as ideas from b where f.n < 0""")
def field_abstractions(spark: SparkSession, d: str) -> DataFrame:
    """The field with most hits, the smaller lexicon on ties, and what it may be shown as."""
    found = bare_lines(spark, d).select("doc_id", "idx", editorial.best_field(F.array_distinct(T.tokens(F.col("text"))), _FIELDS).alias("field")).where("field is not null")
    ideas = F.create_map(*(F.lit(x) for kv in _IDEAS.items() for x in kv))
    return found.select("doc_id", "idx", "field", F.try_element_at(ideas, F.col("field")).alias("ideas"))


_BARE = "list_transform(%s, lambda y: " + fold_b("regexp_replace(y, '^[^0-9A-Za-zÀ-ÿ]+|[^0-9A-Za-zÀ-ÿ]+$', '', 'g')") + ")"


@query(f"""with {LINES}, w as (select doc_id, idx, {words('text')} as w from l), b as (select *, {_BARE % 'w'} as b from w),
p as (select *, list_filter(b, lambda x: regexp_matches(x, '^(1[0-9]|20)[0-9]{{2}}$'))[1] as yr, list_position(list_transform(b, lambda x: regexp_matches(x, '^[0-9]+$')), true) as fi,
  list_position(list_transform(b, lambda x: list_contains({listed(beats.CONTRASTS)}, x)), true) as ct, {joined(f"list_filter(b, lambda x: length(x) >= 4 and not list_contains({listed(T.STOPWORDS)}, x))[1:3]")} as ky from b),
s as (select doc_id, idx, case when yr is not null then yr when fi > 0 then {joined('w[fi : fi + 3]')} when ct > 0 and {joined('w[ct + 1 : ct + 4]')} <> '' then {joined('w[ct + 1 : ct + 4]')} when ky <> '' then ky end as span,
  case when yr is not null then 'date' when fi > 0 then 'number' when ct > 0 and {joined('w[ct + 1 : ct + 4]')} <> '' then 'emphasis' when ky <> '' then 'keyword' end as category from p)
select doc_id, idx, upper(replace(span, 'ß', 'ss')) as span, category from s where span is not null""")
def emphasis_ladder(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", beats.emphasis(F.col("text")).alias("e")).where("e is not null").select("doc_id", "idx", "e.span", "e.category")


@query(f"""with {LINES}, w as (select doc_id, idx, {words('text')}[1:2] as w, case when idx % 2 = 0 then 'keyword' else 'date' end as category from l),
b as (select *, ({_BARE % 'w'})[1] as b from w)
select doc_id, idx, len(w) > 0 and (len(w) > 1 or category = 'date' or regexp_matches({joined('w')}, '[0-9]')) and not coalesce(list_contains({listed(T.STOPWORDS)}, b), false) as alone from b""")
def standalone_spans(spark: SparkSession, d: str) -> DataFrame:
    span = F.array_join(F.slice(T.words(F.col("text")), 1, 2), " ")
    return bare_lines(spark, d).select("doc_id", "idx", beats.can_stand_alone(span, F.when(F.col("idx") % 2 == 0, "keyword").otherwise("date")).alias("alone"))


_ENDS = lambda items: "(" + " or ".join(f"b like '%{x}'" for x in items) + ")"


@query(f"""with {LINES}, c as (select doc_id, idx, {words('text')} as w, {content('text')} as c from l), w as (select doc_id, idx, w, list_filter(c, lambda x, i: list_position(c, x) = i)[1:2] as themes from c), k as (select doc_id, idx, themes, len(w) as total, generate_subscripts(w, 1) - 1 as place, unnest(w) as word from w),
b as (select *, {fold_b("regexp_replace(word, '^[^0-9A-Za-zÀ-ÿ]+|[^0-9A-Za-zÀ-ÿ]+$', '', 'g')")} as b from k),
s as (select *, case when length(b) < 4 or list_contains({listed(T.STOPWORDS)}, b) or not regexp_matches(b, '[a-z]') then -100 else 16 * length(b) + case when list_contains(themes, b) then 220 else 0 end + case when {_ENDS(beats.NOUN_ENDS)} then 170 else 0 end
  - case when {_ENDS(beats.VERB_ENDS)} then 140 else 0 end + case when total > 1 then 120 * place // (total - 1) else 0 end end as score from b)
select doc_id, idx, arg_max(word, (score, -place)) as word, max(score)::bigint as score from s group by all having max(score) > 0""")
def best_words(spark: SparkSession, d: str) -> DataFrame:
    """The word of a line that deserves the frame most."""
    rows = bare_lines(spark, d).withColumn("w", T.words(F.col("text"))).withColumn("themes", F.slice(T.content_terms(F.col("text")), 1, 2))
    each = rows.select("doc_id", "idx", "themes", F.size("w").alias("total"), F.posexplode("w").alias("place", "word"))
    scored = each.withColumn("score", beats.word_score(F.col("word"), F.col("place"), F.col("total"), F.col("themes")))
    return scored.groupBy("doc_id", "idx").agg(F.max_by("word", F.struct("score", -F.col("place"))).alias("word"), F.max("score").alias("score")).where("score > 0")


@query(f"""with {LINES}, b as (select doc_id, idx, {_BARE % words('text')} as b from l)
select doc_id, idx, case {' '.join(f"when list_has_any(b, {listed(c)}) then '{n}'" for n, c in beats.CONNECTORS)} end as connector from b""")
def connectors(spark: SparkSession, d: str) -> DataFrame:
    return bare_lines(spark, d).select("doc_id", "idx", beats.connector(F.col("text")).alias("connector"))


@query(f"""with r as (select doc_id, regexp_extract_all(text, '[0-9A-Za-zÀ-ÿ]+') as r from documents), u as (select doc_id, r, {content("array_to_string(r, ' ')")}[1] as f from r)
select doc_id, f as folded, list_filter(r, lambda q: {fold_b('q')} = f)[1] as form from u where f is not null""")
def first_surface_forms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "text", F.get(T.content_terms(F.col("text")), F.lit(0)).alias("folded")).where("folded is not null")
    return rows.select("doc_id", "folded", beats.first_form(F.col("text"), F.col("folded")).alias("form"))


@query(f"""with {LINES} select doc_id, idx, case when lower(text) like '%license%' or lower(text) like '%reserved%' then 'document' when regexp_matches(text, '[0-9]{{2}}') then 'data' when contains(text, '!') then 'people'
when length(text) < 25 then 'detail' when contains(text, ',') then 'place' else 'action' end as role from l""")
def role_class(spark: SparkSession, d: str) -> DataFrame:
    """The visual role of a line: the first rule that fits."""
    low = F.lower(F.col("text"))
    rules = F.when(low.contains("license") | low.contains("reserved"), "document").when(F.col("text").rlike("[0-9]{2}"), "data").when(F.col("text").contains("!"), "people")
    return bare_lines(spark, d).select("doc_id", "idx", rules.when(F.length(F.col("text")) < 25, "detail").when(F.col("text").contains(","), "place").otherwise("action").alias("role"))


@query("select event_id, case when value / 500 < 0.35::double then 'lift' when value / 500 > 0.65::double then 'hold' else 'neutral' end as grade from events")
def grade_bands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", editorial.grade_for(F.col("value") / 500).alias("grade"))


@query("select event_id, round(coalesce(value * 0.5::double, 0) + (event_id % 7) * 2.0::double, 6) as score from events")
def weighted_components(spark: SparkSession, d: str) -> DataFrame:
    """Named components under named weights; one without a weight counts nothing."""
    parts = F.create_map(F.lit("value"), F.col("value"), F.lit("turn"), (F.col("event_id") % 7).cast("double"), F.lit("other"), F.lit(9.0))
    return table(spark, d, "events").select("event_id", F.round(editorial.weighted(parts, {"value": 0.5, "turn": 2.0}), 6).alias("score"))


@query(f"""with {LINES}, t as (select doc_id, idx, list_sort(list_distinct(list_filter({tokens('text')}, lambda x: list_contains({listed(_PROPS)}, x))))[1] as t from l) select doc_id, idx, t as motif from t where t is not null""")
def first_motifs(spark: SparkSession, d: str) -> DataFrame:
    """The alphabetically first motif that a line has."""
    return bare_lines(spark, d).select("doc_id", "idx", F.array_min(beats.ordered_hits(T.tokens(F.col("text")), _PROPS)).alias("motif")).where("motif is not null")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, list_position(['N', 'A', 'R'], l_returnflag) as rank from lineitem")
def material_ranks(spark: SparkSession, d: str) -> DataFrame:
    rank = F.nullif(F.array_position(F.array(*map(F.lit, ("N", "A", "R"))), F.col("l_returnflag")), F.lit(0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rank.alias("rank"))


@query(f"""with {LINES}, c as (select doc_id, {content('text')} as c from l) select distinct unnest(c) as term from c""")
def authored_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Every content word that any text has."""
    return table(spark, d, "documents").select(F.explode(F.array_distinct(F.flatten(F.transform(F.split("text", "\n"), lambda x: T.content_terms(x))))).alias("term")).distinct()


@query(f"""with {LINES}, c as (select doc_id, idx, text, {content('text')} as c from l), k as (select *, list_filter(c, lambda x, i: list_position(c, x) = i)[1:3] as k from c),
q as (select doc_id, idx, {joined('k')} as base, case when len(k) >= 2 then 'close ' || {joined('k')} else {joined('k')} end as refined, coalesce(k[1], 'scene') as fallback from k)
select doc_id, idx, array_to_string(list_filter([refined, base, fallback], lambda x, i: x <> '' and list_position([refined, base, fallback], x) = i), '|') as queries from q""")
def query_lists(spark: SparkSession, d: str) -> DataFrame:
    """Best first: the refined query, the plain one, the fallback; each once."""
    key = F.slice(T.content_terms(F.col("text")), 1, 3)
    base, fallback = F.array_join(key, " "), F.coalesce(F.get(key, F.lit(0)), F.lit("scene"))
    refined = F.when(F.size(key) >= 2, editorial.refined(base, F.array(F.lit("close")))).otherwise(base)
    every = F.array_distinct(F.filter(F.array(refined, base, fallback), lambda q: q != ""))
    return bare_lines(spark, d).select("doc_id", "idx", F.array_join(every, "|").alias("queries"))


@query(f"""with {LINES}, t as (select doc_id, idx, {content('text')} as c, regexp_extract_all(text, '[A-Z][a-z]+') as n, list_filter({tokens('text')}, lambda x: list_contains({listed(list(_MOODS))}, x))[1] as m from l)
select doc_id, idx, concat_ws(' · ', coalesce(c[1], 'scene'), nullif(array_to_string(n[1:2], '/'), ''), case m {' '.join(f"when '{k}' then '{v}'" for k, v in _MOODS.items())} end) as audit from t""")
def audit_lines(spark: SparkSession, d: str) -> DataFrame:
    names = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))
    concept = F.coalesce(F.get(T.content_terms(F.col("text")), F.lit(0)), F.lit("scene"))
    return bare_lines(spark, d).select("doc_id", "idx", beats.audit_line(concept, names, beats.first_value(T.tokens(F.col("text")), _MOODS)).alias("audit"))


@query("""with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::int as n, (l_linenumber - 1) * 30 as start from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when start < 60 then least(n, 20) else n end as ideal, case when start < 60 then 20 else 35 end as soft, case when start < 60 then greatest(20, 45) else 45 end as hard from r""")
def opening_rhythms(spark: SparkSession, d: str) -> DataFrame:
    """Rows that start in the opening get its lower ceiling."""
    rows = table(spark, d, "lineitem")
    rhythm = beats.opening_rhythm(F.col("l_quantity").cast("int"), F.lit(35), F.lit(45), (F.col("l_linenumber") - 1) * 30, 60, 20)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rhythm.alias("r")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r.*")


QUERIES, ORACLES = query.queries, query.oracles
