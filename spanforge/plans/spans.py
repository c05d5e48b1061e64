"""Queries of interval algebra, runs and sessions, bound to the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.operators import intervals as iv
from spanforge.operators import runs
from spanforge.sources.catalog import spans

KEY = "user_id"
MINUTE = 60_000_000
HOUR = 60 * MINUTE


def span_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return iv.coalesce_spans(spans(spark, d), KEY).select(KEY, "start", "stop", "members")


def span_complement(spark: SparkSession, d: str) -> DataFrame:
    return iv.complement(iv.coalesce_spans(spans(spark, d), KEY), KEY)


def span_union_measure(spark: SparkSession, d: str) -> DataFrame:
    return iv.union_measure(spans(spark, d), KEY)


def span_totals(spark: SparkSession, d: str) -> DataFrame:
    return iv.totals(spans(spark, d), KEY)


def span_shrink_drop(spark: SparkSession, d: str) -> DataFrame:
    return iv.shrink(iv.coalesce_spans(spans(spark, d), KEY), 5 * MINUTE, 5 * MINUTE, HOUR).select(KEY, "start", "stop")


def span_clamp(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit(24 * HOUR)
    first = F.min("start").over(Window.partitionBy(KEY))
    return iv.clamp(spans(spark, d).withColumn("first", first), F.col("first"), F.col("first") + 30 * day).select(KEY, "event_id", "start", "stop")


def overlap_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return iv.conflicts(spans(spark, d), KEY).select(KEY, "event_id", "prev_id", (F.col("prev_stop") - F.col("start")).alias("overlap"))


def split_at_markers(spark: SparkSession, d: str) -> DataFrame:
    all_ = spans(spark, d)
    markers = all_.where("kind = 'purchase'").select(KEY, F.col("start").alias("mark"))
    return iv.split_at(iv.coalesce_spans(all_, KEY), markers, KEY).select(KEY, "piece", "start", "stop")


def remap_time(spark: SparkSession, d: str) -> DataFrame:
    all_ = spans(spark, d)
    laid = iv.timeline(iv.coalesce_spans(all_, KEY), KEY, F.when(F.col("members") > 1, 200).otherwise(100))
    points = all_.select(KEY, "event_id", (F.col("start") + HOUR).alias("at"))
    return iv.remap(points, laid, KEY)


def shift_after_inserts(spark: SparkSession, d: str) -> DataFrame:
    return iv.shifted(spans(spark, d), KEY, F.col("kind") == "purchase", F.col("stop") - F.col("start")).select(KEY, "event_id", "start", "moved")


def long_gaps(spark: SparkSession, d: str) -> DataFrame:
    found = runs.gap_rows(spans(spark, d), KEY, 48 * HOUR)
    return found.select(KEY, "gap_start", "gap_stop", F.round(runs.confidence_ramp(F.col("gap_stop") - F.col("gap_start"), 48 * HOUR), 6).alias("confidence"))


def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    own = runs.sessions(spans(spark, d), KEY, F.col("kind") != "view", 72 * HOUR)
    return own.groupBy(KEY, "session").agg(F.count("*").alias("n_rows"), F.min("start").alias("start"), F.max("stop").alias("stop"))


def blocks_dominant_category(spark: SparkSession, d: str) -> DataFrame:
    return runs.blocks(spans(spark, d), KEY, F.col("kind") != "view", 72 * HOUR, 6 * HOUR, 3).select(KEY, "session", "start", "stop", "n_rows", "dominant")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return runs.consecutive_groups(spans(spark, d).withColumn("seconds", ((F.col("stop") - F.col("start")) / 1_000_000).cast("long")), KEY, "kind", "start", "event_id")


def consecutive_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).select(KEY, "run", "kind", "length", "first_id", "last_id", "seconds")


def run_length_violations(spark: SparkSession, d: str) -> DataFrame:
    return runs.violations(_groups(spark, d), 2).select(KEY, "run", "kind", "length")


def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return runs.longest(_groups(spark, d), KEY).select(KEY, "longest")


def longest_run_seconds(spark: SparkSession, d: str) -> DataFrame:
    return runs.longest(_groups(spark, d), KEY).select(KEY, "longest_seconds")


def adjacent_equal(spark: SparkSession, d: str) -> DataFrame:
    return runs.adjacent_equal(spans(spark, d), KEY, "kind", "view", "start", "event_id")


def monotonic_clamp(spark: SparkSession, d: str) -> DataFrame:
    return runs.monotonic(spans(spark, d), KEY, "start", "stop", "event_id").select(KEY, "event_id", "start", "stop")


def event_to_window(spark: SparkSession, d: str) -> DataFrame:
    """Each event of one kind and the merged activity of all users of its remainder class it falls in."""
    all_ = spans(spark, d).withColumn("team", F.col(KEY) % 20)
    windows = iv.coalesce_spans(all_, "team").select(F.col("team").alias("w_team"), F.col("island").alias("w_island"), "start", "stop")
    points = all_.where("kind = 'signup'").select("event_id", "team", F.col("start").alias("at"))
    hit = iv.point_in_window(points, windows, 24 * HOUR).where("w_team = (team + 1) % 20")
    return hit.groupBy("event_id").agg(F.min_by("w_island", F.struct("start", "w_island")).alias("island"))


def nearest_anchor_band(spark: SparkSession, d: str) -> DataFrame:
    all_ = spans(spark, d)
    points = all_.where("kind = 'click'").select("event_id", F.col("start").alias("at"))
    anchors = all_.where("kind = 'purchase'").select(F.col("event_id").alias("anchor_id"), F.col("start").alias("anchor_at"))
    return iv.nearest(points, anchors, 30 * MINUTE)


def containment_join(spark: SparkSession, d: str) -> DataFrame:
    all_ = spans(spark, d)
    return iv.containment(iv.coalesce_spans(all_.where("kind <> 'click'"), KEY), all_.where("kind = 'click'"), KEY)


def dark_gaps(spark: SparkSession, d: str) -> DataFrame:
    merged = iv.coalesce_spans(spans(spark, d), KEY).withColumn("origin", F.min("start").over(Window.partitionBy(KEY)))
    origin = merged.groupBy(KEY).agg(F.min("origin").alias("origin"))
    gaps = iv.complement(merged, KEY, 0).join(origin, KEY)
    ceiling = F.when(F.col("start") - F.col("origin") < 240 * HOUR, 24 * HOUR).otherwise(96 * HOUR)
    return gaps.where(F.col("stop") - F.col("start") > ceiling).select(KEY, "start", "stop")


def treatment_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Counts by kind, by band of value and by both, with the margins, in one pass."""
    rows = spans(spark, d).withColumn("intensity", F.when(F.col("value") < 50, "low").when(F.col("value") < 150, "mid").otherwise("high"))
    sets = rows.groupingSets([[F.col("kind"), F.col("intensity")], [F.col("kind")], [F.col("intensity")], []], F.col("kind"), F.col("intensity"))
    return sets.agg(F.count("*").alias("n"))


def counts_pivot(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["click", "purchase", "signup", "view"]
    return spans(spark, d).groupBy(KEY).agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds))


def scorecard_diff(spark: SparkSession, d: str) -> DataFrame:
    """Baseline against candidate (even and odd events) by user: distinct kinds, change, reuse."""
    side = lambda k: spans(spark, d).where(F.col("event_id") % 2 == k).groupBy(KEY).agg(F.countDistinct("kind").alias(f"kinds{k}"), F.count("*").alias(f"n{k}"), F.sum((F.col("stop") - F.col("start"))).alias(f"time{k}"))
    both = side(0).join(side(1), KEY, "full_outer").na.fill(0)
    return both.withColumn("changed", F.col("kinds0") != F.col("kinds1")).withColumn("more", F.col("n1") - F.col("n0"))


def seeded_weighted_choice(spark: SparkSession, d: str) -> DataFrame:
    """A draw that depends on the key alone: SHA-256 of seed and id against cumulative weights."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit("7|"), F.col("event_id").cast("string")), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    weights = (("calm", 5), ("lively", 3), ("still", 2))
    pick, upto = F.lit(None).cast("string"), 0
    for name, weight in weights:
        pick = F.coalesce(pick, F.when(u < F.lit((upto + weight) / 10), F.lit(name)))
        upto += weight
    return spans(spark, d).select("event_id", u.alias("u"), pick.alias("choice"))


QUERIES = {
    f.__name__: f
    for f in (
        span_coalesce, span_complement, span_union_measure, span_totals, span_shrink_drop, span_clamp, overlap_conflicts, split_at_markers, remap_time,
        shift_after_inserts, long_gaps, gap_sessions, blocks_dominant_category, consecutive_groups, run_length_violations, longest_run, longest_run_seconds,
        adjacent_equal, monotonic_clamp, event_to_window, nearest_anchor_band, containment_join, dark_gaps, treatment_histogram, counts_pivot, scorecard_diff,
        seeded_weighted_choice,
    )
}

_S = """s as (select user_id, event_id, event_type as kind, epoch_us(ts) as start, epoch_us(ts) + round_even(value * 60, 0)::bigint * 1000000 as stop, value from events)"""
_R = _S + """,
r as (select *, max(stop) over (partition by user_id order by start, stop, event_id rows between unbounded preceding and 1 preceding) as reach from s),
i as (select *, sum(case when reach is null or start > reach + 1 then 1 else 0 end) over (partition by user_id order by start, stop, event_id) as island from r),
m as (select user_id, island, min(start) as start, max(stop) as stop, count(*) as members from i group by all)"""
_G = _S + """,
q as (select *, (stop - start) // 1000000 as seconds, case when lag(kind) over w is not distinct from kind then 0 else 1 end as fresh from s window w as (partition by user_id order by start, event_id)),
n as (select *, sum(fresh) over (partition by user_id order by start, event_id) as run from q),
g as (select user_id, run, kind, count(*) as length, min(event_id) as first_id, max(event_id) as last_id, sum(seconds) as seconds from n group by all)"""
_SESS = _S + """,
f as (select *, kind <> 'view' as flagged from s),
p as (select *, lag(flagged) over w as pf, lag(stop) over w as ps from f window w as (partition by user_id order by start, event_id)),
z as (select *, sum(case when not flagged then 0 when not coalesce(pf, false) then 1 when start - ps > 259200000000 then 1 else 0 end) over (partition by user_id order by start, event_id) as session from p),
o as (select * from z where flagged)"""

ORACLES = {
    "span_coalesce": f"with {_R} select user_id, start, stop, members from m",
    "span_complement": f"with {_R}, c as (select user_id, stop as start, lead(start) over (partition by user_id order by start) as stop from m) select * from c where stop - start >= 40000",
    "span_union_measure": f"with {_R} select user_id, sum(greatest(0, stop - greatest(start, coalesce(reach, start)))) as covered, sum(stop - start) as gross from r group by 1",
    "span_totals": f"with {_R} select user_id, count(*) as pieces, sum(members) as spans, max(stop) - min(start) as original, sum(stop - start) as covered, max(stop) - min(start) - sum(stop - start) as uncovered from m group by 1",
    "span_shrink_drop": f"with {_R} select user_id, start + 300000000 as start, stop - 300000000 as stop from m where stop - start - 600000000 >= 3600000000",
    "span_clamp": f"with {_S}, f as (select *, min(start) over (partition by user_id) as first from s), c as (select user_id, event_id, greatest(start, first) as start, least(stop, first + 30 * 86400000000) as stop from f) select * from c where stop > start",
    "overlap_conflicts": f"with {_S}, p as (select *, lag(event_id) over w as prev_id, lag(stop) over w as prev_stop from s window w as (partition by user_id order by start, stop, event_id)) select user_id, event_id, prev_id, prev_stop - start as overlap from p where prev_stop > start",
    "split_at_markers": f"""with {_R}, c as (select user_id, island, start, stop, start as b from m union select m.user_id, m.island, m.start, m.stop, s.start from m join s on s.user_id = m.user_id and s.kind = 'purchase' and s.start > m.start and s.start < m.stop),
e as (select *, lead(b) over (partition by user_id, island order by b) as nxt, row_number() over (partition by user_id, island order by b) - 1 as piece from c) select user_id, piece, b as start, coalesce(nxt, stop) as stop from e""",
    "remap_time": f"""with {_R}, t as (select *, case when members > 1 then 200 else 100 end as speed from m), l as (select *, (stop - start) * 100 // speed as length from t),
o as (select *, coalesce(sum(length) over (partition by user_id order by start rows between unbounded preceding and 1 preceding), 0) as out_start from l)
select s.user_id, s.event_id, s.start + 3600000000 as at, arg_min(o.out_start + (s.start + 3600000000 - o.start) * 100 // o.speed, o.start) as out_at from s left join o on o.user_id = s.user_id and s.start + 3600000000 between o.start and o.stop group by 1, 2, 3""",
    "shift_after_inserts": f"with {_S} select user_id, event_id, start, start + sum(case when kind = 'purchase' then stop - start else 0 end) over (partition by user_id order by start range between unbounded preceding and current row) - case when kind = 'purchase' then stop - start else 0 end as moved from s",
    "long_gaps": f"with {_R} select user_id, reach as gap_start, start as gap_stop, round(least(0.5::double + 0.05::double * ((start - reach) / 172800000000), 0.95::double), 6) as confidence from r where start - reach > 172800000000",
    "gap_sessions": f"with {_SESS} select user_id, session, count(*) as n_rows, min(start) as start, max(stop) as stop from o group by 1, 2",
    "blocks_dominant_category": f"""with {_SESS}, b as (select user_id, session, min(start) as start, max(stop) as stop, count(*) as n_rows from o group by 1, 2),
k as (select user_id, session, kind, count(*) as n, sum(value) as w from o group by 1, 2, 3), t as (select user_id, session, kind as dominant from k qualify row_number() over (partition by user_id, session order by n desc, w desc, kind) = 1)
select user_id, session, start, stop, n_rows, dominant from b join t using (user_id, session) where stop - start >= 21600000000 or n_rows >= 3""",
    "consecutive_groups": f"with {_G} select * from g",
    "run_length_violations": f"with {_G} select user_id, run, kind, length from g where length > 2",
    "longest_run": f"with {_G} select user_id, max(length) as longest from g group by 1",
    "longest_run_seconds": f"with {_G} select user_id, max(seconds) as longest_seconds from g group by 1",
    "adjacent_equal": f"with {_S}, p as (select *, lag(kind) over (partition by user_id order by start, event_id) as pk from s) select user_id, count(*) filter (pk = kind and kind <> 'view') as repeats from p group by 1",
    "monotonic_clamp": f"with {_R} select user_id, event_id, greatest(start, coalesce(reach, start)) as start, greatest(greatest(start, coalesce(reach, start)), stop) as stop from r",
    "event_to_window": """with s as (select event_id, user_id % 20 as team, event_type as kind, epoch_us(ts) as start, epoch_us(ts) + round_even(value * 60, 0)::bigint * 1000000 as stop from events),
r as (select *, max(stop) over (partition by team order by start, stop, event_id rows between unbounded preceding and 1 preceding) as reach from s),
i as (select *, sum(case when reach is null or start > reach + 1 then 1 else 0 end) over (partition by team order by start, stop, event_id) as island from r),
m as (select team, island, min(start) as start, max(stop) as stop from i group by all)
select s.event_id, arg_min(m.island, m.start) as island from s join m on m.team = (s.team + 1) % 20 and s.start >= m.start and s.start < m.stop where s.kind = 'signup' group by 1""",
    "nearest_anchor_band": f"""with {_S}, p as (select x.event_id, y.event_id as anchor_id, abs(x.start - y.start) as distance from s x join s y on x.kind = 'click' and y.kind = 'purchase' and y.start between x.start - 1800000000 and x.start + 1800000000)
select event_id, anchor_id, distance from p qualify row_number() over (partition by event_id order by distance, anchor_id) = 1""",
    "containment_join": f"""with {_S}, t as (select * from s where kind <> 'click'), r as (select *, max(stop) over (partition by user_id order by start, stop, event_id rows between unbounded preceding and 1 preceding) as reach from t),
i as (select *, sum(case when reach is null or start > reach + 1 then 1 else 0 end) over (partition by user_id order by start, stop, event_id) as island from r), m as (select user_id, island, min(start) as start, max(stop) as stop from i group by all)
select s.user_id, s.event_id, m.island from s left join m on m.user_id = s.user_id and s.start >= m.start and s.stop <= m.stop where s.kind = 'click'""",
    "dark_gaps": f"""with {_R}, o as (select user_id, min(start) as origin from m group by 1), c as (select user_id, stop as start, lead(start) over (partition by user_id order by start) as stop from m)
select c.user_id, c.start, c.stop from c join o using (user_id) where c.stop - c.start > case when c.start - origin < 864000000000 then 86400000000 else 345600000000 end""",
    "treatment_histogram": f"with {_S}, t as (select kind, case when value < 50 then 'low' when value < 150 then 'mid' else 'high' end as intensity from s) select kind, intensity, count(*) as n from t group by grouping sets ((kind, intensity), (kind), (intensity), ())",
    "counts_pivot": f"with {_S} select user_id, " + ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in ("click", "purchase", "signup", "view")) + " from s group by 1",
    "scorecard_diff": f"""with {_S}, a as (select user_id, count(distinct kind) as kinds0, count(*) as n0, sum(stop - start) as time0 from s where event_id % 2 = 0 group by 1), b as (select user_id, count(distinct kind) as kinds1, count(*) as n1, sum(stop - start) as time1 from s where event_id % 2 = 1 group by 1),
j as (select coalesce(a.user_id, b.user_id) as user_id, coalesce(kinds0, 0) as kinds0, coalesce(n0, 0) as n0, coalesce(time0, 0) as time0, coalesce(kinds1, 0) as kinds1, coalesce(n1, 0) as n1, coalesce(time1, 0) as time1 from a full join b on a.user_id = b.user_id)
select *, kinds0 <> kinds1 as changed, n1 - n0 as more from j""",
    "seeded_weighted_choice": "with u as (select event_id, ('0x' || substr(sha256('7|' || event_id), 1, 8))::bigint / 4294967296.0::double as u from events) select event_id, u, case when u < 0.5 then 'calm' when u < 0.8 then 'lively' when u < 1.0 then 'still' end as choice from u",
}

#: DuckDB sums whole numbers to a wider type; these columns are bigint in both engines.
_WHOLE = {
    "span_union_measure": "covered gross", "span_totals": "spans covered uncovered", "shift_after_inserts": "moved", "gap_sessions": "session", "blocks_dominant_category": "session",
    "consecutive_groups": "run seconds", "run_length_violations": "run", "longest_run_seconds": "longest_seconds", "event_to_window": "island", "containment_join": "island", "scorecard_diff": "time0 time1",
}
ORACLES |= {k: f"select * replace ({', '.join(f'{c}::bigint as {c}' for c in v.split())}) from ({ORACLES[k]})" for k, v in _WHOLE.items()}
