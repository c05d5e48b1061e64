"""Queries of contracts, coverage, digests and allocation over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.operators import alloc, integrity
from spanforge.sources.catalog import table

#: Line numbers repeat within an order; these columns make the order total.
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def preflight_issues(spark: SparkSession, d: str) -> DataFrame:
    """Items against their orders: range checks after a left join."""
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    joined = items.join(orders.select("o_orderkey", "o_orderdate", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rules = {
        "order missing": F.col("o_orderkey").isNull(),
        "shipped before ordered": F.col("l_shipdate") < F.col("o_orderdate"),
        "quantity out of range": (F.col("l_quantity") < 1) | (F.col("l_quantity") > 45),
        "discount out of range": F.col("l_discount") > 0.09,
    }
    found = integrity.issues(joined, F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), rules)
    return found.groupBy("issue").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def chain_issues(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    parts = [
        integrity.orphans(t("nation"), t("region"), "n_regionkey", "r_regionkey", "nation without region"),
        integrity.orphans(t("customer"), t("nation"), "c_nationkey", "n_nationkey", "customer without nation"),
        integrity.orphans(t("orders"), t("customer").where("c_acctbal > 0"), "o_custkey", "c_custkey", "order without solvent customer"),
        integrity.orphans(t("lineitem"), t("orders").where("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey", "item without settled order"),
        integrity.orphans(t("lineitem"), t("supplier").where("s_acctbal > 0"), "l_suppkey", "s_suppkey", "item without solvent supplier"),
    ]
    return integrity.union(parts).groupBy("issue").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


def coverage_full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Every document is required; what is given are the labels, three ids on."""
    given = table(spark, d, "labels").select((F.col("doc_id") + 3).alias("doc_id"))
    return integrity.coverage(table(spark, d, "documents"), given, "doc_id")


def disjoint_cover(spark: SparkSession, d: str) -> DataFrame:
    uses = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return integrity.shared_members(uses, "l_partkey")


def patch_apply(spark: SparkSession, d: str) -> DataFrame:
    patch = table(spark, d, "customer").where("c_custkey % 7 = 0").select("c_custkey", F.lit("PATCHED").alias("c_mktsegment"))
    return integrity.patched(table(spark, d, "customer"), patch, "c_custkey", ["c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return integrity.digest(table(spark, d, "documents"), "doc_id", F.col("text"))


def page_digest(spark: SparkSession, d: str) -> DataFrame:
    return integrity.digest(table(spark, d, "pages"), "page_id", F.col("html"))


def lock_violations(spark: SparkSession, d: str) -> DataFrame:
    locked = integrity.digest(table(spark, d, "documents"), "doc_id", F.col("text")).select("doc_id", "digest")
    now = table(spark, d, "documents").where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text")))
    return integrity.lock_violations(locked, integrity.digest(now, "doc_id", F.col("text")).select("doc_id", "digest"), "doc_id")


def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = content_digest(spark, d).groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")
    return rows.select("first_id", "copies")


def set_equality(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    return integrity.set_difference(c, s).groupBy("nation", "only_in").agg(F.count("*").alias("n"))


def json_contract(spark: SparkSession, d: str) -> DataFrame:
    """Closed-schema parse of event properties: values, and keys that the schema doesn't know."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("k", LongType())])
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", schema)["k"].alias("k"), F.size(integrity.unknown_keys(F.col("props"), schema)).cast("long").alias("unknown"))


def allocate_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Items of an order share 60 000 ms by price; the last ends exactly at the end."""
    items = table(spark, d, "lineitem").withColumn("weight", F.bround("l_extendedprice").cast("long"))
    return alloc.proportional(items, "l_orderkey", _ORDER, "weight", 60_000).select("l_orderkey", "l_linenumber", "start", "stop")


def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").withColumn("length", F.bround(F.col("l_quantity") * 100).cast("long"))
    return alloc.offsets(items, "l_orderkey", _ORDER, "length").select("l_orderkey", "l_linenumber", "start", "stop")


def treatment_split(spark: SparkSession, d: str) -> DataFrame:
    """Each item becomes one to three windows; the last takes the exact remainder."""
    items = table(spark, d, "lineitem").withColumn("length", F.bround(F.col("l_quantity") * 100).cast("long"))
    states = F.when(F.col("l_returnflag") == "A", F.array(F.lit(50), F.lit(30), F.lit(20))).when(F.col("l_returnflag") == "R", F.array(F.lit(60), F.lit(40))).otherwise(F.array(F.lit(100)))
    return alloc.split_states(items, states, "length").select("l_orderkey", "l_linenumber", "state", "start", "stop")


def words_over_cue(spark: SparkSession, d: str) -> DataFrame:
    """The words of every turn spread over 1 000 ms by their length."""
    turns = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("cue"), "text")
    spread = alloc.words_over_cue(turns, "cue", F.col("text"), 1_000)
    return spread.select("cue.conv_id", "cue.turn", "pos", "start", "stop")


def scene_binning(spark: SparkSession, d: str) -> DataFrame:
    """Turns fill scenes of at most 400 characters, in order; a fold over each conversation."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("length"))
    return alloc.greedy_bins(turns, "conv_id", "turn", "length", 400)


QUERIES = {
    f.__name__: f
    for f in (
        preflight_issues, chain_issues, coverage_full_outer, disjoint_cover, patch_apply, content_digest, page_digest, lock_violations, duplicate_groups, set_equality, json_contract,
        allocate_timeline, running_offsets, treatment_split, words_over_cue, scene_binning,
    )
}

_W = "list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')"
ORACLES = {
    "preflight_issues": """with j as (select l_orderkey || '/' || l_linenumber as key, * from lineitem left join orders on l_orderkey = o_orderkey),
i as (select key, 'order missing' as issue from j where o_orderkey is null union all select key, 'shipped before ordered' from j where l_shipdate < o_orderdate union all select key, 'quantity out of range' from j where l_quantity < 1 or l_quantity > 45 union all select key, 'discount out of range' from j where l_discount > 0.09)
select issue, count(*) as n, min(key) as first_key from i group by 1""",
    "chain_issues": """with i as (select n_regionkey as key, 'nation without region' as issue from nation where n_regionkey not in (select r_regionkey from region)
union all select c_nationkey, 'customer without nation' from customer where c_nationkey not in (select n_nationkey from nation)
union all select o_custkey, 'order without solvent customer' from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)
union all select l_orderkey, 'item without settled order' from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')
union all select l_suppkey, 'item without solvent supplier' from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0))
select issue, count(*) as n, count(distinct key) as keys from i group by 1""",
    "coverage_full_outer": """with r as (select distinct doc_id as rk from documents), g as (select distinct doc_id + 3 as gk from labels)
select coalesce(rk, gk) as doc_id, case when gk is null then 'missing' else 'unknown' end as state from r full join g on rk = gk where rk is null or gk is null""",
    "disjoint_cover": "select l_partkey, count(distinct l_suppkey) as parts from lineitem group by 1 having count(distinct l_suppkey) > 1",
    "patch_apply": "select c_custkey, c_name, case when c_custkey % 7 = 0 then 'PATCHED' else c_mktsegment end as c_mktsegment from customer",
    "content_digest": "select doc_id, sha256(text) as digest, strlen(text) as size from documents",
    "page_digest": "select page_id, sha256(html) as digest, strlen(html) as size from pages",
    "lock_violations": "select doc_id, case when doc_id % 11 = 0 then 'missing' else 'changed' end as state from documents where doc_id % 11 = 0 or (doc_id % 5 = 0 and upper(text) <> text)",
    "duplicate_groups": "select min(doc_id) as first_id, count(*) as copies from documents group by text having count(*) > 1",
    "set_equality": """with c as (select c_nationkey as nation, count(*) as n from customer group by 1), s as (select s_nationkey as nation, count(*) as n from supplier group by 1), j as (select coalesce(c.nation, s.nation) as nation, coalesce(c.n, 0) as a, coalesce(s.n, 0) as b from c full join s on c.nation = s.nation)
select nation, case when a > b then 'left' else 'right' end as only_in, abs(a - b) as n from j where a <> b""",
    "json_contract": "select event_id, json_extract(props, '$.k')::bigint as k, len(list_filter(json_keys(props), lambda x: x <> 'k')) as unknown from events",
    "allocate_timeline": """with w as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, round_even(l_extendedprice, 0)::bigint as weight from lineitem), r as (select *, sum(weight) over (partition by l_orderkey order by {o})::bigint as upto, sum(weight) over (partition by l_orderkey)::bigint as total from w)
select l_orderkey, l_linenumber, (upto - weight) * 60000 // total as start, upto * 60000 // total as stop from r""",
    "running_offsets": "with w as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, round_even(l_quantity * 100, 0)::bigint as length from lineitem) select l_orderkey, l_linenumber, (sum(length) over w)::bigint - length as start, (sum(length) over w)::bigint as stop from w window w as (partition by l_orderkey order by {o})",
    "treatment_split": """with w as (select l_orderkey, l_linenumber, round_even(l_quantity * 100, 0)::bigint as length, case l_returnflag when 'A' then [50, 30, 20] when 'R' then [60, 40] else [100] end as s from lineitem),
e as (select *, unnest(s) as share, generate_subscripts(s, 1) - 1 as state from w), r as (select *, list_sum(s[1:state]) as before from e)
select l_orderkey, l_linenumber, state, (coalesce(before, 0) * length // 100)::bigint as start, (case when state + 1 = len(s) then length else (coalesce(before, 0) + share) * length // 100 end)::bigint as stop from r""",
    "words_over_cue": f"""with t as (select conv_id, turn, {_W} as w from conversations), e as (select conv_id, turn, generate_subscripts(w, 1) as i, length(unnest(w)) as n from t),
r as (select *, sum(n) over (partition by conv_id, turn order by i) as upto, sum(n) over (partition by conv_id, turn) as total from e)
select conv_id, turn, (i - 1)::int as pos, ((upto - n) * 1000 // total)::bigint as start, (upto * 1000 // total)::bigint as stop from r""",
    "scene_binning": """with recursive t as (select conv_id, turn, length(text) as length, row_number() over (partition by conv_id order by turn) as k from conversations),
f as (select conv_id, turn, k, length as filled, 0 as bin from t where k = 1 union all
select t.conv_id, t.turn, t.k, case when f.filled + t.length > 400 then t.length else f.filled + t.length end, case when f.filled + t.length > 400 then f.bin + 1 else f.bin end from f join t on t.conv_id = f.conv_id and t.k = f.k + 1)
select conv_id, turn, bin::int as bin from f""",
}
ORACLES |= {k: ORACLES[k].replace("{o}", ", ".join(_ORDER) + " rows unbounded preceding") for k in ("allocate_timeline", "running_offsets")}
