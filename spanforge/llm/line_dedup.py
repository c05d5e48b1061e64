"""Line dedup by site-relative frequency.

A line is boilerplate of a host where more than ``RATIO`` of the host's pages hold it, and
at least ``MIN_PAGES`` do; it is dropped from every page of the host. A page is a distinct
text of its host: rows that repeat a text are one page fetched again, so that copies of a
page don't make boilerplate of it and are left for near-duplicate removal.

Pages are made distinct by (host, text digest) and lines counted by (host, line digest), both
with partial aggregation, so a host, a page or a line with a third of all rows costs each
task its own part only. A host has at most (mean lines a page) / RATIO such lines, so its
list is short; lists go to the pages by a broadcast where all of them together are small.
Beyond, they are joined by host, and a host of very many rows is dealt over as many keys as
its rows need. Texts are rewritten in place: on the broadcast way none is ever shuffled.

Lines are compared without blanks, tabs and carriage returns at their ends; blank lines are
never counted nor dropped.

Defined results: a null text stays null, holds no lines and is no page; a text that is
nothing but boilerplate becomes empty. A null host is a host of its own. Rows are kept one
for one. All other columns are returned as they are; ``n_chars``, where present and stated,
becomes the length of a text that changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import cleared, packed, published

RATIO = 0.01
MIN_PAGES = 5
#: Most listed lines, of all hosts, for a broadcast.
BROADCAST_LINES = 200_000
#: Rows of one host that one key of the join beyond takes.
ROWS_A_KEY = 1_000_000
_ENDS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_ENDS))


def boilerplate(docs: DataFrame, host: str, text: str) -> DataFrame:
    """``host, bad, keys``: for each host with any, the digests of its boilerplate lines; keys: of the join."""
    rows = docs.select(F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    held = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("text")), _bare), lambda x: x != ""), lambda x: F.xxhash64(x)))
    each = rows.select("host", F.xxhash64("text").alias("page"), held.alias("lines")).groupBy("host", "page").agg(F.first("lines").alias("lines"), F.count("*").alias("n"))
    with cleared(docs.sparkSession):
        pages = published(each, "pages")
        # The outer form: an inner one infers a filter that computes the array once more.
        lines = pages.select("host", F.explode_outer("lines").alias("line")).where(F.col("line").isNotNull())
        counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
        sizes = pages.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("pages"), F.sum("n").alias("rows"))
        over = counts.join(sizes, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > RATIO * F.col("pages"))
        keys = F.ceil(F.max("rows") / ROWS_A_KEY).cast("int")
        return published(over.groupBy("host").agg(F.array_sort(F.collect_list("line")).alias("bad"), keys.alias("keys")), "boilerplate", keep=True)


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", report: bool = False) -> DataFrame:
    """``docs`` without boilerplate lines; with ``report``, also n_lines and n_dropped."""
    lists = boilerplate(docs, host, text)
    old = F.col("row").getField(text)
    rows = packed(docs).withColumn("of", F.col("row").getField(host).cast("string"))
    same = F.col("of").eqNullSafe(F.col("host"))
    if (lists.agg(F.sum(F.size("bad"))).first()[0] or 0) <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(lists.select("host", "bad")), same, "left")
    else:
        # Hosts with more than one key are few: rows of the whole table / ROWS_A_KEY at most.
        large = lists.where("keys > 1").select(F.col("host").alias("large"), F.col("keys").alias("of_keys"))
        dealt = rows.join(F.broadcast(large), F.col("of").eqNullSafe(F.col("large")), "left")
        dealt = dealt.withColumn("of_key", F.pmod(F.xxhash64(old), F.coalesce("of_keys", F.lit(1))).cast("int"))
        spread = lists.withColumn("key", F.explode(F.sequence(F.lit(0), F.col("keys") - 1)))
        joined = dealt.join(spread, same & (F.col("of_key") == F.col("key")), "left")
    listed = lambda x: F.coalesce(F.array_contains(F.col("bad"), F.xxhash64(_bare(x))), F.lit(False))
    # One pass marks the lines; the rest reads the marks.
    marks = F.transform(_lines(old.cast("string")), lambda x: F.struct(x.alias("s"), (F.col("bad").isNotNull() & listed(x)).alias("b"), (F.length(_bare(x)) > 0).alias("f")))
    marked = joined.withColumn("lines", marks)
    kept = F.array_join(F.transform(F.filter("lines", lambda x: ~x["b"]), lambda x: x["s"]), "\n")
    out = marked.withColumn("new", F.when(F.col("bad").isNull() | F.col("lines").isNull(), old).otherwise(kept))
    found = [F.col("new").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    if "n_chars" in docs.columns:
        n = F.col("row").getField("n_chars")
        changed = n.isNotNull() & (F.col("new") != old)
        found[docs.columns.index("n_chars")] = F.when(changed, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(n).alias("n_chars")
    if report:
        count = lambda key: F.when(F.col("lines").isNull(), 0).otherwise(F.size(F.filter("lines", lambda x: x[key]))).cast("long")
        found += [count("f").alias("n_lines"), count("b").alias("n_dropped")]
    return out.select(*found)
