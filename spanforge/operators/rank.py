"""Retrieval and ranking: terms, candidates, additive scores, refusals, top-k.

Requests and candidates meet on shared terms, never as a product of the two tables; every
request keeps a bounded number of candidates through a per-request row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.functions import text as T

#: Candidates of a request and attempts at acquiring one.
LIMIT, ATTEMPTS = 24, 6
WEIGHTS = {"query_match": 0.6, "length_fit": 0.25, "source_fit": 0.15}
FLOOR = 0.1


def sanitized(requests: DataFrame, text: Column, least: int = 2) -> DataFrame:
    """Ordered distinct content terms and whether there are enough."""
    return requests.withColumn("terms", T.content_terms(text)).withColumn("usable", F.size("terms") >= least)


def matches(requests: DataFrame, bags: DataFrame) -> DataFrame:
    """``req, cand, matched``: terms that a request shares with a candidate of its type.

    ``requests``: req, type, terms; ``bags``: cand, type, bag.
    """
    r = requests.select("req", "type", F.explode("terms").alias("term"))
    b = bags.select("cand", "type", F.explode("bag").alias("term"))
    return r.join(b, ["type", "term"]).groupBy("req", "cand").agg(F.count("*").alias("matched"))


def first_k(df: DataFrame, key: str, order: list[Column], k: int, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) <= k)


def with_fallback(requests: DataFrame, bags: DataFrame, hits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The first ``limit`` hits of each request; of its whole type where nothing overlaps.

    The fallback reads the first ``limit`` candidates of each type, not the type.
    """
    some = first_k(hits, "req", [F.col("cand").asc()], limit).select("req", "cand", "matched")
    none = requests.join(hits.select("req").distinct(), "req", "left_anti")
    heads = first_k(bags.select("type", "cand"), "type", [F.col("cand").asc()], limit)
    return some.unionByName(none.join(heads, "type").select("req", "cand", F.lit(0).cast("long").alias("matched")))


def scored(pairs: DataFrame) -> DataFrame:
    """Components and their sum. ``pairs`` has matched, n_terms, n_chars, needed, preferred."""
    share = F.col("matched") / F.greatest(F.col("n_terms"), F.lit(1))
    out = pairs.withColumns({
        "query_match": WEIGHTS["query_match"] * share,
        "length_fit": F.when(F.col("n_chars") >= F.col("needed"), WEIGHTS["length_fit"]).otherwise(WEIGHTS["length_fit"] * F.col("n_chars") / F.col("needed")),
        "source_fit": F.when(F.col("preferred"), WEIGHTS["source_fit"]).otherwise(0.0),
    })
    return out.withColumn("score", F.round(F.col("query_match") + F.col("length_fit") + F.col("source_fit"), 6))


def refusals(toxic: Column, n_chars: Column, family: Column) -> Column:
    """Reasons that exclude a candidate whatever its score, in order."""
    found = F.array(F.when(toxic == 1, "toxic"), F.when(n_chars < 50, "too short"), F.when(family == "symbols", "symbol noise"))
    return F.array_compact(found)


def family(text: Column) -> Column:
    """First family that fits, in fixed order."""
    return F.when(text.rlike(r"[#$%&*]{2}"), "symbols").when(text.contains("|"), "table").when(text.contains("!!"), "shouting").when(text.rlike("[0-9]{5}"), "numbers").otherwise("prose")


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """The k best admitted candidates of each request by (score desc, id)."""
    return first_k(pairs, "req", [F.desc("score"), F.col("cand").asc()], k, "rank")


def comparative(pairs: DataFrame, flagged: Column) -> DataFrame:
    """Refuse flagged candidates only while an unflagged one survives in the request."""
    clean = F.bool_or(~flagged).over(Window.partitionBy("req"))
    return pairs.withColumn("refused", flagged & clean)


def reuse_review(uses: DataFrame) -> DataFrame:
    """Members of a group that share two terms with its first member stay; others are peeled.

    ``uses``: grp, pos, terms.
    """
    anchor = uses.groupBy("grp").agg(F.min_by("terms", "pos").alias("anchor"))
    shared = F.size(F.array_intersect("terms", "anchor"))
    return uses.join(anchor, "grp").withColumn("keeps", (shared >= 2) | (F.col("pos") == 0))
