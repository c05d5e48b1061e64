"""Contracts, coverage and lineage across linked tables: issue rows, never silent repairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def issues(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """``key, issue`` for every rule that a row breaks; a rule is true where it is broken."""
    found = F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items()))))
    return df.select(key.cast("string").alias("key"), found.alias("issue"))


def orphans(left: DataFrame, right: DataFrame, on: str, to: str, issue: str) -> DataFrame:
    """Rows whose reference leads nowhere."""
    return left.join(right.select(F.col(to).alias("__to")), F.col(on) == F.col("__to"), "left_anti").select(F.col(on).cast("string").alias("key"), F.lit(issue).alias("issue"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def coverage(required: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Full outer: what is required and missing, and what is given and unknown."""
    r, g = required.select(F.col(key).alias("rk")).distinct(), given.select(F.col(key).alias("gk")).distinct()
    both = r.join(g, F.col("rk") == F.col("gk"), "full_outer")
    return both.where("rk is null or gk is null").select(F.coalesce("rk", "gk").alias(key), F.when(F.col("gk").isNull(), "missing").otherwise("unknown").alias("state"))


def shared_members(parts: DataFrame, member: str) -> DataFrame:
    """Members that lie in more than one part: a cover that isn't disjoint."""
    return parts.groupBy(member).agg(F.count("*").alias("parts")).where("parts > 1")


def patched(base: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Only named fields of named rows change: a left join and coalesce."""
    p = patch.select(F.col(key).alias("__k"), *(F.col(f).alias(f"__{f}") for f in fields))
    out = base.join(p, F.col(key) == F.col("__k"), "left")
    return out.select(*(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns))


def digest(df: DataFrame, key: str, content: Column) -> DataFrame:
    return df.select(key, F.sha2(content, 256).alias("digest"), F.octet_length(content).cast("long").alias("size"))


def lock_violations(locked: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Locked rows that are gone or have changed."""
    n = now.select(F.col(key).alias("__k"), F.col("digest").alias("now_digest"))
    joined = locked.join(n, F.col(key) == F.col("__k"), "left")
    state = F.when(F.col("now_digest").isNull(), "missing").when(F.col("now_digest") != F.col("digest"), "changed")
    return joined.select(key, state.alias("state")).where("state is not null")


def canonical(columns: list[str]) -> Column:
    """JSON with sorted keys, the form that digests are taken of."""
    return F.to_json(F.struct(*sorted(columns)))


def unknown_keys(json: Column, schema: StructType) -> Column:
    """Keys of a JSON object that the closed schema doesn't know."""
    return F.array_except(F.json_object_keys(json), F.array(*map(F.lit, schema.fieldNames())))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two-way multiset difference with the side that a row is only in."""
    return left.exceptAll(right).withColumn("only_in", F.lit("left")).unionByName(right.exceptAll(left).withColumn("only_in", F.lit("right")))
