"""The plan grammar: an ordered list of operations, checked by one expression per rule.

A plan is ``plan_id, operations array<struct<kind, source, start, stop, parameters>>``:
clips first, then optional layers in a fixed order, each at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layers in the order in which they may follow the clips.
LAYERS = ("narration", "captions", "text_events", "motion_text", "direction", "music", "fade")
ORDER = "^(?:clip )+" + "".join(f"(?:{x} )?" for x in LAYERS) + "$"
#: Bounds of numeric parameters.
RANGES = {"music": ("gain_db", -60.0, 12.0), "fade": ("seconds", 0.0, 10.0), "direction": ("intensity", 0.0, 1.0)}


def follows_order(operations: Column) -> Column:
    kinds = F.array_join(F.transform(operations, lambda o: F.concat(o["kind"], F.lit(" "))), "")
    return F.rlike(kinds, F.lit(ORDER))


def duration(operation: Column) -> Column:
    return F.coalesce(operation["stop"] - operation["start"], F.get_json_object(operation["parameters"], "$.duration").try_cast("double"))


def total(operations: Column) -> Column:
    return F.aggregate(F.filter(operations, lambda o: o["kind"] == "clip"), F.lit(0.0), lambda a, o: a + F.coalesce(duration(o), F.lit(0.0)))


def plan_issues(plans: DataFrame) -> DataFrame:
    """``plan_id, issue``: order, empty clips and parameters out of range."""
    ops = F.col("operations")
    found = [
        F.when(~follows_order(ops), "order"),
        F.when(F.exists(ops, lambda o: (o["kind"] == "clip") & (F.coalesce(duration(o), F.lit(0.0)) <= 0)), "empty clip"),
        F.when(F.exists(ops, lambda o: (o["kind"] == "clip") & o["source"].isNull()), "clip without source"),
    ]
    for kind, (name, low, high) in RANGES.items():
        found.append(F.when(F.exists(ops, _outside(kind, name, low, high)), f"{kind}.{name} out of range"))
    return plans.select("plan_id", F.explode(F.array_compact(F.array(*found))).alias("issue"))


def _outside(kind: str, name: str, low: float, high: float):
    value = lambda o: F.get_json_object(o["parameters"], f"$.{name}").try_cast("double")
    return lambda o: (o["kind"] == kind) & (value(o).isNull() | (value(o) < low) | (value(o) > high))


def clips(plans: DataFrame) -> DataFrame:
    """Clips with their place on the plan's timeline."""
    from pyspark.sql.window import Window

    rows = plans.select("plan_id", F.posexplode("operations").alias("pos", "o")).where("o.kind = 'clip'").withColumn("length", duration(F.col("o")))
    upto = F.sum("length").over(Window.partitionBy("plan_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("plan_id", "pos", F.col("o.source").alias("source"), (upto - F.col("length")).alias("at"), "length")
