"""Card geometry: the text size that fits, line places and overflow, as arithmetic columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Theme:
    width: int = 1920
    height: int = 1080
    margin: int = 120
    advance: float = 0.6
    least: int = 12
    leading: float = 1.4


def fit_size(lines: Column, size: int, theme: Theme) -> Column:
    """Largest size up to the wanted one at which the longest line fits, never below the least."""
    longest = F.greatest(F.array_max(F.transform(lines, lambda x: F.length(x))), F.lit(1))
    return F.greatest(F.least(F.lit(size), F.floor((theme.width - 2 * theme.margin) / (longest * theme.advance)).cast("int")), F.lit(theme.least))


def layout(cards: DataFrame, theme: Theme = Theme(), size: int = 64) -> DataFrame:
    """``card_id, idx, text, x, y, size, overflows`` of each line. ``cards``: card_id, lines."""
    sized = cards.withColumn("size", fit_size(F.col("lines"), size, theme)).withColumn("n", F.size("lines"))
    rows = sized.select("card_id", "size", "n", F.posexplode("lines").alias("idx", "text"))
    step = F.col("size") * theme.leading
    y = F.floor((theme.height - F.col("n") * step) / 2 + F.col("idx") * step).cast("int")
    wide = F.length("text") * theme.advance * F.col("size")
    return rows.select("card_id", "idx", "text", F.lit(theme.margin).alias("x"), y.alias("y"), "size", (wide > theme.width - 2 * theme.margin).alias("overflows"))


def _rows(cards: DataFrame, *more: Column) -> DataFrame:
    return cards.select("card_id", F.size("lines").alias("n"), *more, F.posexplode("lines").alias("idx", "text"))


def mono(cards: DataFrame, top: int, theme: Theme = Theme(), size: int = 40) -> DataFrame:
    """``card_id, idx, text, x, y, size``: numbered lines of one width; the numbers take four places."""
    wide = F.transform("lines", lambda x: F.concat(F.lit("    "), x))
    rows = _rows(cards, fit_size(wide, size, theme).alias("size"))
    y = F.lit(top) + F.col("idx") * F.floor(F.col("size") * theme.leading)
    return rows.select("card_id", "idx", F.concat(F.format_string("%2d  ", F.col("idx") + 1), "text").alias("text"), F.lit(theme.margin).alias("x"), y.cast("int").alias("y"), "size")


def listed(cards: DataFrame, top: int, theme: Theme = Theme()) -> DataFrame:
    """``card_id, idx, text, x, y``: items spread evenly from the top to the lower margin."""
    step = F.floor((theme.height - theme.margin - top) / F.col("n"))
    return _rows(cards).select("card_id", "idx", F.concat(F.lit("• "), "text").alias("text"), F.lit(theme.margin + 40).alias("x"), (top + F.col("idx") * step).cast("int").alias("y"))


def chain(cards: DataFrame, theme: Theme = Theme(), gap: int = 40) -> DataFrame:
    """``card_id, idx, text, x, width, arrow``: boxes side by side."""
    step = F.floor((theme.width - 2 * theme.margin) / F.col("n"))
    return _rows(cards).select("card_id", "idx", "text", (theme.margin + F.col("idx") * step).cast("int").alias("x"), (step - gap).cast("int").alias("width"), (F.col("idx") < F.col("n") - 1).alias("arrow"))


def compare(cards: DataFrame, top: int, theme: Theme = Theme(), step: int = 90) -> DataFrame:
    """``card_id, idx, text, x, y, side``: two columns, the left one with the odd line."""
    half = F.floor((F.col("n") + 1) / 2)
    left = F.col("idx") < half
    place = F.when(left, F.col("idx")).otherwise(F.col("idx") - half)
    return _rows(cards).select("card_id", "idx", "text", F.when(left, theme.margin).otherwise(theme.width // 2 + 20).alias("x"), (top + place * step).cast("int").alias("y"), F.when(left, "left").otherwise("right").alias("side"))


def stat(figures: DataFrame, theme: Theme = Theme(), most: int = 300) -> DataFrame:
    """``card_id, text, x, y, size``: one figure in the middle. ``figures``: card_id, text."""
    size = F.least(F.lit(most), F.floor((theme.width - 2 * theme.margin) / (F.length("text") * theme.advance)).cast("int"))
    rows = figures.withColumn("size", size)
    x = F.floor((theme.width - F.length("text") * theme.advance * F.col("size")) / 2).cast("int")
    return rows.select("card_id", "text", x.alias("x"), F.floor(theme.height / 2 - F.col("size") / 2).cast("int").alias("y"), "size")


#: Kinds of cards and the keys that their records may have.
KINDS = ("statement", "mono", "list", "chain", "compare", "stat")
CARD_KEYS = ("kind", "lines", "title")


def card_of(payloads: DataFrame) -> DataFrame:
    """``card_id, kind, issue`` of JSON records with closed keys; the kind is null where it isn't known."""
    kind = F.get_json_object("payload", "$.kind")
    unknown = F.array_except(F.json_object_keys("payload"), F.array(*map(F.lit, CARD_KEYS)))
    known = F.coalesce(kind.isin(*KINDS), F.lit(False))
    issue = F.when(~known, "unknown kind").when(F.size(unknown) > 0, F.concat(F.lit("unknown key: "), F.array_join(unknown, ", ")))
    return payloads.select("card_id", F.when(known, kind).alias("kind"), issue.alias("issue"))
