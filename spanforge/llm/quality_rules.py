"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every text is measured once; each measure gives an integer rate. Per language and source a
sketch counts the rates by logarithmic bucket (64 steps, then 32 a power of two: at most
3 % relative error). Sketches of such counts merge by addition, so they are built by
partial aggregation whatever a group's size, and the sketch of a language or of the whole
corpus is the sum of its parts.

No cutoff is a constant. A group's sketch is shrunk smoothly: to its own counts come those of
its language and of the corpus, each scaled to ``PRIOR`` documents, which decide for a group
of three documents and weigh nothing in one of a million. From that mixture a rate's fence is

- its 999th thousandth, or
- for rates of characters, whose junk forms a cluster of its own: where two octaves in a row
  above the third quartile hold under 1/1000 and what lies beyond them holds 1/200 or more,
  the middle (geometric) between the third quartile and the cluster's median. So a source of
  which up to a quarter is junk doesn't set its fence by its junk. Rates of words and lines
  have no such rule: one repeated line or window is the least there can be, so that low rates
  are empty by nature.

A document is past a fence when its count, less ``ERRORS`` standard errors of a count, still
is; short texts are not judged by a handful of characters. A document past any fence is
rejected, and so is one that fails the base rules of the contract.

Defined results: a null text has no words; texts with under ten words fail the base rules.
Null language or source is a group of its own. Rows are kept one for one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm.common import WORD, arrow_batches, cleared, published

#: Documents that the language's and the corpus's sketch each count for in a group's mixture.
PRIOR = 200
#: Weight of one document in a mixture: weights are integers.
UNIT = 1000
#: Standard errors of a count (its square root) that a document is given.
ERRORS = 2
#: Rates: count, base, unit of the rate, whether a cluster of junk is looked for.
RATES = {
    "symbol_rate": ("n_symbols", "word_chars", 1000, True),
    "dup_line_rate": ("n_dup_lines", "n_words", 1000, False),
    "repeat_rate": ("n_repeat_words", "n_words", 1000, False),
    "capital_rate": ("n_capitals", "word_chars", 1000, True),
    "word_length": ("word_chars", "n_words", 100, False),
}
#: Octaves of a rate of characters: thousandths.
OCTAVES = 10
#: Most (language, source) groups whose fences are broadcast; beyond, a join by group.
BROADCAST_GROUPS = 20_000
#: Documents of one group that one key of the join beyond takes.
ROWS_A_KEY = 1_000_000
_WORDS = re.compile(WORD).findall
_SPACES = np.array([9, 10, 11, 12, 13, 32])
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals"]


def repeated_words(words: list[str]) -> int:
    """Words inside 5-word windows that occur twice or more, first occurrences included."""
    n = len(words) - 4
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if len(seen) == len(words):
        return 0
    wide, code, span = len(seen), ids, len(ids)
    while wide**5 >= 1 << 62:  # number pairs of neighbours anew until five fit one integer
        pairs = ids[:-1] * wide + ids[1:]
        _, two = np.unique(pairs, return_inverse=True)
        wide2 = int(two.max()) + 1
        _, four = np.unique(two[:-2] * wide2 + two[2:], return_inverse=True)
        code = four[: span - 4] * wide + ids[4:]
        break
    else:
        code = (((ids[:n] * wide + ids[1 : n + 1]) * wide + ids[2 : n + 2]) * wide + ids[3 : n + 3]) * wide + ids[4 : n + 4]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + 5, -1)
    return int((np.cumsum(covered) > 0).sum())


def measure(text: str | None) -> list[int]:
    """The measures of one text, in the order of ``_MEASURES``."""
    if not text:
        return [0] * len(_MEASURES)
    words = _WORDS(text)
    h = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return [len(words), len(text) - int(h[_SPACES].sum()), int(h[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(words), int(h[65:91].sum())]


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the measures of every whole text."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [measure(t) for t in b.column(3).to_pylist()]
            yield pa.record_batch([*b.columns[:3], *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(_MEASURES)))], ["doc_id", "lang", "source", *_MEASURES])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    return source.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{m} long" for m in _MEASURES))


def rates() -> dict[str, Column]:
    """Integer rates: thousandths of word characters or words; word length in hundredths."""
    return {k: F.floor(unit * F.col(count) / F.greatest(F.col(base), F.lit(1))) for k, (count, base, unit, _) in RATES.items()}


def bucket(value: Column) -> Column:
    """Sketch bucket of a count: ``shift * 64 + value >> shift``, rising with the value."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return shift * 64 + F.floor(value / F.pow(F.lit(2), shift)).cast("long")


def bucket_top(key: Column) -> Column:
    """Largest value of a bucket."""
    return ((key % 64 + 1) * F.pow(F.lit(2), F.floor(key / 64)) - 1).cast("long")


def sketches(rows: DataFrame) -> DataFrame:
    """``lang, source, rate, bucket, n``: one row for each non-empty bucket of a group."""
    entries = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), bucket(v.cast("long")).alias("bucket")) for k, v in rates().items())))
    return rows.select("lang", "source", entries.alias("e")).groupBy("lang", "source", "e.rate", "e.bucket").agg(F.count("*").alias("n"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches added up to the given keys, with ``docs``, the documents of each."""
    summed = parts.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    return summed.withColumn("docs", F.sum("n").over(Window.partitionBy(*keys, "rate")))  # at most some hundred buckets each


def mixtures(parts: DataFrame) -> DataFrame:
    """``lang, source, rate, docs, e``: the shrunken sketch of each group, buckets ``top, w, upto`` in order."""
    scaled = lambda n, docs: F.expr(f"({PRIOR * UNIT} * {n}) div {docs}")
    of_all = merged(parts, []).select("rate", "bucket", scaled("n", "docs").alias("w_all"))
    of_lang = merged(parts, ["lang"]).select(F.col("lang").alias("l"), F.col("rate").alias("l_rate"), F.col("bucket").alias("l_bucket"), scaled("n", "docs").alias("w_lang"))
    own = parts.select(F.col("lang").alias("g"), F.col("source").alias("s"), F.col("rate").alias("g_rate"), F.col("bucket").alias("g_bucket"), F.col("n").alias("w_own"))
    groups = parts.groupBy("lang", "source", "rate").agg(F.sum("n").alias("docs"))
    # The corpus's sketch holds every bucket there is: 5 rates of some hundred buckets, whatever the data's size.
    grid = groups.join(F.broadcast(of_all), "rate")
    at = lambda p: (F.col("rate") == F.col(f"{p}_rate")) & (F.col("bucket") == F.col(f"{p}_bucket"))
    grid = grid.join(of_lang, F.col("lang").eqNullSafe(F.col("l")) & at("l"), "left")
    grid = grid.join(own, F.col("lang").eqNullSafe(F.col("g")) & F.col("source").eqNullSafe(F.col("s")) & at("g"), "left")
    weight = F.coalesce("w_own", F.lit(0)) * UNIT + F.coalesce("w_lang", F.lit(0)) + F.col("w_all")
    order = Window.partitionBy("lang", "source", "rate").orderBy("bucket")
    run = grid.select("lang", "source", "rate", "docs", "bucket", bucket_top(F.col("bucket")).alias("top"), weight.alias("w")).withColumn("upto", F.sum("w").over(order))
    return run.groupBy("lang", "source", "rate").agg(F.max("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("top", "w", "upto"))).alias("e"))


def fences(parts: DataFrame) -> DataFrame:
    """``lang, source, rate, docs, fence`` of each group."""
    first = lambda test: F.get(F.filter("e", test), F.lit(0))["top"]
    rows = mixtures(parts).withColumn("total", F.element_at("e", -1)["upto"])
    rows = rows.withColumns({"q75": first(lambda x: 4 * x["upto"] >= 3 * F.col("total")), "q999": first(lambda x: 1000 * x["upto"] >= 999 * F.col("total"))})
    octave = lambda v: F.when(v == 0, 0).otherwise(F.length(F.bin(v)))
    held = lambda test: F.aggregate(F.filter("e", test), F.lit(0).cast("long"), lambda a, x: a + x["w"])
    beyond = lambda k: held(lambda x: octave(x["top"]) > k + 1)
    empty = lambda k: 1000 * held(lambda x: (octave(x["top"]) == k) | (octave(x["top"]) == k + 1)) < F.col("total")
    valley = F.filter(F.transform(F.sequence(F.lit(1), F.lit(OCTAVES)), lambda k: F.struct(((k > octave(F.col("q75"))) & empty(k)).alias("low"), beyond(k).alias("far"))), lambda v: v["low"] & (200 * v["far"] >= F.col("total")))
    rows = rows.withColumn("far", F.when(F.col("rate").isin([k for k, x in RATES.items() if x[3]]), F.get(valley, F.lit(0))["far"]))
    cluster = first(lambda x: 2 * x["upto"] >= 2 * F.col("total") - F.col("far"))
    middle = F.floor(F.sqrt((F.col("q75") + 1) * (cluster + 1)))
    return rows.select("lang", "source", "rate", "docs", F.when(F.col("far").isNotNull(), middle).otherwise(F.col("q999")).cast("long").alias("fence"))


def group_fences(rows: DataFrame) -> DataFrame:
    """``g_lang, g_source, g_docs, g_fence`` (a map by rate) of every group."""
    with cleared(rows.sparkSession):
        found = fences(published(sketches(rows), "rate-sketches"))
        found = found.groupBy("lang", "source").agg(F.max("docs").alias("g_docs"), F.map_from_entries(F.collect_list(F.struct("rate", "fence"))).alias("g_fence"))
        return published(found.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "g_docs", "g_fence"), "rate-fences", keep=True)


def judge(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed``, ``failed_rates``, ``fences`` (in the order of RATES) and ``kept``."""
    rows = published(measured(docs), "rate-measures")
    limits = group_fences(rows)
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    if limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        found = rows.join(F.broadcast(limits.drop("g_docs")), same, "left")
    else:  # a group may hold a third of all rows: it is dealt over as many keys as its rows need
        keyed = limits.withColumn("keys", F.ceil(F.col("g_docs") / ROWS_A_KEY).cast("int"))
        large = keyed.where("keys > 1").select(F.col("g_lang").alias("h_lang"), F.col("g_source").alias("h_source"), F.col("keys").alias("of"))
        dealt = rows.join(F.broadcast(large), F.col("lang").eqNullSafe(F.col("h_lang")) & F.col("source").eqNullSafe(F.col("h_source")), "left")
        dealt = dealt.withColumn("key", F.pmod(F.xxhash64("doc_id", "n_words"), F.coalesce("of", F.lit(1))).cast("int"))
        found = dealt.join(keyed.withColumn("g_key", F.explode(F.sequence(F.lit(0), F.col("keys") - 1))), same & (F.col("key") == F.col("g_key")), "left")
    beyond = lambda k, count, base, unit: F.col(count) - ERRORS * F.sqrt(F.col(count)) > F.col("g_fence")[k] * F.col(base) / unit
    past = F.filter(F.array(*(F.when(beyond(k, *x[:3]), F.lit(k)) for k, x in RATES.items())), lambda x: x.isNotNull())
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stated = F.concat_ws(",", *(F.col("g_fence")[k].cast("string") for k in RATES))
    out = found.select("doc_id", *_MEASURES[:5], base.alias("base_failed"), F.array_join(past, ",").alias("failed_rates"), stated.alias("fences"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rates") == ""))
