"""Benchmark decontamination by size-partitioned MinHash containment search.

Short items are searched inside long documents, so only the items are sketched: the sketch
of an item is the MinHash bottom-k of its 5-word shingles, and a document is asked which
coordinates it holds. Items are partitioned by their number of shingles n; a partition's
k is chosen so that a document with ``CONTAINMENT`` of the shingles of any of its items must
hold one of the k (at most n - ceil(0.8 n) may be missing), so the search loses nothing
however long the document is. Candidates are confirmed by exact shingle containment.

All of it is DataFrame expressions. A document's shingles are hashed in place and tested
against the sketch where the row is, so neither texts nor shingles are shuffled; only rows
with a hit go on. The sketch is a literal set while it is small (``LITERAL_COORDINATES``).
Beyond, it is cut by hash into parts of ``BROADCAST_COORDINATES`` at most; each is broadcast to
a pass over the documents, so a suite of any size is searched with bounded memory, and a
shingle that many documents share is no hot key of a shuffle.

Words are runs of non-blank characters, lower-cased. Defined results: an item with one to
four words is one shingle of that width; without words it is found nowhere. A null text
holds nothing. Rows that share a doc_id give one pair with the largest overlap among them;
repeated items (same item_id) are one item with the shingles of all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import WORD_JAVA, cleared, packed, published, unpacked

SHINGLE = 5
CONTAINMENT = 0.8
#: Most coordinates held as literals in the plan; beyond, they are broadcast in parts.
LITERAL_COORDINATES = 20_000
#: Coordinates of one part, about: a hash table of one long each.
BROADCAST_COORDINATES = 1_000_000
#: Most contaminated documents whose keys are broadcast to drop them.
BROADCAST_KEYS = 300_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_JAVA), lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once: a lambda's variable is never inlined again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(array: Column, width: int) -> Column:
    return F.when(F.size(array) >= width, F.sequence(F.lit(0), F.size(array) - width)).otherwise(F.expr("cast(array() as array<int>)"))


def _windows(words: Column, width: int) -> Column:
    """Shingles of a width as strings; none where there are fewer words."""
    return _let(words, lambda w: F.transform(_starts(w, width), lambda i: F.concat_ws(" ", F.slice(w, i + 1, width))))


def _hashes(words: Column, width: int) -> Column:
    """Shingle hashes of a width, made from the hashes of the words."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashed, lambda h: F.transform(_starts(h, width), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width)))))


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """``item_id, width, hash, shingle``: distinct shingles of each item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text").cast("string")).alias("words")).where(F.col("item_id").isNotNull() & (F.size("words") > 0))
    found = None
    for width in range(1, SHINGLE + 1):
        fits = items.where(F.size("words") == width) if width < SHINGLE else items.where(F.size("words") >= SHINGLE)
        each = fits.select("item_id", F.lit(width).alias("width"), F.explode(F.arrays_zip(_hashes(F.col("words"), width).alias("hash"), _windows(F.col("words"), width).alias("shingle"))).alias("s")).select("item_id", "width", "s.hash", "s.shingle")
        found = each if found is None else found.unionByName(each)
    return found.distinct()


def _least(n: Column) -> Column:
    """Shingles that a document must hold of an item with n: ceil(CONTAINMENT * n), exactly."""
    return F.ceil(F.lit(round(CONTAINMENT * 100)) * n / 100)


def sketch(shingles: DataFrame) -> DataFrame:
    """``width, hash``: bottom-k coordinates of the items, k by size partition.

    Partition p holds items with 2^p <= n < 2^(p+1) shingles; its k suits its largest n.
    """
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("hash", "width"))).alias("own"))
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    k = F.least((largest - _least(largest) + 1).cast("int"), F.size("own"))
    return sizes.select(F.explode(F.slice("own", F.lit(1), k)).alias("c")).select("c.width", "c.hash").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, row_key, item_id, n_shared, n_item``: rows that hold an item."""
    with cleared(docs.sparkSession):
        return published(_contaminated(docs, benchmark), "item-pairs", keep=True)


def _contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    shingles = published(item_shingles(benchmark), "items")
    coordinates = published(sketch(shingles), "item-sketch")
    widths = sorted(r["width"] for r in coordinates.select("width").distinct().collect())  # five at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    if not widths:
        return rows.select("doc_id", F.lit(0).cast("long").alias("row_key"), F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("n_shared"), F.lit(0).cast("long").alias("n_item")).where(F.lit(False))
    words = _words(F.col("text"))
    size = coordinates.count()
    if size <= LITERAL_COORDINATES:
        hits = F.lit(False)
        for width in widths:
            listed = [r["hash"] for r in coordinates.where(F.col("width") == width).select("hash").collect()]
            hits = hits | F.exists(_hashes(words, width), _among(listed))
        candidates = rows.where(hits)
    else:
        own = F.array_distinct(F.flatten(F.array(*(_hashes(words, w) for w in widths))))
        held = rows.select("doc_id", F.xxhash64("text").alias("row_key"), F.explode_outer(own).alias("hash"))
        keys, parts = None, -(-size // BROADCAST_COORDINATES)
        for part in range(parts):
            some = coordinates.where(F.pmod("hash", F.lit(parts)) == part).select("hash").distinct()
            found = held.join(F.broadcast(some), "hash", "left_semi").select(F.col("doc_id").alias("k_id"), F.col("row_key").alias("k_key"))
            keys = found if keys is None else keys.unionByName(found)
        keys = published(keys.distinct(), "item-hits")
        few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        candidates = rows.join(F.broadcast(keys) if few else keys, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.xxhash64("text") == F.col("k_key")), "left_semi")
    # Exact containment of the candidates: shingles as strings, every item it may hold. They
    # are made distinct before they become structs, whose comparison is quadratic.
    exact = F.flatten(F.array(*(F.transform(F.array_distinct(_windows(words, w)), _tagged(w, "shingle")) for w in widths)))
    # The outer form: an inner one infers a filter that computes these strings for every row.
    spread = candidates.select("doc_id", F.xxhash64("text").alias("row_key"), F.explode_outer(exact).alias("s")).select("doc_id", "row_key", "s.width", "s.shingle")
    totals = shingles.groupBy("item_id").agg(F.count("*").alias("n_item"))
    shared = spread.join(shingles.select("item_id", "width", "shingle"), ["width", "shingle"]).groupBy("doc_id", "row_key", "item_id").agg(F.countDistinct("width", "shingle").alias("n_shared"))
    return shared.join(totals, "item_id").where(F.col("n_shared") >= _least(F.col("n_item"))).select("doc_id", "row_key", "item_id", "n_shared", "n_item")


def _among(listed: list[int]) -> Callable[[Column], Column]:
    return lambda x: x.isin(listed)


def _tagged(width: int, name: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(width).alias("width"), x.alias(name))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment``: one row for each pair."""
    pairs = contaminated(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    return pairs.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with every column."""
    with cleared(docs.sparkSession):
        keys = published(contaminated(docs, benchmark).select("doc_id", "row_key").distinct(), "leaks", keep=True)
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("row_key"))
    return unpacked(packed(docs).join(F.broadcast(keys) if few else keys, same, "left_anti"), docs.columns)
