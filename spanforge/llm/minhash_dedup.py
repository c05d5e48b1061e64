"""Near-duplicate documents by a signature-coordinate inverted join.

1. Each text becomes its set of 5-word shingles and a MinHash signature of ``COORDINATES``
   values. Texts with the same set form a class; only classes go on.
2. A class is posted under its coordinate-value pairs. Pairs held by one class alone can't
   collide; a class with fewer than ``min_matches`` others can't reach the match threshold
   and goes. The rest is posted under its rarest ``COORDINATES - min_matches + 1`` pairs
   (prefix principle: classes that agree in min_matches coordinates share one of these).
   No pairs are made: a posting list names its least class, the hub.
3. Collisions of each class with its hubs are counted; with the hub of most collisions, from
   the threshold on, it is compared on the full sets. So a group of n copies costs n rows, and
   nearly all of it is connected here.
4. Lists that share a class form families; linked classes lie in one family. A family all
   connected is done. In the others, classes outside the largest connected part meet all the
   rest: classes are cut into cells by size (linked sets lie in the same or the next cell) and
   cells into blocks of bounded bytes; a task gets two blocks, and none gets two blocks of
   the largest part. It merges posting lists: the short lists of a class's coordinates yield
   candidates, the long ones are only probed for these (skip merging), whatever is connected
   is skipped, and pairs from the threshold on are compared on the full sets. It returns a
   spanning forest of the links found.
5. Components of all links are groups of near duplicates.

The similarity from which texts are linked is a parameter; the threshold of matches, prefix
length and cells follow from it. The threshold is set where a pair of just that similarity
falls short with a chance below 1e-6; there is no cap on lists, candidates or partners.

Defined results: without words (or text) a document has an empty set and is linked with
nothing; with one to four words, the sequence is its one shingle. In ``near_duplicates`` rows
that share a doc_id are one node: what any of them is linked with, all are. ``without_copies``
looks at rows and not at ids: of each group of linked texts one row stays, the one of least
doc_id (then of least text digest), also where ids repeat with unlike texts. Rows with a null
doc_id are compared with nothing: component null, kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import WORD, arrow_batches, ascii_lower, cleared, packed, published, unpacked
from spanforge.llm.components import components

SHINGLE = 5
#: Links: 100 * |A and B| >= link * |A or B|; the link of op 7's contract.
LINK = 85
COORDINATES = 64
#: Most chance that a pair of similarity ``link`` agrees in fewer than min_matches coordinates.
MISS = 1e-6
#: Bytes of the sets of one block, about.
BLOCK_BYTES = 4 << 20
#: Sets of one block, at most about: the pairs of two blocks are what a task may have to look at.
BLOCK_ROWS = 500
#: Most ids in a broadcast; beyond, ids are joined by a shuffle.
BROADCAST_IDS = 500_000
_WORDS = re.compile(WORD).findall
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=8)
def min_matches(link: int) -> int:
    """The most matches that a pair of similarity ``link`` % misses with a chance below MISS."""
    share, below = link / 100, 0.0
    for k in range(COORDINATES):
        below += comb(COORDINATES, k) * share**k * (1 - share) ** (COORDINATES - k)
        if below >= MISS:
            return k
    return COORDINATES


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = _WORDS(ascii_lower(text)) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n, width = max(len(words) - SHINGLE + 1, 1), min(len(words), SHINGLE)
    code = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            code = _mixed(code * _STEP + h[k : k + n])
    return np.unique(code)


@lru_cache(maxsize=1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    return rng.integers(1, 1 << 62, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, COORDINATES, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of the set under each coordinate, as 32 bits."""
    a, b = _seeds()
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 4096):
            part = shingles[k : k + 4096]
            least = np.minimum(least, ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(1))
    return least.astype("<u4")


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, tkey, n_shingles, fp, sig`` of every row; tkey is a digest of the text, fp is null for an empty set."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for t in b.column(2).to_pylist()]
            fps = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sigs = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(map(len, sets), pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "tkey", "n_shingles", "fp", "sig"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(run, "doc_id long, tkey long, n_shingles long, fp binary, sig binary")


def _postings(classes: DataFrame) -> DataFrame:
    """``class, n, token``: each class under its coordinate-value pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinate = np.arange(COORDINATES, dtype=np.int64) << 32
        for b in batches:
            sigs = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, COORDINATES).astype(np.int64)
            yield pa.record_batch([pa.array(np.repeat(b.column(0).to_numpy(), COORDINATES), pa.int64()), pa.array((sigs | coordinate).ravel(), pa.int64())], ["class", "token"])

    return classes.select("class", "sig").mapInArrow(run, "class long, token long")


def families(classes: DataFrame, link: int = LINK) -> DataFrame:
    """``a, b``: each class that may be linked with another, under the hubs of its prefix."""
    matches = min_matches(link)
    posted = _postings(classes)
    shared = published(posted.groupBy("token").agg(F.count("*").alias("held"), F.min("class").alias("least")).where("held > 1"), "dedup-tokens")
    # Join back: a hot list is a skewed key of an inner join, which is split at run time.
    known = posted.join(shared, "token")
    ranked = known.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("held", "token", "least"))).alias("own")).where(F.size("own") >= matches)
    # The prefix holds COORDINATES - matches + 1 pairs, the rarest first; those held by
    # this class alone are the rarest of all and take up places.
    free = F.lit(COORDINATES - matches + 1) - (F.lit(COORDINATES) - F.size("own"))
    prefix = ranked.select("class", F.explode(F.slice("own", F.lit(1), F.greatest(free, F.lit(1)))).alias("p"))
    return published(prefix.select(F.col("p.least").alias("a"), F.col("class").alias("b")).distinct(), "dedup-stars")


def _joined(stars: DataFrame) -> DataFrame:
    found = components(stars)
    return found.select(F.col("node").alias("class"), F.col("root").alias("family")).unionByName(found.select(F.col("root").alias("class"), F.col("root").alias("family")).distinct())


def _hubs(stars: DataFrame, classes: DataFrame, link: int) -> DataFrame:
    """``a, b``: for each class ``b`` the hub of most collisions, if these reach the threshold."""
    matches = min_matches(link)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u4").reshape(-1, COORDINATES) for k in (2, 3))
            found = (left == right).sum(1)
            keep = pa.array(found >= matches)
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(found[found >= matches], pa.int64())], ["a", "b", "n"])

    sigs = classes.select("class", "sig")
    pairs = stars.where("a < b").join(sigs.select(F.col("class").alias("b"), F.col("sig").alias("right")), "b").join(sigs.select(F.col("class").alias("a"), F.col("sig").alias("left")), "a")
    counted = pairs.select("a", "b", "left", "right").mapInArrow(count, "a long, b long, n long")
    return counted.groupBy("b").agg(F.min(F.struct(-F.col("n"), "a")).alias("best")).select(F.col("best.a").alias("a"), "b")


def _cell(n, link: int):
    """Size cell: sets of similarity ``link`` % lie in the same or the next cell."""
    # a hair wider than the exact step, so that rounding never parts them by two cells
    return F.floor(F.log(n) / F.lit(float(np.log(100 / link)) * (1 + 1e-9))).cast("long")


def links_between(sets: list[np.ndarray], sigs: np.ndarray, side: np.ndarray, part: np.ndarray, link: int = LINK) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows not yet of one ``part``.

    ``side``: 0 and 1 for the rows of two blocks, or 2 for all of a block that meets itself.
    """
    matches = min_matches(link)
    sizes = np.array([len(s) for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    local = local.astype(np.int32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(local.max()) + 1, bool)
    # Posting lists of one side (of all rows, where a block meets itself), one array by token.
    posted = np.flatnonzero(side > 0)
    tokens = (sigs.astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)).reshape(len(sets), COORDINATES)
    flat = tokens[posted].ravel()
    order = np.argsort(flat, kind="stable")
    held, rows = flat[order], posted[order // COORDINATES]
    root, out = part.copy(), []
    for i in np.flatnonzero(side != 1).tolist():
        begin, end = np.searchsorted(held, tokens[i], "left"), np.searchsorted(held, tokens[i], "right")
        short = np.argsort(end - begin, kind="stable")[: COORDINATES - matches + 1]
        near = np.unique(np.concatenate([rows[begin[k] : end[k]] for k in short.tolist()]))
        near = near[root[near] != root[i]]
        if side[i] == 2:
            near = near[near > i]
        low, high = np.minimum(sizes[near], sizes[i]), np.maximum(sizes[near], sizes[i])
        near = near[100 * low >= link * high]
        near = near[(sigs[near] == sigs[i]).sum(1) >= matches]
        if not len(near):
            continue
        mark[local[bounds[i] : bounds[i + 1]]] = True
        at = np.concatenate([[0], np.cumsum(sizes[near])])
        common = np.add.reduceat(mark[np.concatenate([local[bounds[j] : bounds[j + 1]] for j in near])], at[:-1], dtype=np.int64)
        mark[local[bounds[i] : bounds[i + 1]]] = False
        for j in near[100 * common >= link * (sizes[near] + sizes[i] - common)].tolist():
            if root[i] != root[j]:
                out.append((i, j))
                root[root == root[j]] = root[i]
    return out


def _member_sets(members: DataFrame, docs: DataFrame) -> DataFrame:
    """``class, family, fp, n, raw, sig`` of each member, from the text of its representative row.

    ``members``: ``class, family, fp, rep``. A text that many rows repeat comes once a partition.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null").withColumn("tkey", F.xxhash64("text"))
    wanted = members.select("rep.doc_id", "rep.tkey", "class", "family", F.col("fp").alias("want"))
    picked = texts.join(_small(wanted), ["doc_id", "tkey"]).select("class", "family", "want", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            rows = []
            for key, family, want, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if want in seen:
                    continue
                own = shingle_set(text)
                raw = own.tobytes()
                if xxhash.xxh3_128_digest(raw) == want:
                    seen.add(want)
                    rows.append((key, family, want, len(own), raw, signature(own).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["class", "family", "fp", "n", "raw", "sig"])

    return published(picked.mapInArrow(sets, "class long, family long, fp binary, n long, raw binary, sig binary"), "dedup-sets")


def _hub_links(hubs: DataFrame, held: DataFrame, link: int) -> DataFrame:
    """``a, b`` (fingerprints): the classes linked with their hubs, on the full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= link * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    left = held.select(F.col("class").alias("a"), F.col("fp").alias("fp_a"), F.col("raw").alias("raw_a"))
    right = held.select(F.col("class").alias("b"), F.col("fp").alias("fp_b"), F.col("raw").alias("raw_b"))
    return published(hubs.join(right, "b").join(left, "a").select("fp_a", "fp_b", "raw_a", "raw_b").mapInArrow(compare, "a binary, b binary"), "dedup-hub-links")


def _small(table: DataFrame) -> DataFrame:
    """``table`` broadcast where it is small: its key may be a family that holds a third of all classes."""
    return F.broadcast(table) if table.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else table


def _other_links(held: DataFrame, part: DataFrame, link: int) -> DataFrame:
    """``a, b`` (fingerprints): links between classes of one family that hubs left apart."""
    facts = held.select("class", "family", "fp", "n").join(part, F.col("fp") == F.col("node"), "left").select("class", "family", "fp", "n", F.coalesce("root", "fp").alias("part")).distinct()
    facts = published(facts, "dedup-parts")
    size = facts.groupBy("family", "part").agg(F.count("*").alias("n")).groupBy("family").agg(F.count("*").alias("parts"), F.max(F.struct("n", "part")).alias("most"))
    split = published(size.where("parts > 1").select("family", F.col("most.part").alias("main")), "dedup-open")
    rows = facts.join(_small(split), "family").withColumn("rest", (F.col("part") != F.col("main")).cast("int"))
    celled = published(rows.withColumn("cell", _cell(F.col("n"), link)).drop("main"), "dedup-split")
    if celled.isEmpty():
        return celled.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    weight = lambda rest: F.ceil(F.sum(F.when(F.col("rest") == rest, F.greatest(F.col("n") * 8 + 4 * COORDINATES + 64, F.lit(BLOCK_BYTES // BLOCK_ROWS))).otherwise(0)) / BLOCK_BYTES).cast("int")
    blocks = celled.groupBy("family", "cell").agg(weight(1).alias("few"), weight(0).alias("many"))
    blocks = published(blocks, "dedup-blocks")
    above = blocks.select("family", (F.col("cell") - 1).alias("cell"), F.col("few").alias("few_up"), F.col("many").alias("many_up"))
    below = blocks.select("family", (F.col("cell") + 1).alias("cell"), F.col("few").alias("few_down"), F.col("many").alias("many_down"))
    plan = _small(published(blocks.join(above, ["family", "cell"], "left").join(below, ["family", "cell"], "left").na.fill(0), "dedup-plan"))
    # Blocks of a cell: those of the rest first, then those of the family's largest part.
    deal = F.xxhash64("class", "fp")
    own = F.when(F.col("rest") == 1, F.pmod(deal, F.col("few"))).otherwise(F.col("few") + F.pmod(deal, F.col("many"))).cast("int")
    dealt = celled.join(plan, ["family", "cell"]).withColumn("own", own)
    # Tasks (cell, lower block, upper cell's flag, upper block): a block of the rest with itself
    # and with every other of its cell and the cells beside it.
    task = lambda up, i, j, side: F.struct(F.lit(up).alias("up"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    none = F.expr("cast(array() as array<struct<up:int,i:int,j:int,side:int>>)")
    span = lambda few, many: F.when(F.when(F.col("rest") == 1, F.col(few) + F.col(many)).otherwise(F.col(few)) > 0, F.sequence(F.lit(0), F.when(F.col("rest") == 1, F.col(few) + F.col(many)).otherwise(F.col(few)) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    same = F.transform(span("few", "many"), lambda k: F.when(k == F.col("own"), task(0, k, k, 2)).when(k > F.col("own"), task(0, F.col("own"), k, 0)).otherwise(task(0, k, F.col("own"), 1)))
    upper = F.transform(span("few_up", "many_up"), lambda k: task(1, F.col("own"), k, 0))
    lower = F.transform(span("few_down", "many_down"), lambda k: task(1, k, F.col("own"), 1))
    spread = dealt.select("class", "fp", "part", "family", "cell", F.explode(F.concat(none, same, upper, lower)).alias("t"))
    spread = spread.select("family", F.when((F.col("t.up") == 1) & (F.col("t.side") == 1), F.col("cell") - 1).otherwise(F.col("cell")).alias("cell"), "t.up", "t.i", "t.j", "t.side", "class", "fp", "part")
    tasks = spread.join(held.select("class", "fp", "raw", "sig"), ["class", "fp"])

    def compare(table: pa.Table) -> pa.Table:
        found: list[tuple[bytes, bytes]] = []
        side = table.column("side").to_numpy()
        if len(side) > 1 and (side[0] == 2 or 0 < side.sum() < len(side)):
            fps, sets = table.column("fp").to_pylist(), [np.frombuffer(x, np.uint64) for x in table.column("raw").to_pylist()]
            sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u4").reshape(-1, COORDINATES)
            number: dict[bytes, int] = {}
            own = np.array([number.setdefault(x, len(number)) for x in table.column("part").to_pylist()])
            found = [(fps[i], fps[j]) for i, j in links_between(sets, sigs, side, own, link)]
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return published(tasks.groupBy("family", "cell", "up", "i", "j").applyInArrow(compare, "a binary, b binary"), "dedup-other-links")


def _linked(docs: DataFrame, link: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows ``doc_id, tkey, n_shingles, fp``, classes ``fp, class, rep, copies`` and links ``a, b``."""
    rows = published(sketched(docs), "dedup-sketches")
    some = rows.where("doc_id is not null and fp is not null")
    each = some.groupBy("fp").agg(F.min(F.struct("doc_id", "tkey")).alias("rep"), F.count("*").alias("copies"), F.min("sig").alias("sig"))
    # Classes go by 64 bits of their fingerprint; classes that share these only share candidates.
    classes = published(each.withColumn("class", F.xxhash64("fp")), "dedup-classes")
    stars = families(classes, link)
    hubs = published(_hubs(stars, classes, link), "dedup-hubs")
    held = _member_sets(published(classes.join(_joined(stars), "class").select("class", "family", "fp", "rep"), "dedup-members"), docs)
    near = _hub_links(hubs, held, link)
    return rows.drop("sig"), classes.drop("sig"), published(near.unionByName(_other_links(held, components(near), link)), "dedup-links")


def _named(rows: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """``rows`` with the columns of ``labels (fp, copies, ...)``: texts of very many copies by a broadcast."""
    hot = labels.where(F.col("copies") * 2000 > total).drop("copies")  # fewer than 2000 can be
    cold = labels.where(F.col("copies") * 2000 <= total).drop("copies")
    marked = rows.join(F.broadcast(hot.select("fp", F.lit(True).alias("is_hot"))), "fp", "left")
    return marked.where("is_hot").drop("is_hot").join(F.broadcast(hot), "fp").unionByName(marked.where("is_hot is null").drop("is_hot").join(cold, "fp", "left"))


def _grouped(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``fp, copies, rep``: the representative row of each class's group, the least of all its classes."""
    root = components(links)
    rooted = classes.join(root, F.col("fp") == F.col("node"), "left").select("fp", "copies", "rep", F.coalesce("root", "fp").alias("root"))
    # only roots of links have other classes: the rest need no second look
    heads = root.select("root").distinct()
    least = rooted.join(heads, "root", "left_semi").groupBy("root").agg(F.min("rep").alias("least"))
    return published(rooted.join(least, "root", "left").select("fp", "copies", F.coalesce("least", "rep").alias("rep")), "dedup-labels")


def near_duplicates(docs: DataFrame, link: int = LINK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; texts of similarity ``link`` % or more are linked."""
    with cleared(docs.sparkSession):
        rows, classes, links = _linked(docs, link)
        some = rows.where("doc_id is not null")
        # ids with several texts join their classes, and rows without words that share the id
        ids = some.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("fp").alias("filled"), F.min("fp").alias("low"), F.max("fp").alias("high"))
        ids = published(ids.where("filled > 0 and (filled < n or low <> high)").select("doc_id", "low", (F.col("low") != F.col("high")).alias("joins")), "dedup-repeated-ids")
        several = ids.where("joins").select("doc_id", "low")
        if not several.isEmpty():
            links = links.unionByName(some.where("fp is not null").join(several, "doc_id").select(F.col("low").alias("a"), F.col("fp").alias("b")).where("a <> b").distinct())
        labels = _grouped(classes, links).select("fp", "copies", F.col("rep.doc_id").alias("component_id"))
        lent = rows.where("fp is null").join(ids.select("doc_id", "low"), "doc_id").select("doc_id", "low").distinct().join(labels, F.col("low") == F.col("fp")).select("doc_id", F.col("component_id").alias("lent"))
        filled = _named(some.where("fp is not null").select("doc_id", "n_shingles", "fp"), labels, rows.count()).select("doc_id", "n_shingles", "component_id")
        empty = rows.where("fp is null or doc_id is null").select("doc_id", "n_shingles").join(lent, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("lent", "doc_id").alias("component_id"))
        whole = filled.unionByName(empty)
        return published(whole.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "dedup-result", keep=True)


def without_copies(docs: DataFrame, link: int = LINK) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each group stays, every other row goes."""
    with cleared(docs.sparkSession):
        rows, classes, links = _linked(docs, link)
        labels = _grouped(classes, links).select("fp", "copies", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tkey").alias("rep_key"))
        named = _named(rows.where("doc_id is not null and fp is not null").select("doc_id", "tkey", "fp"), labels, rows.count())
        stays = (F.col("doc_id") == F.col("rep_id")) & (F.col("tkey") == F.col("rep_key"))
        # a row that stays and is there several times over counts as its own copy
        keys = named.groupBy("doc_id", "tkey").agg(F.count("*").alias("n"), F.first(stays).alias("stays")).where("not stays or n > 1").select("doc_id", "tkey", "stays")
        keys = published(keys, "dedup-gone", keep=True)
    rows = packed(docs)
    same = (F.col("row.doc_id").cast("long") == F.col("doc_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("tkey"))
    left = rows.join(_small(keys), same, "left_anti")
    again = keys.where("stays")
    if not again.isEmpty():
        # Equal texts under one id: the row whose other columns come first as text stays.
        copies = rows.join(_small(again), same, "inner").groupBy("doc_id", "tkey")
        left = left.unionByName(copies.agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return unpacked(left, docs.columns)
