"""Near duplicates where ids repeat, families that hubs leave apart, and tables left behind."""

import os
import random
import re

import numpy as np
import pytest
from spanforge.llm import common, minhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, tkey string, rep string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)


def _grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", minhash_dedup.ascii_lower(text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def _groups(rows, link, by_id):
    """Group number of each row, over all pairs of rows."""
    sets, group = [_grams(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            near = rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= link * len(sets[a] | sets[b])
            if near or (by_id and rows[a][0] is not None and rows[a][0] == rows[b][0]):
                group = [group[b] if g == group[a] else g for g in group]
    return group


def _check(spark, rows, link):
    by_id = _groups(rows, link, True)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash_dedup.near_duplicates(_docs(spark, rows), link).collect())
    want = []
    for (i, t), g in zip(rows, by_id, strict=True):
        root = None if i is None else min(j for (j, _), h in zip(rows, by_id, strict=True) if h == g)
        want.append((str(i), len(_grams(t)), str(root), i is None or i == root))
    assert got == sorted(want)
    by_text = _groups(rows, link, False)
    left = minhash_dedup.without_copies(_docs(spark, rows), link)
    assert left.columns == _docs(spark, rows).columns
    left = [(r.doc_id, r.text) for r in left.collect()]
    assert all(x in rows for x in left)
    loose = sorted((str(i), str(t)) for i, t in rows if i is None or not _grams(t))
    assert sorted((str(i), str(t)) for i, t in left if i is None or not _grams(t)) == loose
    kept = [by_text[rows.index(x)] for x in left if x[0] is not None and _grams(x[1])]
    every = {g for (i, t), g in zip(rows, by_text, strict=True) if i is not None and _grams(t)}
    assert len(kept) == len(set(kept)) and set(kept) == every


def test_ids_with_several_texts(spark):
    a, b, z = (" ".join(f"{x}{k}" for k in range(30)) for x in "abz")
    _check(spark, [(3, a), (5, a), (5, b), (9, b), (9, z), (None, a), (9, ""), (11, None), (11, a), (12, ""), (12, ""), (3, a)], 85)


def test_repeated_ids_at_random(spark):
    rng, rows = random.Random(3), []
    for _ in range(25):
        words = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        for _ in range(rng.randrange(1, 6)):
            own = list(words)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(90)] = f"e{rng.randrange(10**6)}"
            rows.append((rng.randrange(80), " ".join(own)))
    _check(spark, rows, 80)


def test_families_that_hubs_leave_apart(spark, monkeypatch):
    """Chains of small steps: a family's ends are far from its hub and from one another."""
    rng, rows, key = random.Random(8), [], 0
    for _ in range(3):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for step in range(40):
            if step % 13 != 12:
                rows.append((key, " ".join(words)))
            key += 1
            words[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(k, rows[o][1]) for k, o in enumerate(order)]
    for size in (minhash_dedup.BLOCK_BYTES, 4_000):
        monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", size)
        _check(spark, rows, 85)


def test_merged_lists_find_every_link():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(12):
        base = rng.integers(1, 1 << 60, 150).astype(np.uint64)
        for _ in range(8):
            own = base.copy()
            own[rng.integers(0, 150, rng.integers(0, 20))] = rng.integers(1, 1 << 60, 1).astype(np.uint64)
            sets.append(np.unique(own))
    sigs = np.array([minhash_dedup.signature(s) for s in sets])
    linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))
    for side in (np.full(len(sets), 2), np.arange(len(sets)) % 2):
        found = minhash_dedup.links_between(sets, sigs, side, np.arange(len(sets)))
        assert all(linked(i, j) and side[i] != 1 and side[j] != 0 for i, j in found)
        root = list(range(len(sets)))
        for i, j in found:
            root = [root[i] if r == root[j] else r for r in root]
        assert len(found) == len(sets) - len(set(root))
        assert all(root[i] == root[j] for i in range(len(sets)) for j in range(len(sets)) if i != j and side[i] != 1 and side[j] > 0 and linked(i, j))


def test_intermediate_tables_are_deleted(spark):
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    text = " ".join(f"t{k}" for k in range(50))
    found = minhash_dedup.near_duplicates(_docs(spark, [(1, text), (2, text + " more"), (3, "other words")]))
    made = set(os.listdir(folder)) - before
    assert len(made) == 1 and next(iter(made)).startswith("dedup-result") and found.count() == 3
    minhash_dedup.without_copies(_docs(spark, [(1, text), (2, text + " more")])).count()
    assert {x.split("-")[1] for x in set(os.listdir(folder)) - before} == {"result", "gone"}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, other):
            return other

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
