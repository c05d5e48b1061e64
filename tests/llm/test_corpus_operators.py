"""Near-duplicates, decontamination, URL filter, components and the pipeline."""

import random
import re
from collections import defaultdict

import pytest
from spanforge.llm import components, decontaminate, minhash_dedup, queries, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, n int, fp string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, "x") for i, t in rows], SCHEMA).repartition(3)


def _components(rows):
    """Brute force over all pairs of whole shingle sets; rows that share an id are one node."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", minhash_dedup.ascii_lower(t or ""))
        sets.append((i, frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])))
    up = {i: i for i, _ in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def _edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE\ttwo"), (5, "one"), (6, "one two three four five"), (7, "One two three four five")]
    key = 10
    for size in (60, 140, 400):
        base = [f"w{rng.randrange(300)}" for _ in range(size)]
        for _ in range(45):  # near copies at all distances
            rows.append((key, " ".join(_edited(rng, base, rng.randrange(8)))))
            key += 1
        for _ in range(10):  # longer texts that hold it
            rows.append((key, " ".join(base + [f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(40))])))
            key += 1
    rows += [(key + k, "the same text stands here several times over") for k in range(30)]
    rows += [(key + 40 + k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(80))) for k in range(30)]
    rng.shuffle(rows)
    return rows


def test_near_duplicates_by_brute_force(spark, corpus, monkeypatch):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(_docs(spark, corpus)).collect())
    assert got == _components(corpus)
    monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", 5_000)  # many blocks and cells
    monkeypatch.setattr(minhash_dedup, "BROADCAST_IDS", 0)
    again = minhash_dedup.near_duplicates(_docs(spark, corpus)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in again) == got
    assert all(r.kept == (r.doc_id == r.component_id) for r in again)


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"l{k}" for k in range(25_000))
    rows = [(1, long), (2, long + " more"), (3, None), (None, long), (4, "a b"), (4, "a b"), (5, ""), (6, "")]
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash_dedup.near_duplicates(_docs(spark, rows)).collect()}
    assert found[1, 24_996] == (1, True) and found[2, 24_997] == (1, False) and found[None, 24_996] == (None, True)
    assert found[5, 0] == (5, True) and found[6, 0] == (6, True) and found[3, 0] == (3, True) and found[4, 1] == (4, True)
    left = minhash_dedup.without_copies(_docs(spark, rows))
    assert left.columns == _docs(spark, rows).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "4", "5", "6", "None"]
    assert minhash_dedup.near_duplicates(_docs(spark, rows).where("false")).count() == 0


def test_components_of_a_path(spark):
    order = list(range(60))
    random.Random(2).shuffle(order)
    edges = [*zip(order, order[1:], strict=False), (100, 101), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 60)}, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _leaks(rows, items):
    def grams(t, width):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}, w

    out = set()
    for i, t in rows:
        for j, item in items:
            _, w = grams(item, 5)
            width = min(5, len(w))
            if not width or j is None or t is None:
                continue
            a, b = grams(item, width)[0], grams(t, width)[0]
            if 100 * len(a & b) >= 80 * len(a):
                out.add((i, j, len(a & b), len(a)))
    return out


def test_decontamination_by_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    items = [(k, " ".join(f"b{rng.randrange(400)}" for _ in range(n))) for k, n in enumerate((1, 3, 5, 6, 9, 20, 33, 40, 70))] + [(50, ""), (51, None), (None, "b1 b2 b3 b4 b5")]
    rows = [(0, None), (1, ""), (2, "b1"), (None, items[6][1])]
    for k in range(60):
        item = items[rng.randrange(9)][1].split()
        edits = _edited(rng, item, rng.randrange(4)) if len(item) > 5 else item
        rows.append((10 + k, " ".join([f"f{rng.randrange(999)}" for _ in range(rng.randrange(300))] + edits + ["Tail", "words"]).upper()))
    rows.append((200, " ".join(f"z{k}" for k in range(20_000)) + " " + items[8][1]))
    bench = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, doc_id string")
    want = _leaks(rows, items)
    for literal, part, keys in ((decontaminate.LITERAL_COORDINATES, 10, 10), (0, 10**6, 10**6), (0, 17, 0)):
        for name, limit in zip(("LITERAL_COORDINATES", "BROADCAST_COORDINATES", "BROADCAST_KEYS"), (literal, part, keys), strict=True):
            monkeypatch.setattr(decontaminate, name, limit)
        got = decontaminate.leaks(_docs(spark, rows), bench).collect()
        assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got} == want
    left = decontaminate.without_leaks(_docs(spark, rows), bench)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in rows} - {i for i, *_ in want}
    assert left.columns == _docs(spark, rows).columns
    assert decontaminate.leaks(_docs(spark, rows), bench.where("false")).count() == 0
    assert decontaminate.leaks(_docs(spark, rows).where("false"), bench).count() == 0


def _rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    fits = [r for _, r in url_filter.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    rule = max(fits, key=len, default=None)
    return host, path, rule, dict((r, v) for v, r in url_filter.RULES).get(rule)


def test_url_rules_by_brute_force(spark):
    urls = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://a.example.com/en", "http://example.com/en/x", "x://net/es/", "x://a.net/fr/q", "x://a.net/de/", "x://com", "x://com/", "http://ÀB.com/é", "a://b://c.com/d", "http://h.org/en/\nline", "http://xcom/"]
    urls += [f"http://s{k}.example.{t}/{p}/{k}.html" for k in range(40) for t, p in (("com", "de"), ("com", "en"), ("net", "fr"), ("org", "es"))]
    pages = spark.createDataFrame([(None if k == 3 else k, u, "h", 0.1) for k, u in enumerate(urls)] + [(1000, "x://a.com/", "h", 0.1)] * 3, "page_id long, url string, html string, score double")
    rows = url_filter.judge(pages).collect()
    assert len(rows) == len(urls) + 3
    for r in rows:
        url = urls[3] if r.page_id is None else "x://a.com/" if r.page_id == 1000 else urls[r.page_id]
        host, path, rule, verdict = _rule(url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert {r.verdict for r in url_filter.judge(pages.where("page_id = 9")).collect()} == {"allow"}
    assert url_filter.judge(pages.where("false")).count() == 0


def test_url_ratio_learns(spark):
    """Unruled hosts follow the class that their path resembles."""
    rows = [(k, f"http://good{k}.com/articles/science/{k}") for k in range(150)] + [(500 + k, f"http://bad{k}.net/es/casino-bonus/{k}") for k in range(150)]
    rows += [(2000 + k, f"http://u{k}.org/articles/science/{k}") for k in range(20)] + [(3000 + k, f"http://u{k}.org/es/casino-bonus/{k}") for k in range(20)]
    found = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(found[2000 + k] == "allow" and found[3000 + k] == "block" for k in range(20))


def test_pipeline_stages_compose(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, d)
        assert kept.columns == docs.columns, name
        sizes.append(kept.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] == sizes[2] > sizes[3]
    out = corpus_pipeline.run(spark, d)
    assert out.count() == sizes[-1]


def test_queries_are_the_ten():
    assert [int(k[2:].split("_")[0]) for k in queries.queries()] == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def _ratios(pages):
    """Mean log ratio of each URL by the definition, with plain dictionaries."""
    import math
    from collections import Counter
    from zlib import crc32

    def grams(url):
        host, path, *_ = _rule(url)
        text = re.sub(r"[^a-z0./\-]", "?", re.sub("[0-9]", "0", (host + path).lower()))
        s = [0, 0, 0] + [url_filter.ALPHABET.index(c) + 1 for c in text]
        return [tuple(s[i : i + 4]) for i in range(len(s) - 3)]

    seen = {"allow": Counter(), "block": Counter()}
    for _, url in pages:
        host, path, _, verdict = _rule(url)
        if verdict and crc32((host + path).encode()) % 4:
            seen[verdict].update(g[-k:] for g in grams(url) for k in (1, 2, 3, 4))
    after = {v: {} for v in seen}
    for v, counts in seen.items():
        for g, n in counts.items():
            t, d = after[v].get((len(g), g[:-1]), (0, 0))
            after[v][len(g), g[:-1]] = t + n, d + 1

    def chance(v, g):
        lower = chance(v, g[1:]) if len(g) > 1 else 1 / 32
        t, d = after[v].get((len(g), g[:-1]), (0, 0))
        return (seen[v][g] + d * lower) / (t + d) if t else lower

    def ratio(g):
        known = next((g[-k:] for k in (4, 3, 2, 1) if any(g[-k:] in c for c in seen.values())), None)
        return math.log(chance("allow", known) / chance("block", known)) if known else 0.0

    return {k: sum(map(ratio, grams(u))) / len(grams(u)) for k, u in pages}


def test_url_ratio_by_brute_force(spark):
    rng = random.Random(6)
    pages = [(k, f"http://{rng.choice(['a', 'bb', 'c-c'])}{rng.randrange(9)}.example.{t}/{p}/{rng.randrange(999)}_x") for k in range(120) for t, p in [rng.choice([("com", "de"), ("com", "en"), ("net", "fr"), ("org", "es"), ("org", "é~q")])]]
    got = {r.page_id: r.score for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    want = _ratios(pages)
    assert all(abs((got[k] - got[0]) - (want[k] - want[0])) < 1e-6 for k in got)
