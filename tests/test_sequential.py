"""Sequential decisions against their plain definitions, over whole lists of a key's rows."""

import difflib
import random
from collections import Counter

from spanforge.operators import sequential


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_repetition_by_definition(spark):
    rng = random.Random(1)
    rows = [(d, i, " ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randrange(9)))) for d in range(6) for i in range(40)]
    want = []
    for d in range(6):
        own = [t.split() for k, _, t in rows if k == d]
        for i, a in enumerate(own):
            best = None
            for j in range(max(0, i - 8), i):
                b = own[j]
                if len(a) < 3 or len(b) < 3:
                    continue
                x, y = Counter(a), Counter(b)
                cosine = sum(n * y[w] for w, n in x.items()) / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5
                ratio = difflib.SequenceMatcher(None, b, a, autojunk=False).ratio()
                if best is None or max(cosine, ratio) > best[0]:
                    best = (max(cosine, ratio), min(cosine, ratio), j)
            if best and best[0] >= 0.60:
                want.append((d, best[2] if best[1] >= 0.85 else i, "CUT" if best[1] >= 0.85 else "REVIEW", round(best[0], 5)))
    got = sequential.streamed(_rows(spark, rows, "doc_id long, idx long, tokens string"), "doc_id", ["idx"], sequential.repetition, "doc_id long, idx long, suggestion string, similarity double")
    got = [(r.doc_id, r.idx, r.suggestion, round(r.similarity, 5)) for r in got.collect()]
    assert Counter(x[:3] for x in got) == Counter(x[:3] for x in want)
    assert all(abs(a - b) < 1e-4 for a, b in zip(sorted(x[3] for x in got), sorted(x[3] for x in want), strict=True))


def test_tangents_by_definition(spark):
    rng = random.Random(2)
    rows = [(d, i, rng.random() < 0.2, rng.choice((0.1, 0.2, 0.5))) for d in range(8) for i in range(60)]
    want = []
    for d in range(8):
        own, i = [r for r in rows if r[0] == d], 0
        while i < len(own):
            j = i + 1
            if own[i][2]:
                while j < len(own) and j - i <= 10 and own[j][3] < 0.30:
                    j += 1
                want.append((d, i, j - 1, j - i))
            i = j
    got = sequential.streamed(_rows(spark, rows, "doc_id long, idx long, marked boolean, overlap double"), "doc_id", ["idx"], sequential.tangents, "doc_id long, first_idx long, last_idx long, n_rows long")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_greedy_choices_by_definition(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(u, u * 100 + k, float(rng.randrange(500)), rng.randrange(9) / 10) for u in range(5) for k in range(60)]
    want = []
    for u in range(5):
        taken = []
        for r in sorted((r for r in rows if r[0] == u), key=lambda r: (-r[3], r[2], r[1])):
            if len(taken) < 7 and all(abs(r[2] - t) >= 20 for t in taken):
                taken.append(r[2])
                want.append(r)
    schema = "user_id long, event_id long, start double, importance double"
    got = sequential.streamed(_rows(spark, rows, schema), "user_id", [F.desc("importance"), "start", "event_id"], lambda x: sequential.gap_select(x, 20.0, 7), schema)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    pairs = [(u, rng.randrange(15), rng.randrange(15), rng.randrange(30)) for u in range(4) for _ in range(80)]
    pairs = sorted({p[:3]: p for p in pairs}.values())
    want = []
    for u in range(4):
        a, b = set(), set()
        for p in sorted((p for p in pairs if p[0] == u), key=lambda p: (p[3], p[1], p[2])):
            if p[1] not in a and p[2] not in b:
                a.add(p[1])
                b.add(p[2])
                want.append(p)
    schema = "user_id long, event_id long, anchor_id long, distance long"
    got = sequential.streamed(_rows(spark, pairs, schema), "user_id", ["distance", "event_id", "anchor_id"], sequential.match_anchors, schema)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_alignment_by_definition(spark):
    rng = random.Random(4)
    rows = [(c, t, " ".join(rng.choice("A b c D e".split()) for _ in range(rng.randrange(12)))) for c in range(4) for t in range(10)]
    want = []
    for (c, t, a), (_, _, b) in ((x, y) for x, y in zip(rows, rows[1:], strict=False) if x[0] == y[0]):
        m = difflib.SequenceMatcher(None, a.lower().split(), b.lower().split(), autojunk=False)
        want.append((c, t, sum(x.size for x in m.get_matching_blocks()), len(a.split())))
    got = sequential.streamed(_rows(spark, rows, "conv_id long, turn long, text string"), "conv_id", ["turn"], sequential.align_words, "conv_id long, turn long, matched long, n_words long")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def _allowed(chosen, k, limit):
    return not (len(chosen) >= limit and all(c == k for c in chosen[len(chosen) - limit :]))


def test_direction_and_treatment_by_definition(spark):
    rng = random.Random(5)
    rows = [(u, u * 100 + k, float(k), rng.uniform(0, 400)) for u in range(4) for k in range(50)]
    weights = {"wide": 3.0, "medium": 4.0, "close": 2.0, "detail": 1.0}
    directed, treated = [], []
    for u in range(4):
        done, other = [], []
        for _, e, _, v in (r for r in rows if r[0] == u):
            fit = {k: w * (0.4 if k in done[-3:] else 1) for k, w in weights.items() if not (k == "wide" and v < 20) and not (k == "close" and v > 250)}
            fit = {k: w for k, w in fit.items() if _allowed(done, k, 2)} or fit
            done.append(sequential.draw(f"s|{u}|{e}", fit.items()))
            directed.append((u, e, done[-1]))
            if len(other) >= 6 and "medium" not in other[-6:]:
                other.append("medium")
            else:
                fit = {}
                for k, w in weights.items():
                    back = next((b for b in (1, 2, 3) if len(other) >= b and other[-b] == k), None)
                    if _allowed(other, k, 2):
                        fit[k] = w * {None: 1, 1: 0.3, 2: 0.55, 3: 0.7}[back]
                other.append(sequential.draw(f"s|{u}|{e}", fit.items()) or "medium")
            treated.append((u, e, other[-1]))
    given = _rows(spark, rows, "user_id long, event_id long, start double, value double")
    got = sequential.streamed(given, "user_id", ["start", "event_id"], lambda x: sequential.direct(x, weights, "s"), "user_id long, event_id long, composition string")
    assert sorted(tuple(r) for r in got.collect()) == sorted(directed)
    got = sequential.streamed(given, "user_id", ["start", "event_id"], lambda x: sequential.treat(x, weights, "s", "medium"), "user_id long, event_id long, treatment string")
    assert sorted(tuple(r) for r in got.collect()) == sorted(treated)


def test_resolving_by_definition(spark):
    rng = random.Random(6)
    rows = [(p, p * 10 + q, c, rng.randrange(100) / 100, rng.choice("xyz")) for p in range(4) for q in range(8) for c in range(6)]
    want = []
    for p in range(4):
        uses, families = Counter(), []
        for q in sorted({r[1] for r in rows if r[0] == p}):
            score = lambda r: r[3] - 0.2 * uses[r[2]] - 0.05 * families[-2:].count(r[4])  # noqa: B023, E731
            best = max((r for r in rows if r[1] == q), key=lambda r: (score(r), -r[2]))
            want.append((p, q, best[2], round(score(best), 6)))
            uses[best[2]] += 1
            families.append(best[4])
    got = sequential.streamed(_rows(spark, rows, "plan long, req long, cand long, score double, family string"), "plan", ["req", "cand"], sequential.resolve, "plan long, req long, cand long, score double")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_caption_lines_keep_every_word(spark):
    from spanforge import registry
    from spanforge.operators import captions

    docs = {r.doc_id: r.text.replace("\n", " ") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").collect()}
    got = {}
    for r in registry.queries()["caption_lines"](spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.doc_id, []).append((r.idx, r.text))
    for key, text in docs.items():
        pieces = [t for _, t in sorted(got.get(key, []))]
        assert "".join(pieces).replace(" ", "") == "".join(text.split())
        assert all(len(p) <= captions.JOINED for p in pieces)
