"""Planning joins and caption pieces on literal rows."""

import random

from pyspark.sql import functions as F

from spanforge.operators import captions, planning


def test_assets_and_clips(spark):
    shots = spark.createDataFrame([("a", 0, "s0", "image", "sea", 2.0), ("b", 1, "s1", "video", "sky", 3.0), ("a", 2, "s2", "image", "surf", 4.0), ("c", 3, "s3", "image", "x", 1.0), ("c", 4, "s4", "video", "x", 1.0)], "asset_id string, idx long, shot_id string, type string, query string, seconds double")
    got = {r.asset_id: r for r in planning.asset_requirements(shots).collect()}
    assert (got["a"].query, got["a"].needed_s, got["a"].used_by, got["a"].issue) == ("sea", 4.5, ["s0", "s2"], None)
    assert got["c"].issue == "mixed types"
    clips = {r.shot_id: r for r in planning.bound_clips(shots, spark.createDataFrame([("a", "f1"), ("b", "f1")], "asset_id string, path string")).collect()}
    assert [clips[s].offset for s in ("s0", "s1", "s2", "s3")] == [0.0, 2.0, 5.0, None] and clips["s3"].issue == "unbound asset"


def test_reuse_scenes_rotation(spark):
    shots = spark.createDataFrame([("p", "a", 0), ("p", "a", 1), ("p", "b", 2), ("p", "b", 9)], "plan string, asset_id string, idx long")
    assert [(r.asset_id, r.idx, r.issue) for r in planning.reuse_issues(shots, 3, 3).collect()] == [("a", 1, "again too soon")]
    scenes = spark.createDataFrame([("x", 5.0), ("y", 2.0), ("z", 1.0)], "scene_id string, seconds double")
    parts = spark.createDataFrame([("x", 2.0), ("x", 3.0), ("y", 1.0)], "scene_id string, seconds double")
    assert {(r.scene_id, r.issue) for r in planning.scene_issues(scenes, parts).collect()} == {("y", "sum differs"), ("z", "no shots")}
    turns = planning.rotated(shots, "asset_id", "idx", F.array(F.lit("u"), F.lit("v"))).orderBy("idx").collect()
    assert [r.option for r in turns] == ["u", "v", "u", "v"]


def test_lock(spark):
    decisions = spark.createDataFrame([(1, "A", "p1"), (1, "B", "p2"), (2, "A", "p3"), (3, "A", "p4")], "sequence int, option string, path string")
    answers = spark.createDataFrame([(1, "B"), (2, "PENDING"), (9, "A")], "sequence int, choice string")
    digests = spark.createDataFrame([("p2", "d2"), ("p3", "d3")], "path string, digest string")
    assert {(r.sequence, r.option, r.digest, r.issue) for r in planning.locked(decisions, answers, digests).collect()} == {(1, "B", "d2", None), (2, "A", "d3", "pending"), (3, "A", None, "no answer")}
    assert [r.sequence for r in planning.unknown_answers(decisions, answers).collect()] == [9]


def test_takes_and_gates(spark):
    rows = spark.createDataFrame([(1, 0, "We begin with water."), (1, 1, "sorry, again: we begin with fire."), (1, 2, "tiny broken bit"), (1, 3, "Something else entirely follows.")], "doc long, idx long, text string")
    assert {r.idx: r.why for r in planning.failed_takes(rows, "doc", "idx", ["sorry"]).collect()} == {0: "before a restart", 1: "restart", 2: "fragment"}
    assert [r.suggestion for r in planning.self_commentary(rows, ["again"]).collect()] == ["CUT"]
    row = spark.range(1).select(
        planning.gates({"wide": [(F.lit(False), "no"), (F.lit(True), "text")], "close": [(F.lit(False), "x")]}).alias("g"),
        planning.viable(F.array(F.lit(0.2), F.lit(0.8)), F.lit(5.0), F.lit(1.5)).alias("v"),
        planning.affinities(F.array(F.lit("sea"), F.lit("sand"), F.lit("sun")), {"beach": ["sea", "sand", "sun"], "city": ["street"]}).alias("a"),
        planning.signals(F.array(F.lit("sea")), {"q": F.array(F.lit("sea"), F.lit("sky")), "n": F.expr("cast(array() as array<string>)")}).alias("s"),
    ).first()
    assert row["g"] == {"wide": "text"} and row["v"] is False and row["a"] == {"beach": 1.0, "city": 0.0} and row["s"] == {"q": 0.5, "n": None}


def test_neighbours_and_alignment(spark):
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate("abc")] + [("one", 0, "z")], "k string, i long, v string")
    got = [(r.prev_v, r.next_v, r.position) for r in planning.with_neighbours(rows, "k", "i", "v").orderBy("k", "i").collect()]
    assert got == [(None, "b", 0.0), ("a", "c", 0.5), ("b", None, 1.0), (None, None, 0.0)]
    a, b = (spark.createDataFrame([(1, w)], "k long, words array<string>") for w in (["x", "y", "z"], ["x", "q"]))
    assert abs(planning.positional_alignment(a, b, "k").first()["alignment"] - 1 / 3) < 1e-9


def test_caption_pieces(spark):
    rng = random.Random(9)
    for _ in range(200):
        words = ["w" * rng.randrange(1, 12) for _ in range(rng.randrange(1, 40))]
        lines = captions.wrapped(words)
        assert " ".join(lines).split() == words and all(len(x) <= captions.LINE for x in lines)
        text = " ".join(w + rng.choice(["", "", ",", "."]) for w in words)
        assert " ".join(captions.chunks(text)).split() == text.split()
    assert captions.wrapped(["x" * 100]) == ["x" * 42, "x" * 42, "x" * 16]
    assert captions.rebalanced(["walk to the", "sea"]) == ["walk", "to the sea"]
    rows = captions.caption_chunks(spark.createDataFrame([(1, "One. Two, three."), (2, None)], "k long, t string"), "k", "t").collect()
    assert [(r.k, r.idx, r.text) for r in rows] == [(1, 0, "One."), (1, 1, "Two, three.")]


def test_exact_split():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 9)
        total = rng.uniform(1.0 * n, 5.0 * n)
        got = captions.exact_split(total, [rng.uniform(0.1, 9) for _ in range(n)], 1.0, 5.0)
        assert abs(sum(got) - total) < 1e-9 and all(1.0 - 1e-9 <= x <= 5.0 + 1e-9 for x in got)
    assert captions.exact_split(9.0, [1, 2], 1.0, 2.0) == [4.5, 4.5] and captions.exact_split(1.0, [], 0, 1) == []
    assert captions.all_or_nothing([[(0, 1), (5, 6)], [(2, 3), (5.5, 7)], [(3, 4)]], 1.0) == [0, 2]
