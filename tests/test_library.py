"""Operators on literal rows: branches that the driver's tables never reach."""

import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from spanforge.functions import text as T
from spanforge.operators import alloc, integrity, intervals, rank, runs, sequential
from spanforge.plans import cards, grammar
from spanforge.sources import readers, sinks


def one(spark, column, **values):
    names = list(values)
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'long'}" for n, v in values.items()) if names else "x long")
    return frame.select(column.alias("v")).first()["v"]


def test_folds(spark):
    assert one(spark, T.fold_a(F.col("t")), t="  Größe ÉTÉ ") == "grosse ete"
    assert one(spark, T.fold_b(F.col("t")), t="Größe") == "große"
    assert one(spark, T.fold_d(F.col("t")), t="C'est, là!") == "cest la"
    assert one(spark, T.has_accents(F.col("t")), t="plain Text") is False


def test_sentences_and_words(spark):
    assert one(spark, T.sentences(F.col("t")), t="Why? Because. And… so! End") == ["Why?", "Because.", "And…", "so!", "End"]
    assert one(spark, T.phrase_hits(F.col("t"), ["of the", "the end", "he en"]), t="End of THE end.") == ["of the", "the end"]
    assert one(spark, T.shorten(T.words(F.col("t")), 9), t="one two three") == "one two"


def test_clocks(spark):
    for text, want in (("01:02.5", 62.5), ("1:00:01", 3601.0), ("75", 75.0), ("1.25", 1.25), ("00:61", None), ("x", None), ("1:75:00", None)):
        assert one(spark, T.clock_seconds(F.col("t")), t=text) == want, text
    assert one(spark, T.srt_clock(F.col("m")), m=3_723_004) == "01:02:03,004"
    assert one(spark, T.clock(F.col("m")), m=62_500) == "01:02.500"
    assert one(spark, T.bgr(F.col("t")), t="#A1b2C3") == "&H00C3B2A1"
    assert one(spark, T.safe_name(F.col("t")), t="../a b?") == "a-b"


def test_syllables(spark):
    assert [one(spark, T.syllables(F.col("t")), t=w) for w in ("cake", "the", "banana", "12", "é")] == [1, 1, 3, 0, 1]
    assert one(spark, T.chunk_weight(F.col("t")), t="banana cake.") == 7.0


def test_cosine(spark):
    a, b = T.counts_map(F.split(F.lit("a a b"), " ")), T.counts_map(F.split(F.lit("a b b"), " "))
    assert abs(one(spark, T.cosine(a, b), x=1) - 0.8) < 1e-9
    assert one(spark, T.numbers_in(F.col("t")), t="in 1984 and 3.5 or 2001") == ["1984", "2001", "3.5"]


def _spans(spark, rows):
    return spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate(rows)], "user_id long, event_id long, start long, stop long")


def test_span_algebra(spark):
    df = _spans(spark, [(30, 40), (10, 20), (18, 25), (40, 45)])
    merged = intervals.coalesce_spans(df, "user_id")
    assert sorted((r.start, r.stop, r.members) for r in merged.collect()) == [(10, 25, 2), (30, 45, 2)]
    assert [(r.start, r.stop) for r in intervals.complement(merged, "user_id", 0).collect()] == [(25, 30)]
    assert intervals.union_measure(df, "user_id").first()["covered"] == 30
    assert [r.overlap for r in intervals.conflicts(df, "user_id").select((F.col("prev_stop") - F.col("start")).alias("overlap")).collect()] == [2]
    total = intervals.totals(df, "user_id").first()
    assert total["covered"] + total["uncovered"] == total["original"]


def test_cover_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(a := rng.randrange(200), a + rng.randrange(1, 20)) for _ in range(60)]
    got = intervals.union_measure(_spans(spark, rows), "user_id").first()["covered"]
    assert got == len({t for a, b in rows for t in range(a, b)})


def test_remap_edge_belongs_to_the_earlier_piece(spark):
    laid = intervals.timeline(_spans(spark, [(0, 100), (200, 300)]), "user_id", F.lit(200))
    points = spark.createDataFrame([(1, k, at) for k, at in enumerate((0, 100, 150, 200, 300))], "user_id long, event_id long, at long")
    assert [r.out_at for r in intervals.remap(points, laid, "user_id").orderBy("at").collect()] == [0, 50, None, 50, 100]


def test_range_join_by_buckets(spark):
    rng = random.Random(3)
    points = [(k, rng.randrange(1000)) for k in range(80)]
    windows = [(k, a := rng.randrange(1000), a + rng.randrange(1, 300)) for k in range(30)]
    hit = intervals.point_in_window(spark.createDataFrame(points, "p long, at long"), spark.createDataFrame(windows, "w long, start long, stop long"), 100)
    assert {(r.p, r.w) for r in hit.collect()} == {(p, w) for p, at in points for w, a, b in windows if a <= at < b}


def test_sessions_break_at_unflagged_rows(spark):
    rows = [(1, k, 10 * k, 10 * k + 5, k != 2) for k in range(5)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, start long, stop long, flag boolean")
    got = runs.sessions(df, "user_id", F.col("flag"), 5).groupBy("session").count().orderBy("session").collect()
    assert [r["count"] for r in got] == [2, 2]


def test_allocation_ends_exactly(spark):
    rows = spark.createDataFrame([(1, k, w) for k, w in enumerate((3, 1, 7, 5))], "k long, i long, w long")
    got = alloc.proportional(rows, "k", ["i"], "w", 1000).orderBy("i").collect()
    assert got[0]["start"] == 0 and got[-1]["stop"] == 1000
    assert all(a["stop"] == b["start"] for a, b in zip(got, got[1:], strict=False))


def test_comparative_refusal_needs_a_survivor(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, True)], "req long, cand long, flag boolean")
    assert {r.cand: r.refused for r in rank.comparative(rows, F.col("flag")).collect()} == {1: True, 2: False, 3: False}


def test_sequence_steps():
    assert sequential.draw("x", []) == "" and sequential.draw("x", [("a", 0.0)]) == "a"
    counts = pd.Series([sequential.draw(f"s{k}", [("a", 1.0), ("b", 3.0)]) for k in range(2000)]).value_counts(normalize=True)
    assert abs(counts["b"] - 0.75) < 0.04
    assert sequential.run_allowed(["a", "b"], "b", 2) and not sequential.run_allowed(["b", "b"], "b", 2)
    rows = ({"user_id": 1, "event_id": k, "start": k, "value": 100.0} for k in range(40))
    plan = [x for *_, x in sequential.treat(rows, {"hold": 1.0, "cut": 3.0, "push": 3.0}, "t")]
    assert len(plan) == 40 and all("hold" in plan[i : i + 7] for i in range(len(plan) - 7))
    picked = sequential.gap_select(iter([{"start": s, "importance": i} for i, s in ((0.9, 1.0), (0.8, 5.0), (0.8, 9.0), (0.1, 0.0))]), 3.0, 2)
    assert [x for x, _ in picked] == [1.0, 5.0]
    twice = [{"doc_id": 1, "idx": k, "tokens": "a b c d"} for k in range(2)]
    assert list(sequential.repetition(iter(twice))) == [(1, 0, "CUT", 1.0)]


def test_subtitles(spark):
    srt = "﻿1\r\n00:00:01,000 --> 00:00:02,5\r\nHello\r\nthere\r\n\r\n2\r\n00:00:02,000 --> 00:00:03,000\r\n<b>bold</b>\r\n"
    vtt = "WEBVTT\n\nNOTE x\n\n00:01.000 --> 00:01.000\nflat\n"
    cues = readers.subtitle_cues(spark.createDataFrame([("a.srt", srt), ("b.vtt", vtt)], "path string, content string"))
    got = [tuple(r) for r in cues.orderBy("path", "idx").select("path", "start", "stop", "text", "issue").collect()]
    assert got == [("a.srt", 1000, 2500, "Hello\nthere", None), ("a.srt", 2000, 3000, "<b>bold</b>", "markup"), ("b.vtt", 1000, 1000, "flat", "empty span")]
    assert {r.issue for r in readers.cue_issues(cues).collect()} == {"markup", "empty span"}
    back = sinks.subrip(cues.where("path = 'a.srt' and idx = 0"), "path").first()["content"]
    assert back == "1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n"


def test_script_blocks_and_json(spark, tmp_path):
    (tmp_path / "s.txt").write_text("One\ntwo\n\n \t\nThree?\n\n\n")
    assert [r.text for r in readers.script_blocks(readers.whole_texts(spark, str(tmp_path))).orderBy("idx").collect()] == ["One\ntwo", "Three?"]
    schema = StructType([StructField("a", LongType()), StructField("b", StringType())])
    docs = spark.createDataFrame([("x", '{"a": 1, "z": 2}'), ("y", "{oops")], "path string, content string")
    got = {r.path: (r.unknown, r.broken) for r in readers.closed_json(docs, schema).collect()}
    assert got["x"] == (["z"], False) and got["y"][1]


def test_catalogue_and_log(spark):
    paths = spark.createDataFrame([("m/a.JPG",), ("m/b.mp4",), ("m/c.txt",)], "path string")
    side = spark.createDataFrame([("m/a.json", "1"), ("m/a.JPG.json", "2"), ("m/b.mp4.json", "3")], "path string, content string")
    assert {(r.path, r.media_type, r.sidecar) for r in readers.catalogue(paths, side).collect()} == {("m/a.JPG", "image", "1"), ("m/b.mp4", "video", "3")}
    log = spark.createDataFrame([("s", 0, "silence_start: 1.5"), ("s", 1, "silence_end: 2.5"), ("s", 2, "silence_start: 9")], "source string, idx long, line string")
    assert [tuple(r) for r in readers.silence_spans(log).collect()] == [("s", 1.5, 2.5)]
    payload = '{"hits":[{"id":1,"title":"t","author":"x","renditions":[{"url":"u1","width":5,"height":9},{"url":"u2","width":7,"height":7},{"url":"u3","width":7,"height":1}]}]}'
    hit = readers.remote_hits(spark.createDataFrame([("q", payload)], "query string, payload string"), "video").first()
    assert (hit["url"], hit["orientation"]) == ("u2", "square")
    assert readers.providers(["none"], {"none": None}) is None


def test_grammar(spark):
    op = "struct<kind: string, source: string, start: double, stop: double, parameters: string>"
    rows = [
        ("good", [("clip", "a", 0.0, 2.0, "{}"), ("clip", "b", None, None, '{"duration": 3}'), ("captions", None, None, None, "{}"), ("music", None, None, None, '{"gain_db": -12}')]),
        ("bad", [("music", None, None, None, '{"gain_db": 40}'), ("clip", None, 2.0, 2.0, "{}")]),
    ]
    plans = spark.createDataFrame(rows, f"plan_id string, operations array<{op}>")
    assert {(r.plan_id, r.issue) for r in grammar.plan_issues(plans).collect()} == {("bad", i) for i in ("order", "empty clip", "clip without source", "music.gain_db out of range")}
    assert [(r["at"], r["length"]) for r in grammar.clips(plans.where("plan_id = 'good'")).orderBy("pos").collect()] == [(0.0, 2.0), (2.0, 3.0)]


def test_cards(spark):
    rows = cards.layout(spark.createDataFrame([("c", ["short", "x" * 400])], "card_id string, lines array<string>")).orderBy("idx").collect()
    assert rows[0]["size"] == 12 and [r["overflows"] for r in rows] == [False, True]


def test_integrity(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert {tuple(r) for r in integrity.patched(base, spark.createDataFrame([(2, "z")], "id long, v string"), "id", ["v"]).collect()} == {(1, "a"), (2, "z")}
    assert {tuple(r) for r in integrity.coverage(base, base.where("id = 1").unionByName(spark.createDataFrame([(9, "q")], "id long, v string")), "id").collect()} == {(2, "missing"), (9, "unknown")}


def test_publish_never_overwrites(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1,)], "a long")
    sinks.publish(df, str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.publish(df, str(tmp_path / "x"))


def test_streaming_sessions(spark, tmp_path):
    """Sessions close by the next row or by the watermark; late rows and closed state are gone."""
    from datetime import datetime, timedelta, timezone

    from spanforge.streaming.sessions import sessions

    at = lambda s: datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)
    schema = "user_id long, ts timestamp, seconds double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = sessions(stream, 10, "20 seconds").writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
    parts = ([(1, 0, 5.0), (1, 7, 2.0), (1, 40, 1.0)], [(2, 100, 1.0)], [(3, 300, 1.0), (1, 41, 1.0)], [(4, 900, 1.0)])
    query = found.start()
    for rows in parts:
        spark.createDataFrame([(u, at(s), n) for u, s, n in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
    query.stop()
    got = sorted((r.user_id, r.stop - r.start, r.n) for r in spark.sql("select * from closed").collect())
    assert got == [(1, 1.0, 1), (1, 9.0, 2), (2, 1.0, 1), (3, 1.0, 1)]
