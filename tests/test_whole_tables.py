"""Queries over whole tables: no row is left out by a filter."""

from spanforge import registry

DATA = "/root/testdata/sf0.001"


def test_every_turn_with_words_is_spread(spark):
    turns = spark.read.parquet(f"{DATA}/conversations.parquet")
    want = {(r.conv_id, r.turn) for r in turns.where("trim(text) <> ''").collect()}
    got = {}
    for r in registry.queries()["words_over_cue"](spark, DATA).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.pos, r.start, r.stop))
    assert set(got) == want and any(t > 0 for _, t in want)
    for spans in got.values():
        spans.sort()
        assert spans[0][1] == 0 and spans[-1][2] == 1_000 and all(a[2] == b[1] for a, b in zip(spans, spans[1:], strict=False))


def test_every_document_is_compared_with_the_labels(spark):
    docs = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    given = {r.doc_id + 3 for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = {(r.doc_id, r.state) for r in registry.queries()["coverage_full_outer"](spark, DATA).collect()}
    assert got == {(i, "missing") for i in docs - given} | {(i, "unknown") for i in given - docs}
    assert any(i % 2 for i, s in got if s == "missing")
