"""The pipeline and the URL filter on odd rows: nulls, empty and long texts, repeated rows and ids, extra columns, empty tables."""

import random

import pytest
from spanforge.llm import url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, __ld_bad string, row_key long, score double, fp binary"


def _write(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string, doc_id long").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(17)
    return lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def _rows(pairs):
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "s", None if t is None or k % 3 == 0 else len(t), 1, "x", 2, 0.5, b"y") for k, (i, t) in enumerate(pairs)]


def test_pipeline_keeps_what_it_should(spark, tmp_path, prose):
    import corpus_pipeline

    a, b, item = prose(120), prose(120), prose(30)
    pairs = [(k, prose(80)) for k in range(100, 160)] + [(k, "#$% *** " * 30) for k in range(200, 240)]
    pairs += [(1, a), (1, a), (2, b), (2, a), (None, b), (None, None), (3, None), (4, ""), (5, " \n\t"), (6, prose(40) + " " + item), (7, "word " * 20_000)]
    labels = [(k, 1, 0, "t") for k in range(100, 160)] + [(k, 0, 0, "t") for k in range(200, 240)] + [(None, 1, 0, "t"), (1, None, 0, "t")]
    _write(spark, tmp_path, _rows(pairs), labels, [(1, item, 9), (None, item, 9), (2, None, 9), (3, "", 9)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split(" ")[0] for c in SCHEMA.split(", ")], name
    left = [(r.doc_id, r.text) for r in docs.collect()]
    assert {i for i, _ in left if i and 100 <= i < 160} == set(range(100, 160))
    assert not [i for i, _ in left if i and 200 <= i < 240]
    assert left.count((1, a)) == 1 and left.count((2, b)) == 1 and (2, a) not in left and 6 not in {i for i, _ in left}
    assert left.count((None, b)) == 1
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(str(r.doc_id) for r in found.collect()) == sorted(str(i) for i, _ in left)


@pytest.mark.parametrize("without", ["documents", "labels", "benchmark"])
def test_pipeline_on_empty_tables(spark, tmp_path, prose, without):
    import corpus_pipeline

    docs, labels, items = _rows([(k, prose(60)) for k in range(30)]), [(k, k % 2, 0, "t") for k in range(30)], [(1, prose(30), 9)]
    _write(spark, tmp_path, [] if without == "documents" else docs, [] if without == "labels" else labels, [] if without == "benchmark" else items)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 30


def test_very_long_urls_are_judged(spark):
    rows = [(k, f"http://good{k}.com/articles/science/{k}") for k in range(100)] + [(500 + k, f"http://bad{k}.net/es/casino-bonus/{k}") for k in range(100)]
    rows += [(1000, "http://u.org/" + "articles/science/" * 6_000), (1001, "http://u.org/" + "es/casino-bonus/" * 6_000), (1002, "x" * 100_000)]
    found = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (found[1000].verdict, found[1001].verdict) == ("allow", "block") and found[1002].verdict in ("allow", "block")
    assert len(found[1000].path) == 17 * 6_000 + 1
