"""Queries that compare a document's lines read its row where it lies: same rows as SQL on odd tables, and no term is shuffled."""

import duckdb
import pytest

from spanforge import registry
from spanforge.operators import planning
from tests.test_oracles import _rows

#: Repeated ids, a missing text, empty texts and lines, words of more than one line, letters that fold.
DOCS = [
    (1, "well of the sea like it is\n\nsea salt sea, Ünder the sea!\nfor that sand\nsalt sea\nsalt sea\nall rights reserved license\nsea"),
    (2, "one two three\nfour five six\none\none two\nİstanbul ß straße K\nthree three two\n\n\n\n\n\n\n\n\nthree two one"),
    (2, "two five\nsix six\none three four four\none"),
    (3, None), (4, ""), (5, "\n\n"), (6, "sea sand " * 40 + "\nsea"), (7, None), (7, "wine wine\nbread\nwine wine\n" + "bread wine " * 300 + "\nvine"), (9, "wine\nwine bread"),
    (10, "\n".join(f"in the well of salt like so {'salt' if k % 3 else 'sea'} word{k % 7}" for k in range(60))),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(k, t) for k, t in DOCS] + [(None, "sea sea\nsea"), (None, "sea")], "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    return str(folder), con


def _shuffled(spark, frame):
    """Columns of what is shuffled by the plan, an exchange each."""
    frame.write.format("noop").mode("overwrite").save()
    found, todo = [], [frame._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "Exchange":
            found.append([a.name() for a in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(plan.output())])
        if plan.nodeName() == "AdaptiveSparkPlan":
            todo.append(plan.initialPlan())
        todo += list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(plan.children()))
    return found


def _wide(shuffled):
    """Exchanges of terms or lines: all but keys with their counts and the rows of repeated keys (``buf``)."""
    return [c for c in shuffled if {"term", "idx", "pos", "words", "text"} & set(c)]


INSIDE = ["cosine_prev8", "dominant_vocab", "subject_overlap", "intro_outro", "fresh_terms", "filler_density", "review_merge", "review_summary", "positional_alignment"]


@pytest.mark.parametrize("name", INSIDE)
def test_odd_rows_equal_the_statement(spark, odd, name):
    folder, con = odd
    ours, theirs = registry.queries()[name](spark, folder).toPandas(), con.execute(registry.oracle_sql()[name]).fetch_df()
    assert _rows(ours) == _rows(theirs)
    assert len(ours)


@pytest.mark.parametrize("name", INSIDE)
def test_no_term_is_shuffled(spark, odd, name):
    assert not _wide(_shuffled(spark, registry.queries()[name](spark, odd[0])))


def test_tangents_inside_the_row(spark, odd):
    """Ids of one row: the statement's recursion pairs the rows of others."""
    folder, con = odd
    both = registry.queries()["tangent_runs"](spark, folder).toPandas(), con.execute(registry.oracle_sql()["tangent_runs"]).fetch_df()
    ours, theirs = (x[~x["doc_id"].isin([2, 7]) & x["doc_id"].notna()].astype("int64") for x in both)
    assert _rows(ours) == _rows(theirs) and len(ours)
    assert not _wide(_shuffled(spark, registry.queries()["tangent_runs"](spark, folder)))


def test_neighbours_meet_across_blocks(spark):
    """Ids around the edges of blocks, negative ones too; each text once beside its next."""
    ids = [-257, -256, -255, -1, 0, 1, 254, 255, 256, 257, 511, 512, 600]
    texts = spark.createDataFrame([(k, f"a{k % 2} b c") for k in ids], "k long, tokens string").repartition(4)
    found = sorted((r.k, round(r.alignment, 6)) for r in planning.alignment_with_next(texts, "k").collect())
    assert found == [(k, 0.666667) for k in ids if k + 1 in ids]
