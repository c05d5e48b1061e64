"""Small editorial rules on literal rows."""

from pyspark.sql import functions as F

from spanforge.functions import editorial as E
from spanforge.functions import text as T


def test_small_rules(spark):
    L = F.lit
    arr = lambda *x: F.array(*map(F.lit, x))
    cases = {
        "intent": (E.intent_of(L("Illustrate: the storm (shot)"), "illustrate:", r"\(shot\)"), "the storm"),
        "usable": (E.query_terms(L("storm"), L("the sea"), L("heavy storm"))["terms"], ["storm", "heavy"]),
        "joined": (E.join_prefix(L("dark old"), L("old house")), "dark old house"),
        "refined": (E.refined(L("old house"), arr("dark", "wet", "far")), "dark wet old house"),
        "single": (E.refined(L("house"), arr("dark")), "house"),
        "lexicon": (E.substituted(L("bulb"), {"bulb": "window"}), "window"),
        "default": (E.substituted(L("sea"), {"bulb": "window"}), "sea"),
        "queries": (E.search_queries(arr("a", "b", "a"), L("b")), ["a", "b"]),
        "slices": (E.slices(arr("a", "b", "c", "d"), arr(1.0, 1.0, 2.0)), ["a", "b", "c d"]),
        "aspect": (E.aspect(L(1920), L(1080)), "16:9"),
        "centi": (E.centisecond_clock(L(3_661_239)), "1:01:01.23"),
        "ext": (E.extension(L("x/y.JPG?s=1"), L(".bin")), ".jpg"),
        "noext": (E.extension(L("x/y"), L(".bin")), ".bin"),
        "speed": (E.unit_speed(L(3.0), 0.92), 2.0),
        "foreign": (E.foreign_reasons(L("café noir"), ["noir"]), ["diacritics", "foreign words", "too short"]),
        "symbols": (E.unjustified(arr("chess", "sea"), ["chess", "maze"], arr("maze")), ["chess"]),
        "approve": (E.needs_approval(arr("stock", "real"), L(2)), True),
        "real": (E.needs_approval(arr("real"), L(5)), False),
        "oppose": (E.opposes(L("It rains."), L("But not here.")), True),
        "stems": (E.no_shared_stem(L("running water"), L("runners hide")), True),
        "copy": (E.derived(L("old house"), L("the old house by the sea")), False),
        "contrast": (E.split_on_contrast(L("It rains, but we go")), ["It rains", "but we go"]),
        "span": (E.emphasis_span(arr("one", "big", "idea", "of", "the", "year"), 1, 20, 4, ["of", "the"]), "big idea"),
        "clause": (E.emphasis_span(arr("one,", "two"), 0, 20, 4, []), "one,"),
        "grade": (E.grade_for(L(0.2)), "lift"),
        "field": (E.best_field(arr("wave", "sea", "bank"), {"money": ["bank", "coin"], "sea": ["sea", "wave", "salt"]}), "sea"),
        "nofield": (E.best_field(arr("x"), {"money": ["bank"]}), None),
        "shots": (E.shot_count(L(10.0), 4.0, 1.5, 8.0), 2),
        "duration": (E.declared_or_share(L(None).cast("double"), L(10), L(0.0), L(20)), 4.0),
    }
    row = spark.range(1).select(*(c.alias(k) for k, (c, _) in cases.items())).first()
    assert {k: row[k] for k in cases} == {k: v for k, (_, v) in cases.items()}


def test_structs(spark):
    row = spark.range(1).select(
        E.target_format(F.lit("1920x1080")).alias("a"), E.target_format(F.lit("12")).alias("b"), E.approvals(F.lit("SEQ 07 -> B")).alias("c"), E.approvals(F.lit("SEQ x")).alias("d"),
        E.highlight(F.lit("about 25% of mountains")).alias("e"), E.highlight(F.lit("see the mountains")).alias("f"), E.highlight(F.lit("mountains")).alias("g"),
        E.weighted(F.create_map(F.lit("a"), F.lit(2.0), F.lit("z"), F.lit(9.0)), {"a": 0.5, "b": 1.0}).alias("h"), T.orientation(F.lit(3), F.lit(4)).alias("i"),
    ).first()
    assert tuple(row["a"]) == (1920, 1080, "contain") and row["b"] is None
    assert tuple(row["c"]) == (7, "B") and row["d"] is None
    assert tuple(row["e"]) == (6, 9) and tuple(row["f"]) == (8, 17) and row["g"] is None
    assert row["h"] == 1.0 and row["i"] == "portrait"
