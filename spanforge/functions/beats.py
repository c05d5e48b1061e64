"""Reading one narration line: figures, cues, lexicons, emphasis, and the worth of a word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions import text as T

#: Cues of a conclusion, leads of a contrast, and connectors with their cues.
CONCLUSIONS = ("therefore", "finally", "donc", "also", "enfin")
CONTRASTS = ("but", "mais", "aber", "pero")
CONNECTORS = (("contrast", ("but", "mais", "aber", "pero")), ("cause", ("because", "parce", "weil", "porque")), ("then", ("then", "puis", "dann", "luego")))
NOUN_ENDS = ("tion", "ment", "ung", "heit", "keit", "dad", "ness", "ity")
VERB_ENDS = ("ing", "er", "ir", "en", "ed")
#: Categories of which one word may stand alone.
ALONE = ("date", "number")
_EDGE = r"^[^0-9A-Za-zÀ-ÿ]+|[^0-9A-Za-zÀ-ÿ]+$"


def _texts(items: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, items))


def bare(word: Column) -> Column:
    """A word without punctuation at its ends, folded."""
    return T.fold_b(F.regexp_replace(word, _EDGE, ""))


def first_number(text: Column) -> Column:
    """The first token that is a number; null without any."""
    return F.nullif(F.regexp_extract(text, "[0-9]+", 0), F.lit(""))


def has_cue(tokens: Column, cues: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, _texts(cues))


def ordered_hits(tokens: Column, lexicon: tuple[str, ...]) -> Column:
    """Distinct lexicon words in the order in which a text has them."""
    return F.array_distinct(F.filter(tokens, lambda t: t.isin(*lexicon)))


def first_value(tokens: Column, lexicon: dict[str, str]) -> Column:
    """The value of the first token that the lexicon has; null without any."""
    known = F.create_map(*(F.lit(x) for kv in lexicon.items() for x in kv))
    return F.try_element_at(known, F.get(F.filter(tokens, lambda t: t.isin(*lexicon)), F.lit(0)))


def outside(tokens: Column, vocabulary: list[str] | tuple[str, ...]) -> Column:
    return F.array_except(tokens, _texts(vocabulary))


def connector(text: Column) -> Column:
    """The first connector, in their order, of which the text has a cue."""
    own = F.transform(T.words(text), lambda w: bare(w))
    return F.coalesce(*(F.when(has_cue(own, cues), F.lit(name)) for name, cues in CONNECTORS))


def can_stand_alone(span: Column, category: Column) -> Column:
    """May a span be shown by itself: one word only as a date or figure, and no stop word in front."""
    own = T.words(span)
    figure = category.isin(*ALONE) | span.rlike("[0-9]")
    return (F.size(own) > 0) & ((F.size(own) > 1) | figure) & ~F.coalesce(bare(F.get(own, F.lit(0))).isin(*T.STOPWORDS), F.lit(False))


def emphasis(text: Column) -> Column:
    """``span, category``: a year; a figure and up to three words behind it; what follows a contrast; three content words."""
    pick = lambda span, category: F.struct(F.upper(F.replace(span, F.lit("ß"), F.lit("ss"))).alias("span"), F.lit(category).alias("category"))

    def chosen(line: Column) -> Column:
        own, low = line["own"], line["low"]
        year = F.get(F.filter(low, lambda w: w.rlike("^(1[0-9]|20)[0-9]{2}$")), F.lit(0))
        place = lambda test: F.array_position(F.transform(low, test), True).cast("int")
        figure, turn = place(lambda w: w.rlike("^[0-9]+$")), place(lambda w: w.isin(*CONTRASTS))
        behind = F.array_join(F.slice(own, turn + 1, F.lit(4)), " ")
        key = F.array_join(F.slice(F.filter(low, lambda w: (F.length(w) >= 4) & ~w.isin(*T.STOPWORDS)), 1, 3), " ")
        return (
            F.when(year.isNotNull(), pick(year, "date")).when(figure > 0, pick(F.array_join(F.slice(own, figure, F.lit(4)), " "), "number"))
            .when((turn > 0) & (behind != ""), pick(behind, "emphasis")).when(key != "", pick(key, "keyword"))
        )

    both = lambda line: F.struct(line["own"].alias("own"), F.transform(line["own"], lambda w: bare(w)).alias("low"))
    return T.once(T.once(F.struct(T.words(text).alias("own")), both), chosen)


def word_score(word: Column, place: Column, total: Column, themes: Column) -> Column:
    """How much a word deserves the frame, in hundredths; -100 for what never does."""
    low = bare(word)
    ends = lambda items: reduce(lambda a, b: a | b, (F.endswith(low, F.lit(x)) for x in items))
    score = 16 * F.length(low) + F.when(F.array_contains(themes, low), 220).otherwise(0) + F.when(ends(NOUN_ENDS), 170).otherwise(0)
    score = score - F.when(ends(VERB_ENDS), 140).otherwise(0) + F.when(total > 1, F.floor(120 * place / (total - 1))).otherwise(0)
    unfit = (F.length(low) < 4) | low.isin(*T.STOPWORDS) | ~low.rlike("[a-z]")
    return F.when(unfit, -100).otherwise(score).cast("long")


def first_form(text: Column, folded: Column) -> Column:
    """The first surface form of a folded word."""
    return F.get(F.filter(F.regexp_extract_all(text, F.lit("[0-9A-Za-zÀ-ÿ]+"), F.lit(0)), lambda w: T.fold_b(w) == folded), F.lit(0))


def opening_rhythm(ideal: Column, soft: Column, hard: Column, start: Column, opening: int, ceiling: int) -> Column:
    """The rhythm of a row: in the opening the ceiling is lower, floors and variation stay."""
    inside = start < opening
    top = F.greatest(F.lit(ceiling), F.lit(0))
    return F.struct(F.when(inside, F.least(ideal, top)).otherwise(ideal).alias("ideal"), F.when(inside, top).otherwise(soft).alias("soft"), F.when(inside, F.greatest(top, hard)).otherwise(hard).alias("hard"))


def audit_line(concept: Column, names: Column, emotion: Column) -> Column:
    """One line on what a row was read as; what is unknown is left out."""
    return F.concat_ws(" · ", concept, F.nullif(F.array_join(F.slice(names, 1, 2), "/"), F.lit("")), emotion)
