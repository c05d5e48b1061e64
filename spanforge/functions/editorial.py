"""Small editorial rules as column expressions: queries, gates, picks, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions import text as T

NO_STRINGS = "cast(array() as array<string>)"


def reasons(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(holds, F.lit(name)) for holds, name in rules)))


def with_reasons(old: Column, new: Column) -> Column:
    return F.array_distinct(F.concat(old, new))


def intent_of(purpose: Column, prefix: str, suffix: str) -> Column:
    """A purpose without its template's ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(purpose, f"(?i)^{prefix}", ""), f"(?i){suffix}$", ""))


def query_terms(query: Column, purpose: Column, intent: Column, least: int = 2) -> Column:
    """Ordered union of the content terms of three texts, and whether it is usable."""
    terms = F.array_union(F.array_union(T.content_terms(query), T.content_terms(purpose)), T.content_terms(intent))
    return F.struct(terms.alias("terms"), (F.size(terms) >= least).alias("usable"), F.when(F.size(terms) < least, "too few terms").alias("reason"))


def join_prefix(prefix: Column, phrase: Column) -> Column:
    """Prefix words that the phrase lacks, then the phrase."""
    own = T.words(phrase)
    return F.concat_ws(" ", F.array_join(F.filter(T.words(prefix), lambda w: ~F.array_contains(own, w)), " "), F.array_join(own, " "))


def refined(query: Column, modifiers: Column, longest: int = 7, most: int = 2) -> Column:
    """Up to two modifiers in front while the query stays short; a single noun is left alone."""
    size = F.size(T.words(query))
    room = F.least(F.lit(most), F.lit(longest) - size, F.size(modifiers))
    return F.when((size < 2) | (room <= 0), query).otherwise(F.concat_ws(" ", F.array_join(F.slice(modifiers, F.lit(1), F.greatest(room, F.lit(0))), " "), query))


def substituted(word: Column, lexicon: dict[str, str]) -> Column:
    """Lexicon lookup with the word itself as default."""
    known = F.create_map(*(F.lit(x) for kv in lexicon.items() for x in kv)) if lexicon else F.expr("map('', '')")
    return F.coalesce(F.try_element_at(known, word), word)


def template_query(scale: Column, kind: Column, keywords: Column) -> Column:
    return F.trim(F.format_string("%s %s %s", scale, kind, F.array_join(keywords, " ")))


def search_queries(queries: Column, base: Column) -> Column:
    """Ordered distinct queries, the base one always among them."""
    return F.array_distinct(F.concat(F.coalesce(queries, F.expr(NO_STRINGS)), F.array(base)))


def slices(words: Column, weights: Column) -> Column:
    """Consecutive slices of a word list in proportion to weights; the last takes the rest."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    upto = lambda k: F.when(k == F.size(weights), F.size(words)).otherwise(F.bround(F.size(words) * F.aggregate(F.slice(weights, F.lit(1), k), F.lit(0.0), lambda a, x: a + x) / total).cast("int"))
    return F.transform(F.sequence(F.lit(1), F.size(weights)), lambda k: F.array_join(F.slice(words, upto(k - 1) + 1, F.greatest(upto(k) - upto(k - 1), F.lit(0))), " "))


def aspect(width: Column, height: Column) -> Column:
    return F.when(width * 9 == height * 16, "16:9").when(width * 16 == height * 9, "9:16").when(width == height, "1:1").otherwise(F.concat(width.cast("string"), F.lit(":"), height.cast("string")))


def centisecond_clock(ms: Column) -> Column:
    return F.format_string("%d:%02d:%02d.%02d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, F.floor(ms / 10) % 100)


def extension(path: Column, fallback: Column) -> Column:
    found = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,5})(?:[?#].*)?$", 1))
    return F.when(found == "", fallback).otherwise(found)


def unit_speed(own: Column, base: float, low: float = 0.5, high: float = 2.0) -> Column:
    return F.greatest(F.least(F.bround(own * base, 3), F.lit(high)), F.lit(low))


def target_format(value: Column) -> Column:
    """``WxH[:fit]``; null where it is malformed."""
    form = r"^(\d{2,5})x(\d{2,5})(?::(contain|cover))?$"
    part = lambda k: F.regexp_extract(value, form, k)
    return F.when(value.rlike(form), F.struct(part(1).cast("int").alias("width"), part(2).cast("int").alias("height"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("contain")).alias("fit")))


def foreign_reasons(query: Column, markers: list[str], least: int = 4) -> Column:
    """Why a query is no plain English phrase: diacritics, marker words, too short."""
    return reasons((T.has_accents(query), "diacritics"), (F.size(T.phrase_hits(query, markers)) > 0, "foreign words"), (F.size(T.words(query)) < least, "too short"))


def unjustified(bag: Column, lexicon: list[str], justified: Column) -> Column:
    """Vocabulary hits that nothing in the narration justifies."""
    return F.array_except(F.array_intersect(bag, F.array(*map(F.lit, lexicon))), justified)


def needs_approval(kinds: Column, alternatives: Column) -> Column:
    """Rules in order: real material needs none, generated always, otherwise only a choice does."""
    return F.when(F.array_contains(kinds, "generated"), True).when(F.forall(kinds, lambda k: k == "real"), False).otherwise(alternatives > 1)


def opposes(first: Column, second: Column, markers: tuple[str, ...] = ("but", "however", "yet", "instead")) -> Column:
    """Does the second sentence turn against the first."""
    low = T.fold_b(F.ltrim(second))
    turn = F.lit(False)
    for m in markers:
        turn = turn | F.startswith(low, F.lit(m + " ")) | F.startswith(low, F.lit(m + ","))
    return turn | (F.contains(T.fold_b(second), F.lit(" not ")) & ~F.contains(T.fold_b(first), F.lit(" not ")))


def no_shared_stem(first: Column, second: Column) -> Column:
    stems = lambda x: F.transform(T.content_terms(x), T.stem)
    return ~F.arrays_overlap(stems(first), stems(second))


def derived(composed: Column, source: Column, share: float = 0.6) -> Column:
    """Neither a contiguous copy of the source nor longer than a share of it."""
    norm = lambda x: F.concat(F.lit(" "), F.array_join(T.tokens(x), " "), F.lit(" "))
    return ~F.contains(norm(source), norm(composed)) & (F.size(T.tokens(composed)) <= share * F.size(T.tokens(source)))


def split_on_contrast(text: Column, markers: str = "but|however|yet") -> Column:
    """Before and after the first contrast marker; one part where there is none."""
    return F.transform(F.split(text, rf"(?i),?\s+(?={markers}\b)", 2), lambda x: F.trim(x))


def emphasis_span(words: Column, start: int, limit: int, most: int, weak: list[str]) -> Column:
    """Words from an anchor until a clause ends, a character or word limit; weak tails go."""
    first = F.struct(F.expr(NO_STRINGS).alias("w"), F.lit(False).alias("done"))

    def step(a: Column, x: Column) -> Column:
        grown = F.concat(a["w"], F.array(x))
        full = (F.length(F.array_join(grown, " ")) > limit) | (F.size(grown) > most)
        return F.when(a["done"], a).when(full, F.struct(a["w"].alias("w"), F.lit(True).alias("done"))).otherwise(F.struct(grown.alias("w"), x.rlike(r"[.,;:!?]$").alias("done")))

    taken = F.aggregate(F.slice(words, start + 1, 1000), first, step)["w"]
    strong = F.array_max(F.transform(taken, lambda x, i: F.when(~F.lower(x).isin(weak), i + 1)))
    return F.array_join(F.slice(taken, F.lit(1), F.coalesce(strong, F.lit(0))), " ")


def highlight(text: Column) -> Column:
    """Character span of the first figure, else of the longest content word; null for one word."""
    figure = F.regexp_extract(text, r"\d+(?:[.,]\d+)*%?", 0)
    content = F.filter(F.regexp_extract_all(text, F.lit("[0-9A-Za-zÀ-ÿ]+"), F.lit(0)), lambda w: T.is_content(T.fold_b(w)))
    longest = F.get(F.array_sort(F.transform(content, lambda w, i: F.struct(-F.length(w), i.alias("i"), w.alias("w")))), F.lit(0))["w"]
    pick = F.when(figure != "", figure).otherwise(longest)
    at = F.position(pick, text)
    return F.when(F.size(T.words(text)) > 1, F.when(pick.isNotNull(), F.struct((at - 1).alias("start"), (at - 1 + F.length(pick)).alias("stop"))))


def grade_for(luma: Column, dark: float = 0.35, bright: float = 0.65) -> Column:
    return F.when(luma < dark, "lift").when(luma > bright, "hold").when(luma.isNotNull(), "neutral")


def weighted(components: Column, weights: dict[str, float]) -> Column:
    """Sum of a map of components under named weights; unknown ones count nothing."""
    known = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return F.aggregate(F.map_values(F.map_zip_with(components, known, lambda _, a, w: F.coalesce(a * w, F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x)


def best_field(tokens: Column, lexicons: dict[str, list[str]]) -> Column:
    """Field by (hits, smaller lexicon, declaration order); null without a hit."""
    scored = F.array(*(F.struct(-F.size(F.array_intersect(tokens, F.array(*map(F.lit, words)))), F.lit(len(words)), F.lit(k), F.lit(name).alias("name")) for k, (name, words) in enumerate(lexicons.items())))
    top = F.get(F.array_sort(scored), F.lit(0))
    return F.when(F.exists(tokens, lambda t: t.isin([w for words in lexicons.values() for w in words])), top["name"])


def shot_count(length: Column, ideal: float, low: float, high: float) -> Column:
    """Pieces near the ideal length that respect both bounds."""
    return F.greatest(F.least(F.bround(length / ideal), F.floor(length / low)), F.ceil(length / high), F.lit(1)).cast("int")


def declared_or_share(declared: Column, words: Column, remaining: Column, open_words: Column, per_minute: float = 150.0, floor: float = 1.0) -> Column:
    """A declared duration, else a share of what remains, else words at a pace with a floor."""
    return F.coalesce(declared, F.when(remaining > 0, remaining * words / open_words), F.greatest(words * 60.0 / per_minute, F.lit(floor)))


def approvals(line: Column) -> Column:
    """``SEQ nn -> X`` of one line; null for anything else."""
    form = r"^\s*SEQ\s+(\d{1,3})\s*->\s*([A-Z]|REGENERATE|PENDING)\s*$"
    return F.when(line.rlike(form), F.struct(F.regexp_extract(line, form, 1).cast("int").alias("sequence"), F.regexp_extract(line, form, 2).alias("choice")))
