"""Text functions as column expressions: folding, tokens, clocks, weights, small formats.

Everything stays inside the engine's code generation or its higher-order functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters of the closed alphabet and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüý"
PLAIN = "aaaaaaceeeeiiiinooooouuuuy"
#: Words without content of their own, in the languages of the tables.
STOPWORDS = "the and that this with from have there then than also only into over been were was for are not but you all can".split() + "pour dans avec mais sans plus sont cette elle nous vous".split() + "para como pero porque esta este ellos entre cuando".split() + "nicht eine einer auch sich aber oder wird durch nach".split()
#: Words that carry no information of a scene.
GENERIC = "thing things stuff really actually maybe today".split()
FILLERS = "well like so in of to it is".split()
FILLER_PAIRS = ("of the", "it is", "in the")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: an expression named inside a lambda is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_a(text: Column) -> Column:
    """Lower case without accents, sharp s as ss, trimmed."""
    return F.trim(F.replace(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit("ß"), F.lit("ss")))


def fold_b(text: Column) -> Column:
    """Lower case without accents; sharp s stays."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def fold_d(text: Column) -> Column:
    """Fold A with letters, digits and blanks only."""
    return F.trim(F.regexp_replace(fold_a(text), r"[^\p{L}\p{N}\s]", ""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold_a(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_lines(text: Column) -> Column:
    """The text's tokens with blanks between, its line breaks kept: a line of it, split at blanks, is ``tokens`` of that line."""
    return F.regexp_replace(fold_a(text), "[^a-z0-9\n]+", " ")


def raw_tokens(text: Column) -> Column:
    """Latin words of the text as it is, each folded."""
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9A-Za-zÀ-ÿ]+"), F.lit(0)), fold_b)


def is_content(word: Column, least: int = 4, generic: bool = True) -> Column:
    return (F.length(word) >= least) & ~word.isin(STOPWORDS + (GENERIC if generic else []))


def content_terms(text: Column, least: int = 4) -> Column:
    """Ordered distinct content terms."""
    return F.array_distinct(F.filter(raw_tokens(text), lambda w: is_content(w, least)))


def content_bag(text: Column) -> Column:
    """Content tokens with repeats, one-letter tokens and stop words removed."""
    return F.filter(tokens(text), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def has_accents(text: Column) -> Column:
    return F.lower(text) != fold_b(text)


def sentences(text: Column) -> Column:
    """Parts after terminal punctuation, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?…])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def stem(word: Column) -> Column:
    return F.when(F.length(word) > 5, F.substring(word, 1, 5)).otherwise(word)


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """Phrases that occur as a run of whole words."""
    norm = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    return F.array_sort(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(norm, F.concat(F.lit(" "), p, F.lit(" ")))))


def syllables(word: Column, accented: bool = False) -> Column:
    """Vowel groups of a word's letters less a silent final e, at least 1; 0 without letters."""
    vowels = F.lit("[aeiouyàáâãäåèéêëìíîïòóôõöùúûü]+" if accented else "[aeiouy]+")
    letters = F.lower(F.regexp_replace(word, r"[^\p{L}]", ""))
    groups = F.regexp_count(letters, vowels)
    return F.when(letters == "", 0).otherwise(F.greatest(groups - F.when(F.endswith(letters, F.lit("e")) & (groups > 1), 1).otherwise(0), F.lit(1)))


def chunk_weight(text: Column) -> Column:
    """Syllables, and 3.0 for an ender or 1.2 for a clause mark at the end."""
    total = F.greatest(F.aggregate(F.transform(words(text), lambda w: syllables(w)), F.lit(0), lambda a, x: a + x), F.lit(1))
    last = F.right(F.trim(text), F.lit(1))
    return total + F.when(last.isin(".", "!", "?", "…"), F.lit(3.0)).when(last.isin(",", ";", ":"), F.lit(1.2)).otherwise(F.lit(0.0))


def block_weight(text: Column) -> Column:
    """Syllables by the wider vowels, 3.0 an ender and 1.2 a clause mark anywhere."""
    total = F.aggregate(F.transform(words(text), lambda w: syllables(w, True)), F.lit(0), lambda a, x: a + x)
    return total + F.lit(3.0) * F.regexp_count(text, F.lit("[.!?…]")) + F.lit(1.2) * F.regexp_count(text, F.lit("[,;:]"))


def clock_seconds(text: Column) -> Column:
    """``MM:SS[.mmm]``, ``HH:MM:SS`` or a number, in seconds; null for anything else."""
    form = r"^(?:(\d+):)?(\d{1,2}):([0-5]?\d)(?:[.,](\d{1,3}))?$"
    part = lambda k: F.regexp_extract(text, form, k)
    clock = F.coalesce(part(1).try_cast("int"), F.lit(0)) * 3600 + part(2).cast("int") * 60 + part(3).cast("int") + F.coalesce(F.rpad(F.nullif(part(4), F.lit("")), 3, "0").try_cast("int"), F.lit(0)) / 1000
    return F.when(text.rlike(form), F.when((part(1) == "") | (part(2).try_cast("int") < 60), clock)).when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))


def clock(ms: Column) -> Column:
    """Milliseconds as ``MM:SS.mmm``."""
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)


def srt_clock(ms: Column) -> Column:
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def safe_name(text: Column) -> Column:
    """A file system's safe identifier."""
    name = F.btrim(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), F.lit("-."))
    return F.when(name == "", "item").otherwise(name)


def orientation(width: Column, height: Column) -> Column:
    return F.when(width > height, "landscape").when(width < height, "portrait").when(width == height, "square")


def bgr(colour: Column) -> Column:
    """``#RRGGBB`` as ``&H00BBGGRR``."""
    return F.concat(F.lit("&H00"), F.upper(F.concat(F.substring(colour, 6, 2), F.substring(colour, 4, 2), F.substring(colour, 2, 2))))


def numbers_in(text: Column) -> Column:
    """Years first, then other numbers."""
    years = F.regexp_extract_all(text, F.lit(r"\b(?:1[0-9]|20)[0-9]{2}\b"), F.lit(0))
    every = F.regexp_extract_all(text, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0))
    return F.concat(F.array_distinct(years), F.array_except(every, years))


def shorten(words_: Column, limit: int) -> Column:
    """Longest prefix of words whose joined text stays within a limit."""
    fold = F.aggregate(words_, F.struct(F.lit("").alias("s"), F.lit(False).alias("done")), lambda a, w: F.when(a["done"], a).when(F.length(F.concat_ws(" ", F.nullif(a["s"], F.lit("")), w)) > limit, F.struct(a["s"].alias("s"), F.lit(True).alias("done"))).otherwise(F.struct(F.concat_ws(" ", F.nullif(a["s"], F.lit("")), w).alias("s"), F.lit(False).alias("done"))))
    return fold["s"]


def counts_map(bag: Column) -> Column:
    """Term to count, inside the row."""
    return F.map_from_arrays(F.array_distinct(bag), F.transform(F.array_distinct(bag), lambda t: F.size(F.filter(bag, lambda x: x == t))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two count maps; 0 where either is empty."""
    dot = F.aggregate(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) * F.coalesce(y, F.lit(0)))), F.lit(0), lambda s, x: s + x)
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0), lambda s, x: s + x * x).cast("double"))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))
