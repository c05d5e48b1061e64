"""URL filter: rules first, then a character language-model ratio.

Rules (host and path) decide the URLs they fit; the longest wins. For the rest, two smoothed
variable-order Markov models are learned, one from the URLs that rules allow and one from
those they block. They read the whole URL after its scheme, query and fragment too; host and
path are the rules' only. A URL is read as symbols of a closed alphabet of 32; the chance of a
symbol after a context is interpolated from orders 0 to ``ORDER`` (Witten-Bell: a context
seen t times with d different successors leaves d / (t + d) to the shorter one). The score
is the mean over the URL's symbols of log P_accepted - log P_rejected, and the cut is
calibrated on ruled URLs that training doesn't see: where both classes lie equally many of
their own standard deviations from it.

Counts grow with the corpus, the model doesn't: it has at most 32 + 32^2 + 32^3 + 32^4
rows of two numbers, which is the bound under which it is broadcast. Everything is
DataFrame expressions; every count is pre-aggregated before it is shuffled.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule;
the models read one without ``://`` from its beginning. Null and empty URLs and those that
end with their scheme have no symbols. Where no rule allows or none blocks anything there is no ratio, and what has no
rule is allowed; so is a URL without symbols. Repeated rows come back as often as they came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanforge.llm.common import ascii_lower_col, cleared, published

#: (verdict, rule): host, then path from the first slash.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Symbols before the one that is predicted.
ORDER = 3
#: One of so many ruled URLs calibrates the cut and is not learned from.
CALIBRATION = 4
#: Letters, then one symbol for all digits, then separators; any other character is '?'.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0./-?"
_SIZE = 32  # the alphabet and the mark of the beginning


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower_col(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rest_of(url: Column) -> Column:
    """What the models read: all behind the first ``://``, or the whole URL without one."""
    return F.coalesce(F.regexp_replace(url, r"(?s)^.*?://(.*)$", "$1"), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, or null. A rule fits its host and all subdomains."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    found = F.lit(None).cast("string")
    for verdict, name in rules:
        found = F.when(rule == name, F.lit(verdict)).otherwise(found)
    return found


def symbols(rest: Column) -> Column:
    """Symbol numbers of a URL without its scheme: 1 to 31."""
    letters = F.split(F.regexp_replace(F.regexp_replace(F.lower(rest), "[0-9]", "0"), r"[^a-z0./\-]", "?"), "")
    return F.transform(F.filter(letters, lambda x: x != ""), lambda x: F.position(x, F.lit(ALPHABET)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(url_symbols: Column) -> Column:
    """For each symbol the base-32 number of it and its ORDER predecessors (0: the beginning)."""
    padded = F.concat(F.array_repeat(F.lit(0), ORDER), url_symbols)

    def body(s: Column) -> Column:
        def one(i: Column) -> Column:
            code = F.get(s, i).cast("long")
            for k in range(1, ORDER + 1):
                code = code * _SIZE + F.get(s, i + k)
            return code

        return F.when(F.size(s) > ORDER, F.transform(F.sequence(F.lit(0), F.size(s) - (ORDER + 1)), one)).otherwise(F.expr("cast(array() as array<bigint>)"))

    return _let(padded, body)


def model(counts: DataFrame) -> DataFrame:
    """``level, gram, llr``: log ratio of each gram of ORDER + 1 symbols that was seen, and of
    each shorter one, for contexts that were never seen.

    ``counts``: ``gram, a, r``, occurrences in accepted and rejected URLs. A gram's low digits
    are its last symbols, so the gram of a shorter context is the remainder.
    """
    shorter = counts
    levels = {}
    for level in range(ORDER, -1, -1):
        wide = _SIZE ** (level + 1)
        levels[level] = shorter = published(shorter.select((F.col("gram") % wide).alias("gram"), "a", "r").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "url-counts")
    chances = None
    for level in range(ORDER + 1):
        context = Window.partitionBy(F.floor(F.col("gram") / _SIZE)) if level else Window.partitionBy(F.lit(0))
        seen = levels[level]
        for c in ("a", "r"):
            total, kinds = F.sum(c).over(context), F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).over(context)
            seen = seen.withColumn(f"t{c}", total).withColumn(f"d{c}", kinds)
        if chances is None:
            lower = seen.withColumn("la", F.lit(1 / _SIZE)).withColumn("lr", F.lit(1 / _SIZE))
        else:
            base = chances.select(F.col("gram").alias("g"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
            lower = seen.join(base, F.col("gram") % (_SIZE**level) == F.col("g")).drop("g")
        mix = lambda c: F.when(F.col(f"t{c}") > 0, (F.col(c) + F.col(f"d{c}") * F.col(f"l{c}")) / (F.col(f"t{c}") + F.col(f"d{c}"))).otherwise(F.col(f"l{c}"))
        chances = published(lower.select(F.lit(level).alias("level"), "gram", mix("a").alias("pa"), mix("r").alias("pr")), "url-model")
        levels[level] = chances
    out = levels[0]
    for level in range(1, ORDER + 1):
        out = out.unionByName(levels[level])
    return out.select("level", "gram", F.log(F.col("pa") / F.col("pr")).alias("llr"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``; score: the mean log ratio less the cut."""
    with cleared(pages.sparkSession):
        return published(_judged(pages, rules), "url-verdicts", keep=True)


def _judged(pages: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    # rows alike are judged once and counted, so a hot URL is pre-aggregated
    rows = named.groupBy("page_id", "url", "host", "path").agg(F.count("*").alias("copies")).withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("ruled", verdict_of(F.col("rule"), rules))
    rows = published(rows.withColumn("fold", F.pmod(F.crc32(F.concat("host", "path")), F.lit(CALIBRATION))), "url-rows")
    spread = rows.select("page_id", "url", "copies", "ruled", "fold", F.explode_outer(grams(symbols(rest_of(F.col("url"))))).alias("gram")).where(F.col("gram").isNotNull())
    learned = spread.where("ruled is not null and fold > 0").groupBy("gram").agg(
        F.sum(F.when(F.col("ruled") == "allow", F.col("copies")).otherwise(0)).alias("a"), F.sum(F.when(F.col("ruled") == "block", F.col("copies")).otherwise(0)).alias("r")
    )
    learned = published(learned, "url-grams")
    classes = learned.agg(F.sum("a").alias("a"), F.sum("r").alias("r")).first()
    if not (classes["a"] and classes["r"]):
        return _copies(rows.withColumn("score", F.lit(None).cast("double")).withColumn("verdict", F.coalesce("ruled", F.lit("allow"))))
    table = published(model(learned), "url-ratios")
    scored = spread
    for level in range(ORDER, -1, -1):  # the longest gram that the model has; 32^4 rows at most
        own = F.broadcast(table.where(F.col("level") == level).select(F.col("gram").alias(f"g{level}"), F.col("llr").alias(f"l{level}")))
        scored = scored.join(own, F.col("gram") % (_SIZE ** (level + 1)) == F.col(f"g{level}"), "left").drop(f"g{level}")
    ratio = F.coalesce(*(F.col(f"l{k}") for k in range(ORDER, -1, -1)), F.lit(0.0))
    means = published(scored.groupBy("page_id", "url").agg((F.round(F.avg(ratio), 9)).alias("mean")), "url-scores")
    both = rows.join(means.select(F.col("page_id").alias("p"), F.col("url").alias("u"), "mean"), F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u")), "left").drop("p", "u")
    cut = calibrated(both)
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("mean") < F.lit(cut), "block").otherwise("allow"))
    return _copies(both.withColumn("score", F.col("mean") - F.lit(cut)).withColumn("verdict", verdict))


def calibrated(scored: DataFrame) -> float:
    """Where accepted and rejected URLs lie equally many deviations away; one row of sums."""
    held = scored.where("ruled is not null and fold = 0 and mean is not null")
    is_ = lambda v: F.when(F.col("ruled") == v, F.col("mean"))
    x = held.agg(F.avg(is_("allow")).alias("ma"), F.stddev_pop(is_("allow")).alias("sa"), F.avg(is_("block")).alias("mr"), F.stddev_pop(is_("block")).alias("sr")).first()
    if x["ma"] is None or x["mr"] is None:
        return 0.0
    sa, sr = x["sa"] + 1e-6, x["sr"] + 1e-6
    return round((x["ma"] * sr + x["mr"] * sa) / (sa + sr), 6)


def _copies(rows: DataFrame) -> DataFrame:
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.select("page_id", "host", "path", "rule", "verdict", "score", again.alias("copy")).drop("copy")
