"""Queries of card geometry: cards made of the lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.plans import cards
from spanforge.plans.binding import Plans
from spanforge.sources.catalog import table

query = Plans()
_L = "string_split(text, chr(10))[1:6]"
_CARD = f"""k as (select doc_id as card_id, {_L} as ls from documents where text is not null), z as (select card_id, ls, len(ls) as n, list_max(list_transform(ls, lambda x: length(x))) as longest from k),
s as (select card_id, ls, n, greatest(least(64, floor(1680 / (greatest(longest, 1) * 0.6::double))::int), 12) as size from z),
r as (select card_id, size, n, generate_subscripts(ls, 1) - 1 as idx, unnest(ls) as text from s)"""


def _cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("card_id"), F.slice(F.split("text", "\n"), 1, 6).alias("lines"))


@query(f"""with {_CARD} select card_id, idx, text, 120 as x, floor((1080 - n * (size * 1.4::double)) / 2 + idx * (size * 1.4::double))::int as y, size, length(text) * 0.6::double * size > 1680 as overflows from r""")
def statement_cards(spark: SparkSession, d: str) -> DataFrame:
    """Lines centred on the height, at the largest size that fits."""
    return cards.layout(_cards(spark, d))


@query(f"""with {_CARD}, m as (select *, greatest(least(40, floor(1680 / (greatest(max(length(text)) over (partition by card_id) + 4, 1) * 0.6::double))::int), 12) as fit from r)
select card_id, idx, printf('%2d  ', idx + 1) || text as text, 120 as x, (200 + idx * floor(fit * 1.4::double))::int as y, fit as size from m""")
def mono_cards(spark: SparkSession, d: str) -> DataFrame:
    """Numbered lines of one width from the top on."""
    return cards.mono(_cards(spark, d), top=200)


@query(f"""with {_CARD} select card_id, idx, '• ' || text as text, 160 as x, (200 + idx * ((1080 - 120 - 200) // n))::int as y from r""")
def list_cards(spark: SparkSession, d: str) -> DataFrame:
    """Items spread evenly between the top and the lower margin."""
    return cards.listed(_cards(spark, d), top=200)


@query(f"""with {_CARD} select card_id, idx, text, (120 + idx * (1680 // n))::int as x, (1680 // n - 40)::int as width, idx < n - 1 as arrow from r""")
def chain_cards(spark: SparkSession, d: str) -> DataFrame:
    """Boxes side by side, an arrow behind each but the last."""
    return cards.chain(_cards(spark, d))


@query(f"""with {_CARD}, h as (select *, (n + 1) // 2 as half from r) select card_id, idx, text, case when idx < half then 120 else 960 + 20 end as x, (200 + case when idx < half then idx else idx - half end * 90)::int as y, case when idx < half then 'left' else 'right' end as side from h""")
def compare_cards(spark: SparkSession, d: str) -> DataFrame:
    """Two columns; the left one has the odd line."""
    return cards.compare(_cards(spark, d), top=200)


@query("""select event_id as card_id, f as text, floor((1920 - length(f) * 0.6::double * size) / 2)::int as x, floor(1080 / 2 - size / 2)::int as y, size
from (select event_id, f, least(300, floor(1680 / (length(f) * 0.6::double))::int) as size from (select event_id, floor(value * 1000)::bigint::varchar as f from events))""")
def stat_cards(spark: SparkSession, d: str) -> DataFrame:
    """One figure, as large as fits, in the middle."""
    figures = table(spark, d, "events").select(F.col("event_id").alias("card_id"), F.floor(F.col("value") * 1000).cast("long").cast("string").alias("text"))
    return cards.stat(figures)


@query("select event_id as card_id, (['list', 'stat', null])[event_id % 3 + 1] as kind, case when event_id % 3 = 2 then 'unknown kind' when event_id % 2 = 0 then 'unknown key: colour' end as issue from events")
def card_records(spark: SparkSession, d: str) -> DataFrame:
    """Cards read from JSON with closed keys."""
    kind = F.get(F.array(*map(F.lit, ("list", "stat", "poster"))), (F.col("event_id") % 3).cast("int"))
    payload = F.concat(F.lit('{"kind":"'), kind, F.lit('","lines":["a"]'), F.when(F.col("event_id") % 2 == 0, ',"colour":"red"').otherwise(""), F.lit("}"))
    return cards.card_of(table(spark, d, "events").select(F.col("event_id").alias("card_id"), payload.alias("payload")))


QUERIES, ORACLES = query.queries, query.oracles
