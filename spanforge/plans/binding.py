"""How a query and its DuckDB statement are registered together, and pieces of SQL that many share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.functions import text as T

Query = Callable[[SparkSession, str], DataFrame]


class Plans:
    """Queries of one module by name; ``sql`` is None where SQL can't say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.oracles[query.__name__] = sql
            return query

        return register


#: ``l``: lines of documents.
LINES = """l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as idx,
  unnest(string_split(text, chr(10))) as text from documents)"""


def listed(words: list[str] | tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def fold_b(x: str) -> str:
    return f"translate(lower({x}), '{T.ACCENTED}', '{T.PLAIN}')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(trim(replace({fold_b(x)}, 'ß', 'ss')), '[a-z0-9]+')"


def raw_tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[0-9A-Za-zÀ-ÿ]+'), lambda r: {fold_b('r')})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex(trim({x}), '\\s+'), lambda v: v <> '')"


def content(x: str) -> str:
    """Content terms with repeats, in order."""
    return f"list_filter({raw_tokens(x)}, lambda c: length(c) >= 4 and not list_contains({listed(T.STOPWORDS + T.GENERIC)}, c))"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' ')"
