"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


def entries() -> dict[str, Entry]:
    from .plans import bound, extras, languages, programs, scores, sources, texts

    return scores.entries() | texts.entries() | programs.entries() | extras.entries() | sources.entries() | languages.entries() | bound.entries()


def queries() -> dict[str, Query]:
    return {name: e.run for name, e in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in entries().items() if e.sql}
