"""Predicates and row filters of search, ingest and dashboards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEETING = ("meeting", "minutes", "standup", "retrospective", "agenda", "kickoff", "weekly", "sync notes")


def excludes(always: Sequence[str], conditional: dict[str, Sequence[str]], asked: Sequence[str] = ()) -> list[str]:
    """Labels to leave out: the constant ones, and the conditional ones whose topic is not asked for."""
    return sorted({*always, *(x for k, v in conditional.items() if k not in asked for x in v)})


def has_any(labels: Column, wanted: Sequence[str]) -> Column:
    """Any label equals one of wanted, whatever the case."""
    return F.arrays_overlap(F.transform(F.coalesce(labels, F.array().cast("array<string>")), F.lower), F.array(*[F.lit(x.lower()) for x in wanted]).cast("array<string>"))


def without(labels: Column, unwanted: Sequence[str]) -> Column:
    return F.filter(labels, lambda x: ~F.lower(x).isin(*[u.lower() for u in unwanted]))


def any_match(c: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(f"(?i){p}") for p in patterns], F.lit(False))


class LabelFilter:
    """Builds one predicate over the columns structured_*."""

    def __init__(self) -> None:
        self.parts: list[Column] = []

    def _in(self, name: str, values: Sequence[str]) -> LabelFilter:
        if values:
            self.parts.append(F.col(f"structured_{name}").isin(*values))
        return self

    def category(self, *v: str) -> LabelFilter:
        return self._in("category", v)

    def domain(self, *v: str) -> LabelFilter:
        return self._in("domain", v)

    def status(self, *v: str) -> LabelFilter:
        return self._in("status", v)

    def priority(self, *v: str) -> LabelFilter:
        return self._in("priority", v)

    def min_confidence(self, x: float) -> LabelFilter:
        self.parts.append(F.col("structured_confidence") >= x)
        return self

    def only_valid(self) -> LabelFilter:
        self.parts.append(F.col("structured_is_valid"))
        return self

    def build(self) -> Column:
        return reduce(lambda a, b: a & b, self.parts, F.lit(True))


def valid_pages(docs: DataFrame, labels: DataFrame, key: str, valid: str, content: str, min_chars: int = 100) -> DataFrame:
    """Keeps a labelled page unless its label says invalid, and an unlabelled one if it is long enough. labels: one row a key."""
    x = docs.join(labels.select(key, F.col(valid).alias("_valid"), F.lit(True).alias("_labelled")), key, "left")
    return x.filter(F.when(F.col("_labelled"), F.coalesce("_valid", F.lit(True))).otherwise(F.length(content) >= min_chars)).drop("_valid", "_labelled")


def facets(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "updated", equals: dict[str, str] | None = None) -> DataFrame:
    """Date range and equal values; rows without the value pass."""
    x = df
    if start:
        x = x.filter(F.col(date).isNull() | (F.col(date) >= F.lit(start).cast("timestamp_ntz")))
    if end:
        x = x.filter(F.col(date).isNull() | (F.col(date) <= F.lit(end).cast("timestamp_ntz")))
    for c, v in (equals or {}).items():
        x = x.filter(F.col(c).isNull() | (F.col(c) == v))
    return x


def build_query(df: DataFrame, where: Sequence[Column] = (), order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    x = reduce(lambda a, b: a.filter(b), where, df)
    x = x.orderBy(*order) if order else x
    return x.limit(limit) if limit is not None else x
