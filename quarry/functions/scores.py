"""Scoring formulas of the ranked search, as column expressions. Distances are smaller-is-better unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null, unlike in greatest() and least()."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def similarity_percent(d: Column) -> Column:
    return F.round((1 - clamp(d)) * 100, 1)


def similarity_score(d: Column) -> Column:
    return F.when(d > 1, 100 / (1 + d)).otherwise(100 * (1 - d))


def bm25_percent(s: Column, top: float = 20.0) -> Column:
    return F.round(100 * clamp(s / top))


def hybrid_score(d: Column, keyword: Column, label: Column, w: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> Column:
    """A distance and two capped scores, weighted. The distance term is lower-better while the others are higher-better, by definition."""
    return w[0] * clamp(d) + w[1] * F.least(F.lit(1.0), keyword / 10) + w[2] * F.least(F.lit(1.0), label / 5)


def two_source_score(d: Column, bm25: Column) -> Column:
    return 0.5 * (1 - d) + 0.5 * F.least(F.coalesce(bm25, F.lit(0.0)) / 10, F.lit(1.0))


def keyword_score(title: Column, content: Column, labels: Column, high: list[str], low: list[str]) -> Column:
    """5 for each keyword in the title, 2 in a label, 1 in the content; +2 for each high and +1 for each low keyword whether it matches or not."""
    total = F.lit(0)
    for k in [*high, *low]:
        hit = lambda c: F.contains(F.lower(c), F.lit(k.lower())).cast("int")
        total = total + 5 * hit(title) + 2 * F.exists(labels, lambda x: F.contains(F.lower(x), F.lit(k.lower()))).cast("int") + hit(content)
    return total + F.lit(2 * len(high) + len(low))


def rrf(vector_rank: Column, keyword_rank: Column, title_rank: Column, bm25_rank: Column, k: int = 60) -> Column:
    """Reciprocal ranks; a missing vector or keyword rank counts as a million, a missing title or BM25 rank as nothing."""
    far = F.lit(1_000_000)
    some = lambda w, r: F.coalesce(w / (k + r), F.lit(0.0))
    return 1.0 / (k + F.coalesce(vector_rank, far)) + 0.8 / (k + F.coalesce(keyword_rank, far)) + some(1.2, title_rank) + some(0.6, bm25_rank)


def composite(d: Column, bm25: Column, title: Column, label: Column, w: tuple[float, float, float, float] = (0.05, 0.53, 0.26, 0.16)) -> Column:
    return w[0] * (1 - F.least(d / 2, F.lit(1.0))) + w[1] * F.least(bm25 / 30, F.lit(1.0)) + w[2] * title + w[3] * label


def tag_boost(hits: Column, one: float, many: float) -> Column:
    return F.when(hits > 1, many).when(hits == 1, one).otherwise(1.0)


def domain_boost(n: Column) -> Column:
    return F.least(1 + 0.5 * n, F.lit(2.0))


def label_score(plain_share: Column, domain: Column, feature: Column, tags: Column, category: Column, approved: Column) -> Column:
    """A fifth from plain labels, the rest from structured matches (booleans, and a count of tags), capped at 1."""
    structured = 2 * domain.cast("int") + 3 * feature.cast("int") + F.least(0.8 * tags, F.lit(2.0)) + 0.3 * category.cast("int") + 0.2 * approved.cast("int")
    return clamp(0.2 * plain_share + 0.8 * structured / 7.5)


def priority_boost(p: Column) -> Column:
    return F.when(p == "critical", 2.0).when(p == "high", 1.0).when(p == "medium", 0.5).otherwise(0.0)


def status_boost(s: Column) -> Column:
    return F.when(s == "approved", 1.5).when(s == "review", 0.5).when(s == "deprecated", -2.0).otherwise(0.0)


def query_quality(n_keywords: Column, length: Column) -> Column:
    return F.least(F.least(0.2 * n_keywords, F.lit(1.0)) + F.least(length / 100, F.lit(0.3)), F.lit(1.0))


def display_score(composite_: Column, bm25: Column, d: Column) -> Column:
    return clamp(F.coalesce(composite_ * 100, bm25 * 10, similarity_percent(d)), 0.0, 100.0)


def generic_weight(term: Column, very: list[str], some: list[str]) -> Column:
    return F.when(term.isin(*very), 0.3).when(term.isin(*some), 0.5).otherwise(1.0)
