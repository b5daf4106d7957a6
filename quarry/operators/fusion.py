"""Merging candidate lists: outer joins, reciprocal rank fusion, composite ranking, duplicates, and the whole ranked search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import scores as S

from . import bm25 as BM
from . import vector as V


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the order; the order ends in a unique column."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def merge_sources(vector: DataFrame, text: DataFrame, key: str) -> DataFrame:
    """Full outer join of (key, distance) and (key, score), with where each row came from."""
    x = vector.select(key, "distance").join(text.select(key, "score"), key, "full_outer")
    source = F.when(F.col("distance").isNull(), "bm25").when(F.col("score").isNull(), "vector").otherwise("hybrid")
    return x.withColumn("found_by", source)


def two_source_rank(vector: DataFrame, text: DataFrame, key: str, k: int) -> DataFrame:
    m = merge_sources(vector, text, key)
    score = F.when(F.col("found_by") == "hybrid", S.two_source_score(F.col("distance"), F.col("score"))).when(F.col("found_by") == "vector", 1 - F.col("distance")).otherwise(F.least(F.col("score") / 10, F.lit(1.0)))
    return m.withColumn("hybrid", F.round(score, 9)).orderBy(F.desc("hybrid"), key).limit(k)


def with_ranks(df: DataFrame, key: str, orders: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Places 1, 2, … for each signal, null where the signal is null. Candidates are few by then; give `by` in batch mode."""
    for name, order in orders.items():
        w = W.partitionBy(*by, F.col(name).isNull()).orderBy(order, key)
        df = df.withColumn(f"{name}_rank", F.when(F.col(name).isNotNull(), F.row_number().over(w)))
    return df


def fuse(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Columns distance, keyword, title, bm25 (null: not found by it) -> their ranks and rrf."""
    orders = {"distance": F.col("distance").asc(), "keyword": F.col("keyword").desc(), "title": F.col("title").desc(), "bm25": F.col("bm25").desc()}
    x = with_ranks(df, key, orders, by)
    return x.withColumn("rrf", S.rrf(*[F.col(f"{c}_rank") for c in orders]))


@dataclass(frozen=True)
class SearchRules:
    """What the ranked search knows beside the query. Words are lower case and looked for in the lower-case title unless said otherwise."""

    min_chars: int = 100
    pool: int = 150
    """Candidates of each source."""
    rescued: int = 15
    """Rows a title candidate may bring in."""
    fused: int = 75
    """Rows that are ranked by signal; the others get a tenth of their first score."""
    composed: int = 50
    """Rows whose composite score counts in full; the others' counts half."""
    meeting: Sequence[str] = ()
    """Words of meeting notes: such rows are dropped."""
    meeting_terms: Sequence[str] = ()
    """Words in the text that take a tenth off the fused score."""
    deprecated: Sequence[str] = ()
    generic: Sequence[str] = ()
    """Titles of generic documents: half of the fused score."""
    domain: Sequence[str] = ()
    """Words of the query's domain: each adds half, twice as much at most."""
    tags: Sequence[str] = ()
    """Labels that the query asks for: one doubles the fused score, more triple it (composite: 3 and 6)."""
    penalties: Sequence[tuple[str, float]] = ()
    """Factors for words in the title; the first that fits counts."""
    approved: Sequence[str] = ()
    expanded: int = 2
    """Pages that a result may bring in over references."""


def _any(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, w: a | F.contains(c, F.lit(w)), words, F.lit(False))


def _count(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, w: a + F.contains(c, F.lit(w)).cast("int"), words, F.lit(0))


def rescue(docs: DataFrame, key: str, terms: Sequence[str], most: int) -> DataFrame:
    """key, rescued: rows whose title has a term, the first `most` a term; .05 if the title has all terms, else .2."""
    t = F.lower("title")
    found = F.filter(F.array(*map(F.lit, terms)), lambda k: F.contains(t, k))
    m = docs.select(key, F.size(found).alias("n"), F.explode(found).alias("k"))
    m = m.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy(key))).filter(F.col("rn") <= most)
    return m.groupBy(key).agg(F.min(F.when(F.col("n") == len(terms), 0.05).otherwise(0.2)).alias("rescued"))


def held(df: DataFrame) -> DataFrame:
    """Rows whose number the rules bound (a few hundred, without texts), fetched once, so that what follows does not run the search again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def ranked_search(docs: DataFrame, vectors: DataFrame, key: str, query: list[float], terms: Sequence[str], k: int, rules: SearchRules = SearchRules(), references: DataFrame | None = None, index: BM.SavedIndex | None = None) -> DataFrame:
    """The whole ranked search: vector, text and title candidates, filters, signals, fusion, one row a title, composite scores, expansion.

    docs: key, title, content, labels. vectors: key, embedding. references: src, dst, weight. index: a saved index of docs, if
    there is one (see bm25.save_index). Every source is cut to its pool first, so what is ranked is a few hundred rows; only those are fetched.
    Result: key, title, found_by, rrf, composite, display (0 to 100)."""
    near = V.knn(vectors, "embedding", key, query, rules.pool).select(key, "distance")
    fields = ("title", "content", "labels")
    flat = docs.withColumn("labels", F.array_join("labels", " "))
    text = index.search(terms, rules.pool, fields) if index else BM.search(flat, key, terms, rules.pool, fields)
    m = merge_sources(near, text.select(F.col("id").alias(key), "score"), key).withColumnRenamed("score", "bm25")
    m = m.join(rescue(docs, key, terms, rules.rescued), key, "full_outer")
    m = m.withColumns({"distance": F.least("distance", "rescued"), "found_by": F.coalesce("found_by", F.lit("title"))})
    x = docs.join(F.broadcast(held(m)), key).withColumns({"t": F.lower("title"), "c": F.lower("content")})
    x = x.filter((F.length("content") >= rules.min_chars) & ~_any(F.col("t"), rules.meeting) & ~_any(F.col("t"), rules.deprecated))
    low = F.transform("labels", F.lower)
    plain = reduce(lambda a, w: a + F.exists(low, lambda v: F.contains(v, F.lit(w))).cast("int"), terms, F.lit(0)) / F.lit(float(len(terms)))
    tags = reduce(lambda a, w: a + F.array_contains(low, w).cast("int"), rules.tags, F.lit(0))
    label = S.label_score(plain, _any(F.col("t"), rules.domain), _any(F.col("t"), terms), tags, F.lit(False), _any(F.col("t"), rules.approved))
    x = x.select(
        key, "title", "t", "found_by", "distance", "bm25",
        BM.title_ratio(F.col("title"), terms).alias("ratio"),
        S.keyword_score(F.col("title"), F.col("content"), F.col("labels"), list(terms), []).cast("double").alias("keyword"),
        label.alias("label"), tags.alias("tags"), _count(F.col("t"), rules.domain).alias("domains"),
        _any(F.col("c"), rules.meeting_terms).alias("meeting"), _any(F.col("t"), rules.generic).alias("generic"),
    )
    # First the order that decides who is fused: keyword score, then distance.
    x = held(x).withColumn("title_score", F.when(F.col("ratio") > 0, F.col("ratio")))
    place = F.row_number().over(W.orderBy(F.desc("keyword"), F.col("distance").asc_nulls_last(), key))  # a few hundred rows
    x = x.withColumn("place", place)
    head = fuse(x.filter(F.col("place") <= rules.fused).withColumn("title_", F.col("title")).withColumn("title", F.col("title_score")), key).withColumn("title", F.col("title_")).select(key, "rrf")
    x = x.join(head, key, "left").withColumn("rrf", F.coalesce("rrf", 0.1 * S.hybrid_score(F.coalesce("distance", F.lit(1.0)), F.col("keyword"), F.col("tags")) / 60))
    factor = F.when(F.col("meeting"), 0.9).otherwise(1.0) * F.when(F.col("generic"), 0.5).otherwise(1.0) * S.domain_boost(F.col("domains")) * S.tag_boost(F.col("tags"), 2.0, 3.0)
    x = x.withColumn("rrf", F.round(F.col("rrf") * factor, 9))
    x = first_by(x, ["t"], F.desc("rrf"), F.col(key))
    title = F.greatest(F.coalesce("title_score", F.lit(0.0)), F.when(F.col("distance") <= 0.05, 0.9).otherwise(0.0))
    score = S.composite(F.coalesce("distance", F.lit(2.0)), F.coalesce("bm25", F.lit(0.0)), title, F.col("label")) * S.tag_boost(F.col("tags"), 3.0, 6.0)
    penalty = reduce(lambda out, p: F.when(F.contains("t", F.lit(p[0])), p[1]).otherwise(out), reversed(rules.penalties), F.lit(1.0))
    x = x.withColumn("place", F.row_number().over(W.orderBy(F.desc("rrf"), key)))
    x = x.withColumn("composite", F.round(score * penalty * F.when(F.col("place") <= rules.composed, 1.0).otherwise(0.5), 9))
    shown = F.round(S.display_score(F.col("composite"), F.col("bm25"), F.col("distance")), 1)
    best = x.orderBy(F.desc("composite"), F.desc("rrf"), key).limit(k).select(key, "title", "found_by", "rrf", "composite", shown.alias("display"))
    if references is None:
        return best
    best = held(best)
    linked = references.filter("weight >= 0.7").join(F.broadcast(best.select(F.col(key).alias("src"))), "src", "left_semi")  # k rows
    linked = linked.withColumn("rn", F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))).filter(F.col("rn") <= rules.expanded)
    new = linked.select(F.col("dst").alias(key)).distinct().join(best.select(key), key, "left_anti")
    more = docs.join(F.broadcast(new), key).select(key, "title", F.lit("reference").alias("found_by"), F.lit(0.0).alias("rrf"), F.lit(0.0).alias("composite"), F.round(S.similarity_percent(F.lit(0.4)), 1).alias("display"))
    return best.unionByName(more)
