"""Keywords from a lexicon, and labels by rules."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keywords of one automaton; a larger lexicon is searched for in blocks of so many, each in a scan of the texts.
LEXICON_ROWS = 100_000


@functools.lru_cache(maxsize=4)
def _automaton(words: tuple[tuple[str, str], ...]):  # noqa: ANN202
    import ahocorasick

    found: dict[str, list[str]] = {}
    for keyword, category in words:
        found.setdefault(keyword, []).append(category)
    automaton = ahocorasick.Automaton()
    for keyword, categories in found.items():
        automaton.add_word(keyword, (keyword, categories))
    automaton.make_automaton()
    return automaton


def priority(category: Column, keyword: Column) -> Column:
    return (F.when(category == "core", 100).otherwise(80) + F.when(F.length(keyword).between(2, 8), 20).otherwise(0)).cast("int")


def matches(texts: DataFrame, key: str, text: str, lexicon: DataFrame, rows: int = LEXICON_ROWS) -> DataFrame:
    """(key, keyword, category) for each keyword that a text contains: every text is read once for a block of keywords, whatever their number."""
    schema = T.StructType([texts.schema[key], T.StructField("keyword", T.StringType()), T.StructField("category", T.StringType())])
    words = lexicon.filter("keyword <> ''").select("keyword", F.col("category").cast("string").alias("category")).distinct()
    blocks = max(1, -(-words.count() // rows))
    low = texts.select(key, F.lower(F.col(text)).alias("t")).filter("t IS NOT NULL")
    out = None
    for i in range(blocks):
        own = words.filter(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == i) if blocks > 1 else words
        sent = texts.sparkSession.sparkContext.broadcast(tuple(sorted((r.keyword, r.category) for r in own.collect())))  # one block

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            if not sent.value:
                return
            automaton = _automaton(sent.value)
            for pdf in batches:
                found = []
                for k, t in zip(pdf[key], pdf["t"], strict=True):
                    once = {word: categories for _, (word, categories) in automaton.iter(t)}
                    found.extend((k, word, c) for word, categories in once.items() for c in categories)
                yield pd.DataFrame(found, columns=[key, "keyword", "category"])

        got = low.mapInPandas(scan, schema)
        out = got if out is None else out.union(got)
    return out


def extract(texts: DataFrame, key: str, text: str, lexicon: DataFrame, top: int = 8) -> DataFrame:
    x = matches(texts, key, text, lexicon).withColumn("priority", priority(F.col("category"), F.col("keyword")))
    x = x.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(F.desc("priority"), "keyword")))
    return x.filter(F.col("rn") <= top).select(key, "keyword", "priority")


def intent(query: Column, rules: dict[str, Sequence[str]], other: str = "general") -> Column:
    """The first intent with a word in the query."""
    low, out = F.lower(query), F.lit(other)
    for name, words in reversed(rules.items()):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(name)).otherwise(out)
    return out


def query_keywords(queries: DataFrame, key: str, text: str, lexicon: DataFrame, domains: dict[str, Sequence[str]], intents: dict[str, Sequence[str]], top: int = 8) -> DataFrame:
    """key, domain, intent, keyword, place: the keywords of a query. Its domain is the one with most words in it; of the lexicon's keywords
    in it those stay that are relevant: core ones, those of the domain, and those that share a word start with the intent; 100 for a
    core one, 80 for one of the domain, 20 for a length of 2 to 8; the best `top`."""
    low = F.lower(F.col(text))
    score = lambda words: reduce(lambda a, w: a + F.contains(low, F.lit(w)).cast("int"), words, F.lit(0))
    best = F.array_max(F.array(*[F.struct(score(words).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(domains.items())]))
    q = queries.select(key, F.when(best["n"] > 0, best["name"]).otherwise("unknown").alias("domain"), intent(F.col(text), intents).alias("intent"))
    of_domain = F.create_map(*[x for name, words in domains.items() for x in (F.lit(name), F.array(*map(F.lit, words)))])
    x = matches(queries, key, text, lexicon).join(q, key)
    words = F.coalesce(F.try_element_at(of_domain, F.col("domain")), F.array().cast("array<string>"))
    near = F.exists(words, lambda w: F.contains(F.col("keyword"), w) | F.contains(w, F.col("keyword")))
    core, asked = F.col("category") == "core", F.startswith(F.col("intent"), F.col("keyword"))
    points = F.when(core, 100).otherwise(0) + F.when(near, 80).otherwise(0) + F.when(F.length("keyword").between(2, 8), 20).otherwise(0)
    x = x.filter(core | near | asked).withColumn("points", points.cast("int"))
    x = x.groupBy(key, "domain", "intent", "keyword").agg(F.max("points").alias("points"))
    w = W.partitionBy(key).orderBy(F.desc("points"), "keyword")
    return x.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select(key, "domain", "intent", "keyword", "points", "place")


def shared_terms(query: Column, title: Column, terms: Sequence[str]) -> Column:
    """How many domain terms are in the query and in the title."""
    q, t = F.lower(query), F.lower(title)
    return F.size(F.filter(F.array(*[F.lit(x.lower()) for x in terms]), lambda x: F.contains(q, x) & F.contains(t, x)))


@dataclass(frozen=True)
class LabelRules:
    """The words of rule labelling. Earlier entries win. pairs: domain -> sets of words of which a text has all (half as much again)."""

    by_label: dict[str, str]
    by_title: dict[str, str]
    by_body: dict[str, str]
    domains: dict[str, Sequence[str]]
    pairs: dict[str, Sequence[Sequence[str]]] = field(default_factory=dict)
    statuses: dict[str, str] = field(default_factory=dict)
    tags: dict[str, Sequence[str]] = field(default_factory=dict)
    priorities: dict[tuple[str, str], str] = field(default_factory=dict)
    by_category: dict[str, str] = field(default_factory=dict)
    fallback_category: str = "spec"
    fallback_status: str = "approved"


def rule_labels(docs: DataFrame, title: Column, content: Column, labels: Column, rules: LabelRules, min_chars: int = 100) -> DataFrame:
    """docs with category (from labels, then the title, then the first 500 characters), domain (2 for a word in the title, 1 in the first 1000
    characters, 1.5 for words that come together; the first of equals), status, priority, tags (in title or first 800 characters), confidence
    (.7, and .1 for each of the three that were found), is_valid (long enough) and feature, the cleaned title. With fewer than two of the three found
    there is no rule label: category, domain, status, priority, tags, feature and confidence are null."""
    t, body = F.lower(title), F.lower(content)
    b500, b1000 = F.substr(body, F.lit(1), F.lit(500)), F.substr(body, F.lit(1), F.lit(1000))
    has = lambda c, w: F.contains(c, F.lit(w))

    def first(cases: list[tuple[Column, str]], other: str) -> Column:
        return reduce(lambda out, case: F.when(case[0], F.lit(case[1])).otherwise(out), reversed(cases), F.lit(other))

    category = first([*((F.array_contains(labels, w), c) for w, c in rules.by_label.items()), *((has(t, w), c) for w, c in rules.by_title.items()), *((has(b500, w), c) for w, c in rules.by_body.items())], "other")
    both = F.concat(t, F.lit(" "), b1000)

    def points(name: str) -> Column:
        words = rules.domains[name]
        some = lambda c: reduce(lambda a, x: a | x, [has(c, w) for w in words])
        together = [reduce(lambda a, x: a & x, [has(both, w) for w in own]) for own in rules.pairs.get(name, ())]
        return F.when(some(t), 2.0).otherwise(0.0) + F.when(some(b1000), 1.0).otherwise(0.0) + (F.when(reduce(lambda a, x: a | x, together), 1.5).otherwise(0.0) if together else F.lit(0.0))

    best = F.array_max(F.array(*[F.struct(points(d).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(rules.domains)]))
    status = first([(has(t, w), v) for w, v in rules.statuses.items()], "unknown")
    tag_text = F.concat(t, F.lit(" "), F.substr(body, F.lit(1), F.lit(800)))
    tags = F.array_compact(F.array(*[F.when(reduce(lambda a, x: a | x, [has(tag_text, w) for w in words]), F.lit(tag)) for tag, words in rules.tags.items()]).cast("array<string>"))
    x = docs.withColumn("_l", F.struct(category.alias("category"), best.alias("best"), status.alias("status")))
    found = (F.col("_l.category") != "other").cast("int") + (F.col("_l.best.n") > 0).cast("int") + (F.col("_l.status") != "unknown").cast("int")
    known = found >= 2
    category_ = F.when(F.col("_l.category") == "other", rules.fallback_category).otherwise(F.col("_l.category"))
    status_ = F.when(F.col("_l.status") == "unknown", rules.fallback_status).otherwise(F.col("_l.status"))
    priority_ = first([*(((category_ == c) & (status_ == v), p) for (c, v), p in rules.priorities.items()), *((category_ == c, p) for c, p in rules.by_category.items())], "medium")
    values = {"category": category_, "domain": F.when(F.col("_l.best.n") > 0, F.col("_l.best.d")).otherwise("none"), "status": status_, "priority": priority_, "tags": tags, "feature": F.trim(F.regexp_replace(title, r"^[^\p{L}]*", "")), "confidence": F.lit(0.7) + F.lit(0.1) * found}
    return x.withColumns({n: F.when(known, c) for n, c in values.items()}).withColumn("is_valid", F.length(content) >= min_chars).drop("_l")
