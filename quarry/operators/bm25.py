"""An inverted index as DataFrames and Okapi BM25 over it; title matching."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import tables

K1, B = 1.2, 0.75
BOOSTS = {"title": 3.0, "content": 1.0, "labels": 2.0}


Analyzer = Callable[[Column], Column]


def tokens(c: Column, analyzer: Analyzer | None = None) -> Column:
    """Lower-cased runs of letters and digits. For scripts without spaces, `analyzer` takes their place: a function from a text column to a column
    of token arrays, such as a pandas UDF over a morphological analyzer."""
    return analyzer(c) if analyzer else F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def nouns(c: Column, analyzer: Analyzer | None = None) -> Column:
    """The tokens that name something. Without an analyzer that knows parts of speech: those that start with a capital letter."""
    return analyzer(c) if analyzer else F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda t: t.rlike(r"^\p{Lu}"))


def light_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9_]+|[^\x00-\x7F]+)"), F.lit(1))


def hits(term: Column, terms: Sequence[str], wildcard: bool = False) -> Column:
    """Whether a term is one of the terms; with wildcard, whether it contains one."""
    out = F.lit(False)
    for t in terms:
        out = out | (F.contains(term, F.lit(t)) if wildcard else term == t)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, field, t (tokens) -> term, id, field, len, tf: tokens are numbered within a batch, and (row, number) pairs counted."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(batch.column("t")).dictionary_encode()
        if not len(coded):
            continue
        n = len(coded.dictionary)
        pairs, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + coded.indices.to_numpy(), return_counts=True)
        row = pa.array(pairs // n)
        own = [batch.column(c).take(row) for c in ("id", "field")]
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(pairs % n)), *own, pa.array(sizes[pairs // n].astype(np.int32)), pa.array(tf)], names=["term", "id", "field", "len", "tf"])


def postings(docs: DataFrame, key: str, fields: Sequence[str], keep: Callable[[Column], Column] | None = None, analyzer: Analyzer | None = None) -> DataFrame:
    """term, id, field, len, tf: the index, or the part of it whose terms pass `keep`. Keys are unique, so terms are counted inside each row: nothing
    is shuffled."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f), analyzer).alias("t")) for f in fields])
    x = docs.select(F.col(key).alias("id"), F.inline(each)).filter("t IS NOT NULL")
    if keep:
        x = x.select("id", "field", F.size("t").alias("len"), F.explode(F.filter("t", keep)).alias("term"))
        return x.groupBy("term", "id", "field", "len").agg(F.count(F.lit(1)).alias("tf"))
    return x.mapInArrow(_counted, f"term string, id {docs.schema[key].dataType.simpleString()}, field string, len int, tf long")


def field_stats(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: number of documents and mean length of each field. Tokens are counted, not made."""
    length = lambda f: F.regexp_count(F.lower(F.col(f)), F.lit(r"[\p{L}\p{N}]+"))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), *[F.coalesce(F.avg(length(f)), F.lit(0.0)).alias(f"avg_{f}") for f in fields])


def bm25(index: DataFrame, stats: DataFrame, terms: Sequence[str], fields: Sequence[str] = ("content",), wildcard: bool = False) -> DataFrame:
    """id, score. Only postings of the terms are read; stats is one row. A wildcard term matches every term that contains it."""
    p = index.filter(hits(F.col("term"), terms, wildcard) & F.col("field").isin(*fields))
    df = p.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    x = p.join(df, ["term", "field"]).crossJoin(F.broadcast(stats))  # one row
    part = _idf(F.col("n_docs")) * _saturated({f: F.col(f"avg_{f}") for f in fields}) * _boost(fields)
    return x.groupBy("id").agg(F.sum(part).alias("score"), F.count_distinct("term").alias("match_count"))


def _idf(n_docs: Column) -> Column:
    return F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _boost(fields: Iterable[str]) -> Column:
    return reduce(lambda out, f: F.when(F.col("field") == f, F.lit(BOOSTS.get(f, 1.0))).otherwise(out), fields, F.lit(1.0))


def _saturated(avg: dict[str, Column | float]) -> Column:
    """A posting's count (tf, len, field), saturated and related to the field's mean length."""
    mean = reduce(lambda out, f: F.when(F.col("field") == f, avg[f]).otherwise(out), avg, F.lit(1.0))
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))


def best(found: DataFrame, k: int) -> DataFrame:
    return found.orderBy(F.desc(F.round("score", 9)), "id").limit(k)


def search(docs: DataFrame, key: str, terms: Sequence[str], k: int, fields: Sequence[str] = ("content",), wildcard: bool = False) -> DataFrame:
    """A search without an index: one scan that keeps the postings of the terms, one that counts."""
    index = postings(docs, key, fields, lambda t: hits(t, terms, wildcard))
    return best(bm25(index, field_stats(docs, fields), terms, fields, wildcard), k)


GRAM = 3
#: Ranges of documents whose upper bounds may come to the driver, 12 bytes each; above that they stay a DataFrame.
MOST_RANGES = 200_000
#: Postings that are read without a look at their bounds first.
DIRECT = 200_000


#: Documents whose postings go to one task at most, when an index is written.
DOCS_A_FILE = 4096
#: Frequent terms that may be broadcast, some 40 bytes each; otherwise all postings are shuffled to meet them.
MOST_OFTEN = 1_000_000


def grams(term: Column) -> Column:
    """The distinct substrings of GRAM characters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(term) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.substr(term, i, F.lit(GRAM))))


#: The tables of an index; `id` has the type of the documents' key. An empty table has no files to tell it.
SCHEMAS = {
    "postings": "term string, range int, id {id}, field string, tf long, len int, bucket int",
    "terms": "term string, field string, df long, n long, bucket int",
    "bounds": "term string, field string, range int, most double, n long, bucket int",
    "grams": "gram string, term string, bucket int",
}


def save_index(docs: DataFrame, path: str, key: str, fields: Sequence[str], buckets: int = 64, docs_a_range: int = 256, files_a_bucket: int = 4, analyzer: Analyzer | None = None) -> int:
    """Writes a version of the index at `path`, five tables that change together:

    postings: term, range (documents by a hash of the key, some `docs_a_range` each), id, field, tf, len; in buckets by term, sorted by term and
    range. terms: term, field, df, in the same buckets. bounds: for the terms of more than `docs_a_range` documents, by field and range, how many
    postings there are and the greatest share (see _saturated). grams: gram, term, in buckets by gram. stats: one row."""
    spark = docs.sparkSession
    have = docs.agg(F.count(F.lit(1)).alias("n_docs"), *[F.count(f).alias(f) for f in fields]).first()
    ranges = max(1, -(-have["n_docs"] // docs_a_range))
    kind = docs.schema[key].dataType.simpleString()
    read = lambda folder, name: spark.read.schema(SCHEMAS[name].format(id=kind)).parquet(f"{folder}/{name}")
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    x = postings(docs, key, fields, analyzer=analyzer).select("term", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int").alias("range"), "id", "field", "tf", "len", bucket)
    # A file takes all terms of a bucket in one slice of the ranges; with more ranges there are more slices, so no task grows with the table.
    # All rows of a task have one bucket: it is no part of the sort, in which rows would else be compared by what they have in common first.
    slices = max(files_a_bucket, -(-ranges * docs_a_range // (DOCS_A_FILE * buckets)))
    sliced = lambda rows, by, *order: rows.repartitionById(buckets * slices, F.col("bucket") * slices + F.pmod(by, F.lit(slices)).cast("int")).sortWithinPartitions(*order)
    x = sliced(x, F.col("range"), "term", "range")

    def terms(folder: str) -> DataFrame:
        df = read(folder, "postings").groupBy("bucket", "term", "field").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))
        return sliced(df, F.xxhash64("term", F.lit(1)), "term")

    def stats(folder: str) -> DataFrame:
        n = {r["field"]: r["n"] for r in read(folder, "terms").groupBy("field").agg(F.sum("n").alias("n")).collect()}  # a row a field
        row = {"n_docs": have["n_docs"], "buckets": buckets, "ranges": ranges, "often": docs_a_range, "id_type": kind} | {f"avg_{f}": n.get(f, 0) / have[f] if have[f] else 0.0 for f in fields}
        return spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {'double' if c.startswith('avg_') else 'string' if c == 'id_type' else 'long'}" for c in row)).coalesce(1)

    def bounds(folder: str) -> DataFrame:
        mean = spark.read.parquet(f"{folder}/stats").first().asDict()
        often = read(folder, "terms").filter(F.col("df") > docs_a_range).select("bucket", "term", "field", "df")
        x = read(folder, "postings").join(F.broadcast(often) if often.count() <= MOST_OFTEN else often, ["bucket", "term", "field"])
        x = x.groupBy("bucket", "term", "field", "range").agg(F.max(_saturated({f: mean[f"avg_{f}"] for f in fields})).alias("most"), F.count(F.lit(1)).alias("n"))
        return sliced(x, F.col("range"), "term", "range")

    def gram(folder: str) -> DataFrame:
        x = read(folder, "terms").select("term").distinct().select(F.explode(grams(F.col("term"))).alias("gram"), "term")
        x = x.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
        return sliced(x, F.xxhash64("term", F.lit(1)), "gram")

    parts = {"postings": (x, ["bucket"]), "terms": (terms, ["bucket"]), "stats": (stats, []), "bounds": (bounds, ["bucket"]), "grams": (gram, ["bucket"])}
    open_files = "spark.sql.maxConcurrentOutputFileWriters"
    was = spark.conf.get(open_files)
    spark.conf.set(open_files, "1")  # without it Spark sorts rows by bucket again before it writes them
    try:
        return tables.replace_all(parts, path)
    finally:
        spark.conf.set(open_files, was)


class SavedIndex:
    """The current version of a saved index.

    A search for k rows bounds first what a document of each range can score: by the bounds of frequent terms, and by the postings of the others,
    which are few. The k ranges with the greatest sums are scored, the k-th score found there is the threshold, and only ranges whose bound
    reaches it are read: rows are those of a full read. A wildcard's grams lead to the terms that hold it; what is shorter than a gram is looked
    up in the dictionary."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        folder = tables.at(spark, path)
        self.stats = spark.read.parquet(f"{folder}/stats").first().asDict()
        self.postings, self.bounds, self.terms, self.grams = (spark.read.schema(SCHEMAS[n].format(id=self.stats["id_type"])).parquet(f"{folder}/{n}") for n in ("postings", "bounds", "terms", "grams"))
        self._known: dict[str, list[tuple[str, str, int]]] = {}
        self.avg = {c.removeprefix("avg_"): v for c, v in self.stats.items() if c.startswith("avg_")}

    def _bucket(self, words: Sequence[str]) -> Column:
        """Constant, so that folders of other buckets are not listed."""
        return reduce(lambda a, w: a | (F.col("bucket") == F.pmod(F.xxhash64(F.lit(w)), F.lit(self.stats["buckets"])).cast("int")), words, F.lit(False))

    def containing(self, part: str) -> DataFrame:
        """The terms that contain a string."""
        own = sorted({part[i : i + GRAM] for i in range(len(part) - GRAM + 1)})
        if not own:
            return self.terms.filter(F.contains("term", F.lit(part))).select("term").distinct()
        x = self.grams.filter(self._bucket(own) & F.col("gram").isin(own)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        return x.filter((F.col("n") == len(own)) & F.contains("term", F.lit(part))).select("term")

    def matching(self, terms: Sequence[str], fields: Sequence[str], wildcard: bool = False) -> Callable[[DataFrame], DataFrame]:
        """Cuts a table of this index to the rows of the terms, and adds df."""
        if not wildcard:
            wanted = self._bucket(terms) & F.col("term").isin(list(terms)) & F.col("field").isin(*fields)
            rows = self._looked_up(terms, fields)
            known = self.spark.createDataFrame(rows, "term string, field string, df long")
            return lambda table: table.filter(wanted).join(F.broadcast(known), ["term", "field"])
        found = reduce(DataFrame.union, [self.containing(t) for t in terms]).distinct()
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.stats["buckets"])).cast("int")
        own = [r[0] for r in found.select(bucket).distinct().collect()]  # buckets, a fixed number
        cut = lambda table: table.filter(F.col("bucket").isin(own) & F.col("field").isin(*fields))
        known = cut(self.terms).join(found, "term", "left_semi").select("term", "field", "df")
        return lambda table: cut(table).join(known, ["term", "field"])

    def _looked_up(self, terms: Sequence[str], fields: Sequence[str]) -> list[tuple[str, str, int]]:
        """The dictionary's rows of the terms, read once."""
        new = [t for t in terms if t not in self._known]
        found = self.terms.filter(self._bucket(new) & F.col("term").isin(new)).select("term", "field", "df").collect() if new else []  # terms x fields rows
        self._known |= {t: [(r["term"], r["field"], r["df"]) for r in found if r["term"] == t] for t in new}
        return [r for t in dict.fromkeys(terms) for r in self._known[t] if r[1] in fields]

    def _weight(self) -> Column:
        return _idf(F.lit(self.stats["n_docs"])) * _boost(self.avg)

    def _scores(self, own: DataFrame) -> DataFrame:
        return own.groupBy("id").agg(F.sum(self._weight() * _saturated(self.avg)).alias("score"), F.count_distinct("term").alias("match_count"))

    def scores(self, terms: Sequence[str], fields: Sequence[str] = ("content",), wildcard: bool = False) -> DataFrame:
        """id, score, match_count of every document with one of the terms."""
        return self._scores(self.matching(terms, fields, wildcard)(self.postings))

    def search(self, terms: Sequence[str], k: int, fields: Sequence[str] = ("content",), wildcard: bool = False) -> DataFrame:
        """id, score, match_count: the k best."""
        own = self.matching(terms, fields, wildcard)
        found = own(self.postings)
        n = own(self.terms.drop("df")).agg(F.sum("df")).first()[0] if wildcard else sum(r[2] for r in self._looked_up(terms, fields))
        if (n or 0) <= DIRECT:
            return best(self._scores(found), k)
        ranges, _, _ = self.wanted(own, k)
        return best(self._scores(found.filter(F.col("range").isin(ranges)) if isinstance(ranges, list) else found.join(ranges, "range", "left_semi")), k)

    def wanted(self, own: Callable[[DataFrame], DataFrame], k: int) -> tuple[list[int] | DataFrame, int, int]:
        """The ranges to read for the k best, the postings in them, and all postings of the terms."""
        often = own(self.bounds).select("range", (self._weight() * F.col("most")).alias("most"), "n")
        rest = own(self.postings).filter(F.col("df") <= F.lit(self.stats["often"])).select("range", (self._weight() * _saturated(self.avg)).alias("most"), F.lit(1).cast("long").alias("n"))
        sums = often.union(rest).groupBy("range").agg(F.sum("most").alias("most"), F.sum("n").alias("n"))
        few = self.stats["ranges"] <= MOST_RANGES
        if not few:
            folder = tables.scratch(self.spark, "bounds")
            sums.write.parquet(folder)
            sums = self.spark.read.parquet(folder)
        head = sums.orderBy(F.desc("most"), "range").limit(MOST_RANGES if few else k).collect()
        first = [r["range"] for r in head[:k]]
        seen = best(self._scores(own(self.postings).filter(F.col("range").isin(first))), k).collect() if first else []
        least = seen[-1]["score"] - 1e-6 if len(seen) == k else float("-inf")
        if few:
            ranges = [r for r in head if r["most"] >= least]
            return [r["range"] for r in ranges], sum(r["n"] for r in ranges), sum(r["n"] for r in head)
        kept = sums.filter(F.col("most") >= least)
        return kept.select("range"), kept.agg(F.sum("n")).first()[0] or 0, sums.agg(F.sum("n")).first()[0] or 0

def load_index(spark: SparkSession, path: str) -> SavedIndex:
    return SavedIndex(spark, path)


def search_index(spark: SparkSession, path: str, terms: Sequence[str], k: int, fields: Sequence[str] = ("content",), wildcard: bool = False) -> DataFrame:
    """A search that reads the buckets of its terms only, and in them the row groups with the terms."""
    return SavedIndex(spark, path).search(terms, k, fields, wildcard)


def title_ratio(title: Column, keywords: Sequence[str]) -> Column:
    """Share of the keywords in the title; empty keywords are left out first."""
    words = [w.lower() for w in keywords if w]
    if not words:
        return F.lit(0.0)
    hits = F.lit(0)
    for w in words:
        hits = hits + F.contains(F.lower(title), F.lit(w)).cast("int")
    return hits / F.lit(float(len(words)))


def title_match(title: Column, keywords: Sequence[str], domain: Sequence[str] = (), generic: Sequence[str] = ()) -> Column:
    """How well a title matches a query's keywords, 0 to 1.

    The share of keywords in it; 0.7 at least if one of those found is a domain word, holds one or is part of one. With several keywords: if all of
    them, joined by blanks, joined without, or joined in reverse, stand in the title, 0.95 at least, less 0.05 for each further character (generic
    words begin none) above two, up to 0.20, but 0.75 at least. If they all stand in it apart, what lies between the first's last place and the last's
    first one counts: less 0.08 for each character that is left without generic words, above two, up to 0.30, but 0.60 at least."""
    t = F.lower(F.replace(F.coalesce(title, F.lit("")), F.lit("\ufeff")))
    words = [w.lower() for w in keywords if w]
    base = title_ratio(t, words)
    related = [w for k, w in zip([k for k in keywords if k], words, strict=True) if any(k == x or x in k or k in x for x in domain)]
    if related:
        base = F.when(reduce(lambda a, w: a | F.contains(t, F.lit(w)), related, F.lit(False)), F.greatest(base, F.lit(0.7))).otherwise(base)
    if len(words) < 2:
        return base
    forms = list(dict.fromkeys([" ".join(words), "".join(words), "".join(reversed(words))]))
    rest = t
    for form in forms:
        at = F.instr(rest, F.lit(form))
        rest = F.when(at > 0, F.concat(F.substr(rest, F.lit(1), at - 1), F.substr(rest, at + len(form)))).otherwise(rest)
    starts = "|".join(f"(?={re.escape(g.lower())})" for g in generic if g)
    blanks = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    extra = F.length(blanks(F.regexp_replace(rest, f"(?:{starts})(?s:.)", "") if starts else rest))
    whole = F.greatest(base, F.lit(0.95))
    whole = F.when(extra > 2, F.greatest(whole - F.least(extra * 0.05, F.lit(0.20)), F.lit(0.75))).otherwise(whole)
    at = lambda w: F.instr(t, F.lit(w)) - 1
    end = lambda w: F.length(t) - F.instr(F.reverse(t), F.lit(w[::-1])) + 1
    places = F.array(*[F.struct(at(w).alias("at"), F.lit(i).alias("i"), end(w).alias("end")) for i, w in enumerate(words)])
    one, other = F.array_min(places)["end"], F.array_max(places)["at"]
    low, high = F.least(one, other), F.greatest(one, other)
    between = blanks(F.substr(t, low + 1, high - low))
    left = between
    for g in generic:
        left = F.replace(left, F.lit(g.lower())) if g else left
    gap = F.length(blanks(left))
    apart = F.when((F.length(between) > 2) & (gap > 2), F.greatest(base - F.least(gap * 0.08, F.lit(0.30)), F.lit(0.60))).otherwise(base)
    every = reduce(lambda a, w: a & F.contains(t, F.lit(w)), words, F.lit(True))
    any_form = reduce(lambda a, f: a | F.contains(t, F.lit(f)), forms, F.lit(False))
    return F.when(any_form, whole).when(every, apart).otherwise(base)


def candidates_of(words: Column) -> Column:
    """All pairs of words at different places put together, both ways, and the words: of an array of a query's words."""
    pairs = F.flatten(F.transform(words, lambda a, i: F.transform(F.filter(words, lambda b, j: i != j), lambda b: F.concat(a, b))))
    return F.concat(pairs, words)


def title_candidates(keywords: DataFrame, word: str = "keyword", pos: str = "pos") -> DataFrame:
    """All pairs of different keywords put together both ways, and the keywords; keywords are those of a query."""
    a, b = keywords.select(F.col(word).alias("a"), F.col(pos).alias("i")), keywords.select(F.col(word).alias("b"), F.col(pos).alias("j"))
    pairs = a.join(b, F.col("i") != F.col("j")).select(F.concat("a", "b").alias("candidate"))
    return pairs.union(keywords.select(F.col(word).alias("candidate"))).distinct()
