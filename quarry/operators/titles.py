"""Titles that mean the same page though they are written differently: without a number, shortened, or with the same key words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources import tables

#: Runs of kana and Han characters that count as key words, and from which length on one is enough.
KEYWORD, LONG = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FAF}]{2,}", 3
#: Lengths of the substrings by which a text finds those that hold it; a text of 2 * k - 1 characters and more has one of k.
TIERS = (1, 2, 4, 8, 16, 32)
#: Few titles are shorter than the next length after this one asks for. The substrings of up to so many such titles are sent to all tasks (8 bytes each),
#: which then look for these only; with more, all short substrings are shuffled.
SHORT, MOST_SHORT = 4, 1_000_000
#: Characters that a task takes at once.
CHARS = 1_000_000
KINDS = ("equal", "number", "contained", "keywords")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def numberless(c: Column) -> Column:
    return trimmed(F.regexp_replace(trimmed(c), r"^\d+_", ""))


def keywords(c: Column, pattern: str = KEYWORD) -> Column:
    """The different key words of a title, without a mark in front such as 123_【FIX】."""
    return F.array_distinct(F.regexp_extract_all(trimmed(F.regexp_replace(trimmed(c), r"^[\d_]*[【（(]?[A-Z]+[】）)]?\s*", "")), F.lit(pattern), F.lit(0)))


def _joined(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the titles: merged, so that neither side is gathered on the driver to be broadcast, whatever its estimated size."""
    return a.join(b.hint("merge"), on, how)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _marks(texts: Sequence[str], inner: bool, short: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, hash) of each text's marks: of every `k` substrings of `k` characters in a row, the one with the least hash, for the tiers k of
    TIERS. A text that holds another has all marks of that one's tier. Inner texts have the marks of their own tier only, the longest that is no longer
    than they are; outer ones those of all tiers, in short tiers those in `short` only."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    h = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(h))  # characters from here to the end of the text
    size, rows, found = sizes[row], [], []
    upto = [*(2 * k - 1 for k in TIERS[1:]), np.inf]
    for k, most in zip(TIERS, upto, strict=True):
        if k > 1:  # of two halves; what goes over the end of a text is not taken below
            h = h * np.uint64(0xD6E8FEB86659FD93 + 2 * k) + np.append(h[k // 2 :], np.zeros(min(k // 2, len(h)), dtype=np.uint64))
        if not inner and short is not None and k <= SHORT and not len(short):
            continue
        least, w = _mixed(h + np.uint64(k)), 1
        while w < k:
            least = np.minimum(least, np.append(least[w:], np.full(min(w, len(h)), np.iinfo(np.uint64).max, dtype=np.uint64)))
            w *= 2
        at = np.flatnonzero((left >= 2 * k - 1) & ((size < most) if inner else (size >= 2 * k)))
        if not inner and short is not None and k <= SHORT:
            at = at[np.isin(least[at], short)]
        r, m = row[at], least[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (m[1:] != m[:-1])
        r, m = r[new], m[new]
        order = np.lexsort((m, r))
        r, m = r[order], m[order]
        new = np.ones(len(r), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (m[1:] != m[:-1])
        rows.append(r[new])
        found.append(m[new])
    return np.concatenate(rows), np.concatenate(found)


def _marked(texts: DataFrame, inner: bool, short: Broadcast | None = None) -> DataFrame:
    """h, own, ref (1 or 0), mark: the marks of texts (h, text, own, ref_a, ref_b)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None if short is None else short.value
        for batch in batches:
            own, rest = batch.column("text"), batch.drop_columns(["text"])
            ends = np.cumsum(pc.utf8_length(own).to_numpy())
            cuts = [0, *np.flatnonzero(np.diff(ends // CHARS)) + 1, len(ends)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                rows, found = _marks(own.slice(i, j - i).to_pylist(), inner, only)
                yield pa.RecordBatch.from_arrays([*rest.slice(i, j - i).take(pa.array(rows)).columns, pa.array(found.view(np.int64))], names=["h", "own", "ref", "mark"])

    has_ref = (F.col("ref_a").isNotNull() | F.col("ref_b").isNotNull()).cast("int")
    return texts.select("h", "text", F.col("own").alias("own"), has_ref.alias("ref")).mapInArrow(mark, "h long, own int, ref int, mark long")


def candidates(texts: DataFrame) -> DataFrame:
    """outer, inner (h): texts (h, text, own, ref_a, ref_b) that may hold another, one of them a title, the other a reference. Of each inner text the
    mark that the fewest texts of the other side have leads to those; a text with a mark that none of them has is in none."""
    asked = _marked(texts, True)
    brief = _joined(asked, texts.filter(F.length("text") < 4 * SHORT - 1).select("h"), "h", "left_semi").select("mark").distinct().limit(MOST_SHORT + 1)
    few = brief.toArrow().column("mark").to_numpy().view(np.uint64)  # 8 bytes each, no row objects
    posted = _marked(texts, False, None if len(few) > MOST_SHORT else texts.sparkSession.sparkContext.broadcast(np.sort(few)))
    df = posted.groupBy("mark").agg(F.sum("own").alias("n_own"), F.sum("ref").alias("n_ref"))
    met = _joined(asked, df, "mark", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_own", "n_ref")})
    rarest = met.groupBy("h").agg(
        F.max("own").alias("own"), F.max("ref").alias("ref"), F.min("n_own").alias("n_own"), F.min("n_ref").alias("n_ref"), F.min_by("mark", "n_own").alias("by_own"), F.min_by("mark", "n_ref").alias("by_ref")
    )
    in_ref = F.when((F.col("own") == 1) & (F.col("n_ref") > 0), F.struct(F.col("by_ref").alias("mark"), F.lit(False).alias("own")))
    in_own = F.when((F.col("ref") == 1) & (F.col("n_own") > 0), F.struct(F.col("by_own").alias("mark"), F.lit(True).alias("own")))
    chosen = rarest.select(F.col("h").alias("inner"), F.inline(F.array_compact(F.array(in_ref, in_own)))).withColumnRenamed("own", "of_own")
    pairs = _joined(chosen, posted, "mark").filter((F.col("h") != F.col("inner")) & (F.when(F.col("of_own"), F.col("own")).otherwise(F.col("ref")) == 1))
    return pairs.select(F.col("h").alias("outer"), "inner")


def _held(titles: DataFrame, references: DataFrame) -> DataFrame:
    """text, ref_a, ref_b: for the texts of titles (a, b) that contain one of the references (ref, a, b) or are in one, the least such reference by its a
    and by its b. All is between different texts, whatever number of rows has them."""
    none = F.lit(None).cast(references.schema["ref"].dataType)
    own = titles.select(F.explode(F.array("a", "b")).alias("text"), F.lit(1).alias("own"), none.alias("ref_a"), none.alias("ref_b"))
    other = lambda text, a, b: F.struct(F.col(text).alias("text"), F.lit(0).alias("own"), a.alias("ref_a"), b.alias("ref_b"))
    others = references.select(F.inline(F.array(other("a", F.col("ref"), none), other("b", none, F.col("ref")))))
    texts = own.union(others).filter("text <> ''").groupBy("text").agg(F.max("own").alias("own"), F.min("ref_a").alias("ref_a"), F.min("ref_b").alias("ref_b"))
    spark, path = titles.sparkSession, tables.scratch(titles.sparkSession, "titles")
    texts.withColumn("h", F.monotonically_increasing_id()).write.parquet(path)  # written, so that the numbers stay
    texts = spark.read.parquet(path)
    short = texts.select(F.col("h").alias("inner"), F.col("text").alias("part"), F.col("own").alias("own_"), F.col("ref_a").alias("a_"), F.col("ref_b").alias("b_"))
    pairs = _joined(_joined(candidates(texts), short, "inner"), texts.withColumnRenamed("h", "outer"), "outer").filter(F.contains("text", F.col("part")))
    around = F.when(F.col("own") == 1, F.struct(F.col("outer").alias("h"), F.col("a_").alias("ref_a"), F.col("b_").alias("ref_b")))
    inside = F.when(F.col("own_") == 1, F.struct(F.col("inner").alias("h"), F.col("ref_a"), F.col("ref_b")))
    near = pairs.select(F.inline(F.array_compact(F.array(around, inside)))).groupBy("h").agg(F.min("ref_a").alias("ref_a"), F.min("ref_b").alias("ref_b"))
    return _joined(near, texts.select("h", "text"), "h").select("text", "ref_a", "ref_b")


def fuzzy_titles(titles: DataFrame, references: DataFrame, pattern: str = KEYWORD, long: int = LONG) -> DataFrame:
    """id, kind, ref for every row of titles (id, title): the first kind of KINDS by which a reference (id, title) is met and the least id of such a
    reference; both null if it is missing. Empty and null titles meet nothing.

    equal: the same without blanks around. number: the same without a number in front. contained: one contains the other, with or without numbers.
    keywords: a key word of `long` characters in common, or two shorter ones. Titles meet over what they have in common (a text, a substring, a word, a pair
    of words), each with its least reference, so a word in a third of all titles makes no pairs of them."""
    t = titles.select("id", trimmed(F.col("title")).alias("a"), numberless(F.col("title")).alias("b"), keywords(F.col("title"), pattern).alias("k"))
    r = references.select(F.col("id").alias("ref"), trimmed(F.col("title")).alias("a"), numberless(F.col("title")).alias("b"), keywords(F.col("title"), pattern).alias("k"))
    least = lambda x, by: x.groupBy(by).agg(F.min("ref").alias("ref"))
    met, rest = [], t
    for c, kind in (("a", 0), ("b", 1)):
        by_text = least(r.filter(F.col(c) != ""), c)
        met.append(_joined(t.filter(F.col(c) != ""), by_text, c).select("id", F.lit(kind).alias("kind"), "ref"))
        rest = _joined(rest, by_text.select(c), c, "left_anti")
    # A title in a reference, and a reference in a title: for those that equal none.
    near = _held(rest.select("a", "b"), r.select("ref", "a", "b"))
    for c in ("a", "b"):
        met.append(_joined(rest, near.select(F.col("text").alias(c), F.col(f"ref_{c}").alias("ref")), c).filter("ref IS NOT NULL").select("id", F.lit(2).alias("kind"), "ref"))
    long_word = lambda x: x.select("*", F.explode(F.filter("k", lambda w: F.length(w) >= long)).alias("w"))
    pairs = lambda k: F.flatten(F.transform(k, lambda v: F.transform(F.filter(k, lambda w: w > v), lambda w: F.struct(v.alias("v"), w.alias("w")))))
    two = lambda x: x.select("*", F.explode(pairs(F.col("k"))).alias("w"))
    for cut in (long_word, two):
        met.append(_joined(cut(t.select("id", "k")).select("id", "w"), least(cut(r.select("ref", "k")), "w"), "w").select("id", F.lit(3).alias("kind"), "ref"))
    best = reduce(DataFrame.union, met).groupBy("id").agg(F.min(F.struct("kind", "ref")).alias("m"))
    name = F.get(F.array(*map(F.lit, KINDS)), F.col("m.kind"))
    return _joined(titles.select("id"), best, "id", "left").select("id", name.alias("kind"), F.col("m.ref").alias("ref"))
