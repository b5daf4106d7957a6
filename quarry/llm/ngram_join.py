"""Jaccard self-join on word n-grams with vertical partitioning.

1. Documents with equal shingle sets become one class (128-bit set hash); only class representatives go on.
2. The global order puts rare shingles first. Rarity comes from a counter of all shingles in 2^22 cells, as log2 levels; the
   hash orders within a level. Any order gives right results; this one keeps frequent shingles out of prefixes.
3. Each representative posts its prefix (a tenth of its set at 0.9) as (shingle, id, set size, position). Linked pairs share a
   prefix shingle, and their sizes and positions there pass a bound on the overlap.
4. Round one tests every posting against one representative of its bucket, the one with the fewest rarer shingles, so a group of
   near copies costs a pair a member, not all pairs. Components of the links follow. Round two tests what is left: postings outside the
   main component of their bucket against all others in other components, joined by classes of (size, position) that
   pass the bound. So no link between different components is missed, and pairs inside one component are not made.
5. Pairs are verified exactly: the global order is cut into fragments of equal mass, each fragment counts its partial overlap
   apart, and the counts are summed per pair.

Null texts count as empty: no words, an empty set, linked with nothing, a component of its own. Rows with a null id are returned
as they are (component null). Rows that repeat an id count as one document if their sets are equal; a set per distinct text otherwise,
joined in one component. An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, materialize, merged, small_batches, small_join, text_of
from .components import components
from .hashing import set_key, shingle_sets
from .repeats import BIT_ROWS, bit_table, together

CELL_BITS = 22
#: Cells of the histogram that bounds the overlap of a pair before its sets are fetched.
BOUND_CELLS = 256
FRAGMENTS = 8


def _sets(texts: list[str], width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for offset, some in together(texts):
        yield offset, shingle_sets(some, width)


def _levels(scratch: Scratch, texts: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """The rows (id, n, k1, k2, histogram), and the log2 level of every cell of the counter. Of fixed size: where cells are shared by many
    shingles, those that are frequent still stand out."""
    cells, slices = 1 << CELL_BITS, 64
    per = cells // slices
    columns = ["id", "n", "k1", "k2", "histogram", "slice", "part", "raw"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(cells, dtype=np.uint64)
        for pdf in batches:
            ids = pdf["id"].tolist()
            for offset, sets in _sets(pdf["t"].tolist(), width):
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=cells).astype(np.uint64)
                yield pd.DataFrame([(ids[offset + i], len(s), *set_key(s), _histogram(s), None, None, None) for i, s in enumerate(sets)], columns=columns)
        part = TaskContext.get().partitionId()
        yield pd.DataFrame([(None, None, None, None, None, i, part, zlib.compress(counts[i * per : (i + 1) * per].tobytes(), 1)) for i in range(slices)], columns=columns)

    rows = scratch.table(texts.mapInPandas(scan, "id string, n long, k1 long, k2 long, histogram binary, slice int, part int, raw binary"), "sets")

    def add(raws: list[bytes]) -> bytes:
        total = np.zeros(per, dtype=np.uint64)
        for raw in raws:
            total += np.frombuffer(zlib.decompress(raw), dtype=np.uint64)
        return zlib.compress(total.tobytes(), 1)

    tables = rows.filter("raw IS NOT NULL").select("slice", "part", "raw")
    tasks = (tables.agg(F.max("part")).first()[0] or 0) + 1
    total = np.zeros(cells, dtype=np.uint64)
    for r in merged(tables, add, tasks).collect():  # one row a slice
        total[r["slice"] * per : (r["slice"] + 1) * per] += np.frombuffer(zlib.decompress(r["raw"]), dtype=np.uint64)
    return rows.filter("raw IS NULL").drop("slice", "part", "raw"), np.floor(np.log2(total.astype(np.float64) + 1)).astype(np.uint8)


def _histogram(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s >> np.uint64(24)).astype(np.int64) % BOUND_CELLS, minlength=BOUND_CELLS), 65535).astype("<u2").tobytes()


def _bounded(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs whose histograms allow the overlap: a cell of a pair shares at most the smaller count."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = pdf["ha"].notna() & pdf["hb"].notna()
            yield pdf[~known][["a", "b"]]
            pdf = pdf[known]
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), dtype="<u2").reshape(-1, BOUND_CELLS).astype(np.int64) for c in ("ha", "hb"))
                full = (x == 65535).any(axis=1) | (y == 65535).any(axis=1)
                common = np.minimum(x, y).sum(axis=1)
                yield pdf[full | (100 * common >= percent * (x.sum(axis=1) + y.sum(axis=1) - common))][["a", "b"]]

    x = pairs.join(sketches.toDF("a", "ha"), "a", "left").join(sketches.toDF("b", "hb"), "b", "left")
    return x.select("a", "b", "ha", "hb").mapInPandas(keep, "a long, b long")


def _in_order(s: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted set in the global order, with levels."""
    own = levels[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    order = np.argsort(own, kind="stable")
    return s[order], own[order]


def _passes(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Sizes and positions of a first common shingle allow the overlap that the threshold needs."""
    return (100 + percent) * F.least(n1 - p1, n2 - p2) >= percent * (n1 + n2)


def jaccard_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, links_out: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """id, n_shingles, class_id (smallest id with an equal set), component_id; with links_out also the tested links between classes."""
    with small_batches(spark):
        return _components(spark, docs, id_col, text_col, width, percent, links_out)


def _components(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, links_out: bool) -> DataFrame | tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("t"))
    rows, levels = _levels(scratch, texts, width)
    sketches = rows.select(F.col("id").cast("long").alias("id"), "k1", "k2", "histogram")
    rows = rows.select(F.col("id").cast("long").alias("id"), "n", "k1", "k2")
    classes = scratch.table(rows.filter("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("n").alias("n")), "classes")
    reps = classes.select("rep").distinct()
    n_reps = reps.count()
    shared = spark.sparkContext.broadcast(levels)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, hashes, sizes, places = [], [], [], []
            keys = pdf["id"].tolist()
            for offset, sets in _sets(pdf["t"].tolist(), width):
                for i, own in enumerate(sets):
                    s, _ = _in_order(own, shared.value)
                    k = len(s) + percent * len(s) // -100 + 1 if len(s) else 0
                    ids.append(np.full(k, keys[offset + i], dtype=np.int64))
                    hashes.append(s[:k])
                    sizes.append(np.full(k, len(s), dtype=np.int32))
                    places.append(np.arange(k, dtype=np.int32))
            if ids:
                yield pd.DataFrame({"h": np.concatenate(hashes).view(np.int64), "id": np.concatenate(ids), "n": np.concatenate(sizes), "p": np.concatenate(places)})

    # An id stands for its class: texts of classes represented by another id are not posted.
    chosen = small_join(texts.filter("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "t"), reps.withColumnRenamed("rep", "id"), "id", "left_semi", n_reps)
    posted = scratch.table(chosen.mapInPandas(post, "h long, id long, n int, p int"), "postings")
    heads = posted.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("p", "n", "id")).alias("head")).filter("c > 1").select("h", "head")
    heads = scratch.table(heads, "heads")
    n_heads = heads.count()
    few = n_heads <= BIT_ROWS
    often = bit_table(heads, "h", n_heads) if few else None

    def shared_only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[often.value.has(pdf["h"].to_numpy())]

    inside = scratch.table((posted.mapInPandas(shared_only, posted.schema) if few else posted).join(heads, "h"), "buckets")
    scratch.drop(posted, heads)
    # One sketch an id: an id with several texts keeps the class of its own.
    sketches = scratch.table(sketches.join(classes, ["k1", "k2"]).filter(F.col("id") == F.col("rep")).groupBy("id").agg(F.max("histogram").alias("histogram"), F.count(F.lit(1)).alias("c")).filter("c = 1").drop("c"), "sketches")
    bound = _passes(F.col("n"), F.col("p"), F.col("head.n"), F.col("head.p"), percent)
    stars = inside.filter((F.col("id") != F.col("head.id")) & bound).select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b")).distinct()
    first = verify(scratch, _bounded(stars, sketches, percent), chosen, shared, width, percent)
    labels = components(first.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)

    labelled = inside.select("h", "id", "n", "p").join(labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    labelled = scratch.table(labelled, "labelled")
    scratch.drop(inside)
    main = labelled.groupBy("h", "c").count().groupBy("h").agg(F.max(F.struct("count", "c")).alias("m"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("h", F.col("m.c").alias("main"))
    mixed = labelled.join(main, "h")
    kinds = mixed.groupBy("h", "n", "p").agg(F.max(F.col("c") != F.col("main")).alias("rest"))
    x, y = kinds.filter("rest").drop("rest").toDF("h", "n1", "p1"), kinds.drop("rest").toDF("h", "n2", "p2")
    meets = x.join(y, "h").filter(_passes(F.col("n1"), F.col("p1"), F.col("n2"), F.col("p2"), percent))
    rest = mixed.filter("c <> main").select("h", F.col("n").alias("n1"), F.col("p").alias("p1"), F.col("id").alias("i"), F.col("c").alias("ci")).join(meets, ["h", "n1", "p1"])
    others = mixed.select("h", F.col("n").alias("n2"), F.col("p").alias("p2"), F.col("id").alias("j"), F.col("c").alias("cj"))
    cross = rest.join(others, ["h", "n2", "p2"]).filter("ci <> cj").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    second = verify(scratch, _bounded(cross, sketches, percent), chosen, shared, width, percent)
    links = first.union(second)
    # Ids whose rows have several texts tie the classes of those texts together.
    ties = rows.filter("n > 0 AND id IS NOT NULL").join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).filter("id <> rep").groupBy("id").agg(F.min("rep").alias("r"), F.max("rep").alias("s")).filter("r <> s")
    final = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(ties.select("r", "s")), scratch)
    by_class = classes.join(final, classes["rep"] == final["id"], "left").select("k1", "k2", F.col("rep"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(by_class, ["k1", "k2"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    out, links = materialize(out, "components"), materialize(links, "links") if links_out else None
    scratch.close()
    return (out, links) if links_out else out


def verify(scratch: Scratch, pairs: DataFrame, texts: DataFrame, levels, width: int, percent: int) -> DataFrame:  # noqa: ANN001
    """The pairs (a, b) that reach the threshold, with their overlap: partial overlaps by fragment, summed per pair."""
    pairs = scratch.table(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mass = np.bincount(levels.value, weights=2.0 ** levels.value.astype(float), minlength=64)[:64]
        below, total = np.cumsum(mass) - mass, mass.sum() or 1.0
        for pdf in batches:
            keys = pdf["id"].tolist()
            for offset, sets in _sets(pdf["t"].tolist(), width):
                out = []
                for i, one in enumerate(sets):
                    s, own = _in_order(one, levels.value)
                    place = (below[own] + mass[own] * (s.astype(np.float64) / 2.0**64)) / total
                    fragment = np.minimum((place * FRAGMENTS).astype(np.int64), FRAGMENTS - 1)
                    for f in np.unique(fragment):
                        out.append((keys[offset + i], len(s), int(f), s[fragment == f].view(np.int64)))
                yield pd.DataFrame(out, columns=["id", "n", "fragment", "part"])

    fragments = scratch.table(small_join(texts, ids, "id", "left_semi", ids.count()).mapInPandas(cut, "id long, n long, fragment int, part array<long>"), "fragments")
    once = fragments.dropDuplicates(["id", "fragment"])
    x = pairs.join(once.toDF("a", "na", "fragment", "pa"), "a")
    x = x.join(once.toDF("b", "nb", "fragment", "pb"), ["b", "fragment"])
    partial = x.select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).cast("long").alias("common"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    linked = total.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common")))
    linked = scratch.table(linked.select("a", "b", "common"), "links")
    scratch.drop(pairs, fragments)
    return linked


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, documents(spark, sf_dir)).drop("class_id")
