"""Incremental removal of repeated word windows over a log-structured fingerprint index.

The index is a folder of immutable runs: the blocks (stretches of windows with one anchor, see repeats.py) of the documents added so far, as
anchor, content hash, document, start and count, bucketed and sorted by anchor. A batch's texts are scanned once:

1. The batch's blocks are sorted into a new run.
2. The run is merge-joined with every older run (no run is shuffled for that): blocks whose anchor is in another document too, old or new.
3. In the order of (anchor, 64-bit content hash) neighbours are compared: a block equal to one of an earlier document repeats it whole.
4. Anchors with several contents are the edges of passages: only the texts of those blocks' documents are fetched, windows whose hash is in
   one document only are left out, and the others are sorted and compared as words, byte for byte.
5. Once there are `fan_in` runs of one level, they are compacted into one of the next, which keeps the first block of each content.

Sorts have the document as the last key, so a passage in a third of all documents is spread over tasks. A document comes after another if
it is in a later batch, or has the larger id in the same batch; only repeats of other documents are removed. Null texts have no words; null ids count as
one document before all others. Repeated rows with one id are one document. Empty tables and batches are fine. Columns other than id and text are not read.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import Scratch, documents, drop_path, drop_table, materialize, new_path, setting, small_batches, small_join, text_of
from .hashing import hashes_between, mix, spaced, window_hashes, word_bounds
from .suffix_array import ordered
from .suffix_dedup import _strings

WIDTH, GRAM = 13, 5


class FingerprintIndex:
    """Runs under `path`. Texts are not copied: the documents added so far must be given as `history` to open an index that has runs."""

    def __init__(self, spark: SparkSession, path: str, width: int = WIDTH, gram: int = GRAM, buckets: int | None = None, fan_in: int = 4, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.path, self.width, self.gram, self.fan_in = spark, path, width, gram, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.history = None if history is None else self._texts(history, id_col, text_col)
        self.runs: list[tuple[int, str]] = []  # level, table
        for name in self._stored():
            self._open(name)
        if self.runs and history is None:
            raise ValueError(f"{path} has runs: give the documents added so far as history")

    @staticmethod
    def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(repeats.NULL_ID)).alias("id"), text_of(text_col).alias("t"))

    def _stored(self) -> list[str]:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        done = lambda p: fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.isDirectory() and done(f.getPath()))

    def _open(self, name: str) -> None:
        level, buckets = map(int, name.split("_")[1:3])
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (h BIGINT, bh BIGINT, id BIGINT, start INT, count INT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
        self.runs.append((level, name))

    def _write(self, blocks: DataFrame, level: int) -> str:
        name = f"run_{level}_{self.buckets}_{new_path(self.spark, 'x').rsplit('-', 1)[1]}"
        rows = blocks.repartition(self.buckets, "h")
        if level:
            rows = rows.groupBy("h", "bh").agg(F.min(F.struct("id", "start", "count")).alias("first")).select("h", "bh", "first.*")
        # Sorted by anchor before the writer sorts by bucket and anchor: it finds its rows in order, where comparing them all takes most of the write.
        with setting(self.spark, "spark.sql.optimizer.plannedWrite.enabled", "false"):
            rows.sortWithinPartitions("h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").option("compression", "zstd").option("parquet.enable.dictionary", "false").saveAsTable(name)
        self.runs.append((level, name))
        return name

    def _drop(self, name: str) -> None:
        self.runs = [r for r in self.runs if r[1] != name]
        self.spark.sql(f"DROP TABLE {name}")
        drop_path(self.spark, f"{self.path}/{name}")

    def _compact(self) -> None:
        level = 0
        while any(x == level for x, _ in self.runs):
            full = [n for x, n in self.runs if x == level]
            if len(full) >= self.fan_in:
                # A union of columnar scans lays the runs' buckets side by side but tells Spark that they are together: nothing would be merged across runs.
                with setting(self.spark, "spark.sql.unionOutputPartitioning", "false"):
                    self._write(functools.reduce(DataFrame.union, [self.spark.table(n) for n in full]), level + 1)
                for n in full:
                    self._drop(n)
            level += 1

    def close(self, delete: bool = False) -> None:
        """Forgets the tables of the runs; deletes their files too if told to."""
        for _, name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.runs = []
        if delete:
            drop_path(self.spark, self.path)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds a batch; returns (id, ranges): the windows of its documents that occur in a document before, as array<struct<start, count>>."""
        with small_batches(self.spark), _sorted_runs(self.spark):
            scratch = Scratch(self.spark)
            texts = self._texts(docs, id_col, text_col)
            older = [self.spark.table(n) for _, n in self.runs]
            new = self.spark.table(self._write(self._blocks(texts), 0))
            again = new.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("h")
            met = [run.join(new.select("h").hint("merge"), "h", "left_semi") for run in older]
            met = functools.reduce(DataFrame.union, met) if met else new.limit(0)
            # Of history it only matters that a content is there, and where once.
            met = scratch.table(met.groupBy("h", "bh").agg(F.min(F.struct("id", "start", "count")).alias("first")).select("h", "bh", "first.*"), "met")
            wanted = again.union(met.select("h")).distinct()
            found = scratch.table(self._placed(new.join(wanted, "h", "left_semi"), met), "found")
            order = ordered(scratch, found, ["h", "bh"])
            parts = order.filter(_repeats()).select("id", F.col("start").cast("int").alias("start"), "count")
            # A first block is compared wherever it is in its first document.
            own = order.filter(~_repeats())
            split = scratch.table(own.groupBy("h").agg(F.min("bh").alias("a"), F.max("bh").alias("b")).filter("a <> b").select("h"), "split")
            own = small_join(own, split, "h", "left_semi", split.count())
            parts = parts.union(self._edges(scratch, own, texts))
            ranges = materialize(repeats.grouped(parts), "ranges")
            scratch.close()
        self.history = texts if self.history is None else self.history.union(texts)
        self._compact()
        return ranges

    @staticmethod
    def _placed(new: DataFrame, old: DataFrame) -> DataFrame:
        """New and old blocks, with old ones before all new ones in the order of id and start."""
        before = old.select("h", "bh", F.lit(repeats.NULL_ID).alias("id"), F.lit(-1).cast("long").alias("start"), "count", F.col("id").alias("doc"), F.col("start").alias("at"))
        return new.select("h", "bh", "id", F.col("start").cast("long").alias("start"), "count", F.col("id").alias("doc"), F.col("start").alias("at")).union(before)

    def _blocks(self, texts: DataFrame) -> DataFrame:
        width, gram = self.width, self.gram

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("id").to_numpy()
                for i, data, offsets in _chunks(batch.column("t")):
                    start, end, sizes = word_bounds(data, offsets)
                    x = repeats.blocks(hashes_between(data, start, end), sizes, width, gram)
                    columns = [x.anchor.view(np.int64), x.content.view(np.int64), ids[i + x.doc], x.start.astype(np.int32), x.count.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "bh", "id", "start", "count"])

        return texts.select("id", "t").mapInArrow(scan, "h long, bh long, id long, start int, count int")

    def _edges(self, scratch: Scratch, own: DataFrame, texts: DataFrame) -> DataFrame:
        """(id, start, 1) of the new windows in these blocks whose words are in an earlier document's."""
        width = self.width
        per_doc = own.groupBy("doc", (F.col("start") < 0).alias("old")).agg(F.collect_list(F.struct("at", "count")).alias("ranges"))
        per_doc = scratch.table(per_doc.select(F.col("doc").alias("id"), "old", "ranges.at", "ranges.count"), "fetch")

        def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The words of blocks, parted by one space."""
            for batch in batches:
                ids, (lists, at), (_, count) = batch.column("id").to_numpy(), _flat(batch.column("at")), _flat(batch.column("count"))
                for i, data, offsets in _chunks(batch.column("t")):
                    begin, end, sizes = word_bounds(data, offsets)
                    own = slice(lists[i], lists[i + len(sizes)])
                    doc = np.repeat(np.arange(len(sizes)), np.diff(lists[i : i + len(sizes) + 1]))
                    inside = at[own] + count[own] + (width - 1) <= sizes[doc]
                    doc, start, n = doc[inside], at[own][inside], count[own][inside] + (width - 1)
                    first = (np.cumsum(sizes) - sizes)[doc] + start
                    words, where = spaced(data, begin, end)
                    size = (end - begin)[first + n - 1] + where[first + n - 1] - where[first]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i + doc]), pa.array(start), _strings(words, where[first], size)], names=["id", "start", "content"])

        fetched = []
        for old, source in ((False, texts), (True, self.history)):
            if source is not None:
                wanted = per_doc.filter(F.col("old") == old).drop("old")
                got = repeats.with_ranges(source, wanted, ["id"], wanted.count()).select("id", "t", "at", "count").mapInArrow(contents, "id long, start long, content binary")
                fetched.append(got.select("*", F.lit(old).alias("old")))
        blocks = scratch.table(fetched[0].union(fetched[1]) if len(fetched) > 1 else fetched[0], "contents")

        def hashed(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
            """Of every window of every block, some blocks at a time: block, offset and hash; and the bytes of the blocks, and where the window is in them."""
            for i, data, offsets in _chunks(column):
                start, end, sizes = word_bounds(data, offsets)
                counts, begin = np.maximum(sizes - (width - 1), 0), np.cumsum(sizes) - sizes
                block, at = np.repeat(np.arange(len(sizes)), counts), repeats.spread(begin, counts)
                w = window_hashes(hashes_between(data, start, end), width)[at]
                yield block + i, at - begin[block], w, data, start[at], end[at + (width - 1)]

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs = mix(mix(batch.column("id").to_numpy().view(np.uint64)) + batch.column("old").to_numpy(zero_copy_only=False).astype(np.uint64)).view(np.int64)
                for block, _, w, *_ in hashed(batch.column("content")):
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(docs[block])], names=["w", "d"])

        # Two documents, or an old one beside a new one.
        docs = blocks.mapInArrow(places, "w long, d long")
        shared = scratch.table(docs.groupBy("w").agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a <> b").select("w"), "windows")
        n = shared.count()
        few = n <= repeats.BIT_ROWS
        bits = repeats.bit_table(shared, "w", n) if few else None

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["w", "key", "id", "start"]
            for batch in batches:
                ids, starts = (batch.column(c).to_numpy() for c in ("id", "start"))
                old, before = batch.column("old").to_numpy(zero_copy_only=False), []
                for block, offset, w, data, begin, end in hashed(batch.column("content")):
                    pick = bits.value.has(w) if few else np.ones(len(w), dtype=bool)
                    # Of old windows it only matters that they are there: each goes on once a batch.
                    for was in (False, True):
                        own = np.flatnonzero(pick & (old[block] == was))
                        keys, hashes = _strings(data, begin[own], (end - begin)[own]), pa.array(w[own].view(np.int64))
                        if was:
                            before.append(pa.Table.from_arrays([hashes, keys], names=names[:2]))
                        else:
                            yield pa.RecordBatch.from_arrays([hashes, keys, pa.array(ids[block[own]]), pa.array(starts[block[own]] + offset[own])], names=names)
                for x in pa.concat_tables(before).group_by(names[:2]).aggregate([]).to_batches() if before else ():
                    place = [pa.array(np.full(x.num_rows, v, dtype=np.int64)) for v in (repeats.NULL_ID, -1)]
                    yield pa.RecordBatch.from_arrays([x.column("w"), x.column("key"), *place], names=names)

        windows = scratch.table(blocks.mapInArrow(cut, "w long, key binary, id long, start long"), "cut")
        # Equal words have one hash. It comes first, as numbers sort faster than bytes.
        hits = ordered(scratch, windows, ["w", "key"], once="key").filter(_repeats())
        return hits.select("id", F.col("start").cast("int").alias("start"), F.lit(1).alias("count"))


@contextlib.contextmanager
def _sorted_runs(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark knows that a run, one file a bucket, is sorted: no join or aggregation by anchor sorts or hashes it again."""
    with setting(spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"), setting(spark, "spark.sql.execution.replaceHashWithSortAgg", "true"), setting(spark, "spark.sql.unionOutputPartitioning", "false"):
        yield


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """An Arrow column of texts some at a time: place of the first, their bytes end to end, and where each begins and the last ends."""
    raw, offsets = repeats.utf8(column)
    for i, j in repeats.cuts(offsets):
        yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list begins and the last ends, and their values end to end."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten().to_numpy().astype(np.int64)


def _repeats() -> Column:
    """New rows of ordered() with the same keys in a document before: an old one (start -1) or one with a smaller id."""
    return (F.col("start") >= 0) & ((F.col("first_start") < 0) | (F.col("first_id") != F.col("id")))


def removed_words(docs: DataFrame, ranges: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """id, n_words, n_removed and kept (the words left, joined by one space) or kept_sha256, for every row of docs."""
    name = "kept_sha256" if digest else "kept"
    schema = f"id long, n_words long, n_removed long, {name} string"
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(repeats.NULL_ID)).alias("id"), text_of(text_col).alias("t"))
    out = lambda b: hashlib.sha256(b).hexdigest() if digest else b.tobytes().decode("utf-8", "surrogatepass")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ranged = batch.column("id").to_numpy(), "start" in batch.schema.names
            if ranged:
                (lists, starts), (_, counts) = (_flat(batch.column(c)) for c in ("start", "count"))
            for i, data, offsets in _chunks(batch.column("t")):
                start, end, sizes = word_bounds(data, offsets)
                words, where = spaced(data, start, end)
                n, begin = len(sizes), np.concatenate([[0], np.cumsum(sizes)])
                gone = np.zeros(len(where), dtype=bool)
                if ranged:
                    own = slice(lists[i], lists[i + n])
                    doc = np.repeat(np.arange(n), np.diff(lists[i : i + n + 1]))
                    windows = np.maximum(sizes - (width - 1), 0)[doc]
                    a, b = np.minimum(starts[own], windows), np.minimum(starts[own] + counts[own], windows)
                    some = a < b
                    a, b = (begin[doc] + a)[some], (begin[doc] + b + (width - 1))[some]
                    gone = np.cumsum(np.bincount(a, minlength=len(gone) + 1) - np.bincount(b, minlength=len(gone) + 1))[: len(gone)] > 0
                length = np.where(gone, 0, end - start + 1)
                kept = memoryview(words[np.repeat(~gone, end - start + 1)] if gone.any() else words)
                ends, removed = (np.concatenate([[0], np.cumsum(x)])[begin] for x in (length, gone))
                # The space behind the last word goes too.
                texts_ = [out(kept[x : max(x, y - 1)]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + n]), pa.array(sizes), pa.array(np.diff(removed)), pa.array(texts_, pa.string())], names=["id", "n_words", "n_removed", name])

    n = ranges.count()
    whole = small_join(texts, ranges.select("id"), "id", "left_anti", n).select("id", "t").mapInArrow(cut, schema)
    left = repeats.with_ranges(texts, ranges, ["id"], n).select("id", "t", "ranges.start", "ranges.count")
    both = whole.union(left.mapInArrow(cut, schema))
    with small_batches(docs.sparkSession):
        return materialize(both.select(F.when(F.col("id") != repeats.NULL_ID, F.col("id")).alias(id_col), "n_words", "n_removed", name), "cut")


def op7_substring_dedup(spark: SparkSession, sf_dir: str, batches: int = 4, fan_in: int = 3) -> DataFrame:
    """Adds `documents` to an empty index in batches of ascending ids: with four batches and three runs a level, the third batch meets two runs
    and ends in a compaction, and the fourth meets the compacted run."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    cuts = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    cuts = cuts or [0] * (batches - 1)
    index = FingerprintIndex(spark, new_path(spark, "index"), fan_in=fan_in)
    found = []
    for i in range(batches):
        # Plain bounds, so that files and row groups of other batches are not read.
        upto = F.col("doc_id") <= cuts[i] if i < batches - 1 else F.lit(True)
        found.append(index.add(docs.filter(F.col("doc_id") > cuts[i - 1]).filter(upto) if i else docs.filter(upto | F.col("doc_id").isNull())))
    index.close(delete=True)
    out = removed_words(docs, functools.reduce(DataFrame.union, found), digest=True)
    for ranges in found:
        drop_table(ranges)
    return out
