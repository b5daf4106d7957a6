"""Removal of repeated byte strings with a distributed suffix array.

Texts are UTF-8 bytes. A byte goes if it is covered by a string of `width` bytes that also starts earlier: in a document with a smaller id, or
earlier in the same one. Strings are judged on the input.

1. What cannot repeat is left out first, without loss: a window whose anchor (see repeats.py) occurs at one place only.
2. What is left is cut into blocks, stretches of windows with one anchor. Blocks are sorted as strings and compared with their neighbours;
   those equal to an earlier one are covered whole. The first of its bytes goes on if its anchor has other contents too. Two more levels do the
   same with the blocks that went on, with longer anchors and so shorter blocks, until little more than the edges of passages is left.
3. The suffixes at these edges are sorted by the difference-cover algorithm, and neighbours compared in their first `width` bytes (suffix_array.py).

All comparisons that remove something are of bytes; hashes only choose what is compared.

Null texts are empty; null ids count as one document before all others; repeated rows with one id are one
document at one place, so they don't cover each other. An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import Scratch, documents, drop_table, materialize, small_batches, small_join, text_of
from .hashing import BYTES, Rolling, mix, sliding_min
from .suffix_array import later, ordered, repeated_suffixes

WIDTH = 100
#: Bytes of an anchor, level by level: shorter than the width.
GRAMS = (32, 80, 95)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(repeats.NULL_ID)).alias("id"), text_of(text_col).alias("t"))


def _strings(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """The runs of bytes from starts, of these sizes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    data = values[repeats.spread(starts, sizes)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _blocks(texts: DataFrame, anchors: DataFrame, n_anchors: int, width: int, gram: int) -> DataFrame:
    """(h, id, start, within, content) of the blocks of texts whose anchor is in `anchors`."""
    few = n_anchors <= repeats.BIT_ROWS
    bits = repeats.bit_table(anchors, "h", n_anchors) if few else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            raw, offsets = repeats.utf8(batch.column("t"))
            for i, j in repeats.cuts(offsets):
                own = raw[offsets[i] : offsets[j]]
                x = repeats.blocks(BYTES[own], np.diff(offsets[i : j + 1]), width, gram, content=False)
                pick = bits.value.has(x.anchor) if few else np.ones(len(x.anchor), dtype=bool)
                content = _strings(own, x.at[pick], x.count[pick] + (width - 1))
                yield pa.RecordBatch.from_arrays([pa.array(x.anchor[pick].view(np.int64)), pa.array(ids[i + x.doc[pick]]), pa.array(x.start[pick]), pa.array(x.within[pick]), content], names=["h", "id", "start", "within", "content"])

    found = texts.select("id", "t").mapInArrow(scan, "h long, id long, start long, within boolean, content binary")
    return found if few else found.join(anchors, "h", "left_semi")


def _contested(firsts: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of firsts (one a content) whose anchor has other contents too, or that may repeat themselves: only their windows may be elsewhere."""
    shared = scratch.table(firsts.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("within").alias("w")).filter("n > 1 OR w").select("h"), "contested")
    return small_join(firsts, shared, "h", "left_semi", shared.count())


def _windows(contents: list[bytes], width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of many strings, of windows with one anchor at one place: string, first window in it, anchor, its place in the string, number of
    windows; and the bytes of all strings end to end."""
    sizes = np.fromiter(map(len, contents), dtype=np.int64, count=len(contents))
    raw = np.frombuffer(b"".join(contents), dtype=np.uint8)
    grams = Rolling(BYTES[raw]).every(gram)
    # The leftmost smallest gram: 40 bits of its hash, and its place.
    low = np.uint64((1 << 24) - 1)
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
    begin, counts = np.cumsum(sizes) - sizes, sizes - (width - 1)
    string, at = np.repeat(np.arange(len(sizes)), counts), repeats.spread(begin, counts)
    own = least[at]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), dtype=bool), (own[1:] != own[:-1]) | (string[1:] != string[:-1])]))
    string, at, own = string[first], at[first], own[first]
    return string, at - begin[string], mix(own & ~low), (own & low).astype(np.int64) - begin[string], np.diff(first, append=int(counts.sum())), raw


def _finer(scratch: Scratch, strings: DataFrame, width: int, gram: int) -> DataFrame:
    """(h, id, start, within, content): the blocks of strings (id, start, content) whose anchor has several places in them. A block has one place of
    its anchor, so none has a window twice."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, contents in repeats.together(batch.column("content").to_pylist()):
                string, _, anchor, place, _, _ = _windows(contents, width, gram)
                ids, starts = (batch.column(c).to_numpy()[string + at] for c in ("id", "start"))
                where = mix(mix(ids.view(np.uint64)) + (starts + place).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(where.view(np.int64))], names=["h", "place"])

    places = strings.select("id", "start", "content").mapInArrow(anchors, "h long, place long")
    shared = scratch.table(places.groupBy("h").agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a <> b").select("h"), "anchors")
    n = shared.count()
    few = n <= repeats.BIT_ROWS
    bits = repeats.bit_table(shared, "h", n) if few else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, contents in repeats.together(batch.column("content").to_pylist()):
                string, offset, anchor, _, count, raw = _windows(contents, width, gram)
                pick = bits.value.has(anchor) if few else np.ones(len(anchor), dtype=bool)
                string, offset, anchor, count = string[pick], offset[pick], anchor[pick], count[pick]
                begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, contents), dtype=np.int64, count=len(contents)))])
                ids, starts = (batch.column(c).to_numpy()[string + at] for c in ("id", "start"))
                columns = [pa.array(anchor.view(np.int64)), pa.array(ids), pa.array(starts + offset), pa.array(np.zeros(len(ids), dtype=bool)), _strings(raw, begin[string] + offset, count + (width - 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "id", "start", "within", "content"])

    # Above the size of a bit table all blocks go on: more work, the same result.
    return strings.select("id", "start", "content").mapInArrow(cut, "h long, id long, start long, within boolean, content binary")


def repeated_bytes(spark: SparkSession, docs: DataFrame, width: int = WIDTH, grams: tuple[int, ...] = GRAMS, id_col: str = "doc_id", text_col: str = "text", symbol: int | None = None) -> DataFrame:
    """(id, ranges): starts of the strings that also start earlier, as array<struct<start, count>> of neighbouring starts."""
    scratch = Scratch(spark)
    with small_batches(spark):
        texts = _texts(docs, id_col, text_col)
        counts = repeats.anchor_counts(texts, width, grams[0]).groupBy("h").agg(F.sum("n").alias("n"))
        anchors = scratch.table(counts.filter("n > 1").select("h"), "anchors")
        blocks, found = _blocks(texts, anchors, anchors.count(), width, grams[0]), None
        for finer in (*grams[1:], None):
            blocks = scratch.table(blocks, "blocks")
            # Equal contents have one anchor. It comes first, as numbers sort faster than bytes.
            order = ordered(scratch, blocks.withColumn("count", F.octet_length("content") - (width - 1)), ["h", "content"], once="content")
            scratch.drop(blocks)
            again = order.filter(later()).select("id", "start", "count")
            found = again if found is None else found.union(again)
            # The first row of a partition keeps its content too, though it may not be the first of its kind.
            blocks = _contested(order.filter(~later()).filter("content IS NOT NULL").select("h", "id", "start", "within", "content"), scratch)
            blocks = _finer(scratch, blocks, width, finer) if finer else blocks
        edges = repeated_suffixes(scratch, blocks, width, symbol)
        ranges = materialize(repeats.grouped(found.union(edges.select("id", "start", F.lit(1).alias("count")))), "ranges")
    scratch.close()
    return ranges


def removed_bytes(docs: DataFrame, ranges: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary) or kept_sha256, for every row of docs."""
    name, kind = ("kept_sha256", "string") if digest else ("kept", "binary")
    schema = f"id long, n_bytes long, n_removed long, n_spans long, {name} {kind}"
    texts = _texts(docs, id_col, text_col)
    n = ranges.count()
    digest_of = lambda t: F.sha2(t, 256) if digest else t
    out = lambda b: hashlib.sha256(b).hexdigest() if digest else b

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text, r in zip(pdf["id"], pdf["t"], pdf["ranges"], strict=True):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                gone = repeats.covered(r if r is not None else (), len(raw) - width + 1, width) if len(raw) >= width else np.zeros(len(raw), dtype=bool)
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((key, len(raw), int(gone.sum()), spans, out(raw[~gone].tobytes())))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", name])

    left = repeats.with_ranges(texts, ranges, ["id"], n).mapInPandas(cut, schema)
    raw = F.col("t").cast("binary")
    whole = small_join(texts, ranges.select("id"), "id", "left_anti", n).select("id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), digest_of(raw).alias(name))
    both = whole.union(left).select(F.when(F.col("id") != repeats.NULL_ID, F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", name)
    with small_batches(docs.sparkSession):
        return materialize(both, "cut")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ranges = repeated_bytes(spark, docs)
    out = removed_bytes(docs, ranges, digest=True)
    drop_table(ranges)
    return out
