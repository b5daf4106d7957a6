"""What exact passage removal shares: windows of symbols (words or bytes) that occur before.

Two equal windows of `width` symbols have the same anchor, the smallest hash of the `gram`-symbol runs inside them. A maximal
run of neighbouring windows with one anchor is a block. So an anchor that occurs once in the whole corpus rules all its windows out (most
anchors, and no text is moved for that), and a block equal to an earlier block is covered whole.

Between passes over the texts, candidates travel as bit tables, which may only let too much through, never too little; above a counted
size a shuffled semi-join takes their place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_join
from .hashing import BYTES, Rolling, mix, sliding_min, word_hashes

NULL_ID = -(1 << 63)
Symbols = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]

#: Hashes for which a bit table is made and sent to all executors: 16 bits each, 16 MB at most.
BIT_ROWS = 1 << 23
SLICES = 64


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of many texts end to end, and how many each has."""
    return word_hashes(texts)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of strings end to end, and where each begins and the last ends: nothing is decoded."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def cuts(offsets: np.ndarray, most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of up to so many bytes (or of one text), as together() has them."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, end
        start = end


def together(texts: list, most: int = 200_000) -> Iterator[tuple[int, list]]:
    """Runs of texts of up to so many characters, with the place of the first: what numpy takes at once, and what fits in a
    processor's cache."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


@dataclass
class Blocks:
    """Blocks of many documents: place of the document, anchor, content hash, first window (in the document, and in all symbols), number of windows."""

    doc: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    start: np.ndarray
    at: np.ndarray
    count: np.ndarray
    within: np.ndarray
    """Whether a window of the block may be in it twice; if asked for."""


def blocks(symbols: np.ndarray, sizes: np.ndarray, width: int, gram: int, content: bool = True) -> Blocks:
    """content: with content hashes; otherwise `within` is told."""
    none, reach = np.zeros(0, dtype=np.int64), width - gram + 1
    if len(symbols) < width:
        return Blocks(none, none.view(np.uint64), none.view(np.uint64), none, none, none, none.astype(bool))
    rolling = Rolling(symbols)
    grams = rolling.every(gram, False)
    least = sliding_min(grams, reach)
    begin, long = np.cumsum(sizes) - sizes, sizes >= width
    # Blocks begin where the anchor changes, a document begins, or its last window is over.
    edge = np.ones(len(least) + width, dtype=bool)
    np.not_equal(least[1:], least[:-1], out=edge[1 : len(least)])
    edge[begin[long]] = edge[(begin + sizes - (width - 1))[long]] = True
    at = np.flatnonzero(edge[: len(least)])
    count = np.diff(at, append=len(least))
    doc = np.searchsorted(begin, at, "right") - 1
    inside = at + width <= (begin + sizes)[doc]
    at, count, doc = at[inside], count[inside], doc[inside]
    hashes, within = none.view(np.uint64), none.astype(bool)
    if content:
        hashes = rolling.runs(at, at + count + (width - 1))
    else:
        # Of two equal windows, the first begins at or before an anchor's place that begins a window of the block, and the second ends at
        # or behind another one that ends a window.
        n, end = len(least), at + count
        first, last = np.flatnonzero(grams[:n] == least), np.flatnonzero(grams[reach - 1 : reach - 1 + n] == least)
        x = np.concatenate([first, [len(grams)]])[np.searchsorted(first, at)]
        y = np.concatenate([[-1], last])[np.searchsorted(last, end)]
        within = (x < end) & (y >= at) & (x < y + reach - 1)
    return Blocks(doc, least[at], hashes, at - begin[doc], at, count, within)


class Bits:
    """A table of 2^log2 bits: what was put in is in."""

    def __init__(self, log2: int):
        self.shift, self.table = np.uint64(64 - log2), np.zeros(1 << (log2 - 3), dtype=np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = mix(hashes.view(np.uint64)) >> self.shift
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def bit_table(df: DataFrame, col: str, rows: int | None = None):  # noqa: ANN201
    """Broadcasts the bits of a column of longs, 16 a row. Only for a counted number of rows, BIT_ROWS at most. The table is built in slices."""
    rows = df.count() if rows is None else rows
    log2 = max(16, math.ceil(math.log2(16 * max(1, rows))))
    per = (1 << log2) // SLICES

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = (mix(pdf[col].to_numpy(dtype=np.int64).view(np.uint64)) >> np.uint64(64 - log2)).astype(np.int64)
            yield pd.DataFrame({"slice": at // per, "at": at % per})

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(per, dtype=np.uint8)
        table[pdf["at"].to_numpy()] = 1
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "raw": [np.packbits(table, bitorder="little").tobytes()]})

    out = Bits(log2)
    for r in df.select(col).mapInPandas(slots, "slice int, at int").groupBy("slice").applyInPandas(fill, "slice int, raw binary").collect():
        out.table[r["slice"] * per // 8 : (r["slice"] + 1) * per // 8] = np.frombuffer(r["raw"], dtype=np.uint8)
    return df.sparkSession.sparkContext.broadcast(out)


def anchor_counts(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """h and n: in how many blocks of bytes an anchor occurs, with one more for a block that may repeat itself. Summed once for each batch of
    texts, not over batches, so that one shuffle can do the rest."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            out = [np.zeros(0, dtype=np.uint64)]
            for i, j in cuts(offsets):
                x = blocks(BYTES[raw[offsets[i] : offsets[j]]], np.diff(offsets[i : j + 1]), width, gram, content=False)
                out += [x.anchor, x.anchor[x.within]]
            h, n = np.unique(np.concatenate(out), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

    return texts.select("t").mapInArrow(scan, "h long, n int")


def with_ranges(texts: DataFrame, ranges: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """texts joined to `ranges` (one row a key, so many rows); texts of other keys stay out of the shuffle as long as the keys can be broadcast."""
    return small_join(texts, ranges.select(*keys), keys, "left_semi", rows).join(ranges, keys)


def spread(starts: list[int], counts: list[int]) -> np.ndarray:
    """start, start + 1, … for each range in turn."""
    start, count = np.asarray(starts, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def grouped(ranges: DataFrame) -> DataFrame:
    """(id, start, count) -> one row an id; the ranges of one document only."""
    return ranges.groupBy("id").agg(F.collect_list(F.struct("start", "count")).alias("ranges"))


def covered(ranges, n_windows: int, width: int) -> np.ndarray:  # noqa: ANN001
    """Of n_windows + width - 1 symbols, those inside a window of the ranges."""
    edge = np.zeros(n_windows + width, dtype=np.int64)
    for r in ranges:
        start, end = min(r["start"], n_windows), min(r["start"] + r["count"], n_windows)
        if start < end:
            edge[start] += 1
            edge[end + width - 1] -= 1
    return np.cumsum(edge)[: n_windows + width - 1] > 0
