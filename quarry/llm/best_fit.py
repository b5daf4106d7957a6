"""Packing documents into fixed windows by best fit decreasing, certified by lower bounds and repaired where they leave a gap.

1. Each document is tokenized once in the scan. Only one longer than the window is cut, into pieces of a whole window; its first piece
   may be shorter. Whole windows are sequences of their own.
2. The other pieces are dealt to partitions of some `per_task` pieces. Each is packed by best fit decreasing, and dual feasible functions
   (two families and their compositions) over its lengths bound from below how many sequences any packing of them needs.
3. The same bound over the lengths of all pieces (at most `window` numbers, whatever the corpus) tells how many sequences could be spared
   at most. While that is not zero, partitions exchange documents: one whose bound is not met gives away every sequence with room left,
   a certified one only its emptiest. What is given away is dealt anew to as many partitions as it needs and packed again; a
   partition that needs no fewer sequences then keeps the old ones. This ends when the bound is met, when a single partition spares none, or
   after `rounds`.

A sequence is named by the number of its first piece. Null texts count as empty and give one piece, the end id. Repeated rows are packed as
often as they come. An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import functools
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, materialize, small_batches, text_of
from .packing import PLAIN, gathered

WINDOW = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
PER_TASK = 50_000
ROUNDS = 6
#: Divisors of the rounding functions that bound a packing from below.
DEPTH = 24


class ByteEncoder:
    """Ids of whole texts by a byte-level vocabulary. Where the same vocabulary is there as ranks, beside it, texts of PLAIN characters without
    special strings are encoded by those (the ids are the same, in a fifth of the time); all others by the tokenizer itself."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        self.tokenizer, self.ranks = Tokenizer.from_file(path), None
        beside = re.sub(r"\.json$", ".tiktoken", path)
        if beside != path and os.path.exists(beside):
            import tiktoken

            with open(beside, "rb") as f:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.apart = "|".join([f"[^{PLAIN}]", *special])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if self.ranks is None:
            yield from (np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False))
            return
        for text, apart in zip(texts.to_pylist(), pc.match_substring_regex(texts, self.apart).to_pylist(), strict=True):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids if apart else self.ranks.encode_ordinary(text)
            yield np.array(ids, dtype="<u4")


@functools.lru_cache(maxsize=1)
def encoder(vocabulary: str) -> ByteEncoder:
    return ByteEncoder(vocabulary)


def pieces_of(docs: DataFrame, id_col: str, text_col: str, window: int, vocabulary: str, emit: str) -> DataFrame:
    """id, piece, start, length and ids_crc32 (emit="crc32") or ids, little-endian (emit="ids")."""
    name, kind = ("ids_crc32", "long") if emit == "crc32" else ("ids", "binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            row, piece, start, size, payload = [], [], [], [], []
            for i, ids in enumerate(encoder(vocabulary).encode(batch.column("t").combine_chunks())):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                first = len(ids) % window or window
                for k, at in enumerate([0, *range(first, len(ids), window)]):
                    own = ids[at : at + window if at else first].tobytes()
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    size.append(len(own) // 4)
                    payload.append(zlib.crc32(own) if emit == "crc32" else own)
            key = batch.column("id").combine_chunks().take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([key, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(payload, pa.int64() if emit == "crc32" else pa.binary())], names=["id", "piece", "start", "length", name])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(cut, f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, {name} {kind}")


def lower_bound(counts: np.ndarray, depth: int = DEPTH) -> int:
    """How many windows of len(counts) - 1 tokens any packing needs, counts[x] being the pieces of x tokens.

    A dual feasible function gives a set of lengths that fit one window at most 1 in all. For a threshold e: lengths above window - e count
    1, those below e count 0. In between a length counts its share x of the window or, for a divisor k, x if (k + 1) x is whole and else
    floor((k + 1) x) / k. The greatest sum over all e and k is the bound, in whole numbers throughout."""
    window = len(counts) - 1
    lengths, best = np.arange(window + 1, dtype=np.int64), 0
    n = counts.astype(np.int64)
    below = np.concatenate([[0], np.cumsum(n)])
    e = np.arange(window // 2 + 1)
    for k in range(depth + 1):
        scale = max(k, 1) * window
        share = lengths if k == 0 else np.where((k + 1) * lengths % window == 0, k * lengths, window * ((k + 1) * lengths // window))
        sums = np.concatenate([[0], np.cumsum(share * n)])
        total = scale * (below[-1] - below[window - e + 1]) + sums[window - e + 1] - sums[e]
        best = max(best, -(-int(total.max()) // scale))
    return best


def best_fit(lengths: list[int], window: int) -> list[int]:
    """The window of each piece: longest first, each into the fullest window that has room for it."""
    out, rooms, open_, used = [0] * len(lengths), [[] for _ in range(window + 1)], 0, 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        x = lengths[i]
        if fits := open_ >> x:
            room = x + (fits & -fits).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                open_ ^= 1 << room
        else:
            room, own, used = window, used, used + 1
        out[i] = own
        if left := room - x:
            rooms[left].append(own)
            open_ |= 1 << left
    return out


def packed(table: pa.Table, window: int) -> pa.Table:
    """The table (row, length, sequence_id, offset; others) packed anew, unless it is packed in no more sequences already; `loose` tells which
    pieces are in sequences that its partition gives away."""
    table = table.sort_by([("length", "descending"), ("row", "ascending")])
    rows, lengths = (table.column(c).to_numpy() for c in ("row", "length"))
    own = np.array(best_fit(lengths.tolist(), window))
    old, offsets = table.column("sequence_id"), table.column("offset").to_numpy(zero_copy_only=False)
    n_new = int(own.max()) + 1
    if old.null_count == 0 and len(before := np.unique(old.to_numpy())) <= n_new:
        own, n_new = np.searchsorted(before, old.to_numpy()), len(before)
        names = before
    else:
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        ends = np.cumsum(lengths[order]) - lengths[order]
        offsets = np.empty(len(rows), dtype=np.int64)
        offsets[order] = ends - np.repeat(ends[first], np.diff(first, append=len(order)))
        names = rows[order][first]
    room = window - np.bincount(own, weights=lengths, minlength=n_new).astype(np.int64)
    certified = n_new == lower_bound(np.bincount(lengths, minlength=window + 1))
    given = (np.arange(n_new) == np.argmax(room)) & (room > 0) if certified else room > 0
    others = [c for c in table.column_names if c not in ("sequence_id", "offset", "loose")]
    table = table.select(others).append_column("sequence_id", pa.array(names[own])).append_column("offset", pa.array(offsets.astype(np.int64)))
    return table.append_column("loose", pa.array(given[own]))


def bound_of(pieces: DataFrame, window: int) -> int:
    counts = np.zeros(window + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `window` rows
        counts[r["length"]] = r["count"]
    return lower_bound(counts)


def certificate(pieces: DataFrame, window: int = WINDOW) -> tuple[int, int]:
    """The sequences of packed pieces, and how many any packing of them needs."""
    return pieces.filter("offset = 0").count(), bound_of(pieces, window)


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str = VOCABULARY, emit: str = "crc32", per_task: int = PER_TASK, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 or ids, sequence_id, offset."""
    scratch = Scratch(spark)
    with small_batches(spark):
        pieces = scratch.table(pieces_of(docs, id_col, text_col, window, vocabulary, emit).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = pieces.filter(F.col("length") == window).withColumn("sequence_id", F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    # The payload stays where it is: what moves between partitions is a number and a length.
    left = pieces.filter(F.col("length") < window).select("row", "length", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"), F.lit(True).alias("loose"))
    bound, done, spent, used = bound_of(left, window), [], 0, math.inf
    given, n = left, left.count()
    for i in range(rounds):
        if not n or used <= bound:
            break
        groups = given.withColumn("part", F.pmod(F.xxhash64(F.coalesce("sequence_id", "row"), F.lit(i)), F.lit(-(-n // per_task)))).groupBy("part")
        new = scratch.table(groups.applyInArrow(lambda table: packed(table.drop_columns("part"), window), "row long, length long, sequence_id long, offset long, loose boolean"), "packed")
        last, used = used, spent + new.filter("offset = 0").count()
        done.append(new.filter("NOT loose"))
        spent += done[-1].filter("offset = 0").count()
        given = new.filter("loose")
        n = given.count()
        if used >= last and n <= per_task:
            break
    places = functools.reduce(DataFrame.union, [*done, given]).select("row", "sequence_id", "offset")
    rest = pieces.filter(F.col("length") < window).join(places, "row")
    payload = "ids_crc32" if emit == "crc32" else "ids"
    out = whole.unionByName(rest).select(F.col("id").alias(id_col), "piece", "start", "length", payload, "sequence_id", "offset")
    out = materialize(out, "best-fit")
    scratch.close()
    return out


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, documents(spark, sf_dir))
