"""Sorted suffixes of sampled positions, after the difference cover modulo three of Kaerkkaeinen and Sanders.

A run is a stretch of neighbouring suffixes that are judged by their first `width` bytes. Positions of a run are dealt by their
offset modulo three, and those of remainder one and two are the sample:

1. Sampled suffixes are sorted by triples of `symbol` bytes, and triples are named. If a triple spans less than the width, the
   names and the triples behind them are sorted in turn, recursively.
2. The remaining suffixes are merged in through the names of the sample: remainders zero and one in a sort by (byte, name of the next),
   zero and two by (byte, byte, name of the one after). Names count the differences in the first width - 1 and width - 2 bytes.
3. Neighbours in each order are compared, in their bytes or by byte and name; of equal ones the earliest place stands first.

Two places behind a run's end are sampled too, as far as its bytes go, so every suffix finds its next ones. Sorts are range partitions with
the place as the last key, so a suffix with a third of all places is spread. What the driver sees is two rows a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _different(now: pa.Array, last: pa.Array | None, prefix: int | None = None) -> np.ndarray:
    """Which values differ from the one before."""
    both = pa.concat_arrays([now[:1] if last is None else last, now])
    if prefix is not None:
        both = pc.binary_slice(both, 0, prefix)
    return pc.not_equal(both[1:], both[:-1]).to_numpy(zero_copy_only=False)


def ordered(scratch: Scratch, df: DataFrame, keys: list[str], prefixes: tuple[int, ...] = (), once: str = "", name: str = "order") -> DataFrame:
    """df (id, start, keys; others) in the order of keys, id and start, with first_id and first_start: the earliest place with the same
    keys; and for each prefix p a column name_p: how many rows before differ from their predecessor in the first p bytes of the last key
    (p = 0: all of it) or in another key. The column `once` is kept in the first row of equal keys (and of a partition) only."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"name_{p}" for p in prefixes]
    added = ["part", "edge", "head", "first_id", "first_start", *names]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema] + [f"{c} long" for c in added])

    def batch_of(out: dict, keep: np.ndarray) -> pa.RecordBatch:
        if once:
            out[once] = pc.if_else(pa.array(keep), out[once], pa.scalar(None, out[once].type))
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], names=list(out))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, first, steps, held = TaskContext.get().partitionId(), None, None, dict.fromkeys(names, 0), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held:
                yield batch_of(*held)
            own = [batch.column(k) for k in keys]
            others = np.zeros(n, dtype=bool)
            for i, c in enumerate(own[:-1]):
                others |= _different(c, last and last[i])
            new = others | _different(own[-1], last and last[-1])
            ids, starts = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "start"))
            first = first or (ids[0], starts[0], True)
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            fid, fst, head = np.where(at < 0, first[0], ids[at]), np.where(at < 0, first[1], starts[at]), (at < 0) & first[2]
            edge = np.zeros(n, dtype=np.int64)
            edge[0] = last is None
            out = {f.name: batch.column(f.name) for f in batch.schema}
            out |= {"part": np.full(n, part), "edge": edge, "head": head.astype(np.int64), "first_id": fid, "first_start": fst}
            for c, p in zip(names, prefixes, strict=True):
                out[c] = steps[c] + np.cumsum(others | (_different(own[-1], last and last[-1], p) if p else new))
                steps[c] = int(out[c][-1])
            held = out, new | (edge > 0)
            first, last = (fid[-1], fst[-1], bool(head[-1])), [c[n - 1 :] for c in own]
        if held:
            held[0]["edge"][-1] += 2
            held[1][-1] = True
            yield batch_of(*held)

    sorted_ = df.repartitionByRange(parts, *keys, "id", "start").sortWithinPartitions(*keys, "id", "start")
    rows = scratch.table(sorted_.mapInArrow(walk, schema), name)
    edges = rows.filter("edge > 0").collect()  # two rows a partition
    shifts, last, earliest, offsets = [], None, None, dict.fromkeys(names, 0)
    for part in sorted({r["part"] for r in edges}):
        own = [r for r in edges if r["part"] == part]
        begin, end = next(r for r in own if r["edge"] & 1), next(r for r in own if r["edge"] & 2)
        same = last is not None and all(begin[k] == last[k] for k in keys)
        for c, p in zip(names, prefixes, strict=True):
            alike = last is not None and all(begin[k] == last[k] for k in keys[:-1]) and (begin[keys[-1]][:p] == last[keys[-1]][:p] if p else same)
            offsets[c] += int(last is not None and not alike)
        carried = earliest if same else (None, None)
        shifts.append((part, *carried, *offsets.values()))
        earliest = carried if same and end["head"] else (end["first_id"], end["first_start"])
        for c in names:
            offsets[c] += end[c]
        last = end
    shift = spark.createDataFrame(shifts, "p long, e_id long, e_start long" + "".join(f", s_{c} long" for c in names))
    out = rows.join(F.broadcast(shift), rows["part"] == shift["p"])
    resolved = [F.when(F.col("head") * F.isnotnull("e_id").cast("long") == 1, F.col(f"e_{c}")).otherwise(F.col(f"first_{c}")).alias(f"first_{c}") for c in ("id", "start")]
    return out.select(*df.columns, *resolved, *[(F.col(c) + F.col(f"s_{c}")).alias(c) for c in names])


def later() -> Column:
    """Rows of ordered() with an earlier row of the same keys."""
    return (F.col("first_id") != F.col("id")) | (F.col("first_start") != F.col("start"))


def sample(runs: DataFrame, width: int) -> DataFrame:
    """runs (id, start, content: width - 1 more bytes than suffixes) -> the sampled suffixes: id, start, key (their first bytes), suffix (not one
    of the two places behind), and before1 and before2, the one and two bytes before them, null if those places are not in the run."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column("content")
            sizes = pc.binary_length(contents).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = np.frombuffer(b"".join(contents.to_pylist()), dtype=np.uint8)
            counts = sizes - (width - 1)
            run = np.repeat(np.arange(len(sizes)), counts + 2)
            offset = np.arange(len(run)) - np.repeat(np.cumsum(counts + 2) - (counts + 2), counts + 2)
            pick = offset % 3 > 0
            run, offset = run[pick], offset[pick]
            at = (np.cumsum(sizes) - sizes)[run] + offset
            length = np.minimum(width, sizes[run] - offset)
            ends = np.cumsum(length)
            data = raw[np.repeat(at - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
            key = pa.BinaryArray.from_buffers(pa.binary(), len(run), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            ids, starts = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[run] for c in ("id", "start"))
            inside = offset < counts[run]
            one = np.where(offset <= counts[run], raw[at - 1], 0).astype(np.int64)
            two = raw[np.maximum(at - 2, 0)].astype(np.int64) * 256 + raw[at - 1]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(starts + offset), key, pa.array(inside), pa.array(one, mask=offset > counts[run]), pa.array(two, mask=offset < 2)], names=["id", "start", "key", "suffix", "before1", "before2"])

    return runs.select("id", "start", "content").mapInArrow(scan, "id long, start long, key binary, suffix boolean, before1 long, before2 long")


def repeated_suffixes(scratch: Scratch, runs: DataFrame, width: int, symbol: int | None = None) -> DataFrame:
    """runs (id, start, content) -> (id, start) of every suffix whose first `width` bytes also start a suffix at an earlier place; some twice."""
    triple = 3 * (symbol or -(-width // 3))
    sampled, reach, keys = scratch.table(sample(runs, width), "sample"), 0, ["key"]
    while reach + triple < width - 2:
        # One level of the recursion: names of what is sorted so far and the next triple.
        level = sampled.withColumn("rest", F.expr(f"substring(key, {triple + 1})")).withColumn("key", F.expr(f"substring(key, 1, {triple})"))
        named = ordered(scratch, level, keys, (0,)).select("id", "start", F.col("name_0").alias("name"), F.col("rest").alias("key"), "suffix", "before1", "before2")
        scratch.drop(sampled)
        sampled = scratch.table(named, "level")
        reach, keys = reach + triple, ["name", "key"]
    first, second = width - 1 - reach, width - 2 - reach
    order = ordered(scratch, sampled, keys, (first, second))
    scratch.drop(sampled)
    hits = order.filter(F.col("suffix") & later()).select("id", "start")
    one = order.filter("before1 IS NOT NULL").select("id", (F.col("start") - 1).alias("start"), F.col("before1").alias("c"), F.col(f"name_{first}").alias("n"))
    two = order.filter("before2 IS NOT NULL").select("id", (F.col("start") - 2).alias("start"), F.col("before2").alias("c"), F.col(f"name_{second}").alias("n"))
    for merged in (one, two):
        hits = hits.union(ordered(scratch, merged, ["c", "n"]).filter(later()).select("id", "start"))
    return hits
