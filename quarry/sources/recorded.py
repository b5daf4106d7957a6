"""Kept answers of remote services: the same requests as to the service itself, answered from a folder that all executors share.

`record` writes rows as a service holds them, sorted by time of change within a part (a project; one part for a wiki or a drive), each with its
place, as parquet files of a bounded number of rows, and beside them an index of the files: a row for each stretch of places in a file, with its times.
Bodies are found by id over a second table of that kind, sorted by id. `answer` is what a service would say to one request: it looks into the
index, which a process reads once, and opens the files of that page alone, so a request costs the same however many rows are kept. Sources take such
a folder as their `url`, so a sync can be repeated without the service, on a cluster as well as in tests.
"""

from __future__ import annotations

import functools
import json
import uuid
from bisect import bisect_left, bisect_right

import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tables

PATHS = {"rest/api/content": "results", "rest/api/search": "issues", "files": "files"}
#: Rows of a file at most.
ROWS = 1000


def record(rows: DataFrame, folder: str, key: str, updated: str, raw: Column, part: Column | None = None, kind: Column | None = None, body: Column | None = None, first: dict[str, int] | None = None) -> None:
    """Appends rows to a folder. raw: the record as JSON. Places go on behind those of rows recorded before (`first`, by part); rows recorded later must
    have changed later. Places come from counts by partition of a range sort, so no part is in one task."""
    empty = F.lit(None).cast("string")
    x = rows.select(
        F.coalesce(part if part is not None else F.lit(""), F.lit("")).alias("part"), F.date_format(F.col(updated).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("updated"),
        F.col(key).cast("string").alias("id"), F.col(key).alias("_key"), (kind if kind is not None else empty).alias("kind"), raw.alias("raw"), (body if body is not None else empty).alias("body"),
    )
    spark, own = rows.sparkSession, uuid.uuid4().hex
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["part", "updated", "_key"]
    stage = f"{folder}-stage"
    x.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_key").withColumn("_m", F.monotonically_increasing_id()).write.mode("overwrite").parquet(stage)
    x = spark.read.parquet(stage)
    starts = x.groupBy("part", F.shiftright("_m", 33).alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("low"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("part", "_p", (before - F.col("low")).alias("_shift"))  # a row a part and partition
    shift = functools.reduce(lambda out, p: F.when(F.col("part") == p[0], p[1]).otherwise(out), (first or {}).items(), F.lit(0))
    x = x.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(starts), ["part", "_p"]).withColumn("place", F.col("_m") + F.col("_shift") + shift)
    written = f"{folder}/rows-{own}"
    x.select("part", "place", "updated", "id", "kind", "raw", "body", F.col("_p").alias("stretch")).sortWithinPartitions("part", "place").write.option("maxRecordsPerFile", ROWS).parquet(written)
    file = F.concat(F.lit(f"rows-{own}/"), F.col("_metadata.file_name"))
    kept = spark.read.parquet(written)
    if body is not None:
        ids = f"{folder}/ids-{own}"
        kept.select("id", "part", "place").repartitionByRange(n, "id").sortWithinPartitions("id").write.option("maxRecordsPerFile", ROWS).parquet(ids)
        known = spark.read.parquet(ids).groupBy(F.concat(F.lit(f"ids-{own}/"), F.col("_metadata.file_name")).alias("file")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
        known.coalesce(1).write.mode("append").parquet(f"{folder}/by-id")
    # The index comes last: rows that are not in it are not served. A file may hold several stretches of places, each a row of the index.
    index = kept.groupBy("part", file.alias("file"), "stretch").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.min("updated").alias("oldest"), F.max("updated").alias("newest"))
    index.drop("stretch").coalesce(1).write.mode("append").parquet(f"{folder}/index")
    tables.drop(spark, stage)


@functools.lru_cache(maxsize=8)
def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), folder


def _listed(folder: str, name: str) -> tuple[str, ...]:
    """The files of an index: one for each time that rows were recorded."""
    fs, path = _opened(folder)
    return tuple(sorted(f.path for f in fs.get_file_info(pafs.FileSelector(f"{path}/{name}", allow_not_found=True)) if f.path.endswith(".parquet")))


@functools.lru_cache(maxsize=8)
def _parts(folder: str, files: tuple[str, ...]) -> dict[str, tuple[list[int], list[dict]]]:
    """Part -> least places and rows of its files, in the order of places."""
    rows = ds.dataset(list(files), filesystem=_opened(folder)[0], format="parquet").to_table().to_pylist() if files else []
    out: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: r["low"]):
        out.setdefault(r["part"], []).append(r)
    return {part: ([r["low"] for r in own], own) for part, own in out.items()}


@functools.lru_cache(maxsize=8)
def _by_id(folder: str, files: tuple[str, ...]) -> list[tuple[list[bytes], list[dict]]]:
    """For each time that rows were recorded, the latest first: least ids and rows of its files, in the order of ids as Spark sorts them."""
    rows = ds.dataset(list(files), filesystem=_opened(folder)[0], format="parquet").to_table().to_pylist() if files else []
    out: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: r["low"].encode()):
        out.setdefault(r["file"].split("/")[0], []).append(r)
    return [([r["low"].encode() for r in own], own) for own in out.values()]


@functools.lru_cache(maxsize=4)
def _read(folder: str, file: str, column: str) -> dict[tuple[str, int], tuple[str, str]]:
    """(part, place) -> a column and the time of change, of one file; neighbouring pages and bodies share it."""
    fs, path = _opened(folder)
    t = pq.read_table(f"{path}/{file}", columns=["part", "place", column, "updated"], filesystem=fs)
    return dict(zip(zip(t["part"].to_pylist(), t["place"].to_pylist(), strict=True), zip(t[column].to_pylist(), t["updated"].to_pylist(), strict=True), strict=True))


@functools.lru_cache(maxsize=16)
def _places(folder: str, file: str) -> dict[str, tuple[str, int]]:
    fs, path = _opened(folder)
    t = pq.read_table(f"{path}/{file}", columns=["id", "part", "place"], filesystem=fs)
    return dict(zip(t["id"].to_pylist(), zip(t["part"].to_pylist(), t["place"].to_pylist(), strict=True), strict=True))


def _files(index: dict, part: str, low: int, high: int) -> list[dict]:
    """The files of a part with places from low up to high, without high."""
    lows, rows = index.get(part, ([], []))
    return [r for r in rows[max(0, bisect_right(lows, low) - 1) : bisect_right(lows, high - 1)] if r["high"] >= low]


def _body(folder: str, key: str) -> str:
    found = None
    for lows, rows in _by_id(folder, _listed(folder, "by-id")):
        # An id that has several rows may go on in the files before.
        for r in reversed(rows[: bisect_right(lows, key.encode())]):
            if r["high"].encode() < key.encode():
                break
            place = _places(folder, r["file"]).get(key)
            found = max(found, place, key=lambda p: -1 if p is None else p[1])
    if found is None:
        return ""
    part, place = found
    for r in _files(_parts(folder, _listed(folder, "index")), part, place, place + 1):
        if (part, place) in (own := _read(folder, r["file"], "body")):
            return own[part, place][0] or ""
    return ""


def _changed_before(folder: str, index: dict, part: str, since: str) -> int:
    """How many rows of a part changed before a time. Rows are in the order of their change, so only the file in which it falls is read."""
    rows = index.get(part, ([], []))[1]
    n = bisect_left(rows, since, key=lambda r: r["newest"])
    if n == len(rows):
        return rows[-1]["high"] + 1 if rows else 0
    r = rows[n]
    return r["low"] + (sum(at < since for (p, i), (_, at) in _read(folder, r["file"], "raw").items() if p == part and r["low"] <= i <= r["high"]) if r["oldest"] < since else 0)


def answer(folder: str, path: str, query: dict[str, object]) -> bytes:
    """What the service says to a request; places are its offsets and tokens."""
    if path not in PATHS:
        return _body(folder, path.split("/")[1]).encode()
    part, since = str(query.get("project") or ""), query.get("since")
    low = int(query.get("start") or query.get("token") or query.get("pageToken") or 0)
    index = _parts(folder, _listed(folder, "index"))
    if since:
        skipped = _changed_before(folder, index, part, str(since))
        low = low + skipped if path == "rest/api/content" else max(low, skipped)
    size = int(query.get("limit") or query.get("pageSize") or 100)
    if query.get("newest"):
        low = max(0, max((r["high"] for r in index.get(part, ([], []))[1]), default=-1) + 1 - size)
    if query.get("fields") == "nextPageToken":
        last = max((r["high"] for r in index.get(part, ([], []))[1]), default=-1)
        return json.dumps({"nextPageToken": str(low + size)} if low + size <= last + 1 else {}).encode()
    asked, rows = str(query.get("q") or ""), []
    for r in _files(index, part, low, low + size):
        own, kinds = _read(folder, r["file"], "raw"), _read(folder, r["file"], "kind") if asked else {}
        rows += [(i, own[part, i][0], kinds[part, i][0] if asked else None) for i in range(max(low, r["low"]), min(low + size, r["high"] + 1)) if (part, i) in own]
    found = [json.loads(raw) for _, raw, kind in sorted(rows, key=lambda r: r[0]) if not asked or f"'{kind}'" in asked]
    out: dict[str, object] = {PATHS[path]: found}
    if len(rows) == size:
        out["nextPageToken"] = str(low + size)
    return json.dumps(out).encode()
