"""Nearest neighbours over array columns: exact, filtered, batched and by cells of centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Squared Euclidean (l2), cosine or negative dot product; null if lengths differ."""
    if metric == "l2":
        out = F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    elif metric == "cosine":
        out = 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
    elif metric == "dot":
        out = -dot(a, b)
    else:
        raise ValueError(f"no metric {metric}")
    return F.when(F.size(a) == F.size(b), out)


def knn(df: DataFrame, vector: str, key: str, query: list[float], k: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """The k nearest rows: one scan, a top-k heap a task, no shuffle of rows. The filter goes before the cut."""
    x = df if where is None else df.filter(where)
    to = F.array(*[F.lit(float(v)) for v in query])
    return x.withColumn("distance", distance(F.col(vector), to, metric)).filter("distance IS NOT NULL").orderBy("distance", key).limit(k)


def batch_knn(df: DataFrame, vector: str, key: str, queries: DataFrame, query_key: str, query_vector: str, k: int, metric: str = "l2", block: int = 4096) -> DataFrame:
    """k nearest for each row of a stated query set. Queries go in blocks against all rows, as matrices; each task keeps k a query before
    anything is shuffled. Vectors of another length than the queries', or with nulls, are left out. Terms are summed in the order of
    distance(), so results are the same to the last bit."""
    if metric != "l2":
        raise ValueError("batches are by l2")
    q = queries.select(F.col(query_key).cast("long").alias("q"), _d(F.col(query_vector)).alias("qv")).filter("qv IS NOT NULL")
    width = (q.select(F.max(F.size("qv"))).first()[0]) or 1
    whole = lambda v: (F.size(v) == width) & ~F.exists(v, lambda x: x.isNull())
    q = q.filter(whole("qv"))
    rows = df.filter(whole(vector)).select(F.col(key).cast("long").alias("id"), _d(F.col(vector)).alias("v"), F.lit(0).alias("cell"))
    blocks = max(1, -(-q.count() // block))
    out = None
    for i in range(blocks):
        own = q.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()  # a block of queries
        asked = df.sparkSession.sparkContext.broadcast((np.array([r.q for r in own], dtype=np.int64), np.array([r.qv for r in own], dtype=np.float64).reshape(-1, width)))
        near = rows.mapInPandas(_nearest(asked, None, k), "q long, id long, distance double, cell int")
        near = near.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "id"))).filter(F.col("rank") <= k).select("q", "id", "distance", "rank")
        out = near if out is None else out.union(near)
    return out


def assign_cells(df: DataFrame, vector: str, centroids: list[list[float]]) -> DataFrame:
    """The nearest centroid of each row, as cell; write partitioned by it to search few cells."""
    c = F.array(*[F.struct(distance(F.col(vector), F.array(*[F.lit(float(v)) for v in x])).alias("d"), F.lit(i).alias("cell")) for i, x in enumerate(centroids)])
    return df.withColumn("cell", F.array_min(c)["cell"])


def cell_knn(cells: DataFrame, vector: str, key: str, queries: DataFrame, query_key: str, query_vector: str, centroids: list[list[float]], k: int, block: int = 4096) -> DataFrame:
    """q, id, distance, rank, cell: the k nearest of each query, all of them. A cell's rows are skipped only where the triangle inequality (distance
    to the centroid less the rows' radius) says that none comes before the k found so far; so the centroids change the time, never the rows.
    Each task keeps k a query. Vectors of another length, or with nulls, are left out on both sides, and so are null cells."""
    c = np.array(centroids, dtype=np.float64)
    if not c.size:
        return cells.select(F.lit(None).cast("long").alias("q"), F.col(key).cast("long").alias("id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"), F.lit(0).alias("cell")).limit(0)
    whole = lambda v: (F.size(v) == c.shape[1]) & ~F.exists(v, lambda x: x.isNull())
    q = queries.filter(whole(query_vector)).select(F.col(query_key).cast("long").alias("q"), _d(F.col(query_vector)).alias("qv"))
    rows = cells.filter(whole(vector)).filter("cell IS NOT NULL").select(F.col(key).cast("long").alias("id"), _d(F.col(vector)).alias("v"), F.col("cell").cast("int").alias("cell"))
    blocks = max(1, -(-q.count() // block))
    out = None
    for i in range(blocks):
        own = q.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()
        asked = cells.sparkSession.sparkContext.broadcast((np.array([r.q for r in own], dtype=np.int64), np.array([r.qv for r in own], dtype=np.float64).reshape(-1, c.shape[1])))
        near = rows.mapInPandas(_nearest(asked, c, k), "q long, id long, distance double, cell int")
        near = near.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "id"))).filter(F.col("rank") <= k).select("q", "id", "distance", "rank", "cell")
        out = near if out is None else out.union(near)
    return out


def _nearest(asked, c: np.ndarray | None, k: int):  # noqa: ANN001, ANN202
    """For mapInPandas: the k nearest rows of a task to each query, in the order of distance and id. Without centroids all rows are compared."""

    def first(d: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
        """The k first columns of each line by d; columns that tie keep their order."""
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        return [np.take_along_axis(x, at, axis=1) for x in (d, *more)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = asked.value
        far = None if c is None else np.sqrt(((q[:, None, :] - c[None]) ** 2).sum(axis=2))
        best, keys, cell = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), -1)
        for pdf in batches:
            for n, part in pdf.sort_values("id", kind="stable").groupby("cell"):
                v = np.array(part["v"].tolist(), dtype=np.float64)
                open_ = np.arange(len(q))
                if far is not None:
                    radius = np.sqrt(((v - c[n]) ** 2).sum(axis=1)).max()
                    # The slack is far above rounding; a bound that is no number skips nothing.
                    least = np.maximum(0, far[:, n] - radius - 1e-9 * (far[:, n] + radius)) ** 2
                    open_ = np.flatnonzero(~(least > best[:, -1]))
                for at in range(0, len(v), 256) if len(open_) else ():
                    x, own = v[at : at + 256], part["id"].to_numpy(dtype=np.int64)[at : at + 256]
                    d = np.zeros((len(open_), len(x)))
                    for j in range(v.shape[1]):  # in the order of distance(), so that sums are the same to the last bit
                        d += (x[None, :, j] - q[open_, None, j]) ** 2
                    d, own, same = first(d, np.broadcast_to(own, d.shape), np.full(d.shape, n))
                    d, own, same = (np.concatenate(p, axis=1) for p in ((best[open_], d), (keys[open_], own), (cell[open_], same)))
                    by_id = np.argsort(own, axis=1, kind="stable")
                    best[open_], keys[open_], cell[open_] = first(*(np.take_along_axis(y, by_id, axis=1) for y in (d, own, same)))
        some = cell >= 0
        yield pd.DataFrame({"q": np.repeat(ids, k).reshape(-1, k)[some], "id": keys[some], "distance": best[some], "cell": cell[some].astype(np.int32)})

    return run


def title_boosted(d: Column, ratio: Column) -> Column:
    return F.when(ratio >= 0.66, d / 5).when(ratio >= 0.33, d / 3).otherwise(d)
