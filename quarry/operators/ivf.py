"""An inverted file of quantized vectors: trained cells, residual product codes, search by distance tables, exact re-ranking.

Training (`train`): k-means for the cells, then k-means in each of `parts` sub-spaces for the residuals. Both run as rounds of one
aggregation over all rows, from the first ones by a hash of the key on: tasks sum their rows by nearest centre, Spark adds the sums up,
and only the centres (cells or parts x codes rows) come to the driver.

Storage (`save`), one version of a table set: `codes` (key and `parts` bytes a row, a folder a cell), `vectors` (a folder a cell, sorted by key),
`keys` (key -> cell, in buckets of the key's hash, sorted: the scalar index) and `centres`.

Search (`search`): a query probes its nearest cells. Tasks read the codes of probed cells alone and sum table entries, one look-up a
part, for all queries of a cell at once; each keeps `rerank` rows a query. Vectors are read for those candidates only, from their cells, and
ranked by the exact distance. `share_read` tells how much of the table a set of queries probes, counted for each of them.

Every row is in the index; vectors of another length, or with nulls in them, are in none. Ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.sources import tables

from .vector import distance

CELLS, PARTS, CODES = 256, 16, 256
BLOCK = 4096


@dataclass
class Centres:
    cells: np.ndarray
    """One line a cell."""
    codes: np.ndarray
    """part, code, dimension of the part: residuals to the cell."""

    @property
    def parts(self) -> int:
        return len(self.codes)

    def split(self, x: np.ndarray) -> np.ndarray:
        """(rows, parts, dimensions of a part)"""
        return x.reshape(len(x), self.parts, -1)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, None, :], self.cells[None])[:, 0]

    def code_of(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return nearest(self.split(x - self.cells[cell]), self.codes).astype(np.uint8)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For x (rows, parts, d) and centres (parts, n, d): the nearest centre of each part, by matrix products."""
    out = np.empty(x.shape[:2], dtype=np.int64)
    for m in range(x.shape[1]):
        c = centres[m]
        out[:, m] = np.argmin((c * c).sum(axis=1)[None] - 2 * (x[:, m] @ c.T), axis=1)
    return out


def probed(cells: np.ndarray, queries: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each query."""
    d = (cells * cells).sum(axis=1)[None] - 2 * queries @ cells.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(-1, width)


def whole(df: DataFrame, vector: str, width: int) -> DataFrame:
    return df.filter((F.size(vector) == width) & ~F.exists(vector, lambda v: v.isNull()))


def _rounds(rows: DataFrame, width: int, first: np.ndarray, rounds: int, residual=None) -> np.ndarray:  # noqa: ANN001
    """k-means from the given centres (parts, n, d) on; a centre without rows stays where it is."""
    centres, (parts, n, d) = first, first.shape
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(centres)

        def add_up(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            sums, counts = np.zeros((parts * n, d)), np.zeros(parts * n, dtype=np.int64)
            for pdf in batches:
                x = _matrix(pdf["v"], width)
                x = (residual(x) if residual else x).reshape(len(x), parts, d)
                own = (nearest(x, shared.value) + np.arange(parts) * n).ravel()
                np.add.at(sums, own, x.reshape(-1, d))
                counts += np.bincount(own, minlength=parts * n)
            if len(some := np.flatnonzero(counts)):  # a task may have no rows
                yield pd.DataFrame({"c": some, "n": counts[some], "s": sums[some].tolist()})

        each = rows.mapInPandas(add_up, "c long, n long, s array<double>").groupBy("c")
        sums = each.agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(d)]).collect()  # a row a centre
        centres = centres.reshape(-1, d).copy()
        for r in sums:
            centres[r["c"]] = np.array(r[2:]) / r["n"]
        centres = centres.reshape(parts, n, d)
    return centres


def train(df: DataFrame, vector: str, key: str, cells: int = CELLS, parts: int = PARTS, codes: int = CODES, sample: int | None = None, rounds: int = 6) -> Centres:
    """Centres fitted on all whole rows, or on the first `sample` by a hash of the key where a caller asks for so few. There are as many cells as the square
    root of their number asks for, at most `cells`."""
    width = df.select(F.max(F.size(vector))).first()[0] or 0
    if width <= 0 or width % parts:
        raise ValueError(f"vectors of {width} dimensions do not fall into {parts} parts")
    order = F.xxhash64(key)
    x = whole(df, vector, width).select(order.alias("h"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    if sample is not None:
        x = x.orderBy("h", "key").limit(sample).repartition(max(1, min(sample // 4096, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    path = tables.scratch(df.sparkSession, "training")
    tables.spread(x).write.parquet(path)  # each round reads it once
    x = df.sparkSession.read.parquet(path)
    n = x.count()
    seeds = _matrix(x.orderBy("h", "key").limit(max(cells, codes)).select("v").toPandas()["v"], width)  # cells or codes rows
    if not n:
        raise ValueError("no whole vector to train on")
    some = max(1, min(cells, int(np.sqrt(n))))
    coarse = _rounds(x, width, seeds[None, :some], rounds)[0]
    out = Centres(coarse, np.zeros((parts, 1, width // parts)))
    residual = lambda v: v - coarse[out.cell_of(v)]
    first = residual(seeds)[:codes].reshape(-1, parts, width // parts).transpose(1, 0, 2).copy()
    fine = _rounds(x, width, first, rounds, residual)
    tables.drop(df.sparkSession, path)
    return Centres(coarse, fine)


def encoded(df: DataFrame, vector: str, key: str, centres: Centres) -> DataFrame:
    """key, cell, codes (a byte a part), v for every whole vector."""
    width = centres.cells.shape[1]
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for pdf in batches:
            x = _matrix(pdf["v"], width)
            cell = c.cell_of(x)
            pdf["cell"], pdf["codes"] = cell.astype(np.int32), [r.tobytes() for r in c.code_of(x, cell)]
            yield pdf

    rows = whole(df, vector, width).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInPandas(encode, "key long, v array<double>, cell int, codes binary")


def save(df: DataFrame, path: str, vector: str, key: str, centres: Centres, buckets: int = 16, files_a_cell: int = 1) -> int:
    """Writes the index as the next version of the tables at `path`."""
    spark = df.sparkSession
    stage = tables.scratch(spark, "encoded")
    encoded(df, vector, key, centres).write.parquet(stage)
    x = spark.read.parquet(stage)
    cell = F.pmod(F.xxhash64("key"), F.lit(files_a_cell))
    by_cell = x.repartition("cell", cell).sortWithinPartitions("cell", "key")
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    keys = x.select("key", "cell", bucket.alias("bucket")).repartition(buckets, "bucket").sortWithinPartitions("bucket", "key")
    flat = spark.createDataFrame([("cells", centres.cells.tobytes(), list(centres.cells.shape)), ("codes", centres.codes.tobytes(), list(centres.codes.shape))], "name string, raw binary, shape array<int>")
    out = tables.replace_all({"codes": (by_cell.select("key", "codes", "cell"), ["cell"]), "vectors": (by_cell.select("key", "v", "cell"), ["cell"]), "keys": (keys, ["bucket"]), "centres": (flat.coalesce(1), [])}, path)
    tables.drop(spark, stage)
    return out


class Index:
    """The current version of a saved index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.at = spark, tables.at(spark, path)
        flat = {r["name"]: np.frombuffer(r["raw"], dtype=np.float64).reshape(r["shape"]) for r in spark.read.parquet(f"{self.at}/centres").collect()}
        self.centres = Centres(flat["cells"], flat["codes"])
        self.codes, self.vectors, self.keys = (spark.read.parquet(f"{self.at}/{name}") for name in ("codes", "vectors", "keys"))

    def get(self, key: int) -> DataFrame:
        """The vector of one key: its bucket tells the cell, and the cell's files are read for the key alone."""
        buckets = self.keys.select(F.max("bucket")).first()[0] + 1  # partition values, no file is read
        bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(key).cast("long")), F.lit(buckets))).first()[0]
        r = self.keys.filter((F.col("bucket") == bucket) & (F.col("key") == key)).select("cell").first()
        return self.vectors.filter((F.col("cell") == (r["cell"] if r else -1)) & (F.col("key") == key)).select("key", "v")

    def probes(self, queries: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each query."""
        return probed(self.centres.cells, queries, n)

    def search(self, queries: DataFrame, key: str, vector: str, k: int, nprobe: int = 8, rerank: int = 100) -> DataFrame:
        """q, id, distance, rank: the k nearest of each row of a stated query set, among the `rerank` best by code of its `nprobe` nearest cells."""
        width = self.centres.cells.shape[1]
        q = whole(queries, vector, width).select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("qv"))
        blocks = max(1, -(-q.count() // BLOCK))
        out = None
        for i in range(blocks):
            own = q.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()  # a block of queries
            ids, x = np.array([r.q for r in own], dtype=np.int64), np.array([r.qv for r in own]).reshape(-1, width)
            near = self._candidates(ids, x, self.probes(x, nprobe), rerank)
            near = near.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("near", "id"))).filter(F.col("place") <= rerank).select("q", F.col("id").alias("key"), "cell")
            cells = sorted(set(self.probes(x, nprobe).ravel().tolist()))
            asked = self.spark.createDataFrame([(r.q, r.qv) for r in own], "q long, qv array<double>")
            exact = near.join(self.vectors.filter(F.col("cell").isin(cells)), ["cell", "key"]).join(F.broadcast(asked), "q")  # a block of queries
            exact = exact.select("q", F.col("key").alias("id"), distance(F.col("v"), F.col("qv")).alias("distance"))
            ranked = exact.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("distance", "id"))).filter(F.col("rank") <= k)
            out = ranked if out is None else out.union(ranked)
        return out

    def _candidates(self, ids: np.ndarray, x: np.ndarray, probes: np.ndarray, rerank: int) -> DataFrame:
        """q, id, cell, near: by codes, the best rows of each task."""
        shared = self.spark.sparkContext.broadcast((self.centres, ids, x, {int(c): np.flatnonzero((probes == c).any(axis=1)) for c in np.unique(probes)}))
        parts = self.centres.parts

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres, ids, x, asked = shared.value
            found: dict[int, list[tuple[np.ndarray, ...]]] = {}
            for pdf in batches:
                for cell, rows in pdf.groupby("cell"):
                    codes = np.frombuffer(b"".join(rows["codes"]), dtype=np.uint8).reshape(-1, parts)
                    keys, own = rows["key"].to_numpy(), asked.get(int(cell), ())
                    for q in own:
                        residual = (x[q] - centres.cells[cell]).reshape(parts, 1, -1)
                        table = ((centres.codes - residual) ** 2).sum(axis=2)
                        near = table[np.arange(parts), codes].sum(axis=1)
                        held = found.setdefault(int(q), [])
                        held.append((near, keys, np.full(len(near), cell)))
                        if sum(len(h[0]) for h in held) > 4 * rerank:
                            found[int(q)] = [best(held)]
            for q, held in found.items():
                near, keys, cell = best(held)
                yield pd.DataFrame({"q": ids[q], "id": keys, "cell": cell.astype(np.int32), "near": near})

        def best(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            near, keys, cell = (np.concatenate(h) for h in zip(*held, strict=True))
            at = np.lexsort((keys, near))[:rerank]
            return near[at], keys[at], cell[at]

        cells = np.unique(probes).tolist()
        rows = self.codes.filter(F.col("cell").isin(cells))  # folders of other cells are not listed
        return rows.mapInPandas(scan, "q long, id long, cell int, near double")

    def share_read(self, queries: DataFrame, vector: str, nprobe: int) -> float:
        """Mean share of the rows whose codes a query reads, over all queries."""
        sizes = {r["cell"]: r["count"] for r in self.codes.groupBy("cell").count().collect()}  # a row a cell
        cells = self.centres.cells
        shared = self.spark.sparkContext.broadcast((cells, np.array([sizes.get(c, 0) for c in range(len(cells))], dtype=np.int64)))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres, rows = shared.value
            for pdf in batches:
                yield pd.DataFrame({"n": [len(pdf)], "rows": [rows[probed(centres, _matrix(pdf["v"], centres.shape[1]), nprobe)].sum()]})

        q = whole(queries, vector, cells.shape[1]).select(F.col(vector).cast("array<double>").alias("v"))
        r = q.mapInPandas(count, "n long, rows long").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).first()
        return r["rows"] / (r["n"] * max(1, sum(sizes.values()))) if r["n"] else 0.0
