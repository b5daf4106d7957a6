"""What the training-data operators share: word rules, scratch tables, size-checked joins."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that may be broadcast: of 16 to 40 bytes each, so 64 MB at most.
BROADCAST_ROWS = 1_500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="quarry-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", found)
    return found


_made: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def clear(spark: SparkSession) -> None:
    """Deletes all scratch tables that this process made. Results that were not written elsewhere go with them."""
    for path in list(_made):
        drop_path(spark, path)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, lost executors cost no recomputation. The shuffle files of the write go
    when it is done; otherwise those of all steps lie on disk until the driver's next garbage collection."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no result reads any longer."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    _made.discard(path)


def drop_table(df: DataFrame) -> None:
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, next((p for p in _made if path.endswith(p.partition(":")[2] or p)), path))


class Scratch:
    """Scratch tables of one run of an operator, dropped as soon as nothing reads them any longer."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        out = materialize(df, name, path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table))
            drop_path(self.spark, path)

    def close(self) -> None:
        self.drop(*[table for table, _ in self.paths.values()])


def merged(tables: DataFrame, add, tasks: int, fan: int = 32) -> DataFrame:  # noqa: ANN001
    """Tables cut into slices, one set a task (slice, part, raw), as one row a slice: add turns a list of raws into one. Merged in a
    tree, so no worker holds more than some `fan` slices."""
    def into(n: int):  # noqa: ANN202
        def join(pdf):  # noqa: ANN001, ANN202
            import pandas as pd

            return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "part": pdf["part"].iloc[:1] % n, "raw": [add(pdf["raw"].tolist())]})

        return join

    while tasks > 1:
        tasks = -(-tasks // fan)
        tables = tables.groupBy("slice", F.pmod("part", F.lit(tasks))).applyInPandas(into(tasks), "slice int, part int, raw binary")
    return tables


def small_join(big: DataFrame, small: DataFrame, on, how: str, rows: int) -> DataFrame:
    """Broadcasts `small` only if its counted rows fit; otherwise a shuffled join, which adaptive execution splits when skewed."""
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def documents_but(df: DataFrame, *names: str) -> Column:
    """All columns of df but these, as one struct."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in names])


def hot_join(big: DataFrame, small: DataFrame, on: list[str], size: str, rows: int) -> DataFrame:
    """big left-joined to small, one row a key, whose column `size` tells how many rows of big have the key. Keys with many rows, a million at
    most, are broadcast, so none of them lands in one task; the others are shuffled."""
    hot = max(10_000, -(-rows // 1_000_000))
    x = big.join(F.broadcast(small.filter(F.col(size) > hot)), on, "left")
    added = [c for c in small.columns if c not in on]
    rest = x.filter(F.col(size).isNull()).drop(*added).join(small.filter(F.col(size) <= hot), on, "left")
    return x.filter(F.col(size).isNotNull()).unionByName(rest)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Words without keeping them: white-space runs inside the trimmed text, plus one."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body) -> Column:
    """Binds value to a lambda variable, so that body may use it often and it is computed once."""
    return F.transform(F.array(value), body)[0]


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for what is run inside."""
    was = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def small_batches(spark: SparkSession, size: int = 4_000_000) -> contextlib.AbstractContextManager[None]:
    """Arrow batches of few enough bytes that a Python worker holds little, however long texts are; for what is run inside."""
    return setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(size))
