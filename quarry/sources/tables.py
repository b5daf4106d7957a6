"""Tables as folders of parquet: read, page, append, delete, replace, back up; and other file formats.

A versioned table is a folder of immutable versions, each under a name of its own, and a small file for each version number that names its
folder. Writers write a folder first and then claim the next number by one rename that fails if the number is taken: a reader or a crash sees
the old table or the new one, and of two writers with one base the second is told (Conflict), so it can read again and go on.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POINTER = "_version-"


class Conflict(RuntimeError):
    """Another writer has replaced the version that a change was based on."""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors can write; a local session without a checkpoint folder gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quarry-tables/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path, and the path in it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def load(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None, merge_schemas: bool = False) -> DataFrame:
    """A scan; filter and columns reach the files. Schemas of all files are merged only if asked for: that opens every one."""
    x = spark.read.option("mergeSchema", str(merge_schemas).lower()).parquet(path)
    x = x if where is None else x.filter(where)
    return x.select(*columns) if columns else x


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt out to all of them; a scan of more stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.rdd().getNumPartitions() < cores else scan


def page(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    return df.orderBy(key).offset(offset).limit(limit)


def after(df: DataFrame, key: str, cursor: object, limit: int) -> DataFrame:
    """Keyset paging: limit + 1 rows tell whether there are more."""
    x = df if cursor is None else df.filter(F.col(key) > F.lit(cursor))
    return x.orderBy(key).limit(limit + 1)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _files(spark, path)
    if not fs.exists(folder):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    return sorted(int(n.removeprefix(POINTER)) for n in names if n.startswith(POINTER) and n.removeprefix(POINTER).isdigit())


def version(spark: SparkSession, path: str) -> int | None:
    """The number of the current version; None for a table that does not exist."""
    return max(_versions(spark, path), default=None)


def _folder(spark: SparkSession, path: str, number: int) -> str:
    fs, pointer = _files(spark, f"{path}/{POINTER}{number}")
    stream = fs.open(pointer)
    try:
        return f"{path}/{spark._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def at(spark: SparkSession, path: str) -> str:
    """The folder of the current version."""
    return _folder(spark, path, version(spark, path))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a versioned table."""
    return spark.read.parquet(at(spark, path))


def replace(df: DataFrame, path: str, keep: int = 2) -> int:
    """Writes the next version and points to it; versions older than the last `keep` are deleted. df may read the table itself."""
    return replace_all({"": (df, [])}, path, keep)


def replace_all(parts: dict[str, tuple[DataFrame | Callable[[str], DataFrame], list[str]]], path: str, keep: int = 2) -> int:
    """The same for several tables that change together: name in the version -> rows and the columns to partition by. Rows may be a function of
    the version's folder, for what is made from a table written before it."""
    spark = next(df.sparkSession for df, _ in parts.values() if isinstance(df, DataFrame))
    was = version(spark, path)
    now, own = 0 if was is None else was + 1, f"v-{uuid.uuid4().hex}"
    for name, (df, by) in parts.items():
        rows = df if isinstance(df, DataFrame) else df(f"{path}/{own}")
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{own}/{name}".rstrip("/"))
    fs, fresh = _files(spark, f"{path}/_new-{own}")
    stream = fs.create(fresh)
    stream.write(bytearray(own, "ascii"))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fresh, _files(spark, f"{path}/{POINTER}{now}")[1], spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        for gone in (f"{path}/_new-{own}", f"{path}/{own}"):
            drop(spark, gone)
        if version(spark, path) != was:
            raise Conflict(f"version {now} of {path} was written meanwhile") from e
        raise
    for old in _versions(spark, path):
        if old <= now - keep:
            gone = _folder(spark, path, old)
            drop(spark, f"{path}/{POINTER}{old}")
            drop(spark, gone)
    return now


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it is there."""
    fs, gone = _files(spark, path)
    fs.delete(gone, True)


def append_version(df: DataFrame, path: str) -> int:
    """Adds rows to a versioned table, as a version."""
    was = version(df.sparkSession, path)
    return replace(df if was is None else current(df.sparkSession, path).unionByName(df, allowMissingColumns=True), path)


def delete(spark: SparkSession, path: str, where: Column) -> int:
    """Deletes the rows of a versioned table for which `where` is true (not those for which it is null)."""
    return replace(current(spark, path).filter(~F.coalesce(where, F.lit(False))), path)


def backup(df: DataFrame, root: str, stamp: str, limit: int | None = None) -> str:
    path = f"{root}/backup-{stamp}"
    (df.limit(limit) if limit else df).write.mode("overwrite").parquet(path)
    return path


def backups(spark: SparkSession, root: str) -> list[str]:
    """Stamps of the finished backups, the newest first."""
    fs, folder = _files(spark, root)
    if not fs.exists(folder):
        return []
    found = [f.getPath().getName() for f in fs.listStatus(folder)]
    done = [n for n in found if n.startswith("backup-") and fs.exists(_files(spark, f"{root}/{n}/_SUCCESS")[1])]
    return sorted((n.removeprefix("backup-") for n in done), reverse=True)


def prune(spark: SparkSession, root: str, keep: int = 30) -> list[str]:
    """Deletes all but the newest `keep` backups; the stamps that went."""
    gone = backups(spark, root)[keep:]
    for stamp in gone:
        fs, path = _files(spark, f"{root}/backup-{stamp}")
        fs.delete(path, True)
    return gone


def restore(spark: SparkSession, root: str, path: str, stamp: str | None = None) -> int:
    """Makes a backup (the newest, or the one with the stamp) the current version of a table."""
    return replace(spark.read.parquet(f"{root}/backup-{stamp or backups(spark, root)[0]}"), path)


def retained(taken: DataFrame, at: str, keep: int = 30) -> DataFrame:
    """Of a list of backups, with whether each is kept: the newest `keep`."""
    return taken.withColumn("kept", F.row_number().over(W.orderBy(F.desc(at))) <= keep)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_files(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """Any files, for a decoder UDF."""
    return spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path)


def markdown_tables(rows: DataFrame, sheet: str, number: str, cells: str) -> DataFrame:
    """sheet, markdown: the rows (an array of cells each) of a sheet as one table. Blank rows go, the first that is left is the header, pipes are
    escaped, nulls are empty, short rows are filled up."""
    filled = F.transform(cells, lambda c: F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")))
    x = rows.select(sheet, number, filled.alias("c")).filter(F.exists("c", lambda v: v != ""))
    x = x.groupBy(sheet).agg(F.max(F.size("c")).alias("w"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("i"), "c"))), lambda r: r["c"]).alias("r"))
    lines = F.transform("r", lambda c: F.concat(F.lit("| "), F.array_join(F.concat(c, F.array_repeat(F.lit(""), F.col("w") - F.size(c))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("w")))
    whole = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.size("r")))
    return x.select(sheet, F.array_join(whole, "\n").alias("markdown"))
