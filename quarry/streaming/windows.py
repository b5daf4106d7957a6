"""Event-time windows, sessions and upserts on streams; each is the same expression as in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.incremental import classify, upsert
from quarry.sources import tables


def windowed(df: DataFrame, ts: str, size: str, slide: str | None = None, late: str | None = None, bad: str = "event_type = 'error'") -> DataFrame:
    """n, error count and mean of `value` in tumbling or sliding windows. With `late`, a stream's state is bounded by a watermark."""
    x = df.withWatermark(ts, late) if late and df.isStreaming else df
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return x.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr(bad)).alias("errors"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "errors", "mean")


def sessions(df: DataFrame, ts: str, user: str, gap: str, late: str | None = None) -> DataFrame:
    x = df.withWatermark(ts, late) if late and df.isStreaming else df
    return x.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(df: DataFrame, ts: str, key: str, late: str) -> DataFrame:
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def upsert_batches(stream: DataFrame, path: str, key: str, checkpoint: str):  # noqa: ANN201
    """A stream whose micro-batches replace the rows of their keys in a parquet table; versions are written beside each other, so a repeated batch
    gives the same table."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        source = f"{path}/v{number}"
        old = spark.read.schema(batch.schema).parquet(source) if number else spark.createDataFrame([], batch.schema)
        last = batch.dropDuplicates([key])
        upsert(old, last, key).write.mode("overwrite").parquet(f"{path}/v{number + 1}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def synced(stream: DataFrame, path: str, key: str, ts: str, checkpoint: str, excluded: Column | None = None):  # noqa: ANN201
    """A stream of changed rows that keeps a versioned table up to date: of a batch the last change of each key is classified, what is added or updated
    takes the place of the key's rows, and what is excluded now goes. The table and the log of batches (batch, action, n) change in one version,
    so a batch that is run again after a failure is seen to be done."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = tables.version(spark, path) is not None
        at = tables.at(spark, path) if known else ""
        log = spark.read.parquet(f"{at}/log") if known else spark.createDataFrame([], "batch long, action string, n long")
        if log.filter(F.col("batch") >= number).limit(1).count():
            return
        stored = spark.read.schema(batch.schema).parquet(f"{at}/rows") if known else spark.createDataFrame([], batch.schema)
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), ts).alias("r")).select("r.*")
        stage = tables.scratch(spark, "changes")
        classify(last, stored.groupBy(key).agg(F.max(ts).alias(ts)), key, ts, excluded if excluded is not None else F.lit(False)).write.parquet(stage)
        x = spark.read.parquet(stage)
        changed = x.filter(F.col("_action").isin("added", "updated")).drop("_action")
        kept = stored.join(x.filter(F.col("_action") == "excluded").select(key), key, "left_anti")
        done = x.groupBy(F.col("_action").alias("action")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(number).cast("long").alias("batch"), "action", "n")
        tables.replace_all({"rows": (upsert(kept, changed, key), []), "log": (log.union(done).coalesce(1), [])}, path)
        tables.drop(spark, stage)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
