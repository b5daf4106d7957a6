"""Incremental sync: classification of incoming rows, upsert, purge, high-water marks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import tables


def newer(a: Column, b: Column, millis: int = 1000) -> Column:
    """a is later than b by more than `millis`; a null on either side counts as newer."""
    diff = F.unix_millis(a.cast("timestamp")) - F.unix_millis(b.cast("timestamp"))
    return F.coalesce(diff > millis, F.lit(True))


def classify(incoming: DataFrame, stored: DataFrame, key: str, ts: str, excluded: Column) -> DataFrame:
    """incoming with _action: excluded, added, updated or unchanged. stored: one row a key."""
    old = stored.select(key, F.col(ts).alias("_old"), F.lit(True).alias("_known"))
    x = incoming.withColumn("_excluded", F.coalesce(excluded, F.lit(False))).join(old, key, "left")
    action = F.when(F.col("_excluded"), "excluded").when(F.col("_known").isNull(), "added").when(newer(F.col(ts), F.col("_old")), "updated").otherwise("unchanged")
    return x.withColumn("_action", action).drop("_old", "_known", "_excluded")


def upsert(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """All stored rows of the incoming keys go, then the incoming rows come."""
    return stored.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def high_water(jobs: DataFrame, finished: str, back_seconds: int = 1) -> DataFrame:
    return jobs.agg((F.max(finished) - F.expr(f"INTERVAL '{back_seconds}' SECOND")).alias("since"))


def worst(severity: Column) -> Column:
    """Roll-up of ok, warning, critical."""
    order = F.when(severity == "critical", 2).when(severity == "warning", 1).otherwise(0)
    return F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("critical")), F.max(order) + 1)


def purge(spark: SparkSession, path: str, excluded: Column) -> int:
    """Deletes the stored rows that the exclusion rules now match; how many went."""
    before = tables.current(spark, path).count()
    tables.delete(spark, path, excluded)
    return before - tables.current(spark, path).count()


class Progress:
    """Which batches of a long sync are done, in a versioned table: a run that was broken off goes on after the last batch that finished."""

    SCHEMA = "batch string, n bigint, finished timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def done(self) -> set[str]:
        return set() if tables.version(self.spark, self.path) is None else {r["batch"] for r in tables.current(self.spark, self.path).select("batch").collect()}

    def finish(self, batch: str, n: int) -> None:
        row = self.spark.createDataFrame([(batch, n, None)], self.SCHEMA).withColumn("finished", F.current_timestamp())
        tables.append_version(row, self.path)

    def run(self, batches: Iterable[tuple[str, DataFrame]], apply: Callable[[DataFrame], None]) -> list[str]:
        """Applies what is not done yet; the names of the batches it applied. apply must be repeatable, for a batch whose end was not noted."""
        was, now = self.done(), []
        for name, rows in batches:
            if name not in was:
                apply(rows)
                self.finish(name, rows.count())
                now.append(name)
        return now


def sampled(df: DataFrame, ts: str, seconds: int, order: str, by: list[str]) -> DataFrame:
    """by, slot, and the last row of each slot of so many seconds: what a sampler that looks every so often has seen."""
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds)
    x = df.withColumn("slot", slot.cast("timestamp_ntz"))
    rest = [c for c in df.columns if c not in by]
    return x.groupBy(*by, "slot").agg(F.max_by(F.struct(*rest), F.struct(ts, order)).alias("r")).select(*by, "slot", "r.*")


def append_message(messages: DataFrame, new: DataFrame, key: str, turn: str) -> DataFrame:
    """messages with the new ones at the end of their conversations, in the order of the new rows' own turns; conversations may be new."""
    last = messages.groupBy(key).agg((F.max(turn) + 1).alias("next"))
    moved = new.join(last, key, "left").withColumn(turn, F.col(turn) + F.coalesce("next", F.lit(0))).drop("next")
    return messages.unionByName(moved.select(*messages.columns))
