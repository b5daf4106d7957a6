"""Mixing sources to target weights.

Every row gets a hash-random key. Within its source, rows are ordered by that key; since keys are uniform, key ranges of equal
width (blocks) are an exact range partition that needs no sampling. Running sums inside each block plus the sums of the blocks
before give each row's prefix sum, and the mix is cut at the source's budget: whole epochs, then the head of the order, with
the row at the cut taken in part. A source with a third of all rows is spread over as many blocks as any other share of rows.

Null or word-less texts have size 0 and nothing taken; a null source is a source of its own, last in order. Rows with one id
are ordered by it alone and share its key, so repeated rows may swap places but take the same in sum. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialize, n_words_of, text_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size -> source, source_size, target. One row per source, so its windows are over sources, not rows.

    A source is full (target = max_epochs * size) exactly if, at the level that fills it, all sources together take less than
    the total. All comparisons are in integers, so both engines agree."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("decimal(38,0)")
    x = sizes.withColumn("w", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("decimal(38,0)"))
    whole = W.partitionBy()
    upto = W.orderBy(F.col("cap") / F.col("w")).rangeBetween(W.unboundedPreceding, 0)
    x = x.withColumns({"total": F.sum("source_size").over(whole), "all_w": F.sum("w").over(whole), "caps": F.sum("cap").over(upto), "ws": F.sum("w").over(upto)})
    full = (F.col("w") * F.col("caps") + F.col("cap") * (F.col("all_w") - F.col("ws"))) <= F.col("total") * F.col("w")
    x = x.withColumn("full", full)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
    free = F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)
    share = (left * F.col("w")).cast("double") / free.cast("double")
    return x.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, rows_per_block: int = 20_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, and the columns to carry."""
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))), 1, 12), 16, 10).cast("long")
    # The marker keeps a null source apart from every text in equality joins.
    name = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), name.alias("name"), size.alias("size"), key.alias("key"), *[F.col(c).alias(f"_{c}") for c in carry])
    # Sizes are worth keeping; whole texts are rather read again.
    rows = rows if carry else materialize(rows, "mix-sizes")
    per_source = materialize(rows.groupBy("name").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    most = per_source.agg(F.max("n")).first()[0] or 1
    blocks = max(64, math.ceil(most / rows_per_block))
    targets = source_targets(per_source.select("source", "source_size"), weights, max_epochs)
    targets = targets.withColumn("name", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))).drop("source")

    rows = rows.withColumn("block", F.floor(F.col("key") * F.lit(blocks) / F.lit(1 << 48)).cast("int"))
    before = W.partitionBy("name").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("name", "block").agg(F.sum("size").alias("block_size"))
    sums = sums.withColumn("before", F.coalesce(F.sum("block_size").over(before), F.lit(0))).join(targets, "name").drop("block_size")
    inside = W.partitionBy("name", "block").orderBy("key", "id").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["name", "block"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("inside")))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *[F.col(f"_{c}").alias(c) for c in carry])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, documents(spark, sf_dir), n_words_of(text_of())).drop("source")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5('mix-1:' || CAST(doc_id AS VARCHAR)), 1, 12) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w, 3 * source_size AS cap,
         sum(source_size) OVER () AS total FROM s),
v AS (
  SELECT *, sum(w) OVER () AS all_w, sum(cap) OVER r AS caps, sum(w) OVER r AS ws
  FROM w WINDOW r AS (ORDER BY cap / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT *, w * caps + cap * (all_w - ws) <= total * w AS is_full FROM v),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(cap AS DOUBLE)
              ELSE CAST((total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) * w AS DOUBLE)
                   / CAST(sum(CASE WHEN NOT is_full THEN w END) OVER () AS DOUBLE) END AS target
  FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS taken
FROM p
"""
