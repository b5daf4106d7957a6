"""Comparing searches: threshold grids, methods, snapshots of vectors, types of keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def f1_of(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def threshold_grid(found: DataFrame, distance: str, hit: str, relevant: DataFrame, cuts: Sequence[float], qualities: Sequence[float]) -> DataFrame:
    """cut, quality, kept (within the distance threshold), good (within the quality threshold), hits, precision, recall, f1, and best: the first cell
    with the highest F1. Cells whose quality is above the distance are skipped. relevant: one row with the number of relevant rows."""
    cells = [F.struct(F.lit(c).alias("cut"), F.lit(q).alias("quality")) for c in cuts for q in qualities if q <= c]
    d, near = F.col(distance), F.col(distance) <= F.col("cut")
    m = found.select(distance, hit, F.inline(F.array(*cells))).groupBy("cut", "quality").agg(F.count_if(near).alias("kept"), F.count_if(d <= F.col("quality")).alias("good"), F.count_if(near & F.col(hit)).alias("hits"))
    x = m.crossJoin(F.broadcast(relevant.toDF("relevant")))  # one row
    share = lambda of: F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col(of)), F.lit(0.0))
    x = x.withColumns({"precision": share("kept"), "recall": share("relevant")})
    x = x.withColumn("f1", F.round(f1_of(F.col("precision"), F.col("recall")), 9))
    return x.withColumn("best", F.row_number().over(W.orderBy(F.desc("f1"), "cut", "quality")) == 1)  # a row a cell


def f1_by_method(found: dict[str, DataFrame], relevant: DataFrame, key: str) -> DataFrame:
    """One row: the F1 of each method's results. relevant: key and a boolean of the same name, for every row there is."""
    all_ = relevant.agg(F.count_if("relevant").alias("all"))
    each = reduce(DataFrame.union, [x.select(F.lit(name).alias("method"), key) for name, x in found.items()])
    n = each.join(relevant, key, "left").groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if("relevant").alias("hits"))
    f1 = n.crossJoin(F.broadcast(all_)).select("method", F.try_divide(2.0 * F.col("hits"), F.col("n") + F.col("all")).alias("f1"))  # one row
    return f1.agg(*[F.max(F.when(F.col("method") == name, F.col("f1"))).alias(name) for name in found])


def vector_diff(before: DataFrame, after: DataFrame, key: str, vector: str, tolerance: float = 1e-4) -> DataFrame:
    """key, state (same, changed, added, removed), max_diff and mean_diff of the elements. Vectors of different lengths are changed, without diffs."""
    d = lambda c: F.col(c).cast("array<double>")
    x = before.select(key, d(vector).alias("a")).join(after.select(key, d(vector).alias("b")), key, "full_outer")
    diff = F.when(F.size("a") == F.size("b"), F.zip_with("a", "b", lambda p, q: F.abs(p - q)))
    x = x.withColumn("diff", diff)
    x = x.withColumns({"max_diff": F.array_max("diff"), "mean_diff": F.aggregate("diff", F.lit(0.0), lambda s, v: s + v) / F.size("diff")})
    state = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.coalesce(F.col("max_diff") < tolerance, F.lit(False)), "same").otherwise("changed")
    return x.select(key, state.alias("state"), "max_diff", "mean_diff")


def runtime_types(df: DataFrame, column: str) -> DataFrame:
    """kind, n: the types that the values of a column of JSON scalars have."""
    v = F.trim(column)
    kind = F.when(v.isNull() | (v == "null"), "null").when(v.rlike('^".*"$'), "string").when(v.isin("true", "false"), "boolean").when(v.startswith("{"), "object").when(v.startswith("["), "array").otherwise("number")
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
