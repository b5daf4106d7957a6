"""Quality scores by regularised quadratic discriminant analysis.

Inputs are transformed statistics of the text alone (the measurements of the rule ledger as shares, on a log scale). Labelled rows
are reduced to class sums, squares and products in one aggregation, so training moves two rows to the driver whatever the
number of labels. Class covariances are shrunk towards the pooled covariance and a multiple of the identity; their Cholesky factors
are inverted once and enter the scoring expression as literals: score = logistic(log density difference + log prior odds).

Null texts count as empty and get a score. Labels other than 0 or 1 and labels without a document are left out. If a class has no
label, every score is the share of label 1 (0.5 without labels). An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize
from .quality_rules import MEASURES, ledger


def _share(part: str, whole: str) -> Column:
    return F.log1p(100.0 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))


def features() -> dict[str, Column]:
    return {
        "x_words": F.log1p(F.col("n_words").cast("double")),
        "x_length": F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
        "x_symbols": _share("n_symbols", "n_words"),
        "x_lines": _share("n_lines", "n_words"),
        "x_dup_lines": _share("n_dup_lines", "n_lines"),
        "x_repeats": _share("n_repeat_words", "n_words"),
        "x_upper": _share("n_upper", "word_chars"),
        "x_bangs": _share("n_bangs", "n_words"),
    }


@dataclass
class Discriminant:
    names: list[str]
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    """Inverted Cholesky factors of the class covariances."""
    offset: float
    """Log prior odds plus the difference of the log determinants."""
    constant: float | None = None

    def log_odds(self) -> Column:
        def distance(k: int) -> Column:
            total = F.lit(0.0)
            for i in range(len(self.names)):
                z = F.lit(0.0)
                for j in range(i + 1):
                    z = z + F.lit(float(self.inverses[k][i, j])) * (F.col(self.names[j]) - F.lit(float(self.means[k][j])))
                total = total + z * z
            return total

        return F.lit(0.5) * (distance(0) - distance(1)) + F.lit(self.offset)

    def score(self) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        odds = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), self.log_odds()))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(rows: DataFrame, label: str, names: list[str], to_pooled: float = 0.1, to_identity: float = 0.01) -> Discriminant:
    """rows: a label of 0 or 1 and the features. One aggregation of sums, then small matrices on the driver."""
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(n).alias(f"s{i}") for i, n in enumerate(names)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs]
    got = {r[label]: r for r in rows.filter(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    n = [got[k]["n"] if k in got else 0 for k in (0, 1)]
    if min(n) == 0:
        return Discriminant(names, [], [], 0.0, n[1] / sum(n) if sum(n) else 0.5)
    means, covs = [], []
    for k in (0, 1):
        mu = np.array([got[k][f"s{i}"] for i in range(d)]) / n[k]
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = got[k][f"p{i}_{j}"] / n[k]
        means.append(mu)
        covs.append(second - np.outer(mu, mu))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    ridge = np.eye(d) * max(np.trace(pooled) / d, 1e-6)
    factors = [np.linalg.cholesky((1 - to_pooled - to_identity) * c + to_pooled * pooled + to_identity * ridge) for c in covs]
    logdet = [2 * np.log(np.diag(f)).sum() for f in factors]
    return Discriminant(names, means, [np.linalg.inv(f) for f in factors], math.log(n[1] / n[0]) + 0.5 * (logdet[0] - logdet[1]))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    measured = ledger(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), *MEASURES)
    x = materialize(measured.select("doc_id", "held_out", *[c.alias(n) for n, c in features().items()]), "features")
    names = list(features())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").filter(F.col("quality").isin(0, 1))
    model = fit(labels.join(x.filter(~F.col("held_out")), "doc_id"), "quality", names)
    x = x.withColumn("score", model.score())
    return x.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
