"""Exact duplicates by a Golomb-coded exchange of fingerprints.

1. Every scan partition (a sender) hashes its texts to ``b`` bits, where ``b`` grows with the logarithm of the number of
   rows, and sends each owner of a hash range the sorted distinct hashes as Golomb-coded gaps (about 14 bits a hash).
2. An owner decodes what it received, and answers each sender with a bitmap: which of its hashes occur more than once.
3. Only rows whose bit is set (suspects) have their whole texts shuffled, pre-aggregated by the text itself, so equal
   means equal bytes and a hot group costs one row per map task.

Null texts count as empty. Repeated rows with one id are counted as rows; all rows with the id that stays are kept. A null id
is below every other; if all ids of a group are null, its rows are kept. An empty table gives an empty result. Columns other
than id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, hot_join, materialize, small_join, text_of


def golomb_encode(values: np.ndarray, universe: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct values in [0, universe) as gaps, with a power of two as the Golomb parameter: quotients in unary and
    remainders in binary, as two bit streams."""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(-1)) - 1
    k = max(0, int(math.log2(max(1.0, 0.69 * universe / max(1, len(values))))))
    quotient = gaps >> k
    ends = np.cumsum(quotient + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    unary[ends - 1] = 0
    low = (gaps[:, None] >> np.arange(k, dtype=np.int64)) & 1
    return k, np.packbits(unary).tobytes(), np.packbits(low.astype(np.uint8)).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, low: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(unary, dtype=np.uint8))
    quotient = np.diff(np.flatnonzero(bits == 0)[:n], prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(low, dtype=np.uint8))[: n * k].reshape(n, k).astype(np.int64)
    gaps = (quotient.astype(np.int64) << k) + (rest << np.arange(k, dtype=np.int64)).sum(axis=1)
    return np.cumsum(gaps + 1) - 1


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra_bits: int = 12, rows_per_owner: int = 100_000) -> DataFrame:
    """One row per input row: id, keep_id (largest id of the equal texts), group_size, kept, text_sha256 (binary)."""
    rows = docs.count()
    bits = min(62, math.ceil(math.log2(max(2, rows))) + extra_bits)
    owners = max(4, math.ceil(rows / rows_per_owner))
    width = -(-(1 << bits) // owners)
    hashed = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    fp = F.shiftrightunsigned(F.xxhash64("t"), 64 - bits)
    sent = materialize(hashed.select("id", fp.alias("fp"), F.unhex(F.sha2("t", 256)).alias("sha"), F.spark_partition_id().alias("sender")), "fingerprints")

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        own, counts = np.unique(pdf["fp"].to_numpy(), return_counts=True)
        out = []
        for owner in np.unique(own // width):
            lo, hi = np.searchsorted(own, [owner * width, (owner + 1) * width])
            k, unary, low = golomb_encode(own[lo:hi] - owner * width, width)
            out.append((int(owner), int(pdf["sender"].iloc[0]), hi - lo, k, unary, low, np.packbits(counts[lo:hi] > 1).tobytes()))
        return pd.DataFrame(out, columns=["owner", "sender", "n", "k", "unary", "low", "twice"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb_decode(*x) for x in zip(pdf["n"], pdf["k"], pdf["unary"], pdf["low"], strict=True)]
        twice = [np.unpackbits(np.frombuffer(b, dtype=np.uint8))[:n].astype(bool) for b, n in zip(pdf["twice"], pdf["n"], strict=True)]
        _, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        often = np.split((counts > 1)[inverse] | np.concatenate(twice), np.cumsum(pdf["n"])[:-1])
        return pdf[["owner", "sender", "n"]].assign(bitmap=[np.packbits(b).tobytes() for b in often])

    def look_up(mine: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
        own, inverse = np.unique(mine["fp"].to_numpy(), return_inverse=True)
        bitmaps = bitmaps.sort_values("owner")
        bits_ = [np.unpackbits(np.frombuffer(b, dtype=np.uint8))[:n] for b, n in zip(bitmaps["bitmap"], bitmaps["n"], strict=True)]
        return mine[["id", "fp", "sha"]].assign(suspect=np.concatenate(bits_).astype(bool)[inverse] if len(own) else False)

    coded = sent.select("sender", "fp").groupBy("sender").applyInPandas(encode, "owner long, sender int, n long, k int, unary binary, low binary, twice binary")
    bitmaps = coded.groupBy("owner").applyInPandas(answer, "owner long, sender int, n long, bitmap binary")
    found = materialize(sent.groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInPandas(look_up, "id long, fp long, sha binary, suspect boolean"), "suspects")

    again = found.filter("suspect").select("fp").distinct()
    n_again = again.count()
    texts = small_join(hashed.select("id", "t", fp.alias("fp")), again, "fp", "left_semi", n_again)
    groups = texts.groupBy("fp", "t").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = materialize(groups.select("fp", F.unhex(F.sha2("t", 256)).alias("sha"), "keep_id", "group_size"), "groups")
    # sha separates the rare unequal texts of one fingerprint; each (fp, sha) is one text here.
    joined = hot_join(found, groups, ["fp", "sha"], "group_size", rows)
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, documents(spark, sf_dir)).withColumn("text_sha256", F.lower(F.hex("text_sha256")))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
