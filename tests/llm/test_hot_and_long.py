"""Passages that a third of all documents share, very long texts, and many tasks, against brute force."""

import glob
import hashlib
import random
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import bytes_left, frame, jaccard, mixed, words_left

from quarry.llm import common, exact_dedup, mixing, ngram_join, packing, pii, repeats, substring_dedup, suffix_dedup


@pytest.fixture(scope="module")
def hot():
    """A passage in each third document, with other words around it each time, and three texts of 20,000 words that share long stretches."""
    r = random.Random(12)
    passage = " ".join(r.choices([f"p{i}" for i in range(90)], k=70))
    texts = [" ".join([*r.choices([f"w{i}" for i in range(900)], k=r.randint(5, 60)), *([passage] if i % 3 == 0 else []), *r.choices([f"w{i}" for i in range(900)], k=r.randint(0, 30))]) for i in range(240)]
    long = " ".join(r.choices([f"q{i}" for i in range(4000)], k=20_000))
    return [*texts, long, long[30_000:90_000] + " " + texts[0], "é😀 " * 20_000, long]


def test_hot_passages_in_bytes_and_words(spark, hot, monkeypatch):
    df = frame(spark, hot).repartition(6)
    for rows in (repeats.BIT_ROWS, 0):
        monkeypatch.setattr(repeats, "BIT_ROWS", rows)
        index = substring_dedup.FingerprintIndex(spark, common.new_path(spark, "index"), buckets=3, fan_in=2)
        ranges = index.add(df.filter("doc_id < 100")).union(index.add(df.filter("doc_id >= 100")))
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.removed_words(df, ranges).collect()}
        index.close(delete=True)
        assert got == words_left(hot)
    monkeypatch.undo()
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.removed_bytes(df, suffix_dedup.repeated_bytes(spark, df)).collect()}
    assert got == bytes_left(hot)


@pytest.mark.parametrize("bit_rows", [None, 0])
def test_hot_shingles_link_no_more_and_no_less(spark, hot, monkeypatch, bit_rows):
    if bit_rows is not None:
        monkeypatch.setattr(ngram_join, "BIT_ROWS", bit_rows)
    own = [*hot[:120], *[hot[0] + f" z{i}" for i in range(40)], hot[-1], hot[-1] + " end"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark, frame(spark, own).repartition(5), width=3, percent=90).collect()}
    assert got == jaccard(own, 3, 90)


def test_long_texts_in_the_other_operators(spark, hot):
    df = frame(spark, hot).repartition(5)
    kept = {r.doc_id: (r.keep_id, r.text_sha256) for r in exact_dedup.exact_dedup(spark, df, rows_per_owner=30).collect()}
    n = len(hot)
    assert kept[n - 4] == (n - 1, hashlib.sha256(hot[-1].encode()).digest()) and kept[n - 2][0] == n - 2
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = mixing.mix(spark, df, size, rows_per_block=20).collect()
    assert {r.doc_id: r.taken for r in rows} == mixed([(r.doc_id, r.source, r["size"]) for r in rows]) and max(r["size"] for r in rows) == 20_000
    pieces = packing.pack(spark, df).collect()
    assert {r.doc_id: sum(p.length for p in pieces if p.doc_id == r.doc_id) for r in pieces} == {r.doc_id: r.doc_tokens for r in pieces}
    secret = spark.createDataFrame([(1, "word " * 20_000 + "a.b7@mail.example.com" + " word" * 10)], "doc_id long, text string")
    out = pii.pseudonymise(secret, "k").first().text
    assert len(out) == len(secret.first().text) and "a.b7@mail.example.com" not in out and out.startswith("word word")


def test_tables_of_many_tasks_are_merged_in_a_tree(spark):
    rows = [(s, p, np.full(3, p * (s + 1), dtype=np.int64).tobytes()) for s in range(2) for p in range(70)]
    df = spark.createDataFrame(rows, "slice int, part int, raw binary").repartition(40)
    add = lambda raws: np.sum([np.frombuffer(x, dtype=np.int64) for x in raws], axis=0).tobytes()
    got = {r.slice: np.frombuffer(r.raw, dtype=np.int64).tolist() for r in common.merged(df, add, 70, fan=4).collect()}
    assert got == {s: [sum(range(70)) * (s + 1)] * 3 for s in range(2)}


def test_a_written_step_leaves_no_shuffle_files(spark):
    def shuffled():
        return set(glob.glob(f"{tempfile.gettempdir()}/**/blockmgr-*/*/shuffle_*", recursive=True))

    before, was = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    x = spark.range(20_000).repartition(3, "id").groupBy((F.col("id") % 900).alias("k")).agg(F.count("*").alias("n"))
    out = common.materialize(x, "step")
    end = time.time() + 20
    while shuffled() - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffled() - before and out.count() == 900
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == was
