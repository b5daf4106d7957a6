"""A training corpus in five stages: quality rules, boilerplate lines, near duplicates, source mix, packed sequences.

Each stage takes the documents that the stage before kept, and all but the last return the columns of `documents`. run() writes
each stage's result to the shared folder and reads it again, so a lost executor never costs more than a stage.

Null or empty texts fail the quality rules. Rows with a null id pass the near-duplicate stage. An empty table passes
through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, drop_table, materialize, n_words_of, small_join, text_of, words_of
from quarry.llm.line_dedup import drop_boilerplate_lines
from quarry.llm.mixing import mix
from quarry.llm.ngram_join import jaccard_components
from quarry.llm.packing import pack
from quarry.llm.quality_rules import ledger, verdict

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of the full policy."""
    return ledger(docs.select(*COLUMNS)).filter(verdict()).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate in their source."""
    x = drop_boilerplate_lines(spark, docs.select(*COLUMNS), F.col("source"))
    return x.withColumn("n_chars", F.when(F.col("_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: five words, a similarity of 0.8. Of rows that repeat that id,
    which are of its group, the greatest stays (so never an empty text for another). Rows with a null id all stay."""
    found = jaccard_components(spark, docs, width=5, percent=80)
    gone = materialize(found.filter("component_id <> doc_id").select("doc_id").distinct(), "near-duplicates")
    kept = small_join(docs.select(*COLUMNS), gone, "doc_id", "left_anti", gone.count())
    again = kept.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = materialize(again, "repeated-ids")
    n = again.count()
    if not n:
        return kept
    one = small_join(kept, again, "doc_id", "left_semi", n).groupBy("doc_id").agg(F.max(F.struct(*COLUMNS[1:])).alias("row"))
    return small_join(kept, again, "doc_id", "left_anti", n).unionByName(one.select("doc_id", "row.*"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each whole epoch, and one cut to the words that are left of the budget."""
    x = mix(spark, docs.select(*COLUMNS), n_words_of(text_of()), carry=("text", "lang", "n_chars"))
    epochs = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rest = (F.col("taken") - epochs * F.col("size")).cast("int")
    head = F.array_join(F.slice(words_of(text_of()), F.lit(1), rest), " ")
    copies = F.concat(F.array_repeat(F.col("text"), epochs), F.when(rest > 0, F.array(head)).otherwise(F.array().cast("array<string>")))
    x = x.withColumn("text", F.explode(copies))
    return x.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(spark, docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("mixing", mixture), ("packing", packed)]
#: The packing stage has no SQL: tests compare the pieces of run() with those of a brute-force version of the five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop_table(last)
        last = docs
    out = materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
    drop_table(docs)
    return out
