"""Quality rules as a ledger of bits.

``ledger`` measures every text once and stores, beside the measurements, one failure bit for each rule. Policies are versioned
sets of rules; a verdict is one bitwise AND over the ledger, so a policy changes without reading a text again. ``ablation``
aggregates the ledger by its masked bits (at most 2^rules groups, partial sums first) and tells for each rule how many rows
fail it, fail only it, and would come back if it were dropped.

Only DataFrame functions are used. Nothing is shuffled by the ledger. Null texts count as empty and fail too_short; ids may be
null or repeat; an empty table gives an empty ledger. Columns other than the text pass through, whatever their names; only those named
as a column of the ledger are replaced by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, documents_but, let, materialize, text_of

SYMBOLS = "#*$%&|<>"
#: Rules in the order of their bits, over the measurements, in integers.
RULES: dict[str, str] = {
    "too_short": "n_words < 50",
    "repeat_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "shouting": "100 * n_upper > 50 * word_chars",
    "bangs": "100 * n_bangs > 20 * n_words",
}
#: Policies by version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "2024-base": ("too_short", "repeat_words"),
    "2024-full": tuple(RULES),
}
POLICY = "2024-full"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur at least twice in the text. Windows are compared as 64-bit hashes of one text;
    most texts end at the distinct count, the others sort (hash, position) and look at neighbours."""

    def covered(starts: Column) -> Column:
        spans = F.zip_with(starts, F.slice(starts, F.lit(2), F.size(starts)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(spans, F.lit(0), lambda acc, x: acc + x)

    def repeated(s: Column) -> Column:
        n = F.size(s)
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        picked = F.filter(F.transform(s, lambda x, i: F.when(((i > 0) & same(i - 1, i)) | ((i < n - 1) & same(i, i + 1)), x["p"])), lambda p: p.isNotNull())
        return F.when(F.size(picked) > 0, let(F.sort_array(picked), covered)).otherwise(F.lit(0))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        sort = lambda h: let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), repeated)
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(sort(h)))

    return F.when(F.size(words) >= 3, of(words)).otherwise(F.lit(0)).cast("long")


def ledger(docs: DataFrame, text_col: str = "text", rules: dict[str, str] = RULES) -> DataFrame:
    """docs with the columns of MEASURES and fail_bits (bit i: rule i fails)."""
    size = lambda c: F.size(c).cast("long")
    x = docs.select(documents_but(docs, *MEASURES, "fail_bits").alias("row"), text_of(f"`{text_col}`").alias("_t"))
    x = x.withColumn("_w", F.filter(F.split("_t", SPACE), lambda w: w != ""))
    x = x.withColumn("_l", F.filter(F.split("_t", "\n"), lambda v: v.rlike(r"[^\x20\x09-\x0D]")))
    gone = lambda chars: (F.length("_t") - F.length(F.translate("_t", chars, ""))).cast("long")
    measured = {
        "n_words": size("_w"),
        "word_chars": F.length(F.regexp_replace("_t", SPACE, "")).cast("long"),
        "n_symbols": gone(SYMBOLS),
        "n_lines": size("_l"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_w")),
        "n_upper": F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long"),
        "n_bangs": gone("!"),
    }
    # A generator of one row: no filter on the measurements is pushed below it, so each is computed once a row.
    x = x.select("row", F.inline(F.array(F.struct(*[c.alias(n) for n, c in measured.items()]))))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules.values())]
    x = x.withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))
    names = [f.name for f in x.schema["row"].dataType.fields]
    return x.select(*[F.col("row")[c].alias(c) for c in names], *MEASURES, "fail_bits")


def mask(policy: str, rules: dict[str, str] = RULES, policies: dict[str, tuple[str, ...]] = POLICIES) -> int:
    names = list(rules)
    return sum(1 << names.index(r) for r in policies[policy])


def verdict(policy: str = POLICY) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(book: DataFrame, policy: str = POLICY, rules: dict[str, str] = RULES) -> DataFrame:
    """rule, n_failed, n_failed_alone (rows that come back without the rule), n_rejected and n_rows of the policy."""
    m = F.lit(mask(policy)).cast("long")
    groups = book.groupBy(F.col("fail_bits").bitwiseAND(m).alias("b")).count()
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, n in enumerate(rules) if n in POLICIES[policy]])
    x = groups.select("b", "count", F.explode(each).alias("r"))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("count"))), F.lit(0)).alias
    return x.groupBy(F.col("r.rule").alias("rule")).agg(count(F.col("b").bitwiseAND(F.col("r.bit")) != 0)("n_failed"), count(F.col("b") == F.col("r.bit"))("n_failed_alone"), count(F.col("b") != 0)("n_rejected"), F.sum("count").alias("n_rows"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored; the base rules and the policy are two masks over it, and same_bits, the rows that fail the same rules, is its bitwise
    aggregation (at most 2^rules rows), from which ablation() tells the effect of each rule."""
    book = materialize(ledger(documents(spark, sf_dir).select("doc_id", "text")).drop("text"), "ledger")
    same = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("same_bits"))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("2024-base")).cast("long")) != 0
    x = book.join(F.broadcast(same), "fail_bits")
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & verdict()).alias("kept"), "n_lines", "n_upper", "n_bangs", "fail_bits", "same_bits")


SQL_LEDGER = r"""
d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) o(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS BIGINT) AS n_lines,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
            - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_bangs
  FROM d LEFT JOIN r USING (doc_id)),
ledger AS (
  SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT
    + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
    + 32 * (100 * n_upper > 50 * word_chars)::INT + 64 * (100 * n_bangs > 20 * n_words)::INT AS BIGINT) AS fail_bits FROM m)
"""
SQL = f"""
WITH {SQL_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept,
       n_lines, n_upper, n_bangs, fail_bits, count(*) OVER (PARTITION BY fail_bits) AS same_bits FROM ledger
"""
