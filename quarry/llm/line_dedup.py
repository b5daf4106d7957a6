"""Boilerplate lines by their frequency within a site.

A line (trimmed of ASCII white space) is boilerplate on a host if it is on at least ``min_pages`` of the host's pages and on
more than ``ratio`` of them. Rows are pages; a line counts once a page. Pages are told apart by row, hosts by value.

Counting explodes 64-bit line hashes, one per distinct line of a page, and aggregates them per host with partial sums, so a
line or host with a third of all rows costs one row per map task. The boilerplate set has at most mean lines a page / ratio
entries a host; if its counted size fits, it is broadcast as one array a host and texts are never shuffled. Otherwise the hits
are joined per line, regrouped per page, and joined to the pages.

Blank lines are kept unless a line is dropped next to nothing else. A page whose every line is boilerplate is a copy of other
pages, not boilerplate, and is left whole (near-duplicate removal decides on it). Null or empty texts stay as they are; a null
host is a host of its own. An empty table gives an empty result. Other columns pass through untouched, whatever their names; only
those named as an added column (_host_pages, _lines, _dropped) are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, documents_but, materialize

RATIO = 0.1
MIN_PAGES = 3


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def html_text(html: Column) -> Column:
    """The visible text of a page, a line for each block element."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?i)</?(p|div|li|ul|ol|nav|article|section|header|footer|h[1-6]|br|hr|tr|td|table|title|head|body|html|blockquote|pre)([\x20\x09-\x0D/][^>]*)?>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1), F.lit("")))


def drop_boilerplate_lines(spark: SparkSession, pages: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`pages` with text_col cleaned, and the columns _host_pages, _lines and _dropped (counts of non-blank lines)."""
    scratch = Scratch(spark)
    named = F.when(host.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), host))
    # All columns of the input travel in one, so no name of theirs can clash.
    x = pages.select(documents_but(pages, "_host_pages", "_lines", "_dropped").alias("row"), named.alias("host"), F.col(text_col).alias("text"))
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    hashes = F.transform(F.filter(F.transform(lines, _trimmed), lambda v: v != ""), lambda v: F.xxhash64(v))
    totals = scratch.table(x.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    counts = x.select("host", F.explode(F.array_distinct(hashes)).alias("h")).groupBy("host", "h").count().filter(F.col("count") >= min_pages)
    often = materialize(counts.join(totals, "host").filter(F.col("count") > F.lit(ratio) * F.col("pages")).select("host", "h"), "boilerplate")

    if often.count() <= broadcast_rows and totals.count() <= broadcast_rows:
        sets = materialize(totals.join(often.groupBy("host").agg(F.collect_list("h").alias("hits")), "host", "left"), "host-lines")
        x = x.join(F.broadcast(sets), "host", "left")
        scratch.close()
    else:
        x = materialize(x.withColumn("i", F.monotonically_increasing_id()), "pages")
        hits = x.select("i", "host", F.explode(F.array_distinct(hashes)).alias("h")).join(often, ["host", "h"])
        x = x.join(hits.groupBy("i").agg(F.collect_list("h").alias("hits")), "i", "left").join(totals, "host", "left")
    each = F.transform(lines, lambda v: F.struct(v.alias("raw"), _trimmed(v).alias("line")))
    x = x.withColumn("each", F.transform(each, lambda v: F.struct(v["raw"].alias("raw"), F.when(v["line"] != "", F.xxhash64(v["line"])).alias("h"))))
    hit = lambda e: e["h"].isNotNull() & F.coalesce(F.array_contains(F.col("hits"), e["h"]), F.lit(False))
    x = x.withColumn("n", F.size(F.filter("each", lambda e: e["h"].isNotNull())).cast("long"))
    x = x.withColumn("gone", F.size(F.filter("each", hit)).cast("long"))
    x = x.withColumn("gone", F.when(F.col("gone") < F.col("n"), F.col("gone")).otherwise(F.lit(0)).cast("long"))
    kept = F.array_join(F.transform(F.filter("each", lambda e: ~hit(e)), lambda e: e["raw"]), "\n")
    cleaned = F.when(F.col("gone") > 0, kept).otherwise(F.col("text"))
    names = [f.name for f in x.schema["row"].dataType.fields]
    own = [cleaned.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names]
    return x.select(*own, F.col("pages").alias("_host_pages"), F.col("n").alias("_lines"), F.col("gone").alias("_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host_of(F.col("url")).alias("host"), html_text(F.col("html")).alias("text"))
    # Taking the text out of the markup is most of the work; it is read twice.
    x = drop_boilerplate_lines(spark, materialize(pages, "page-texts"), F.col("host"))
    return x.select("page_id", "host", F.col("_host_pages").alias("host_pages"), F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), "text")


SQL = r"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '') AS host,
    replace(replace(replace(replace(replace(replace(
      regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
        '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
        '(?i)</?(p|div|li|ul|ol|nav|article|section|header|footer|h[1-6]|br|hr|tr|td|table|title|head|body|html|blockquote|pre)([\x20\x09-\x0D/][^>]*)?>', chr(10), 'g'),
        '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS text
  FROM pages),
l AS (
  SELECT page_id, host, i, raw, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM (SELECT page_id, host, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM p)),
t AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
c AS (SELECT host, line, count(DISTINCT page_id) AS n FROM l WHERE line <> '' GROUP BY host, line),
b AS (SELECT c.host, c.line FROM c JOIN t ON c.host IS NOT DISTINCT FROM t.host WHERE n >= 3 AND n > 0.1::DOUBLE * host_pages),
f AS (SELECT l.*, b.line IS NOT NULL AS hit FROM l LEFT JOIN b ON l.host IS NOT DISTINCT FROM b.host AND l.line = b.line),
g AS (
  SELECT page_id, count(*) FILTER (line <> '') AS n_lines, count(*) FILTER (hit) AS hits,
         string_agg(raw, chr(10) ORDER BY i) FILTER (NOT hit) AS kept
  FROM f GROUP BY page_id)
SELECT p.page_id, p.host, host_pages, n_lines, CASE WHEN hits < n_lines THEN hits ELSE 0 END AS n_dropped,
       CASE WHEN hits > 0 AND hits < n_lines THEN kept ELSE p.text END AS text
FROM p JOIN g USING (page_id) JOIN t ON p.host IS NOT DISTINCT FROM t.host
"""
