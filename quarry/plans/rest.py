"""Queries on tables and sync, joins, graphs, evaluation, data quality and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import analytics as A
from quarry.operators import bm25 as BM
from quarry.operators import caches as CA
from quarry.operators import evaluation as E
from quarry.operators import fusion as FU
from quarry.operators import graph as G
from quarry.operators import incremental as I
from quarry.operators import titles as TI
from quarry.operators import vector as V
from quarry.sources import recorded as RC
from quarry.sources import remote as RM
from quarry.sources import tables as TB
from quarry.streaming import windows as SW

from .registry import query, saved, table
from .retrieval import ALL_FIELDS, BATCH, CELLS, CHUNKS, FIELDS, HIT, L2, PROBE, TERMS, chunks, found_by_codes, index_sql, indexed, knn_4, probed, seeds, sources, vector_index, vectors


@query("src_1_open_table", "SELECT count(*) AS n FROM nation")
def src_1(s, d):
    return TB.load(s, f"{d}/nation.parquet").agg(F.count(F.lit(1)).alias("n"))


@query("src_2_full_scan", "SELECT * FROM region")
def src_2(s, d):
    return table(s, d, "region")


@query("src_3_columnar_scan", "SELECT vec_id, label FROM embeddings")
def src_3(s, d):
    return TB.load(s, f"{d}/embeddings.parquet", ["vec_id", "label"])


@query("src_4_paged_scan", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 500")
def src_4(s, d):
    return TB.page(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 500, 500)


@query("src_5_scan_of_vectors", "SELECT vec_id FROM embeddings")
def src_5(s, d):
    return vectors(s, d).select("vec_id")


@query("src_6_row_count", "SELECT count(*) AS n FROM lineitem")
def src_6(s, d):
    return table(s, d, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("src_7_changed_since", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'")
def src_7(s, d):
    return TB.load(s, f"{d}/orders.parquet", ["o_orderkey"], F.col("o_orderdate") >= F.lit("1997-06-01").cast("timestamp_ntz"))


@query("src_8_cursor_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 51")
def src_8(s, d):
    return TB.after(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 100, 50)


def changed_at(key):  # noqa: ANN001, ANN201
    """A minute for each key from the start of 2024 on."""
    return F.timestamp_seconds(F.lit(1_704_067_200) + F.col(key) * 60)


def as_json(**columns):  # noqa: ANN201
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})


def recorded_pages(x, folder):  # noqa: ANN001, ANN201
    x = x.withColumn("updated", changed_at("doc_id"))
    at = F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    raw = as_json(id=F.col("doc_id").cast("string"), title=F.substring("text", 1, 40), body=F.col("text"), space=F.col("source"), url=F.concat(F.lit("/wiki/"), F.col("doc_id").cast("string")), labels=F.array("lang"), lastModified=at)
    RC.record(x, folder, "doc_id", "updated", raw)


@query("src_7_changed_pages", "SELECT doc_id AS page_id, substr(text, 1, 40) AS title, length(text) AS n FROM documents WHERE doc_id >= 120")
def src_7_pages(s, d):
    """The documents as a wiki serves them, page after page; the filter is handed to the service."""
    folder = saved(s, d, "wiki", "documents", lambda path: recorded_pages(table(s, d, "documents"), path))
    RM.register(s)
    x = s.read.format("quarry_wiki").options(url=folder, pagesize="200").load()
    return x.filter(F.col("updated") >= F.timestamp_seconds(F.lit(1_704_067_200 + 120 * 60))).select("page_id", "title", F.length("content").alias("n"))


@query("src_7_synced_pages", "SELECT doc_id AS page_id, length(text) AS n FROM documents WHERE source IS DISTINCT FROM 'src1'")
def src_7_synced(s, d):
    """The same wiki as a stream, in two runs with one checkpoint: first its older half, then all of it. Pages of one space are excluded."""
    wiki, folder = table(s, d, "documents"), TB.scratch(s, "wiki")
    middle = wiki.select(F.percentile_approx("doc_id", 0.5)).first()[0]
    RM.register(s)
    path, checkpoint = TB.scratch(s, "pages"), TB.scratch(s, "stream")
    for part, first in ((wiki.filter(F.col("doc_id") <= middle), {}), (wiki.filter(F.col("doc_id") > middle), {"": wiki.filter(F.col("doc_id") <= middle).count()})):
        x = part.withColumn("updated", changed_at("doc_id"))
        at = F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        raw = as_json(id=F.col("doc_id").cast("string"), title=F.substring("text", 1, 40), body=F.col("text"), space=F.col("source"), lastModified=at)
        RC.record(x, folder, "doc_id", "updated", raw, first=first)
        stream = s.readStream.format("quarry_wiki").options(url=folder, pagesize="200").load()
        SW.synced(stream, path, "page_id", "updated", checkpoint, F.col("space") == "src1").awaitTermination()
    return s.read.parquet(f"{TB.at(s, path)}/rows").select("page_id", F.length("content").alias("n"))


@query("src_8_changed_tickets", "SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS project, c_name AS summary FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey > 60")
def src_8_tickets(s, d):
    """The customers as a tracker serves tickets, by project and token; projects and time are handed to the service."""

    def build(path):  # noqa: ANN001, ANN202
        x = table(s, d, "customer").withColumn("updated", changed_at("c_custkey"))
        at = F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        raw = as_json(key=F.col("c_custkey").cast("string"), summary=F.col("c_name"), status=F.lit("Open"), created=at, updated=at)
        RC.record(x, path, "c_custkey", "updated", raw, part=F.col("c_mktsegment"))

    folder = saved(s, d, "tickets", "customer", build)
    RM.register(s)
    names = ",".join(r[0] for r in table(s, d, "customer").select("c_mktsegment").distinct().collect())  # projects, which the service lists
    x = s.read.format("quarry_tickets").options(url=folder, projects=names, pagesize="500").load()
    x = x.filter(F.col("project").isin("BUILDING", "MACHINERY") & (F.col("updated") > F.timestamp_seconds(F.lit(1_704_067_200 + 60 * 60))))
    return x.select("key", "project", "summary")


@query("src_9_drive_files", "SELECT CAST(page_id AS VARCHAR) AS id, url AS name, CASE WHEN page_id % 4 = 1 THEN '| page | size |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || page_id || ' | ' || length(html) || ' |' ELSE html END AS content FROM pages WHERE page_id % 4 < 2")
def src_9(s, d):
    """The web pages as files of a drive: documents, sheets and others; the types are handed to the service, sheets come as tables."""

    def build(path):  # noqa: ANN001, ANN202
        x = table(s, d, "pages").withColumn("updated", changed_at("page_id"))
        kind = F.when(F.col("page_id") % 4 == 0, RM.DOCUMENT).when(F.col("page_id") % 4 == 1, RM.SHEET).when(F.col("page_id") % 4 == 2, RM.SLIDES).otherwise("image/png")
        sheet = F.concat(F.lit("page,size\n,\n"), F.col("page_id").cast("string"), F.lit(","), F.length("html").cast("string"), F.lit("\n"))
        at = F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        raw = as_json(id=F.col("page_id").cast("string"), name=F.col("url"), mimeType=kind, modifiedTime=at)
        RC.record(x, path, "page_id", "updated", raw, kind=kind, body=F.when(kind == RM.SHEET, sheet).otherwise(F.col("html")))

    folder = saved(s, d, "drive", "pages", build)
    RM.register(s)
    x = s.read.format("quarry_drive").options(url=folder).load().filter(F.col("type").isin(RM.DOCUMENT, RM.SHEET))
    return x.select("id", "name", "content")


@query("src_12_json_lines", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src_12(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.k")


@query("snk_2_delete_where", "SELECT doc_id FROM documents WHERE NOT coalesce(lang = 'en', false)")
def snk_2(s, d):
    path = TB.scratch(s, "documents")
    TB.replace(table(s, d, "documents").select("doc_id", "lang"), path)
    TB.delete(s, path, F.col("lang") == "en")
    return TB.current(s, path).select("doc_id")


@query("snk_3_replaced_table", "SELECT o_orderkey, o_orderstatus || '-2' AS o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def snk_3(s, d):
    """A table that is replaced by rows read from itself."""
    path = TB.scratch(s, "orders")
    TB.replace(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), path)
    TB.replace(TB.current(s, path).filter("o_orderstatus <> 'P'").withColumn("o_orderstatus", F.concat("o_orderstatus", F.lit("-2"))), path)
    return TB.current(s, path)


@query("snk_5_saved_index", f"WITH {index_sql(hit=HIT, fields=ALL_FIELDS)} SELECT id, round(score, 6) AS score, match_count FROM bm ORDER BY round(score, 9) DESC, id LIMIT 50")
def snk_5(s, d):
    """The index is written, opened again and searched."""
    path = TB.scratch(s, "index")
    BM.save_index(indexed(s, d), path, "doc_id", FIELDS, 16)
    return BM.search_index(s, path, TERMS, 50, FIELDS).withColumn("score", F.round("score", 6))


@query("snk_4_index_cells", f"WITH {CELLS} SELECT CAST(cell AS INT) AS cell, count(*) AS n FROM n GROUP BY 1")
def snk_4(s, d):
    """The vectors written by cell, and read back: a folder a cell."""
    path = TB.scratch(s, "cells")
    TB.replace_all({"cells": (V.assign_cells(vectors(s, d), "embedding", seeds(s, d)), ["cell"])}, path)
    x = s.read.parquet(f"{TB.at(s, path)}/cells")
    return x.groupBy(F.col("cell").cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("snk_4_quantized_index", "SELECT vec_id, 16 AS bytes FROM embeddings")
def snk_4_quantized(s, d):
    """The codes of the trained index, read back: every row once, a byte a part."""
    return vector_index(s, d).codes.select(F.col("key").alias("vec_id"), F.length("codes").alias("bytes"))


@query("snk_4_key_index", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings WHERE vec_id = 77")
def snk_4_key(s, d):
    """One row by the scalar index on the key."""
    x = vector_index(s, d).get(77)
    return x.select(F.col("key").alias("vec_id"), F.round(F.aggregate("v", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("snk_6_backup_retention", "SELECT day, row_number() OVER (ORDER BY day DESC) <= 10 AS kept FROM (SELECT DISTINCT ts::DATE AS day FROM events)")
def snk_6(s, d):
    return TB.retained(table(s, d, "events").select(F.to_date("ts").alias("day")).distinct(), "day", 10)


@query("snk_6_restored_backup", "SELECT 'b2' AS stamp, c_custkey, c_acctbal + 2 AS c_acctbal FROM customer")
def snk_6b(s, d):
    """Three backups of a changing table, the oldest pruned, and the newest restored over a damaged table."""
    root, path = TB.scratch(s, "backups"), TB.scratch(s, "customer")
    for i in range(3):
        TB.replace(table(s, d, "customer").select("c_custkey", (F.col("c_acctbal") + i).alias("c_acctbal")), path)
        TB.backup(TB.current(s, path), root, f"b{i}")
    TB.prune(s, root, 2)
    TB.delete(s, path, F.lit(True))
    TB.restore(s, root, path)
    return TB.current(s, path).select(F.lit(TB.backups(s, root)[0]).alias("stamp"), "c_custkey", "c_acctbal")


SNK7 = f"""WITH {CHUNKS}, e AS (SELECT 'page:' || doc_id AS a, 'page:' || (doc_id + 1) AS b, 'REFERENCE' AS t, 1.0::DOUBLE AS w FROM chunks WHERE (doc_id + 1) IN (SELECT doc_id FROM chunks) UNION ALL SELECT a, b, t, w FROM (SELECT 'page:' || doc_id AS a, 'concept:' || unnest(list_distinct(labels)) AS b, 'CONCEPT' AS t, 0.6::DOUBLE AS w FROM chunks) WHERE b IS NOT NULL),
n AS (SELECT 'page:' || doc_id AS id, 'page' AS k FROM chunks UNION SELECT b, 'concept' FROM e WHERE t = 'CONCEPT')
SELECT 'node' AS part, id AS a, k AS b, NULL AS t, NULL::DOUBLE AS w FROM n UNION ALL SELECT 'edge', a, b, t, w FROM e"""


@query("snk_7_graph_csv", SNK7)
def snk_7(s, d):
    """Nodes and edges as CSV with typed headers, written and read back."""
    x = chunks(s, d).select(F.col("doc_id").alias("page"), "labels")
    path = TB.scratch(s, "graph-csv")
    nodes, edges_ = G.csv_tables(*G.build(x, "page", "labels", x.select("page", (F.col("page") + 1).alias("to"))))
    TB.write_csv(nodes, f"{path}/nodes")
    TB.write_csv(edges_, f"{path}/edges")
    n = TB.read_csv(s, f"{path}/nodes", "a string, b string").select(F.lit("node").alias("part"), "a", "b", F.lit(None).cast("string").alias("t"), F.lit(None).cast("double").alias("w"))
    return n.union(TB.read_csv(s, f"{path}/edges", "a string, b string, t string, w double").select(F.lit("edge"), "a", "b", "t", "w"))


# Incoming: every order, dated later by 0, 1, 2 or 3 seconds; stored: those not divisible by 5.
INCOMING = "inc AS (SELECT o_orderkey, o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 4) AS updated, o_orderstatus FROM orders), stored AS (SELECT o_orderkey, o_orderdate AS updated, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0), act AS (SELECT i.*, CASE WHEN i.o_orderstatus = 'P' THEN 'excluded' WHEN s.o_orderkey IS NULL THEN 'added' WHEN date_diff('millisecond', s.updated, i.updated) > 1000 THEN 'updated' ELSE 'unchanged' END AS action FROM inc i LEFT JOIN stored s USING (o_orderkey))"


def sync(s, d):  # noqa: ANN001, ANN201
    o = table(s, d, "orders")
    late = F.expr("make_dt_interval(0, 0, 0, o_orderkey % 4)")
    incoming = o.select("o_orderkey", (F.col("o_orderdate") + late).alias("updated"), "o_orderstatus")
    stored = o.filter("o_orderkey % 5 <> 0").select("o_orderkey", F.col("o_orderdate").alias("updated"), "o_orderstatus")
    return stored, I.classify(incoming, stored, "o_orderkey", "updated", F.col("o_orderstatus") == "P")


@query("inc_1_high_water", "SELECT max(ts) - INTERVAL 1 SECOND AS since FROM events")
def inc_1(s, d):
    return I.high_water(table(s, d, "events"), "ts")


@query("inc_2_classified", f"WITH {INCOMING} SELECT o_orderkey, action FROM act")
def inc_2(s, d):
    return sync(s, d)[1].select("o_orderkey", F.col("_action").alias("action"))


@query("inc_3_upsert", f"WITH {INCOMING} SELECT o_orderkey, updated FROM act WHERE action IN ('added', 'updated') UNION ALL SELECT o_orderkey, updated FROM stored WHERE o_orderkey NOT IN (SELECT o_orderkey FROM act WHERE action IN ('added', 'updated'))")
def inc_3(s, d):
    stored, x = sync(s, d)
    return I.upsert(stored, x.filter(F.col("_action").isin("added", "updated")).drop("_action"), "o_orderkey").select("o_orderkey", "updated")


@query("snk_1_append", f"WITH {INCOMING} SELECT o_orderkey, 'stored' AS came FROM stored UNION ALL SELECT o_orderkey, 'added' FROM act WHERE action = 'added'")
def snk_1(s, d):
    """New rows are appended to a stored table."""
    stored, x = sync(s, d)
    path = TB.scratch(s, "stored")
    TB.append(stored.select("o_orderkey", F.lit("stored").alias("came")), path)
    TB.append(x.filter(F.col("_action") == "added").select("o_orderkey", F.lit("added").alias("came")), path)
    return TB.load(s, path)


@query("inc_4_purged", "SELECT doc_id, (SELECT count(*) FROM documents WHERE source IN ('src1', 'src2') OR length(text) < 100) AS gone FROM documents WHERE NOT coalesce(source IN ('src1', 'src2') OR length(text) < 100, false)")
def inc_4(s, d):
    path = TB.scratch(s, "purged")
    TB.replace(table(s, d, "documents").select("doc_id", "source", F.length("text").alias("size")), path)
    gone = I.purge(s, path, F.col("source").isin("src1", "src2") | (F.col("size") < 100))
    return TB.current(s, path).select("doc_id", F.lit(gone).cast("bigint").alias("gone"))


@query("inc_6_resumed_sync", "SELECT c_custkey, c_nationkey % 4 AS batch, CASE WHEN c_nationkey % 4 < 2 THEN 1 ELSE 2 END AS run FROM customer")
def inc_6(s, d):
    """A sync in four batches that breaks off in the third; the second run does what is left."""
    rows, path = table(s, d, "customer").select("c_custkey", (F.col("c_nationkey") % 4).alias("batch")), TB.scratch(s, "sync")
    progress = I.Progress(s, f"{path}/progress")
    for run, most in ((1, 2), (2, 4)):
        batches = ((str(i), rows.filter(F.col("batch") == i)) for i in range(most))
        progress.run(batches, lambda x, run=run: TB.append(x.withColumn("run", F.lit(run)), f"{path}/rows"))
    return TB.load(s, f"{path}/rows")


@query("inc_7_cache_replay", "SELECT props AS question, count(*) AS asked, count(*) FILTER (gap < INTERVAL 6 HOUR) AS hits FROM (SELECT props, ts - lag(ts) OVER (PARTITION BY props ORDER BY ts, event_id) AS gap FROM events) GROUP BY 1")
def inc_7(s, d):
    x = CA.replay(table(s, d, "events").select(F.col("props").alias("question"), "ts", "event_id"), "question", "ts", "event_id", 6 * 3600)
    return x.groupBy("question").agg(F.count(F.lit(1)).alias("asked"), F.count_if("hit").alias("hits"))


@query("inc_8_sampled", "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS slot, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def inc_8(s, d):
    x = I.sampled(table(s, d, "events").select("event_type", "ts", "event_id", "value"), "ts", 3600, "event_id", ["event_type"])
    return x.select("event_type", F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"), "value", "event_id")


@query("inc_5_ticket_sync", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'updated' WHEN o_orderkey % 3 > 1 THEN 'updated' ELSE 'unchanged' END AS action FROM orders")
def inc_5(s, d):
    o = table(s, d, "orders")
    incoming = o.select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, o_orderkey % 3)")).alias("updated"))
    x = I.classify(incoming, o.select("o_orderkey", F.col("o_orderdate").alias("updated")), "o_orderkey", "updated", F.lit(False))
    return x.select("o_orderkey", F.col("_action").alias("action"))


@query("inc_9_health", "SELECT user_id, CASE max(CASE WHEN value > 60 THEN 2 WHEN value > 40 THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS health FROM events GROUP BY 1")
def inc_9(s, d):
    level = F.when(F.col("value") > 60, "critical").when(F.col("value") > 40, "warning").otherwise("ok")
    return table(s, d, "events").groupBy("user_id").agg(I.worst(level).alias("health"))


@query("inc_10_conversation_pages", "SELECT conv_id, count(*) AS n, max(turn) AS last FROM conversations WHERE conv_id > 3 GROUP BY 1 ORDER BY conv_id LIMIT 21")
def inc_10(s, d):
    x = table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    return TB.after(x, "conv_id", 3, 20)


@query("inc_10_appended_message", "WITH l AS (SELECT conv_id, max(turn) + 1 AS next FROM conversations GROUP BY 1) SELECT conv_id, turn, role, length(text) AS n FROM conversations UNION ALL SELECT conv_id, next, 'user', 6 FROM l WHERE conv_id % 2 = 0 UNION ALL SELECT -1, 0, 'user', 6")
def inc_10b(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "role", "text")
    ids = c.filter("conv_id % 2 = 0").select("conv_id").distinct().union(s.createDataFrame([(-1,)], "conv_id bigint"))
    new = ids.select("conv_id", F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.lit("thanks").alias("text"))
    return I.append_message(c, new, "conv_id", "turn").select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("jn_1_hits_with_records", "SELECT vec_id, label, text FROM (SELECT vec_id, label FROM embeddings ORDER BY embedding[1], vec_id LIMIT 50) LEFT JOIN documents ON doc_id = vec_id")
def jn_1(s, d):
    hits = vectors(s, d).orderBy(F.get("embedding", F.lit(0)), "vec_id").limit(50).select("vec_id", "label")
    return hits.join(table(s, d, "documents"), F.col("vec_id") == F.col("doc_id"), "left").select("vec_id", "label", "text")


@query("jn_2_one_of_many", "SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) ON l_orderkey = o_orderkey AND rn = 1")
def jn_2(s, d):
    first = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l_linenumber"), F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("l_partkey"))
    o = table(s, d, "orders").select("o_orderkey")
    return o.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber", "l_partkey")


@query("jn_5_enriched_tickets", "SELECT o_orderkey, c_mktsegment, n_lines FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def jn_5(s, d):
    n = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    o = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.join(n, "o_orderkey", "left").select("o_orderkey", "c_mktsegment", "n_lines")


@query("jn_6_completion_dates", "SELECT o_orderkey, shipped FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def jn_6(s, d):
    done = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    return table(s, d, "orders").filter("o_orderstatus = 'F'").join(done, "o_orderkey", "left").select("o_orderkey", "shipped")


@query("jn_7_with_labels", "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def jn_7(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left")


@query("jn_8_sibling_chunks", "SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, chr(10) || chr(10) ORDER BY l_linenumber, l_partkey) AS content FROM lineitem GROUP BY 1")
def jn_8(s, d):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("c"))))
    return table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(rows, lambda r: r["c"]), "\n\n").alias("content"))


@query("jn_9_labels_into_rows", "SELECT v.vec_id, q.quality FROM (SELECT vec_id, CAST(regexp_replace(vec_id || '-chunk-' || vec_id % 3, '-chunk-[0-9]+$', '') AS BIGINT) AS page FROM embeddings) v LEFT JOIN labels q ON q.doc_id = v.page")
def jn_9(s, d):
    page = F.regexp_replace(F.concat(F.col("vec_id").cast("string"), F.lit("-chunk-"), (F.col("vec_id") % 3).cast("string")), "-chunk-[0-9]+$", "").cast("bigint")
    return vectors(s, d).select("vec_id", page.alias("doc_id")).join(table(s, d, "labels"), "doc_id", "left").select("vec_id", "quality")


@query("jn_10_anti_both_ways", "SELECT 'unlabelled' AS side, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'orphan', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def jn_10(s, d):
    docs, labels = table(s, d, "documents"), table(s, d, "labels")
    n = F.count(F.lit(1)).alias("n")
    a = docs.join(labels, "doc_id", "left_anti").agg(n).select(F.lit("unlabelled").alias("side"), "n")
    return a.union(labels.join(docs.filter("lang <> 'en'"), "doc_id", "left_anti").agg(n).select(F.lit("orphan").alias("side"), "n"))


@query("jn_11_new_pages", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def jn_11(s, d):
    return table(s, d, "documents").select("doc_id").join(vectors(s, d).select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("jn_12_user_names", "SELECT event_id, coalesce(c_name, 'Unknown') AS name FROM events LEFT JOIN customer ON c_custkey = user_id")
def jn_12(s, d):
    return table(s, d, "events").join(table(s, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left").select("event_id", F.coalesce("c_name", F.lit("Unknown")).alias("name"))


@query("jn_13_inner", "SELECT doc_id, label FROM documents JOIN embeddings ON vec_id = doc_id")
def jn_13(s, d):
    return table(s, d, "documents").join(vectors(s, d), F.col("vec_id") == F.col("doc_id")).select("doc_id", "label")


@query("jn_14_domain_pairs", "WITH n AS (SELECT c_custkey AS node, c_nationkey AS domain, c_mktsegment AS category FROM customer) SELECT a.node, count(*) AS links, count(*) FILTER (b.category = a.category) AS same, round(sum(0.5::DOUBLE + CASE WHEN b.category = a.category THEN 0.2 ELSE 0 END), 6) AS weight FROM n a JOIN n b ON a.domain = b.domain AND a.node <> b.node GROUP BY 1")
def jn_14(s, d):
    """Every link of a node in its domain, counted from the sizes of domains and categories; kg_3_domain_edges and links_of() have the pairs."""
    x = G.link_counts(G.domain_links(table(s, d, "customer"), "c_custkey", "c_nationkey", "c_mktsegment"))
    return x.filter("links > 0").select("node", "links", "same", F.round("weight", 6).alias("weight"))


TAGS = "t AS (SELECT p_partkey AS id, list_distinct(string_split(p_name, ' ') || [p_brand, p_type]) AS t FROM part), j AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t))::DOUBLE AS similarity FROM t a JOIN t b ON a.id < b.id)"


def tagged(s, d):  # noqa: ANN001, ANN201
    tags = F.concat(F.split("p_name", " "), F.array("p_brand", "p_type"))
    return table(s, d, "part").withColumn("tags", tags)


@query("jn_15_tag_similarity", f"WITH {TAGS}, y AS (SELECT a AS id, b AS other, similarity FROM j UNION ALL SELECT b, a, similarity FROM j) SELECT id, count(*) AS links, round(sum(similarity), 6) AS similarity, max(round(similarity, 6)) AS best FROM y WHERE similarity >= 0.3 GROUP BY 1")
def jn_15(s, d):
    """Of every part, how many others are similar, how much in all and at best: pairs are made between classes of equal tag sets only. tag_edges()
    has the pairs of parts."""
    x = G.tag_links(tagged(s, d), "p_partkey", "tags", 0.3)
    return x.select("id", "links", F.round("similarity", 6).alias("similarity"), F.round("best", 6).alias("best"))


EDGES = "edges AS (SELECT o_custkey AS src, l_suppkey AS dst, count(*)::DOUBLE AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def edges(s, d):  # noqa: ANN001, ANN201
    x = table(s, d, "orders").join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return x.groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


@query("jn_16_top_neighbours", f"WITH {EDGES} SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn FROM edges WHERE src IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) WHERE rn <= 3")
def jn_16(s, d):
    return G.neighbours(edges(s, d), table(s, d, "customer").filter("c_mktsegment = 'BUILDING'"), "c_custkey", 3)


@query("jn_17_title_containment", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON contains(lower(n_name), lower(substr(r_name, 1, 2))) OR contains(lower(r_name), lower(n_name))")
def jn_17(s, d):
    r, n = table(s, d, "region"), table(s, d, "nation")
    part = G.containing(n, "n_nationkey", F.lower("n_name"), r, "r_regionkey", F.lower(F.substring("r_name", 1, 2)))
    whole = G.containing(r, "r_regionkey", F.lower("r_name"), n, "n_nationkey", F.lower("n_name"))
    return part.unionByName(whole).distinct().select("r_regionkey", "n_nationkey")


TITLED = r"""t AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN doc_id || '_' ELSE '' END || split_part(text, chr(10), 1) AS title FROM documents),
h AS (SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages UNION ALL SELECT 100000 + doc_id, substr(split_part(text, chr(10), 1), 1, 20 + doc_id % 60) FROM documents WHERE doc_id % 7 = 3 UNION ALL SELECT 200000 + doc_id, '9_' || split_part(text, chr(10), 1) FROM documents WHERE doc_id % 11 = 5),
x AS (SELECT id, regexp_replace(title, '^\s+|\s+$', '', 'g') AS a FROM t), y AS (SELECT id, regexp_replace(title, '^\s+|\s+$', '', 'g') AS a FROM h),
tt AS (SELECT *, regexp_replace(regexp_replace(a, '^\d+_', ''), '^\s+|\s+$', '', 'g') AS b, list_distinct(regexp_extract_all(regexp_replace(a, '^[\d_]*[【（(]?[A-Z]+[】）)]?\s*', ''), '\p{L}{9,}')) AS k FROM x),
hh AS (SELECT *, regexp_replace(regexp_replace(a, '^\d+_', ''), '^\s+|\s+$', '', 'g') AS b, list_distinct(regexp_extract_all(regexp_replace(a, '^[\d_]*[【（(]?[A-Z]+[】）)]?\s*', ''), '\p{L}{9,}')) AS k FROM y),
m AS (SELECT tt.id, hh.id AS ref, CASE WHEN tt.a <> '' AND tt.a = hh.a THEN 0 WHEN tt.b <> '' AND tt.b = hh.b THEN 1
  WHEN (tt.a <> '' AND hh.a <> '' AND (contains(tt.a, hh.a) OR contains(hh.a, tt.a))) OR (tt.b <> '' AND hh.b <> '' AND (contains(tt.b, hh.b) OR contains(hh.b, tt.b))) THEN 2
  WHEN len(list_filter(list_intersect(tt.k, hh.k), lambda w: length(w) >= 12)) >= 1 OR len(list_intersect(tt.k, hh.k)) >= 2 THEN 3 END AS kind FROM tt, hh),
b AS (SELECT id, min({'kind': kind, 'ref': ref}) AS m FROM m WHERE kind IS NOT NULL GROUP BY 1)
SELECT t.id, ['equal', 'number', 'contained', 'keywords'][m.kind + 1] AS kind, m.ref AS ref FROM t LEFT JOIN b USING (id)"""


@query("jn_17_fuzzy_titles", f"WITH {TITLED}")
def jn_17_fuzzy(s, d):
    """Whole first lines of the documents, some with a number, against the titles of the pages and shortened or numbered lines."""
    x = table(s, d, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("line"))
    titles = x.select(F.col("doc_id").alias("id"), F.concat(F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("doc_id").cast("string"), F.lit("_"))).otherwise(""), F.col("line")).alias("title"))
    pages = table(s, d, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    cut = x.filter("doc_id % 7 = 3").select((F.col("doc_id") + 100000).alias("id"), F.substr("line", F.lit(1), (F.lit(20) + F.col("doc_id") % 60).cast("int")).alias("title"))
    numbered = x.filter("doc_id % 11 = 5").select((F.col("doc_id") + 200000).alias("id"), F.concat(F.lit("9_"), F.col("line")).alias("title"))
    return TI.fuzzy_titles(titles, pages.union(cut).union(numbered), r"\p{L}{9,}", 12)


@query("kg_1_reference_edges", r"WITH x AS (SELECT page_id AS src, unnest(list_distinct(regexp_extract_all(url, '/([0-9]+)', 1))) AS d FROM pages) SELECT src, try_cast(d AS BIGINT) AS dst, 1.0::DOUBLE AS weight FROM x WHERE try_cast(d AS BIGINT) <> src")
def kg_1(s, d):
    return G.reference_edges(table(s, d, "pages"), "page_id", F.col("url"), "/([0-9]+)", 1.0)


@query("kg_1_number_edges", r"WITH x AS (SELECT page_id AS src, unnest(list_distinct(regexp_extract_all(html || ' ' || lpad((page_id % 250)::VARCHAR, 3, '0') || '_a ' || lpad((page_id * 7 % 250)::VARCHAR, 3, '0') || '_b ' || lpad((page_id * 7 % 250)::VARCHAR, 3, '0') || '_c', '(\d{3})_', 1))) AS dst FROM pages) SELECT src, dst, 0.7::DOUBLE AS weight FROM x WHERE dst <> src::VARCHAR AND dst <> right(src::VARCHAR, 3)")
def kg_1_numbers(s, d):
    """Numbers of pages in whole pages, to which some are added."""
    number = lambda c: F.lpad(c.cast("string"), 3, "0")
    i = F.col("page_id")
    text = F.concat("html", F.lit(" "), number(i % 250), F.lit("_a "), number(i * 7 % 250), F.lit("_b "), number(i * 7 % 250), F.lit("_c"))
    return G.number_edges(table(s, d, "pages"), "page_id", text)


@query("kg_2_by_title", "SELECT r_regionkey, min(n_nationkey) AS n_nationkey FROM region JOIN nation ON contains(n_name, substr(r_name, 1, 1)) GROUP BY 1")
def kg_2(s, d):
    x = G.containing(table(s, d, "nation"), "n_nationkey", F.col("n_name"), table(s, d, "region"), "r_regionkey", F.substring("r_name", 1, 1))
    return x.groupBy("r_regionkey").agg(F.min("n_nationkey").alias("n_nationkey"))


@query("kg_3_domain_edges", "SELECT c_custkey AS node, c_nationkey AS domain, c_mktsegment AS category, 0.5::DOUBLE + 0.2 AS same, 0.5::DOUBLE AS other FROM customer WHERE c_nationkey IS NOT NULL")
def kg_3_all(s, d):
    """The whole relation, as membership: links_of() makes the pairs of stated nodes."""
    return G.domain_links(table(s, d, "customer"), "c_custkey", "c_nationkey", "c_mktsegment")


@query("kg_4_concepts", f"WITH {CHUNKS} SELECT unnest(labels) AS concept, count(*) AS pages FROM chunks GROUP BY 1")
def kg_4(s, d):
    return chunks(s, d).select(F.explode("labels").alias("concept")).groupBy("concept").agg(F.count(F.lit(1)).alias("pages"))


KG5 = f"""WITH {CHUNKS}, r AS (SELECT 'reference' AS kind, 'page:' || doc_id AS src, 'page:' || (doc_id + 1) AS dst, 1.0::DOUBLE AS weight FROM chunks WHERE (doc_id + 1) IN (SELECT doc_id FROM chunks)),
l AS (SELECT 'concept' AS kind, 'page:' || doc_id AS src, 'concept:' || unnest(list_distinct(labels)) AS dst, 0.6::DOUBLE AS weight FROM chunks), e AS (SELECT * FROM r UNION ALL SELECT * FROM l WHERE dst IS NOT NULL)
SELECT id, split_part(id, ':', 1) AS kind, count(*) FILTER (way = 'out') AS n_out, count(*) FILTER (way = 'in') AS n_in, round(sum(weight), 6) AS weight FROM (SELECT src AS id, 'out' AS way, weight FROM e UNION ALL SELECT dst, 'in', weight FROM e) GROUP BY 1, 2"""


@query("kg_5_built_graph", KG5)
def kg_5(s, d):
    """Pages and labels to nodes and edges, written as one version and read back."""
    x = chunks(s, d).select(F.col("doc_id").alias("page"), "labels")
    links = x.select("page", (F.col("page") + 1).alias("to"))
    path = TB.scratch(s, "graph")
    TB.replace_all({n: (t, ["kind"]) for n, t in zip(("nodes", "edges"), G.build(x, "page", "labels", links), strict=True)}, path)
    at = TB.at(s, path)
    nodes, edges_ = s.read.parquet(f"{at}/nodes"), s.read.parquet(f"{at}/edges")
    ends = edges_.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), "weight"), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), "weight"))))
    sums = ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), F.round(F.sum("weight"), 6).alias("weight"))
    return nodes.join(sums, "id").select("id", "kind", "n_out", "n_in", "weight")


PR = "WITH " + EDGES + ", g AS (SELECT 'c' || src AS src, 's' || dst AS dst, weight FROM edges UNION ALL SELECT 's' || dst, 'c' || src, weight FROM edges), n AS (SELECT DISTINCT src AS id FROM g), o AS (SELECT src, sum(weight) AS total FROM g GROUP BY 1), t AS (SELECT g.src, dst, weight / total AS p FROM g JOIN o USING (src)), k AS (SELECT count(*) AS n FROM n), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM n, k)" + "".join(f", r{i + 1} AS (SELECT dst AS id, 0.15 / any_value(k.n) + 0.85 * sum(p * r) AS r FROM t JOIN r{i} ON r{i}.id = t.src, k GROUP BY 1)" for i in range(5))


@query("kg_10_importance", PR + " SELECT id, round(r, 9) AS importance FROM r5")
def kg_10(s, d):
    """Customers have even numbers and suppliers odd ones until the ranks are there: numbers are joined faster than names."""
    way = lambda a, b: F.struct(a.alias("src"), b.alias("dst"), "weight")
    customer, supplier = 2 * F.col("src"), 2 * F.col("dst") + 1
    both = edges(s, d).select(F.inline(F.array(way(customer, supplier), way(supplier, customer))))
    name = F.concat(F.when(F.col("id") % 2 == 0, "c").otherwise("s"), F.floor(F.col("id") / 2).cast("string"))
    return G.importance(both, TB.scratch(s, "importance"), 5).select(name.alias("id"), F.round("importance", 9).alias("importance"))


@query("kg_10_paths", f"WITH {EDGES}, g AS (SELECT src, dst FROM edges WHERE weight >= 2), a AS (SELECT DISTINCT dst FROM g WHERE src = 1), b AS (SELECT DISTINCT g.src FROM g JOIN a USING (dst) WHERE g.src <> 1) SELECT src AS id, 2 AS hops FROM b UNION ALL SELECT -dst - 1, 1 FROM a")
def kg_10_paths(s, d):
    """Customers two steps from customer 1, over shared suppliers; suppliers are numbered below zero."""
    e = edges(s, d).filter("weight >= 2").select("src", (-F.col("dst") - 1).alias("dst"))
    both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return G.within(both, s.createDataFrame([(1,)], "id bigint"), 2).filter("hops > 0")


WAYS = f"WITH {EDGES}, e AS (SELECT src, -dst - 1 AS dst, CAST(floor(60 / weight) AS BIGINT) + 1 AS cost FROM edges), g AS (SELECT * FROM e UNION ALL SELECT dst, src, cost FROM e), k0 AS (SELECT s AS start, s AS id, 0::BIGINT AS cost, 0 AS hops, NULL::BIGINT AS via FROM (VALUES (1::BIGINT), (2), (7)) t(s))" + "".join(f", k{i + 1} AS (SELECT start, id, w.cost AS cost, w.hops AS hops, w.via AS via FROM (SELECT start, id, min({{'cost': cost, 'hops': hops, 'via': via}}) AS w FROM (SELECT * FROM k{i} UNION ALL SELECT start, dst, k.cost + g.cost, k.hops + 1, src FROM k{i} k JOIN g ON g.src = k.id) GROUP BY 1, 2))" for i in range(4))


@query("kg_10_weighted_paths", WAYS + " SELECT start, id, cost, hops, coalesce(via, 0) AS via FROM k4")
def kg_10_ways(s, d):
    """From three customers, over suppliers that are cheaper the more lines they share, in four hops at most."""
    e = edges(s, d).select("src", (-F.col("dst") - 1).alias("dst"), (F.floor(60 / F.col("weight")) + 1).alias("cost"))
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), "cost")
    both = e.select(F.inline(F.array(way("src", "dst"), way("dst", "src"))))
    path = TB.scratch(s, "ways")
    both.hint("rebalance", F.col("dst")).write.parquet(f"{path}/edges")
    found = G.shortest(s.read.parquet(f"{path}/edges"), s.createDataFrame([(1,), (2,), (7,)], "id bigint"), path, 4)
    return found.select("start", "id", "cost", "hops", F.coalesce("via", F.lit(0)).alias("via"))


@query("kg_6_neighbours", f"WITH {EDGES} SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn FROM edges WHERE weight >= 2 AND src IN (1, 2, 4)) WHERE rn <= 5")
def kg_6(s, d):
    return G.neighbours(edges(s, d), table(s, d, "customer").filter("c_custkey IN (1, 2, 4)"), "c_custkey", 5, 2.0)


@query("kg_7_edges_of", f"WITH {EDGES} SELECT 'out' AS way, dst AS other, weight FROM edges WHERE src = 4 UNION ALL SELECT 'in', src, weight FROM edges WHERE dst = 4")
def kg_7(s, d):
    e = edges(s, d)
    return e.filter("src = 4").select(F.lit("out").alias("way"), F.col("dst").alias("other"), "weight").union(e.filter("dst = 4").select(F.lit("in").alias("way"), F.col("src").alias("other"), "weight"))


@query("kg_8_expansion", f"WITH {EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn FROM edges WHERE src <= 20 AND weight >= 1) SELECT DISTINCT dst AS id, 0.4::DOUBLE AS distance FROM r WHERE rn <= 2 AND dst NOT IN (SELECT c_custkey FROM customer WHERE c_custkey <= 20)")
def kg_8(s, d):
    hits = table(s, d, "customer").filter("c_custkey <= 20")
    found = G.neighbours(edges(s, d), hits, "c_custkey", 2, 1.0).select(F.col("dst").alias("id")).distinct()
    return found.join(hits.select(F.col("c_custkey").alias("id")), "id", "left_anti").withColumn("distance", F.lit(0.4))


@query("kg_9_typed_graph", "SELECT kind, count(*) AS n FROM (SELECT 'segment' AS kind, c_mktsegment AS v FROM customer UNION SELECT 'nation', n_name FROM nation UNION SELECT 'region', r_name FROM region) GROUP BY 1")
def kg_9(s, d):
    k = lambda name, col, t: table(s, d, t).select(F.lit(name).alias("kind"), F.col(col).alias("v"))
    return k("segment", "c_mktsegment", "customer").union(k("nation", "n_name", "nation")).union(k("region", "r_name", "region")).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


#: Endings that make a part's name a system item in these tables.
PARTS = {"widget": "Widget", "bolt": "Bolt", "Brand#5": "Brand"}
MENTIONED = """k AS (SELECT p_partkey AS page, p_name AS title, p_brand AS label, p_type AS function, unnest([p_name, upper(p_name), p_brand]) AS keyword FROM part),
i AS (SELECT *, CASE WHEN keyword LIKE '%Brand#5' THEN 'Brand' WHEN keyword LIKE '%widget' THEN 'Widget' WHEN keyword LIKE '%bolt' THEN 'Bolt' END AS item FROM k),
m AS (SELECT page, 'Page:' || page AS src, 'DESCRIBES' AS relation, 'Function:' || lower(function) AS dst FROM (SELECT DISTINCT page, function FROM k)
  UNION ALL SELECT page, 'Function:' || lower(function), 'ASSOCIATED_WITH', 'Keyword:' || regexp_replace(lower(keyword), '[\\s\\p{P}]+', '', 'g') FROM k
  UNION ALL SELECT page, 'Function:' || lower(function), 'CONTAINS', 'SystemItem:' || regexp_replace(lower(keyword), '[\\s\\p{P}]+', '', 'g') FROM i WHERE item IS NOT NULL
  UNION ALL SELECT page, 'Page:' || page, 'TAGGED_WITH', 'Label:' || regexp_replace(lower(label), '[\\s\\p{P}]+', '', 'g') FROM (SELECT DISTINCT page, label FROM k))"""


def typed(s, d):  # noqa: ANN001, ANN201
    """Parts as pages: a function from the type, keywords from the name (in two spellings) and the brand, a label from the brand."""
    x = table(s, d, "part")
    known = x.select(F.col("p_partkey").alias("page"), F.create_map("p_type", F.array("p_name", F.upper("p_name"), "p_brand")).alias("functions"))
    pages = x.select(F.col("p_partkey").alias("page"), F.col("p_name").alias("title"), F.array("p_brand").alias("labels"))
    return G.typed_graph(known, pages, TB.scratch(s, "typed"), PARTS)


@query("kg_9_typed_nodes", f"WITH {MENTIONED} SELECT split_part(id, ':', 1) AS type, id, count(DISTINCT page) AS pages FROM (SELECT page, src AS id FROM m UNION ALL SELECT page, dst FROM m) GROUP BY id")
def kg_9_nodes(s, d):
    return typed(s, d)[0].select("type", "id", "pages")


@query("kg_9_typed_edges", f"WITH {MENTIONED}, r AS (SELECT src, dst, min(src) OVER (PARTITION BY dst) AS first FROM m WHERE relation = 'DESCRIBES') SELECT src, relation, dst, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT src, 'RELATES_TO', first, count(*) FROM r WHERE src <> first GROUP BY ALL")
def kg_9_edges(s, d):
    return typed(s, d)[1].select("src", "relation", "dst", "n")


@query("agg_26_graph_stats", f"WITH {EDGES}, e AS (SELECT 'c' || src AS id FROM edges UNION ALL SELECT 's' || dst FROM edges) SELECT id, count(*) AS degree FROM e GROUP BY 1 ORDER BY degree DESC, id LIMIT 10")
def agg_26(s, d):
    e = edges(s, d).select(F.concat(F.lit("c"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("dst").cast("string")).alias("dst"))
    return G.degrees(e).orderBy(F.desc("degree"), "id").limit(10)


EVAL = BATCH + ", x AS (SELECT r.*, a.label = b.label AS hit, a.label FROM r JOIN embeddings a ON a.vec_id = r.q JOIN embeddings b ON b.vec_id = r.id WHERE rank <= 10), n AS (SELECT label, count(*) AS total FROM embeddings GROUP BY 1), e AS (SELECT q, count(*) FILTER (hit) AS hits, any_value(total) AS total, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM x JOIN n USING (label) GROUP BY 1)"


def evaluated(s, d):  # noqa: ANN001, ANN201
    v = vectors(s, d)
    r = V.batch_knn(v, "embedding", "vec_id", v.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    a, b = v.select(F.col("vec_id").alias("q"), F.col("label").alias("la")), v.select(F.col("vec_id").alias("id"), F.col("label").alias("lb"))
    x = r.join(a, "q").join(b, "id").join(v.groupBy(F.col("label").alias("la")).agg(F.count(F.lit(1)).alias("total")), "la")
    hit = F.col("la") == F.col("lb")
    return x.groupBy("q").agg(F.count_if(hit).alias("hits"), F.first("total").alias("total"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))


@query("evl_1_precision_recall", EVAL + " SELECT q, round(hits / 10.0, 6)::DOUBLE AS precision, round(hits / total, 6) AS recall, round(coalesce(2.0 * hits / nullif(10 + total, 0), 0), 6)::DOUBLE AS f1 FROM e")
def evl_1(s, d):
    h, t = F.col("hits"), F.col("total")
    return evaluated(s, d).select("q", F.round(h / 10.0, 6).alias("precision"), F.round(h / t, 6).alias("recall"), F.round(2.0 * h / (10 + t), 6).alias("f1"))


@query("evl_7_ndcg", EVAL + ", i AS (SELECT sum(1 / log2(k + 1)) AS ideal FROM range(1, 11) t(k)) SELECT q, round(dcg / ideal, 6) AS ndcg FROM e, i")
def evl_7(s, d):
    from math import log2

    return evaluated(s, d).select("q", F.round(F.col("dcg") / sum(1 / log2(k + 1) for k in range(1, 11)), 6).alias("ndcg"))


@query("evl_2_score_consistency", BATCH + " SELECT q, count(*) AS n, round(avg(dist), 6) AS mean, round(stddev_pop(dist), 6) AS std, round(max(dist) - min(dist), 6) AS spread FROM r WHERE rank <= 10 GROUP BY 1")
def evl_2(s, d):
    v = vectors(s, d)
    r = V.batch_knn(v, "embedding", "vec_id", v.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    x = F.col("distance")
    return r.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"), F.round(F.max(x) - F.min(x), 6).alias("spread"))


@query("evl_3_keyword_quality", "WITH k AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS got, ['the', 'tion', 'la'] AS ideal FROM benchmark), m AS (SELECT *, len(list_filter(ideal, lambda i: len(list_filter(got, lambda g: contains(g, i))) > 0)) AS found, len(list_filter(got, lambda g: contains(g, 'the') OR contains(g, 'tion') OR contains(g, 'la'))) AS good FROM k) SELECT item_id, round(found / 3.0::DOUBLE, 6) AS recall, round(good / len(got), 6) AS precision FROM m")
def evl_3(s, d):
    ideal = F.array(*map(F.lit, ("the", "tion", "la")))
    x = table(s, d, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("got"))
    found = F.size(F.filter(ideal, lambda i: F.exists("got", lambda g: F.contains(g, i))))
    right = F.size(F.filter("got", lambda g: F.exists(ideal, lambda i: F.contains(g, i))))
    return x.select("item_id", F.round(found / 3.0, 6).alias("recall"), F.round(right / F.size("got"), 6).alias("precision"))


@query("evl_4_rubric", "WITH c AS (SELECT doc_id, [1 + doc_id % 5, 1 + doc_id % 4, 3 + doc_id % 3, 2 + doc_id % 4, 1 + doc_id % 3] AS s FROM documents) SELECT doc_id, list_avg(s) >= 3.5 AND list_min(s) >= 2 AND s[1] >= 3 AS passed FROM c")
def evl_4(s, d):
    i = F.col("doc_id")
    x = table(s, d, "documents").select("doc_id", F.array(1 + i % 5, 1 + i % 4, 3 + i % 3, 2 + i % 4, 1 + i % 3).alias("s"))
    mean = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, v: a + v) / 5
    return x.select("doc_id", ((mean >= 3.5) & (F.array_min("s") >= 2) & (F.get("s", F.lit(0)) >= 3)).alias("passed"))


@query("evl_5_recall_of_cells", f"{BATCH} SELECT count(DISTINCT q) AS queries, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS least, round(avg(dist), 6) AS exact_mean, true AS recalled, true AS part_read FROM r WHERE rank <= 10")
def evl_5(s, d):
    """Recall at 10 of two searches over all their queries, by another operator's exact rows. Of the search by cells, which probes until no other cell can
    be nearer: on average and at least, both all. Of the quantized index: at least 0.9, from less than nine tenths of the codes."""
    q = vectors(s, d).filter("vec_id % 100 = 0")
    exact = V.batch_knn(vectors(s, d), "embedding", "vec_id", q, "vec_id", "embedding", 10).select("q", "id", "distance")
    cells = knn_4(s, d).select("q", F.col("vec_id").alias("id"), F.lit(1).alias("near"))
    each = exact.join(cells, ["q", "id"], "left").join(found_by_codes(s, d).select("q", "id", F.lit(1).alias("hit")), ["q", "id"], "left")
    each = each.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.count("near").alias("near"), F.count("hit").alias("hit"), F.sum("distance").alias("distance"))
    index = vector_index(s, d)
    share = index.share_read(q, "embedding", probed(index))
    recall = F.col("near") / F.col("n")
    x = each.agg(F.count("q").alias("queries"), F.avg(recall).alias("recall"), F.min(recall).alias("least"), F.round(F.sum("distance") / F.sum("n"), 6).alias("exact_mean"), (F.sum("hit") >= 0.9 * F.sum("n")).alias("recalled"))
    return x.withColumn("part_read", F.lit(share < 0.9))


@query("evl_6_cosine", "WITH q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], qv), 6) AS distance FROM embeddings, q ORDER BY list_cosine_distance(embedding::DOUBLE[], qv), vec_id LIMIT 20")
def evl_6(s, d):
    from .retrieval import probe

    x = V.knn(vectors(s, d), "embedding", "vec_id", probe(s, d), 20, "cosine")
    return x.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))


@query("evl_8_moments", "WITH x AS (SELECT unnest(embedding)::DOUBLE AS v, label FROM embeddings), m AS (SELECT label, avg(v) AS mu, stddev_pop(v) AS sd FROM x GROUP BY 1) SELECT label, round(min(v), 6) AS low, round(max(v), 6) AS high, round(any_value(mu), 6) + 0 AS mean, round(any_value(sd), 6) AS std, round(avg(power((v - mu) / sd, 3)), 5) AS skew, round(avg(power((v - mu) / sd, 4)) - 3, 5) AS kurt FROM x JOIN m USING (label) GROUP BY 1")
def evl_8(s, d):
    v = F.col("v")
    x = vectors(s, d).select("label", F.explode(F.col("embedding").cast("array<double>")).alias("v"))
    return x.groupBy("label").agg(F.round(F.min(v), 6).alias("low"), F.round(F.max(v), 6).alias("high"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.round(F.skewness(v), 5).alias("skew"), F.round(F.kurtosis(v), 5).alias("kurt"))


@query("evl_9_nearest_rank", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(CASE WHEN i = least(n * 50 // 100, n - 1) THEN value END) AS p50, max(CASE WHEN i = least(n * 90 // 100, n - 1) THEN value END) AS p90 FROM r GROUP BY 1")
def evl_9(s, d):
    return A.nearest_ranks(table(s, d, "events"), "event_type", "value", {"p50": 50, "p90": 90})


@query("evl_10_bands", BATCH + " SELECT q, count(*) FILTER (dist < 0.3) AS good, count(*) FILTER (dist >= 0.3 AND dist < 0.6) AS fair, count(*) FILTER (dist >= 0.6) AS poor FROM r WHERE rank <= 10 GROUP BY 1")
def evl_10(s, d):
    v = vectors(s, d)
    x = F.col("distance")
    r = V.batch_knn(v, "embedding", "vec_id", v.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    return r.groupBy("q").agg(F.count_if(x < 0.3).alias("good"), F.count_if((x >= 0.3) & (x < 0.6)).alias("fair"), F.count_if(x >= 0.6).alias("poor"))


SWEEP = BATCH + """, x AS (SELECT r.q, r.dist, a.label = b.label AS hit FROM r JOIN embeddings a ON a.vec_id = r.q JOIN embeddings b ON b.vec_id = r.id WHERE rank <= 50), n AS (SELECT sum(c) AS relevant FROM (SELECT label, count(*) AS c FROM embeddings GROUP BY 1) JOIN (SELECT label FROM embeddings WHERE vec_id % 100 = 0) USING (label)),
d AS (SELECT t / 5.0::DOUBLE AS cut FROM range(3, 11) s(t)), g AS (SELECT t / 5.0::DOUBLE AS quality FROM range(2, 9) s(t)),
m AS (SELECT cut, quality, count(*) FILTER (dist <= cut) AS kept, count(*) FILTER (dist <= quality) AS good, count(*) FILTER (dist <= cut AND hit) AS hits FROM x, d, g WHERE quality <= cut GROUP BY ALL),
f AS (SELECT *, coalesce(hits / nullif(kept, 0)::DOUBLE, 0) AS precision, coalesce(hits / nullif(relevant, 0)::DOUBLE, 0) AS recall FROM m, n),
h AS (SELECT *, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM f)
SELECT cut, quality, kept, good, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, row_number() OVER (ORDER BY h.f1 DESC, cut, quality) = 1 AS best FROM h"""


@query("evl_11_threshold_sweep", SWEEP)
def evl_11(s, d):
    """Eight distance and seven quality thresholds, without those where the quality is above the distance; the cell with the best F1 is marked."""
    v = vectors(s, d)
    q = v.filter("vec_id % 100 = 0")
    r = V.batch_knn(v, "embedding", "vec_id", q, "vec_id", "embedding", 50)
    a, b = v.select(F.col("vec_id").alias("q"), F.col("label").alias("la")), v.select(F.col("vec_id").alias("id"), F.col("label").alias("lb"))
    x = r.join(a, "q").join(b, "id").select("distance", (F.col("la") == F.col("lb")).alias("hit"))
    relevant = v.groupBy("label").agg(F.count(F.lit(1)).alias("c")).join(q.select("label"), "label").agg(F.sum("c").alias("relevant"))
    return E.threshold_grid(x, "distance", "hit", relevant, [t / 5 for t in range(3, 11)], [t / 5 for t in range(2, 9)]).select("cut", "quality", "kept", "good", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "best")


METHODS = f"""{index_sql(hit=HIT, fields="'content'")}, {PROBE}, v AS (SELECT vec_id AS doc_id, {L2} / 2 AS distance FROM e, q ORDER BY {L2}, vec_id LIMIT 30), b AS (SELECT id AS doc_id, score FROM bm ORDER BY round(score, 9) DESC, id LIMIT 30),
m AS (SELECT doc_id, distance, score FROM v FULL JOIN b USING (doc_id)),
h AS (SELECT doc_id, round(CASE WHEN distance IS NOT NULL AND score IS NOT NULL THEN 0.5 * (1 - distance) + 0.5 * least(score / 10, 1) WHEN score IS NULL THEN 1 - distance ELSE least(score / 10, 1) END, 9) AS s FROM m),
t AS (SELECT 'vector' AS method, doc_id FROM (SELECT doc_id FROM v ORDER BY distance, doc_id LIMIT 20) UNION ALL SELECT 'bm25', doc_id FROM (SELECT doc_id FROM b ORDER BY round(score, 9) DESC, doc_id LIMIT 20) UNION ALL SELECT 'hybrid', doc_id FROM (SELECT doc_id FROM h ORDER BY s DESC, doc_id LIMIT 20)),
w AS (SELECT count(*) AS relevant FROM chunks WHERE contains(lower(content), 'ening')),
c AS (SELECT method, count(*) AS n, count(*) FILTER (contains(lower(content), 'ening')) AS hits FROM t LEFT JOIN chunks USING (doc_id) GROUP BY 1),
fm AS (SELECT method, 2.0 * hits / nullif(n + relevant, 0) AS f1 FROM c, w)
SELECT round(any_value(f1) FILTER (method = 'vector'), 6)::DOUBLE AS vector, round(any_value(f1) FILTER (method = 'bm25'), 6)::DOUBLE AS bm25, round(any_value(f1) FILTER (method = 'hybrid'), 6)::DOUBLE AS hybrid,
round(coalesce(any_value(f1) FILTER (method = 'vector'), 0) / coalesce(nullif(any_value(f1) FILTER (method = 'bm25'), 0), 0.001), 6)::DOUBLE AS vector_bm25, round(coalesce(any_value(f1) FILTER (method = 'bm25'), 0) / coalesce(nullif(any_value(f1) FILTER (method = 'hybrid'), 0), 0.001), 6)::DOUBLE AS bm25_hybrid FROM fm"""


@query("evl_12_method_ratios", f"WITH {METHODS}")
def evl_12(s, d):
    """F1 of vector, text and hybrid search for the documents with a keyword, and their ratios; a ratio to 0 is to 0.001."""
    near, text = sources(s, d)
    hybrid = FU.two_source_rank(near, text, "doc_id", 20).select("doc_id")
    found = {"vector": near.orderBy("distance", "doc_id").limit(20), "bm25": text.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(20), "hybrid": hybrid}
    relevant = chunks(s, d).select("doc_id", F.contains(F.lower("content"), F.lit("ening")).alias("relevant"))
    f1 = E.f1_by_method({k: x.select("doc_id") for k, x in found.items()}, relevant, "doc_id")
    ratio = lambda a, b: F.round(F.coalesce(F.col(a), F.lit(0.0)) / F.coalesce(F.nullif(F.col(b), F.lit(0.0)), F.lit(0.001)), 6)
    return f1.select(*[F.round(c, 6).alias(c) for c in found], ratio("vector", "bm25").alias("vector_bm25"), ratio("bm25", "hybrid").alias("bm25_hybrid"))


@query("evl_13_ranking_consistency", BATCH + ", t AS (SELECT * FROM r WHERE rank <= 30) SELECT a.q AS qa, b.q AS qb, count(*) AS common, bool_and(abs(a.rank - b.rank) <= 30) AS near, round(greatest(0, 1 - coalesce(stddev_pop(a.dist) / nullif(avg(a.dist), 0), 0)), 6) AS consistency FROM t a JOIN t b ON a.id = b.id AND a.q < b.q GROUP BY 1, 2")
def evl_13(s, d):
    v = vectors(s, d)
    t = V.batch_knn(v, "embedding", "vec_id", v.filter("vec_id % 100 = 0"), "vec_id", "embedding", 30)
    a, b = t.select("id", F.col("q").alias("qa"), F.col("distance").alias("da"), F.col("rank").alias("ra")), t.select("id", F.col("q").alias("qb"), F.col("rank").alias("rb"))
    x = a.join(b, "id").filter("qa < qb").groupBy("qa", "qb")
    spread = F.coalesce(F.try_divide(F.stddev_pop("da"), F.avg("da")), F.lit(0.0))
    return x.agg(F.count(F.lit(1)).alias("common"), F.bool_and(F.abs(F.col("ra") - F.col("rb")) <= 30).alias("near"), F.round(F.greatest(F.lit(0.0), 1 - spread), 6).alias("consistency"))


@query("evl_14_vector_diff", "WITH p AS (SELECT vec_id, [x / 127.0 FOR x IN [round(v::DOUBLE * 127) FOR v IN embedding]] AS b, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 7 <> 0), x AS (SELECT vec_id, [abs(a[i] - b[i]) FOR i IN range(1, len(a) + 1)] AS diff FROM p) SELECT e.vec_id, CASE WHEN diff IS NULL THEN 'removed' WHEN list_max(diff) < 0.0001 THEN 'same' ELSE 'changed' END AS state, round(list_max(diff), 6) AS max_diff, round(list_avg(diff), 6) AS mean_diff FROM embeddings e LEFT JOIN x USING (vec_id)")
def evl_14(s, d):
    """A snapshot against one that went through bytes (127 steps) and lost every seventh row."""
    v = vectors(s, d)
    stored = v.filter("vec_id % 7 <> 0").select("vec_id", F.transform(F.transform("embedding", lambda x: F.round(x.cast("double") * 127)), lambda x: x / 127.0).alias("embedding"))
    x = E.vector_diff(v, stored, "vec_id", "embedding")
    return x.select("vec_id", "state", F.round("max_diff", 6).alias("max_diff"), F.round("mean_diff", 6).alias("mean_diff"))


@query("dq_1_vector_lengths", "SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong, count(*) FILTER (vec_id IS NULL) AS no_key FROM embeddings")
def dq_1(s, d):
    return vectors(s, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") != 64).alias("wrong"), F.count_if(F.col("vec_id").isNull()).alias("no_key"))


@query("dq_2_types", "SELECT CASE WHEN json_type(v) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'number' WHEN json_type(v) = 'VARCHAR' THEN 'string' ELSE 'null' END AS kind, count(*) AS n FROM (SELECT CASE event_id % 5 WHEN 0 THEN '\"' || event_id || '\"' WHEN 1 THEN 'null' ELSE event_id::VARCHAR END::JSON AS v FROM events) GROUP BY 1")
def dq_2(s, d):
    """A key column of a record store, where keys came as numbers, as texts and not at all."""
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, F.concat(F.lit('"'), i.cast("string"), F.lit('"'))).when(i % 5 == 1, "null").otherwise(i.cast("string"))
    return E.runtime_types(table(s, d, "events").select(raw.alias("v")), "v")


@query("dq_3_label_frequency", f"WITH {CHUNKS} SELECT unnest(labels) AS label, count(*) AS n FROM chunks GROUP BY 1 ORDER BY n DESC, label")
def dq_3(s, d):
    return chunks(s, d).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


@query("dq_4_labelled_pages", f"WITH {CHUNKS} SELECT count(*) FILTER (len(labels) > 0) AS pages, sum(len(labels))::BIGINT AS labels FROM chunks")
def dq_4(s, d):
    return chunks(s, d).agg(F.count_if(F.size("labels") > 0).alias("pages"), F.sum(F.size("labels")).alias("labels"))


@query("dq_5_title_prefix", f"WITH {CHUNKS} SELECT doc_id FROM chunks WHERE title >= 'Of' AND title < 'Og' AND starts_with(title, 'Of')")
def dq_5(s, d):
    return chunks(s, d).filter((F.col("title") >= "Of") & (F.col("title") < "Og") & F.startswith("title", F.lit("Of"))).select("doc_id")


@query("dq_6_missing_labels", "SELECT d.doc_id, CASE WHEN length(text) >= 100 THEN 'rule' ELSE 'model' END AS by FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def dq_6(s, d):
    x = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti")
    return x.select("doc_id", F.when(F.length("text") >= 100, "rule").otherwise("model").alias("by"))


@query("dq_7_category_means", "SELECT source, lang, round(avg(n_chars), 6) AS mean FROM documents GROUP BY ALL")
def dq_7(s, d):
    return table(s, d, "documents").groupBy("source", "lang").agg(F.round(F.avg("n_chars"), 6).alias("mean"))


@query("stream_1_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stream_1(s, d):
    x = SW.windowed(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour")
    return x.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "errors", F.round("mean", 6).alias("mean"))


@query("stream_2_sliding", "SELECT strftime(date_trunc('day', ts) + INTERVAL 2 HOUR * (hour(ts) // 2) - INTERVAL 2 HOUR * k, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events, range(12) t(k) GROUP BY 1")
def stream_2(s, d):
    x = SW.windowed(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "24 hours", "2 hours")
    return x.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("stream_3_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM k GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1")
def stream_3(s, d):
    x = SW.sessions(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "30 minutes")
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))
