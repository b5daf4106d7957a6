"""Queries on filters, projections, text, chunks, keywords and labels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import chunks as C
from quarry.functions import substrings as SS
from quarry.functions import text as T
from quarry.operators import bm25 as BM
from quarry.operators import filters as FL
from quarry.operators import incremental as I
from quarry.operators import lattice as LT
from quarry.operators import lexicon as LX
from quarry.operators.analytics import normalise_message
from quarry.sources import tables as TB

from .registry import query, saved, short_batches, table
from .retrieval import CHUNKS, chunks


def docs(s, d):  # noqa: ANN001, ANN201
    return table(s, d, "documents")


def _filter(name: str, where: str, cond) -> None:  # noqa: ANN001
    """Chunks that pass a predicate."""

    @query(name, f"WITH {CHUNKS} SELECT doc_id FROM chunks WHERE {where}")
    def plan(s, d):
        return chunks(s, d).filter(cond()).select("doc_id")


LOW = "list_transform(labels, lambda x: lower(x))"
_filter("flt_1_predicate", "source = 'src3'", lambda: F.expr("source = 'src3'"))
_filter("flt_2_key_range", "doc_id >= 42 AND doc_id < 43", lambda: F.col("doc_id") == 42)
_filter("flt_3_in_list", "doc_id IN (1, 5, 9, 900)", lambda: F.col("doc_id").isin(1, 5, 9, 900))
_filter("flt_4_like", "title LIKE '%the%'", lambda: F.contains("title", F.lit("the")))
_filter("flt_6_exclude_list", f"NOT list_has_any({LOW}, ['src0', 'src1', 'src2'])", lambda: ~FL.has_any(F.col("labels"), FL.excludes(["src0"], {"a": ["src1", "src2"], "b": ["src9"]}, ["b"])))
_filter("flt_7_exclude_labels", f"NOT list_has_any({LOW}, ['en'])", lambda: ~FL.has_any(F.col("labels"), ["EN"]))
_filter("flt_8_include_labels", f"list_has_any({LOW}, ['fr', 'src4'])", lambda: FL.has_any(F.transform("labels", lambda x: x), ["FR", "src4"]))
def _wide(c):  # noqa: ANN001, ANN202
    """Capital letters as full-width ones, which are the same in compatibility form."""
    return F.translate(F.upper(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))


_filter("flt_8_normalised_labels", f"list_has_any({LOW}, ['fr', 'src4'])", lambda: F.arrays_overlap(T.normalised_labels(F.transform("labels", lambda x: F.concat(F.lit(" "), _wide(x)))), F.array(F.lit("fr"), F.lit("src4"))))
_filter("flt_10_distance_band", "(doc_id % 200) / 100.0 <= 1.5 AND (doc_id % 200) / 100.0 >= 0.5", lambda: (F.col("doc_id") % 200 / 100.0).between(0.5, 1.5))
_filter("flt_11_short_content", "length(content) >= 100", lambda: F.length("content") >= 100)
_filter("flt_12_meetings", "NOT regexp_matches(title, '(?i)meeting|minutes|standup|retrospective|agenda|kickoff|weekly|sync notes')", lambda: ~FL.any_match(F.col("title"), FL.MEETING))
_filter("flt_13_deprecated", "coalesce(lower(labels[1]) <> 'de', true)", lambda: ~F.lower(F.get("labels", F.lit(0))).eqNullSafe("de"))
_filter("flt_15_notifications", "NOT regexp_matches(title, '(?i)mail|notification')", lambda: ~FL.any_match(F.col("title"), ["mail", "notification"]))
_filter("flt_17_ingest_exclusion", "NOT (list_has_any(labels, ['src7']) OR contains(title, 'Of') OR length(content) < 100)", lambda: ~(F.arrays_overlap("labels", F.array(F.lit("src7"))) | F.contains("title", F.lit("Of")) | (F.length("content") < 100)))


STRUCT = "st AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'spec' WHEN 1 THEN 'meeting' ELSE 'guide' END AS structured_category, lang AS structured_domain, CASE WHEN doc_id % 2 = 0 THEN 'approved' ELSE 'draft' END AS structured_status, (doc_id % 10) / 10.0::DOUBLE AS structured_confidence, doc_id % 7 <> 0 AS structured_is_valid FROM documents)"


def structured(s, d):  # noqa: ANN001, ANN201
    i = F.col("doc_id")
    return docs(s, d).select("doc_id", F.when(i % 3 == 0, "spec").when(i % 3 == 1, "meeting").otherwise("guide").alias("structured_category"), F.col("lang").alias("structured_domain"), F.when(i % 2 == 0, "approved").otherwise("draft").alias("structured_status"), (i % 10 / F.lit(10.0)).alias("structured_confidence"), (i % 7 != 0).alias("structured_is_valid"))


@query("flt_5_label_filter", f"WITH {STRUCT} SELECT doc_id FROM st WHERE structured_category = 'spec' AND structured_domain IN ('en', 'fr') AND structured_confidence >= 0.5 AND structured_is_valid")
def flt_5(s, d):
    return structured(s, d).filter(FL.LabelFilter().category("spec").domain("en", "fr").min_confidence(0.5).only_valid().build()).select("doc_id")


@query("flt_9_labels_without", f"WITH {CHUNKS} SELECT doc_id, list_filter(labels, lambda x: lower(x) <> 'en') AS labels FROM chunks")
def flt_9(s, d):
    return chunks(s, d).select("doc_id", FL.without(F.col("labels"), ["EN"]).alias("labels"))


@query("flt_14_valid_pages", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE CASE WHEN l.doc_id IS NOT NULL THEN l.quality = 1 ELSE length(text) >= 100 END")
def flt_14(s, d):
    labels = table(s, d, "labels").select("doc_id", (F.col("quality") == 1).alias("valid"))
    return FL.valid_pages(docs(s, d), labels, "doc_id", "valid", "text").select("doc_id")


@query("flt_16_facets", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AND event_type = 'click'")
def flt_16(s, d):
    return FL.facets(table(s, d, "events"), "2024-01-10 00:00:00", "2024-01-20 00:00:00", "ts", {"event_type": "click"}).select("event_id")


@query("flt_18_dashboard", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-01-01' AND o_orderstatus IN ('O', 'F') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flt_18(s, d):
    x = table(s, d, "orders").filter(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1997-01-01").cast("timestamp_ntz")))
    return x.filter(F.col("o_orderstatus").isin("O", "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("flt_19_logs", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND user_id IN (1, 2, 3) AND (contains(props, '8') OR event_type = 'error')")
def flt_19(s, d):
    x = table(s, d, "events").filter((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & F.col("user_id").isin(1, 2, 3))
    return x.filter(F.contains("props", F.lit("8")) | (F.col("event_type") == "error")).select("event_id")


@query("flt_20_ticket_search", "SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'urg') OR contains(lower(o_orderstatus), 'p') OR contains(CAST(o_orderkey AS VARCHAR), '77') ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def flt_20(s, d):
    has = lambda c, v: F.contains(F.lower(F.col(c).cast("string")), F.lit(v))
    x = table(s, d, "orders").filter(has("o_orderpriority", "urg") | has("o_orderstatus", "p") | has("o_orderkey", "77"))
    return x.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey")


@query("flt_21_query_builder", "SELECT event_id FROM events WHERE user_id = 5 AND ts >= TIMESTAMP '2024-01-24' ORDER BY ts DESC, event_id LIMIT 25")
def flt_21(s, d):
    return FL.build_query(table(s, d, "events"), [F.col("user_id") == 5, F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")], [F.desc("ts"), F.col("event_id")], 25).select("event_id")


@query("flt_22_score_cut", "SELECT vec_id FROM embeddings WHERE embedding[1] >= 0.05 ORDER BY embedding[1] DESC, vec_id LIMIT 15")
def flt_22(s, d):
    return FL.build_query(table(s, d, "embeddings").withColumn("x", F.get("embedding", F.lit(0)).cast("double")), [F.col("x") >= 0.05], [F.desc("x"), F.col("vec_id")], 15).select("vec_id")


@query("prj_1_flatten", f"WITH {STRUCT} SELECT doc_id, structured_category, structured_status FROM st")
def prj_1(s, d):
    nested = structured(s, d).select("doc_id", F.struct(F.col("structured_category").alias("category"), F.col("structured_status").alias("status")).alias("label"))
    return nested.select("doc_id", *[F.col(f"label.{c}").alias(f"structured_{c}") for c in ("category", "status")])


@query("prj_2_normalised_record", "SELECT try_cast(replace(source, 'src', '') AS BIGINT) AS page_id, coalesce(text, '') AS content, doc_id FROM documents")
def prj_2(s, d):
    return docs(s, d).select(F.expr("try_cast(replace(source, 'src', '') AS BIGINT)").alias("page_id"), F.coalesce(T.strip_bom(F.col("text")), F.lit("")).alias("content"), "doc_id")


@query("prj_3_late_content", "SELECT doc_id, text FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def prj_3(s, d):
    top = docs(s, d).select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id")
    return docs(s, d).select("doc_id", "text").join(F.broadcast(top), "doc_id")  # twenty rows


@query("prj_4_result_rows", f"WITH {CHUNKS} SELECT doc_id, title, 'https://kb.example/wiki/spaces/' || source || '/pages/' || doc_id AS url, round(least(100, greatest(0, length(content) / 50.0)), 1) AS score FROM chunks")
def prj_4(s, d):
    url = T.page_url(F.lit(None).cast("string"), F.col("source"), F.col("doc_id"), "https://kb.example")
    return chunks(s, d).select("doc_id", "title", url.alias("url"), F.round(F.least(F.lit(100.0), F.length("content") / 50.0), 1).alias("score"))


@query("prj_5_url", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') AND contains(url, '/wiki/') THEN url ELSE 'https://kb.example/wiki/spaces/S/pages/' || page_id END AS link FROM pages")
def prj_5(s, d):
    return table(s, d, "pages").select("page_id", T.page_url(F.col("url"), F.lit("S"), F.col("page_id"), "https://kb.example").alias("link"))


@query("prj_6_defaults", "SELECT event_id, coalesce(value, 0) AS total_time, CAST(coalesce(try_cast(regexp_extract(props, '[0-9]+') AS BIGINT), 0) AS BIGINT) AS k FROM events")
def prj_6(s, d):
    return table(s, d, "events").select("event_id", F.coalesce("value", F.lit(0.0)).alias("total_time"), F.coalesce(F.expr(r"try_cast(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"), F.lit(0)).cast("bigint").alias("k"))


def _text(name: str, sql: str, column, source: str = "documents", key: str = "doc_id") -> None:  # noqa: ANN001
    @query(name, f"SELECT {key}, {sql} AS value FROM {source}" if sql else None)
    def plan(s, d):
        return table(s, d, source).select(key, column().alias("value"))


def _c(name: str):  # noqa: ANN202
    return F.col(name)


ENT = "replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
SQUEEZE = "trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g'))"
_text("str_1_bom", "replace(chr(65279) || text, chr(65279), '')", lambda: T.strip_bom(F.concat(F.lit("﻿"), F.col("text"))))
_text("str_2_html_for_index", SQUEEZE.format(ENT.format("regexp_replace(html, '<[^>]*>', '', 'g')")), lambda: T.strip_html_for_index(_c("html")), "pages", "page_id")
_text("str_3_html_to_text", SQUEEZE.format("regexp_replace(" + ENT.format("html") + ", '<[^>]*>', ' ', 'g')"), lambda: T.html_to_text(_c("html")), "pages", "page_id")
_text("str_4_html_without_scripts", SQUEEZE.format(ENT.format("regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'), '<[^>]*>', ' ', 'g')")), lambda: T.strip_html_with_bodies(_c("html")), "pages", "page_id")
_text("str_6_messages", "regexp_replace(props, '[0-9]+', '[NUMBER]', 'g')", lambda: normalise_message(_c("props")), "events", "event_id")
_text("str_7_questions", "substr(" + SQUEEZE.format(r"regexp_replace(lower(text), '[\[\](){}.,!?;:]', '', 'g')") + ", 1, 100)", lambda: T.normalise_question(_c("text")))
_text("str_8_query_words", "list_filter(string_split(" + SQUEEZE.format(r"regexp_replace(text, '[\[\](){}]', ' ', 'g')") + ", ' '), lambda w: length(w) > 1 AND lower(w) NOT IN ('the', 'la', 'der'))", lambda: T.query_words(_c("text"), ["the", "la", "der"]), "benchmark", "item_id")
_text("str_9_negative_words", "list_filter(string_split(lower(text), ' '), lambda w: w NOT IN ('the', 'la'))", lambda: F.filter(F.split(F.lower("text"), " "), lambda w: ~w.isin("the", "la")), "benchmark", "item_id")
_text("str_10_title_parts", r"trim(regexp_replace('012_' || p_name, '^[^\p{L}]*', ''))", lambda: T.title_parts(F.concat(F.lit("012_"), _c("p_name")))["cleaned"], "part", "p_partkey")
_text("str_11_clone_marker", "contains(upper(text), 'THE')", lambda: F.contains(F.upper("text"), F.lit("THE")))
_text("str_12_half_width", "translate('（' || text || '）：！', '（）：；，．！？', '():;,.!?')", lambda: T.half_width(F.concat(F.lit("（"), F.col("text"), F.lit("）：！"))))
_text("str_13_reference_marks", "regexp_extract_all('see (' || substr(source, 1, 4) || ') and (' || lang || ')', '\\(([^)]*)\\)', 1)", lambda: F.regexp_extract_all(F.concat(F.lit("see ("), F.substring("source", 1, 4), F.lit(") and ("), _c("lang"), F.lit(")")), F.lit(r"\(([^)]*)\)"), F.lit(1)))
_text("str_14_snippet", "CASE WHEN length(text) <= 100 THEN text WHEN position('tion' IN lower(text)) = 0 THEN substr(text, 1, 100) || '...' ELSE CASE WHEN greatest(1, position('tion' IN lower(text)) - 30) > 1 THEN '...' ELSE '' END || substr(text, greatest(1, position('tion' IN lower(text)) - 30), 100) || CASE WHEN greatest(1, position('tion' IN lower(text)) - 30) + 100 <= length(text) THEN '...' ELSE '' END END", lambda: T.snippet(_c("text"), "tion", 100))
_HEAD = "CASE WHEN doc_id % 10 < 3 THEN 80 WHEN doc_id % 10 < 6 THEN 120 ELSE 160 END"
_AT = "list_filter([CAST(position('tion' IN lower(text)) AS BIGINT), CAST(position('queaux' IN lower(text)) AS BIGINT)], lambda p: p > h)"
_SNIP = f"(SELECT CASE WHEN length(text) <= 200 THEN text WHEN len(a) = 0 THEN substr(text, 1, 200) ELSE substr(text, 1, h) || ' … ' || array_to_string(list_transform(a, lambda p: substr(text, greatest(h + 1, p - CAST(floor((200 - h) // len(a) * 0.3) AS BIGINT)), (200 - h) // len(a))), ' … ') END FROM (SELECT h, {_AT} AS a FROM (SELECT CAST({_HEAD} AS BIGINT) AS h)))"
_text("str_15_multi_snippet", _SNIP, lambda: T.multi_snippet(_c("text"), ["tion", "queaux"], 200, _c("doc_id") % 10 + 1))
_text("str_16_sentence_pieces", "", lambda: T.sentence_pieces(200)(_c("text")))
_text("str_17_common_substring", "", lambda: SS.longest_common(F.col("text"), F.lit("the tion of")))
_text("str_18_token_estimate", r"CAST(ceil(0.5 * length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) + 1.8 * (length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')))) AS BIGINT)", lambda: T.token_estimate(_c("text")).cast("bigint"))
_text("str_19_sha_key", "sha256(source || ':' || lang)", lambda: F.sha2(F.concat(_c("source"), F.lit(":"), _c("lang")), 256))
_text("str_19_short_hash", "CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(source, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (h * 31 + x) % 4294967296) AS BIGINT)", lambda: T.short_hash(_c("source")))
_H = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(coalesce(source, '') || coalesce(lang, '') || coalesce(source, ''), ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (h * 31 + x) % 4294967296)"
_text("str_19_base36", f"lower(to_base(abs({_H} - CASE WHEN {_H} >= 2147483648 THEN 4294967296 ELSE 0 END), 36))", lambda: T.base36_hash(F.concat(*[F.coalesce(_c(x), F.lit("")) for x in ("source", "lang", "source")])))
_text("str_20_field_names", "coalesce(map {'O': 'open', 'F': 'finished'}[o_orderstatus], o_orderstatus)", lambda: F.coalesce(F.try_element_at(F.create_map(F.lit("O"), F.lit("open"), F.lit("F"), F.lit("finished")), _c("o_orderstatus")), _c("o_orderstatus")), "orders", "o_orderkey")
_text("str_21_ticket_text", "'Status: ' || o_orderstatus || chr(10) || 'Priority: ' || o_orderpriority || chr(10) || 'Assignee: ' || o_custkey", lambda: F.concat_ws("\n", F.concat(F.lit("Status: "), _c("o_orderstatus")), F.concat(F.lit("Priority: "), _c("o_orderpriority")), F.concat(F.lit("Assignee: "), _c("o_custkey").cast("string"))), "orders", "o_orderkey")
_text("arr_1_labels", "list_filter(list_transform(string_split('[' || lang || ', \"' || source || '\"]', ','), lambda x: trim(replace(replace(replace(x, '[', ''), ']', ''), '\"', ''))), lambda x: x <> '')", lambda: T.labels_as_array(F.concat(F.lit("["), _c("lang"), F.lit(', "'), _c("source"), F.lit('"]'))))
_text("arr_2_environment", "CASE WHEN contains(url, '.com') AND contains(url, 'blog') THEN 'mixed' WHEN contains(url, '.com') THEN 'shop' WHEN contains(url, 'blog') THEN 'blog' ELSE 'unknown' END", lambda: T.environment_of(F.array("url"), {"shop": ".com", "blog": "blog"}), "pages", "page_id")
_text("jsn_1_json", "CAST(json_extract(props, '$.k') AS BIGINT)", lambda: F.from_json("props", "k bigint")["k"], "events", "event_id")
_text("dat_3_newer", "coalesce(date_diff('millisecond', o_orderdate, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + INTERVAL 1 MILLISECOND * (o_orderkey % 4 * 500) END) > 1000, true)", lambda: I.newer(F.when(_c("o_orderkey") % 9 != 0, _c("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, (o_orderkey % 4) * 0.5)")), _c("o_orderdate")), "orders", "o_orderkey")
_text("str_5_rich_text", "", lambda: T.rich_text(F.to_json(F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")))))
_text("tok_1_tokens", r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')", lambda: BM.tokens(_c("text")))
_text("tok_2_light_tokens", r"regexp_extract_all(lower(text), '([a-z0-9_]+|[^\x00-\x7F]+)', 1)", lambda: BM.light_tokens(_c("text")))
_text("tok_3_selected_tokens", r"list_filter(string_split_regex(text, '[^\p{L}\p{N}]+'), lambda t: regexp_matches(t, '^\p{Lu}'))", lambda: BM.nouns(_c("text")))
_text("kw_3_fallback_keywords", "list_filter(string_split_regex(lower(text), ' (of|la|der|de) | '), lambda w: w <> '')[1:8]", lambda: F.slice(F.filter(F.split(F.lower("text"), " (of|la|der|de) | "), lambda w: w != ""), 1, 8), "benchmark", "item_id")
_text("kw_4_word_split", r"list_filter(regexp_extract_all(text, '([a-zA-Z]+|[0-9]+|[^\x00-\x7F]+)', 1), lambda w: lower(w) NOT IN ('the', 'la'))", lambda: F.filter(F.regexp_extract_all("text", F.lit(r"([a-zA-Z]+|[0-9]+|[^\x00-\x7F]+)"), F.lit(1)), lambda w: ~F.lower(w).isin("the", "la")), "benchmark", "item_id")


@query("kw_6_domain_terms", f"WITH {CHUNKS} SELECT doc_id, len(list_filter(['the', 'tion', 'ening', 'queaux', 'ouer'], lambda w: contains(lower(content), w) AND contains(lower(title), w))) AS terms FROM chunks")
def kw_6(s, d):
    """Terms that a text, as the query, shares with a title."""
    short_batches(s)
    short_batches(s)
    n = LX.shared_terms(F.col("content"), F.col("title"), ["the", "tion", "ening", "queaux", "ouer"])
    return chunks(s, d).select("doc_id", n.cast("bigint").alias("terms"))


@query("src_10_markdown_table", r"WITH r AS (SELECT n_regionkey, n_nationkey, ['key', 'name'] AS c, -1 AS i FROM nation UNION ALL SELECT n_regionkey, n_nationkey, CASE WHEN n_nationkey % 4 = 3 THEN [' ', NULL] ELSE [n_nationkey::VARCHAR, n_name || '|x'] END, n_nationkey FROM nation), h AS (SELECT DISTINCT n_regionkey, i, [replace(trim(coalesce(x, '')), '|', '\|') FOR x IN c] AS c FROM r), l AS (SELECT n_regionkey, i, '| ' || array_to_string(c, ' | ') || ' |' AS line FROM h WHERE len(list_filter(c, lambda x: x <> '')) > 0) SELECT n_regionkey, string_agg(CASE WHEN i = -1 THEN line || chr(10) || '| --- | --- |' ELSE line END, chr(10) ORDER BY i) AS markdown FROM l GROUP BY 1")
def src_10(s, d):
    """A sheet for each region: a header, a row for each nation, blank rows between."""
    n = table(s, d, "nation")
    cells = F.when(F.col("n_nationkey") % 4 == 3, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.array(F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit("|x"))))
    header = n.select("n_regionkey").distinct().select("n_regionkey", F.lit(-1).cast("bigint").alias("i"), F.array(F.lit("key"), F.lit("name")).alias("cells"))
    rows = header.union(n.select("n_regionkey", F.col("n_nationkey").cast("bigint").alias("i"), cells.alias("cells")))
    return TB.markdown_tables(rows, "n_regionkey", "i", "cells")


@query("src_10_markdown_row", "SELECT r_regionkey, '| ' || r_regionkey || ' | ' || replace(r_name, '|', '\\|') || ' |' AS line FROM region")
def src_10b(s, d):
    return table(s, d, "region").select("r_regionkey", T.markdown_row(F.array(F.col("r_regionkey").cast("string"), "r_name")).alias("line"))


@query("src_11_csv_text", "SELECT n_nationkey, array_to_string(string_split(n_nationkey || ',' || n_name, ','), ' | ') AS line FROM nation")
def src_11(s, d):
    return table(s, d, "nation").select("n_nationkey", F.array_join(F.split(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name"), ","), " | ").alias("line"))


@query("chk_1_fixed_chunks", "WITH c AS (SELECT doc_id, text, unnest(range(0, 1 + CAST(greatest(0, ceil((length(text) - 1800) / 1600)) AS BIGINT))) AS i FROM documents WHERE length(text) > 0) SELECT doc_id, i, i * 1600 AS start, substr(text, CAST(i * 1600 + 1 AS BIGINT), 1800) AS content FROM c")
def chk_1(s, d):
    return docs(s, d).select("doc_id", F.inline(T.fixed_chunks(F.col("text"))))


# Ends and beginnings of runs of stops, then one chunk a step.
SPANS = """WITH RECURSIVE m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^。！？.!?]*[。！？.!?]+')) AS s, generate_subscripts(regexp_extract_all(text, '[^。！？.!?]*[。！？.!?]+'), 1) AS k FROM documents),
r AS (SELECT doc_id, k, CAST(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS e, length(regexp_extract(s, '[。！？.!?]+$')) AS w FROM m),
l AS (SELECT doc_id, list(e ORDER BY k) AS ends, list(e - w ORDER BY k) AS begins FROM r GROUP BY 1),
c AS (SELECT doc_id, length(text) AS n, coalesce(ends, []) AS ends, coalesce(begins, []) AS begins, 0::BIGINT AS start, CASE WHEN length(text) <= 1800 THEN length(text) ELSE coalesce(list_max(list_filter(ends, lambda e: e <= 1800 AND e > 1750)), 1800) END AS stop FROM documents LEFT JOIN l USING (doc_id) WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
  UNION ALL SELECT doc_id, n, ends, begins, start, CASE WHEN start + 1800 >= n THEN n ELSE coalesce(list_max(list_filter(ends, lambda e: e <= start + 1800 AND e > start + 1750)), start + 1800) END AS stop
  FROM (SELECT doc_id, n, ends, begins, greatest(start + 180, CASE WHEN k <= len(ends) AND begins[k] < stop THEN least(greatest(start + greatest(1, (stop - start) // 20), ends[k]), stop - 1) ELSE stop - 200 END) AS start
        FROM (SELECT *, 1 + len(list_filter(ends, lambda e: e < greatest(start, stop - 200))) AS k FROM c WHERE stop < n))),
x AS (SELECT c.doc_id, start, stop, trim(substr(text, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content FROM c JOIN documents USING (doc_id)),
y AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS i, start, stop, content FROM x WHERE content <> '')"""


@query("chk_2_sentence_chunks", SPANS + " SELECT doc_id, i, start, stop, content FROM y")
def chk_2(s, d):
    return docs(s, d).select("doc_id", F.inline(C.sentence_chunks(F.col("text"))))


EST = r"ceil(0.5 * length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) + 1.8 * (length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))))"


@query("chk_3_rebuild_chunks", f"WITH x AS (SELECT doc_id, text, substr(text, 1, 20) AS title, {EST} > 1024 AS cut FROM documents WHERE length(text) > 0), c AS (SELECT *, unnest(range(0, CASE WHEN cut THEN 1 + CAST(greatest(0, ceil((length(text) - 1600) / 1400)) AS BIGINT) ELSE 1 END)) AS i FROM x) SELECT doc_id, i, repeat(title, 3) || CASE WHEN cut THEN substr(text, CAST(i * 1400 + 1 AS BIGINT), 1600) ELSE text END AS content FROM c")
def chk_3(s, d):
    text = F.col("text")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("start"), text.alias("content")))
    x = docs(s, d).filter(F.length(text) > 0).select("doc_id", F.substring("text", 1, 20).alias("title"), F.when(T.token_estimate(text) > 1024, T.fixed_chunks(text, 1600, 200)).otherwise(whole).alias("c"))
    return x.select("doc_id", "title", F.inline("c")).select("doc_id", "i", F.concat(F.repeat("title", 3), "content").alias("content"))


@query("chk_4_conditional_chunks", SPANS + """, z AS (SELECT y.doc_id, i, content, count(*) OVER (PARTITION BY y.doc_id) AS chunks FROM y JOIN documents USING (doc_id) WHERE length(text) >= 3000 UNION ALL SELECT doc_id, 0, text, 1 FROM documents WHERE length(text) < 3000)
SELECT doc_id, CASE WHEN chunks > 1 THEN doc_id || '-' || i ELSE doc_id::VARCHAR END AS id, i AS chunk, CAST(chunks AS INT) AS chunks, content, CASE WHEN chunks > 1 THEN lang || chr(10) || chr(10) || lang || chr(10) || chr(10) || lang ELSE lang END || chr(10) || chr(10) || content AS vector_text FROM z JOIN documents USING (doc_id)""")
def chk_4(s, d):
    short_batches(s)
    return C.chunk_rows(docs(s, d), "doc_id", F.col("text"), F.col("lang"))


@query("chk_5_valid_chunks", f"WITH {CHUNKS} SELECT doc_id, CASE WHEN length(content) >= 100 AND length(regexp_replace(content, '[^\\p{{L}}]', '', 'g')) >= 20 THEN content ELSE title END AS content FROM chunks")
def chk_5(s, d):
    good = (F.length("content") >= 100) & (F.length(F.regexp_replace("content", r"[^\p{L}]", "")) >= 20)
    return chunks(s, d).select("doc_id", F.when(good, F.col("content")).otherwise(F.col("title")).alias("content"))


LEX = "lex AS (SELECT DISTINCT word AS keyword, CASE WHEN length(word) <= 4 THEN 'core' ELSE 'domain' END AS category FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part UNION ALL SELECT * FROM (VALUES ('the'), ('tion'), ('queaux'), ('ening'), ('la')) t(w)) WHERE word <> '')"
PRIO = "(CASE category WHEN 'core' THEN 100 ELSE 80 END + CASE WHEN length(keyword) BETWEEN 2 AND 8 THEN 20 ELSE 0 END)"


def lexicon(s, d):  # noqa: ANN001, ANN201
    words = table(s, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("keyword"))
    more = s.createDataFrame([(w,) for w in ("the", "tion", "queaux", "ening", "la")], "keyword string")
    x = words.union(more).filter("keyword <> ''").distinct()
    return x.withColumn("category", F.when(F.length("keyword") <= 4, "core").otherwise("domain"))


KW1 = f"""WITH {LEX}, d AS (SELECT * FROM (VALUES (0, 'english', ['the', 'ing', 'ened']), (1, 'romance', ['queaux', 'tion', 'ouer'])) t(p, domain, words)),
q AS (SELECT item_id, lower(text) AS t, CASE WHEN contains(lower(text), 'wh') THEN 'thedefinition' WHEN contains(lower(text), 'ei') THEN 'lading' ELSE 'general' END AS intent FROM benchmark),
s AS (SELECT item_id, p, domain, words, len(list_filter(words, lambda w: contains(t, w))) AS n FROM q, d),
b AS (SELECT item_id, CASE WHEN max(n) > 0 THEN arg_max(domain, (n, -p)) ELSE 'unknown' END AS domain, CASE WHEN max(n) > 0 THEN arg_max(words, (n, -p)) ELSE [] END AS words FROM s GROUP BY 1),
m AS (SELECT item_id, domain, intent, keyword, category = 'core' AS core, len(list_filter(words, lambda w: contains(keyword, w) OR contains(w, keyword))) > 0 AS near, starts_with(intent, keyword) AS asked FROM q JOIN b USING (item_id) JOIN lex ON contains(t, keyword)),
p AS (SELECT *, CAST(100 * core::INT + 80 * near::INT + 20 * (length(keyword) BETWEEN 2 AND 8)::INT AS INT) AS points FROM m WHERE core OR near OR asked),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY points DESC, keyword) AS INT) AS place FROM p)
SELECT item_id, domain, intent, keyword, points, place FROM r WHERE place <= 8"""


@query("kw_1_lexicon_keywords", KW1)
def kw_1(s, d):
    """Domain and intent of a query, and its relevant keywords by points."""
    domains = {"english": ["the", "ing", "ened"], "romance": ["queaux", "tion", "ouer"]}
    return LX.query_keywords(table(s, d, "benchmark"), "item_id", "text", lexicon(s, d), domains, {"thedefinition": ["wh"], "lading": ["ei"]}, 8)


@query("kw_1_contained_keywords", f"WITH {LEX}, m AS (SELECT item_id, keyword, {PRIO} AS priority FROM benchmark JOIN lex ON contains(lower(text), keyword)), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY priority DESC, keyword) AS rn FROM m) SELECT item_id, keyword, CAST(priority AS INT) AS priority FROM r WHERE rn <= 8")
def kw_1b(s, d):
    return LX.extract(table(s, d, "benchmark"), "item_id", "text", lexicon(s, d), 8)


@query("kw_2_category_priority", f"WITH {LEX} SELECT keyword, CAST({PRIO} AS INT) AS priority FROM lex")
def kw_2(s, d):
    return lexicon(s, d).select("keyword", LX.priority(F.col("category"), F.col("keyword")).alias("priority"))


@query("kw_5_domain_terms", "SELECT DISTINCT regexp_replace(w, '(ing|ed|s)$', '') AS term FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE length(regexp_replace(w, '(ing|ed|s)$', '')) >= 3")
def kw_5(s, d):
    return table(s, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).select(F.regexp_replace("w", "(ing|ed|s)$", "").alias("term")).filter(F.length("term") >= 3).distinct()


@query("kw_7_candidate_domains", f"WITH {LEX}, m AS (SELECT item_id, keyword, row_number() OVER (PARTITION BY item_id ORDER BY keyword) AS rn FROM benchmark JOIN lex ON contains(lower(text), keyword) WHERE category = 'domain') SELECT item_id, keyword FROM m WHERE rn <= 3")
def kw_7(s, d):
    x = LX.matches(table(s, d, "benchmark"), "item_id", "text", lexicon(s, d).filter("category = 'domain'"))
    return x.withColumn("rn", F.row_number().over(W.partitionBy("item_id").orderBy("keyword"))).filter("rn <= 3").select("item_id", "keyword")


@query("jn_18_lexicon_join", f"WITH {LEX}, m AS (SELECT item_id, category, keyword, row_number() OVER (PARTITION BY item_id, category ORDER BY keyword) AS rn FROM benchmark JOIN lex ON contains(lower(text), keyword)) SELECT item_id, category, keyword FROM m WHERE rn <= 20")
def jn_18(s, d):
    x = LX.matches(table(s, d, "benchmark"), "item_id", "text", lexicon(s, d))
    return x.withColumn("rn", F.row_number().over(W.partitionBy("item_id", "category").orderBy("keyword"))).filter("rn <= 20").select("item_id", "category", "keyword")


LBL = rf"""WITH {CHUNKS}, x AS (SELECT doc_id, title, lower(title) AS t, lower(content) AS c, labels, length(content) AS n FROM chunks),
y AS (SELECT *, substr(c, 1, 500) AS b5, substr(c, 1, 1000) AS b, t || ' ' || substr(c, 1, 1000) AS both_, t || ' ' || substr(c, 1, 800) AS tagged FROM x),
c AS (SELECT *, CASE WHEN list_contains(labels, 'src0') THEN 'spec' WHEN list_contains(labels, 'src1') THEN 'workflow' WHEN contains(t, 'tion') THEN 'spec' WHEN contains(t, 'la') THEN 'guide' WHEN contains(b5, 'ouer') THEN 'meeting' ELSE 'other' END AS cat,
  2.0 * (contains(t, 'the') OR contains(t, 'ing'))::INT + (contains(b, 'the') OR contains(b, 'ing'))::INT + 1.5 * ((contains(both_, 'the') AND contains(both_, 'wh')) OR (contains(both_, 'ing') AND contains(both_, 'sh')))::INT AS d1,
  2.0 * contains(t, 'que')::INT + contains(b, 'que')::INT AS d2, CASE WHEN contains(t, 'er') THEN 'draft' WHEN contains(t, 'on') THEN 'approved' ELSE 'unknown' END AS st FROM y),
k AS (SELECT *, (cat <> 'other')::INT + (greatest(d1, d2) > 0)::INT + (st <> 'unknown')::INT AS found, CASE cat WHEN 'other' THEN 'spec' ELSE cat END AS cat_, CASE st WHEN 'unknown' THEN 'approved' ELSE st END AS st_ FROM c)
SELECT doc_id, n >= 100 AS is_valid, CASE WHEN found >= 2 THEN cat_ END AS category, CASE WHEN found >= 2 THEN CASE WHEN greatest(d1, d2) = 0 THEN 'none' WHEN d1 >= d2 THEN 'english' ELSE 'romance' END END AS domain, CASE WHEN found >= 2 THEN st_ END AS status,
  CASE WHEN found >= 2 THEN CASE WHEN cat_ = 'spec' AND st_ = 'approved' THEN 'high' WHEN cat_ = 'spec' AND st_ = 'draft' THEN 'medium' WHEN cat_ = 'workflow' THEN 'high' WHEN cat_ = 'meeting' THEN 'low' ELSE 'medium' END END AS priority,
  CASE WHEN found >= 2 THEN list_filter([CASE WHEN contains(tagged, 'der') OR contains(tagged, 'die') THEN 'german' END, CASE WHEN contains(tagged, 'los') THEN 'spanish' END], lambda v: v IS NOT NULL) END AS tags,
  CASE WHEN found >= 2 THEN trim(regexp_replace(title, '^[^\p{{L}}]*', '')) END AS feature, CASE WHEN found >= 2 THEN round(CAST(0.7 + 0.1 * found AS DOUBLE), 6) END AS confidence FROM k"""


@query("lbl_1_rule_labels", LBL)
def lbl_1(s, d):
    rules = LX.LabelRules(
        by_label={"src0": "spec", "src1": "workflow"},
        by_title={"tion": "spec", "la": "guide"},
        by_body={"ouer": "meeting"},
        domains={"english": ["the", "ing"], "romance": ["que"]},
        pairs={"english": [["the", "wh"], ["ing", "sh"]]},
        statuses={"er": "draft", "on": "approved"},
        tags={"german": ["der", "die"], "spanish": ["los"]},
        priorities={("spec", "approved"): "high", ("spec", "draft"): "medium"},
        by_category={"workflow": "high", "meeting": "low"},
    )
    x = LX.rule_labels(chunks(s, d), F.col("title"), F.col("content"), F.col("labels"), rules)
    return x.select("doc_id", "is_valid", "category", "domain", "status", "priority", "tags", "feature", F.round("confidence", 6).alias("confidence"))


@query("lbl_2_ticket_status", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'review' ELSE 'draft' END AS status FROM orders")
def lbl_2(s, d):
    o = F.col("o_orderstatus")
    return table(s, d, "orders").select("o_orderkey", F.when(F.contains(o, F.lit("F")), "approved").when(F.contains(o, F.lit("P")), "review").otherwise("draft").alias("status"))


def learned(s, d):  # noqa: ANN001, ANN201
    """The dictionary of all documents' words, learned once."""
    return s.read.parquet(saved(s, d, "dictionary", "documents", lambda path: LT.learn(TB.spread(table(s, d, "documents").select("text")), "text").write.parquet(path)))


@query("tok_1_lattice_tokens")
def tok_1_lattice(s, d):
    """Whole texts, cut by a dictionary learned from all of them: compounds and words that no space parts."""
    short_batches(s)
    cut = BM.tokens(F.col("text"), LT.analyzer(learned(s, d)))
    return TB.spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", cut.alias("t")).select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("tok_3_lattice_nouns")
def tok_3_lattice(s, d):
    """Of the same tokens, the nouns."""
    short_batches(s)
    cut = BM.nouns(F.col("text"), LT.analyzer(learned(s, d), (LT.NOUN,)))
    return TB.spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", cut.alias("t")).select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("nouns"))


@query("tok_1_dictionary", r"SELECT word, count(*) AS n, CASE WHEN 2 * count(*) FILTER (regexp_matches(t, '^\p{Lu}')) >= count(*) THEN 'noun' ELSE 'word' END AS kind FROM (SELECT t, lower(t) AS word FROM (SELECT unnest(string_split_regex(text, '[^\p{L}\p{N}]+')) AS t FROM documents) WHERE length(t) >= 3 AND NOT regexp_matches(t, '\p{N}')) GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, word LIMIT 200000")
def tok_1_dictionary(s, d):
    return learned(s, d)


QUERY_WORDS = ["small widget", "colder", "bolt"]


@query(
    "str_17_relevance_tiers",
    f"""WITH w AS (SELECT unnest({QUERY_WORDS}) AS w), s AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM w), g AS (SELECT DISTINCT w, substr(w, i, n) AS g FROM (SELECT w, i, unnest(range(1, length(w) - i + 2)) AS n FROM s)),
c AS (SELECT p_partkey, p_name AS k, w, coalesce(max(length(g)) FILTER (contains(p_name, g)), 0) AS common FROM part, g GROUP BY ALL),
r AS (SELECT p_partkey, max(common) AS common, max(CASE WHEN k = w THEN 1.0::DOUBLE ELSE greatest(CASE WHEN contains(k, w) THEN 0.9::DOUBLE ELSE 0 END, CASE WHEN contains(w, k) THEN 0.8::DOUBLE ELSE 0 END, CASE WHEN common >= 2 THEN common / greatest(length(k), length(w))::DOUBLE ELSE 0 END) END) AS score FROM c GROUP BY 1)
SELECT p_partkey, CAST(common AS INT) AS common, common >= 4 AS shares_four, round(score, 6) AS score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' WHEN score >= 0.2 THEN 'low' END AS tier FROM r""",
)
def str_17_tiers(s, d):
    x = table(s, d, "part").select("p_partkey", SS.common_with(s, F.col("p_name"), QUERY_WORDS)["length"].alias("common"), SS.relevance(F.col("p_name"), QUERY_WORDS).alias("score"))
    return x.select("p_partkey", "common", (F.col("common") >= 4).alias("shares_four"), F.round("score", 6).alias("score"), SS.tier(F.col("score")).alias("tier"))


@query("str_17_benchmark_words")
def str_17_words(s, d):
    """Whole documents against all words of the benchmark at once: the longest piece of any of them."""
    words = table(s, d, "benchmark").select(F.explode(BM.tokens(F.col("text"))).alias("w")).distinct().orderBy("w")
    words = [r["w"] for r in words.limit(SS.MOST).collect()]  # the keywords of a lexicon; common_with checks their size
    x = TB.spread(table(s, d, "documents").select("doc_id", "text"))
    found = SS.common_with(s, F.lower("text"), words)
    return x.select("doc_id", found.alias("f")).select("doc_id", "f.length", "f.start", F.get(F.array(*map(F.lit, words)), F.col("f.pattern")).alias("word"))
