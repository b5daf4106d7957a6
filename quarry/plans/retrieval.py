"""Queries on vectors, BM25, scores and fusion."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import scores as S
from quarry.operators import bm25 as BM
from quarry.operators import fusion as FU
from quarry.operators import ivf as IV
from quarry.operators import vector as V
from quarry.sources import tables as TB

from .registry import opened, query, saved, table

TERMS = ["the", "ening", "queaux"]


def chunks(s, d, spread=False):  # noqa: ANN001, ANN201
    """documents as wiki chunks: a title from the first line, the text, labels from language and source."""
    x = table(s, d, "documents").select("doc_id", "text", "lang", "source")
    x = TB.spread(x) if spread else x
    title = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 60)
    return x.select("doc_id", title.alias("title"), F.col("text").alias("content"), F.array("lang", "source").alias("labels"), "source")


CHUNKS = "chunks AS (SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 60) AS title, text AS content, [lang, source] AS labels, source FROM documents)"


def vectors(s, d):  # noqa: ANN001, ANN201
    return table(s, d, "embeddings")


def probe(s, d, i=0):  # noqa: ANN001, ANN201
    """The embedding of one row, as the query vector."""
    r = vectors(s, d).filter(F.col("vec_id") == i).select("embedding").first()
    return list(r[0]) if r else [0.0] * 64


PROBE = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
L2 = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - qv[i]) * (v[i] - qv[i])))"
KNN = f"WITH {PROBE} SELECT vec_id, round({L2}, 6) AS distance FROM e, q {{where}} ORDER BY {L2}, vec_id LIMIT {{k}}"


@query("knn_1_exact", KNN.format(where="", k=10))
def knn_1(s, d):
    return V.knn(vectors(s, d), "embedding", "vec_id", probe(s, d), 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query("knn_2_raw_endpoint", f"WITH {PROBE}, n AS (SELECT vec_id, label, round({L2}, 6) AS distance FROM e, q ORDER BY {L2}, vec_id LIMIT 10) SELECT vec_id, distance, CASE WHEN distance > 1 THEN 100 / (1 + distance) ELSE 100 * (1 - distance) END AS similarity, label FROM n WHERE distance <= 1.6 AND label <> 3")
def knn_2(s, d):
    """The endpoint's own order: nearest rows first, then the ceiling and the filter, so fewer than k rows may be left."""
    x = V.knn(vectors(s, d), "embedding", "vec_id", probe(s, d), 10).withColumn("distance", F.round("distance", 6))
    return x.filter((F.col("distance") <= 1.6) & (F.col("label") != 3)).select("vec_id", "distance", S.similarity_score(F.col("distance")).alias("similarity"), "label")


@query("knn_3_filtered", KNN.format(where="WHERE label = 3", k=20))
def knn_3(s, d):
    return V.knn(vectors(s, d), "embedding", "vec_id", probe(s, d), 20, where=F.col("label") == 3).select("vec_id", F.round("distance", 6).alias("distance"))


def seeds(s, d):  # noqa: ANN001, ANN201
    """The first vector of each label."""
    return [list(r[0]) for r in vectors(s, d).groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c")).orderBy("label").select("c").collect()]


BATCH = "WITH p AS (SELECT a.vec_id AS q, b.vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) AS dist FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) a, embeddings b), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS rank FROM p)"
#: The cell of each vector: the nearest of the first vectors of the labels.
CELLS = "c AS (SELECT row_number() OVER (ORDER BY label) - 1 AS cell, e FROM (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings GROUP BY 1)), l AS (SELECT vec_id, cell, list_sum(list_transform(range(1, len(e) + 1), lambda i: (embedding[i]::DOUBLE - e[i]) * (embedding[i]::DOUBLE - e[i]))) AS d FROM embeddings, c), n AS (SELECT vec_id, arg_min(cell, (d, cell)) AS cell FROM l GROUP BY 1)"


@query("knn_4_cells", f"{BATCH}, {CELLS} SELECT q, id AS vec_id, round(dist, 6) AS distance, CAST(rank AS INT) AS rank, CAST(n.cell AS INT) AS cell FROM r JOIN n ON r.id = n.vec_id WHERE rank <= 10")
def knn_4(s, d):
    """Every hundredth vector against cells around the first vector of each label; cells are probed until no other can be nearer."""
    c, q = seeds(s, d), vectors(s, d).filter("vec_id % 100 = 0")
    near = V.cell_knn(V.assign_cells(vectors(s, d), "embedding", c), "embedding", "vec_id", q, "vec_id", "embedding", c, 10)
    return near.select("q", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank", "cell")


def vector_index(s, d):  # noqa: ANN001, ANN201
    """The trained index of the vectors."""

    def build(path):  # noqa: ANN001, ANN202
        x = vectors(s, d)
        IV.save(x, path, "embedding", "vec_id", IV.train(x, "embedding", "vec_id"))

    return opened(IV.Index, s, saved(s, d, "vectors", "embeddings", build))


#: Of the cells. The vectors of the test tables have no direction that is more frequent than others, so neighbours lie in many cells.
PROBED = 0.8


def probed(index):  # noqa: ANN001, ANN201
    return max(1, round(PROBED * len(index.centres.cells)))


def found_by_codes(s, d):  # noqa: ANN001, ANN201
    q = vectors(s, d).filter("vec_id % 100 = 0")
    index = vector_index(s, d)
    return index.search(q, "vec_id", "embedding", 10, probed(index), 200)


@query("knn_4_quantized", f"{BATCH} SELECT q, count(*) AS found, round(max(dist), 6) AS exact_10th, true AS near FROM r WHERE rank <= 10 GROUP BY q")
def knn_4_quantized(s, d):
    """Every hundredth vector against the quantized index, beside the exact search: whether the tenth found is at most a tenth farther away than
    the true tenth (distances are squares)."""
    q = vectors(s, d).filter("vec_id % 100 = 0")
    near = found_by_codes(s, d).groupBy("q").agg(F.count("id").alias("found"), F.max("distance").alias("far"))
    exact = V.batch_knn(vectors(s, d), "embedding", "vec_id", q, "vec_id", "embedding", 10).groupBy("q").agg(F.max("distance").alias("exact"))
    return exact.join(near, "q").select("q", "found", F.round("exact", 6).alias("exact_10th"), (F.col("far") <= 1.21 * F.col("exact") + 1e-9).alias("near"))


@query("knn_5_batch", BATCH + " SELECT q, id, round(dist, 6) AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def knn_5(s, d):
    q = vectors(s, d).filter("vec_id % 100 = 0")
    return V.batch_knn(vectors(s, d), "embedding", "vec_id", q, "vec_id", "embedding", 5).withColumn("distance", F.round("distance", 6))


RATIO = "((contains(lower(title), 'the')::INT + contains(lower(title), 'ening')::INT + contains(lower(title), 'queaux')::INT) / 3.0::DOUBLE)"


@query("knn_6_title_boost", f"WITH {CHUNKS}, x AS (SELECT doc_id, {RATIO} AS r, (doc_id % 100) / 100.0::DOUBLE AS dist FROM chunks) SELECT doc_id, round(CASE WHEN r >= 0.66 THEN dist / 5 WHEN r >= 0.33 THEN dist / 3 ELSE dist END, 6) AS boosted FROM x")
def knn_6(s, d):
    r = BM.title_ratio(F.col("title"), TERMS)
    return chunks(s, d).select("doc_id", F.round(V.title_boosted(F.col("doc_id") % 100 / F.lit(100.0), r), 6).alias("boosted"))


TOK = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
INDEX = f"""{CHUNKS}, f AS (SELECT doc_id AS id, 'title' AS field, {TOK.format('title')} AS t FROM chunks UNION ALL SELECT doc_id, 'content', {TOK.format('content')} FROM chunks UNION ALL SELECT doc_id, 'labels', {TOK.format("array_to_string(labels, ' ')")} FROM chunks),
p AS (SELECT term, id, field, len, count(*) AS tf FROM (SELECT id, field, len(t) AS len, unnest(t) AS term FROM f) GROUP BY ALL),
st AS (SELECT field, avg(len(t)) AS avgdl FROM f GROUP BY 1), nd AS (SELECT count(*) AS n FROM chunks),
bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgdl)) * CASE field WHEN 'title' THEN 3.0 WHEN 'labels' THEN 2.0 ELSE 1.0 END) AS score, count(DISTINCT term) AS match_count
  FROM (SELECT p.*, count(*) OVER (PARTITION BY term, field) AS df FROM p WHERE {{hit}} AND field IN ({{fields}})) JOIN st USING (field), nd GROUP BY 1)"""


def index_sql(hit: str, fields: str) -> str:
    return INDEX.replace("{hit}", hit).replace("{fields}", fields)


HIT, ALL_FIELDS = "term IN ('the', 'ening', 'queaux')", "'title', 'content', 'labels'"


def indexed(s, d):  # noqa: ANN001, ANN201
    return chunks(s, d, True).withColumn("labels", F.array_join("labels", " "))


FIELDS = ("title", "content", "labels")


def text_index(s, d):  # noqa: ANN001, ANN201
    """The saved index of the wiki chunks."""
    return opened(BM.SavedIndex, s, saved(s, d, "text", "documents", lambda path: BM.save_index(indexed(s, d), path, "doc_id", FIELDS, 16)))


@query("bm_1_index", f"WITH {index_sql(hit='true', fields=ALL_FIELDS)} SELECT field, count(*) AS postings, sum(tf)::BIGINT AS tokens, count(DISTINCT term) AS terms FROM p GROUP BY 1")
def bm_1(s, d):
    p = BM.postings(indexed(s, d), "doc_id", FIELDS)
    return p.groupBy("field").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens"), F.countDistinct("term").alias("terms"))


@query("bm_2_prepared_documents", r"SELECT page_id, string_split_regex(trim(lower(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g'))), ' ') AS terms FROM pages")
def bm_2(s, d):
    text = F.trim(F.lower(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", ""), r"[^\p{L}\p{N}]+", " ")))
    return table(s, d, "pages").select("page_id", F.split(text, " ").alias("terms"))


@query("bm_3_candidates", f"WITH {index_sql(hit=HIT, fields=ALL_FIELDS)} SELECT id, round(score, 6) AS score, match_count FROM bm ORDER BY round(score, 9) DESC, id LIMIT 50")
def bm_3(s, d):
    return text_index(s, d).search(TERMS, 50, FIELDS).withColumn("score", F.round("score", 6))


WILD = index_sql(hit="contains(term, 'queau')", fields="'content'")


@query("bm_3_wildcard", f"WITH {WILD} SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, id LIMIT 50")
def bm_3b(s, d):
    return text_index(s, d).search(["queau"], 50, ("content",), wildcard=True).select("id", F.round("score", 6).alias("score"))


@query("bm_4_label_filtered", f"WITH {index_sql(hit=HIT, fields=ALL_FIELDS)} SELECT id, round(score, 6) AS score FROM bm JOIN chunks ON doc_id = id WHERE list_has_any(labels, ['en', 'fr']) AND NOT list_has_any(labels, ['src0']) ORDER BY round(score, 9) DESC, id LIMIT 50")
def bm_4(s, d):
    c = chunks(s, d)
    found = text_index(s, d).scores(TERMS, FIELDS)
    ok = F.arrays_overlap("labels", F.array(F.lit("en"), F.lit("fr"))) & ~F.arrays_overlap("labels", F.array(F.lit("src0")))
    x = found.join(c.filter(ok).select(F.col("doc_id").alias("id")), "id", "left_semi")
    return x.orderBy(F.desc(F.round("score", 9)), "id").limit(50).select("id", F.round("score", 6).alias("score"))


@query("bm_5_summed_keywords", f"WITH {index_sql(hit=HIT, fields=ALL_FIELDS)} SELECT id, title, round(score, 6) AS score, match_count, round(score * CASE WHEN {RATIO} >= 0.66 THEN 2.5 WHEN {RATIO} >= 0.33 THEN 2.0 ELSE 1 END, 6) AS shown FROM bm JOIN chunks ON doc_id = id ORDER BY round(score, 9) DESC, id LIMIT 30")
def bm_5(s, d):
    top = text_index(s, d).search(TERMS, 30, FIELDS)
    x = top.join(chunks(s, d).select(F.col("doc_id").alias("id"), "title"), "id")
    r = BM.title_ratio(F.col("title"), TERMS)
    return x.select("id", "title", F.round("score", 6).alias("score"), "match_count", F.round(F.col("score") * F.when(r >= 0.66, 2.5).when(r >= 0.33, 2.0).otherwise(1.0), 6).alias("shown"))


@query("bm_6_corpus_stats", f"WITH {CHUNKS} SELECT count(*) AS n_docs, round(avg(length(title)), 6) AS mean_title FROM chunks")
def bm_6(s, d):
    return chunks(s, d).agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(F.length("title")), 6).alias("mean_title"))


def ttl_sql(keywords, domain, generic):  # noqa: ANN001, ANN201
    """title_match() in SQL: the same rules, over lists."""
    low = [k.lower() for k in keywords]
    rest = "t"
    for form in dict.fromkeys([" ".join(low), "".join(low), "".join(reversed(low))]):
        rest = f"CASE WHEN contains({rest}, '{form}') THEN substr({rest}, 1, strpos({rest}, '{form}') - 1) || substr({rest}, strpos({rest}, '{form}') + {len(form)}) ELSE {rest} END"
    forms = " OR ".join(f"contains(t, '{f}')" for f in {" ".join(low), "".join(low), "".join(reversed(low))})
    related = " OR ".join([f"contains(t, '{w}')" for w in low if any(x in w or w in x for x in domain)] or ["false"])
    places = ", ".join(f"{{'at': strpos(t, '{w}') - 1, 'i': {i}, 'e': length(t) - strpos(reverse(t), '{w[::-1]}') + 1}}" for i, w in enumerate(low))
    begins = " OR ".join(f"starts_with(substr(rest, i), '{g}')" for g in generic)
    left = "gap"
    for g in generic:
        left = f"replace({left}, '{g}', '')"
    trim = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return f"""WITH {CHUNKS}, a AS (SELECT doc_id, lower(title) AS t, ({" + ".join(f"contains(lower(title), '{w}')::INT" for w in low)}) / {len(low)}.0::DOUBLE AS r FROM chunks),
b AS (SELECT *, CASE WHEN {related} THEN greatest(r, 0.7::DOUBLE) ELSE r END AS base, {rest} AS rest, list_sort([{places}]) AS p FROM a),
c AS (SELECT *, length({trim(f"array_to_string(list_transform(list_filter(range(1, length(rest) + 1), lambda i: NOT ({begins})), lambda i: substr(rest, i, 1)), '')")}) AS extra,
  {trim(f"substr(t, least(p[1].e, p[{len(low)}].at) + 1, greatest(p[1].e, p[{len(low)}].at) - least(p[1].e, p[{len(low)}].at))")} AS gap FROM b),
d AS (SELECT *, length({trim(left)}) AS n FROM c)
SELECT doc_id, round(CASE WHEN {forms} THEN CASE WHEN extra > 2 THEN greatest(greatest(base, 0.95::DOUBLE) - least(extra * 0.05::DOUBLE, 0.20::DOUBLE), 0.75::DOUBLE) ELSE greatest(base, 0.95::DOUBLE) END
  WHEN {" AND ".join(f"contains(t, '{w}')" for w in low)} THEN CASE WHEN length(gap) > 2 AND n > 2 THEN greatest(base - least(n * 0.08::DOUBLE, 0.30::DOUBLE), 0.60::DOUBLE) ELSE base END ELSE base END, 6) AS match FROM d"""


GENERIC = ("er", "la", "_")


@query("ttl_1_title_match", ttl_sql(TERMS, ["tion", "he"], GENERIC))
def ttl_1(s, d):
    return chunks(s, d).select("doc_id", F.round(BM.title_match(F.col("title"), TERMS, ["tion", "he"], GENERIC), 6).alias("match"))


@query("ttl_1_gaps", ttl_sql(["en", "on"], ["zz"], GENERIC))
def ttl_1_gaps(s, d):
    """Two short keywords, which many titles hold together, apart and in reverse."""
    return chunks(s, d).select("doc_id", F.round(BM.title_match(F.col("title"), ["en", "on"], ["zz"], GENERIC), 6).alias("match"))


@query("ttl_2_candidates_of_titles", f"WITH {CHUNKS}, w AS (SELECT doc_id, list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')[:5] AS k FROM chunks), p AS (SELECT doc_id, unnest(k) AS k, generate_subscripts(k, 1) AS i FROM w) SELECT DISTINCT doc_id, candidate FROM (SELECT a.doc_id, a.k || b.k AS candidate FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.i <> b.i UNION ALL SELECT doc_id, k FROM p)")
def ttl_2_titles(s, d):
    """Candidates of every title's first five words, inside each row."""
    k = F.slice(BM.tokens(F.col("title")), 1, 5)
    return chunks(s, d).select("doc_id", F.explode(F.array_distinct(BM.candidates_of(k))).alias("candidate"))


@query("ttl_2_title_candidates", "SELECT DISTINCT candidate FROM (SELECT lower(a.r_name) || lower(b.r_name) AS candidate FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey UNION ALL SELECT lower(r_name) FROM region)")
def ttl_2(s, d):
    """The regions' names as the keywords of a query."""
    return BM.title_candidates(table(s, d, "region").select(F.lower("r_name").alias("keyword"), F.col("r_regionkey").alias("pos")))


@query("ttl_3_title_rescue", f"WITH {CHUNKS}, m AS (SELECT c.k, doc_id, row_number() OVER (PARTITION BY c.k ORDER BY doc_id) AS rn FROM chunks JOIN (VALUES ('the'), ('ening'), ('queaux')) c(k) ON contains(lower(title), c.k)) SELECT doc_id, min(CASE WHEN k = 'queaux' THEN 0.05::DOUBLE ELSE 0.2 END) AS distance FROM m WHERE rn <= 15 GROUP BY 1")
def ttl_3(s, d):
    hits = F.filter(F.array(*map(F.lit, TERMS)), lambda k: F.contains(F.lower("title"), k))
    m = chunks(s, d).select("doc_id", F.explode(hits).alias("k"))
    m = m.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("doc_id"))).filter("rn <= 15")
    return m.groupBy("doc_id").agg(F.min(F.when(F.col("k") == "queaux", 0.05).otherwise(0.2)).alias("distance"))


@query("ttl_4_exact_key", "SELECT o_orderkey, o_orderkey = CAST(regexp_extract('status of ORD-7 please', 'ORD-([0-9]+)', 1) AS BIGINT) AS pinned FROM orders ORDER BY pinned DESC, o_totalprice DESC, o_orderkey LIMIT 5")
def ttl_4(s, d):
    key = F.try_to_number(F.regexp_extract(F.lit("status of ORD-7 please"), "ORD-([0-9]+)", 1), F.lit("999999999999")).cast("bigint")
    pinned = F.col("o_orderkey") == key
    return table(s, d, "orders").withColumn("pinned", pinned).orderBy(F.desc("pinned"), F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "pinned")


@query("top_1_cut", "SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30")
def top_1(s, d):
    return table(s, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(30).select("doc_id")


# Signals made from the tables alone, so that both engines see the same: a distance, a BM25-like score, a keyword score, a title score.
SIG = "sig AS (SELECT doc_id, (doc_id * 7 % 101) / 50.0::DOUBLE AS distance, CASE WHEN doc_id % 3 = 0 THEN (doc_id * 13 % 97) / 3.0::DOUBLE END AS bm25, (doc_id * 5 % 23)::DOUBLE AS keyword, CASE WHEN doc_id % 4 = 0 THEN (doc_id * 3 % 11) / 11.0::DOUBLE END AS title, (doc_id * 11 % 7)::DOUBLE AS label FROM documents)"


def signals(s, d):  # noqa: ANN001, ANN201
    i = F.col("doc_id")
    return table(s, d, "documents").select("doc_id", (i * 7 % 101 / F.lit(50.0)).alias("distance"), F.when(i % 3 == 0, i * 13 % 97 / F.lit(3.0)).alias("bm25"), (i * 5 % 23).cast("double").alias("keyword"), F.when(i % 4 == 0, i * 3 % 11 / F.lit(11.0)).alias("title"), (i * 11 % 7).cast("double").alias("label"))


def _scored(name: str, sql: str, column) -> None:  # noqa: ANN001
    @query(name, f"WITH {SIG} SELECT doc_id, round(CAST({sql} AS DOUBLE), 6) AS score FROM sig")
    def plan(s, d):
        return signals(s, d).select("doc_id", F.round(column(), 6).alias("score"))


def _c(name: str):  # noqa: ANN202
    return F.col(name)


_scored("scr_1_similarity_percent", "round((1 - least(1, greatest(0, distance))) * 100, 1)", lambda: S.similarity_percent(_c("distance")))
_scored("scr_2_similarity_score", "CASE WHEN distance > 1 THEN 100 / (1 + distance) ELSE 100 * (1 - distance) END", lambda: S.similarity_score(_c("distance")))
_scored("scr_3_bm25_percent", "CASE WHEN bm25 IS NOT NULL THEN round(100 * least(1, greatest(0, bm25 / 20))) END", lambda: S.bm25_percent(_c("bm25")))
_scored("scr_4_hybrid", "0.4 * least(1, greatest(0, distance)) + 0.4 * least(1, keyword / 10) + 0.2 * least(1, label / 5)", lambda: S.hybrid_score(_c("distance"), _c("keyword"), _c("label")))
_scored("scr_5_hybrid_other_weights", "0.6 * least(1, greatest(0, distance)) + 0.3 * least(1, keyword / 10) + 0.1 * least(1, label / 5)", lambda: S.hybrid_score(_c("distance"), _c("keyword"), _c("label"), (0.6, 0.3, 0.1)))
_scored("scr_6_two_sources", "0.5 * (1 - distance) + 0.5 * least(coalesce(bm25, 0) / 10, 1)", lambda: S.two_source_score(_c("distance"), _c("bm25")))
_scored("scr_10_composite", "0.05 * (1 - least(distance / 2, 1)) + 0.53 * least(coalesce(bm25, 0) / 30, 1) + 0.26 * coalesce(title, 0) + 0.16 * label / 7", lambda: S.composite(_c("distance"), F.coalesce("bm25", F.lit(0.0)), F.coalesce("title", F.lit(0.0)), _c("label") / 7))
_scored("scr_14_label_score", "least(1, greatest(0, 0.2 * (label / 7) + 0.8 * (2 * (doc_id % 2 = 0)::INT + 3 * (doc_id % 5 = 0)::INT + least(0.8 * (doc_id % 4), 2.0) + 0.3 * (doc_id % 3 = 0)::INT + 0.2 * (doc_id % 7 = 0)::INT) / 7.5))", lambda: S.label_score(_c("label") / 7, _c("doc_id") % 2 == 0, _c("doc_id") % 5 == 0, _c("doc_id") % 4, _c("doc_id") % 3 == 0, _c("doc_id") % 7 == 0))
_scored("scr_16_priority_and_status", "CASE doc_id % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.0 END + CASE doc_id % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 0.5 ELSE -2.0 END", lambda: S.priority_boost(F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (_c("doc_id") % 4 + 1).cast("int"))) + S.status_boost(F.element_at(F.array(*map(F.lit, ("approved", "review", "deprecated"))), (_c("doc_id") % 3 + 1).cast("int"))))
_scored("scr_17_first_chunk_bonus", "coalesce(distance, 0) - CASE WHEN doc_id % 5 = 0 THEN 0.05 ELSE 0 END + coalesce(1 - bm25 / 20, 0)", lambda: _c("distance") - F.when(_c("doc_id") % 5 == 0, 0.05).otherwise(0.0) + F.coalesce(1 - _c("bm25") / 20, F.lit(0.0)))
_scored("scr_19_display_score", "least(100, greatest(0, coalesce(title * 100, bm25 * 10, round((1 - least(1, greatest(0, distance))) * 100, 1))))", lambda: S.display_score(_c("title"), _c("bm25"), _c("distance")))
_scored("scr_20_generic_weight", "CASE WHEN doc_id % 5 < 2 THEN 0.3 WHEN doc_id % 5 = 2 THEN 0.5 ELSE 1.0 END", lambda: S.generic_weight((_c("doc_id") % 5).cast("string"), ["0", "1"], ["2"]))
_scored("scr_21_query_quality", "least(least(0.2 * keyword, 1.0) + least(label / 100, 0.3), 1.0)", lambda: S.query_quality(_c("keyword"), _c("label")))


@query("scr_7_keyword_score", f"""WITH {CHUNKS} SELECT doc_id, CAST(5 * (contains(lower(title), 'the')::INT + contains(lower(title), 'la')::INT) + 2 * (len(list_filter(labels, lambda x: contains(lower(x), 'the'))) > 0)::INT + 2 * (len(list_filter(labels, lambda x: contains(lower(x), 'la'))) > 0)::INT + contains(lower(content), 'the')::INT + contains(lower(content), 'la')::INT + 3 AS INT) AS score FROM chunks""")
def scr_7(s, d):
    return chunks(s, d).select("doc_id", S.keyword_score(F.col("title"), F.col("content"), F.col("labels"), ["the"], ["la"]).alias("score"))


RANKED = f"""{SIG}, r AS (SELECT *, row_number() OVER (ORDER BY distance, doc_id) AS vr, row_number() OVER (ORDER BY keyword DESC, doc_id) AS kr,
CASE WHEN title IS NOT NULL THEN row_number() OVER (PARTITION BY title IS NULL ORDER BY title DESC, doc_id) END AS tr, CASE WHEN bm25 IS NOT NULL THEN row_number() OVER (PARTITION BY bm25 IS NULL ORDER BY bm25 DESC, doc_id) END AS br FROM (SELECT * FROM sig ORDER BY keyword DESC, doc_id LIMIT 75)),
f AS (SELECT *, 1.0::DOUBLE / (60 + vr) + 0.8::DOUBLE / (60 + kr) + coalesce(1.2::DOUBLE / (60 + tr), 0) + coalesce(0.6::DOUBLE / (60 + br), 0) AS rrf FROM r)"""


def fused(s, d):  # noqa: ANN001, ANN201
    return FU.fuse(signals(s, d).orderBy(F.desc("keyword"), "doc_id").limit(75), "doc_id")


@query("scr_8_rrf", f"WITH {RANKED} SELECT doc_id, round(rrf, 9) AS rrf FROM f")
def scr_8(s, d):
    return fused(s, d).select("doc_id", F.round("rrf", 9).alias("rrf"))


@query("win_1_ranks", f"WITH {RANKED} SELECT doc_id, vr, kr, tr, br FROM f")
def win_1(s, d):
    return fused(s, d).select("doc_id", *[F.col(a).cast("bigint").alias(b) for a, b in (("distance_rank", "vr"), ("keyword_rank", "kr"), ("title_rank", "tr"), ("bm25_rank", "br"))])


@query("scr_9_rrf_modifiers", f"WITH {RANKED} SELECT doc_id, round(rrf * CASE WHEN doc_id % 9 = 0 THEN 0.9 ELSE 1 END * CASE WHEN doc_id % 8 = 0 THEN 0.5 ELSE 1 END * least(1 + 0.5 * (doc_id % 4), 2.0) * CASE WHEN doc_id % 5 = 1 THEN 2.0 WHEN doc_id % 5 > 1 THEN 3.0 ELSE 1.0 END, 9) AS score FROM f")
def scr_9(s, d):
    i = F.col("doc_id")
    factor = F.when(i % 9 == 0, 0.9).otherwise(1.0) * F.when(i % 8 == 0, 0.5).otherwise(1.0) * S.domain_boost(i % 4) * S.tag_boost(i % 5, 2.0, 3.0)
    return fused(s, d).select("doc_id", F.round(F.col("rrf") * factor, 9).alias("score"))


COMP = "0.05 * (1 - least(distance / 2, 1)) + 0.53 * least(coalesce(bm25, 0) / 30, 1) + 0.26 * greatest(coalesce(title, 0), CASE WHEN doc_id % 10 = 0 THEN 0.9 ELSE 0 END) + 0.16 * label / 7"


@query("scr_11_composite_rank", f"WITH {SIG}, x AS (SELECT doc_id, round(({COMP}) * CASE WHEN doc_id % 5 = 1 THEN 3.0 WHEN doc_id % 5 > 1 THEN 6.0 ELSE 1.0 END, 9) AS score FROM sig) SELECT doc_id, score FROM x ORDER BY score DESC, doc_id LIMIT 50")
def scr_11(s, d):
    i = F.col("doc_id")
    title = F.greatest(F.coalesce("title", F.lit(0.0)), F.when(i % 10 == 0, 0.9).otherwise(0.0))
    score = S.composite(F.col("distance"), F.coalesce("bm25", F.lit(0.0)), title, F.col("label") / 7) * S.tag_boost(i % 5, 3.0, 6.0)
    return signals(s, d).select("doc_id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query("scr_12_category_penalties", f"WITH {CHUNKS} SELECT doc_id, CAST(CASE WHEN contains(lower(title), 'template') THEN 0.02 WHEN contains(lower(title), 'workflow') THEN 0.3 WHEN source = 'src0' THEN 0.5 WHEN source = 'src1' THEN 1.5 ELSE 1.0 END * least(1 + 0.5 * contains(lower(title), 'the')::INT, 2.0) AS DOUBLE) AS factor FROM chunks")
def scr_12(s, d):
    t = F.lower("title")
    kind = F.when(F.contains(t, F.lit("template")), 0.02).when(F.contains(t, F.lit("workflow")), 0.3).when(F.col("source") == "src0", 0.5).when(F.col("source") == "src1", 1.5).otherwise(1.0)
    return chunks(s, d).select("doc_id", (kind * S.domain_boost(F.contains(t, F.lit("the")).cast("int"))).alias("factor"))


@query("scr_13_query_intent", "SELECT item_id, contains(lower(text), 'tion') OR contains(lower(text), 'ing') AS functional, contains(lower(text), 'mail') OR contains(lower(text), 'template') AS email FROM benchmark")
def scr_13(s, d):
    any_ = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("text"), w))
    return table(s, d, "benchmark").select("item_id", any_(["tion", "ing"]).alias("functional"), any_(["mail", "template"]).alias("email"))


@query("scr_15_label_match", f"WITH {CHUNKS} SELECT doc_id, CAST(3 * list_contains(labels, 'fr')::INT + 2 * list_contains(labels, 'src3')::INT + 5 * (len(list_filter(range(2, 7), lambda n: contains(lower(title), substr('ention', 1, CAST(n AS INT))))) / 5.0) AS DOUBLE) AS score FROM chunks")
def scr_15(s, d):
    """Domain and tag equality, and the share of a feature's 2- to 6-letter beginnings in the title."""
    grams = F.filter(F.array(*[F.lit("ention"[:n]) for n in range(2, 7)]), lambda g: F.contains(F.lower("title"), g))
    has = lambda v: F.array_contains("labels", v).cast("int")
    return chunks(s, d).select("doc_id", (3 * has("fr") + 2 * has("src3") + 5 * F.size(grams) / 5.0).cast("double").alias("score"))


@query("scr_18_tail_scores", f"WITH {SIG}, r AS (SELECT *, row_number() OVER (ORDER BY keyword DESC, doc_id) AS rk FROM (SELECT * FROM sig ORDER BY keyword DESC, doc_id LIMIT 150)) SELECT doc_id, round(CASE WHEN rk > 75 THEN 0.1 * keyword ELSE keyword END, 6) AS rrf FROM r")
def scr_18(s, d):
    x = signals(s, d).orderBy(F.desc("keyword"), "doc_id").limit(150).withColumn("rk", F.row_number().over(W.orderBy(F.desc("keyword"), "doc_id")))
    return x.select("doc_id", F.round(F.when(F.col("rk") > 75, 0.1 * F.col("keyword")).otherwise(F.col("keyword")), 6).alias("rrf"))


@query("top_2_by_rrf", f"WITH {RANKED} SELECT doc_id FROM f ORDER BY round(rrf, 9) DESC, doc_id LIMIT 10")
def top_2(s, d):
    return fused(s, d).orderBy(F.desc(F.round("rrf", 9)), "doc_id").limit(10).select("doc_id")


HYB = f"""WITH {index_sql(hit=HIT, fields="'content'")}, {PROBE}, v AS (SELECT vec_id AS doc_id, {L2} / 2 AS distance FROM e, q ORDER BY {L2}, vec_id LIMIT 30), b AS (SELECT id AS doc_id, score FROM bm ORDER BY round(score, 9) DESC, id LIMIT 30),
m AS (SELECT doc_id, distance, score, CASE WHEN distance IS NULL THEN 'bm25' WHEN score IS NULL THEN 'vector' ELSE 'hybrid' END AS found_by FROM v FULL JOIN b USING (doc_id)),
h AS (SELECT *, round(CASE found_by WHEN 'hybrid' THEN 0.5 * (1 - distance) + 0.5 * least(score / 10, 1) WHEN 'vector' THEN 1 - distance ELSE least(score / 10, 1) END, 9) AS hybrid FROM m)"""


def sources(s, d):  # noqa: ANN001, ANN201
    v = V.knn(vectors(s, d), "embedding", "vec_id", probe(s, d), 30).select(F.col("vec_id").alias("doc_id"), (F.col("distance") / 2).alias("distance"))
    return v, text_index(s, d).search(TERMS, 30, ("content",)).select(F.col("id").alias("doc_id"), "score")


@query("hyb_1_two_sources", HYB + " SELECT doc_id, found_by, round(hybrid, 6) AS hybrid FROM h ORDER BY h.hybrid DESC, doc_id LIMIT 20")
def hyb_1(s, d):
    return FU.two_source_rank(*sources(s, d), "doc_id", 20).select("doc_id", "found_by", F.round("hybrid", 6).alias("hybrid"))


@query("hyb_2_best_by_title", HYB + ", t AS (SELECT h.*, lower(title) AS t FROM h JOIN chunks USING (doc_id)) SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY t ORDER BY hybrid DESC, doc_id) AS rn FROM t) WHERE rn = 1")
def hyb_2(s, d):
    x = FU.two_source_rank(*sources(s, d), "doc_id", 60).join(chunks(s, d).select("doc_id", F.lower("title").alias("t")), "doc_id")
    return FU.first_by(x, ["t"], F.desc("hybrid"), F.col("doc_id")).select("doc_id")


@query("jn_4_outer_merge", HYB + " SELECT doc_id, found_by FROM m")
def jn_4(s, d):
    return FU.merge_sources(*sources(s, d), "doc_id").select("doc_id", "found_by")


@query("jn_3_fill_nulls", HYB + " SELECT doc_id, round(coalesce(distance, 1 - score / 20), 6) AS distance, found_by FROM m")
def jn_3(s, d):
    m = FU.merge_sources(*sources(s, d), "doc_id")
    return m.select("doc_id", F.round(F.coalesce("distance", 1 - F.col("score") / 20), 6).alias("distance"), "found_by")


SEARCH = FU.SearchRules(meeting=("meeting",), meeting_terms=("sh",), deprecated=("ouin",), generic=("er",), domain=("on", "an"), tags=("en", "src0"), penalties=(("la", 0.3), ("de", 0.5)), approved=("in",))

FULL = f"""WITH {index_sql(hit=HIT, fields=ALL_FIELDS)}, {PROBE}, v AS (SELECT vec_id AS doc_id, {L2} AS distance FROM e, q ORDER BY {L2}, vec_id LIMIT 150), b AS (SELECT id AS doc_id, score AS bm25 FROM bm ORDER BY round(score, 9) DESC, id LIMIT 150),
k AS (SELECT * FROM (VALUES ('the'), ('ening'), ('queaux')) t(k)), rs AS (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS rn FROM chunks JOIN k ON contains(lower(title), k.k)),
rt AS (SELECT doc_id, min(CASE WHEN {RATIO} = 1 THEN 0.05::DOUBLE ELSE 0.2 END) AS rescued FROM rs JOIN chunks USING (doc_id) WHERE rn <= 15 GROUP BY 1),
m AS (SELECT doc_id, distance, bm25, CASE WHEN distance IS NULL THEN 'bm25' WHEN bm25 IS NULL THEN 'vector' ELSE 'hybrid' END AS found_by FROM v FULL JOIN b USING (doc_id)),
m2 AS (SELECT doc_id, CASE WHEN distance IS NULL THEN rescued WHEN rescued IS NULL THEN distance ELSE least(distance, rescued) END AS distance, bm25, coalesce(found_by, 'title') AS found_by FROM m FULL JOIN rt USING (doc_id)),
x AS (SELECT doc_id, title, lower(title) AS t, found_by, distance, bm25, {RATIO} AS ratio,
  CAST(5 * (contains(lower(title), 'the')::INT + contains(lower(title), 'ening')::INT + contains(lower(title), 'queaux')::INT) + contains(lower(content), 'the')::INT + contains(lower(content), 'ening')::INT + contains(lower(content), 'queaux')::INT
    + 2 * ((contains(lower(array_to_string(labels, ' ')), 'the'))::INT + (contains(lower(array_to_string(labels, ' ')), 'ening'))::INT + (contains(lower(array_to_string(labels, ' ')), 'queaux'))::INT) + 6 AS DOUBLE) AS keyword,
  CAST(list_contains(labels, 'en') AS INT) + CAST(list_contains(labels, 'src0') AS INT) AS tags, contains(lower(title), 'on')::INT + contains(lower(title), 'an')::INT AS domains, contains(lower(content), 'sh') AS meeting, contains(lower(title), 'er') AS generic
  FROM m2 JOIN chunks USING (doc_id) WHERE length(content) >= 100 AND NOT contains(lower(title), 'meeting') AND NOT contains(lower(title), 'ouin')),
y AS (SELECT *, least(1, greatest(0, 0.8 * (2 * (domains > 0)::INT + 3 * (ratio > 0)::INT + least(0.8 * tags, 2.0) + 0.2 * contains(t, 'in')::INT) / 7.5)) AS label, nullif(ratio, 0) AS title_score, row_number() OVER (ORDER BY keyword DESC, distance NULLS LAST, doc_id) AS place FROM x),
r AS (SELECT *, CASE WHEN distance IS NOT NULL THEN row_number() OVER (PARTITION BY distance IS NULL ORDER BY distance, doc_id) END AS vr, row_number() OVER (ORDER BY keyword DESC, doc_id) AS kr, CASE WHEN title_score IS NOT NULL THEN row_number() OVER (PARTITION BY title_score IS NULL ORDER BY title_score DESC, doc_id) END AS tr, CASE WHEN bm25 IS NOT NULL THEN row_number() OVER (PARTITION BY bm25 IS NULL ORDER BY bm25 DESC, doc_id) END AS br FROM y WHERE place <= 75),
fu AS (SELECT doc_id, 1.0::DOUBLE / (60 + coalesce(vr, 1000000)) + 0.8::DOUBLE / (60 + kr) + coalesce(1.2::DOUBLE / (60 + tr), 0) + coalesce(0.6::DOUBLE / (60 + br), 0) AS rrf FROM r),
z AS (SELECT y.*, round(coalesce(fu.rrf, 0.1 * (0.4 * least(1, greatest(0, coalesce(distance, 1))) + 0.4 * least(1, keyword / 10) + 0.2 * least(1, tags / 5.0)) / 60) * CASE WHEN meeting THEN 0.9 ELSE 1 END * CASE WHEN generic THEN 0.5 ELSE 1 END * least(1 + 0.5 * domains, 2.0) * CASE WHEN tags = 1 THEN 2.0 WHEN tags > 1 THEN 3.0 ELSE 1.0 END, 9) AS rrf FROM y LEFT JOIN fu USING (doc_id)),
u AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, doc_id) AS p2 FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rrf DESC, doc_id) AS rn FROM z) WHERE rn = 1),
w AS (SELECT *, round((0.05 * (1 - least(coalesce(distance, 2) / 2, 1)) + 0.53 * least(coalesce(bm25, 0) / 30, 1) + 0.26 * greatest(coalesce(title_score, 0), CASE WHEN distance <= 0.05 THEN 0.9 ELSE 0 END) + 0.16 * label) * CASE WHEN tags = 1 THEN 3.0 WHEN tags > 1 THEN 6.0 ELSE 1.0 END * CASE WHEN contains(t, 'la') THEN 0.3 WHEN contains(t, 'de') THEN 0.5 ELSE 1.0 END * CASE WHEN p2 <= 50 THEN 1.0 ELSE 0.5 END, 9) AS composite FROM u),
top AS (SELECT doc_id, title, found_by, rrf, composite, round(least(100, greatest(0, composite * 100)), 1) AS display FROM w ORDER BY w.composite DESC, w.rrf DESC, doc_id LIMIT 30),
ln AS (SELECT DISTINCT doc_id + 1 AS doc_id FROM top WHERE doc_id % 3 > 0 AND (doc_id + 1) NOT IN (SELECT doc_id FROM top))
SELECT doc_id, title, found_by, round(rrf, 6) AS rrf, round(composite, 6) AS composite, display FROM top UNION ALL SELECT doc_id, title, 'reference', 0, 0, 60.0 FROM ln JOIN chunks USING (doc_id)"""


def next_pages(s, d):  # noqa: ANN001, ANN201
    """References from each page to the one after it."""
    return table(s, d, "documents").select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"), F.when(F.col("doc_id") % 3 > 0, 0.9).otherwise(0.5).alias("weight"))


@query("hyb_3_ranked_search", FULL)
def hyb_3(s, d):
    v = vectors(s, d).select(F.col("vec_id").alias("doc_id"), "embedding")
    x = FU.ranked_search(chunks(s, d), v, "doc_id", probe(s, d), TERMS, 30, SEARCH, next_pages(s, d), text_index(s, d))
    return x.select("doc_id", "title", "found_by", F.round("rrf", 6).alias("rrf"), F.round("composite", 6).alias("composite"), "display")


@query("srt_1_pinned_first", f"WITH {SIG} SELECT doc_id, row_number() OVER (ORDER BY doc_id % 50 = 0 DESC, keyword DESC, distance, doc_id) AS place FROM sig ORDER BY place LIMIT 40")
def srt_1(s, d):
    order = [(F.col("doc_id") % 50 == 0).desc(), F.desc("keyword"), F.col("distance"), F.col("doc_id")]
    return signals(s, d).orderBy(*order).limit(40).select("doc_id", F.row_number().over(W.orderBy(*order)).cast("bigint").alias("place"))


@query("srt_2_chronological", "SELECT user_id, list(event_id ORDER BY ts, event_id) AS history FROM events GROUP BY 1")
def srt_2(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda e: e["event_id"]).alias("history"))


def _dedup(name: str, key_sql: str, key, order_sql: str, order) -> None:  # noqa: ANN001
    @query(name, f"WITH {SIG}, c AS (SELECT *, {key_sql} AS k FROM sig) SELECT k, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {order_sql}) AS rn FROM c) WHERE rn = 1")
    def plan(s, d):
        return FU.first_by(signals(s, d).withColumn("k", key()), ["k"], *order()).select("k", "doc_id")


_dedup("ddp_1_pinned_then_near", "doc_id % 40", lambda: F.col("doc_id") % 40, "doc_id % 50 = 0 DESC, distance, doc_id", lambda: [(F.col("doc_id") % 50 == 0).desc(), F.col("distance"), F.col("doc_id")])
_dedup("ddp_2_nearest", "doc_id // 3", lambda: F.floor(F.col("doc_id") / 3), "distance, doc_id", lambda: [F.col("distance"), F.col("doc_id")])
_dedup("ddp_3_references", "doc_id % 17", lambda: F.col("doc_id") % 17, "distance, doc_id", lambda: [F.col("distance"), F.col("doc_id")])


@query("ddp_4_first_occurrence", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def ddp_4(s, d):
    return table(s, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("ddp_5_distinct_in_order", r"WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS t, generate_subscripts(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> ''), 1) AS i FROM documents), m AS (SELECT doc_id, t, min(i) AS i FROM w GROUP BY ALL) SELECT doc_id, list(t ORDER BY i) AS keywords FROM m GROUP BY 1")
def ddp_5(s, d):
    x = table(s, d, "documents").select("doc_id", F.array_distinct(BM.tokens(F.col("text"))).alias("keywords"))
    return x.filter(F.size("keywords") > 0)


@query("set_1_union_all", f"WITH {SIG} SELECT doc_id, 'title' AS list FROM sig WHERE title > 0.5 UNION ALL SELECT doc_id, 'bm25' FROM sig WHERE bm25 > 20")
def set_1(s, d):
    x = signals(s, d)
    return x.filter("title > 0.5").select("doc_id", F.lit("title").alias("list")).unionByName(x.filter("bm25 > 20").select("doc_id", F.lit("bm25").alias("list")))


@query("set_2_tag_overlap", "SELECT a.p_partkey, CAST(len(list_intersect(list_distinct(string_split(a.p_name, ' ')), list_distinct(string_split(b.p_name, ' ')))) AS INT) AS common, CAST(len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))) AS INT) AS either FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def set_2(s, d):
    p = table(s, d, "part")
    a, b = p.select("p_partkey", F.split("p_name", " ").alias("a")), p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.split("p_name", " ").alias("b"))
    return a.join(b, "p_partkey").select("p_partkey", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_union("a", "b")).alias("either"))


@query("set_3_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_3(s, d):
    return table(s, d, "documents").select("doc_id").subtract(table(s, d, "labels").select("doc_id"))


@query("set_4_keyword_union", "SELECT item_id, list_sort(list_distinct(list_concat(string_split(lower(text), ' '), ['the', 'la']))) AS keywords FROM benchmark")
def set_4(s, d):
    own = F.split(F.lower("text"), " ")
    return table(s, d, "benchmark").select("item_id", F.array_sort(F.array_union(own, F.array(F.lit("the"), F.lit("la")))).alias("keywords"))
