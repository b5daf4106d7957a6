"""Golden rows and invariants for the core operators."""

import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry import plans
from quarry.functions import chunks, stats, substrings, text
from quarry.functions import scores as S
from quarry.operators import analytics, bm25, filters, fusion, graph, incremental, ivf, lattice, lexicon, titles, vector
from quarry.sources import tables
from quarry.streaming import windows

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_score_formulas(spark):
    r = one(spark, S.similarity_percent(F.lit(0.25)), S.similarity_score(F.lit(3.0)), S.bm25_percent(F.lit(5.0)), S.rrf(F.lit(1), F.lit(2), F.lit(None).cast("int"), F.lit(3)), S.clamp(F.lit(None).cast("double")))
    assert r[0] == 75.0 and r[1] == 25.0 and r[2] == 25.0 and r[4] is None
    assert math.isclose(r[3], 1 / 61 + 0.8 / 62 + 0.6 / 63)


def test_statistics_of_nothing(spark):
    r = spark.range(0).agg(stats.mean0("id").alias("m"), stats.share(F.col("id") > 1).alias("s")).first()
    assert r.m == 0 and r.s == 0
    weeks = [one(spark, stats.week_of_month(F.lit(f"2024-01-{d:02}").cast("date")))[0] for d in (7, 8, 28, 29, 31)]
    assert weeks == [1, 2, 4, 5, 5]


def test_knn_orders_ties_by_key_and_skips_other_lengths(spark):
    df = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0]), (5, None)], "id long, v array<double>")
    assert [r.id for r in vector.knn(df, "v", "id", [1.0, 0.0], 3).collect()] == [1, 2, 3]


def test_bm25_prefers_rare_terms(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "a")], "id long, content string")
    assert bm25.search(df, "id", ["b"], 5).count() == 1
    assert {r.id for r in bm25.search(df, "id", ["a"], 5).collect()} == {1, 2, 3}
    assert bm25.search(df, "id", ["none"], 5).count() == 0


def test_dedup_is_unique_and_deterministic(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 2)) for i in range(9)], "id long, k long, d double")
    got = {r.k: r.id for r in fusion.first_by(df.repartition(5), ["k"], F.col("d"), F.col("id")).collect()}
    assert got == {0: 0, 1: 4, 2: 2}


def test_label_filters(spark):
    df = spark.createDataFrame([(1, ["En", "x"]), (2, []), (3, None)], "id long, labels array<string>")
    assert [r.id for r in df.filter(filters.has_any(F.col("labels"), ["EN"])).collect()] == [1]
    assert filters.excludes(["a"], {"t": ["b"], "u": ["c"]}, ["u"]) == ["a", "b"]


def test_chunks_cover_the_text(spark):
    for n in (0, 1, 1800, 1801, 2000, 5000):
        t = "".join(chr(97 + i % 26) for i in range(n))
        rows = one(spark, text.fixed_chunks(F.lit(t)))[0] or []
        assert "".join(r.content if i == 0 else r.content[200:] for i, r in enumerate(rows)) == t
    assert len(one(spark, text.fixed_chunks(F.lit("x" * 2000), compat_tail=True))[0]) == 1


def test_text_rules(spark):
    r = one(spark, text.strip_bom(F.lit("﻿a﻿")), text.html_to_text(F.lit("<p>a&lt;b</p>")), text.labels_as_array(F.lit('["a", "b"]')), text.token_estimate(F.lit("abcdé")), text.labels_as_array(F.lit(None).cast("string")))
    assert r[0] == "a" and r[2] == ["a", "b"] and r[3] == 4 and r[4] == []


def test_rich_text_and_common_substring(spark):
    raw = '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"a"},{"type":"hardBreak"},{"type":"text","text":"b"}]}]}'
    r = one(spark, text.rich_text(F.lit(raw)), substrings.longest_common(F.lit("abcd"), F.lit("xbcy")), text.nfkc(F.lit("Ａ")))
    assert r[0] == "a\nb" and r[1] == 2 and r[2] == "A"


def test_registered_text_queries_take_whole_texts(spark, tmp_path):
    far = "x" * 60 + "\nand the tion of it"
    spark.createDataFrame([(1, far), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rich, common = ({r.doc_id: r.value for r in plans.PLANS[n](spark, str(tmp_path)).collect()} for n in ("str_5_rich_text", "str_17_common_substring"))
    assert rich == {1: far, 2: "", 3: ""} and common == {1: 11, 2: 0, 3: 0}


def test_common_substring_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [("".join(rng.choice(list("abc"), rng.integers(0, 12))), "".join(rng.choice(list("abc"), rng.integers(0, 12)))) for _ in range(80)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", substrings.longest_common(F.col("a"), F.col("b")).alias("n")).collect()
    assert len(got) == 80 and all(r.n == max((j - i for i in range(len(r.a)) for j in range(i + 1, len(r.a) + 1) if r.a[i:j] in r.b), default=0) for r in got)


def test_sync_classification_at_the_second(spark):
    old = spark.sql("SELECT 1L id, timestamp_ntz'2024-01-01 00:00:00' t UNION ALL SELECT 2L, timestamp_ntz'2024-01-01 00:00:00' UNION ALL SELECT 3L, timestamp_ntz'2024-01-01 00:00:00'")
    new = spark.sql("SELECT 1L id, timestamp_ntz'2024-01-01 00:00:01' t UNION ALL SELECT 2L, timestamp_ntz'2024-01-01 00:00:01.001' UNION ALL SELECT 3L, CAST(NULL AS timestamp_ntz) UNION ALL SELECT 4L, NULL")
    got = {r.id: r._action for r in incremental.classify(new, old, "id", "t", F.lit(False)).collect()}
    assert got == {1: "unchanged", 2: "updated", 3: "updated", 4: "added"}


def test_tag_edges_equal_all_pairs(spark):
    sets = [(i, [f"t{(i * j) % 7}" for j in range(1, 5)]) for i in range(30)]
    got = {(r.a, r.b) for r in graph.tag_edges(spark.createDataFrame(sets, "id long, t array<string>"), "id", "t", 0.3).collect()}
    want = {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) >= 0.3 * len(set(x) | set(y))}
    assert got == want


def test_domain_links_keep_every_pair(spark):
    rows = [(i, None if i % 13 == 12 else i % 3, None if i % 11 == 10 else f"c{i % 4}") for i in range(60)]
    nodes = spark.createDataFrame(rows, "id long, d int, c string")
    links = graph.domain_links(nodes, "id", "d", "c")
    want = {(a, b, 0.5 + 0.2 * (c is not None and c == e)) for a, d, c in rows for b, f, e in rows if a < b and d is not None and d == f}
    assert len(want) > 5 * 60 and links.count() == sum(d is not None for _, d, _ in rows)
    got = [tuple(r) for r in graph.links_of(links).collect()]
    assert set(got) == want and len(got) == len(want)
    some = [tuple(r) for r in graph.links_of(links, spark.createDataFrame([(0,), (3,), (4,)], "node long")).collect()]
    assert set(some) == {w for w in want if {w[0], w[1]} & {0, 3, 4}} and len(some) == len(set(some))


def test_link_counts_are_those_of_the_pairs(spark):
    rows = [(i, None if i % 13 == 12 else i % 3, None if i % 11 == 10 else f"c{i % 4}") for i in range(60)]
    links = graph.domain_links(spark.createDataFrame(rows, "id long, d int, c string"), "id", "d", "c")
    want = {}
    for a, d, c in rows:
        near = [e for b, f, e in rows if b != a and d is not None and f == d]
        if d is not None:
            same = sum(c is not None and e == c for e in near)
            want[a] = (len(near), same, round(0.5 * len(near) + 0.2 * same, 6))
    assert {r.node: (r.links, r.same, round(r.weight, 6)) for r in graph.link_counts(links).collect()} == want


def test_tag_links_are_those_of_the_pairs(spark):
    sets = [(i, [f"t{(i * j) % 5}" for j in range(1, 4)]) for i in range(40)]
    df = spark.createDataFrame(sets, "id long, t array<string>")
    want = {}
    for r in graph.tag_edges(df, "id", "t", 0.3).collect():
        for i in (r.a, r.b):
            n, s, m = want.get(i, (0, 0.0, 0.0))
            want[i] = (n + 1, s + r.similarity, max(m, r.similarity))
    got = {r.id: (r.links, r.similarity, r.best) for r in graph.tag_links(df, "id", "t", 0.3).collect()}
    assert got.keys() == want.keys() and all(math.isclose(x, y) for i in want for x, y in zip(got[i], want[i], strict=True))


def test_graph_build_paths_and_importance(spark, tmp_path):
    pages = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", None]), (2, ["a", None]), (3, [])], "id long, labels array<string>")
    links = spark.createDataFrame([(1, 2), (1, 2), (2, 2), (2, 9)], "page long, to long")
    nodes, edges = graph.build(pages, "id", "labels", links)
    assert {r.id for r in nodes.collect()} == {"page:1", "page:2", "page:3", "concept:a", "concept:b"} and nodes.count() == 5
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("page:1", "concept:a"), ("page:1", "concept:b"), ("page:1", "page:2"), ("page:2", "concept:a")]
    ring = spark.createDataFrame([(i, (i + 1) % 6, 1.0) for i in range(6)], "src long, dst long, weight double")
    ranks = graph.importance(ring, str(tmp_path / "r"), 7, every=3).collect()
    assert len(ranks) == 6 and all(math.isclose(r.importance, 1 / 6) for r in ranks)
    assert {(r.id, r.hops) for r in graph.within(ring, spark.createDataFrame([(4,)], "id long"), 3).collect()} == {(4, 0), (5, 1), (0, 2), (1, 3)}


def test_places_in_order_without_a_sort(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(v)) for k, n in ((0, 1), (1, 2), (2, 500), (3, 301)) for v in (rng.normal(size=n) if k != 3 else np.repeat([1.0, 2.0, 7.5], n // 3 + 1)[:n])]
    df = spark.createDataFrame([*rows, (2, None)], "k int, v double").repartition(5)
    for cells in (1, 3, 4096):
        own = {k: sorted(v for x, v in rows if x == k) for k in range(4)}
        ranks = df.select("k").distinct().select("k", F.explode(F.array(*[F.lit(i).cast("long") for i in (0, 1, 250, 300, 499)])).alias("rank"))
        got = {(r.k, r["rank"]): r.v for r in analytics.at_ranks(df, "k", "v", ranks, cells).collect()}
        assert got == {(k, i): v[i] for k, v in own.items() for i in (0, 1, 250, 300, 499) if i < len(v)}
    q = {r.k: (r.a, r.b) for r in analytics.quantiles(df, "k", "v", {"a": 50, "b": 95}).collect()}
    assert all(math.isclose(q[k][0], np.percentile(v, 50)) and math.isclose(q[k][1], np.percentile(v, 95)) for k, v in own.items())
    near = {r.k: r.p for r in analytics.nearest_ranks(df, "k", "v", {"p": 90}).collect()}
    assert near == {k: v[min(len(v) * 90 // 100, len(v) - 1)] for k, v in own.items()}


def test_lexicon_in_blocks_finds_what_contains_finds(spark):
    words = [(f"{a}{b}", c) for a in "abc" for b in ("", "b", "ca") for c in ("core", "domain") if not (a == "c" and c == "core")]
    texts = [(1, "Abca cab"), (2, "xyz"), (3, None), (4, ""), (5, "CC")]
    want = {(k, w, c) for k, t in texts if t for w, c in words if w in t.lower()}
    lex = spark.createDataFrame([*words, ("", "core")], "keyword string, category string")
    df = spark.createDataFrame(texts, "id long, t string")
    for rows in (100, 3):
        assert {tuple(r) for r in lexicon.matches(df, "id", "t", lex, rows).collect()} == want


def test_saved_index_is_searched_like_the_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a a b", "t one"), (2, "a c", "b"), (3, "a", None), (4, None, "c c")], "id long, content string, title string")
    path = str(tmp_path / "index")
    for _ in range(2):  # a second version takes the place of the first
        bm25.save_index(df, path, "id", ("content", "title"), 4)
    for terms in (["b"], ["a", "c"], ["none"]):
        found = [[(r.id, round(r.score, 9), r.match_count) for r in x.collect()] for x in (bm25.search(df, "id", terms, 9, ("content", "title")), bm25.search_index(spark, path, terms, 9, ("content", "title")))]
        assert found[0] == found[1]


@pytest.mark.parametrize(("direct", "most"), [(0, 200_000), (0, 0), (200_000, 200_000)])
def test_block_bounds_lose_no_row_and_read_less(spark, tmp_path, monkeypatch, direct, most):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        common = ["the"] * int(rng.integers(0, 4)) + [f"w{x}" for x in rng.integers(0, 200, 30)]
        rows.append((i, " ".join([*common, *(["rare"] * (i % 149 == 0)), *(["rareword"] * (i % 97 == 0))]), "the title" if i % 50 == 0 else "x"))
    df = spark.createDataFrame(rows, "id long, content string, title string")
    path = str(tmp_path / "index")
    bm25.save_index(df, path, "id", ("content", "title"), 4, docs_a_range=16)
    monkeypatch.setattr(bm25, "DIRECT", direct)
    monkeypatch.setattr(bm25, "MOST_RANGES", most)
    index = bm25.SavedIndex(spark, path)
    for terms, k, wildcard in ((["the", "rare"], 4, False), (["rare"], 5, True), (["ar"], 7, True), (["the"], 10, False), (["absent"], 3, False), (["w1", "w2", "the"], 600, False)):
        one, two = (x.select("id", F.round("score", 8).alias("s"), "match_count").collect() for x in (bm25.search(df, "id", terms, k, ("content", "title"), wildcard), index.search(terms, k, ("content", "title"), wildcard)))
        assert one == two
    kept, read, all_ = index.wanted(index.matching(["the", "rare"], ("content", "title")), 4)
    assert 0 < read < all_ / 2 and all_ == sum((r[1].split().count("the") > 0) + (r[0] % 50 == 0) + (r[0] % 149 == 0) for r in rows)
    assert sorted(r.term for r in index.containing("are").collect()) == ["rare", "rareword"] and [r.term for r in index.containing("ewo").collect()] == ["rareword"]


def test_quantized_index_reads_a_part_and_finds_nearly_all(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4, (12, 32))
    x = np.concatenate([c + rng.normal(0, 1, (80, 32)) for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9990, None), (9991, [1.0]), (9992, [None, *[0.0] * 31])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    trained = ivf.train(df, "v", "id", cells=16, parts=8, codes=32, sample=500, rounds=4)
    assert trained.cells.shape == (16, 32) and trained.codes.shape == (8, 32, 4)
    ivf.save(df, str(tmp_path / "i"), "v", "id", trained, buckets=4)
    index = ivf.Index(spark, str(tmp_path / "i"))
    assert index.codes.count() == len(x) == index.keys.count() and {len(r.codes) for r in index.codes.collect()} == {8}
    q = df.filter("id % 40 = 0")
    found = {(r.q, r.id): r.distance for r in index.search(q, "id", "v", 5, nprobe=4, rerank=40).collect()}
    exact = {(a, int(b)): ((x[b] - x[a]) ** 2).sum() for a in range(0, len(x), 40) for b in np.argsort(((x - x[a]) ** 2).sum(axis=1), kind="stable")[:5]}
    hits = found.keys() & exact.keys()
    assert len(found) == len(exact) and len(hits) >= 0.9 * len(exact) and all(math.isclose(found[p], exact[p], abs_tol=1e-9) for p in hits)
    assert 0 < index.share_read(q, "v", 4) < 0.6
    everything = {(r.q, r.id) for r in index.search(q, "id", "v", 5, nprobe=16, rerank=len(x)).collect()}
    assert everything == exact.keys()
    assert index.get(77).first().v == x[77].tolist() and index.get(12345).count() == 0
    with pytest.raises(ValueError, match="parts"):
        ivf.train(df, "v", "id", parts=7)


def cheapest(words, run):
    """Brute force: every way to cut a run into words and stretches of one class."""
    total = sum(n for _, n, _ in words)
    cost = {w: (-math.log(n / total), k) for w, n, k in words}
    starts = {w[0] for w in cost}

    def ways(at):
        if at == len(run):
            yield 0.0, ()
        for end in range(at + 1, len(run) + 1):
            t = run[at:end]
            kinds = {lattice.class_of(c) for c in t}
            own = [cost[t]] if t in cost else []
            whole = end == len(run) or lattice.class_of(run[end]) not in kinds
            if len(kinds) == 1 and (whole or run[end] in starts or len(t) == 1):
                own.append((lattice.UNKNOWN + lattice.BY_CHARACTER * len(t), "number" if kinds == {"number"} else "unknown"))
            for c, k in own:
                for rest, tokens in ways(end):
                    yield c + rest, ((t, k), *tokens)

    found = [(round(c, 6), len(t), [-len(x) for x, _ in t], t) for c, t in ways(0)]
    return list(min(found)[3]) if found else []


def test_lattice_paths_are_the_cheapest():
    words = [("ab", 5, "noun"), ("abc", 2, "word"), ("c", 9, "word"), ("cab", 3, "noun"), ("東京", 7, "noun"), ("京都", 4, "noun"), ("都", 2, "word"), ("に", 9, "word")]
    d, rng = lattice.Dictionary.of(words), np.random.default_rng(1)
    for n in range(9):
        for _ in range(60):
            run = "".join(rng.choice(list("abcx7東京都にカ"), n, p=[0.2, 0.2, 0.15, 0.05, 0.05, 0.1, 0.1, 0.05, 0.05, 0.05]))
            assert d.segment(run) == cheapest(words, run)
    assert d.segment("東京都に") == [("東京", "noun"), ("都", "word"), ("に", "word")] and d.segment("") == []


def test_lattice_tokens_serve_the_index(spark, tmp_path):
    texts = [(1, "Das Haus, das Boot; Hausboot hausboot77"), (2, "das Haus boot Boot Haus"), (3, None), (4, ""), (5, "xyz " + "Hausboot " * 20_000)]
    df = spark.createDataFrame(texts, "id long, content string")
    words = lattice.learn(df, "content", least=2)
    assert [tuple(r) for r in words.collect()] == [("hausboot", 20_001, "noun"), ("boot", 3, "noun"), ("das", 3, "word"), ("haus", 3, "noun")]
    small = words.filter("word <> 'hausboot'")
    cut = lattice.analyzer(small)
    rows = {r.id: r.t for r in df.select("id", bm25.tokens(F.col("content"), cut).alias("t")).collect()}
    assert rows[1] == ["das", "haus", "das", "boot", "haus", "boot", "haus", "boot", "77"] and rows[3] is None and rows[4] == []
    assert rows[5] == ["xyz", *["haus", "boot"] * 20_000]
    nouns = {r.id: r.t for r in df.filter("id < 3").select("id", bm25.nouns(F.col("content"), lattice.analyzer(small, (lattice.NOUN,))).alias("t")).collect()}
    assert nouns[1] == ["haus", "boot", "haus", "boot", "haus", "boot"]
    bm25.save_index(df, str(tmp_path / "i"), "id", ("content",), 4, analyzer=cut)
    index = bm25.SavedIndex(spark, str(tmp_path / "i"))
    assert [r.id for r in index.search(["boot"], 9).orderBy("id").collect()] == [1, 2, 5] and index.stats["avg_content"] == (9 + 5 + 0 + 40_001) / 4
    with pytest.raises(ValueError, match="words at most"):
        lattice.held(small, 2)


def test_title_matches_by_what_lies_between(spark):
    titles = ["教室グループ削除機能", "教室削除機能", "削除教室の一覧を出す画面", "教室を削除", "教室一覧", None, "\ufeff教室 削除", "教室abcdefghij削除"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id long, title string")
    got = [round(r.m, 6) for r in df.select("id", bm25.title_match(F.col("title"), ["教室", "削除"], generic=["機能"]).alias("m")).orderBy("id").collect()]
    assert got == [0.7, 1.0, 0.8, 1.0, 0.5, 0.0, 1.0, 0.7]
    one = df.select(bm25.title_match(F.col("title"), ["教室一覧画面"], domain=["教室一覧"]).alias("m")).distinct().collect()
    assert {r.m for r in one} == {0.0}
    assert df.select(bm25.title_match(F.col("title"), ["教室", "x"], domain=["教"]).alias("m")).collect()[4].m == 0.7


def test_components_and_typed_graph(spark, tmp_path):
    rng = np.random.default_rng(4)
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(40) if i != 20] + [("hub", f"h{i}") for i in range(50)] + [("z", "z")] + [(f"r{a}", f"r{b}") for a, b in rng.integers(0, 60, (40, 2))]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(pairs, "a string, b string"), str(tmp_path / "c")).collect()}
    assert got == {x: root(x) for x in {y for p in pairs for y in p}}

    pages = spark.createDataFrame([(1, "Start", ["完了", "faq", None]), (2, "Other", None), (9, "No knowledge", ["faq"])], "page long, title string, labels array<string>")
    known = [(1, {"Login": ["Login API", "login  api", "password"], "空": []}), (2, {"login": ["Ｌｏｇｉｎ API", "保存ボタン"]}), (7, {"Lost": ["x"]}), (1, None)]
    nodes, edges = graph.typed_graph(spark.createDataFrame(known, "page long, functions map<string, array<string>>"), pages, str(tmp_path / "g"))
    n = {(r.type, r.name): (r.pages, r.subtype) for r in nodes.collect()}
    assert n == {
        ("Page", "Start"): (1, None), ("Page", "Other"): (1, None), ("Function", "Login"): (2, None), ("Function", "空"): (1, None), ("Keyword", "Login API"): (2, None), ("Keyword", "password"): (1, None),
        ("Keyword", "保存ボタン"): (1, None), ("SystemItem", "Login API"): (2, "API"), ("SystemItem", "保存ボタン"): (1, "Button"), ("Label", "完了"): (1, "Status"), ("Label", "faq"): (1, "General"),
    }
    name = {r.id: r.name for r in nodes.collect()}
    e = {(name[r.src], r.relation, name[r.dst]): r.n for r in edges.collect()}
    assert e[("Login", "ASSOCIATED_WITH", "Login API")] == 3 and e[("Login", "CONTAINS", "Login API")] == 2 and e[("Start", "DESCRIBES", "Login")] == 1 and e[("Start", "TAGGED_WITH", "完了")] == 1
    assert e[("Other", "RELATES_TO", "Start")] == 1 and {r for _, r, _ in e} == {"DESCRIBES", "ASSOCIATED_WITH", "CONTAINS", "TAGGED_WITH", "RELATES_TO"}


def test_suffix_automata_find_what_loops_find(spark):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abc"), n))
    for _ in range(300):
        patterns, t = [word(rng.integers(0, 9)) for _ in range(rng.integers(0, 5))], word(rng.integers(0, 25))
        length, start, pattern = substrings.Automaton(patterns).longest(t)
        best = max((n for p in patterns for i in range(len(p)) for n in range(1, len(p) - i + 1) if p[i : i + n] in t), default=0)
        assert length == best and (pattern >= 0) == (best > 0)
        if best:
            assert t[start : start + best] in patterns[pattern] and not any(t[i : i + best] in p for p in patterns for i in range(start))
    long = "ab" * 20_000 + "needle" + "ba" * 20_000
    df = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "x\uffffneed")], "id long, t string")
    rows = {r.id: tuple(r.f) for r in df.select("id", substrings.common_with(spark, F.col("t"), ["eedl", "need", "zz"]).alias("f")).collect()}
    assert rows == {1: (4, 40_000, 1), 2: (0, 0, -1), 3: (0, 0, -1), 4: (4, 2, 1)}
    assert [r.h for r in df.orderBy("id").select(substrings.has_common(F.col("t"), F.lit("edle"), 4).alias("h")).collect()] == [True, False, False, False]
    with pytest.raises(ValueError, match="characters at most"):
        substrings.common_with(spark, F.col("t"), ["x" * 1_000_001])


def test_titles_meet_like_all_pairs(spark):
    import re

    def keys(t):
        return set(re.findall("[\u3040-\u309f\u30a0-\u30ff\u4e00-\u9faf]{2,}", re.sub(r"^[\d_]*[【（(]?[A-Z]+[】）)]?\s*", "", t.strip()).strip()))

    def kind(t, r):
        a, b = t.strip(), r.strip()
        if a == b and a:
            return 0
        x, y = (re.sub(r"^\d+_", "", v).strip() for v in (a, b))
        if x and x == y:
            return 1
        if (a and b and (a in b or b in a)) or (x and y and (x in y or y in x)):
            return 2
        common = keys(t) & keys(r)
        return 3 if any(len(w) >= 3 for w in common) or len(common) >= 2 else None

    rng = np.random.default_rng(7)
    parts = ["教室", "全体管理者", "削除", "機能", "ログイン", "の", "x", "API ", "【FIX】", "12_", "7_", " ", "画面一覧"]
    make = lambda n: ["".join(rng.choice(parts, rng.integers(0, 5))) for _ in range(n)]
    own, refs = [*make(120), None, "", "453_【FIX】パスワード再設定機能", "超管理部門 zz"], [*make(60), None, "超管理部門 yy", "045_【FIX】パスワード再設定機能", "全体管理者 ログアウト", "x"]
    rows = titles.fuzzy_titles(*(spark.createDataFrame([(i, t) for i, t in enumerate(x)], "id long, title string") for x in (own, refs))).collect()
    want = {i: min(((k, j) for j, r in enumerate(refs) if r is not None and (k := kind(t or "", r)) is not None), default=(None, None)) for i, t in enumerate(own)}
    assert {r.id: (r.kind, r.ref) for r in rows} == {i: (None if k is None else titles.KINDS[k], j) for i, (k, j) in want.items()}
    assert {r.kind for r in rows} == {None, *titles.KINDS}


def test_index_rows_are_sorted_by_term_not_by_bucket(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11} common") for i in range(60)], "id long, content string")
    plans, write = [], bm25.tables.replace_all
    monkeypatch.setattr(bm25.tables, "replace_all", lambda parts, path: (plans.append(parts["postings"][0]._jdf.queryExecution().optimizedPlan().toString()), write(parts, path))[1])
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    bm25.save_index(docs, str(tmp_path / "i"), "id", ("content",), 4, 16)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert plans[0].split("Sort [", 1)[1].startswith("term")
    files = list((tmp_path / "i").glob("v-*/postings/bucket=*/*.parquet"))
    assert files
    for f in files:
        terms = [r.term for r in spark.read.parquet(str(f)).collect()]
        assert terms == sorted(terms)


def test_titles_in_titles_of_all_lengths_with_few_candidates(spark):
    rng = np.random.default_rng(11)
    # Few syllables, so every three characters of a title are in very many others.
    words = ["".join(rng.choice(["ban", "dan", "tan"], rng.integers(1, 4))) for _ in range(40)]
    lines = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(300)] + ["é", "bé", "\U0001f600 dan"]
    cut = lambda t, i: t[(a := int(rng.integers(0, 9))) : a + 1 + (i * 7) % 150].strip()
    refs = [cut(t, i) for i, t in enumerate(lines)] + ["x " + lines[5] + " y", "dan"]
    own = [*lines, *[cut(t, i + 3) for i, t in enumerate(lines)]]
    frame = lambda x: spark.createDataFrame([(i, t) for i, t in enumerate(x)], "id long, title string")
    rows = titles.fuzzy_titles(frame(own), frame(refs), "[0-9]{9,}", 12).collect()
    kind = lambda a, b: 0 if a == b != "" else 2 if a and b and (a in b or b in a) else None
    want = {i: min(((k, j) for j, r in enumerate(refs) if (k := kind(t, r)) is not None), default=(None, None)) for i, t in enumerate(own)}
    assert {r.id: (r.kind, r.ref) for r in rows} == {i: (None if k is None else titles.KINDS[k], j) for i, (k, j) in want.items()}
    # Long titles meet few that do not hold them: over three characters each met nearly all 600.
    long = [" ".join(rng.choice(words, 12)) for _ in range(600)]
    texts = spark.createDataFrame([(i, t, i % 2, None if i % 2 else i, None) for i, t in enumerate(long)], "h long, text string, own int, ref_a long, ref_b long")
    assert titles.candidates(texts).count() < 600


def test_cheapest_ways_with_a_hub(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, 40, 160), rng.integers(0, 40, 160), rng.integers(0, 9, 160), strict=True)] + [(99, i, 5) for i in range(40)] + [(i, 99, 5) for i in range(40)] + [(200, 201, 1)]
    found = graph.shortest(spark.createDataFrame(rows, "src long, dst long, cost long"), spark.createDataFrame([(0,), (5,), (0,)], "id long"), str(tmp_path / "w"))
    got = {(r.start, r.id): (r.cost, r.hops, r.via) for r in found.collect()}
    for start in (0, 5):
        best = {start: (0, 0)}
        for _ in range(60):
            for a, b, c in rows:
                if a in best and (best[a][0] + c, best[a][1] + 1) < best.get(b, (1 << 60, 0)):
                    best[b] = (best[a][0] + c, best[a][1] + 1)
        assert {i: w[:2] for (s, i), w in got.items() if s == start} == best
        way = graph.way_to(found, start, 17)
        cost = {(a, b): min(c for x, y, c in rows if (x, y) == (a, b)) for a, b, _ in rows}
        assert way[0] == start and way[-1] == 17 and sum(cost[p] for p in zip(way, way[1:], strict=False)) == best[17][0]
    assert graph.way_to(found, 0, 201) == []


def test_a_round_of_ways_sorts_no_edges(spark):
    front = spark.createDataFrame([(1, 1, 0), (2, 2, 3)], "start long, id long, cost long")
    edges = spark.createDataFrame([(1, 5, 4), (2, 5, 1), (2, 6, 1), (9, 6, 1), (1, 7, 2)], "src long, dst long, cost long")
    x = graph._one_further(front, edges.union(edges))
    assert sorted(map(tuple, x.collect())) == [(1, 5, 4, 1), (1, 7, 2, 1), (2, 5, 4, 2), (2, 6, 4, 2)]
    plan = x._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_importance_writes_edges_without_meeting_their_sums(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 90), rng.integers(0, 35, 90), rng.integers(1, 6, 90), strict=True)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    got = {r.id: r.importance for r in graph.importance(edges, str(tmp_path / "r"), 7, every=3).collect()}
    nodes = sorted({x for a, b, _ in rows for x in (a, b)})
    total = {a: sum(w for x, _, w in rows if x == a) for a, _, _ in rows}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(7):
        lost = sum(r for i, r in rank.items() if i not in total) / len(nodes)
        rank = {i: 0.15 / len(nodes) + 0.85 * (lost + sum(rank[a] * w / total[a] for a, b, w in rows if b == i)) for i in nodes}
    assert got.keys() == rank.keys() and all(abs(got[i] - rank[i]) < 1e-12 for i in nodes)
    assert spark.read.parquet(str(tmp_path / "r" / "moves")).columns == ["src", "dst", "weight"]


def test_importance_keeps_the_rank_of_dead_ends(spark, tmp_path):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("d", "a", 1.0)]  # c leads nowhere, nothing leads to d
    got = {r.id: r.importance for r in graph.importance(spark.createDataFrame(edges, "src string, dst string, weight double"), str(tmp_path / "r"), 7, every=3).collect()}
    out = {n: sum(w for a, _, w in edges if a == n) for n in "abcd"}
    r = dict.fromkeys("abcd", 0.25)
    for _ in range(7):
        lost = sum(r[n] for n in "abcd" if not out[n]) / 4
        r = {n: 0.15 / 4 + 0.85 * (lost + sum(r[a] * w / out[a] for a, b, w in edges if b == n)) for n in "abcd"}
    assert got.keys() == r.keys() and all(math.isclose(got[n], r[n]) for n in r) and math.isclose(sum(got.values()), 1)


def test_sentence_spans_cover_the_text_and_go_on():
    rng = np.random.default_rng(2)
    for n in (0, 1, 60, 500, 3000):
        t = "".join(rng.choice(list("abc .!?。"), n, p=[0.3, 0.3, 0.2, 0.1, 0.04, 0.02, 0.02, 0.02]))
        for size, overlap in ((100, 20), (50, 90), (7, 0)):
            spans = chunks.sentence_spans(t, size, overlap)
            assert [a for a, _ in spans[1:]] == sorted({a for a, _ in spans[1:]}) and all(b - a <= size for a, b in spans)
            assert {i for a, b in spans for i in range(a, b)} == set(range(n))
    assert chunks.sentence_spans("One two. Three four. Five", 12, 0)[0] == (0, 8)


def test_sentence_pieces_are_the_text(spark):
    t = "One. Two! " + "x" * 500 + "? Three\nFour. " + "y" * 10
    got = spark.range(1).select(text.sentence_pieces(100)(F.lit(t)).alias("p")).first().p
    assert "".join(got) == t and all(len(p) <= 100 for p in got) and got[0] == "One. Two! "[: len(got[0])] and spark.range(1).select(text.sentence_pieces(5)(F.lit(None).cast("string")).alias("p")).first().p == []


def test_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.append(spark.range(5), path)
    tables.append(spark.range(5, 8), path)
    assert sorted(r.id for r in tables.load(spark, path, where=F.col("id") % 2 == 1).collect()) == [1, 3, 5, 7]


def test_upserts_by_batch_and_distinct_events(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    windows.upsert_batches(stream, str(tmp_path / "out"), "id", str(tmp_path / "check")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / "v1")).collect())) == [(1, "a"), (2, "b")]
    assert windows.distinct_events(rows.union(rows), "v", "id", "1 hour").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select((F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 400)).alias("ts"), F.when(F.col("id") % 7 == 0, "error").otherwise("view").alias("event_type"), F.col("id").cast("double").alias("value"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windows.windowed(stream, "ts", "1 hour", late="10 minutes").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, windows.windowed(spark.read.parquet(str(tmp_path / "in")), "ts", "1 hour").collect()))


def test_cells_find_all_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 8))
    v[100:140] = v[0]  # ties go by key
    df = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), (900, [1.0]), (901, None)], "id long, v array<double>").repartition(5)
    q, c = df.filter("id % 20 = 0"), v[:10].tolist()
    near = vector.cell_knn(vector.assign_cells(df, "v", c), "v", "id", q, "id", "v", c, 7, block=6).collect()
    want = {(i, int(j), r + 1) for i in range(0, 400, 20) for r, j in enumerate(np.argsort(((v - v[i]) ** 2).sum(axis=1), kind="stable")[:7])}
    assert {(r.q, r.id, r["rank"]) for r in near} == want and len(near) == len(want)
    exact = vector.batch_knn(df, "v", "id", q, "id", "v", 7).collect()
    assert {(r.q, r.id, r.distance) for r in near} >= {(r.q, r.id, r.distance) for r in exact if r.distance is not None}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_recall_of_cells_over_all_queries(spark):
    r = plans.PLANS["evl_5_recall_of_cells"](spark, SF).first()
    assert r.queries == 5 and r.recalled and r.part_read


def test_an_index_of_more_documents_has_more_slices(spark, tmp_path, monkeypatch):
    """No file of postings or bounds grows with the number of documents, and rows found stay the same."""
    df = spark.range(900).select("id", F.concat_ws(" ", F.lit("all"), F.concat(F.lit("w"), F.col("id") % 7), F.concat(F.lit("v"), F.col("id") % 90)).alias("content"))
    found = {}
    for most in (4096, 8):
        monkeypatch.setattr(bm25, "DOCS_A_FILE", most)
        path = str(tmp_path / f"i{most}")
        bm25.save_index(df, path, "id", ("content",), 2, docs_a_range=4)
        monkeypatch.setattr(bm25, "DIRECT", 0)
        rows = bm25.search_index(spark, path, ["all", "w3", "v5"], 20, ("content",)).collect()
        tables_ = [spark.read.parquet(f"{tables.at(spark, path)}/{t}") for t in ("postings", "bounds")]
        found[most] = [tuple(r) for r in rows], [max(r["count"] for r in t.groupBy("_metadata.file_name", "bucket").count().collect()) for t in tables_]
    assert found[8][0] == found[4096][0] and len(found[8][0]) == 20
    assert found[8][1][0] * 8 < found[4096][1][0] and found[8][1][1] * 8 < found[4096][1][1]


def test_a_dictionary_takes_little_memory():
    """200,000 words, as a task holds them."""
    import tracemalloc

    rng = np.random.default_rng(5)
    words = [("".join(w), 5, "noun") for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (200_000, 9))]
    tracemalloc.start()
    d = lattice.Dictionary.of(words)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 100e6 and d.segment(words[0][0] + words[1][0]) == [(words[0][0], "noun"), (words[1][0], "noun")]


def test_long_texts_come_in_short_batches(spark):
    from quarry.plans.registry import short_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    try:
        short_batches(spark)
        x = spark.range(0, 600, 1, 1).select(F.repeat(F.concat(F.lit("ab"), "id"), F.lit(10_000)).alias("t"))
        sizes = F.pandas_udf(lambda t: t.map(lambda _: len(t)), "long")
        assert x.select(sizes("t").alias("n")).agg(F.max("n")).first()[0] < 300
    finally:
        spark.conf.set(name, was)


def test_titles_are_not_gathered_on_the_driver(spark):
    """No table of titles is broadcast, however small Spark thinks it is: the estimate is of compressed bytes, and the driver holds all such tables at once."""
    frame = lambda n: spark.range(n).select("id", F.concat(F.lit("title of "), F.col("id") % 40).alias("title"))
    rows = titles.fuzzy_titles(frame(60), frame(50))
    assert {(r.kind, r.ref) for r in rows.collect() if r.id in (3, 43)} == {("equal", 3)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_lattice_of_long_and_many_runs_takes_linear_time(spark):
    """Unknown stretches may end before every letter that starts a word: each place looked at all that follow."""
    import time

    words = [("ab", 5, "noun"), ("abc", 2, "word"), ("c", 9, "word"), ("cab", 3, "noun"), ("x", 1, "word"), ("京都", 4, "noun")]
    d, rng = lattice.Dictionary.of(words), np.random.default_rng(6)
    long = "".join(rng.choice(list("abcx"), 12_000))
    start = time.process_time()
    found = d.segment(long)
    assert time.process_time() - start < 5 and "".join(t for t, _ in found) == long
    runs = ["".join(rng.choice(list("abcx7京都"), n)) for n in rng.integers(0, 9, 400)]
    runs += [long, "", "a", long[:300]]
    want = [d.segment(r) for r in runs]
    assert want[:400] == [cheapest(words, r) for r in runs[:400]]
    assert d.segments(runs).to_pylist() == [[t for t, _ in w] for w in want]
    assert d.segments(runs, (lattice.NOUN, lattice.NUMBER)).to_pylist() == [[t for t, kind in w if kind in ("noun", "number")] for w in want]
    assert lattice.Dictionary.of([]).segments(["ab7", ""]).to_pylist() == [["ab", "7"], []] and d.segments([]).to_pylist() == []


def test_lattice_analyzer_takes_short_batches(spark):
    from quarry.plans.registry import short_batches

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    try:
        short_batches(spark)
        x = spark.range(0, 600, 1, 1).select(F.split(F.repeat(F.concat(F.lit("ab "), "id"), F.lit(8_000)), " ").alias("t"))
        sizes = F.arrow_udf(lambda t: pa.array([len(t)] * len(t)), "long")
        assert x.select(sizes("t").alias("n")).agg(F.max("n")).first()[0] < 300
    finally:
        spark.conf.set(name, was)


def test_runs_of_the_last_batches_are_not_segmented_again(monkeypatch):
    d = lattice.Dictionary.of([("ab", 5, "noun"), ("c", 9, "word")])
    asked, cut = [], d.segments
    monkeypatch.setattr(d, "segments", lambda runs, kinds=None: asked.append(list(runs)) or cut(runs, kinds))
    batches = [["abc", "", "cab"], ["cab", "abab", "abc"], ["xyz" * 9], ["abc", "cab"]]
    for kept, want in ((1000, [batches[0], ["abab"], batches[2], []]), (12, [batches[0], ["abab"], batches[2], batches[3]])):
        monkeypatch.setattr(lattice, "KEPT", kept)
        for kinds in (None, ("noun",)):
            asked.clear()
            d.kept.clear()
            assert [d.known(pa.array(b), kinds).to_pylist() for b in batches] == [cut(b, kinds).to_pylist() for b in batches]
            assert asked == want


def test_vector_index_is_fitted_on_all_rows_and_its_share_counted_over_all_queries(spark, tmp_path, monkeypatch):
    df = spark.range(70_000).select("id", F.array(F.col("id").cast("double"), F.lit(0.0)).alias("v"))
    assert ivf.train(df, "v", "id", cells=1, parts=1, codes=1, rounds=1).cells.tolist() == [[34_999.5, 0.0]]  # the mean of all
    monkeypatch.setattr(ivf, "BLOCK", 4)
    few = df.filter("id < 1000").select("id", F.array(F.col("id") * F.col("id"), F.lit(0.0)).alias("v"))  # cells of very different sizes
    ivf.save(few, str(tmp_path / "i"), "v", "id", ivf.train(few, "v", "id", cells=9, parts=1, codes=4), buckets=2)
    index = ivf.Index(spark, str(tmp_path / "i"))
    sizes = {r["cell"]: r["count"] for r in index.codes.groupBy("cell").count().collect()}
    q = np.array([[float(i * i), 0.0] for i in range(0, 1000, 7)])
    want = np.mean([sum(sizes.get(int(c), 0) for c in own) / 1000 for own in index.probes(q, 2)])
    assert math.isclose(index.share_read(few.filter("id % 7 = 0"), "v", 2), want) and len(set(sizes.values())) > 1
    assert index.share_read(few.filter("id < 0"), "v", 2) == 0.0
    assert ivf._rounds(few.filter("id IN (2, 4)").select("v").repartition(8), 2, np.zeros((1, 1, 2)), 1).tolist() == [[[10.0, 0.0]]]  # most tasks are empty
