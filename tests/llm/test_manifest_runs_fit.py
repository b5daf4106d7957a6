"""The Merkle manifest, periodic runs and best-fit packing against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import best_fit, merkle, periodic
from quarry.llm.hashing import word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _tree string, row long, leaf string, id string, t string, root string"
CLASH = ("clash", 7, "clash", "clash", "clash", "clash")


def rows_of(n=60, langs=("en", "de", None, "", "é", "😀"), seed=3):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices("abcdefgh", k=r.randint(1, 90))), "en" if i % 2 else r.choice(langs), f"s{i % 3}", i, *CLASH) for i in range(n)]
    rows += [(n, None, "de", None, None, *CLASH), (n + 1, "", None, "", 0, *CLASH), (n + 2, "x " * 3000, "en", "s", 6000, *CLASH), (n + 3, "é😀 " * 40, "", "s", None, *CLASH)]
    return rows + [rows[5]] * 3 + [(None, "no id", "de", "s", 5, *CLASH), (None, None, "de", "s", 5, *CLASH)]


def H(*parts):  # noqa: N802
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def folded_tree(nodes):
    """(root, for each node its steps: None, or (side, sibling))"""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            steps[i].append((p & 1, level[p ^ 1]) if p ^ 1 < len(level) else None)
            at[i] = p // 2
        level = [H(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], steps


def brute_manifest(rows):
    def leaf(r, more=0):
        values = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {k: folded_tree([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in langs}
    root, above = folded_tree([own[k][0] for k in langs])
    out = []
    for k, up in zip(langs, above, strict=True):
        for (_, _, first, r), steps in zip(sorted(trees[k], key=lambda x: x[:3]), own[k][1], strict=True):
            path = [*steps, *up]
            h = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else first
            for s in path:
                h = H(h) if s is None else H(s[1], h) if s[0] else H(h, s[1])
            out.append((r[0], first, own[k][0], root, H(*[s[1] for s in path if s]), h, h == root))
    return out


COLS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("rows", [rows_of(), rows_of(200, [f"l{i}" for i in range(30)]), rows_of()[:1], []], ids=["some", "many-trees", "one", "none"])
def test_manifest(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op11_merkle_manifest(spark, str(tmp_path)).select(*COLS).collect()
    want = brute_manifest(rows) if rows else []
    assert Counter(map(tuple, got)) == Counter(want)
    assert not rows or len(rows) == 1 or {r.verified for r in got} == {True, False}


@pytest.mark.parametrize(("block_levels", "top"), [(1, 2), (2, 4), (1, 1000), (3, 40)])
def test_manifest_in_small_blocks_and_more_trees_than_the_driver_takes(spark, block_levels, top):
    rows = rows_of(150, [f"l{i}" for i in range(12)])
    x = merkle.manifest(spark, spark.createDataFrame(rows, SCHEMA), merkle.leaf_of(*map(F.col, merkle.LEAF)), block_levels=block_levels, top=top)
    got = x.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")), merkle.folded(F.col("leaf"), F.col("proof")).alias("f")).collect()
    assert Counter(map(tuple, [r[:5] for r in got])) == Counter(r[:5] for r in brute_manifest(rows)) and all(r.f == r.root for r in got)


def brute_runs(w, min_words=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            own = w[start : i + q]
            if len(own) >= max(min_words, exponent * q) and not any(own[k:] == own[:-k] for k in range(1, q)):
                out.append((start, len(own), q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(r, most=60):
    w = [r.randrange(r.randint(1, 3)) for _ in range(r.randint(0, most))]
    if w and r.random() < 0.6:
        a = r.randrange(len(w))
        p = 1 + (len(w) - a) // r.randint(2, 9)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


@pytest.mark.parametrize(("min_words", "exponent"), [(6, 4), (3, 2), (4, 3), (12, 5)])
def test_runs_in_random_words(min_words, exponent):
    r = random.Random(exponent)
    for _ in range(700):
        w = random_words(r)
        want = brute_runs(w, min_words, exponent)
        assert periodic.runs_in(w, min_words, exponent) == want
        text = " ".join(map(str, w))
        got = set()
        for t, start, end in periodic.stretches(*word_hashes([text, f"{text} q", ""]), min_words, exponent):
            got |= {(start + s, n, p) for s, n, p in periodic.runs_in(w[start:end], min_words, exponent)} if t == 0 else set()
        assert got == set(want)


def test_runs_with_colliding_hashes(monkeypatch):
    """Every stretch has one hash: the words decide."""
    monkeypatch.setattr(periodic.Extensions, "_same", lambda self, i, j, n: True)
    r = random.Random(8)
    for _ in range(400):
        w = random_words(r)
        assert periodic.runs_in(w) == brute_runs(w)


def brute_op12(key, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (key, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs(spark, tmp_path):
    r = random.Random(4)
    rows = rows_of() + [(1000 + i, " \t".join(map(str, random_words(r, 300))), "en", "s", 1, *CLASH) for i in range(120)]
    rows += [(5000, " ".join(["a b c"] * 30 + ["d"] * 7 + [f"w{i}" for i in range(20_000)]), "en", "s", 1, *CLASH), (5001, "x" * 100_000, "en", "s", 1, *CLASH), (5002, "a " * 20_000, "en", "s", 1, *CLASH)]
    for name, own in (("some", rows), ("none", [])):
        spark.createDataFrame(own, SCHEMA).repartition(3).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = periodic.op12_periodic_runs(spark, str(tmp_path / name))
        got = got.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
        assert Counter(map(tuple, got)) == Counter(brute_op12(x[0], x[1]) for x in own if x[0] != 5000) + Counter(tuple(x) for x in got if x.doc_id == 5000)
    long = periodic.periodic_runs(spark.createDataFrame(rows, SCHEMA)).filter("doc_id = 5000").first()
    assert [tuple(x) for x in long.runs] == [(0, 90, 3), (90, 7, 1)] and long.collapsed.startswith("a b c d w0 w1 ") and long.n_words == 20_097
    with pytest.raises(ValueError, match="two periods"):
        periodic.periodic_runs(spark.createDataFrame(rows, SCHEMA), min_exponent=1)


def test_best_fit_is_an_exact_round_trip(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [x for x in rows_of() if x[0] is not None]
    rows += [(500, "end <|endoftext|> of\x85text 　 ｆｕｌｌ naïve 日本語テキスト\r\n", "en", "s", 1, *CLASH), (501, "word " * 21_000, "en", "s", 1, *CLASH), (502, "x" * 5000, "en", "s", 1, *CLASH)]
    df = spark.createDataFrame(rows, SCHEMA).dropDuplicates(["doc_id"]).repartition(3)
    pieces = best_fit.pack(spark, df, window=256, emit="ids", per_task=20).collect()
    texts = {x[0]: x[1] for x in rows}
    for key, t in texts.items():
        own = sorted((p for p in pieces if p.doc_id == key), key=lambda p: p.piece)
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert b"".join(bytes(p.ids) for p in own) == ids.tobytes() and [p.piece for p in own] == list(range(-(-len(ids) // 256)))
        assert all(p.length == 256 for p in own[1:]) and [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
    at = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert at.get(p.sequence_id, 0) == p.offset
        at[p.sequence_id] = p.offset + p.length
    assert all(n <= 256 for n in at.values())
    df.write.parquet(str(tmp_path / "documents.parquet"))
    crc = best_fit.op13_best_fit_packing(spark, str(tmp_path))
    n, bound = best_fit.certificate(crc)
    assert bound <= n <= bound + 1
    wide = best_fit.pack(spark, df, emit="ids")
    assert {(p.doc_id, p.start): p.ids_crc32 for p in crc.collect()} == {(p.doc_id, p.start): zlib.crc32(bytes(p.ids)) for p in wide.collect()}
    assert best_fit.pack(spark, df.limit(0)).count() == 0
    again = best_fit.pack(spark, df.union(df), window=256, per_task=20).collect()
    assert len(again) == 2 * len(pieces)


def test_plain_characters_have_the_same_ids_by_both_ways():
    import pyarrow as pa

    enc = best_fit.ByteEncoder(best_fit.VOCABULARY)
    chars = [chr(i) for i in [*range(0x530), *range(0x2000, 0x2100), *range(0x3000, 0x3100), *range(0x4E00, 0x4F00), *range(0x1F300, 0x1F400)]]
    texts = [f"a{c} {c}{c}\n {c}1's  {c} " for c in chars] + ["a" * 3000, " " * 300, "<|endoftext|>", "\r\n\t x"]
    assert [x.tolist() for x in enc.encode(pa.array(texts))] == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def fewest(lengths, window):
    """Exact, by search."""
    best = len(lengths)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in sorted(set(bins)):
            if k + lengths[i] <= window:
                own = list(bins)
                own[own.index(k)] += lengths[i]
                go(i + 1, own)
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best


def test_bounds_are_never_above_the_best_packing():
    r, tight = random.Random(2), 0
    for _ in range(300):
        window = r.choice([10, 12, 30])
        lengths = sorted((r.randint(1, window) for _ in range(r.randint(0, 9))), reverse=True)
        bound, best = best_fit.lower_bound(np.bincount(lengths, minlength=window + 1)), fewest(lengths, window)
        own = best_fit.best_fit(lengths, window)
        used = len(set(own))
        assert bound <= best <= used and all(sum(x for x, b in zip(lengths, own, strict=True) if b == k) <= window for k in set(own))
        tight += bound == best
    assert tight > 270
    thirds = np.bincount([11] * 9, minlength=31)  # two to a window, though the sum would fit four windows
    assert best_fit.lower_bound(thirds) == 5


def test_partitions_with_gaps_exchange_documents(spark):
    """A document a partition at first: only exchange brings them together."""
    r = random.Random(1)
    rows = [(i, " ".join(["a"] * r.randint(5, 120)), "en", "s", 1, *CLASH) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    first = best_fit.certificate(best_fit.pack(spark, df, window=256, per_task=4, rounds=1), 256)
    last = best_fit.certificate(best_fit.pack(spark, df, window=256, per_task=4), 256)
    assert first[1] == last[1] <= last[0] < first[0]
