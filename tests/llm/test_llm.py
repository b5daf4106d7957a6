"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import classifier, components, exact_dedup, hashing, line_dedup, mixing, ngram_join, packing, pii, quality_rules, repeats, substring_dedup, suffix_array, suffix_dedup
from quarry.llm.common import Scratch, new_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, n long, t string"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(r.choices(words, k=40))
    texts = []
    for i in range(n):
        t = " ".join(r.choices(words, k=r.randint(1, 120)))
        if i % 5 == 0:
            t = f"{t} {passage} {' '.join(r.choices(words, k=5))}"
        if i % 7 == 0 and texts:
            t = texts[-1]
        if i % 11 == 0:
            t = "tail tail tail " * 30 + "\n" + t
        texts.append(t)
    return [*texts, None, "", " \t ", "é😀 " * 50, "x" * 5000, "a b c"]


def frame(spark, texts, ids=None):
    rows = [((ids or range(len(texts)))[i], t, "en", None if i % 9 == 8 else f"src{i % 3}", 1, 7, 7, 7, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def test_exact_dedup(spark, docs, texts, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(spark, docs, rows_per_owner=20).collect()}
    by = {}
    for i, t in enumerate(texts):
        by.setdefault(t or "", []).append(i)
    for i, t in enumerate(texts):
        g = by[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(g), len(g), i == max(g))
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).digest()
    assert exact_dedup.exact_dedup(spark, empty).count() == 0


def test_golomb_round_trip():
    for n, universe in ((0, 10), (1, 1), (5, 5), (100, 1 << 40), (1000, 1 << 14)):
        v = np.sort(np.random.default_rng(n).choice(universe, n, replace=False) if universe < 1 << 20 else np.unique(np.random.default_rng(n).integers(0, universe, n)))
        assert (exact_dedup.golomb_decode(len(v), *exact_dedup.golomb_encode(v, universe)) == v).all()


def mixed(rows, weights=(5, 2, 1), most=3):
    """Brute force: (id, source, size) -> words taken of each id."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(n for _, x, n in rows if x == s) for s in sources}
    w = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = sum(w[s] for s in sources if s not in full)
        over = {s for s in sources if s not in full and left * w[s] >= most * sizes[s] * free}
        if not over:
            break
        full |= over
    taken = {}
    for s in sources:
        budget = most * sizes[s] if s in full else left * w[s] // free
        own = sorted((int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:12], 16), i, n) for i, x, n in rows if x == s)
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        for _, i, n in own:
            taken[i] = epochs * n + min(n, rest)
            rest -= min(n, rest)
    return taken


def test_mixing(spark, docs, empty):
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = mixing.mix(spark, docs, size, rows_per_block=5).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in mixing.mix(spark, docs, size).collect()} == mixed([(r.doc_id, r.source, r["size"]) for r in rows])
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert sum(r["size"] for r in own) == own[0].source_size and sum(r.taken for r in own) == int(own[0].target)
        assert all(r.taken <= 3 * r["size"] for r in own)
    assert abs(sum({r.source: r.target for r in rows}.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert mixing.mix(spark, empty, size).count() == 0


def test_packing_is_an_exact_round_trip(spark, docs, texts, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack(spark, docs, window=256, emit="ids", pieces_per_bucket=3).cache()
    rows = pieces.collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        want = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        assert b"".join(bytes(r.ids) for r in own) == want and all(r.doc_tokens * 4 == len(want) for r in own)
    sequences = {r.sequence_id: r for r in packing.assemble(pieces).collect()}
    for r in rows:
        assert bytes(sequences[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert all(s.n_tokens <= 256 and len(s.ids) == 4 * s.n_tokens for s in sequences.values())
    crc = packing.pack(spark, docs, window=256).collect()
    assert {(r.doc_id, r.start): r.ids_crc32 for r in crc} == {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in rows}
    assert packing.pack(spark, empty).count() == 0


def test_plan_takes_every_piece_once():
    histogram = {2048: 3, 1000: 7, 1048: 5, 1: 5000, 64: 10, 700: 4, 1284: 9}
    taken = {}
    for counts, repeats_ in packing.plan_windows(histogram):
        assert sum(x * m for x, m in counts) <= 2048
        for x, m in counts:
            taken[x] = taken.get(x, 0) + m * repeats_
    assert taken == histogram


def measured(t):
    t = t or ""
    w = t.encode().split()
    wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = {g for g, n in Counter(wins).items() if n > 1}
    lines = [x for x in t.split("\n") if x.encode().split()]
    m = {"n_words": len(w), "word_chars": sum(len(x.decode()) for x in w), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines))}
    m |= {"n_repeat_words": len({k + j for k, g in enumerate(wins) if g in often for j in range(3)}), "n_upper": sum(unicodedata.category(c) == "Lu" for c in t), "n_bangs": t.count("!")}
    n = m["n_words"]
    fails = [n < 50, 100 * m["n_repeat_words"] > 50 * n, 100 * m["n_symbols"] > 10 * n, 100 * m["n_dup_lines"] > 50 * m["n_lines"], not 2 * n <= m["word_chars"] <= 20 * n, 100 * m["n_upper"] > 50 * m["word_chars"], 100 * m["n_bangs"] > 20 * n]
    return m | {"fail_bits": sum(1 << i for i, f in enumerate(fails) if f)}


def test_quality_rules(spark, texts, empty):
    own = [*texts, "LOUD " * 60, "a! b! " * 40, "# $ " * 60, "x\nx\nx\ny", "one two three " * 7000]
    rows = {r.doc_id: r for r in quality_rules.ledger(frame(spark, own).withColumn("n_words", F.lit(-1)).withColumn("_t", F.lit("x"))).collect()}
    for i, t in enumerate(own):
        assert {k: rows[i][k] for k in measured(t)} == measured(t) and rows[i]._t == "x" and rows[i].lang == "en"
    assert quality_rules.ledger(empty).count() == 0
    ab = {r.rule: r for r in quality_rules.ablation(quality_rules.ledger(frame(spark, own))).collect()}
    assert ab["too_short"].n_failed == sum(r.n_words < 50 for r in rows.values()) and ab["too_short"].n_rejected == sum(r.fail_bits > 0 for r in rows.values())


def test_line_dedup_paths_agree(spark, empty):
    lines = [(i, "h" if i % 3 else None, f"menu\n own line {i}\nfoot {i % 2}\n") for i in range(12)] + [(90, "h", None), (91, "h", ""), (92, "h", "menu")]
    df = spark.createDataFrame(lines, "page_id long, host string, text string")
    a, b = ({r.page_id: (r.text, r._dropped) for r in line_dedup.drop_boilerplate_lines(spark, df, F.col("host"), ratio=0.5, broadcast_rows=n).collect()} for n in (10**6, 0))
    clash = df.withColumn("_host", F.lit("x")).withColumn("_set", F.lit("y")).withColumn("_lines", F.lit("z")).withColumn("row", F.lit("r"))
    own = line_dedup.drop_boilerplate_lines(spark, clash, F.col("host"), ratio=0.5).collect()
    assert {(r._host, r._set, r.row) for r in own} == {("x", "y", "r")} and {r.page_id: (r.text, r._dropped) for r in own} == a
    assert a == b and a[1][0] == " own line 1\nfoot 1\n" and a[90][0] is None and a[92][0] == "menu"
    assert line_dedup.drop_boilerplate_lines(spark, empty, F.col("source")).count() == 0


def jaccard(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_ngram_join_links_like_all_pairs(spark, texts, empty):
    r = random.Random(3)
    base = " ".join(r.choices([f"v{i}" for i in range(500)], k=60)).split()
    near = []
    for _ in range(25):
        w = list(base)
        for k in r.sample(range(60), r.randint(0, 3)):
            w[k] = f"e{r.randint(0, 9)}"
        near.append(" ".join(w))
    own = [*texts, *near]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(spark, frame(spark, own).repartition(4), width=3, percent=80).collect()}
    assert got == jaccard(own, 3, 80)
    assert ngram_join.jaccard_components(spark, empty).count() == 0


def test_components_of_a_path(spark):
    got = dict(map(tuple, components.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long"), Scratch(spark)).collect()))
    assert got == dict.fromkeys(range(41), 0)


def test_substring_dedup_in_batches(spark, docs, texts, empty):
    path = new_path(spark, "index")
    index = substring_dedup.FingerprintIndex(spark, path, fan_in=2, buckets=4)
    ranges = index.add(docs.filter("doc_id < 20")).union(index.add(docs.filter("doc_id BETWEEN 20 AND 40")))
    assert len(index.runs) == 1  # compacted
    index.close()
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark, path)
    index = substring_dedup.FingerprintIndex(spark, path, fan_in=2, buckets=4, history=docs.filter("doc_id <= 40"))
    assert len(index.runs) == 1
    ranges = ranges.union(index.add(docs.filter("doc_id > 40")))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.removed_words(docs, ranges).collect()}
    assert got == words_left(texts)
    assert substring_dedup.removed_words(empty, index.add(empty)).count() == 0


def test_repeated_suffixes(spark):
    r = random.Random(1)
    rows = [(i // 2, 100 * (i % 2), bytes(r.choices(b"ab\0", k=r.randint(10, 40)))) for i in range(40)]
    places = {}
    for i, start, content in rows:
        for k in range(len(content) - 9):
            places.setdefault(content[k : k + 10], []).append((i, start + k))
    want = {p for own in places.values() for p in sorted(own)[1:]}
    df = spark.createDataFrame(rows, "id long, start long, content binary").repartition(3)
    for symbol in (None, 2, 1):  # one level, and the recursion
        scratch = Scratch(spark)
        assert {tuple(x) for x in suffix_array.repeated_suffixes(scratch, df, 10, symbol).collect()} == want
        scratch.close()


def bytes_left(texts, width=100):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - width + 1):
            if raw[k : k + width] in seen:
                gone[k : k + width] = True
            seen.add(raw[k : k + width])
        want[i] = (len(raw), int(gone.sum()), np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes())
    return want


def test_suffix_dedup(spark, docs, texts, empty, monkeypatch):
    def run(df):
        return {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.removed_bytes(df, suffix_dedup.repeated_bytes(spark, df)).collect()}

    assert run(docs) == bytes_left(texts) and run(empty) == {}
    copies = [texts[3]] * 5
    assert run(frame(spark, copies).repartition(4)) == bytes_left(copies)
    # Texts that repeat themselves only, at every distance.
    r = random.Random(3)
    periodic = [("".join(r.choices("abcdefgh", k=p)) * 200)[: 100 + p + p % 7] + "".join(r.choices("ijklmn", k=p % 50)) for p in range(1, 140)]
    assert run(frame(spark, periodic)) == bytes_left(periodic)
    monkeypatch.setattr(repeats, "BIT_ROWS", 0)  # semi-joins in place of bit tables
    assert run(docs) == bytes_left(texts)


def words_left(texts):
    first, want = {}, {}
    words = [(t or "").encode().split() for t in texts]
    for i, w in enumerate(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return want


def test_long_texts_and_copies_only(spark, texts, monkeypatch):
    r = random.Random(9)
    long = " ".join(r.choices([f"q{i}" for i in range(3000)], k=20_000))
    for own in ([long, long[5000:60_000], texts[3], long], [texts[3]] * 5):
        df = frame(spark, own).repartition(4)
        for rows in (repeats.BIT_ROWS, 0):
            monkeypatch.setattr(repeats, "BIT_ROWS", rows)
            index = substring_dedup.FingerprintIndex(spark, new_path(spark, "index"), buckets=3)
            got = substring_dedup.removed_words(df, index.add(df))
            index.close(delete=True)
            assert {x.doc_id: (x.n_words, x.n_removed, x.kept) for x in got.collect()} == words_left(own)
    df = frame(spark, [long, long, long + " z"])
    assert {x.doc_id: x.component_id for x in ngram_join.jaccard_components(spark, df).collect()} == {0: 0, 1: 0, 2: 0}


def test_null_and_repeated_ids(spark, texts):
    """Rows without an id and rows that repeat an id with its text: nothing is lost, and each row has a result."""
    own = [texts[3], texts[3], texts[8], texts[8], None, "a b"]
    ids = [None, None, 7, 7, None, 9]
    df = frame(spark, own, ids).repartition(3)
    n = len(own)
    kept = exact_dedup.exact_dedup(spark, df).collect()
    assert sorted((r.doc_id or 0, r.group_size, r.kept) for r in kept) == [(0, 1, True), (0, 2, True), (0, 2, True), (7, 2, True), (7, 2, True), (9, 1, True)]
    assert all(r.n_removed == 0 for r in suffix_dedup.removed_bytes(df, suffix_dedup.repeated_bytes(spark, df)).collect())
    index = substring_dedup.FingerprintIndex(spark, new_path(spark, "index"), buckets=3)
    out = substring_dedup.removed_words(df, index.add(df)).collect()
    assert len(out) == n and all(r.n_removed == 0 for r in out)
    again = substring_dedup.removed_words(df, index.add(df)).collect()  # the same documents in a later batch: all repeats
    assert all(r.n_removed == r.n_words for r in again if r.n_words > 12)
    index.close(delete=True)
    groups = ngram_join.jaccard_components(spark, df).collect()
    assert sorted(((r.doc_id, r.component_id) for r in groups), key=str) == sorted([(None, None)] * 3 + [(7, 7)] * 2 + [(9, 9)], key=str)
    pieces = packing.pack(spark, df, window=256).collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces) and sum(r.start == 0 for r in pieces) == n
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    assert mixing.mix(spark, df, size).count() == n
    assert quality_rules.ledger(df).count() == pii.pseudonymise(df, "k").count() == n


def test_pii_keeps_formats_links_and_invalid_finds(spark, empty):
    texts = ["a.b7@mail.example.com and a.b7@mail.example.com", "card 4532015112830366, not 4532015112830367", "on 2024-02-29 not 2023-02-29", "10.0.0.1 not 256.1.1.1", "123-45-6789 not 000-45-6789", "+1 (076) 555-8046", None, "", "plain 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    a, b = got[0].text.split(" and ")
    assert a == b != "a.b7@mail.example.com" and a.endswith("@mail.example.com")
    card = got[1].text[5:21]
    assert card != "4532015112830366" and got[1].text.endswith("4532015112830367") and sum(int(d) if i % 2 else (int(d) * 2 - 9 * (int(d) > 4)) for i, d in enumerate(card)) % 10 == 0
    assert "2023-02-29" in got[2].text and "2024-02-29" not in got[2].text and "256.1.1.1" in got[3].text and "000-45-6789" in got[4].text
    assert got[5].text.startswith("+1 (") and got[5].text != texts[5] and got[6].text is None and got[7].text == "" and got[8].text == "plain 12"
    many = spark.range(700).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    assert pii.pseudonymise(many, "k").select("text").distinct().count() == 700  # a permutation
    assert pii.pseudonymise(empty, "k").count() == 0


def test_more_layouts_of_personal_data(spark):
    finds = ["2024-02-29", "+1 555 123 4567", "555 123 4567", "+44 20 7946 0958", "3782 822463 10005", "3782-822463-10005"]
    kinds = ["date", "phone", "phone", "phone", "card", "card"]
    texts = [f"on {finds[0]}T10:00:00 x", *(f"see {x}, ok" for x in finds[1:]), "3782 822463 10006 and 2024-02-30T10:00 and 1234 567 8901"]
    got = [r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    layout = lambda t: "".join("0" if c.isdigit() else c for c in t)
    for r, t, find, kind in zip(got, texts, finds, kinds, strict=False):
        assert [(f.kind, f.found) for f in r._found] == [(kind, find)] and find not in r.text and layout(r.text) == layout(t)
    assert got[0].text.endswith("T10:00:00 x") and got[1].text.startswith("see +1 ") and got[3].text.startswith("see +44 ") and got[6].text == texts[6]


def keyed(key, kind, i, value):
    return hashlib.sha256("\x1f".join([key, kind, str(i), value]).encode()).hexdigest()


def feistel_numbers(x, y, of_x, of_y, key, kind, back=False):
    """An independent Feistel permutation of pairs of numbers, and its inverse."""
    sign = -1 if back else 1
    for i in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        number = lambda v: int(keyed(key, kind, i, str(v))[:15], 16)  # noqa: B023, E731
        if i % 2 == 0:
            x = (x + sign * number(y)) % of_x
        else:
            y = (y + sign * number(x)) % of_y
    return x, y


def feistel_letters(text, key, kind, alphabets, back=False):
    def shift(part, digest):
        out = ""
        for i, c in enumerate(part):
            by = int(digest[4 * (i % 16) : 4 * (i % 16) + 4], 16) + i
            own = next((a for a in alphabets if c in a), None)
            out += own[(own.index(c) + (-by if back else by)) % len(own)] if own else c
        return out

    x, y = text[: len(text) // 2], text[len(text) // 2 :]
    for i in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        if i % 2 == 0:
            x = shift(x, keyed(key, kind, i, y))
        else:
            y = shift(y, keyed(key, kind, i, x))
    return x + y


def test_pii_against_an_independent_feistel_and_its_inverse(spark):
    r = random.Random(4)
    hexa = lambda letters: "".join(r.choices("0123456789" + letters, k=40))
    letters = {"email": ["a.b7", "José_X-9", "z"], "secret": [hexa("abcdef"), hexa("ABCDEF"), hexa("abcdefABCDEF")], "phone": ["0765558046"], "card": ["453201511283036"]}
    rows = [(k, v) for k, own in letters.items() for v in own]
    alphabets = {"secret": pii.HEX}
    df = spark.createDataFrame(rows, "kind string, v string")
    hex_kind = F.col("kind") == "secret"
    got = df.select("kind", "v", F.when(hex_kind, pii.feistel_text(F.col("v"), "k", F.lit("secret"), pii.HEX)).otherwise(pii.feistel_text(F.col("v"), "k", F.col("kind"))).alias("p")).collect()
    for x in got:
        own = alphabets.get(x.kind, pii.TEXT)
        assert x.p == feistel_letters(x.v, "k", x.kind, own) and feistel_letters(x.p, "k", x.kind, own, back=True) == x.v
    for kind, (of_x, of_y) in {"ip": (65536, 65536), "ssn": (898 * 99, 9999), "date": pii.DAYS}.items():
        pairs = [(r.randrange(of_x), r.randrange(of_y)) for _ in range(20)]
        out = spark.createDataFrame(pairs, "x long, y long").select("x", "y", pii.feistel_pair(F.col("x"), F.col("y"), of_x, of_y, "k", F.lit(kind)).alias("p")).collect()
        for o in out:
            assert (o.p.x, o.p.y) == feistel_numbers(o.x, o.y, of_x, of_y, "k", kind) and feistel_numbers(*o.p, of_x, of_y, "k", kind, back=True) == (o.x, o.y)


def test_pii_is_a_permutation_of_each_layout(spark):
    """Different dates stay different in every layout and reading; mixed-case secrets stay apart from their lower-case twins."""
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int"))
    days = spark.range(9000).select(*[F.date_format(day, f).alias(f"c{i}") for i, f in enumerate(("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "d.M.yyyy", "M/d/yyyy", "d/MM/yyyy"))])
    every = days.select(F.explode(F.array(*days.columns)).alias("text")).distinct()
    out = pii.pseudonymise(every.withColumn("was", F.col("text")), "k").collect()
    shape = lambda t: "".join("0" if c.isdigit() else c for c in t)
    assert len({x.text for x in out}) == len(out) == every.count() and all(shape(x.text) == shape(x.was) for x in out)
    hexa = "0a1b2c3d4e5f60718293a4b5c6d7e8f9"
    own = [f"key={hexa}", f"key={hexa.upper()}", "key=0A1b2c3d4e5f60718293a4b5c6d7e8f9", "10.1.2.3", "10.1.2.4", "123-45-6789", "123-45-6780"]
    clash = spark.createDataFrame([(t, "m", "e", "x") for t in own], "text string, _m string, _each string, _found string")
    rows = pii.pseudonymise(clash, "k").collect()
    assert len({x.text for x in rows}) == len(own) and all(x.text != t and x._m == "m" and x._each == "e" for x, t in zip(rows, own, strict=True))
    assert all([c.isupper() for c in x.text] == [c.isupper() for c in t] for x, t in zip(rows[:3], own, strict=False))


def test_registered_classifier_is_the_numpy_discriminant(spark, texts, tmp_path):
    r = random.Random(2)
    own = [*texts, *(" ".join(r.choices(["ab", "c!", "DEF", "#"], k=r.randint(1, 80))) for _ in range(60))]
    label = {i: int(len(t or "") % 3 > 0) for i, t in enumerate(own) if i % 4}
    frame(spark, own, [*range(len(own) - 1), None]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*((i, q, 0) for i, q in label.items()), (0, 7, 0), (2, None, 0), (99_999, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    got = {x.doc_id: x for x in classifier.op9_quality_classifier(spark, str(tmp_path)).collect()}

    def vector(t):
        m = measured(t)
        share = lambda a, b: np.log1p(100.0 * m[a] / max(m[b], 1))
        return [np.log1p(m["n_words"]), np.log1p(m["word_chars"] / max(m["n_words"], 1)), share("n_symbols", "n_words"), share("n_lines", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "word_chars"), share("n_bangs", "n_words")]

    x = np.array([vector(t) for t in own])
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(own))])
    sets = [x[[i for i, q in label.items() if q == k and not held[i] and i < len(own) - 1]] for k in (0, 1)]
    n, d = [len(v) for v in sets], x.shape[1]
    covs = [np.cov(v.T, bias=True) for v in sets]
    pooled = sum(a * c for a, c in zip(n, covs, strict=True)) / sum(n)
    shrunk = [0.89 * c + 0.1 * pooled + 0.01 * np.eye(d) * np.trace(pooled) / d for c in covs]
    density = [np.log(a / sum(n)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - v.mean(0), np.linalg.inv(c), x - v.mean(0)) for a, v, c in zip(n, sets, shrunk, strict=True)]
    want = 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))
    for i in range(len(own) - 1):
        assert abs(got[i].score - want[i]) < 1e-6 and got[i].held_out == held[i] and got[i].predicted == int(got[i].score >= 0.5)
    assert not got[None].held_out and abs(got[None].score - want[-1]) < 1e-6


def five_stages(texts):
    """The pipeline by brute force: the pieces (doc_id, start, length, crc, doc_tokens) of what is packed, as often as they come."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = {i: (t, None if i % 9 == 8 else f"src{i % 3}") for i, t in enumerate(texts) if not measured(t)["fail_bits"]}
    count, pages = Counter(), Counter(s for _, s in rows.values())
    trim = lambda x: x.strip(" \t\n\x0b\f\r")
    for t, s in rows.values():
        count.update({(s, trim(x)) for x in t.split("\n") if trim(x)})
    often = {k for k, n in count.items() if n >= 3 and n > 0.1 * pages[k[0]]}
    for i, (t, s) in rows.items():
        lines = t.split("\n")
        hits = [(s, trim(x)) in often for x in lines]
        if any(hits) and sum(hits) < sum(bool(trim(x)) for x in lines):
            rows[i] = ("\n".join(x for x, h in zip(lines, hits, strict=True) if not h), s)
    ids = list(rows)
    groups = jaccard([rows[i][0] for i in ids], 5, 80)
    rows = {i: rows[i] for k, i in enumerate(ids) if groups[k][1] == k}
    sizes = {i: len(t.encode().split()) for i, (t, _) in rows.items()}
    out, tok = Counter(), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, n in mixed([(i, s, sizes[i]) for i, (_, s) in rows.items()]).items():
        epochs, rest = divmod(n, sizes[i]) if sizes[i] else (0, 0)
        words = rows[i][0].encode().split()
        for t in [*[rows[i][0]] * epochs, *([b" ".join(words[:rest]).decode()] if rest else [])]:
            raw = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
            out.update((i, a // 4, len(raw[a : a + 8192]) // 4, zlib.crc32(raw[a : a + 8192]), len(raw) // 4) for a in range(0, len(raw), 8192))
    return out


def test_discriminant_separates_and_survives_one_class(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), float(x), float(y)) for k in (0, 1) for x, y in rng.normal([3 * k, -k], 0.5 + 0.3 * k, (200, 2))]
    df = spark.createDataFrame(rows, "y long, a double, b double")
    scored = df.withColumn("s", classifier.fit(df, "y", ["a", "b"]).score()).collect()
    assert sum((r.s >= 0.5) == (r.y == 1) for r in scored) > 380 and all(0 <= r.s <= 1 for r in scored)
    assert classifier.fit(df.filter("y = 1"), "y", ["a", "b"]).constant == 1.0 and classifier.fit(df.filter("y = 5"), "y", ["a", "b"]).constant == 0.5


def test_blocks_see_all_windows():
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(20)]
    x = repeats.blocks(*repeats.words(texts), 13, 5)
    assert int(x.count.sum()) == sum(max(0, len(t.split()) - 12) for t in texts)


def test_pipeline_is_the_five_stages(spark, texts, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    more = [" ".join(r.choices([f"p{i}" for i in range(400)], k=r.randint(60, 3000))) for _ in range(12)]
    footed = [f"{t}\nterms of use\n" for t in more[:8]]
    for name, own in (("small", [*texts, *more, *footed, *(t + " end" for t in more)]), ("none", [])):
        frame(spark, own).select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in rows) == five_stages(own)
        at = {}
        for x in sorted(rows, key=lambda x: (x.sequence_id, x.offset)):
            assert at.get(x.sequence_id, 0) == x.offset
            at[x.sequence_id] = x.offset + x.length
        assert all(n <= 2048 for n in at.values()) and (len(rows) > 20) == (name == "small")


def test_registered_index_joins_several_runs_and_compacts(spark, texts, tmp_path, monkeypatch):
    frame(spark, texts).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    made, met, merged = substring_dedup.FingerprintIndex, [], []

    class Seen(made):
        def add(self, docs, *a):
            met.append(sorted(level for level, _ in self.runs))
            return super().add(docs, *a)

        def _write(self, blocks, level):
            merged.append(level)
            return super()._write(blocks, level)

    monkeypatch.setattr(substring_dedup, "FingerprintIndex", Seen)
    got = substring_dedup.op7_substring_dedup(spark, str(tmp_path))
    assert [0, 0] in met and [1] in met and max(merged) == 1
    once = substring_dedup.op7_substring_dedup(spark, str(tmp_path), batches=1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, once.collect()), key=str) and any(r.n_removed for r in got.collect())


def test_compaction_merges_across_runs_and_batches_read_their_rows_only(spark, texts, tmp_path, monkeypatch):
    frame(spark, texts * 3).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    made, plans, compacted = substring_dedup.FingerprintIndex, [], []

    class Seen(made):
        def add(self, docs, *a):
            plans.append(docs._jdf.queryExecution().executedPlan().toString())
            return super().add(docs, *a)

        def _compact(self):
            super()._compact()
            compacted.extend(spark.table(n).select("h", "bh").collect() for level, n in self.runs if level)

    monkeypatch.setattr(substring_dedup, "FingerprintIndex", Seen)
    got = substring_dedup.op7_substring_dedup(spark, str(tmp_path))
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got.collect()} == {i: x[:2] for i, x in words_left(texts * 3).items()}
    assert compacted and all(len(rows) == len(set(rows)) for rows in compacted)
    assert all("LessThanOrEqual(doc_id" in p for p in plans[:3]) and all("GreaterThan(doc_id" in p for p in plans[1:])


@pytest.mark.parametrize("chunk", [200_000, 1])
def test_words_of_many_texts_in_bytes(chunk):
    own = ["", "a b", "c", " d\x0b\r\ne ", "\u00a0 \u2003x", "", "f\x1fg  h", " \t", "i"]
    raw = np.frombuffer("".join(own).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in own)])
    for i, j in repeats.cuts(offsets, chunk):
        data, some = raw[offsets[i] : offsets[j]], own[i:j]
        start, end, sizes = hashing.word_bounds(data, offsets[i : j + 1] - offsets[i])
        want = [w for t in some for w in t.encode().split()]
        assert [data[a:b].tobytes() for a, b in zip(start, end, strict=True)] == want and sizes.tolist() == [len(t.encode().split()) for t in some]
        assert hashing.spaced(data, start, end)[0].tobytes() == b"".join(w + b" " for w in want)
        assert hashing.hashes_between(data, start, end).tolist() == hashing.word_hashes(some)[0].tolist()


def test_one_row_of_a_repeated_id_stays(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(40)]
    long, near, other = " ".join(words), " ".join([*words, "z"]), " ".join(f"v{i}" for i in range(40))
    rows = [(1, near), (1, long), (1, long), (2, long), (3, other), (4, "a b"), (4, "a b"), (4, ""), (None, other + " q"), (None, other + " q")]
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()), key=str)
    assert got == sorted([(1, near), (3, other), (4, "a b"), (None, other + " q"), (None, other + " q")], key=str)
