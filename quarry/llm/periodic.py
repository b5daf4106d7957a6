"""Runs of words that repeat with a period, and texts without their repeats.

A run is a stretch of words with smallest period q (words q apart are the same) that no neighbouring word extends, of `min_words` words and
`min_exponent` periods at least. By the runs theorem (Bannai et al.), one of a run's periods is the longest Lyndon word at its place, in an
order of the words or in its reverse:

1. Longest Lyndon words come from a stack scanned from right to left: a word's goes on while the suffix behind it is greater.
2. Suffixes are compared by their longest common extension, found by binary search over rolling hashes and then verified word by word.
   What is known of one distance is kept, so a periodic text costs no more than another.
3. A Lyndon word that the words behind it repeat is extended to both sides in the same way. A run is taken once for its start and period.

Texts are scanned where they are; nothing is shuffled. Stretches without a run are left out first: in a run every three words in a row stand
min_exponent - 1 times or more, so the scan gets stretches of such triples alone. Hashes of triples may let too much through, never too
little. Null texts have no words; ids may be null or repeat; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import documents, let, materialize, small_batches, text_of, words_of
from .hashing import mix, split_words, window_hashes, word_hashes

MIN_WORDS, MIN_EXPONENT = 6, 4
PRIME, BASE = (1 << 61) - 1, 0x2F0B4C47D5A3E19B % ((1 << 61) - 1)
GRAM = 3


class Extensions:
    """Longest common extensions in a list of numbered words, to the right and to the left."""

    def __init__(self, words: list[int]):
        self.words, n = words, len(words)
        self.sums = list(accumulate(words, lambda h, w: (h * BASE + w + 1) % PRIME, initial=0))
        self.powers = list(accumulate(range(n), lambda p, _: p * BASE % PRIME, initial=1))
        self.known: dict[int, tuple[int, int]] = {}
        """For a distance, a stretch of places whose word is that of the place so far on; no further place to the right has it."""

    def _same(self, i: int, j: int, n: int) -> bool:
        s, p = self.sums, self.powers[n]
        return (s[i + n] - s[i] * p - s[j + n] + s[j] * p) % PRIME == 0

    def _most(self, same, limit: int) -> int:  # noqa: ANN001
        """The greatest n up to limit with same(n), which holds for all smaller ones too."""
        low, step = 0, 1
        while low + step <= limit and same(low + step):
            low, step = low + step, step * 2
        high = min(limit, low + step - 1)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if same(mid) else (low, mid - 1)
        return low

    def right(self, i: int, j: int) -> int:
        """How many words from i < j on are the same."""
        w = self.words
        if w[i] != w[j]:
            return 0
        d = j - i
        low, high = self.known.get(d, (0, -1))
        if i < high and low - i <= 4 * d and w[i:low] == w[j : low + d]:
            self.known[d] = (min(low, i), high)
            return high - i
        n = self._most(lambda n: self._same(i, j, n), len(w) - j)
        if w[i : i + n] != w[j : j + n]:  # two stretches with one hash
            n = next(k for k in range(n) if w[i + k] != w[j + k])
        self.known[d] = (i, i + n)
        return n

    def left(self, i: int, j: int) -> int:
        """How many words before i < j are the same, from the last on."""
        w = self.words
        if not i or w[i - 1] != w[j - 1]:
            return 0
        n = self._most(lambda n: self._same(i - n, j - n, n), i)
        if w[i - n : i] != w[j - n : j]:
            n = next(k for k in range(n) if w[i - 1 - k] != w[j - 1 - k])
        return n


def runs_in(words: list[int], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    n, out, ext = len(words), set(), Extensions(words)
    last: dict[int, tuple[int, int]] = {}
    for greater in (int.__gt__, int.__lt__):
        after = [n] * n  # where the longest Lyndon word from a place on ends: at the next smaller suffix
        for i in range(n - 1, -1, -1):
            j, own = i + 1, words[i]
            while j < n:
                if (other := words[j]) == own:
                    common = ext.right(i, j)
                    if j + common == n:  # a suffix that the other begins with is smaller in both orders
                        break
                    own_then, other = words[i + common], words[j + common]
                else:
                    own_then = own
                if not greater(other, own_then):
                    break
                j = after[j]
            after[i] = j
            p = j - i
            # The first period that stands in a run whole is followed by min_exponent - 2 others at least.
            if j == n or i + (min_exponent - 1) * p > n or words[j] != own:
                continue
            start, end = last.get(p, (0, 0))
            if start <= i and i + 2 * p <= end:
                continue
            start, end = i - ext.left(i, j), j + ext.right(i, j)
            last[p] = (start, end)
            if end - start >= max(min_words, min_exponent * p):
                out.add((start, end - start, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> Iterator[tuple[int, int, int]]:
    """Of texts end to end (hashes of words, and how many each has): (text, first word, word behind the last) of what may hold runs."""
    need = max(1, min(min_exponent - 1, max(min_words, min_exponent) - GRAM + 1))
    least = max(1, max(min_words, min_exponent) - GRAM + 1)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    grams = window_hashes(words, GRAM)
    at = np.flatnonzero(np.arange(GRAM, len(words) + 1) <= ends[text[: len(grams)]]) if len(grams) else np.zeros(0, dtype=np.int64)
    group = text[at]
    while len(at):
        _, which, counts = np.unique(grams[at] ^ mix(group.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
        keep = counts[which] >= need
        kept = at[keep]
        new = np.ones(len(kept), dtype=bool)
        new[1:] = (np.diff(kept) > 1) | (np.diff(text[kept]) > 0)
        group = np.cumsum(new) - 1
        long = np.bincount(group, minlength=1)[group] >= least if len(kept) else new
        done = len(kept) == len(at) and long.all()
        at, group = kept[long], group[long]
        if done:
            break
    begins = ends - sizes
    for own in np.split(at, np.flatnonzero(np.diff(group)) + 1) if len(at) else ():
        t = int(text[own[0]])
        yield t, int(own[0] - begins[t]), int(own[-1] + GRAM - begins[t])


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds behind its first period, joined by one space."""
    kept, at = [], 0
    for start, end in sorted((s + p, s + n) for s, n, p in runs):
        kept += words[at : max(at, start)]
        at = max(at, end)
    return b" ".join([*kept, *words[at:]])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """id, n_words, runs as array<struct<start, length, period>> by start and period, and collapsed: the text without repeats."""
    if min_exponent < 2 or min_words < GRAM:
        raise ValueError("runs have two periods and three words at least")
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in repeats.together(batch.column("t").to_pylist()):
                hashes, sizes = word_hashes(texts)
                split = list(map(split_words, texts))
                found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for t, start, end in stretches(hashes, sizes, min_words, min_exponent):
                    number: dict[bytes, int] = {}
                    own = [number.setdefault(w, len(number)) for w in split[t][start:end]]
                    found[t] += [(start + s, n, p) for s, n, p in runs_in(own, min_words, min_exponent)]
                found = [sorted(set(x), key=lambda r: (r[0], r[2])) for x in found]
                flat = np.array([r for x in found for r in x], dtype=np.int64).reshape(-1, 3)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[first : first + len(texts)], pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), rows), pa.array([collapse(w, r).decode() for w, r in zip(split, found, strict=True)])],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(scan, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("id", id_col)


def planted(text: Column, key: Column) -> Column:
    """The text; of each tenth (by the crc32 of the key) the words, periodic from some word on."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)), " ")

    return F.when(h % 10 == 0, let(words_of(text), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(F.lit("")))).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    x = periodic_runs(docs.select("doc_id", planted(text_of(), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    x = x.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    x = x.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), "b.length", (-F.col("b.period")).alias("period"), F.expr("1000 * b.length div -b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
    with small_batches(spark):
        return materialize(x, "periodic-runs")
