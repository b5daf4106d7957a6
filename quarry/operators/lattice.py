"""Segmentation by a dictionary: for scripts without spaces, and for compounds.

A run of letters and digits is a lattice: its edges are the dictionary's words, and where no word goes on, stretches of one class of
characters. The tokens are the path of least cost (ties: fewer tokens, then the longer first token), found by dynamic programming from
the end. A word costs the negative logarithm of its share of all words; an unknown stretch costs more than any word, and more by character.

`learn` makes a dictionary from texts: one aggregation over all words, with the class of each word by how it is mostly written. It is a table of a
stated size, the most frequent `most` words, so it can be sent to every task. `analyzer` gives the column function that bm25.tokens, bm25.nouns and a
saved index take. In a batch, each distinct run is segmented once, if not one of the last batches had it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a dictionary at most.
MOST = 200_000
#: Characters by which the length of words is bounded.
HEAD = 3
#: Characters of runs that a task segments at once, and bytes of the runs of earlier batches that it keeps with their tokens.
CHARS, KEPT = 250_000, 3_000_000
UNKNOWN, BY_CHARACTER = 25.0, 4.0
NOUN, WORD, NUMBER, OTHER = "noun", "word", "number", "unknown"
#: Costs are whole numbers of units; a token more outweighs every place where the first one may end.
UNIT, FEW = 1e9, 1 << 32
UNKNOWN_UNITS, CHARACTER_UNITS = int(UNKNOWN * UNIT), int(BY_CHARACTER * UNIT)
SEED = np.uint64(0x9E3779B97F4A7C15)
CLASSES = [NUMBER, "hiragana", "katakana", "han", "hangul", "letter"]


def class_of(c: str) -> str:
    """What an unknown character goes together with."""
    if c.isdigit():
        return NUMBER
    for name, low, high in (("hiragana", 0x3041, 0x309F), ("katakana", 0x30A0, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7A3)):
        if low <= ord(c) <= high:
            return name
    return "letter"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _mixed(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Hashes of strings that are a character longer."""
    h = (h ^ c) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return ((h * SEED) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Dictionary:
    """Words with cost and class, as arrays: a hash table finds the words that start at every place of many runs at once, by length."""

    kinds: list[str]
    cost: np.ndarray
    """Of each word, in units of 1e-9, so that sums and ties are exact."""
    kind: np.ndarray
    letters: np.ndarray
    """Of all words, one after the other; each starts at its place in `start`."""
    start: np.ndarray
    lengths: np.ndarray
    """Lengths that words have, ascending."""
    hashes: np.ndarray
    """Open addressing by hash; `slots` has the word of each, -1 where none is."""
    slots: np.ndarray
    heads: np.ndarray
    """The hashes of the first HEAD characters of the longer words, in order, and the greatest length behind each."""
    longest: np.ndarray
    classes: np.ndarray = field(default_factory=lambda: np.full(0x110000, -1, dtype=np.int8), repr=False)
    """Class of each character that was met so far."""
    first: np.ndarray = field(default_factory=lambda: np.zeros(0x110000, dtype=bool), repr=False)
    kept: dict[tuple[str, ...] | None, tuple[pa.Array, pa.Array]] = field(default_factory=dict, repr=False, compare=False)
    """Runs and their tokens, by the classes asked for."""

    @staticmethod
    def of(words: Iterable[tuple[str, int, str]]) -> Dictionary:
        """(word, count, class) -> the dictionary; of a word that comes twice, the last row."""
        words = [w for w in words if w[0]]
        total = sum(n for _, n, _ in words)
        last = {w: (n, kind) for w, n, kind in words}
        names = sorted({kind for _, kind in last.values()})
        number = {name: i for i, name in enumerate(names)}
        cost = np.array([round(math.log(total / n) * UNIT) for n, _ in last.values()], dtype=np.int64)
        kind = np.array([number[k] for _, k in last.values()], dtype=np.int32)
        sizes = np.array([len(w) for w in last], dtype=np.int64)
        letters = _codes("".join(last))
        start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        hashes, head, behind = np.full(len(sizes), SEED, dtype=np.uint64), np.zeros(len(sizes), dtype=np.uint64), sizes > HEAD
        for n in range(1, int(sizes.max(initial=0)) + 1):
            own = np.flatnonzero(sizes >= n)
            hashes[own] = _mixed(hashes[own], letters[start[own] + n - 1])
            if n == HEAD:
                head = hashes.copy()
        heads, which = np.unique(head[behind], return_inverse=True)
        longest = np.zeros(len(heads), dtype=np.int64)
        np.maximum.at(longest, which, sizes[behind])
        bits = max(4, int(2 * len(sizes)).bit_length())
        table, slots, open_, at = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int32), np.arange(len(sizes)), _slot(hashes, bits)
        while len(open_):
            free = slots[at] < 0
            slots[at[free]] = open_[free]  # of several, the last stays
            placed = slots[at] == open_
            table[at[placed]] = hashes[open_[placed]]
            open_, at = open_[~placed], (at[~placed] + 1) & ((1 << bits) - 1)
        out = Dictionary(names, cost, kind, letters, start, np.unique(sizes), table, slots, heads, longest)
        out.first[letters[start[:-1]]] = True
        return out

    def _found(self, codes: np.ndarray, left: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, words): which words start where."""
        found, most, mask = [], int(self.lengths[-1]) if len(self.lengths) else 0, len(self.slots) - 1
        bits, lengths = mask.bit_length(), set(self.lengths.tolist())
        at = np.flatnonzero(left > 0)
        h = np.full(len(at), SEED, dtype=np.uint64)
        room = np.minimum(left[at], most)
        for n in range(1, most + 1):
            if n > 1:
                some = room >= n
                at, h, room = at[some], h[some], room[some]
            if not len(at):
                break
            h = _mixed(h, codes[at + n - 1])
            if n in lengths:
                place, slot = np.arange(len(at)), _slot(h, bits)
                while len(place):
                    word = self.slots[slot]
                    hit = np.flatnonzero((word >= 0) & (self.hashes[slot] == h[place]))
                    hit = hit[self.start[word[hit] + 1] - self.start[word[hit]] == n]
                    own, w = at[place[hit]], self.start[word[hit]]
                    same = np.ones(len(hit), dtype=bool)
                    for k in range(n):  # no word is told by its hash alone
                        same &= codes[own + k] == self.letters[w + k]
                    hit = hit[same]
                    found.append((n, at[place[hit]], word[hit]))
                    on = word >= 0
                    on[hit] = False
                    place, slot = place[on], (slot[on] + 1) & mask
            if n == HEAD and len(self.heads):
                i = np.minimum(np.searchsorted(self.heads, h), len(self.heads) - 1)
                room = np.minimum(room, np.where(self.heads[i] == h, self.longest[i], HEAD))
        return found

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        own = self.classes[codes]
        if (own < 0).any():
            for c in np.unique(codes[own < 0]).tolist():
                self.classes[c] = CLASSES.index(class_of(chr(c)))
            own = self.classes[codes]
        return own

    def _paths(self, runs: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens of the least paths through the runs, one after the other: run, length, and kind (number in `kinds`, -1: NUMBER, -2: OTHER).

        All runs go from their ends to their starts together, a character a step. Of the unknown stretches from a place, which end where their class
        does or before a word's first character, the best is that of the next place, one longer, or the one that ends at the next place."""
        sizes = np.array([len(r) for r in runs], dtype=np.int64)
        codes = _codes("\0".join(runs) + "\0")
        stops = np.cumsum(sizes + 1) - 1  # behind each run is a place for its end
        left = np.repeat(stops, sizes + 1) - np.arange(len(codes))
        kind, starts_word = self._classes(codes), self.first[codes]
        steps = int(sizes.max(initial=0))
        narrow = np.uint16 if steps < 1 << 16 else np.int64
        order = np.argsort(left.astype(narrow), kind="stable")
        upto = np.concatenate([[0], np.cumsum(np.bincount(left, minlength=steps + 1))])
        words: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(steps + 1)]
        for n, at, word in self._found(codes, left):
            turn = np.argsort(left[at].astype(narrow), kind="stable")
            at, word = at[turn], word[turn]
            cuts = [0, *(np.flatnonzero(np.diff(left[at])) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    words[left[at[a]]].append((n, at[a:b], word[a:b]))
        # A path's cost, and its tokens * FEW - the end of its first token: of equal costs the lesser is better.
        cost, tie, far_cost, far_tie = (np.zeros(len(codes), dtype=np.int64) for _ in range(4))
        tokens, ends, own = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes)), np.full(len(codes), -1, dtype=np.int32)
        for step in range(1, steps + 1):
            i = order[upto[step] : upto[step + 1]]
            j = i + 1
            c, t = cost[j] + (UNKNOWN_UNITS + CHARACTER_UNITS), tokens[j] + FEW - j
            same = (kind[j] == kind[i]) & (left[j] > 0)
            fc, ft = np.where(same, far_cost[j] + CHARACTER_UNITS, c), np.where(same, far_tie[j], t)
            near = (c < fc) | ((c == fc) & (t < ft))
            cost[i], tie[i] = np.where(near, c, fc), np.where(near, t, ft)
            near &= starts_word[j]
            far_cost[i], far_tie[i] = np.where(near, c, fc), np.where(near, t, ft)
            for n, a, w in words[step]:
                c, t = cost[a + n] + self.cost[w], tokens[a + n] + FEW - (a + n)
                near = (c < cost[a]) | ((c == cost[a]) & (t <= tie[a]))
                a = a[near]
                cost[a], tie[a], own[a] = c[near], t[near], w[near]
            t = tie[i]
            tokens[i] = -((-t) // FEW) * FEW
            ends[i] = tokens[i] - t
        first, at = np.zeros(len(codes), dtype=bool), (stops - sizes)[sizes > 0]
        while len(at):
            first[at] = True
            at = ends[at]
            at = at[left[at] > 0]
        at = np.flatnonzero(first)
        unknown = np.where(kind[at] == CLASSES.index(NUMBER), -1, -2)
        named = self.kind[own[at]] if len(self.kind) else unknown
        return np.searchsorted(stops, at), ends[at] - at, np.where(own[at] >= 0, named, unknown)

    def segments(self, runs: Sequence[str], kinds: tuple[str, ...] | None = None) -> pa.ListArray:
        """The tokens of each run, or those of some classes."""
        tokens, counts, i = [pa.array([], pa.string())], [np.zeros(1, dtype=np.int64)], 0
        ends = np.cumsum([len(r) + 1 for r in runs])
        asked = None if kinds is None else np.array([name in kinds for name in self._names()])
        while i < len(runs):  # some runs at a time
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHARS, "right")))
            part = runs[i:j]
            run, sizes, kind = self._paths(part)
            text = "".join(part)
            at = np.concatenate([[0], np.cumsum(sizes)])
            codes = _codes(text)
            width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
            offsets = np.concatenate([[0], np.cumsum(width)])[at].astype(np.int32)
            own = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(text.encode("utf-8", "surrogatepass")))
            if asked is not None:
                some = asked[kind]
                own, run = own.filter(pa.array(some)), run[some]
            tokens.append(own)
            counts.append(np.bincount(run, minlength=len(part)))
            i = j
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.concat_arrays(tokens))

    def known(self, runs: pa.Array, kinds: tuple[str, ...] | None = None) -> pa.ListArray:
        """As segments, of different runs: most of them come in many batches, so those of the last ones are kept."""
        old, own = self.kept.get(kinds, (pa.array([], pa.string()), pa.array([], pa.list_(pa.string()))))
        at = pc.index_in(runs, value_set=old)
        new = runs.filter(pc.is_null(at))
        cut = self.segments(new.to_pylist(), kinds)
        place = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(old) + np.arange(len(new))
        both = pa.concat_arrays([own, cut])
        out = both.take(pa.array(place))
        all_ = pa.concat_arrays([old, new])
        self.kept[kinds] = (all_, both) if (pc.sum(pc.binary_length(all_)).as_py() or 0) <= KEPT else (runs, out)
        return out

    def _names(self) -> list[str]:
        """Of kinds by their number, from the end for those below 0."""
        return [*self.kinds, OTHER, NUMBER]

    def segment(self, run: str) -> list[tuple[str, str]]:
        """(token, class) of the least path through one run."""
        _, sizes, kind = self._paths([run])
        at = np.cumsum(sizes)
        return [(run[e - n : e], self._names()[k]) for e, n, k in zip(at.tolist(), sizes.tolist(), kind.tolist(), strict=True)]


def learn(docs: DataFrame, text: str, least: int = 5, shortest: int = 3, most: int = MOST) -> DataFrame:
    """word, n, kind: the `most` most frequent words of `shortest` characters and more that occur `least` times. A word that is mostly written with a
    capital is a noun, as far as spelling tells."""
    runs = docs.select(F.explode(F.split(F.col(text), r"[^\p{L}\p{N}]+")).alias("t")).filter((F.length("t") >= shortest) & ~F.col("t").rlike(r"\p{N}"))
    x = runs.groupBy(F.lower("t").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t").rlike(r"^\p{Lu}")).alias("capital"))
    x = x.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most)
    return x.select("word", "n", F.when(2 * F.col("capital") >= F.col("n"), NOUN).otherwise(WORD).alias("kind"))


def held(words: DataFrame, most: int = MOST) -> Dictionary:
    """The dictionary of a table (word, n, kind), of so many rows at most."""
    rows = words.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a dictionary has {most} words at most")
    return Dictionary.of((r["word"], r["n"], r["kind"]) for r in rows)


def analyzer(words: DataFrame, kinds: tuple[str, ...] | None = None) -> Callable[[Column], Column]:
    """From a text column to its tokens; only those of some classes, if asked for."""
    shared = words.sparkSession.sparkContext.broadcast(held(words))

    @F.arrow_udf("array<string>")
    def cut(runs: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(runs).dictionary_encode()
        tokens = shared.value.known(coded.dictionary, kinds).take(coded.indices)
        counts = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))])
        offsets = counts[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), tokens.flatten(), mask=pc.is_null(runs))

    return lambda text: cut(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))
