"""Common substrings by suffix automata: of one pattern or of many, built once, run over each text in time linear in its length."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Between patterns; a text's own such character matches nothing.
APART = "￿"
#: Characters of all patterns together that are sent to the tasks, at most.
MOST = 1_000_000
HIGH, MEDIUM, LOW = 0.8, 0.5, 0.2


class Automaton:
    """The suffix automaton of some patterns: every substring of one of them is a way from state 0."""

    def __init__(self, patterns: Sequence[str]):
        self.link, self.length, self.step, self.last = [-1], [0], [{}], [-1]
        state, self.starts, n = 0, [], 0
        for p in patterns:
            self.starts.append(n)
            for c in p + APART:
                state = self._add(state, c, n)
                n += 1

    def _state(self, length: int, step: dict[str, int], link: int, last: int) -> int:
        for own, value in ((self.length, length), (self.step, step), (self.link, link), (self.last, last)):
            own.append(value)
        return len(self.length) - 1

    def _add(self, state: int, c: str, at: int) -> int:
        new = self._state(self.length[state] + 1, {}, 0, at)
        while state >= 0 and c not in self.step[state]:
            self.step[state][c] = new
            state = self.link[state]
        if state >= 0:
            known = self.step[state][c]
            if self.length[known] == self.length[state] + 1:
                self.link[new] = known
            else:
                # The longer strings of the known state keep it; those that also end here get one of their own.
                short = self._state(self.length[state] + 1, dict(self.step[known]), self.link[known], self.last[known])
                self.link[known] = self.link[new] = short
                while state >= 0 and self.step[state].get(c) == known:
                    self.step[state][c] = short
                    state = self.link[state]
        return new

    def longest(self, text: str) -> tuple[int, int, int]:
        """Length of the longest common substring, where it starts in the text (the first of equally long ones), and a pattern that has it (-1: none)."""
        step, link, length = self.step, self.link, self.length
        state = size = best = end = 0
        where = -1
        for i, c in enumerate(text):
            if c == APART:
                state = size = 0
                continue
            while c not in step[state]:
                state = link[state]
                if state < 0:
                    state = size = 0
                    break
                size = length[state]
            else:
                state, size = step[state][c], size + 1
                if size > best:
                    best, end, where = size, i + 1, self.last[state]
        return best, end - best, self._pattern(where) if best else -1

    def _pattern(self, at: int) -> int:
        low, high = 0, len(self.starts) - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.starts[mid] <= at else (low, mid - 1)
        return low


@functools.lru_cache(maxsize=1024)
def _of(*patterns: str) -> Automaton:
    return Automaton(patterns)


@F.pandas_udf(T.IntegerType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common substring; the automaton of the shorter of two strings is kept for the rows that have it too."""

    def one(x: str | None, y: str | None) -> int:
        short, long = sorted((x or "", y or ""), key=len)
        return _of(short).longest(long)[0]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def has_common(a: Column, b: Column, n: int) -> Column:
    """Whether two strings share a substring of n characters."""
    return longest_common(a, b) >= n


def common_with(spark, text: Column, patterns: Sequence[str]) -> Column:  # noqa: ANN001
    """struct<length, start, pattern>: the longest substring that a text shares with any of the patterns (the first such in the text)."""
    if sum(map(len, patterns)) > MOST:
        raise ValueError(f"patterns have {MOST} characters at most; search in parts")
    shared = spark.sparkContext.broadcast(list(patterns))

    @F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("length", "start", "pattern")]))
    def run(texts: pd.Series) -> pd.DataFrame:
        own = _of(*shared.value)
        return pd.DataFrame([own.longest(t or "") for t in texts], columns=["length", "start", "pattern"]).astype("int32")

    return run(text)


def relevance(keyword: Column, words: Sequence[str]) -> Column:
    """How relevant a keyword is to a query's words: 1 if it is one, 0.9 if it holds one, 0.8 if it is part of one, else the greatest share that a common
    substring of two characters or more has of the longer of both."""
    share = lambda w: F.when(longest_common(keyword, F.lit(w)) >= 2, longest_common(keyword, F.lit(w)) / F.greatest(F.length(keyword), F.lit(len(w)))).otherwise(0.0)
    each = [F.when(keyword == w, 1.0).otherwise(F.greatest(F.when(F.contains(keyword, F.lit(w)), 0.9).otherwise(0.0), F.when(F.contains(F.lit(w), keyword), 0.8).otherwise(0.0), share(w))) for w in words]
    return F.greatest(F.lit(0.0), F.lit(0.0), *each)


def tier(score: Column) -> Column:
    """high, medium, low, or null for what is left out."""
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").when(score >= LOW, "low")
