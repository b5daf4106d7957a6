"""Cutting texts into overlapping chunks that end with a sentence where one ends nearby."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STOPS = re.compile(r"[。！？.!?]+")
#: How far before a cut a sentence end is looked for, in characters.
NEAR = 50
CHUNK = "array<struct<i:bigint,start:bigint,stop:bigint,content:string>>"


def sentence_spans(text: str, size: int, overlap: int, near: int = NEAR) -> list[tuple[int, int]]:
    """Spans of up to `size` characters. A span ends with the last sentence that ends within `near` characters before its limit, and the next one
    starts with the first sentence in the overlap; without any, both fall on fixed places. Each start is a tenth of the size further at least, but
    never behind the last end: no character is lost, and the last span reaches the end of the text."""
    runs = [m.span() for m in _STOPS.finditer(text)]
    begins, ends = [a for a, _ in runs], [b for _, b in runs]
    overlap, step, n = min(overlap, size * 8 // 10), max(1, size // 10), len(text)
    out, start = [], 0
    while start < n:
        stop = min(start + size, n)
        if stop < n and (k := bisect_right(ends, stop)) and ends[k - 1] > max(start, stop - near):
            stop = ends[k - 1]
        out.append((start, stop))
        if stop >= n:
            break
        lap = max(start, stop - overlap)
        k = bisect_left(ends, lap)
        if k < len(ends) and begins[k] < stop:
            after = min(max(start + max(1, (stop - start) // 20), ends[k]), stop - 1)
        else:
            after = stop - overlap
        start = max(after, min(start + step, stop))
    return out


def sentence_chunks(text: Column, size: int = 1800, overlap: int = 200) -> Column:
    """array<struct<i, start, stop, content>>, contents without white space at their ends; blank texts have none."""

    @F.pandas_udf(CHUNK)
    def cut(texts: pd.Series) -> pd.Series:
        def one(text_: str | None) -> list[tuple[int, int, int, str]] | None:
            if text_ is None or not text_.strip(" \t\n\r\f\v"):
                return None
            spans = [(a, b, text_[a:b].strip(" \t\n\r\f\v")) for a, b in sentence_spans(text_, size, overlap)]
            return [(i, *x) for i, x in enumerate(x for x in spans if x[2])]

        return texts.map(one)

    return cut(text)


def chunk_rows(df, key: str, text: Column, title: Column, least: int = 3000, size: int = 1800, overlap: int = 200):  # noqa: ANN001, ANN201
    """Rows of texts of `least` characters and more by chunk, shorter ones whole: key, id (with the chunk's number if there are several),
    chunk, chunks, content, and vector_text (the title three times before a chunk, once before a whole text)."""
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(0).cast("bigint").alias("start"), F.length(text).cast("bigint").alias("stop"), text.alias("content")))
    parts = F.when(F.length(text) >= least, F.coalesce(sentence_chunks(text, size, overlap), whole)).otherwise(whole)
    x = df.select(F.col(key), title.alias("title"), parts.alias("parts")).select(key, "title", F.size("parts").alias("chunks"), F.inline("parts"))
    several = F.col("chunks") > 1
    led = F.concat(F.when(several, F.concat_ws("\n\n", "title", "title", "title")).otherwise(F.col("title")), F.lit("\n\n"), F.col("content"))
    return x.select(key, F.when(several, F.concat_ws("-", F.col(key).cast("string"), F.col("i").cast("string"))).otherwise(F.col(key).cast("string")).alias("id"), F.col("i").alias("chunk"), "chunks", "content", led.alias("vector_text"))
