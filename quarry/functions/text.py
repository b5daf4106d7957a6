"""Cleaning, normalising and cutting text, labels and addresses, as column expressions; UDFs only where no expression can do it."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def strip_bom(c: Column) -> Column:
    return F.replace(c, F.lit("﻿"), F.lit(""))


def decode_entities(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def strip_html_for_index(c: Column) -> Column:
    """Tags vanish, then entities."""
    return collapse(decode_entities(F.regexp_replace(c, "<[^>]*>", "")))


def html_to_text(c: Column) -> Column:
    """Entities first, then tags become spaces."""
    return collapse(F.regexp_replace(decode_entities(c), "<[^>]*>", " "))


def strip_html_with_bodies(c: Column) -> Column:
    """Also without the bodies of scripts and styles."""
    return collapse(decode_entities(F.regexp_replace(F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", ""), "<[^>]*>", " ")))


def normalise_question(c: Column) -> Column:
    return F.substring(collapse(F.regexp_replace(F.lower(c), r"[\[\](){}.,!?;:]", "")), 1, 100)


def query_words(c: Column, stop: Sequence[str]) -> Column:
    """Brackets become spaces; words of one character and stop words go."""
    words = F.split(collapse(F.regexp_replace(c, r"[\[\](){}]", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*stop))


def snippet(text: Column, keyword: str, size: int) -> Column:
    """size characters around the first keyword, 30 % before it; ellipses where something was cut."""
    at = F.locate(keyword.lower(), F.lower(text))
    start = F.greatest(F.lit(1), at - int(size * 0.3))
    cut = F.substr(text, start, F.lit(size))
    left, right = F.when(start > 1, "...").otherwise(""), F.when(start + size <= F.length(text), "...").otherwise("")
    return F.when(F.length(text) <= size, text).when(at == 0, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(F.concat(left, cut, right))


def token_estimate(c: Column) -> Column:
    """Half a token for each ASCII character, 1.8 for any other, rounded up."""
    ascii_ = F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    return F.ceil(0.5 * ascii_ + 1.8 * (F.length(c) - ascii_))


def short_hash(c: Column) -> Column:
    """h * 31 + code point over 32 bits, as a signed number."""
    return F.aggregate(F.transform(F.split(F.coalesce(c, F.lit("")), ""), lambda x: F.when(x == "", 0).otherwise(F.ascii(x))).cast("array<bigint>"), F.lit(0).cast("bigint"), lambda h, x: F.pmod(h * 31 + x, F.lit(1 << 32)))


def base36_hash(c: Column) -> Column:
    """The same hash as a number of 32 bits with a sign, without the sign, in digits and small letters."""
    h = short_hash(c)
    return F.lower(F.conv(F.abs(F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)).cast("string"), 10, 36))


def title_parts(title: Column) -> Column:
    """status, number and cleaned from a title such as '【draft】 012_Some name'."""
    status = F.when(title.rlike("(?i)deprecated|obsolete"), "deprecated").when(title.rlike("(?i)draft"), "draft").otherwise("approved")
    return F.struct(status.alias("status"), F.regexp_extract(title, r"([0-9]{3})_", 1).alias("number"), F.trim(F.regexp_replace(title, r"^[^\p{L}]*", "")).alias("cleaned"))


def labels_as_array(c: Column) -> Column:
    """A JSON array, '[a, b]' or 'a, b' as an array of trimmed labels; null is empty."""
    loose = F.transform(F.split(F.regexp_replace(c, r"^\[|\]$", ""), ","), lambda x: F.trim(F.regexp_replace(x, '"', "")))
    return F.coalesce(F.filter(loose, lambda x: x != ""), F.array().cast("array<string>"))


def _containing(part: str):  # noqa: ANN202
    return lambda u: F.contains(u, F.lit(part))


def environment_of(urls: Column, rules: dict[str, str], other: str = "unknown") -> Column:
    """The environment that the addresses point to; 'mixed' if to several."""
    hits = F.array_compact(F.array(*[F.when(F.exists(urls, _containing(p)), F.lit(e)) for e, p in rules.items()]))
    return F.when(F.size(hits) > 1, "mixed").when(F.size(hits) == 1, F.get(hits, F.lit(0))).otherwise(other)


def page_url(url: Column, space: Column, page: Column, base: str) -> Column:
    good = url.rlike("^https?://") & F.contains(url, F.lit("/wiki/"))
    both = F.concat(F.lit(f"{base}/wiki/spaces/"), space, F.lit("/pages/"), page.cast("string"))
    return F.when(good, url).when(space.isNotNull() & page.isNotNull(), both).when(page.isNotNull(), F.concat(F.lit(f"{base}/wiki/pages/"), page.cast("string"))).otherwise("#")


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))


def half_width(c: Column) -> Column:
    return F.translate(c, "（）：；，．！？", "():;,.!?")


def fixed_chunks(text: Column, size: int = 1800, overlap: int = 200, compat_tail: bool = False) -> Column:
    """array<struct<i, start, content>>. Every character is in a chunk; compat_tail drops what the first full-size rule dropped."""
    step = size - overlap
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step))
    last = F.greatest(F.lit(0), F.ceil((n - size) / step) - 1) if compat_tail else last
    starts = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: F.struct(i.alias("i"), (i * step).alias("start"), F.substr(text, (i * step + 1).cast("int"), F.lit(size)).alias("content")))
    return F.when(n > 0, starts)


def sentence_pieces(limit: int = 1000):  # noqa: ANN201
    """A pandas UDF: text -> pieces of whole sentences up to `limit` characters; a longer sentence is cut. Together the pieces are the text."""
    import re

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            out, now = [], ""
            for sentence in re.findall(r"[^.!?\n]+[.!?\n]*|[.!?\n]+", text or ""):
                if len(now) + len(sentence) > limit and now:
                    out.append(now)
                    now = ""
                while len(sentence) > limit:
                    out.append(sentence[:limit])
                    sentence = sentence[limit:]
                now += sentence
            return [*out, now] if now else out

        return texts.map(one)

    return cut


def multi_snippet(text: Column, keywords: Sequence[str], size: int, rank: Column) -> Column:
    """A text of up to `size` characters whole; of a longer one the head, and around each keyword behind it an equal share of the rest, 30 % before the
    keyword. The better the rank, the less goes to the head: 40 % up to the third place, 60 % up to the sixth, 80 % after."""
    head = F.when(rank <= 3, size * 4 // 10).when(rank <= 6, size * 6 // 10).otherwise(size * 8 // 10)
    at = F.filter(F.array(*[F.locate(k.lower(), F.lower(text)) for k in keywords]), lambda p: p > head)
    each = F.floor((size - head) / F.size(at)).cast("int")
    parts = F.transform(at, lambda p: F.substr(text, F.greatest(head + 1, p - F.floor(each * 0.3).cast("int")), each))
    cut = F.when(F.size(at) > 0, F.concat(F.substr(text, F.lit(1), head), F.lit(" … "), F.array_join(parts, " … "))).otherwise(F.substr(text, F.lit(1), F.lit(size)))
    return F.when(F.length(text) <= size, text).otherwise(cut)


@F.pandas_udf(T.StringType())
def nfkc(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalised_labels(labels: Column) -> Column:
    """Labels in compatibility form, lower case, without blanks around; null stays null."""
    joined = nfkc(F.array_join(F.transform(labels, lambda x: F.coalesce(x, F.lit(""))), "\x01"))
    return F.when(F.size(labels) > 0, F.transform(F.split(joined, "\x01"), lambda x: F.trim(F.lower(x)))).otherwise(labels)


@F.pandas_udf(T.StringType())
def rich_text(c: pd.Series) -> pd.Series:
    """The text of a rich-text tree in JSON: paragraphs, breaks, lists, quotes, tables."""

    def walk(node: dict) -> str:
        if node.get("type") == "text":
            return node.get("text", "")
        if node.get("type") == "hardBreak":
            return "\n"
        inner = "".join(walk(x) for x in node.get("content") or [])
        return {"listItem": f"- {inner.strip()}\n", "tableCell": f"{inner.strip()} | ", "tableRow": f"{inner}\n", "blockquote": f"> {inner}"}.get(node.get("type"), inner + "\n" if node.get("type") in ("paragraph", "heading") else inner)

    def one(raw: str | None) -> str | None:
        try:
            return None if raw is None else walk(json.loads(raw)).strip()
        except (ValueError, AttributeError):
            return raw

    return c.map(one)
