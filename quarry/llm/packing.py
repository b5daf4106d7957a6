"""Packing documents into fixed windows by non-negative least squares on the length histogram.

1. Each document is tokenized once and cut at multiples of the window; what is left is one piece shorter than the window. Only
   piece records (and, if asked for, their ids) leave the Python workers.
2. The histogram has at most `window` lengths, whatever the corpus. The driver enumerates shallow combinations that fill a
   window exactly (pairs, and triples whose smallest part is a multiple of `grid`), solves their repeat counts against the
   histogram by non-negative least squares (accelerated projected gradient), rounds with carried remainders, and packs the
   residual histogram greedily, longest first, each time repeating the found combination as often as the counts allow.
3. The plan says, for each length, which ranks go to which sequence and offset. Ranks come from row numbers inside hash
   buckets of a length plus the counts of the buckets before, so one length with a third of all pieces is spread over buckets.

Null texts count as empty and give one piece, the end id. Repeated rows are packed as often as they come. An empty table
gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import json
import math
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialize, small_batches, text_of

WINDOW = 2048
END_ID = 1
END = END_ID.to_bytes(4, "little")
VOCABULARY = "word_bpe_49k.json"
#: Parts of words whose ids a Python worker keeps (some 6 MB), and the bytes of text taken at once.
CACHED = 150_000
TOGETHER = 4_000_000
#: The shape of tokenizer that is taken apart here: lower case, then these parts, each encoded by itself.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHAPE = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], PARTS)
#: Everything in PARTS but runs of letters, in the syntax of Arrow's expressions.
BETWEEN = r"('s|'t|'re|'ve|'m|'ll|'d|\pN|[^\s\x0b\x{85}\pZ\pL\pN]+)"
#: Characters that are their own normal form, with one lower case and one class in all engines: Latin, Cyrillic, kana, Han, punctuation, symbols.
PLAIN = r"\x00-\x1b\x20-\x{12f}\x{131}-\x{24f}\x{400}-\x{45f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20bf}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{1f300}-\x{1f64f}"


class Encoder:
    """Ids of whole texts, as little-endian bytes, through a table of the parts that the tokenizer cuts words into.

    The tokenizer drops white space and encodes each part by itself, so the ids of a text are the ids of its parts in turn. Arrow
    lower-cases and cuts the texts and tells the parts apart; a batch's parts are looked up in one Arrow array of known ones, and only
    new parts are encoded, many at a time: ids whose entry ends a part tell where the next begins. Texts with other than PLAIN
    characters or with special strings, and all texts of other tokenizers, are encoded whole."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if "/" not in vocabulary:
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        model = json.loads(Path(vocabulary).read_text())
        normal, cut = ((model.get(k) or {}).get(v, []) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        rules = [x["pattern"]["Regex"] for x in cut if x["type"] == "Split"]
        suffix = model["model"].get("end_of_word_suffix")
        self.by_part = bool(suffix) and ([x["type"] for x in normal], [x["type"] for x in cut], *rules) == SHAPE
        if self.by_part:
            self.apart = "|".join([f"[^{PLAIN}]", *(re.escape(x["content"]) for x in model.get("added_tokens", []))])
            ids = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(ids.values()) + 1, dtype=bool)
            self.ends[[i for t, i in ids.items() if t.endswith(suffix)]] = True
        self.parts, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, parts: pa.StringArray) -> pa.BinaryArray:
        """The ids of each part."""
        out = []
        for i in range(0, len(parts), 5000):
            own = parts[i : i + 5000].to_pylist()
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(own) and stops[-1] == len(ids):
                offsets = np.concatenate([[0], stops * 4]).astype(np.int32)
                out.append(pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())]))
            else:
                out.append(pa.array(self.whole(own), pa.binary()))
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        if not self.by_part:
            return self.whole(texts.to_pylist())
        apart = pc.match_substring_regex(texts, self.apart)
        plain = pc.if_else(apart, "", texts)
        split = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), BETWEEN, r" \1 "))
        sizes, each = pc.list_value_length(split), pc.list_flatten(split)
        # Blanks at either end leave empty strings.
        coded = each.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.parts)
        missing = coded.dictionary.filter(pc.is_null(found))
        blank = pc.equal(missing, "")
        ids = self._new(missing.filter(pc.invert(blank)))
        if pc.any(blank).as_py():
            at = pc.index(missing, "").as_py()
            ids = pa.concat_arrays([ids[:at], pa.array([b""], pa.binary()), ids[at:]])
        table = pa.concat_arrays([self.ids, ids])
        place = found.to_numpy(zero_copy_only=False).astype(np.float64)
        place[np.isnan(place)] = len(self.parts) + np.arange(len(missing))
        coded_ids = table.take(pa.array(place.astype(np.int32)[coded.indices.to_numpy()]))
        if room := min(CACHED - len(self.parts), len(missing)):
            # Filled once, with what comes first: frequent parts come early, rare ones gain nothing.
            self.parts, self.ids = pa.concat_arrays([self.parts, missing[:room]]), pa.concat_arrays([self.ids, ids[:room]])
        ends = np.concatenate([[0], np.cumsum(sizes.to_numpy())])
        at = np.frombuffer(coded_ids.buffers()[1], dtype=np.int32)[coded_ids.offset :][ends].tolist()
        raw = memoryview(coded_ids.buffers()[2] or b"")
        out = [bytes(raw[x:y]) for x, y in zip(at, at[1:], strict=False)]
        if others := np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist():
            for i, raw_ids in zip(others, self.whole([texts[i].as_py() for i in others]), strict=True):
                out[i] = raw_ids
        return out


@functools.lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def gathered(batches: Iterator[pa.RecordBatch], most: int = TOGETHER) -> Iterator[pa.Table]:
    """Neighbouring batches together, up to so many bytes: the more text, the fewer words in it are new."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pieces_of(docs: DataFrame, id_col: str, text_col: str, window: int, vocabulary: str, emit: str) -> DataFrame:
    """id, start, length, doc_tokens and ids_crc32 (emit="crc32") or ids, little-endian (emit="ids")."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            keys, start, total, size, payload = [], [], [], [], []
            for key, ids in zip(batch.column("id").to_pylist(), encoder(vocabulary).encode(batch.column("t").combine_chunks()), strict=True):
                ids += END
                for at in range(0, len(ids), 4 * window):
                    raw = ids[at : at + 4 * window]
                    keys.append(key)
                    start.append(at // 4)
                    size.append(len(raw) // 4)
                    total.append(len(ids) // 4)
                    payload.append(zlib.crc32(raw) if emit == "crc32" else raw)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(payload, pa.int64() if emit == "crc32" else pa.binary())], names=["id", "start", "length", "doc_tokens", name])

    name, kind = ("ids_crc32", "long") if emit == "crc32" else ("ids", "binary")
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("t"))
    return rows.mapInArrow(cut, f"id string, start long, length long, doc_tokens long, {name} {kind}")


def nnls(columns: np.ndarray, target: np.ndarray, steps: int = 400) -> np.ndarray:
    """min |A x - target|, x >= 0, where column j of A counts the lengths columns[j] (0: none); by accelerated projected gradient."""
    size = len(target)

    def forward(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(columns[:, i], weights=x, minlength=size) for i in range(columns.shape[1]))
        y[0] = 0
        return y

    def back(r: np.ndarray) -> np.ndarray:
        return r[columns].sum(axis=1)

    v = np.ones(len(columns))
    for _ in range(30):
        v = back(forward(v))
        v /= (norm := np.linalg.norm(v)) or 1.0
    step = 1.0 / max(norm * 1.05, 1e-9)
    x = y = np.zeros(len(columns))
    momentum = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(forward(y) - target))
        after = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        x, y, momentum = new, new + (momentum - 1) / after * (new - x), after
    return x


def plan_windows(histogram: dict[int, int], window: int = WINDOW, grid: int = 64) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations as [(length, how often in one sequence)], and how many sequences use each. Takes every piece exactly once."""
    left = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] += n
    out: list[tuple[list[tuple[int, int]], int]] = []

    def use(lengths: list[int], repeats: int) -> None:
        counts = [(x, lengths.count(x)) for x in sorted(set(lengths), reverse=True)]
        repeats = min([repeats, *(int(left[x]) // m for x, m in counts)])
        if repeats > 0:
            for x, m in counts:
                left[x] -= m * repeats
            out.append((counts, repeats))

    use([window], int(left[window]))
    pairs = [(a, window - a, 0) for a in range(1, window // 2 + 1) if left[a] and left[window - a]]
    triples = [(a, b, window - a - b) for a in range(grid, window // 3 + 1, grid) if left[a] for b in range(a, (window - a) // 2 + 1) if left[b] and left[window - a - b]]
    if combos := pairs + triples:
        columns = np.array(combos)
        target = left.astype(float)
        target[window] = 0
        x = nnls(columns, target)
        # What rounding cuts off is carried on to the next combination of the same smallest length.
        whole, carry = np.floor(x).astype(np.int64), 0.0
        for j in range(len(x)):
            carry += x[j] - whole[j]
            if carry >= 1:
                whole[j], carry = whole[j] + 1, carry - 1
        for j in np.argsort(-whole, kind="stable"):
            if whole[j]:
                use([int(v) for v in columns[j] if v], int(whole[j]))
    while (present := np.flatnonzero(left)).size:
        counts, room = [], window
        for x in map(int, present[::-1]):
            if m := min(room // x, int(left[x])):
                counts.append((x, m))
                room -= m * x
            if not room:
                break
        repeats = min(int(left[x]) // m for x, m in counts)
        for x, m in counts:
            left[x] -= m * repeats
        out.append((counts, repeats))
    return out


def slots(plan: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, ...]]:
    """length, first and last rank, first sequence, how often in a sequence, first offset."""
    rows, used, sequence = [], {}, 0
    for counts, repeats in plan:
        offset = 0
        for length, m in counts:
            first = used.get(length, 0)
            used[length] = first + m * repeats
            rows.append((length, first, used[length] - 1, sequence, m, offset))
            offset += m * length
        sequence += repeats
    return rows


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str = VOCABULARY, emit: str = "crc32", pieces_per_bucket: int = 20_000) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, ids_crc32 or ids, sequence_id, offset."""
    with small_batches(spark):
        pieces = materialize(pieces_of(docs, id_col, text_col, window, vocabulary, emit), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    buckets = max(64, math.ceil(max(histogram.values(), default=1) / pieces_per_bucket))
    bounds = spark.createDataFrame(slots(plan_windows(histogram, window)), "length long, first long, last long, sequence long, m long, at long")
    x = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "start"), F.lit(buckets)))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = x.groupBy("length", "bucket").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = W.partitionBy("length", "bucket").orderBy("id", "start")
    x = x.withColumn("inside", F.row_number().over(inside) - 1).join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))
    # The plan's size depends on the window alone, not on the corpus.
    b = F.broadcast(bounds.withColumnRenamed("length", "plan_length"))
    x = x.join(b, (F.col("length") == F.col("plan_length")) & F.col("rank").between(F.col("first"), F.col("last")))
    j = F.col("rank") - F.col("first")
    sequence, offset = F.col("sequence") + F.floor(j / F.col("m")), F.col("at") + F.pmod(j, F.col("m")) * F.col("length")
    payload = "ids_crc32" if emit == "crc32" else "ids"
    return x.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "start", "length", payload, "doc_tokens", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def assemble(packed: DataFrame) -> DataFrame:
    """The sequences of pack(..., emit="ids"): sequence_id, n_tokens, ids (little-endian). A sequence has at most `window` pieces."""
    x = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return x.select("sequence_id", "n_tokens", F.aggregate(F.transform("p", lambda e: e["ids"]), F.lit(b""), lambda a, e: F.concat(a, e)).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, documents(spark, sf_dir))
