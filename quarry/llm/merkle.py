"""A Merkle manifest of a dataset: a leaf for each row, a tree for each group, a root over the groups' subroots, and a proof for each row.

Trees are binary; the last node of a level may stand alone, and its parent is then the digest of it alone. Upper trees are broadcast:

1. Leaves are hashed in the scan (texts are never shuffled) and sorted by (tree, key, leaf), which gives each its place in its tree.
2. Large blocks of 2^block_levels neighbouring leaves are folded to one node each, and blocks of blocks, until at most `top` nodes are
   left. A tree with a third of all leaves is many blocks; a block is all that a task holds.
3. The driver builds the trees over those nodes and the root, and broadcasts for each node the path that leads from it to the root: `top`
   rows at most. If there are more trees than that, their subroots are the leaves of one tree more, which is folded in the same way.
4. Executors go back down: each block's own paths, then the path above it, are the proofs. `folded` is the digest that a leaf and a
   proof lead to, row by row, without the tree.

Order: null trees and null keys first, rows with one key by their leaf; trees as UTF-8 bytes. Null values are told from empty ones (see
leaf_of). Repeated rows are leaves of their own. An empty table has no leaves and no root. Columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, documents, materialize, small_join

BLOCK_LEVELS = 12
TOP = 4096
NODE = "_tree string, _at long, _size long, _digest string"
ABOVE = "_path string, subroot string, root string"
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*columns: Column) -> Column:
    """The digest of a row: each value as its UTF-8 byte count, a colon and itself, a null as a dash."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in text]), 256)


def levels_of(nodes: list[str], n: int) -> list[list[str]]:
    """The nodes and the n levels above them."""
    out = [nodes]
    for _ in range(n):
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def path_of(levels: list[list[str]], at: int) -> list[str]:
    """What leads from a node to the last level: L or R and the sibling on that side, or a dash where there is none."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append("-" if other >= len(level) else f"{'L' if at & 1 else 'R'}{level[other]}")
        at >>= 1
    return out


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    side = lambda s, name: F.when(s.startswith(name), F.substr(s, F.lit(2))).otherwise(F.lit(""))
    steps = F.filter(F.split(proof, " "), lambda s: s != "")
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(side(s, "L"), h, side(s, "R")), 256))


def siblings_digest(proof: Column) -> Column:
    """The digest of a proof's siblings, level by level."""
    return F.sha2(F.translate(proof, "LR- ", ""), 256)


def placed(scratch: Scratch, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """nodes (_tree, _digest, keys; others) with _at, the place in the tree by keys and digest, and _size, the tree's leaves."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_tree", *keys, "_digest", "_row"]
    rows = nodes.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_row").withColumn("_m", F.monotonically_increasing_id())
    rows = scratch.table(rows, "leaves-in-order")
    # A partition holds neighbouring trees, so this has a row a partition and one a tree at most.
    starts = rows.groupBy("_tree", F.shiftright("_m", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.min("_m").alias("first"))
    tree = W.partitionBy("_tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.table(starts.select("_tree", "_part", (before - F.col("first")).alias("_shift"), F.sum("n").over(tree).alias("_size")), "starts")
    x = small_join(rows.withColumn("_part", F.shiftright("_m", 33)), starts, ["_tree", "_part"], "inner", starts.count())
    return x.withColumn("_at", F.col("_m") + F.col("_shift")).drop("_m", "_part", "_shift")


def proofs(spark: SparkSession, scratch: Scratch, nodes: DataFrame, keys: list[str], block_levels: int = BLOCK_LEVELS, top: int = TOP) -> DataFrame:
    """nodes (_tree, _digest, _row, keys; others) with subroot, root and _path."""

    def height(table: pa.Table) -> int:
        return min(block_levels, (table.column("_size")[0].as_py() - 1).bit_length())

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        above = levels_of(table.column("_digest").to_pylist(), height(table))
        size = ((table.column("_size")[0].as_py() - 1) >> block_levels) + 1
        return pa.table({"_tree": [key[0].as_py()], "_at": [key[1].as_py()], "_size": [size], "_digest": above[-1]})

    def unfold(table: pa.Table, names: list[str], path: str, subroot: str, root: str) -> pa.Table:
        table = table.sort_by("_at")
        levels, first = levels_of(table.column("_digest").to_pylist(), height(table)), table.column("_at")[0].as_py()
        paths = [" ".join([*path_of(levels, at - first), path]).strip() for at in table.column("_at").to_pylist()]
        n = table.num_rows
        return table.select(names).append_column("_path", pa.array(paths)).append_column("subroot", pa.array([subroot] * n)).append_column("root", pa.array([root] * n))

    block = F.shiftright("_at", block_levels).alias("_block")
    stages = [scratch.table(placed(scratch, nodes, keys), "nodes")]
    while True:
        stages.append(scratch.table(stages[-1].select("_tree", "_at", "_size", "_digest").groupBy("_tree", block).applyInArrow(fold, NODE), "blocks"))
        n = stages[-1].count()
        if n <= top or not stages[-1].filter("_size > 1").limit(1).count():
            break
    if n <= top:
        above: DataFrame | Callable = _driver_top(spark, stages[-1])
    else:
        subroots = scratch.table(stages[-1].select(F.lit("").alias("_tree"), F.col("_tree").alias("_key"), "_digest", F.lit(0).alias("_row")), "subroots")
        one = proofs(spark, scratch, subroots, ["_key"], block_levels, top)
        above = one.select(F.col("_key").alias("_tree"), F.lit(0).cast("long").alias("_at"), "_path", F.col("_digest").alias("subroot"), "root")
    if isinstance(above, DataFrame):
        above = scratch.table(above, "top")
    for i in range(len(stages) - 2, -1, -1):
        names = [c for c in stages[i].columns if i == 0 and c not in ("_at", "_size") or c in ("_tree", "_at") and i]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stages[i].schema if f.name in names)
        groups = stages[i].groupBy("_tree", block)
        if isinstance(above, DataFrame):
            out = groups.cogroup(above.groupBy("_tree", F.col("_at").alias("_block"))).applyInArrow(_beside(unfold, names), f"{kinds}, {ABOVE}")
        else:
            out = groups.applyInArrow(_below(unfold, names, above), f"{kinds}, {ABOVE}")
        above = out if i == 0 else scratch.table(out, "paths")
    return above


def _below(unfold: Callable, names: list[str], above: Callable) -> Callable:
    """unfold for a block's key and rows, with what is above it looked up."""
    return lambda key, table: unfold(table, names, *above(key))


def _beside(unfold: Callable, names: list[str]) -> Callable:
    """unfold for a block's rows and the one row of what is above it."""
    return lambda table, up: unfold(table, names, *[up.column(c)[0].as_py() for c in ("_path", "subroot", "root")])


def _driver_top(spark: SparkSession, nodes: DataFrame) -> Callable:
    """The trees over the nodes that are left, `top` at most, and the root; as a look-up of what is above a node."""
    trees: dict[str, list[tuple[int, str]]] = {}
    for r in nodes.collect():
        trees.setdefault(r["_tree"], []).append((r["_at"], r["_digest"]))
    own = {t: [d for _, d in sorted(trees[t])] for t in sorted(trees, key=str.encode)}
    towers = {t: levels_of(x, (len(x) - 1).bit_length()) for t, x in own.items()}
    over = levels_of([x[-1][0] for x in towers.values()], max(0, len(towers) - 1).bit_length())
    found = {}
    for i, (t, tower) in enumerate(towers.items()):
        rest = path_of(over, i)
        for at in range(len(tower[0])):
            found[t, at] = (" ".join([*path_of(tower, at), *rest]), tower[-1][0], over[-1][0])
    shared = spark.sparkContext.broadcast(found)
    return lambda key: shared.value[key[0].as_py(), key[1].as_py()]


def manifest(spark: SparkSession, docs: DataFrame, leaf: Column, key: str = "doc_id", tree: str = "lang", carry: dict[str, Column] | None = None, block_levels: int = BLOCK_LEVELS, top: int = TOP) -> DataFrame:
    """A row for each of docs: key, tree, what `carry` names, leaf, subroot, root and proof (see path_of; "" if the leaf is the root)."""
    scratch, carry = Scratch(spark), carry or {}
    # A null tree comes before the empty one.
    name = F.coalesce(F.concat(F.lit("="), F.col(tree)), F.lit(""))
    rows = docs.select(name.alias("_tree"), F.col(key).alias("_key"), leaf.alias("_digest"), F.monotonically_increasing_id().alias("_row"), *[c.alias(f"+{n}") for n, c in carry.items()])
    x = proofs(spark, scratch, scratch.table(rows, "leaves"), ["_key"], block_levels, top)
    tree_name = F.when(F.col("_tree") != "", F.substr("_tree", F.lit(2)))
    x = x.select(F.col("_key").alias(key), tree_name.alias(tree), *[F.col(f"`+{n}`").alias(n) for n in carry], F.col("_digest").alias("leaf"), "subroot", "root", F.col("_path").alias("proof"))
    out = materialize(x, "manifest")
    scratch.close()
    return out


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are tampered with where 7 divides the crc32 of the id: their leaf is that of one character more, their proof the original."""
    docs = documents(spark, sf_dir)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(hit, leaf_of(*[F.col(c) + F.lit(1) if c == "n_chars" else F.col(c) for c in LEAF]))
    x = manifest(spark, docs, leaf_of(*map(F.col, LEAF)), carry={"tampered": tampered})
    x = x.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return x.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 bit by bit: DuckDB has no function for it.
_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"
_LEAF = lambda n_chars: "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF("n_chars")} AS leaf, {_LEAF("(n_chars + 1)")} AS other,
         xor({_CRC}, 4294967295) % 7 = 0 AS hit FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
low AS (
  SELECT 0 AS level, tree, place, leaf AS h, n FROM l
  UNION ALL
  SELECT min(level) + 1, tree, place // 2, sha256(string_agg(h, '' ORDER BY place)), (min(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, place // 2),
s AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, place, h, n FROM s
  UNION ALL
  SELECT min(level) + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (min(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY place // 2),
tall AS (SELECT tree, max(level) AS up FROM low GROUP BY tree),
steps AS (
  SELECT l.doc_id, l.leaf, l.place, l.tree, low.level AS step, (l.place >> low.level) & 1 AS odd, b.h AS h
  FROM l JOIN low ON low.tree = l.tree AND low.place = l.place >> low.level AND low.n > 1
  LEFT JOIN low b ON b.tree = low.tree AND b.level = low.level AND b.place = xor(low.place, 1)
  UNION ALL
  SELECT l.doc_id, l.leaf, l.place, l.tree, tall.up + high.level, (s.place >> high.level) & 1, b.h
  FROM l JOIN tall USING (tree) JOIN s USING (tree) JOIN high ON high.place = s.place >> high.level AND high.n > 1
  LEFT JOIN high b ON b.level = high.level AND b.place = xor(high.place, 1)),
paths AS (
  SELECT tree, place, string_agg(h, '' ORDER BY step) AS joined,
         list(CASE WHEN h IS NULL THEN '-' WHEN odd = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY step) AS path FROM steps GROUP BY tree, place)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(p.joined, '')) AS proof_sha256,
       list_reduce(list_prepend(CASE WHEN hit THEN coalesce(other, leaf) ELSE leaf END, coalesce(p.path, [])),
         lambda a, b: sha256(CASE WHEN b[1] = 'L' THEN b[2:] || a WHEN b[1] = 'R' THEN a || b[2:] ELSE a END)) AS folded_root,
       folded_root = r.h AS verified
FROM l JOIN s USING (tree) CROSS JOIN (SELECT h FROM high WHERE n = 1) r LEFT JOIN paths p ON p.tree = l.tree AND p.place = l.place
"""
