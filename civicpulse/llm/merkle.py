"""A Merkle manifest of a dataset: one tree per language, one over the languages, a proof per row.

The rows of a language are numbered in order and cut into superblocks of 2^bits consecutive leaves. A
task reduces one superblock to its top; the tops are cut and reduced in the same way until each tree has
one node. Then outer nodes travel back down: the siblings that a superblock needs from outside are
cogrouped with its leaves, and the task that gets both finishes the inner reduction, joins inner and
outer proof, and folds the observed leaf up to the root. So no task holds more than a superblock, and
texts are read and hashed in the scan only: what is shuffled are digests.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leaves of a superblock, as a power of two.
BITS = 10

#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(**changed: Column) -> Column:
    """The digest of a row: each field as ``-`` if null, else its bytes, a colon and its text."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def joined(left: str, right: str) -> str:
    return sha256((left + right).encode()).hexdigest()


def reduced(nodes: list[str], height: int) -> list[list[str]]:
    """``nodes`` and the levels above them, up to ``height``; a node without a partner is hashed alone."""
    levels = [nodes]
    for _ in range(height):
        below = levels[-1]
        levels.append([joined(below[i], below[i + 1] if i + 1 < len(below) else "") for i in range(0, len(below), 2)])
    return levels


def path(levels: list[list[str]], at: int) -> list[str]:
    """The siblings of a node, a token per level: ``L`` or ``R`` and a digest, ``-`` where it has none."""
    tokens = []
    for level in levels[:-1]:
        other = at ^ 1
        tokens.append("-" if other >= len(level) else ("L" if other < at else "R") + level[other])
        at >>= 1
    return tokens


def folded(node: str, tokens: list[str]) -> str:
    """The root that a node gives with the siblings of a proof."""
    for token in tokens:
        node = joined(token[1:], node) if token[0] == "L" else joined(node, token[1:])
    return node


def _height(size: int, bits: int) -> int:
    """Levels that a superblock is reduced by, in a tree that has ``size`` nodes at its height."""
    return min(bits, (size - 1).bit_length())


def ranked(df: DataFrame, tree: str, *order: str) -> DataFrame:
    """``df`` with ``pos``, the place of a row in its tree, and ``size``, the tree's rows.

    Rows are dealt out by range, so a tree that holds most rows is spread; a row's place is its place in its
    partition and the counts of the partitions before. Equal rows are told apart by where they were read.
    """
    keys = [tree, *order, "_read"]
    placed = df.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = placed.drop("_read").checkpoint()
    placed = placed.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    parts = placed.groupBy(tree, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    ahead = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        tree, "_part", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"),
        F.sum("_n").over(Window.partitionBy(tree)).alias("size"),
    )
    found = placed.join(offsets, [tree, "_part"]).withColumn("pos", F.col("_row") - F.col("_first") + F.col("_ahead"))
    return found.drop("_part", "_row", "_first", "_ahead")


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", bits)).groupBy("tree", "block")


def _tops(nodes: DataFrame, bits: int) -> DataFrame:
    """One node per superblock: the next nodes of the tree."""

    def top(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block, size = block.sort_values("pos"), int(block["size"].iloc[0])
        node = reduced(list(block["node"]), _height(size, bits))[-1][0]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "size": [-(-size >> bits)], "node": [node]})

    columns = nodes.select("tree", "pos", "size", "node")
    return _blocks(columns, bits).applyInPandas(top, "tree string, pos long, size long, node string")


def _heights(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """``nodes`` and the nodes above them, until each tree has one."""
    heights = [nodes]
    size = nodes.agg(F.max("size")).first()[0] or 1
    while True:
        heights.append(_tops(heights[-1], bits).checkpoint())
        size = -(-size >> bits)
        if size <= 1:
            return heights


def _descended(nodes: DataFrame, outer: DataFrame, bits: int) -> DataFrame:
    """``tree``, ``block``, ``outer``, ``subroot``, ``root`` for each node, from those of its superblock."""

    def down(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block, (_, _, rest, subroot, root) = block.sort_values("pos"), above.iloc[0]
        levels = reduced(list(block["node"]), _height(int(block["size"].iloc[0]), bits))
        paths = [" ".join(path(levels, at) + rest.split()) for at in range(len(block))]
        return pd.DataFrame({"tree": block["tree"], "block": block["pos"], "outer": paths, "subroot": subroot, "root": root})

    schema = "tree string, block long, outer string, subroot string, root string"
    return _blocks(nodes, bits).cogroup(outer.groupBy("tree", "block")).applyInPandas(down, schema)


def _outer(heights: list[DataFrame], outer: DataFrame, bits: int) -> DataFrame:
    """What the superblocks of the lowest nodes need from outside, given what the roots need."""
    for nodes in reversed(heights[1:-1]):
        outer = _descended(nodes, outer, bits)
    return outer


def prove(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """A proof per leaf, and the root that the observed leaf folds up to.

    ``leaves`` has ``doc_id``, ``lang``, ``leaf`` and ``observed``, the digest of the row as it is seen now (null:
    unchanged). Added are ``proof`` (siblings up to the root, see ``path``), ``subroot`` of the language,
    ``root``, ``folded_root`` and ``verified``. Leaves are in order of doc_id, nulls first, then of digests;
    a null language is a tree of its own, ahead of the others. Repeated rows are leaves of their own. A
    single leaf is its subroot and, if there is no other language, the root. No leaves give no rows.
    """
    kind = leaves.schema["doc_id"].dataType
    named = leaves.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), "doc_id", F.col("leaf").alias("node"), "observed"
    ).checkpoint()  # ranges are sampled first, and texts should be read once
    placed = ranked(named, "tree", "doc_id", "node").withColumn("doc_id", F.col("doc_id").cast("string")).checkpoint()
    heights = _heights(placed, bits)
    languages = heights[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "node")
    languages = ranked(languages, "tree", "of").checkpoint()
    above = _heights(languages, bits)
    root = above[-1].select("tree", F.col("pos").alias("block"), F.lit("").alias("outer"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    paths = _descended(languages, _outer(above, root, bits), bits).select(F.col("block").alias("pos"), "outer", "root")
    tops = languages.join(paths, "pos").select(
        F.col("of").alias("tree"), F.lit(0).cast("long").alias("block"), "outer", F.col("node").alias("subroot"), "root"
    )
    outer = _outer(heights, tops, bits)

    def finish(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block, (_, _, rest, subroot, root) = block.sort_values("pos"), above.iloc[0]
        nodes, outside = list(block["node"]), rest.split()
        levels = reduced(nodes, _height(int(block["size"].iloc[0]), bits))
        proofs = [path(levels, at) + outside for at in range(len(nodes))]
        seen = [folded(new or old, proof) for new, old, proof in zip(block["observed"], nodes, proofs)]
        return pd.DataFrame({
            "lang": block["tree"].str[1:].where(block["tree"] != "", None), "doc_id": block["doc_id"], "leaf": nodes,
            "subroot": subroot, "root": root, "proof": [" ".join(p) for p in proofs], "folded_root": seen,
            "verified": [s == root for s in seen],
        })

    schema = "lang string, doc_id string, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"
    columns = placed.select("tree", "pos", "size", "doc_id", "node", "observed")
    found = _blocks(columns, bits).cogroup(outer.groupBy("tree", "block")).applyInPandas(finish, schema)
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def siblings(proof: str) -> Column:
    """The digests of a proof's siblings, one after the other."""
    return F.regexp_replace(proof, "[LR -]", "")


def manifest(docs: DataFrame, tampered: Column | None = None, bits: int = BITS) -> DataFrame:
    """``prove`` over the rows of ``docs``; rows with ``tampered`` are seen with ``n_chars`` one higher.

    ``docs`` has the columns of ``FIELDS``; others are not looked at. A null ``n_chars`` stays null.
    """
    changed = F.col("n_chars").cast("decimal(20,0)") + 1
    seen = F.when(tampered, leaf(n_chars=changed)) if tampered is not None else F.lit(None).cast("string")
    return prove(docs.select("doc_id", "lang", leaf().alias("leaf"), seen.alias("observed")), bits)


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text for DuckDB; needs ``crc(t)`` of ``CRC_SQL`` beside it."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    step = "xor(c >> 8, t[1 + (xor(c, b) & 255)])"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {step}), 4294967295)"


#: The steps of CRC-32 by byte.
CRC_SQL = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf_sql(n_chars: str) -> str:
    return f"sha256({' || '.join(_field_sql(n_chars if name == 'n_chars' else name) for name in FIELDS)})"


#: The columns of the registered query for DuckDB, over the view ``documents``.
MANIFEST_SQL = f"""
WITH RECURSIVE {CRC_SQL},
  hashed AS MATERIALIZED (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {_leaf_sql("n_chars")} AS leaf,
      CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf_sql("n_chars::HUGEINT + 1")} END AS observed FROM documents, crc),
  placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
      count(*) OVER (PARTITION BY tree) AS size FROM hashed),
  nodes(tree, l, p, n, d) AS (SELECT tree, 0, pos, size, leaf FROM placed UNION ALL
    SELECT tree, l + 1, p // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY p)) FROM nodes WHERE n > 1 GROUP BY tree, l, p // 2, n),
  subroots AS MATERIALIZED (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE n = 1),
  tops(l, p, n, d) AS (SELECT 0, pos, size, subroot FROM subroots UNION ALL
    SELECT l + 1, p // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY p)) FROM tops WHERE n > 1 GROUP BY l, p // 2, n),
  every AS MATERIALIZED (SELECT tree, l, p, n, d FROM nodes UNION ALL SELECT NULL, l, p, n, d FROM tops),
  inner_path(doc_id, leaf, pos, tree, l, p, n, proof, seen) AS (
    SELECT doc_id, leaf, pos, tree, 0, pos, size, '', coalesce(observed, leaf) FROM placed
    UNION ALL
    SELECT i.doc_id, i.leaf, i.pos, i.tree, i.l + 1, i.p // 2, (i.n + 1) // 2, i.proof || coalesce(e.d, ''),
      sha256(CASE WHEN i.p % 2 = 1 THEN coalesce(e.d, '') || i.seen ELSE i.seen || coalesce(e.d, '') END)
    FROM inner_path i LEFT JOIN every e ON e.tree = i.tree AND e.l = i.l AND e.p = xor(i.p, 1) WHERE i.n > 1),
  outer_path(doc_id, leaf, pos, tree, l, p, n, proof, seen) AS (
    SELECT doc_id, leaf, i.pos, tree, 0, s.pos, s.size, proof, seen FROM inner_path i JOIN subroots s USING (tree) WHERE i.n = 1
    UNION ALL
    SELECT i.doc_id, i.leaf, i.pos, i.tree, i.l + 1, i.p // 2, (i.n + 1) // 2, i.proof || coalesce(e.d, ''),
      sha256(CASE WHEN i.p % 2 = 1 THEN coalesce(e.d, '') || i.seen ELSE i.seen || coalesce(e.d, '') END)
    FROM outer_path i LEFT JOIN every e ON e.tree IS NULL AND e.l = i.l AND e.p = xor(i.p, 1) WHERE i.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, seen AS folded_root, seen = root AS verified
FROM outer_path JOIN subroots USING (tree), (SELECT d AS root FROM tops WHERE n = 1) WHERE outer_path.n = 1"""
