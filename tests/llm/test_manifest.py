"""The Merkle manifest against a plain one, over odd rows and several heights of superblocks."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from civicpulse.llm import merkle
from civicpulse.llm.common import start

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, node string, block string, size string, leaf string"


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, n_chars) -> str:
    values = [row.doc_id, row.source, row.lang, n_chars, row.text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and per node its siblings as (side, digest)."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, of = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for j in range(len(run)):
                for own in owners[i + j]:
                    paths[own].append([("R", run[1]) if j == 0 else ("L", run[0])][0] if len(run) == 2 else ("-", ""))
            above.append(h(*run))
            of.append([o for group in owners[i : i + 2] for o in group])
        nodes, owners = above, of
    return nodes[0], paths


def plain(rows) -> list[tuple]:
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = [(r, leaf_of(r, r.n_chars)) for r in rows if r.lang == lang]
        own.sort(key=lambda x: (x[0].doc_id is not None, x[0].doc_id or 0, x[1]))
        trees.append((own, *climb([digest for _, digest in own])))
    if not trees:
        return []
    root, tops = climb([top for _, top, _ in trees])
    out = []
    for (own, top, paths), above in zip(trees, tops):
        for (row, digest), path in zip(own, paths):
            changed = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 0 and row.n_chars is not None
            seen = leaf_of(row, row.n_chars + 1) if changed else digest
            for side, other in path + above:
                seen = h(other, seen) if side == "L" else h(seen, other)
            out.append((row.doc_id, digest, top, root, h(*(d for _, d in path + above)), seen, seen == root))
    return out


def found(docs, bits: int) -> list[tuple]:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle.manifest(docs, tampered, bits).withColumn("proof_sha256", F.sha2(merkle.siblings("proof").cast("binary"), 256))
    return [tuple(r) for r in rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


@pytest.fixture(scope="module")
def docs(spark):
    start(spark)
    langs = ["en", "en", "en", "fr", "é", None, ""]
    rows = [(i, f"text {i}", langs[i % 7], "s" if i % 3 else None, i if i % 5 else None) for i in range(70)]
    rows += [(7, "text 7", "en", "s", 7)] * 3  # repeated rows
    rows += [(None, "no id", "en", None, 2**63 - 1), (None, None, None, None, None), (14, "", "solo", "", 2**63 - 1), (99, "long " * 40_000, "en", "1:x", -3)]
    rows = [(*row, "c", 1, "c", "c", "c", "c") for row in rows]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_equals_plain(docs, bits):
    rows = found(docs, bits)
    assert sorted(rows, key=repr) == sorted(plain(docs.collect()), key=repr)
    assert {r[-1] for r in rows} == {True, False}


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 5])
def test_few_rows(docs, count):
    few = docs.where("lang = 'en'").orderBy("doc_id").limit(count)
    assert sorted(found(few, 1), key=repr) == sorted(plain(few.collect()), key=repr)


def test_a_single_leaf_is_the_root(spark):
    row = found(spark.createDataFrame([(5, None, None, None, None)], "doc_id int, text string, lang string, source string, n_chars int"), 10)[0]
    assert row[1] == row[2] == row[3] == row[5] and row[4] == sha256(b"").hexdigest()


def test_places_in_a_tree_that_most_rows_share(spark):
    start(spark)
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "=hot").otherwise(F.concat(F.lit("="), F.col("id") % 50)).alias("tree"), (F.col("id") * 7919 % 20_000).alias("doc_id"))
    placed = merkle.ranked(rows, "tree", "doc_id").toPandas().sort_values(["tree", "doc_id"])
    assert (placed.groupby("tree").cumcount() == placed["pos"]).all()
    assert (placed.groupby("tree")["pos"].transform("size") == placed["size"]).all()


def test_what_was_removed_or_moved_no_longer_folds(docs):
    kept = merkle.manifest(docs).where("doc_id = 20").first()
    fewer = merkle.manifest(docs.where("doc_id <> 21")).first()
    assert kept.verified and kept.root != fewer.root
    assert merkle.folded(kept.leaf, kept.proof.split()) == kept.root
    assert merkle.folded(kept.leaf, kept.proof.split()[::-1]) != kept.root
