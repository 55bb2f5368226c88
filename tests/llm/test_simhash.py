"""Fingerprints and their components against all pairs, also where shards are dealt again."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from civicpulse.llm import simhash
from civicpulse.llm.common import start

SCHEMA = "doc_id long, text string, point long, shard string, low string, root string, rows string, vertex string"


def plain_fingerprint(text) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    if words and len(words) < 3:
        shingles = [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in hashes) > len(hashes))


def pairs_within(points, reach=2) -> set:
    out = set()
    for i, x in enumerate(points):
        for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ x) <= reach):
            out.add((i, i + 1 + int(j)))
    return out


def clustered(n: int, seed: int) -> np.ndarray:
    """Distinct points: some at random, some within a few bits of a few centres."""
    random_ = np.random.default_rng(seed)
    points = random_.integers(0, 2**64, n, dtype=np.uint64)
    for _ in range(3):
        near = random_.random(n) < 0.6
        points[near] = points[random_.integers(0, n // 20 + 1, near.sum())] ^ (np.uint64(1) << random_.integers(0, 64, near.sum(), dtype=np.uint64))
    return np.unique(points)


@pytest.fixture(scope="module", autouse=True)
def prepared(spark):
    start(spark)


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one TWO", "a b c", "A b C d", "É é ß x y", "x " * 5000, "w1 w2 w3\x0bw4\x0cw5\x1cw6"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("leaf", [4, 64, 256])
def test_leaves_find_all_pairs(monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    points = clustered(1500, leaf)
    a, b = simhash._near(points, 2)
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} == pairs_within(points)


def test_points_that_nothing_cuts(monkeypatch):
    points = np.unique(np.array([0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i in range(64) for j in range(i))], np.uint64))
    expected = pairs_within(points)
    a, b = simhash._by_masks(points, np.arange(len(points)), 2)
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} == expected
    monkeypatch.setattr(simhash, "LEAF", 16)
    a, b = simhash._near(points, 2)
    assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} == expected


@pytest.mark.parametrize("points_per_shard", [50, simhash.POINTS])
def test_every_near_pair_meets_in_a_shard(spark, monkeypatch, points_per_shard):
    for name, value in (("POINTS", points_per_shard), ("LEAST_SHARDS", 4), ("MOST_SHARDS", 8), ("SAMPLE", 64), ("ROWS", 100)):
        monkeypatch.setattr(simhash, name, value)
    points = clustered(2000, 9)
    table = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "point long")
    shards = {}
    for row in simhash._shards(table, len(points), 2).collect():
        shards.setdefault(row.shard, set()).add(row.point)
    assert len(shards) > 4 + 8 * (points_per_shard == 50)
    for i, j in pairs_within(points):
        pair = {int(points.view(np.int64)[i]), int(points.view(np.int64)[j])}
        assert any(pair <= own for own in shards.values())


def test_components_of_odd_texts(spark):
    random_ = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [random_.choice(words) for _ in range(400)]
    rows = [(1, None), (2, ""), (3, "\t"), (None, ""), (None, "alone with no id"), (5, "Solo"), (6, "solo")]
    for i in range(40, 0, -1):
        changed = list(base)
        changed[i] = "changed"
        rows += [(100 + i, " ".join(changed)), (100 + i, " ".join(changed))]
    rows += [(200 + i, " ".join(random_.choice(words) for _ in range(30))) for i in range(60)]
    rows.append((300, " ".join(random_.choice(words) for _ in range(100_000))))
    got = simhash.near_duplicates(spark.createDataFrame([(*r, 1, "s", "l", "r", "n", "v") for r in rows], SCHEMA)).collect()
    points = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    root = list(range(len(rows)))
    for i, j in pairs_within(points):
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    lowest = {}
    for (doc_id, _), r in zip(rows, root):
        if doc_id is not None:
            lowest[r] = min(lowest.get(r, doc_id), doc_id)
    expected = [(d, f"{int(p):016x}", lowest.get(r)) for (d, _), p, r in zip(rows, points, root)]
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_third_of_all_rows_in_one_group(spark):
    rows = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "the same text again").otherwise(F.concat(F.lit("own "), F.md5(F.col("id").cast("string")))).alias("text"))
    got = simhash.near_duplicates(rows.withColumnRenamed("id", "doc_id"))
    assert got.where("doc_id % 3 = 0").select("component_id").distinct().collect()[0][0] == 0
    assert got.count() == 6000
