"""Approximate nearest neighbours: stable projections, a kd-tree, and a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicpulse.llm.common import groups_of, numbers

NEAREST = 10
#: Numbers that a vector is projected to; even, so that the chi-square test has a closed form.
PROJECTED = 8
#: A search stops when a nearer vector would have shown with this probability.
CONFIDENCE = 0.98
#: Rows that the tree over the whole table is fitted on at most, those with the smallest hashes.
SAMPLE_ROWS = 20_000
#: Vectors that one task searches at a time; a larger leaf of the tree is searched in parts.
LEAF_ROWS = 4_000
#: Leaves that the sample allows at most, as each needs sampled rows to be cut by.
MOST_LEAVES = 512
#: Queries that meet a part at a time.
QUERY_ROWS = 2_000
#: Vectors in a leaf of a part's own tree.
SMALL_LEAF = 64

#: What a vector is known by; ``row`` tells vectors of one vec_id apart.
VECTOR = ("vec_id", "row", "embedding")


def projection(width: int) -> np.ndarray:
    """A fixed matrix of independent standard normal numbers, which are 2-stable."""
    return np.random.default_rng(7_001).standard_normal((width, PROJECTED))


def seen(ratio: np.ndarray | float) -> np.ndarray:
    """Chance that a vector's squared projected distance, over its squared distance, is at most ``ratio``.

    That quotient has a chi-square distribution with PROJECTED degrees of freedom.
    """
    half = np.minimum(np.asarray(ratio, float) / 2, 700)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(PROJECTED // 2))


class Tree:
    """A kd-tree whose leaves are boxes; ``leaf`` has the leaf of each fitted row."""

    def __init__(self, points: np.ndarray, size: int):
        self.cuts: list[tuple[int, float, int, int]] = []
        self.leaves, self.leaf = 0, np.zeros(len(points), np.int64)
        self.root = self._grow(points, np.arange(len(points)), size)

    def _grow(self, points: np.ndarray, rows: np.ndarray, size: int) -> int:
        """The node over these rows: a cut's number, or -1 minus a leaf's."""
        if len(rows) > size:
            part = points[rows]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            cut = float(np.median(part[:, axis]))
            low = part[:, axis] < cut
            if not low.any() and (part[:, axis] > cut).any():
                cut = float(part[:, axis][part[:, axis] > cut].min())
                low = part[:, axis] < cut
            if low.any():
                at = len(self.cuts)
                self.cuts.append((axis, cut, 0, 0))
                self.cuts[at] = (axis, cut, self._grow(points, rows[low], size), self._grow(points, rows[~low], size))
                return at
        self.leaf[rows] = self.leaves
        self.leaves += 1
        return -self.leaves

    def find(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point falls in."""
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                axis, cut, below, above = self.cuts[node]
                low = points[rows, axis] < cut
                todo += [(below, rows[low]), (above, rows[~low])]
        return out

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper corner of each leaf's box; unbounded at the outside."""
        low, high = np.full((self.leaves, PROJECTED), -np.inf), np.full((self.leaves, PROJECTED), np.inf)
        todo = [(self.root, np.full(PROJECTED, -np.inf), np.full(PROJECTED, np.inf))]
        while todo:
            node, a, b = todo.pop()
            if node < 0:
                low[-node - 1], high[-node - 1] = a, b
                continue
            axis, cut, below, above = self.cuts[node]
            b_low, a_high = b.copy(), a.copy()
            b_low[axis], a_high[axis] = cut, cut
            todo += [(below, a, b_low), (above, a_high, b)]
        return low, high


def gaps(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point from each box."""
    return (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(-1)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (as double) of the vectors that take part, a row each.

    Left out are rows without vec_id, null and empty vectors, and those that are zero or hold a null
    or non-finite number. Rows that share a vec_id, equal ones too, are vectors of their own.
    """
    x = F.col("embedding")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
        .where("vec_id is not null and size(embedding) > 0")
        .where(~F.exists("embedding", bad) & F.exists("embedding", lambda v: v != 0))
    )


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return numbers(column, np.float64).reshape(-1, width)


def _placed(tree: Tree, width: int):
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = projection(width)
        for batch in batches:
            leaf = tree.find(_rows(batch.column("embedding"), width) @ matrix)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in VECTOR), pa.array(leaf)], [*VECTOR, "leaf"])

    return put


def nearest(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, places, best: tuple[np.ndarray, np.ndarray], k: int, width_matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of a part and of ``best``: their distances and (vec_id, row), nearest first, without row ``own``.

    Leaves of the part's tree are taken by their distance from the projected query; their vectors
    are verified by their own distance; the search ends when the next leaf is so far that a vector
    nearer than the k-th found would have been seen with the wanted confidence.
    """
    order, starts, low, high = places
    far = gaps(query @ width_matrix, low, high)
    scores, found = best
    for leaf in np.argsort(far, kind="stable"):
        if len(scores) >= k and (scores[k - 1] == 0 and far[leaf] > 0 or scores[k - 1] > 0 and seen(far[leaf] / scores[k - 1] ** 2) >= CONFIDENCE):
            break
        rows = order[starts[leaf] : starts[leaf + 1]]
        rows = rows[ids[rows, 1] != own]
        distance = np.sqrt(((vectors[rows] - query) ** 2).sum(1))
        scores, found = np.concatenate([scores, distance]), np.concatenate([found, ids[rows]])
        first = np.lexsort((found[:, 1], found[:, 0], scores))[:k]
        scores, found = scores[first], found[first]
    return scores, found


FOUND = "query_id long, query_row long, vec_id long, row long, score double"


def _searched(width: int, k: int):
    """Search one part with the queries that come to it; rows of a part follow each other, vectors first."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = projection(width)
        for batch in groups_of("part", batches):
            part = np.asarray(batch.column("part"))
            ids = np.stack([np.asarray(batch.column(c)) for c in ("vec_id", "row")], axis=1)
            is_query = np.asarray(batch.column("is_query"))
            vectors, reach = _rows(batch.column("embedding"), width), np.asarray(batch.column("reach"))
            edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            out: tuple[list, list, list] = ([], [], [])  # query, found, score
            for a, b in zip(edges[:-1], edges[1:]):
                asked = a + np.flatnonzero(is_query[a:b])
                rows = a + np.flatnonzero(~is_query[a:b])
                if not len(asked) or not len(rows):
                    continue
                projected = vectors[rows] @ matrix
                tree = Tree(projected, SMALL_LEAF)
                order = np.argsort(tree.leaf, kind="stable")
                starts = np.searchsorted(tree.leaf[order], np.arange(tree.leaves + 1))
                low = np.minimum.reduceat(projected[order], starts[:-1])
                high = np.maximum.reduceat(projected[order], starts[:-1])
                for q in asked:
                    # What is known to be near enough stands in for k vectors at that distance.
                    bound = (np.full(k, reach[q]), np.full((k, 2), -1)) if np.isfinite(reach[q]) else (np.zeros(0), np.zeros((0, 2), np.int64))
                    scores, found = nearest(vectors[q], ids[q, 1], ids[rows], vectors[rows], (order, starts, low, high), bound, k, matrix)
                    real = found[:, 1] >= 0 if np.isfinite(reach[q]) else np.ones(len(found), bool)
                    out[0].append(np.repeat(ids[q : q + 1], real.sum(), axis=0))
                    out[1].append(found[real])
                    out[2].append(scores[real])
            query, found = (np.concatenate(x) if x else np.zeros((0, 2), np.int64) for x in out[:2])
            score = np.concatenate(out[2]) if out[2] else np.zeros(0)
            columns = [query[:, 0], query[:, 1], found[:, 0], found[:, 1], score]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], [f.split()[0] for f in FOUND.split(", ")])

    return search


def _visits(tree: Tree, width: int):
    """The other leaves that a query has to visit, given how far its k-th nearest so far is."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, (low, high) = projection(width), tree.boxes()
        for batch in batches:
            reach, home = np.asarray(batch.column("reach")), np.asarray(batch.column("leaf"))
            query, leaf = [], []
            for i, point in enumerate(_rows(batch.column("embedding"), width) @ matrix):
                far = gaps(point, low, high)
                if not np.isfinite(reach[i]):
                    go = np.ones(len(far), bool)
                elif reach[i] == 0:
                    go = far == 0
                else:
                    go = seen(far / reach[i] ** 2) < CONFIDENCE
                go[home[i]] = False
                leaf.append(np.flatnonzero(go))
                query.append(np.full(go.sum(), i))
            rows = pa.array(np.concatenate(query) if query else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(rows) for c in (*VECTOR, "reach")]
                + [pa.array(np.concatenate(leaf) if leaf else np.zeros(0, np.int64))],
                [*VECTOR, "reach", "leaf"],
            )

    return listed


def _asked(queries: DataFrame, points: DataFrame, parts: DataFrame, width: int, k: int) -> DataFrame:
    """Send queries to all parts of their leaf, a block of queries at a time, and search there."""
    n = F.col("parts")
    # Vectors of a leaf are dealt to its parts; a part is repeated for each block of its queries.
    blocks = queries.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("blocks"))
    # A row per leaf, at most MOST_LEAVES: broadcast, so that no leaf is gathered.
    sizes = F.broadcast(parts.join(blocks, "leaf"))
    name = lambda part, block: F.xxhash64("leaf", part, block).alias("part")
    vectors = points.join(sizes, "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).select(
        name(F.pmod(F.xxhash64("row"), n.cast("long")).cast("int"), F.col("block")),
        F.lit(False).alias("is_query"), *VECTOR, F.lit(float("inf")).alias("reach"),
    )
    asked = queries.join(sizes, "leaf").withColumn("at", F.explode(F.sequence(F.lit(0), n.cast("int") - 1))).select(
        name(F.col("at"), F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int")),
        F.lit(True).alias("is_query"), *VECTOR, "reach",
    )
    return vectors.union(asked).repartition("part").sortWithinPartitions("part").mapInArrow(
        _searched(width, k), FOUND
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    nearest_first = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, k: int = NEAREST) -> DataFrame:
    """Per query its k nearest vectors: query_id, rank, vec_id, score (Euclidean distance).

    ``is_query`` is the condition on vec_id that chooses the queries. The tree over the whole table
    is fitted on a bounded sample; every vector is put in its leaf. A query first searches its own
    leaf, which bounds how far its neighbours are, and then the leaves that the chi-square test
    does not rule out. A leaf with more than LEAF_ROWS vectors, as equal vectors make, is searched
    in parts. Rows that share a vec_id are each a query, if it is one, and candidates of each other. Scores are those of the original vectors; ties go to the smaller vec_id. ``valid``
    says which vectors take part; vectors of another width than the commonest one take no part
    either; a query with fewer than k others gets all; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    known = valid(vectors)
    width = known.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").head()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = width["width"]
    # Numbered once they are stored, so a vector keeps its number.
    known = known.where(F.size("embedding") == width).checkpoint().withColumn("row", F.monotonically_increasing_id())
    total = known.count()
    sample = known.orderBy(F.xxhash64("vec_id", "row"), "vec_id", "row").limit(SAMPLE_ROWS).select("embedding").toArrow()
    sample = _rows(sample["embedding"].combine_chunks(), width) @ projection(width)
    leaves = min(MOST_LEAVES, max(1, 2 * total // LEAF_ROWS), max(1, len(sample) // 8))
    tree = Tree(sample, max(1, -(-len(sample) // leaves)))
    tree.leaf = np.zeros(0, np.int64)
    points = known.select(*VECTOR).mapInArrow(_placed(tree, width), "vec_id long, row long, embedding array<double>, leaf long").checkpoint()
    parts = points.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF_ROWS).alias("parts"))
    queries = points.where(is_query).withColumn("reach", F.lit(float("inf")))
    at_home = _best(_asked(queries, points, parts, width, k), k).drop("rank").checkpoint()
    reach = at_home.groupBy("query_row").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("near"))
    bounded = queries.join(reach, queries.row == reach.query_row, "left").select(
        *VECTOR, "leaf", F.coalesce("near", F.lit(float("inf"))).alias("reach")
    )
    elsewhere = bounded.mapInArrow(_visits(tree, width), "vec_id long, row long, embedding array<double>, reach double, leaf long").checkpoint()
    found = at_home.union(_asked(elsewhere, points, parts, width, k))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
