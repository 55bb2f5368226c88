"""Near duplicates by SimHash fingerprints, paired exactly through vantage-point trees.

Equal fingerprints are one point. A tree over a bounded sample deals the points to shards: at each node
those within the median distance of a vantage point go left, the others right. Two points at most
``reach`` bits apart have distances to the vantage point that differ by ``reach`` at most (triangle bound), so
a left point farther than median - reach is sent right as well, and every near pair meets in a shard. Inside a
shard the same goes on to small leaves, where all pairs are measured. A shard returns a forest of its links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse.llm.common import text_rows
from civicpulse.llm.components import beside, components

#: Bits that linked fingerprints may differ in, words of a shingle.
REACH, SHINGLE = 2, 3

#: Points that a tree over the shards is fitted on, at most.
SAMPLE = 16_384

#: Shards that the points are dealt to at once: as many as keep a shard below POINTS, between these two.
LEAST_SHARDS, MOST_SHARDS = 64, 1024
POINTS = 200_000

#: Times that shards above POINTS are dealt again, by trees of their own.
ROUNDS = 3

#: Points of a leaf whose pairs are all measured, and vantage points tried per node.
LEAF, TRIED = 256, 6

#: Rows of an oversized shard that are sent on together.
ROWS = 50_000

#: Shingles whose bits are counted at once.
STEP = 1 << 14

_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def fingerprint(text: str) -> int:
    """The SimHash of a text's word shingles, repeats included: a bit is set if over half of them set it."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    line, at = b" ".join(words), 0
    begins, ends = [], []
    for word in words:
        begins.append(at)
        at += len(word)
        ends.append(at)
        at += 1
    ends = ends[SHINGLE - 1 :] or ends[-1:]
    hashed = xxhash.xxh64_intdigest
    hashes = np.fromiter((hashed(line[a:b], 42) for a, b in zip(begins, ends)), ">u8", len(ends))
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), STEP):
        bits = np.unpackbits(hashes[low : low + STEP].view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``point``, the fingerprint as a signed number, per row; a null text has no words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(points.view(np.int64))], ["doc_id", "point"])

    return text_rows(docs).mapInArrow(hashed, "doc_id long, point long")


def _tree_of(points: np.ndarray, leaf: int, reach: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, median, left, right) over a sample; a child below zero is shard -1 - child.

    Of some vantage points that one is taken whose median cuts best: few points near it, halves alike.
    """
    nodes, shards = [], 0

    def grow(own: np.ndarray) -> int:
        nonlocal shards
        cut = _cut(own, reach) if len(own) > leaf else None
        if cut is None:
            shards += 1
            return -shards
        vantage, median, away = cut
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        nodes[at] = (int(vantage), median, grow(own[away <= median]), grow(own[away > median]))
        return at

    grow(points)
    return nodes


def _cut(points: np.ndarray, reach: int) -> tuple[np.uint64, int, np.ndarray] | None:
    """The best vantage point of some, its median and all distances; None if each leaves a side as large as before."""
    best = None
    for vantage in points[np.linspace(0, len(points) - 1, TRIED).astype(int)]:
        away = np.bitwise_count(points ^ vantage).astype(np.int64)
        counts = np.bincount(away, minlength=66)
        left = np.cumsum(counts)
        both = left - np.concatenate([np.zeros(reach, np.int64), left[:-reach]])
        worst = np.maximum(left, len(points) - left + both)
        median = int(np.argmin(worst))
        if best is None or worst[median] < best[0]:
            best = worst[median], vantage, median, away
    return best[1:] if best[0] <= 0.9 * len(points) else None


def _dealt(points: np.ndarray, nodes: list, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards and the places of the points that go there; a point near a boundary goes to several."""
    waiting = [(0 if nodes else -1, np.arange(len(points)))]
    while waiting:
        at, own = waiting.pop()
        if at < 0:
            if len(own):
                yield -1 - at, own
            continue
        vantage, median, left, right = nodes[at]
        away = np.bitwise_count(points[own] ^ np.uint64(vantage)).astype(np.int64)
        waiting.append((left, own[away <= median]))
        waiting.append((right, own[away > median - reach]))


def _near(points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within reach, each pair once at least; points are distinct."""
    found, waiting = [], [np.arange(len(points))]
    while waiting:
        own = waiting.pop()
        cut = _cut(points[own], reach) if len(own) > LEAF else None
        if cut is not None:
            _, median, away = cut
            waiting += [own[away <= median], own[away > median - reach]]
        elif len(own) > 16 * LEAF:
            found.append(_by_masks(points, own, reach))
        else:
            for low in range(0, len(own), LEAF):
                part = own[low : low + LEAF]
                rows, others = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[own[low:]][None, :]) <= reach)
                pairs = part[rows], own[low:][others]
                ahead = pairs[0] != pairs[1]
                found.append((pairs[0][ahead], pairs[1][ahead]))
    return tuple(np.concatenate(side) if found else np.zeros(0, np.int64) for side in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _by_masks(points: np.ndarray, own: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a part that no vantage point cuts: each fingerprint within reach of a point is looked up."""
    order = own[np.argsort(points[own])]
    ranked, masks = points[order], [0]
    for _ in range(reach):
        masks = list({m ^ (1 << bit) for m in masks for bit in range(64)} | set(masks))
    a, b = [], []
    for mask in masks:
        if mask:
            wanted = ranked ^ np.uint64(mask)
            place = np.minimum(np.searchsorted(ranked, wanted), len(ranked) - 1)
            hit = np.flatnonzero((ranked[place] == wanted) & (ranked < wanted))
            a.append(order[hit])
            b.append(order[place[hit]])
    return np.concatenate(a), np.concatenate(b)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per place the smallest place of its component."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if np.array_equal(low, root):
            return root
        root = low


def _forest(table: pa.Table, reach: int) -> pa.Table:
    """Per point of a shard that has a link, a link to the smallest point it is reached from in the shard."""
    points = np.unique(np.asarray(table.column("point")))
    root = _roots(len(points), *_near(points.view(np.uint64), reach))
    linked = np.flatnonzero(root != np.arange(len(points)))
    return pa.table({"a": points[linked], "b": points[root[linked]]})


def _sent(nodes: list, reach: int, shard_of: int) -> Callable[[pa.RecordBatch | pa.Table], pa.Table]:
    """Points of a shard to points and the shards they go to; a tree has at most as many as it was fitted on points."""

    def send(batch: pa.RecordBatch | pa.Table) -> pa.Table:
        points = np.asarray(batch.column("point"))
        parts = [(shard, points[own]) for shard, own in _dealt(points.view(np.uint64), nodes, reach)]
        shards = [np.full(len(own), shard_of * 2 * SAMPLE + shard, np.int64) for shard, own in parts]
        empty = [np.zeros(0, np.int64)]
        return pa.table({"shard": np.concatenate(shards or empty), "point": np.concatenate([p for _, p in parts] or empty)})

    return send


def _shards(points: DataFrame, n: int, reach: int) -> DataFrame:
    """``shard`` and ``point``: pairs within reach share a shard; a shard holds POINTS or so where the points allow it."""
    wanted = min(max(LEAST_SHARDS, n // POINTS), MOST_SHARDS)
    sample = points.orderBy(F.xxhash64("point")).limit(SAMPLE).toArrow().column("point").to_numpy().view(np.uint64)
    nodes = _tree_of(sample, max(1, len(sample) // wanted), reach)
    send = _sent(nodes, reach, 0)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from send(batch).to_batches()

    done, rest = None, points.mapInArrow(first, "shard long, point long").checkpoint()
    for _ in range(ROUNDS):
        sizes = rest.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > POINTS).checkpoint()
        if sizes.isEmpty():
            break
        small = rest.join(sizes.select("shard"), "shard", "left_anti")
        done = small if done is None else done.union(small)
        rest = _again(rest, sizes, reach).checkpoint()
    return rest if done is None else done.union(rest)


def _again(points: DataFrame, sizes: DataFrame, reach: int) -> DataFrame:
    """The points of the shards of ``sizes`` in shards by a tree for each, from at most SAMPLE of its points."""
    large = points.join(sizes, "shard").withColumn("salt", F.pmod(F.xxhash64("point"), F.ceil(F.col("n") / ROWS).cast("long")))

    def fitted(table: pa.Table) -> pa.Table:
        nodes = _tree_of(np.sort(np.asarray(table.column("point"))).view(np.uint64), max(1, SAMPLE // MOST_SHARDS), reach)
        shard = table.column("shard")[0].as_py()
        flat = [[v - (1 << 64) if v >= 1 << 63 else v for node in nodes for v in node]]
        return pa.table({"shard": [shard], "n": table.column("n")[:1], "nodes": pa.array(flat, pa.list_(pa.int64()))})

    # A share of the points, by their hash, that is SAMPLE of them on average.
    share = F.pmod(F.xxhash64(F.lit(7), F.col("point")), F.lit(1 << 30)) < SAMPLE * float(1 << 30) / F.col("n")
    trees = large.where(share).select("shard", "n", "point").groupBy("shard").applyInArrow(fitted, "shard long, n long, nodes array<long>")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / ROWS).cast("long") - 1))
    trees = trees.select("shard", salts.alias("salt"), "nodes")

    def send(key: tuple, own: pa.Table, tree: pa.Table) -> pa.Table:
        flat = tree.column("nodes")[0].as_py() if len(tree) else []
        nodes = [(flat[i] % (1 << 64), *flat[i + 1 : i + 4]) for i in range(0, len(flat), 4)]
        return _sent(nodes, reach, key[0].as_py())(own)

    both = large.select("shard", "salt", "point").groupBy("shard", "salt").cogroup(trees.groupBy("shard", "salt"))
    return both.applyInArrow(send, "shard long, point long")


def near_duplicates(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` per row of ``docs``.

    Fingerprints within ``reach`` differing bits are linked; a component is what links reach, and is named by its
    smallest doc_id, nulls aside (null if there is no other). Rows without words have fingerprint zero, and are
    linked by it like any other. Texts of fewer words than a shingle are one shingle. Repeated rows are rows of
    their own. No rows give no rows.
    """
    marked = fingerprints(docs).checkpoint()
    points = marked.groupBy("point").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")).checkpoint()
    n = points.count()

    def forest(table: pa.Table) -> pa.Table:
        return _forest(table, reach)

    links = _shards(points.select("point"), n, reach).groupBy("shard").applyInArrow(forest, "a long, b long")
    roots = components(links)
    rooted = points.join(roots.withColumnRenamed("vertex", "point"), "point", "left")
    rooted = rooted.select("point", "low", "rows", F.coalesce("root", "point").alias("root")).checkpoint()
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = beside(rooted.drop("low"), named, "root").select("point", "component_id")
    found = beside(marked, named, "point")
    digits = F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", digits, "component_id")


def _hash_sql() -> str:
    """``hashed(s, hash)`` for DuckDB: XXH64 with seed 42 of the texts of ``shingle(s)``, in whole numbers modulo 2^64."""
    primes = [11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261]
    one, two, three, four, five = primes
    size, seed, used = 2**64, 42, count()

    def whole(number: int) -> str:
        return f"{number}::UHUGEINT"

    def plus(*parts: str) -> str:
        return f"(({' + '.join(parts)}) % {whole(size)})"

    def times(value: str, factor: int) -> str:
        return f"(({value}) * {whole(factor)} % {whole(size)})"

    def turned(value: str, bits: int) -> str:
        x = f"x{next(used)}"  # the value is named, as it is used twice
        return f"list_transform([{value}], lambda {x}: ({x} * {whole(2**bits)} % {whole(size)} + ({x} >> {64 - bits})))[1]"

    def taken_in(sum_: str, lane: str) -> str:
        return times(turned(plus(sum_, times(lane, two)), 31), one)

    def lanes(number: str, place: Callable[[str], str], width: int) -> str:
        k = f"k{next(used)}"
        value = " + ".join(f"b[{place(k)} + {j + 1}] * {whole(256**j)}" for j in range(width))
        return f"list_transform(range({number}), lambda {k}: ({value}))"

    def folded(start: str, values: str, step: Callable[[str, str], str]) -> str:
        a, v = f"a{next(used)}", f"v{next(used)}"
        return f"list_reduce(list_prepend({start}, {values}), lambda {a}, {v}: {step(a, v)})"

    starts = [(seed + one + two) % size, (seed + two) % size, seed, (seed - one) % size]
    sums = [folded(whole(v), lanes("n // 32", lambda k, j=j: f"32 * {k} + {8 * j}", 8), taken_in) for j, v in enumerate(starts)]
    long = plus(*(turned(f"s{j}", bits) for j, bits in enumerate((1, 7, 12, 18))))
    for j in range(4):
        long = plus(times(f"xor({long}, {taken_in(whole(0), f's{j}')})", one), whole(four))
    begin = plus(f"CASE WHEN n >= 32 THEN {long} ELSE {whole((seed + five) % size)} END", "n::UHUGEINT")
    eights = folded("h0", lanes("(n - r0) // 8", lambda k: f"r0 + 8 * {k}", 8), lambda a, v: plus(times(turned(f"xor({a}, {taken_in(whole(0), v)})", 27), one), whole(four)))
    fours = folded("h1", lanes("(n - r1) // 4", lambda k: f"r1 + 4 * {k}", 4), lambda a, v: plus(times(turned(f"xor({a}, {times(v, one)})", 23), two), whole(three)))
    ones = folded("h2", "list_slice(b, r2 + 1, n)", lambda a, v: times(turned(f"xor({a}, {times(v, five)})", 11), one))
    each = ", ".join(f"CASE WHEN n >= 32 THEN {s} END AS s{j}" for j, s in enumerate(sums))
    return f"""
  bytes AS (SELECT s, n, list_transform(range(n), lambda k: ('0x' || h[2 * k + 1:2 * k + 2])::UHUGEINT) AS b
    FROM (SELECT s, hex(s) AS h, strlen(s) AS n FROM shingle)),
  stripes AS (SELECT *, {each} FROM bytes),
  begun AS (SELECT *, {begin} AS h0, n // 32 * 32 AS r0 FROM stripes),
  by_eight AS (SELECT *, {eights} AS h1, r0 + (n - r0) // 8 * 8 AS r1 FROM begun),
  by_four AS (SELECT *, {fours} AS h2, r1 + (n - r1) // 4 * 4 AS r2 FROM by_eight),
  by_one AS (SELECT *, {ones} AS h3 FROM by_four),
  hashed AS MATERIALIZED (SELECT s, xor(h5, h5 >> 32)::UBIGINT AS hash
    FROM (SELECT s, {times("xor(h4, h4 >> 29)", three)} AS h5 FROM (SELECT s, {times("xor(h3, h3 >> 33)", two)} AS h4 FROM by_one)))"""


def near_duplicates_sql() -> str:
    """The columns of the registered query for DuckDB, over the view ``documents``: all pairs of distinct fingerprints."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
  every AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(words) - {SHINGLE - 2}, least(len(words), 1) + 1)),
      lambda p: array_to_string(words[p:p + {SHINGLE - 1}], ' '))) AS s FROM w),
  counted AS MATERIALIZED (SELECT doc_id, s, count(*) AS n FROM every GROUP BY ALL),
  shingle AS (SELECT DISTINCT s FROM counted),{_hash_sql()},
  sums AS (SELECT doc_id, sum(n) AS n, {", ".join(f"sum(n) FILTER (hash >> {i} & 1 = 1) AS b{i}" for i in range(64))}
    FROM counted JOIN hashed USING (s) GROUP BY doc_id),
  marked AS MATERIALIZED (SELECT doc_id, {" + ".join(f"(2 * coalesce(b{i}, 0) > coalesce(n, 0))::UBIGINT * {2**i}::UBIGINT" for i in range(64))} AS point
    FROM documents LEFT JOIN sums USING (doc_id)),
  points AS MATERIALIZED (SELECT point, min(doc_id) AS low FROM marked GROUP BY point),
  links AS MATERIALIZED (SELECT a.point AS a, b.point AS b FROM points a, points b WHERE a.point <> b.point AND bit_count(xor(a.point, b.point)) <= {REACH}),
  reached(point, other) AS (SELECT point, point FROM points UNION SELECT point, b FROM reached JOIN links ON other = a),
  lowest AS (SELECT r.point, min(low) AS component_id FROM reached r JOIN points p ON p.point = r.other GROUP BY r.point)
SELECT doc_id, lpad(lower(to_hex(point)), 16, '0') AS fingerprint, component_id FROM marked JOIN lowest USING (point)"""
