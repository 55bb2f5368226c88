"""Documents alike in their word shingles: a chosen-path join, exact verification, and classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse.llm.common import Words, chunks, fresh, groups_of, keyed_rows, mixed, signed
from civicpulse.llm.components import beside, components, narrowed

WORDS = 5
#: Similarity from which documents are linked, as a fraction: 4 / 5.
SIMILAR = (4, 5)
#: Sampled tokens per set: the smallest of its shingles under so many orders.
SAMPLES = 64
#: Chance that a linked pair meets in a bucket.
RECALL = 0.999999
#: Sets of a bucket that are compared with each other; a larger one is split.
BUCKET = 1000
#: Sets of a block when sets are compared exactly.
BLOCK = 256
#: Splits of a bucket that stays larger; after them it is compared block by block.
DEPTH = 2
#: Paths that a bucket goes on along when it is split.
PATHS = 2
#: Equal samples from which a pair is verified; a linked pair has fewer with a chance of 1e-7.
PROMISING = 33

_FACTORS = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)


def survival(depth: int = DEPTH) -> float:
    """Chance that a pair at the threshold meets in one run, its bucket being split ``depth`` times.

    It agrees in the first token, and at each split in the token of one of PATHS paths.
    """
    alike = SIMILAR[0] / SIMILAR[1]
    return alike * (1 - (1 - alike) ** PATHS) ** depth


def runs(recall: float = RECALL) -> int:
    """Repetitions after which a pair at the threshold has met with the given chance, however large its buckets are."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival()))


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a chunk and their texts, in order; a shorter text is one shingle."""
    at, hashes = words.grams(WORDS)
    owner = words.text[at]
    sizes = np.diff(words.first)
    for n in range(1, WORDS):
        if not (sizes == n).any():
            continue
        spot, short = words.grams(n)
        whole = sizes[words.text[spot]] == n
        owner = np.concatenate([owner, words.text[spot][whole]])
        hashes = np.concatenate([hashes, short[whole]])
    order = np.argsort(owner, kind="stable")
    return hashes[order], owner[order]


def shingle_sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and their texts."""
    hashes, owner = shingles(words)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: a hash of its set of shingles, the set's size and samples; 0 for no words."""
    for texts in chunks(batches):
        hashes, owner = shingle_sets(texts.words())
        n = len(texts)
        size = np.bincount(owner, minlength=n)
        some = np.flatnonzero(size)
        starts = np.concatenate([[0], np.cumsum(size[some])])[:-1].astype(np.int64)
        samples = np.zeros((n, SAMPLES), "<u4")
        ids = np.zeros(n, np.uint64)
        if len(some):
            for t in range(SAMPLES):
                lowest = np.minimum.reduceat(hashes * _FACTORS[t], starts)
                samples[some, t] = (mixed(lowest) >> np.uint64(32)).astype(np.uint32)
            ids[some] = mixed(np.add.reduceat(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts) + size[some].astype(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [texts.columns["doc_id"], texts.columns["key"], signed(ids), pa.array(size.astype(np.int32)),
             pa.array([s.tobytes() for s in samples], pa.binary())],
            ["doc_id", "key", "set_id", "size", "samples"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(v, "<u4") for v in column.to_pylist()], np.uint32).reshape(-1, SAMPLES)


def _split(count: int):
    """From rows with samples to buckets: the first token of each run, or the next of a bucket's path.

    A bucket's path hash decides which samples split it, one per path.
    """
    def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples, ids = _matrix(batch.column("samples")), np.asarray(batch.column("set_id"))
            if "bucket" not in batch.schema.names:
                paths = [(np.full(len(ids), run, np.uint64), np.full(len(ids), run)) for run in range(count)]
            else:
                path = mixed(np.asarray(batch.column("bucket")).view(np.uint64))
                step = path // np.uint64(SAMPLES) % np.uint64(SAMPLES - 1) + np.uint64(1)
                paths = [(path ^ np.uint64(i), ((path + np.uint64(i) * step) % np.uint64(SAMPLES)).astype(np.int64)) for i in range(PATHS)]
            for path, token in paths:
                value = samples[np.arange(len(ids)), token].astype(np.uint64)
                bucket = mixed(mixed(path + np.uint64(0x2545F491)) + value)
                yield pa.RecordBatch.from_arrays([signed(bucket), pa.array(ids)], ["bucket", "set_id"])

    return divided


def roots_of(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component among 0 .. count - 1, for links a - b."""
    root = np.arange(count)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brute force within buckets, on samples; what is alike is joined by as few links as do.

    Where two blocks of a bucket meet, each block's own links come from its other task, so only
    links between what each block joins by itself are given.
    """
    for batch in groups_of("bucket", batches):
        bucket, ids = np.asarray(batch.column("bucket")), np.asarray(batch.column("set_id"))
        samples, side = _matrix(batch.column("samples")), np.asarray(batch.column("side"))
        start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        size = np.diff(np.append(start, len(bucket)))
        #: Partners of each row: those after it in its bucket.
        after = np.repeat(start + size, size) - np.arange(len(bucket)) - 1
        links: list[tuple[np.ndarray, np.ndarray]] = []
        total = np.concatenate([[0], np.cumsum(after)])
        low = 0
        while low < len(bucket):
            high = max(low + 1, int(np.searchsorted(total, total[low] + 200_000, "right")) - 1)
            left = np.repeat(np.arange(low, high), after[low:high])
            right = left + 1 + np.arange(len(left)) - np.repeat(total[low:high] - total[low], after[low:high])
            alike = (samples[left] == samples[right]).sum(1) >= PROMISING if len(left) else np.zeros(0, bool)
            links.append((left[alike], right[alike]))
            low = high
        left, right = (np.concatenate([link[i] for link in links]) for i in (0, 1))
        mixed_sides = np.maximum.reduceat(side, start) != np.minimum.reduceat(side, start)
        same = side[left] == side[right]
        apart = np.repeat(mixed_sides, size)
        within = roots_of(len(bucket), left[same], right[same])
        root = roots_of(len(bucket), left, right)
        linked = (root != np.arange(len(root))) & (~apart | (within == np.arange(len(root))))
        yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[root[linked]])], ["a", "b"])


def _candidates(sets: DataFrame, recall: float) -> DataFrame:
    """Links a, b that join all sets which may be alike; transitive, not all pairs."""
    buckets = sets.mapInArrow(_split(runs(recall)), "bucket long, set_id long")
    links, samples = None, sets.select("set_id", "samples")
    for depth in range(DEPTH + 1):
        sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        shared = buckets.join(sizes, "bucket")
        small = shared.where(F.col("n") <= BUCKET).select("bucket", F.lit(0).alias("side"), "set_id") if depth < DEPTH else _blocked(shared)
        # In order of sets, so that the buckets of one group give links to the same few smallest sets.
        dealt = small.join(samples, "set_id").repartition("bucket").sortWithinPartitions("bucket", "set_id")
        found = dealt.mapInArrow(_promising, "a long, b long")
        links = found if links is None else links.union(found)
        if depth < DEPTH:
            large = shared.where(F.col("n") > BUCKET).select("bucket", "set_id").checkpoint()
            count = large.count()
            if not count:
                break
            large = narrowed(large, count)
            buckets = large.join(samples, "set_id").mapInArrow(_split(0), "bucket long, set_id long").distinct().checkpoint()
            buckets = narrowed(buckets, count)
    return links


def _blocked(shared: DataFrame) -> DataFrame:
    """Buckets of any size as pairs of blocks of bounded size; a smaller bucket is one block."""
    count = F.ceil(F.col("n") / BUCKET).cast("int")
    own = F.pmod(F.xxhash64("set_id"), count).cast("int")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return shared.withColumn("own", own).select(
        "set_id", F.col("bucket").alias("path"), "own", F.explode(F.sequence(F.lit(0), count - 1)).alias("other")
    ).select(F.xxhash64("path", low, high).alias("bucket"), (F.col("own") == low).cast("int").alias("side"), "set_id")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each document, sorted, as bytes."""
    for texts in chunks(batches):
        hashes, owner = shingle_sets(texts.words())
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        raw = [hashes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        names = ("set_id", "cluster", "n", "copies")
        yield pa.RecordBatch.from_arrays([*(texts.columns[c] for c in names), pa.array(raw, pa.large_binary())], [*names, "shingles"])


def common_shingles(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of ``sets`` shares with each of ``others``."""
    sizes = [len(s) for s in (*sets, *others)]
    value, code = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    used = np.bincount(code, minlength=len(value))
    order = np.cumsum(used > 1) - 1
    keep = used[code] > 1
    code, owner = order[code[keep]], owner[keep]
    by_code = np.argsort(code, kind="stable")
    code, owner = code[by_code], owner[by_code]
    out = np.zeros((len(sets), len(others)), np.int64)
    width = max(1, 8_000_000 // max(1, len(sizes)))
    for low in range(0, int(order[-1]) + 1 if len(order) else 0, width):
        a, b = np.searchsorted(code, [low, low + width])
        present = np.zeros((len(sizes), width), np.float32)
        present[owner[a:b], code[a:b] - low] = 1
        out += (present[: len(sets)] @ present[len(sets) :].T).astype(np.int64)
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links within a pair of blocks: per set how many documents it is linked to here, and a
    few of the links that join the same sets as all of them do."""
    for batch in groups_of("task", batches):
        task = np.asarray(batch.column("task"))
        starts = np.append(np.flatnonzero(np.append(True, task[1:] != task[:-1])), len(task))
        ids_out, links_out, root_out = [], [], []
        for low, high in zip(starts[:-1], starts[1:]):
            part = batch.slice(low, high - low)
            ids, first = np.unique(np.asarray(part.column("set_id")), return_index=True)
            copies = np.asarray(part.column("copies"))[first]
            left = np.asarray(part.column("left"))[first]
            right = np.asarray(part.column("right"))[first]
            sets = [np.frombuffer(part.column("shingles")[int(i)].as_buffer(), np.uint64) for i in first]
            rows, columns = np.flatnonzero(left), np.flatnonzero(right)
            if not len(rows) or not len(columns) or len(ids) < 2:
                continue
            shared = common_shingles([sets[i] for i in rows], [sets[i] for i in columns])
            sizes = np.array([len(s) for s in sets])
            a, b = SIMILAR
            alike = (a + b) * shared >= a * (sizes[rows][:, None] + sizes[columns][None, :])
            alike &= rows[:, None] != columns[None, :]
            count = np.zeros(len(ids), np.int64)
            count[rows] += alike @ copies[columns]
            if not (len(rows) == len(columns) and (rows == columns).all()):
                count[columns] += alike.T @ copies[rows]
            x, y = np.nonzero(alike)
            root = roots_of(len(ids), rows[x], columns[y])
            some = count > 0
            ids_out.append(ids[some])
            links_out.append(count[some])
            root_out.append(ids[root[some]])
        flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([flat(ids_out), flat(links_out), flat(root_out)], ["set_id", "links", "root"])


def _verified(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Exact links between the sets of each cluster, a pair of blocks at a time."""
    chosen = members.select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.key").alias("rep_key"), "set_id", "cluster", "n", "copies")
    sets = (
        rows.join(chosen, rows.doc_id.eqNullSafe(chosen.rep_id) & (rows.key == chosen.rep_key))
        .select("text", "set_id", "cluster", "n", "copies")
        .mapInArrow(_sets, "set_id long, cluster long, n long, copies long, shingles binary")
    )
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("set_id"), count).cast("int")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1))).select(
        F.xxhash64("cluster", low, high).alias("task"), "set_id", "copies",
        (F.col("own") == low).alias("left"), (F.col("own") == high).alias("right"), "shingles",
    )
    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_linked, "set_id long, links long, root long")


def classes(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """Per row: doc_id, key, class_id, n_links, and whether (doc_id, key) is its class's first.

    Words are runs of anything but space and tab to carriage return; a set holds the five-word
    shingles of the whole text, a shorter text is one shingle. Rows of equal sets are one set in
    the join. Linked are two documents of similarity 0.8 or more; n_links counts all others that a
    document is linked to, copies included, and a class is a component of links, named by its
    smallest doc_id. A text without words (null, empty) is linked to nothing and is a class of its
    own; repeated rows are copies of each other; an empty table gives an empty one.

    No pairs are written out: a bucket or block yields a forest that joins what is linked in it,
    and numbers of links. Sets are named by 64-bit hashes.
    """
    rows = keyed_rows(docs)
    sampled = rows.mapInArrow(_sampled, "doc_id long, key long, set_id long, size int, samples binary").checkpoint()
    sets = sampled.where("size > 0").groupBy("set_id", "samples").agg(
        F.min(F.struct("doc_id", "key")).alias("rep"), F.min("doc_id").alias("first"), F.count("*").alias("copies")
    ).checkpoint()
    clusters = components(_candidates(sets, recall))
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"))
    members = beside(clusters, sizes, "root").select(F.col("vertex").alias("set_id"), F.col("root").alias("cluster"), "n").join(
        sets.select("set_id", "rep", "copies"), "set_id"
    )
    exact = _verified(rows, members).checkpoint()
    links = exact.groupBy("set_id").agg(F.sum("links").alias("links"))
    root = components(exact.select(F.col("set_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("vertex", "set_id")
    placed = (
        sets.select("set_id", "rep", "first", "copies").join(root, "set_id", "left").join(links, "set_id", "left")
        .withColumn("root", F.coalesce("root", "set_id")).checkpoint()
    )
    named = placed.groupBy("root").agg(F.min("first").alias("class_id"), F.min("rep").alias("class_rep"))
    by_set = beside(placed, named, "root").select(
        "set_id", "class_id", "class_rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    alone = sampled.where("size = 0").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("is_first"))
    found = sampled.where("size > 0").select("doc_id", "key", "set_id").join(by_set, "set_id").select(
        "doc_id", "key", "class_id", F.col("n_links").cast("long").alias("n_links"),
        F.col("class_rep").eqNullSafe(F.struct("doc_id", "key")).alias("is_first"),
    )
    return found.union(alone)


def one_of_each(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their class; of repeated rows one."""
    of, same = fresh(docs.columns, "_first_id"), fresh(docs.columns, "_first_key")
    first = classes(docs, recall).where("is_first").select(F.col("doc_id").alias(of), F.col("key").alias(same)).distinct()
    key, number = fresh(docs.columns, "key"), fresh(docs.columns, "number")
    named = docs.withColumns({key: F.xxhash64(F.coalesce("text", F.lit(""))), number: F.col("doc_id").cast("long")})
    kept = named.join(first, named[number].eqNullSafe(first[of]) & (named[key] == first[same]), "left_semi")
    return kept.dropDuplicates([number, key]).select(*docs.columns)


#: ``doc_id``, ``class_id`` and ``n_links`` for DuckDB, over the view ``documents``: all pairs that share a shingle.
CLASSES_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
  shingles AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(words[pos:pos + 4], ' '), least(len(words), 5)) AS s
    FROM (SELECT *, unnest(range(1, greatest(len(words) - 3, least(len(words), 1) + 1))) AS pos FROM w)),
  sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * shared.n >= 4 * (x.n + y.n - shared.n)),
  reached(doc_id, other) AS (SELECT a, b FROM links UNION SELECT doc_id, b FROM reached JOIN links ON other = a),
  counts AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a),
  lowest AS (SELECT doc_id, min(other) AS low FROM reached GROUP BY doc_id)
SELECT doc_id, least(doc_id, coalesce(low, doc_id)) AS class_id, coalesce(n, 0) AS n_links
FROM documents LEFT JOIN counts USING (doc_id) LEFT JOIN lowest USING (doc_id)"""
