"""Removal of repeated passages by prefix-partitioned suffix trees over words.

Suffixes are grouped by variable-length prefixes that end in an anchor. Neighbours with one anchor travel as one
stretch of text, so a task that gets a group has the words themselves: it numbers them exactly, sorts the suffixes
as words, and finds the internal nodes of its subtrees from what neighbours have in common. Hashes only choose
which suffixes can have a partner and where they go; two different words are never taken for one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse.llm.common import Words, chunks, groups_of, keyed_rows
from civicpulse.sources.blocks import in_blocks

#: Words of a window; a subtree's internal nodes of this depth are repeats.
WINDOW = 35
#: Words of an anchor, by which the prefixes of suffixes are chosen.
ANCHOR = 12
#: A group whose anchor occurs more often than this is cut by longer prefixes: by whole windows.
GROUP = 1_000
#: Runs of windows that a task holds before it sends them to their parts.
RUNS = 1 << 18

_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def windows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of a chunk, and the hashes of their words."""
    return words.grams(WINDOW)


def anchors(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window the smallest hash of ANCHOR words inside it and how far in the first such is.

    Equal windows have equal anchors at equal places. Also all hashes of ANCHOR words, sorted.
    """
    spot, grams = words.grams(ANCHOR)
    value = np.full(len(words.hash), _LAST)
    value[spot] = grams
    reach, low = 1, value
    while reach * 2 <= WINDOW - ANCHOR + 1:
        low = np.minimum(low, np.append(low[reach:], np.full(min(reach, len(low)), _LAST)))
        reach *= 2
    rest = WINDOW - ANCHOR + 1 - reach
    smallest = np.minimum(low[at], low[at + rest])
    # The first occurrence: how many places ahead the next equal value is.
    inside = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    for step in range(WINDOW - ANCHOR + 1):
        open_ = open_[value[at[open_] + step] != smallest[open_]]
        inside[open_] += 1
    return smallest, inside, np.sort(grams)


def _dealt(names: list[str], part: int, bucket: np.ndarray, values: list[np.ndarray]) -> pa.Table:
    """One row per bucket: bucket, part, and the bucket's values as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(bucket))
    columns = []
    for v in values:
        v = v[order]
        columns.append(pa.array([v[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()))
    return pa.Table.from_arrays(
        [pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(len(starts), part, np.int32)), *columns], names
    )


def _joined(tables: list[pa.Table], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *tables]).combine_chunks()


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in text.split(", "))])


ANCHORS = "bucket int, part int, anchors binary, counts binary"
FREQUENT = "part int, anchors binary, totals binary"
SUFFIXES = "prefix long, single boolean, part int, start long, text binary"
REPEATS = "part int, runs binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _part_chunks(table: pa.Table) -> Iterator[Words]:
    """The words of a part, in chunks, in an order that only its rows' contents decide."""
    ordered = table.take(pc.sort_indices(table, [(c, "ascending") for c in ("key", "doc_id", "text")]))
    for texts in chunks(iter(ordered.combine_chunks().to_batches())):
        words = texts.words()
        words.columns, words.raw, words.bounds = texts.columns, texts.data, texts.bounds
        yield words


def _part_anchors(buckets: int):
    def found(table: pa.Table) -> pa.Table:
        part, out = table.column("part")[0].as_py(), []
        for words in _part_chunks(table):
            smallest, _, all_grams = anchors(words, windows(words)[0])
            value = np.unique(smallest)
            # Occurrences that are no window's anchor may count too: they only let more through.
            times = np.searchsorted(all_grams, value, "right") - np.searchsorted(all_grams, value)
            bucket = (value % np.uint64(buckets)).astype(np.int64)
            out.append(_dealt(["bucket", "part", "anchors", "counts"], part, bucket, [value, times.astype("<u4")]))
        return _joined(out, _schema(ANCHORS))

    return found


def _column(batch: pa.RecordBatch, name: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of bytes, and the row each is from."""
    raw = batch.column(name).to_pylist()
    sizes = np.array([len(r) for r in raw], np.int64) // np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(raw), dtype), np.repeat(np.arange(len(raw)), sizes)


def _per_part(batch: pa.RecordBatch, row: np.ndarray, values: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """A row for each row of the batch that has values left."""
    ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
    some = np.flatnonzero(np.diff(ends))
    columns = [pa.array([v[ends[i] : ends[i + 1]].tobytes() for i in some], pa.binary()) for v in values]
    return pa.RecordBatch.from_arrays([batch.column("part").take(pa.array(some)), *columns], names)


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors that occur twice or more in the corpus, back to the parts that have them."""
    for batch in groups_of("bucket", batches):
        value, row = _column(batch, "anchors", "<u8")
        times, _ = _column(batch, "counts", "<u4")
        _, code = np.unique(value, return_inverse=True)
        total = np.bincount(code, weights=times)[code].astype(np.int64) if len(value) else np.zeros(0, np.int64)
        keep = total > 1
        yield _per_part(batch, row[keep], [value[keep], np.minimum(total[keep], 2**32 - 1).astype("<u4")], ["part", "anchors", "totals"])


def _stretches(words: Words, known: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows whose anchor recurs: prefix, whether it is a whole window, first window and their number.

    A run's windows have one anchor at one place; where the anchor is very frequent, a run is one window.
    """
    at, window = windows(words)
    smallest, inside, _ = anchors(words, at)
    spot = np.minimum(np.searchsorted(known, smallest), len(known) - 1)
    keep = known[spot] == smallest
    at, window, smallest, place, single = at[keep], window[keep], smallest[keep], (at + inside)[keep], totals[spot[keep]] > GROUP
    begins = np.ones(len(at), bool)
    begins[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1) | single[1:]
    first = np.flatnonzero(begins)
    return np.where(single, window, smallest)[first], single[first], at[first], np.diff(np.append(first, len(at)))


def _packed(runs: list[tuple[int, int]]) -> bytes:
    """Runs of windows, first and number each."""
    return np.array(runs, "<i8").tobytes()


def _part_suffixes(table: pa.Table, frequent: pa.Table) -> pa.Table:
    """The suffixes of a part whose anchor recurs, each in the group of its prefix, as stretches of text.

    A stretch that the part holds several times is sent once; that its windows are repeats is known then,
    and goes along as a row without a text of its own, with the runs in its place (start is -1).
    """
    if not table.num_rows or not frequent.num_rows:
        return _schema(SUFFIXES).empty_table()
    part = table.column("part")[0].as_py()
    known = np.frombuffer(b"".join(frequent.column("anchors").to_pylist()), "<u8")
    totals = np.frombuffer(b"".join(frequent.column("totals").to_pylist()), "<u4")
    order = np.argsort(known)
    known, totals = known[order], totals[order]
    sent: dict[bytes, list] = {}
    own: list[tuple[int, int]] = []
    before = 0
    for words in _part_chunks(table):
        prefix, single, first, number = _stretches(words, known, totals)
        raw = words.raw.tobytes()
        begin, end = words.begin[first], words.end[first + number + WINDOW - 2]
        columns = (c.tolist() for c in (prefix.view(np.int64), single, first + before, number, begin, end))
        for name, alone, start, count, a, b in zip(*columns):
            text = raw[a:b]
            row = sent.setdefault(text, [name, alone, start, 0])
            if row[3] == 1:
                own.append((row[2], count))
            if row[3]:
                own.append((start, count))
            row[3] += 1
        before += len(words.hash)
    rows = [(name, alone, part, start, text) for text, (name, alone, start, _) in sent.items()]
    if own:
        rows.append((part, True, part, -1, _packed(own)))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _schema(SUFFIXES))], schema=_schema(SUFFIXES)) if rows else _schema(SUFFIXES).empty_table()


def deep_nodes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For stretches of words: the stretch and place of each suffix, and whether a node of window depth is above it.

    The words are numbered, so equal numbers are equal words. Sorted, the suffixes are in the order of a walk
    through their trees: the words that neighbours have in common are the depth of the node between them.
    """
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    number = pa.array([w for own in split for w in own], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(">i4")
    each = np.maximum(sizes - WINDOW + 1, 0)
    row = np.repeat(np.arange(len(texts)), each)
    place = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    suffix = np.ascontiguousarray(number[((np.cumsum(sizes) - sizes)[row] + place)[:, None] + np.arange(WINDOW)])
    order = np.argsort(suffix.view(f"S{4 * WINDOW}").ravel()) if len(row) else row
    differs = suffix[order][1:] != suffix[order][:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), WINDOW)
    deep = common >= WINDOW
    below = np.zeros(len(row), bool)
    below[order[1:]] |= deep
    below[order[:-1]] |= deep
    return row, place, below


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows below deep nodes, as runs for the parts that have them, from rows sorted by single and prefix.

    Runs of all groups of a task are held together, so a part gets one row from it, however many groups it has there.
    """
    held, size = [], 0
    for found in _repeated(batches):
        held.append(found)
        size += len(found[0])
        if size >= RUNS:
            yield _replies(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield _replies(*map(np.concatenate, zip(*held)))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows below deep nodes: part, first window and their number."""
    for (single,), own in in_blocks(batches, "single"):
        if single:
            yield from _equal_windows(own)
            continue
        for batch in groups_of("prefix", own):
            row, place, below = deep_nodes(batch.column("text").to_pylist())
            row, place = row[below], place[below]
            begins = np.ones(len(row), bool)
            begins[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
            first = np.flatnonzero(begins)
            starts = np.asarray(batch.column("start"))[row[first]] + place[first]
            yield np.asarray(batch.column("part"))[row[first]], starts, np.diff(np.append(first, len(row)))


def _equal_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for groups whose prefix is a whole window, however many parts have it: a leaf is held per text."""
    name, leaves = None, {}
    for batch in batches:
        found = []
        for prefix, part, start, text in zip(*(batch.column(c).to_pylist() for c in ("prefix", "part", "start", "text"))):
            if start < 0:
                first, number = np.frombuffer(text, "<i8").reshape(-1, 2).T
                yield np.full(len(first), part), first, number
                continue
            if prefix != name:
                name, leaves = prefix, {}
            leaf = leaves.setdefault(b" ".join(text.split()), [part, start, False])
            if leaf[:2] != [part, start]:
                found += [(part, start)] if leaf[2] else [(part, start), tuple(leaf[:2])]
                leaf[2] = True
        if found:
            parts, starts = (np.array(c, np.int64) for c in zip(*found))
            yield parts, starts, np.ones(len(parts), np.int64)


def _replies(part: np.ndarray, start: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    """A row per part with its runs."""
    order = np.argsort(part, kind="stable")
    part, runs = part[order], np.stack([start[order], number[order]], axis=1).astype("<i8")
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(part))
    packed = [runs[a:b].tobytes() for a, b in zip(first, ends)]
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(packed, pa.binary())], schema=_schema(REPEATS))


def _without(table: pa.Table, repeats: pa.Table) -> pa.Table:
    """Per document of a part, what is left without the words of repeated windows."""
    runs = np.frombuffer(b"".join(repeats.column("runs").to_pylist()), "<i8").reshape(-1, 2)
    runs = runs[np.argsort(runs[:, 0])]
    out: tuple[list, list, list, list] = ([], [], [], [])
    before = 0
    for words in _part_chunks(table) if table.num_rows else ():
        count = len(words.hash)
        low, high = np.searchsorted(runs[:, 0], [before, before + count])
        change = np.zeros(count + 1, np.int64)
        np.add.at(change, runs[low:high, 0] - before, 1)
        np.add.at(change, runs[low:high, 0] + runs[low:high, 1] - 1 + WINDOW - before, -1)
        before += count
        kept = np.cumsum(change[:-1]) == 0
        raw = words.raw.tobytes()
        removed = np.concatenate([[0], np.cumsum(~kept)])
        for i, doc_id in enumerate(words.columns["doc_id"].to_pylist()):
            a, b = words.first[i], words.first[i + 1]
            own = raw[words.bounds[i] : words.bounds[i + 1]].split()
            gone = int(removed[b] - removed[a])
            left = b" ".join(compress(own, kept[a:b].tolist()) if gone else own)
            for column, value in zip(out, (doc_id, int(b - a), gone, hashlib.sha256(left).hexdigest())):
                column.append(value)
    schema = _schema(RESULT)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, and the SHA-256 of the kept words, joined by spaces.

    Words are runs of anything but space and tab to carriage return. Removed is each word that lies
    in a window of WINDOW words whose sequence also starts somewhere else in the corpus, the same
    document included. Null, empty and short texts lose nothing; repeated rows repeat each other,
    and each keeps a row; an empty table gives an empty one.

    Documents are dealt to parts once; all passes read that exchange. The first pass counts anchors,
    the smallest hashes of ANCHOR words in each window, since only a suffix whose anchor recurs can
    have a deep node above it. Those suffixes are grouped by variable-length prefixes, up to and
    with the anchor, or the whole window where the anchor is very frequent, and travel as text.
    Each group's suffixes are sorted as words, and the windows below nodes of window depth go back to
    the parts by their places. A part sends a stretch of words once however often it holds it, and
    a group by whole windows is a stream, so no window is gathered however many documents have it.
    """
    spark = docs.sparkSession
    rows = keyed_rows(docs)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    # A part is read into memory: a quarter of what one task scans. A task has several parts, one after the other,
    # so that the three passes sort, and the result is written, in as many tasks as there are buckets.
    parts = 4 * buckets
    part = F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int").alias("part")
    dealt = rows.select(part, "doc_id", "key", "text").repartition(buckets, "part")
    by_part = dealt.groupBy("part")

    def in_buckets(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "bucket").sortWithinPartitions("bucket")

    frequent = in_buckets(by_part.applyInArrow(_part_anchors(buckets), ANCHORS)).mapInArrow(_recurring, FREQUENT)
    suffixes = by_part.cogroup(frequent.groupBy("part")).applyInArrow(_part_suffixes, SUFFIXES)
    grouped = suffixes.repartition(buckets, "prefix").sortWithinPartitions("single", "prefix")
    repeats = grouped.mapInArrow(_subtrees, REPEATS)
    return by_part.cogroup(repeats.groupBy("part")).applyInArrow(_without, RESULT)


#: The same for DuckDB, over the view ``documents``: every window written out and counted.
REPEATS_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
  windows AS (SELECT doc_id, pos, array_to_string(words[pos:pos + {WINDOW - 1}], ' ') AS s FROM (SELECT *, unnest(range(1, len(words) - {WINDOW - 2})) AS pos FROM w)),
  repeated AS (SELECT doc_id, pos FROM windows QUALIFY count(*) OVER (PARTITION BY s) > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {WINDOW})) AS pos FROM repeated),
  left_over AS (SELECT doc_id, pos, words[pos] AS word FROM (SELECT *, unnest(range(1, len(words) + 1)) AS pos FROM w) ANTI JOIN gone USING (doc_id, pos)),
  kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM left_over GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""
