"""Packing of token sequences by linear grouping, few-size configurations and best fit."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from civicpulse.llm.common import text_rows

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"
#: Lengths above this share of the capacity are large.
LARGE = 1 / 4
#: Groups of equal cardinality that the large lengths are rounded up in.
GROUPS = 1024

#: Runs without white space from this length on go to the library whose time stays linear in them.
_LONG_RUN = re.compile(r"\S{400}")
_BLANK_RUN = re.compile(r"\s{400}")


@cache
def _encoders():
    """Two libraries over the same vocabulary: the contract's, and a faster one with equal ids."""
    slow = Tokenizer.from_file(public_tokenizers.path(f"{VOCABULARY}.json"))
    with open(public_tokenizers.path(f"{VOCABULARY}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items() if t.special}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return slow, fast


def token_ids(text: str) -> np.ndarray:
    """Ids of a text, special strings included as the library reads them, then id 0."""
    slow, fast = _encoders()
    if _LONG_RUN.search(text) or _BLANK_RUN.search(text):
        ids = slow.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode(text, allowed_special="all")
    return np.array([*ids, 0], "<u4")


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece; a longer document's first piece takes the remainder."""
    if total <= capacity:
        return [(0, total)]
    starts = ([0] if total % capacity else []) + list(range(total % capacity, total, capacity))
    return list(zip(starts, np.diff([*starts, total]).tolist()))


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; a null text is empty."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = token_ids(text.as_py())
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    crc = zlib.crc32(ids[start : start + length])
                    for column, value in zip(rows, (doc_id, piece, start, length, crc)):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names)

    return text_rows(docs).mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Where the pieces of each length go, from the number of pieces of each length alone.

    A segment says: of the pieces of one length, those ranked from ``rank`` on, ``count`` in all,
    go to the sequences from ``bin`` on, ``per`` to each, side by side from ``offset``. The plan's
    size is bounded by the capacity, not by the number of pieces.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS):
        self.capacity = capacity
        self.segments: list[tuple[int, int, int, int, int, int]] = []
        self.bins = 0
        self._rank = dict.fromkeys(counts, 0)
        #: Ranges of sequences (first, number) by the room that is left in each.
        self._room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        large = {n: c for n, c in counts.items() if n > capacity * LARGE}
        self._place_large(large, groups)
        for length in sorted((n for n in counts if n not in large), reverse=True):
            self._place_small(length, counts[length])

    def _segment(self, length: int, count: int, first: int, per: int, offset: int) -> None:
        self.segments.append((length, self._rank[length], count, first, per, offset))
        self._rank[length] += count

    def _place_large(self, large: dict[int, int], groups: int) -> None:
        queues = grouped(large, groups)
        sizes = [max(n for n, _ in q) for q in queues]
        for picked, times in configurations(sizes, [sum(c for _, c in q) for q in queues], self.capacity):
            # Substitute actual pieces: each slot takes the group's next ones, longest first.
            slots = [_take(queues[g], times) for g in picked]
            at = 0
            while at < times:
                step = min(s[0][1] for s in slots)
                offset = 0
                for slot in slots:
                    length, left = slot[0]
                    self._segment(length, step, self.bins + at, 1, offset)
                    offset += length
                    slot[0] = (length, left - step)
                    if left == step:
                        slot.pop(0)
                self._room[self.capacity - offset].append((self.bins + at, step))
                at += step
            self.bins += times

    def _place_small(self, length: int, left: int) -> None:
        """Best fit: each piece goes to a sequence with the least room that takes it."""
        room = length
        while left:
            while room <= self.capacity and not self._room[room]:
                room += 1
            if room > self.capacity:
                room, opened = self.capacity, -(-left // (self.capacity // length))
                self._room[room].append((self.bins, opened))
                self.bins += opened
            first, number = self._room[room].pop()
            per = min(left, room // length)
            used = min(number, left // per)
            self._segment(length, used * per, first, per, self.capacity - room)
            left -= used * per
            self._room[room - per * length].append((first, used))
            if number > used:
                self._room[room].append((first + used, number - used))
            room = length


def grouped(large: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count), longest first, of groups that hold equally many pieces."""
    total, out, queue, room = sum(large.values()), [], [], 0
    per = max(1, -(-total // groups))
    room = per
    for length in sorted(large, reverse=True):
        left = large[length]
        while left:
            take = min(left, room)
            queue.append((length, take))
            left, room = left - take, room - take
            if not room:
                out.append(queue)
                queue, room = [], per
    return out + ([queue] if queue else [])


def configurations(sizes: list[int], demand: list[int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """Sets of groups that share a sequence, and how often each set is used, until demand is met.

    The largest size still in demand is taken, and joined by those that fill the rest of the
    sequence best; among equal fillings larger sizes win. The set is used as often as demand allows.
    """
    demand = list(demand)
    while any(demand):
        head = next(g for g in range(len(sizes)) if demand[g])
        picked = [head, *_filling(sizes, [d - (g == head) for g, d in enumerate(demand)], capacity - sizes[head])]
        times = min(demand[g] // picked.count(g) for g in set(picked))
        yield picked, times
        for g in picked:
            demand[g] -= times


def _filling(sizes: list[int], demand: list[int], room: int) -> list[int]:
    """Groups, each at most as often as demanded, whose sizes add up to the most within ``room``."""
    reached, items = [1], []
    for g, (size, left) in enumerate(zip(sizes, demand)):
        for _ in range(min(left, room // size)):
            more = reached[-1] | (reached[-1] << size & (1 << room + 1) - 1)
            if more == reached[-1]:
                break
            reached.append(more)
            items.append(g)
    total, out = reached[-1].bit_length() - 1, []
    for i in range(len(items), 0, -1):
        if not reached[i - 1] >> total & 1:
            out.append(items[i - 1])
            total -= sizes[items[i - 1]]
    return out[::-1]


def _take(queue: list[tuple[int, int]], number: int) -> list[tuple[int, int]]:
    out = []
    while number:
        length, left = queue.pop(0)
        used = min(left, number)
        out.append((length, used))
        number -= used
        if left > used:
            queue.insert(0, (length, left - used))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Every piece with its sequence_id and offset.

    The driver sees the number of pieces per length only, at most ``capacity`` rows. Pieces are
    ranked within their length in two steps, so no length is gathered in one task. Every row is
    packed: a null or empty text is one piece of length 1, repeated rows are packed each, and an
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    cut_up = pieces(docs, capacity).checkpoint().withColumn("row", F.monotonically_increasing_id())
    counts = {r.length: r.n for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(counts, capacity, groups)
    columns = [list(c) for c in zip(*plan.segments)] or [[]] * 6
    names = ["length", "rank_from", "number", "first", "per", "base"]
    segments = spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)}))

    buckets = max(16, -(-sum(counts.values()) // 20_000))
    cut_up = cut_up.withColumn("bucket", F.pmod(F.hash("row"), F.lit(buckets)))
    sizes = cut_up.groupBy("length", "bucket").agg(F.count("*").alias("size"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = (
        cut_up.withColumn("n", F.row_number().over(within) - 1)
        .join(sizes, ["length", "bucket"])
        .withColumn("rank", F.col("earlier") + F.col("n"))
    )
    at = F.col("rank") - F.col("rank_from")
    return (
        ranked.join(F.broadcast(segments), "length")
        .where((at >= 0) & (at < F.col("number")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first") + F.floor(at / F.col("per"))).cast("long").alias("sequence_id"),
            (F.col("base") + at % F.col("per") * F.col("length")).cast("long").alias("offset"),
        )
    )
