"""Benchmark passages in documents, found by spaced seeds and verified around each hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse.llm.common import Texts, Words, chunks, folded, keyed_rows, mixed, signed, text_array

#: Fixed masks: 1 compares a token, 0 ignores it. Seven tokens of a span of seven to twelve, such that one of
#: them fits beside any two substitutions in 12 words, three in 15, four in 20 and five in 25. Every overlap
#: holds such a part: one of 26 words or more is two, one of which is equal enough itself.
MASKS = ("11101111", "1111010011", "11010011011", "1111111", "110101001011", "11101000111", "110010010111")
#: Items of fewer words are looked for unchanged.
MASKED_WORDS = max(map(len, MASKS))
#: Items of fewer words say too little to be looked for.
LEAST_WORDS = 5
#: An overlap counts from this many words on (or the whole of a shorter item) ...
OVERLAP_WORDS = 13
#: ... if this share of its words is equal, a fraction: 4 / 5.
EQUAL_SHARE = (4, 5)
#: Weight of a substituted word against an equal one when an overlap is extended.
SUBSTITUTED = 2
#: A factor for each place under a mask.
_FACTORS = mixed(np.arange(977, 977 + max(map(len, MASKS)), dtype=np.uint64)) | np.uint64(1)
#: The filter that training hashes pass before they are joined has so many bits a test hash ...
BITS_A_HASH = 256
#: ... and at most so many.
FILTER_BITS = 1 << 26


def _seeds(words: Words, short: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Positions and hashes under each mask (marked 0), then of whole short items' lengths (marked so)."""
    count = len(words.hash)
    for m, mask in enumerate(MASKS):
        if count < len(mask):
            continue
        places = count - len(mask) + 1
        at = np.flatnonzero(words.text[:places] == words.text[len(mask) - 1 :])
        total = np.full(places, m + 1, np.uint64)
        for step in (i for i, c in enumerate(mask) if c == "1"):
            total += words.hash[step : step + places] * _FACTORS[step]
        yield 0, at, mixed(total[at])
    for n in short:
        at, hashes = words.grams(n)
        yield n, at, mixed(hashes + np.uint64(n * 7919))


def _items(benchmark: DataFrame) -> DataFrame:
    """Each distinct text of an item_id, ``item_key`` naming it: rows without item_id or text are none."""
    return (
        benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
        .select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
        .withColumn("item_key", F.xxhash64("text"))
    )


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in chunks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.diff(folded(texts).words().first).astype(np.int64))], ["n"])


def _item_hashes(short: tuple[int, ...]):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in chunks(batches):
            words = folded(texts).words()
            sizes = np.diff(words.first)
            item, key = np.asarray(texts.columns["item_id"]), np.asarray(texts.columns["item_key"])
            for n, at, hashes in _seeds(words, short):
                owner = words.text[at]
                sought = sizes[owner] == n if n else sizes[owner] >= MASKED_WORDS
                at, hashes, owner = at[sought], hashes[sought], owner[sought]
                yield pa.RecordBatch.from_arrays(
                    [signed(hashes), pa.array(item[owner]), pa.array(key[owner]),
                     pa.array((at - words.first[owner]).astype(np.int64))],
                    ["hash", "item_id", "item_key", "item_at"],
                )

    return hashed


def _bits(hashes: DataFrame) -> np.ndarray:
    """A filter over the test hashes, 64 bits to a number; at most FILTER_BITS, whatever their number."""
    count = hashes.count()
    size = 1 << 16
    while size < BITS_A_HASH * count and size < FILTER_BITS:
        size *= 2
    slot = F.col("hash").bitwiseAND(F.lit(size - 1))
    words = hashes.select(F.floor(slot / 64).alias("word"), F.pmod(slot, F.lit(64)).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[np.asarray(found["word"])] = np.asarray(found["bits"])
    return out.view(np.uint64)


def _hits(bits: np.ndarray, short: tuple[int, ...]):
    mask = np.uint64(64 * len(bits) - 1)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in chunks(batches):
            words = folded(texts).words()
            doc_id, key = texts.columns["doc_id"], texts.columns["key"]
            for _, at, hashes in _seeds(words, short):
                slot = hashes & mask
                hit = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).view(np.int64) > 0
                at, hashes = at[hit], hashes[hit]
                owner = words.text[at]
                yield pa.RecordBatch.from_arrays(
                    [signed(hashes), doc_id.take(pa.array(owner)), key.take(pa.array(owner)),
                     pa.array((at - words.first[owner]).astype(np.int64))],
                    ["hash", "doc_id", "key", "doc_at"],
                )

    return found


def best_overlap(document: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """Start in the document, words and equal words of the best overlap with the item's first word at ``shift``.

    Every stretch counts that is long and equal enough. The best is the one of the highest score if it
    counts, else the one with the most equal words, of these the shortest and earliest; None if none counts.
    """
    least = min(OVERLAP_WORDS, len(item))
    low, high = max(0, -shift), min(len(item), len(document) - shift)
    if high - low < least:
        return None
    equal = document[low + shift : high + shift] == item[low:high]
    total = np.concatenate([[0], np.cumsum(equal)])
    places = np.arange(len(total))
    if total[-1] * EQUAL_SHARE[1] < least * EQUAL_SHARE[0]:
        return None
    # A stretch is equal enough if its surplus, a whole number, isn't below zero.
    surplus = EQUAL_SHARE[1] * total - EQUAL_SHARE[0] * places
    score = (1 + SUBSTITUTED) * total - SUBSTITUTED * places
    lowest = np.minimum.accumulate(score)
    end = int(np.argmax(score - lowest))
    begin = int(np.flatnonzero(score[: end + 1] == lowest[end])[-1])
    if end - begin < least or surplus[end] < surplus[begin]:
        # The last place that isn't below each place has the most equal words; trailing others are cut.
        highest = np.maximum.accumulate(surplus[::-1])[::-1]
        ends = np.searchsorted(-highest, -surplus, "right") - 1
        begins = np.flatnonzero(ends - places >= least)
        if not len(begins):
            return None
        same = total[ends[begins]]
        ends = np.maximum(np.searchsorted(total, same), begins + least)
        chosen = np.lexsort((begins, ends - begins, -(same - total[begins])))[0]
        begin, end = int(begins[chosen]), int(ends[chosen])
    return low + shift + begin, end - begin, int(total[end] - total[begin])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "key", "item_id", "start", "n_words", "n_equal"]
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [], [])
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            document = folded(Texts(one.column("text"), {})).words().hash
            found = one.column("found")[0].as_py()
            items = folded(Texts(text_array([f["item"] for f in found]), {})).words()
            every: dict[int, list] = {}
            for i, candidate in enumerate(found):
                item = items.hash[items.first[i] : items.first[i + 1]]
                overlapping = [o for s in candidate["shifts"] if (o := best_overlap(document, item, s))]
                if overlapping:
                    every.setdefault(candidate["item_id"], []).extend(overlapping)
            for item_id, overlapping in every.items():
                start, words, equal = max(overlapping, key=lambda o: (o[2], -o[1], -o[0]))
                values = (one.column("doc_id")[0].as_py(), one.column("key")[0].as_py(), item_id, start, words, equal)
                for column, value in zip(rows, values):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per contaminated document and item: doc_id, key, item_id, start, n_words, n_equal.

    Words are compared without ASCII case and punctuation. Every whole text is searched; an overlap
    has ``OVERLAP_WORDS`` words or the whole item, of which ``EQUAL_SHARE`` are equal, the rest
    substituted, and any such stretch of any alignment counts; the best one of an item is reported,
    ties to the earliest. Every distinct
    text of an item is searched. Items of 5 to 11 words must occur unchanged, shorter ones aren't
    looked for. Null and empty texts have none,
    repeated rows have rows each, and empty tables give an empty result.

    Training hashes pass a filter of bounded size before they are shuffled to the join, so what
    moves is what matches, and a benchmark of any size goes the same way.
    """
    items = _items(benchmark).where(F.length("text") > 0)
    lengths = items.mapInArrow(_lengths, "n long").where((F.col("n") >= LEAST_WORDS) & (F.col("n") < MASKED_WORDS))
    short = tuple(sorted(r.n for r in lengths.distinct().collect()))
    hashes = items.mapInArrow(_item_hashes(short), "hash long, item_id long, item_key long, item_at long").distinct()
    rows = keyed_rows(docs)
    hits = rows.mapInArrow(_hits(_bits(hashes), short), "hash long, doc_id long, key long, doc_at long")
    aligned = (
        hits.join(hashes, "hash")
        .select("doc_id", "key", "item_id", "item_key", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
        .groupBy("doc_id", "key", "item_id", "item_key").agg(F.collect_set("shift").alias("shifts"))
    )
    found = (
        aligned.join(items.withColumnRenamed("text", "item"), ["item_id", "item_key"])
        .groupBy(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key"))
        .agg(F.collect_list(F.struct("item_id", "item", "shifts")).alias("found"))
    )
    return (
        rows.join(found, rows.doc_id.eqNullSafe(found.found_id) & (rows.key == found.found_key))
        .select("doc_id", "key", "text", "found")
        .mapInArrow(_verified, "doc_id long, key long, item_id long, start long, n_words long, n_equal long")
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark passage."""
    bad = overlaps(docs, benchmark).select(F.col("doc_id").alias("_bad_id"), F.col("key").alias("_bad_key")).distinct()
    match = docs["doc_id"].cast("long").eqNullSafe(bad["_bad_id"]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_bad_key"]
    )
    return docs.join(bad, match, "left_anti")
