"""Token counts per document from piece counts per distinct pre-token."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicpulse.llm.common import Texts, chunks, groups_of, lists, mixed, text_rows

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: Bytes of text and texts whose pre-tokens are counted together before they are shuffled.
BLOCK_BYTES, BLOCK_TEXTS = 8 << 20, 1 << 16
#: A pre-token of more than this share of a block's texts is frequent: its pieces are counted there.
FREQUENT = 1 / 64
_SPACE = "▁"


@cache
def _processor(path: str) -> sentencepiece.SentencePieceProcessor:
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    if not splits_at_spaces(processor):
        raise ValueError("pieces of this vocabulary go beyond a pre-token")
    return processor


def splits_at_spaces(processor: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether no piece holds a line feed, or a space mark after another character."""
    pieces = (processor.id_to_piece(i) for i in range(processor.vocab_size()))
    return not any("\n" in p or _SPACE in p.lstrip(_SPACE) for p in pieces)


def pretokens(texts: Texts) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of a chunk, in order, and the text each belongs to.

    The tokenizer takes a space for its space mark and puts one before a text that isn't empty.
    A pre-token begins at a line feed, or at a space that follows no space, and goes up to the
    next one; no piece crosses its end.
    """
    data, bounds = texts.data, texts.bounds
    starts = bounds[:-1][np.diff(bounds) > 0]
    data = np.insert(data, starts, 0x20)
    bounds = bounds + np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])
    space = data == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins |= data == 0x0A
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    begin = np.flatnonzero(begins)
    offsets = np.append(begin, len(data)).astype(np.int64)
    values = pa.Array.from_buffers(
        pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )
    return values, np.searchsorted(bounds, begin, "right") - 1


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[Texts]:
    """Blocks of texts in which the space mark, which the tokenizer takes for a space, is one."""
    def spaced():
        for batch in batches:
            text = pc.replace_substring(batch.column("text"), _SPACE, " ")
            yield batch.set_column(batch.schema.get_field_index("text"), "text", text)

    return chunks(spaced(), BLOCK_BYTES, BLOCK_TEXTS)


def piece_counts(processor: sentencepiece.SentencePieceProcessor, found: list[bytes]) -> list[int]:
    """How many pieces each pre-token has.

    What the tokenizer puts before a text stands for a pre-token's first space; before a line feed
    it is one piece too many.
    """
    words = [w.decode() for w in found]
    ids = processor.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
    return [1 if w == " " else len(i) - (w[0] == "\n") for w, i in zip(words, ids)]


_FREQUENCIES = (
    "bucket int, block long, words binary, lengths binary, texts binary, places binary, times binary, "
    "doc_id array<long>, n_bytes array<long>"
)
_SUMS = "block long, places binary, sums binary, doc_id array<long>, n_bytes array<long>"


def _frequencies(path: str, buckets: int):
    """Per block and bucket of pre-tokens: the pre-tokens, in which texts each is, and how often.

    One more row for a block has its documents and the pieces of their frequent pre-tokens.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, block = _processor(path), TaskContext.get().partitionId() << 32
        for texts in _plain(batches):
            found, owner = pretokens(texts)
            coded = found.dictionary_encode()
            n, words = len(texts), coded.dictionary
            pair, times = np.unique(np.asarray(coded.indices).astype(np.int64) * n + owner, return_counts=True)
            code, place = pair // n, pair % n
            in_texts = np.bincount(code, minlength=len(words))
            often = in_texts > max(1, n * FREQUENT)
            pieces = np.zeros(len(words), np.int64)
            pieces[often] = piece_counts(processor, words.filter(pa.array(often)).to_pylist())
            known = np.bincount(place, weights=times * pieces[code], minlength=n).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(in_texts)])
            rare = np.flatnonzero(~often)
            bucket = (word_hashes(words)[rare] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rare, bucket = rare[order], bucket[order]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(rare) else np.zeros(0, np.int64)
            size = np.asarray(pc.binary_length(words)).astype("<u4")
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for low, high in zip(starts, np.append(starts[1:], len(rare))):
                own = rare[low:high]
                at = np.repeat(first[own] - np.concatenate([[0], np.cumsum(in_texts[own])[:-1]]), in_texts[own])
                at += np.arange(len(at))
                values = (
                    int(bucket[low]), b"".join(words.take(pa.array(own)).to_pylist()), size[own].tobytes(),
                    in_texts[own].astype("<u4").tobytes(), place[at].astype("<u2").tobytes(), times[at].astype("<u4").tobytes(),
                )
                for column, value in zip(rows, values):
                    column.append(value)
            one, more = np.array([n]), len(rows[0])
            own = int(mixed(np.array([block], np.uint64))[0] % np.uint64(buckets))
            none = pa.nulls(more, pa.list_(pa.int64()))
            with_documents = [
                pa.array([own], pa.int32()), pa.array([block]), *(pa.nulls(1, pa.binary()) for _ in range(3)),
                pa.array([np.arange(n, dtype="<u2").tobytes()]), pa.array([known.astype("<i8").tobytes()]),
                lists(texts.columns["doc_id"], one), lists(texts.columns["n_bytes"], one),
            ]
            names = [c.split()[0] for c in _FREQUENCIES.split(", ")]
            yield pa.RecordBatch.from_arrays(with_documents, names)
            for low in range(0, more, 256):
                part = slice(low, low + 256)
                binary = [pa.array(column[part], pa.binary()) for column in rows[1:]]
                count = len(binary[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[0][part], pa.int32()), pa.array(np.full(count, block)), *binary, none[part], none[part]], names
                )
            block += 1

    return counted


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each value of a binary array."""
    return Texts(words.cast(pa.large_binary()), {}).hashes()


def _joined(path: str):
    """Meet the pre-tokens of this task's buckets with their piece counts, each counted once."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, known = _processor(path), {}
        for batch in batches:
            places, sums = [], []
            for row in batch.select(["words", "lengths", "texts", "places", "times"]).to_pylist():
                place = np.frombuffer(row["places"], "<u2")
                if row["words"] is None:
                    places.append(row["places"])
                    sums.append(row["times"])
                    continue
                ends = np.cumsum(np.frombuffer(row["lengths"], "<u4"), dtype=np.int64).tolist()
                raw = row["words"]
                words = [raw[a:b] for a, b in zip([0, *ends], ends)]
                new = [w for w in words if w not in known]
                known.update(zip(new, piece_counts(processor, new)))
                pieces = np.array([known[w] for w in words], np.int64)
                tokens = np.repeat(pieces, np.frombuffer(row["texts"], "<u4")) * np.frombuffer(row["times"], "<u4")
                touched, index = np.unique(place, return_inverse=True)
                places.append(touched.tobytes())
                sums.append(np.bincount(index, weights=tokens).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), pa.array(places, pa.binary()), pa.array(sums, pa.binary()), batch.column("doc_id"), batch.column("n_bytes")],
                [c.split()[0] for c in _SUMS.split(", ")],
            )

    return summed


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document, from all rows of its block."""
    for batch in groups_of("block", batches):
        block = np.asarray(batch.column("block"))
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for low, high in zip(starts, np.append(starts[1:], len(block))):
            part = batch.slice(low, high - low)
            documents = part.filter(part.column("doc_id").is_valid())
            n_bytes = documents.column("n_bytes").flatten()
            total = np.zeros(len(n_bytes), np.int64)
            for places, sums in zip(part.column("places").to_pylist(), part.column("sums").to_pylist()):
                total[np.frombuffer(places, "<u2")] += np.frombuffer(sums, "<i8")
            yield pa.RecordBatch.from_arrays(
                [documents.column("doc_id").flatten(), n_bytes, pa.array(total)], ["doc_id", "n_bytes", "n_tokens"]
            )


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, and whether these are more than ``limit``.

    The pre-tokens of a block of texts are dealt to buckets by their hash, with the places and
    frequencies of their texts. The task of a bucket counts the pieces of each distinct pre-token
    once, joins the counts to the frequencies, and sends a sum per text back to its block. A
    pre-token that many texts of a block share is counted there, so no frequent one is gathered.
    There are at least as many buckets as parts of the input, which bounds what a task keeps. Ids
    are never written out.

    Null and empty texts have 0 tokens. Rows are counted one by one, so repeated rows, doc_ids with
    several texts and null doc_ids all keep a row each; an empty table gives an empty one.

    A place in a block stands for a row, so ``docs`` should be a stored table: a part that is read
    again after a loss must give its rows in the same order, as files and checkpoints do.
    """
    spark = docs.sparkSession
    path = public_tokenizers.path(vocabulary)
    rows = text_rows(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    sums = rows.mapInArrow(_frequencies(path, buckets), _FREQUENCIES).repartition(buckets, "bucket").mapInArrow(_joined(path), _SUMS)
    return (
        sums.repartition("block").sortWithinPartitions("block")
        .mapInArrow(_totals, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
