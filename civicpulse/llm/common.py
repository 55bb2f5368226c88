"""What several operators share: session set-up, bounded chunks of texts, word and n-gram hashes."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicpulse.session import prepare

#: Bytes of text that a task turns into arrays at once; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20

#: Separators of words: space, and tab to carriage return.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_RANDOM = np.random.default_rng(20240601)
_BYTE_CODES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def start(spark: SparkSession) -> SparkSession:
    """Ship the package, bound the Arrow batches, and make sure that there is a checkpoint folder.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``; only where that is
    unset, as in tests in local mode, a temporary folder takes its place.
    """
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", "")
        if not shared and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="civicpulse-checkpoint-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return start(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of a table, whatever other columns it has; a null text is empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )


def keyed_rows(docs: DataFrame) -> DataFrame:
    """``text_rows`` with ``key``, a hash of the text: with doc_id it names a row's content.

    Rows that repeat both share what is found for either, which is the same for equal texts.
    """
    return text_rows(docs).withColumn("key", F.xxhash64("text"))


def fresh(columns: list[str], stem: str) -> str:
    """A column name that is not among ``columns``, in any case."""
    taken = {c.lower() for c in columns}
    while stem in taken:
        stem += "_"
    return stem


class Texts:
    """A chunk of texts as one byte array; ``first`` and ``last`` bound each text."""

    def __init__(self, texts: pa.Array, columns: dict[str, pa.Array]):
        binary = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
        raw = binary.buffers()[2]
        whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.bounds = offsets - offsets[0]
        self.columns = columns

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self) -> "Words":
        return Words(self)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each text."""
        begin, end = self.bounds[:-1], self.bounds[1:]
        return mixed(_spans(_BYTE_CODES[self.data], begin, end) + (end - begin).astype(np.uint64))


class Words:
    """The words of a chunk: byte ranges, the text each is in, and 64-bit hashes."""

    def __init__(self, texts: Texts):
        data, bounds = texts.data, texts.bounds
        inside = ~_SEPARATOR[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        if len(data):
            cuts = bounds[(bounds > 0) & (bounds < len(data))]
            begins[cuts] |= inside[cuts]
            ends[cuts - 1] |= inside[cuts - 1]
        self.begin = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.text = np.searchsorted(bounds, self.begin, "right") - 1
        #: Words of text i are first[i] .. first[i + 1].
        self.first = np.searchsorted(self.begin, bounds)
        self.hash = _spans(_BYTE_CODES[data], self.begin, self.end)
        self.hash = mixed(self.hash + (self.end - self.begin).astype(np.uint64))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which n words of one text follow, and the hashes of these n words."""
        count = len(self.hash)
        if count < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[: count - n + 1] == self.text[n - 1 :])
        return at, mixed(_spans(self.hash, at, at + n) + np.uint64(n))


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 .. n - 1, modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def _spans(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of codes[begin:end] for all spans, from one running sum."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power(_BASE, len(codes)), out=sums[1:])
    return (sums[end] - sums[begin]) * _power(_INVERSE, len(codes) + 1)[begin]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, rows: int = 1 << 16) -> Iterator[Texts]:
    """The rows of Arrow batches in order, in chunks of at most ``limit`` bytes of text and ``rows`` rows."""
    for batch in batches:
        sizes = np.asarray(pc.binary_length(batch.column("text")).fill_null(0))
        low = 0
        total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(total, total[low] + limit, "right")) - 1)
            high = min(high, low + rows)
            part = batch.slice(low, high - low)
            names = part.schema.names
            yield Texts(part.column("text"), {n: part.column(n) for n in names if n != "text"})
            low = high


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """An array of lists of the given sizes over consecutive values."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def numbers(column: pa.Array, dtype=np.int64) -> np.ndarray:
    """The values of a column of lists, flattened."""
    return np.asarray(column.flatten()).astype(dtype, copy=False)


#: Case folded and punctuation blanked, for words that need not match to the letter.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20


def folded(texts: Texts) -> Texts:
    """The same texts with ASCII letters in lower case and ASCII punctuation as spaces."""
    out = object.__new__(Texts)
    out.data, out.bounds, out.columns = _FOLD[texts.data], texts.bounds, texts.columns
    return out


def text_array(values: list) -> pa.Array:
    return pa.array([v or "" for v in values], pa.string())


def groups_of(name: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that no value of the sorted column ``name`` is in two of them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        keys = np.asarray(batch.column(name))
        if not len(keys):
            continue
        cut = int(np.flatnonzero(keys == keys[-1])[0])
        if rest and rest[-1].column(name)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            rest = []
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
