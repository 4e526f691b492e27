"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.session import shared_folder

#: Lower-cases A-Z only, as the contracts ask; Spark's lower() also changes other letters.
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows of one Arrow batch: texts are long, and a task holds a batch or two.
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task holds of the texts; a session that asks for fewer rows keeps its setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its lineage ends there, so that a lost executor costs no recomputation. The driver's JVM deletes it as it ends."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that extra ones with any name can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def batches(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Drops the empty batches."""
    return (f for f in frames if len(f))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: equal inputs give equal outputs, near ones unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C13
#: What each byte adds to a word's hash.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            own = np.full(max(n, 2 * len(_powers[i])), x, np.uint64)
            own[0] = 1
            _powers[i] = np.cumprod(own)
    return _powers[0][:n], _powers[1][:n]


#: Bytes that are hashed at once; a longer word is hashed in one go.
_STRETCH = 1 << 18


class Words:
    """The words of some texts (UTF-8), and a 64-bit hash of each: a polynomial of its bytes, finished by mixed(). All in whole arrays; nothing is kept for later calls.

    table maps the bytes: what becomes a space divides words. begin and end are places in raw, which holds the texts with a
    line feed before, between and behind them; text i starts at start[i], and its words are first[i] to first[i + 1].
    """

    def __init__(self, texts: Sequence[bytes | None], table: bytes):
        self.raw = b"\n".join([b"", *(t or b"" for t in texts), b""])
        self.start = np.cumsum([1, *(len(t or b"") + 1 for t in texts)])
        data = np.frombuffer(self.raw.translate(table), np.uint8)
        inside = data != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.begin, self.end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.begin, self.start)
        self.hash = np.empty(len(self.begin), np.uint64)
        at = 0
        while at < len(self.begin):
            low = self.begin[at]
            to = max(at + 1, int(np.searchsorted(self.end, low + _STRETCH, "right")))
            up, down = powers(int(self.end[to - 1] - low) + 1)
            sums = np.zeros(len(up), np.uint64)
            np.cumsum(_BYTE[data[low : self.end[to - 1]]] * up[:-1], out=sums[1:])
            b, e = self.begin[at:to] - low, self.end[at:to] - low
            self.hash[at:to] = (sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64)
            at = to
        self.hash = mixed(self.hash)

    def characters(self) -> np.ndarray | None:
        """How many characters stand before each byte; null where all are ASCII."""
        if self.raw.isascii():
            return None
        return np.concatenate([[0], np.cumsum((np.frombuffer(self.raw, np.uint8) & 0xC0) != 0x80)])


#: Words of the near-duplicate contract: [^\x20\x09-\x0D]+, with A-Z lower-cased.
SPACED = bytes(32 if c in b"\t\n\v\f\r" else c for c in range(256)).lower()
#: Words of ASCII letters and digits and of all bytes beyond ASCII, with A-Z lower-cased.
LETTERED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()

#: Bytes of the texts that are looked at together, unless one text is longer.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Rows with some texts of about so many bytes, or one row, and their texts as they lie in Arrow's buffer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = [x.as_buffer() for x in batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())]
        texts = [None if x is None else memoryview(x) for x in texts]
        sizes = np.cumsum([1 if x is None else len(x) + 1 for x in texts])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at), texts[at:to]
            at = to


def groups_of(group: np.ndarray, n_groups: int, hashes: np.ndarray, level: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of each group by level, then hash: (hashes, level, where each group's begin; n_groups + 1 places).

    One sort of one number for each hash: group, level and the hash's top bits. Where those bits don't tell two hashes of a
    group apart, all are sorted in full.
    """
    if level is None:
        level = np.zeros(len(hashes), np.uint8)
    order = None
    if n_groups <= 1 << 19:
        packed = group.astype(np.uint64) << np.uint64(45) | level.astype(np.uint64) << np.uint64(39) | hashes >> np.uint64(25)
        order = np.argsort(packed)
        packed = packed[order]
        if ((packed[1:] == packed[:-1]) & (hashes[order[1:]] != hashes[order[:-1]])).any():
            order = None
    if order is None:
        order = np.lexsort((hashes, level, group))
    hashes, level, group = hashes[order], level[order], group[order]
    own = np.ones(len(hashes), bool)
    own[1:] = (hashes[1:] != hashes[:-1]) | (group[1:] != group[:-1])
    group = group[own]
    return hashes[own], level[own], np.searchsorted(group, np.arange(n_groups + 1))


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of the width-word shingles of each text, sorted, and where each text's begin.

    words: hashes of all texts' words; first: where each text's begin, and the end. A text of fewer words is one shingle.
    """
    count = np.diff(first)
    k = np.minimum(width, count)
    per = np.where(count > 0, count - k + 1, 0)
    text = np.repeat(np.arange(len(count)), per)
    at = np.arange(len(text)) + np.repeat(first[:-1] - np.cumsum(per) + per, per)
    out = k[text].astype(np.uint64)
    for i in range(width):
        use = slice(None) if not len(k) or (k[per > 0] > i).all() else np.flatnonzero(i < k[text])
        out[use] = mixed(out[use] * np.uint64(0x9E3779B97F4A7C15) + words[at[use] + i])
    found, _, starts = groups_of(text, len(count), out)
    return found, starts


#: Some 100 bytes each.
REMEMBERED = 150_000


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered; cleared when a task has seen REMEMBERED distinct words, which bounds its memory."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
