"""Substring de-duplication by hashing units of text, globally.

A unit is normalised (its words with A-Z in lower case, without ASCII marks and white space) and hashed; equal digests are grouped over the whole
corpus; the occurrence with the least rank (doc_id, then place) stays, the others are removed, as ranges of characters of the
original text. There are two kinds of units:

1. Lines (or paragraphs; they are one thing in a text without blank lines) of MIN_WORDS words or more.
2. Passages of MIN_WORDS words of the whole text, wherever they begin, across lines too: whole lines alone can't show a
   passage that stands within different lines, or runs over several. Only passages that may repeat are grouped: by winnowing, a repeated passage shares a
   fingerprint of half its words with its like, and a filter of fingerprints that occur more than once (FILTER_BITS bits, a
   bounded size; others that pass cost time, not results) says where those are. So every repeated passage is found in full.

What goes is what either kind of unit says: the lines' and the passages' ranges are united at the end.

A passage that overlaps the first occurrence of itself (a repeated word) isn't removed for that.

Cases. Null and empty texts have no units. Rows with a null doc_id have no rank: they take no part and stay whole. Repeated rows
of one doc_id have one rank: they don't remove each other's units. Extra columns are ignored (report) or kept (deduplicated).
An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import WordHashes, batches, mixed, only, stored

MIN_WORDS, FILTER_BITS = 50, 27
_PART_BITS = 20
#: Words are runs of ASCII letters and digits and of all other characters beyond ASCII; in bytes, what this table leaves.
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: Words of segments that are hashed at once.
BATCH_WORDS = 150_000


def words_of(text: str) -> list[bytes]:
    """A text's words with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of so many words, the same wherever it stands."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    power = np.full(n, _BASE, np.uint64)
    power[0] = 1
    inverse = np.full(n, _INVERSE, np.uint64)
    inverse[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words) * np.cumprod(power), dtype=np.uint64)])
    return mixed((sums[width:] - sums[:-width]) * np.cumprod(inverse)[: n - width + 1] + np.uint64(width))


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each so many hashes in a row."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    now, have = h, 1
    while have * 2 <= width:
        now, have = np.minimum(now[:-have], now[have:]), have * 2
    return np.minimum(now[: len(h) - width + 1], now[width - have : width - have + len(h) - width + 1])


def fingerprints(words: np.ndarray, min_words: int) -> np.ndarray:
    """Winnowed hashes of half passages: of each passage of min_words words the least one. Those that recur in the text come twice."""
    half = min_words // 2
    chosen = least(windows(words, half), min_words - half + 1)
    if not len(chosen):
        return chosen
    at = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    runs = np.diff(np.concatenate([at, [len(chosen)]]))
    return np.concatenate([chosen[at], chosen[at][runs > min_words - half + 1]])


def _segments(text: str | None, gone: list[int] | None = None) -> Iterator[tuple[int, str]]:
    """(place, text) of what passages are looked for in: the whole text, whichever of its lines are gone."""
    if text:
        yield 0, text


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int, str]], np.ndarray, np.ndarray]]:
    """A frame, its segments (row, place, text), their words and where each one's begin; some segments at a time."""
    hash_of = WordHashes()
    for frame in batches(frames):
        held, parts, size = [], [], 0
        for row, text in enumerate(frame["text"]):
            for place, segment in _segments(text):
                held.append((row, place, segment))
                parts.append(hash_of.of(words_of(segment)))
                size += len(parts[-1])
                if size >= BATCH_WORDS:
                    yield frame, held, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
                    held, parts, size = [], [], 0
        if held:
            yield frame, held, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def _line_units(min_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hash_of = WordHashes()
        for frame in batches(frames):
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                at = 0
                for k, line in enumerate(text.split("\n") if text else ()):
                    # Most lines are too short by their length alone.
                    if len(line) >= 2 * min_words - 1 and len(words := words_of(line)) >= min_words:
                        digest = xxhash.xxh3_64_intdigest(hash_of.of(words).tobytes())
                        out.append((digest - (1 << 63), doc_id, k, at, at + len(line)))
                    at += len(line) + 1
            yield pd.DataFrame(out, columns=["digest", "doc_id", "unit", "start", "end"])

    return run


def _fingerprints(min_words: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, words, starts in _hashed(frames):
            # Windows that run over a segment's end can only add fingerprints.
            yield pd.DataFrame({"digest": fingerprints(words, min_words).view(np.int64)})

    return run


def _bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts: dict[int, np.ndarray] = {}
    for frame in frames:
        for part, cells in frame.groupby("part")["cell"]:
            parts.setdefault(int(part), np.zeros(1 << _PART_BITS, bool))[cells.to_numpy()] = True
    for part, own in parts.items():
        yield pd.DataFrame({"part": [part], "bits": [np.packbits(own).tobytes()]})


def _filter(digests: DataFrame) -> np.ndarray:
    """A bit for each cell of the digests that occur more than once: 2**FILTER_BITS bits."""
    cell = F.shiftrightunsigned("digest", 64 - FILTER_BITS)
    several = digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    cells = several.select(F.shiftright(cell, _PART_BITS).cast("int").alias("part"), cell.bitwiseAND((1 << _PART_BITS) - 1).cast("int").alias("cell"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    size = 1 << (_PART_BITS - 3)
    for row in cells.repartition("part").mapInPandas(_bits, "part int, bits binary").toLocalIterator():
        out[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


LINE = "digest long, doc_id long, unit int, start int, end int"
PASSAGE = "digest long, doc_id long, start int, end int"


def _passages(known: np.ndarray, min_words: int):
    half = min_words // 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, held, words, starts in _hashed(frames):
            cell = windows(words, half) >> np.uint64(64 - FILTER_BITS)
            hit = (known[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1
            sums = np.concatenate([[0], np.cumsum(hit)])
            digest = windows(words, min_words)
            n = len(digest)
            reach = min_words - half + 1
            # A passage may repeat only if one of its halves' windows does.
            place = np.flatnonzero(sums[reach : reach + n] > sums[:n]) if n else np.empty(0, np.int64)
            of = np.searchsorted(starts, place, "right") - 1
            inside = place + min_words <= starts[of + 1]
            place, of = place[inside], of[inside]
            if not len(place):
                continue
            lots = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            doc_id, start, end = np.empty(len(place), np.int64), np.empty(len(place), np.int32), np.empty(len(place), np.int32)
            for lo, hi in zip(lots, [*lots[1:], len(of)], strict=True):
                row, begin, segment = held[of[lo]]
                spans = np.array([m.span() for m in WORD.finditer(segment)], np.int32)
                first = place[lo:hi] - starts[of[lo]]
                doc_id[lo:hi] = frame["doc_id"].iloc[row]
                start[lo:hi] = begin + spans[first, 0]
                end[lo:hi] = begin + spans[first + min_words - 1, 1]
            yield pd.DataFrame({"digest": digest[place].view(np.int64), "doc_id": doc_id, "start": start, "end": end})

    return run


def _repeated_lines(units: DataFrame) -> DataFrame:
    """All but the first occurrence of each digest."""
    first = units.groupBy("digest").agg(F.min(F.struct("doc_id", "unit")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("__digest"), "first")
    return units.join(first, F.col("digest") == F.col("__digest")).where(F.struct("doc_id", "unit") != F.col("first")).select("doc_id", "unit", "start", "end")


def _repeated_passages(units: DataFrame) -> DataFrame:
    """All but the first occurrence of each digest and those that overlap it: one exchange, and a window that goes through a
    digest's rows in order with the first one in hand, however many there are."""
    order = Window.partitionBy("digest").orderBy("doc_id", "start").rowsBetween(Window.unboundedPreceding, 0)
    seen = units.withColumn("first", F.first(F.struct("doc_id", "end")).over(order))
    return seen.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") >= F.col("first.end"))).select("doc_id", "start", "end")


def _merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for ranges in frame["ranges"]:
            own: list[list[int]] = []
            for r in sorted((int(r["start"]), int(r["end"])) for r in ranges):
                if own and r[0] <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], r[1])
                else:
                    own.append(list(r))
            out.append([{"start": s, "end": e} for s, e in own])
        yield pd.DataFrame({"doc_id": frame["doc_id"], "spans": out})


def removed(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id and spans (start and end in characters, in order) of each document of docs(doc_id, text) that loses some."""
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = stored(docs.mapInPandas(_line_units(min_words), LINE), "line-units")
    known = _filter(docs.mapInPandas(_fingerprints(min_words), "digest long"))
    passages = docs.mapInPandas(_passages(known, min_words), PASSAGE)
    ranges = _repeated_lines(lines).select("doc_id", "start", "end").unionByName(_repeated_passages(passages))
    return ranges.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("ranges")).mapInPandas(_merged, "doc_id long, spans array<struct<start: int, end: int>>")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_spans, removed_chars and spans of every row of docs(doc_id, text)."""
    rows = only(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"))
    none = F.array().cast("array<struct<start: int, end: int>>")
    found = rows.join(removed(docs, **options), "doc_id", "left").withColumn("spans", F.coalesce("spans", none))
    chars = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.size("spans").alias("n_spans"), chars.alias("removed_chars"), "spans")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs without the repeated units; the texts' other characters stay as they are."""
    gone = removed(docs, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("was")).join(gone, F.col("id") == F.col("doc_id"), "left")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["text"], F.substring("was", a["at"] + 1, s["start"] - a["at"])).alias("text"), s["end"].alias("at"))
    left = F.aggregate("spans", start, step, lambda a: F.concat(a["text"], F.substring("was", a["at"] + 1, F.length("was"))))
    text = F.when(F.col("spans").isNull(), F.col("was")).otherwise(left)
    return rows.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
