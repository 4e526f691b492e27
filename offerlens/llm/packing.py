"""Best-fit packing of token sequences, by exact-complement hashing over the lengths.

1. Documents are tokenised once, cut where they are longer than a sequence, and stored as pieces.
2. How many pieces have each length is counted. That table has CAPACITY rows at most, whatever the corpus, and the plan is
   made from it alone: going down from the longest length, single lengths, pairs and triples whose sums are exactly the gap
   are looked up under the counts that are left, and consumed as often as they are there; what no combination fills
   exactly is packed by best fit. A plan is a list of patterns, each to be used a number of times; as each use ends a length or
   a pattern, there are few.
3. Each piece gets its number within its length (counted by salted buckets, so a length that a third of all pieces have is
   no group) and looks up its pattern, sequence and offset by that number.

Cases. A null or empty text is a piece that holds just the end token. Repeated rows are packed each; their doc_id repeats. A
null doc_id stays null. Extra columns are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import only, stored

CAPACITY, END = 2_048, 0
BUCKET_ROWS = 100_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
#: Characters of the texts that are tokenised at once.
BATCH_CHARS = 2_000_000


@lru_cache(maxsize=1)
def _whole(path: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids of each text, by the vocabulary of a tokenizers file.

    tiktoken merges a byte-level vocabulary by the same ranks about five times as fast as tokenizers does, with the same ids;
    other kinds of files, and texts that hold the string of an added token, go to tokenizers itself.
    """
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as file:
        known = json.load(file)
    plain = {k: known.get(k) for k in ("normalizer", "pre_tokenizer")} | {"model": known["model"]["type"]}
    if plain["normalizer"] is None and plain["model"] == "BPE" and (plain["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not plain["pre_tokenizer"]["add_prefix_space"]:
        # Byte-level files write bytes that aren't printable as the code points from 256 on, in order.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        added = sorted(x["content"] for x in known.get("added_tokens", []))
        ranks = {bytes(byte_of[c] for c in token): i for token, i in known["model"]["vocab"].items() if token not in added}
        merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [np.array(_whole(path).encode(x, add_special_tokens=False).ids if any(a in x for a in added) else merge.encode_ordinary(x), np.uint32) for x in texts]
    return lambda texts: [np.array(x.ids, np.uint32) for x in _whole(path).encode_batch(texts, add_special_tokens=False)]


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of each piece: full ones, but for the first."""
    first = len(ids) % capacity or min(capacity, len(ids))
    starts = [0, *range(first, len(ids), capacity)]
    return [(s, ids[s:e]) for s, e in zip(starts, [*starts[1:], len(ids)], strict=True)]


def _tokenised(path: str, capacity: int, with_ids: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path)
        for frame in frames:
            texts = [x or "" for x in frame["text"]]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_CHARS):
                    size, to = size + len(texts[to]), to + 1
                rows = []
                for doc_id, ids in zip(frame["doc_id"].iloc[at:to], encode(texts[at:to]), strict=True):
                    for k, (start, own) in enumerate(cut(np.append(ids, np.uint32(END)), capacity)):
                        rows.append((doc_id, k, start, len(own), zlib.crc32(own.astype("<u4").tobytes()), own.astype(np.int32) if with_ids else None))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECE.split(", ")])
                at = to

    return run


def pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInPandas(_tokenised(path, capacity, with_ids), PIECE)


def _exact(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three lengths that are left and add up to gap, longest first."""
    if gap <= 0 or gap >= len(left):
        return None
    if left[gap]:
        return (gap,)

    def pair(total: int, most: int) -> tuple[int, int] | None:
        a = np.arange(min(total - 1, most), (total - 1) // 2, -1)
        if not len(a):
            return None
        b = total - a
        fits = (left[a] > 0) & (left[b] > 0) & ((a != b) | (left[a] > 1))
        return (int(a[i]), int(b[i])) if fits[i := int(fits.argmax())] else None

    if found := pair(gap, gap - 1):
        return found
    for a in np.flatnonzero(left[: gap - 1])[::-1]:
        if 3 * a < gap:
            break
        left[a] -= 1
        found = pair(gap - int(a), int(a))
        left[a] += 1
        if found:
            return (int(a), *found)
    return None


#: Shares of the capacity up to which lengths are held back from the exact combinations; the best plan of all is taken.
RESERVES = (0.0, 0.01, 0.03, 0.1, 0.25)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, how many in a sequence)], how many sequences) that use up the counts.

    Short pieces help best fit most, so it is also tried to keep them for the residuals.
    """
    plans = (_plan(counts, capacity, int(capacity * share)) for share in RESERVES)
    return min(plans, key=lambda patterns: sum(times for _, times in patterns))


def _plan(counts: dict[int, int], capacity: int, reserve: int) -> list[tuple[list[tuple[int, int]], int]]:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[list[tuple[int, int]], int]] = []

    def tally(lengths: tuple[int, ...]) -> list[tuple[int, int]]:
        return [(x, lengths.count(x)) for x in dict.fromkeys(lengths)]

    rest: dict[int, int] = {x: int(left[x]) for x in range(1, reserve + 1) if left[x]}
    left[: reserve + 1] = 0
    for length in range(capacity, 0, -1):
        while left[length]:
            if length == capacity:
                pattern = [(length, 1)]
            else:
                left[length] -= 1
                others = _exact(left, capacity - length)
                left[length] += 1
                if others is None:
                    rest[length] = int(left[length])
                    left[length] = 0
                    break
                pattern = tally((length, *others))
            times = min(int(left[x]) // n for x, n in pattern)
            for x, n in pattern:
                left[x] -= n * times
            out.append((pattern, times))
    # Best fit of the rest: of the sequences with the same gap and pattern, only the number is kept.
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                each = capacity // length
                gap, group, have = capacity, [], max(1, n // each)
            else:
                group, have = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                each = gap // length
            full = min(have, n // each)
            if full:
                open_.setdefault(gap - each * length, []).append(([*group, (length, each)], full))
                n, have = n - full * each, have - full
            if n and have:
                open_.setdefault(gap - n * length, []).append(([*group, (length, n)], 1))
                n, have = 0, have - 1
            if have and group:
                open_.setdefault(gap, []).append((group, have))
    out += [x for groups in open_.values() for x in groups]
    return out


def _places(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first number, how many in a sequence, first sequence, first offset), sorted by number."""
    used: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for pattern, times in patterns:
        offset = 0
        for length, n in pattern:
            first = used.get(length, 0)
            out.setdefault(length, []).append((first, n, base, offset))
            used[length] = first + n * times
            offset += n * length
        base += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _placed(places: dict[int, np.ndarray], columns: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lengths, numbers = frame["length"].to_numpy(), frame["__number"].to_numpy()
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for length in np.unique(lengths):
                own, of = places[int(length)], lengths == length
                i = np.searchsorted(own[:, 0], numbers[of], "right") - 1
                within = numbers[of] - own[i, 0]
                sequence[of] = own[i, 2] + within // own[i, 1]
                offset[of] = own[i, 3] + within % own[i, 1] * length
            yield frame[columns].assign(sequence_id=sequence, offset=offset)

    return run


def packed(docs: DataFrame, path: str, *, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset (and its ids)."""
    found = pieces(docs, path, capacity=capacity, with_ids=with_ids)
    rows = stored(found if with_ids else found.drop("ids"), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # CAPACITY rows at most
    buckets = max(16, -(-sum(counts.values()) // BUCKET_ROWS))
    numbered = rows.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = numbered.groupBy("length", "__bucket").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece")
    numbered = numbered.withColumn("__own", F.row_number().over(own) - 1).join(starts, ["length", "__bucket"]).withColumn("__number", F.col("__before") + F.col("__own"))
    columns = rows.columns
    return numbered.select(*columns, "__number").mapInPandas(_placed(_places(plan(counts, capacity)), columns), ", ".join(c for c in [*PIECE.split(", "), "sequence_id long", "offset long"] if c.split()[0] in {*columns, "sequence_id", "offset"}))


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences of pieces with ids: sequence_id, ids, and doc_ids in order."""
    of = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("__p"))
    return of.select("sequence_id", F.flatten(F.col("__p.ids")).alias("ids"), F.col("__p.doc_id").alias("doc_ids"))
