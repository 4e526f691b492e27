"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at some positions of a window of words and ignore the others, so a window still matches where an ignored
word was substituted. The masked hashes of the benchmark's windows are looked up for those of every document's (a hash join
within the task: the benchmark goes to the tasks in blocks of BLOCK_WORDS words, a bounded broadcast each). Around each hit the
document and the item are compared word by word on the hit's diagonal. A document is contaminated if some stretch there, of
OVERLAP words or the whole item if that is shorter, agrees in SIMILARITY of its words or more.

Words are runs of letters, digits and underscores, in lower case. Items of fewer than SHORTEST words are not looked for.
Items of fewer than OVERLAP words have short masks of their own. Some mask fits every way to substitute as many words of an item of
SHORTEST to OVERLAP words as SIMILARITY allows (a test goes through all of them), so no overlap that counts is missed.

Cases. A null or empty text is clean. A null or empty item matches nothing; repeated items are found each. Repeated documents
are judged each; a null doc_id stays null. Extra columns are ignored (contamination) or kept (clean). An empty benchmark leaves
every document clean; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import Words, mixed, only, pieces

#: 1 is a compared position.
LONG_MASKS = ("1110110101", "1101010111", "110110010011", "101001101101", "1111111")
SHORT_MASKS = ("111", "1101", "1011")
SHORTEST, OVERLAP, SIMILARITY = 5, 13, 0.8
BLOCK_WORDS = 400_000
_FILTER_BITS = 23
#: ASCII characters that are no part of a word become spaces; others that aren't are replaced before.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
_MARKS = re.compile(r"[^\w\x00-\x7f]+")


def hashed(texts: list[str | None]) -> Words:
    lower = ((t or "").lower() for t in texts)
    return Words([(t if t.isascii() else _MARKS.sub(" ", t)).encode("utf-8", "surrogatepass") for t in lower], _TABLE)


def _masked(words: np.ndarray, mask: str, seed: int) -> np.ndarray:
    """The masked hash of the window at each position."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, seed + 1, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return mixed(out)


@dataclass
class Items:
    """The masked hashes of a block of benchmark items, sorted, with their places."""

    ids: np.ndarray
    #: Words of all items, and where each item's begin; the last entry is the end.
    words: np.ndarray
    start: np.ndarray
    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    known: np.ndarray
    masks: list[tuple[int, str]]

    @staticmethod
    def of(ids: list[int], texts: list[str | None]) -> Items:
        found_words = hashed(texts)
        words = np.split(found_words.hash, found_words.first[1:-1])
        keep = [i for i, w in enumerate(words) if len(w) >= SHORTEST]
        words = [words[i] for i in keep]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
        used: dict[int, str] = {}
        for k, w in enumerate(words):
            for seed, mask in enumerate((*LONG_MASKS, *SHORT_MASKS)):
                if (seed < len(LONG_MASKS)) == (len(w) >= OVERLAP):
                    used[seed] = mask
                    h = _masked(w, mask, seed)
                    found.append((h, np.full(len(h), k), np.arange(len(h))))
        hashes, item, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(hashes, kind="stable")
        known = np.zeros(1 << _FILTER_BITS, bool)
        known[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        return Items(np.array([ids[i] for i in keep], np.int64), np.concatenate([np.empty(0, np.uint64), *words]), np.cumsum([0, *map(len, words)]), hashes[order], item[order], place[order], known, sorted(used.items()))

    def overlaps(self, words: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first word, end) of overlaps that hold; words: those of several documents, starts as above."""
        tried = set()
        for seed, mask in self.masks:
            h = _masked(words, mask, seed)
            at = np.flatnonzero(self.known[h >> np.uint64(64 - _FILTER_BITS)])
            left, right = np.searchsorted(self.hashes, h[at], "left"), np.searchsorted(self.hashes, h[at], "right")
            for p, lo, hi in zip(at[right > left].tolist(), left[right > left].tolist(), right[right > left].tolist(), strict=True):
                doc = int(np.searchsorted(starts, p, "right")) - 1
                if p + len(mask) > starts[doc + 1]:
                    continue  # the window runs into the next document
                for j in range(lo, hi):
                    k = int(self.item[j])
                    diagonal = p - int(self.place[j])
                    if (k, diagonal) not in tried:
                        tried.add((k, diagonal))
                        if found := self._held(words, int(starts[doc]), int(starts[doc + 1]), k, diagonal):
                            yield doc, k, found[0] - int(starts[doc]), found[1] - int(starts[doc])

    def _held(self, words: np.ndarray, first: int, end: int, k: int, diagonal: int) -> tuple[int, int] | None:
        item = self.words[self.start[k] : self.start[k + 1]]
        lo, hi = max(first, diagonal), min(end, diagonal + len(item))
        need = min(OVERLAP, len(item))
        if hi - lo < need:
            return None
        sums = np.cumsum(np.concatenate([[0], words[lo:hi] == item[lo - diagonal : hi - diagonal]]))
        good = np.flatnonzero(sums[need:] - sums[:-need] >= np.ceil(SIMILARITY * need - 1e-9))
        return (lo + int(good[0]), lo + int(good[-1]) + need) if len(good) else None


def _found(items: Items, texts: list[bytes | None]) -> list[list[tuple[int, int, int]]]:
    """Of each text: (item_id, first word, end) of its overlaps."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    words = hashed([None if t is None else str(t, "utf-8", "surrogatepass") for t in texts])
    for doc, k, s, e in items.overlaps(words.hash, words.first):
        out[doc].append((int(items.ids[k]), s, e))
    return out


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of BLOCK_WORDS words or little more, one at a time; it is a stated set, read block by block."""
    rows = only(benchmark, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    words = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-words // BLOCK_WORDS))
    for i in range(n):
        got = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).orderBy("item_id").collect()
        yield Items.of([r["item_id"] for r in got], [r["text"] for r in got])


SPAN = "struct<item_id: long, first_word: long, end_word: long>"


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids and spans (by words) of every row of docs(doc_id, text); one pass for each block of the benchmark, which alone goes to the tasks then."""
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.array().cast(f"array<{SPAN}>").alias("spans"))
    for items in blocks(benchmark):

        def run(frames: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch, texts in pieces(frames):
                found, spans = _found(items, texts), batch.column("spans")
                own = [[*old, *({"item_id": a, "first_word": b, "end_word": c} for a, b, c in new)] for old, new in zip(spans.to_pylist(), found, strict=True)] if any(found) else spans
                yield batch.set_column(2, "spans", pa.array(own, spans.type))

        rows = rows.mapInArrow(run, rows.schema)
    ids = F.array_sort(F.array_distinct(F.col("spans.item_id")))
    return rows.select("doc_id", (F.size("spans") > 0).alias("contaminated"), F.size(ids).alias("n_items"), ids.alias("item_ids"), F.array_sort("spans").alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns; one pass for each block of the benchmark."""
    for items in blocks(benchmark):

        def run(frames: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch, texts in pieces(frames):
                yield batch.filter(pa.array([not f for f in _found(items, texts)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
