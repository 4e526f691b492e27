"""Line de-duplication by an exact set-similarity join.

1. The tokens (words between ASCII marks and white space, A-Z in lower case, as hashes of 64 bits) of all lines are counted in
   2**CELL_BITS hashed cells, a bounded table whatever the vocabulary; a token's rarity is its cell's count, with ties by
   hash, so that all lines order their tokens alike.
2. Lines with equal token sets are one class. Of each class the rarest tokens are its prefix: two sets with a Jaccard similarity
   of PERCENT / 100 share a token there. Tokens that occur once in the corpus are left out; nothing else can share them.
3. The prefixes are dealt out and sorted by token and set size; a row meets those of its token whose size the length filter
   allows, a window of the sorted rows, so no token's rows are ever held together. Of the earlier classes (by doc_id, then line number) there that pass
   the positional filter and a bound on the sets' difference by parity bits (all are exact; the smaller set's prefix is the
   shorter one), each class takes some FIRST as candidates: it matters whether there is an earlier similar line, not how many,
   so a group of near copies gives a few pairs for each, not all pairs.
4. Candidates are verified on their full token sets, which are read again from the documents. A class that has more
   candidates than it took, and none of which held, is then joined with all of its candidates. So none is missed.
5. A line goes if an earlier line has an equal or similar set, whether that one stays or not.

A token with more than HOT_ROWS prefix rows is dealt out in blocks, each two of which meet in a task of their own.

Every line that has a word is judged (min_words=1). Sets of so few tokens that none but an equal one can be similar (least_size)
have no prefix; they cost one aggregation.

Cases. Null and empty texts have no lines that are judged. Rows with a null doc_id have no rank: they take no part and stay whole.
Lines of repeated rows of one doc_id have one rank: they don't remove each other. Extra columns are ignored (removed) or kept
(deduplicated). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import LETTERED, Words, batches, groups_of, mixed, only, pieces, stored

PERCENT, MIN_WORDS, CELL_BITS, FIRST = 80, 1, 24, 1
#: Bits of a token's hash in prefix rows, and of its place in the set.
TOKEN_BITS, _PLACE_BITS = 34, 28
_PART_BITS = 16
#: Up to so many rows (16 bytes each) go to every task; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Prefix rows of one token that a task takes; more are dealt out in blocks.
HOT_ROWS = 20_000
#: The rarity level of tokens that may have so many.
_LEVEL_HOT = int(8 + 3 * np.log2(HOT_ROWS / 8))
#: Distinct cells that a task holds before it passes their counts on.
_HELD_CELLS = 1 << 20


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each cell's tokens occur in this task, by part of the table."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        cells, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(cells)
        cells, first = np.unique(cells[order], return_index=True)
        return cells, np.add.reduceat(counts[order], first)

    def done(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        parts, first = np.unique(cells >> _PART_BITS, return_index=True)
        spans = list(zip(first, [*first[1:], len(cells)], strict=True))
        low = (cells & ((1 << _PART_BITS) - 1)).astype(np.uint16)
        return pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "cells": [low[s:e].tobytes() for s, e in spans], "counts": [counts[s:e].tobytes() for s, e in spans]})

    for _, texts in pieces(frames):
        cells = np.sort(_cells(Words(texts, LETTERED).hash))
        at = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.empty(0, np.int64)
        held.append((cells[at], np.diff(np.append(at, len(cells)))))
        if sum(len(x[0]) for x in held) >= 2 * _HELD_CELLS:
            held = [merged()]
            if len(held[0][0]) >= _HELD_CELLS:
                yield done(*held[0])
                held = []
    if held and len((last := merged())[0]):
        yield done(*last)


def _levels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sum of each part as levels of six bits: counts up to 8, then three steps for each doubling."""
    sums: dict[int, np.ndarray] = {}
    for frame in frames:
        for part, cells, counts in zip(frame["part"], frame["cells"], frame["counts"], strict=True):
            own = sums.setdefault(int(part), np.zeros(1 << _PART_BITS, np.int64))
            own[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.int64)
    for part, own in sums.items():
        high = 8 + np.floor(3 * np.log2(np.maximum(own, 1) / 8))
        yield pd.DataFrame({"part": [part], "levels": [np.where(own <= 8, own, np.minimum(high, 63)).astype(np.uint8).tobytes()]})


def rarity(docs: DataFrame) -> np.ndarray:
    """The level of each cell: a table of 2**CELL_BITS bytes."""
    parts = docs.select("text").mapInArrow(_counts, "part int, cells binary, counts binary").repartition("part").mapInPandas(_levels, "part int, levels binary")
    out = np.zeros(1 << CELL_BITS, np.uint8)
    for row in parts.toLocalIterator():
        out[row["part"] << _PART_BITS : (row["part"] + 1) << _PART_BITS] = np.frombuffer(row["levels"], np.uint8)
    return out


def least_size(percent: int) -> int:
    """The tokens that a set has at least if another than an equal one can be similar: n of n + 1 tokens are enough."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 31


class Lines:
    """The lines of some texts that are judged, with their token sets in the order of the prefix: those of line i are tokens[first[i]:first[i + 1]]."""

    def __init__(self, texts: list[bytes | None], levels: np.ndarray | None, min_words: int, percent: int):
        self.percent = percent
        w = Words(texts, LETTERED)
        breaks = np.flatnonzero(np.frombuffer(w.raw, np.uint8) == 10)
        begin, end = breaks[:-1] + 1, breaks[1:]
        word = np.searchsorted(w.begin, breaks)
        doc = np.searchsorted(w.start, begin, "right") - 1
        keep = np.diff(word) >= max(1, min_words)
        self.doc, self.number = doc[keep], (np.arange(len(doc)) - np.searchsorted(begin, w.start)[doc])[keep]
        characters = w.characters()
        place = (lambda at: at) if characters is None else (lambda at: characters[at])
        of = place(w.start[self.doc])
        self.begin, self.end = place(begin[keep]) - of, place(end[keep]) - of
        count = np.diff(word)
        tokens = w.hash[np.repeat(keep, count)]
        level = levels[_cells(tokens)] if levels is not None else None
        n = len(self.doc)
        self.tokens, self.level, self.first = groups_of(np.repeat(np.arange(n), count[keep]), n, tokens, level)
        self.size = np.diff(self.first)
        self.line = np.repeat(np.arange(n), self.size)
        sums = np.add.reduceat(mixed(self.tokens), self.first[:-1]) if n else np.empty(0, np.uint64)
        self.key = mixed(sums ^ mixed(self.size.astype(np.uint64))).view(np.int64)

    def parity(self, k: int) -> np.ndarray:
        """Word k of 128 parity bits of each set."""
        bits = np.where((self.tokens >> np.uint64(6)) % np.uint64(2) == k, np.uint64(1) << (self.tokens % np.uint64(64)), np.uint64(0))
        return (np.bitwise_xor.reduceat(bits, self.first[:-1]) if len(self.size) else np.empty(0, np.uint64)).view(np.int64)

    def prefixes(self) -> pa.Array:
        """Of each line: token and place in one number, of the prefix tokens that others may have; from 2**62 on if the token is frequent."""
        place = np.arange(len(self.tokens)) - self.first[:-1][self.line]
        length = self.size - -(-self.percent * self.size // 100) + 1
        length[self.size < least_size(self.percent)] = 0
        use = (place < length[self.line]) & (self.level != 1)
        packed = (self.tokens >> np.uint64(64 - TOKEN_BITS)).astype(np.int64) << _PLACE_BITS | (self.level >= _LEVEL_HOT).astype(np.int64) << 62 | place
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.line[use], minlength=len(self.size)))])
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(packed[use]))


LINE = "doc_id long, line int, start int, end int, key long, n int, p long, q long, prefix array<long>"


def _lines(levels: np.ndarray, percent: int, min_words: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(frames):
            x = Lines(texts, levels, min_words, percent)
            if len(x.size):
                short = lambda a: pa.array(a, pa.int32())
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id").take(pa.array(x.doc)), "line": short(x.number), "start": short(x.begin), "end": short(x.end), "key": x.key, "n": short(x.size), "p": x.parity(0), "q": x.parity(1), "prefix": x.prefixes()}
                )

    return run


def _token_sets(min_words: int, percent: int):
    """The token sets of the lines whose numbers are wanted."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(frames):
            x = Lines(texts, None, min_words, percent)
            wanted = batch.column("__wanted")
            rows = np.isin(x.doc << 32 | x.number, np.repeat(np.arange(len(texts)) << 32, np.diff(wanted.offsets)) | wanted.flatten().to_numpy())
            keys, at = np.unique(x.key[rows], return_index=True)
            at = np.flatnonzero(rows)[at]
            yield pa.RecordBatch.from_pydict({"key": keys, "words": pa.array([x.tokens[x.first[i] : x.first[i + 1]].tobytes() for i in at], pa.binary())})

    return run


def _confirmed(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for x, y in zip(frame["x"], frame["y"], strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield frame.loc[keep, ["a", "b"]]

    return run


#: Rows that are taken in one go, and pairs of them whose filters are looked at.
_ROWS, _PAIRS = 30_000, 250_000
#: What a prefix row holds: node (its token, or two blocks of a hot one) and n as one number, place and line as one number, and
#: the block of a hot token's row where it meets another block, else -1. Only candidates of rows that are asked about are given.
PREFIX = "tn long, pl long, side int, asked boolean, doc_id long, key long, p long, q long"
_COLUMNS = [c.split()[0] for c in PREFIX.split(", ")]


def prefixes(lines: DataFrame) -> DataFrame:
    """A row for each prefix token of lines(doc_id, line, key, n, p, q, prefix)."""
    token, place = F.shiftright(F.col("t").bitwiseAND((1 << 62) - 1), _PLACE_BITS), F.col("t").bitwiseAND((1 << _PLACE_BITS) - 1)
    rows = lines.select("doc_id", "line", "key", "n", "p", "q", F.explode("prefix").alias("t"))
    return rows.select(token.alias("token"), (F.col("t") >= 1 << 62).alias("frequent"), "n", F.shiftleft(place, 32).bitwiseOR(F.col("line")).alias("pl"), F.lit(True).alias("asked"), "doc_id", "key", "p", "q")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows by node and set size. A hot token's rows are in blocks, and block i meets block j in a node of their own; else a token is a node."""
    tn = lambda node: F.shiftleft(node, _PLACE_BITS).bitwiseOR(F.col("n"))
    hot = rows.where("frequent").groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > HOT_ROWS)
    hot = stored(hot.select(F.col("token").alias("__hot"), F.ceil(F.col("c") / HOT_ROWS).cast("int").alias("blocks")), "hot-tokens")
    if not hot.take(1):
        found = rows.select(tn(F.col("token")).alias("tn"), "pl", F.lit(-1).alias("side"), "asked", "doc_id", "key", "p", "q")
    else:  # there are fewer hot tokens than rows / HOT_ROWS, all frequent in the corpus, so they go to every task
        parts = rows.join(F.broadcast(hot), F.col("token") == F.col("__hot"), "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("key", "token"), "blocks").cast("int"), F.lit(0)))
        parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        node = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).bitwiseAND((1 << TOKEN_BITS) - 1)
        found = parts.select(tn(F.when(F.col("blocks").isNull(), F.col("token")).otherwise(node)).alias("tn"), "pl", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), "asked", "doc_id", "key", "p", "q")
    return found.repartition(F.shiftright("tn", _PLACE_BITS)).sortWithinPartitions("tn")


def _passing(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows (same node, compatible sizes, n of i no greater than n of j) the filters leave."""
    n_i, n_j, at_i, at_j = rows["n"][i], rows["n"][j], rows["place"][i], rows["place"][j]
    k = np.flatnonzero(((100 + percent) * (n_i - at_i) >= 2 * percent * n_i) & ((100 + percent) * np.minimum(n_i - at_i, n_j - at_j) >= percent * (n_i + n_j)))
    i, j = i[k], j[k]
    good = (rows["key"][i] != rows["key"][j]) & ((rows["doc_id"][i] != rows["doc_id"][j]) | (rows["line"][i] != rows["line"][j])) & ((rows["side"][i] < 0) | (rows["side"][i] != rows["side"][j]))
    differ = np.bitwise_count(rows["p"][i] ^ rows["p"][j]).astype(np.int64) + np.bitwise_count(rows["q"][i] ^ rows["q"][j])
    return k[good & ((100 + percent) * differ <= (100 - percent) * (n_i + n_j)[k])]


#: kind 0: a is an earlier candidate of b; 1: b has more candidates.
TAKEN = "kind int, a long, b long"


def _candidates(percent: int, first: int | None):
    """Of rows sorted by node and set size: the candidates of each among its like, or the first ones; it is held against those rows only whose sizes the length filter allows."""

    def taken(columns: dict[str, np.ndarray], done: int) -> Iterator[pa.RecordBatch]:
        tn, n = columns["tn"], columns["tn"] & ((1 << _PLACE_BITS) - 1)
        rows = columns | {"n": n, "place": columns["pl"] >> 32, "line": columns["pl"] & 0xFFFFFFFF}
        low = np.searchsorted(tn, (tn - n) | -(-percent * n // 100))
        counts = np.arange(len(tn)) - low
        counts[:done] = 0
        upto, at = np.cumsum(counts), done
        while at < len(tn):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, "right")))
            count = counts[at:to]
            j = np.repeat(np.arange(at, to), count)
            i = np.repeat(low[at:to] - np.cumsum(count) + count, count) + np.arange(len(j))
            k = _passing(rows, i, j, percent)
            i, j = i[k], j[k]
            if len(j):
                later = (rows["doc_id"][i] > rows["doc_id"][j]) | ((rows["doc_id"][i] == rows["doc_id"][j]) & (rows["line"][i] > rows["line"][j]))
                i, j = np.where(later, j, i), np.where(later, i, j)
                i, j = i[rows["asked"][j]], j[rows["asked"][j]]
            if len(j):
                if first is not None:
                    order = np.argsort(j, kind="stable")
                    i, j = i[order], j[order]
                    starts = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]]))
                    nth = np.arange(len(j)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(j)]])))
                    more = np.unique(rows["key"][j[nth == first]])
                    i, j = i[nth < first], j[nth < first]
                else:
                    more = np.empty(0, np.int64)
                pairs = np.unique(np.stack([rows["key"][i], rows["key"][j]], 1), axis=0)
                kind = np.repeat(np.array([0, 1], np.int32), [len(pairs), len(more)])
                yield pa.RecordBatch.from_pydict({"kind": kind, "a": np.concatenate([pairs[:, 0], np.zeros(len(more), np.int64)]), "b": np.concatenate([pairs[:, 1], more])})
            at = to

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        waiting: list[pa.RecordBatch] = []

        def met() -> Iterator[pa.RecordBatch]:
            nonlocal held
            new = pa.Table.from_batches(waiting)
            columns = {c: new.column(c).to_numpy() for c in _COLUMNS}
            for c in "pq":
                columns[c] = columns[c].view(np.uint64)
            done = len(held.get("tn", ()))
            if done:
                columns = {c: np.concatenate([held[c], columns[c]]) for c in _COLUMNS}
            yield from taken(columns, done)
            # Rows to come may meet those of the last node that aren't too small.
            last = int(columns["tn"][-1])
            n = last & ((1 << _PLACE_BITS) - 1)
            cut = int(np.searchsorted(columns["tn"], (last - n) | -(-percent * n // 100)))
            held = {c: columns[c][cut:].copy() for c in _COLUMNS}
            waiting.clear()

        for batch in frames:
            if batch.num_rows:
                waiting.append(batch)
                if sum(x.num_rows for x in waiting) >= _ROWS:
                    yield from met()
        if waiting:
            yield from met()

    return run


def _met(rows: DataFrame, percent: int, first: int | None) -> DataFrame:
    return stored(dealt(rows).mapInArrow(_candidates(percent, first), TAKEN).distinct(), "candidates")


def near_asked(marked: DataFrame, percent: int) -> DataFrame:
    """The rows of marked (prefix rows with asked) that an asked row of the same token may have as its like by the length, positional and rank filters.

    Sizes go by cells of a sixth of a doubling. The place of the smaller set's row must lie in the shorter prefix, which holds
    2p / (100 + p) of the set behind it; so a row that lies beyond it is met by asked rows of smaller or equal sets only, which
    lie within it (and by itself, as it takes part). Only classes of a lower rank than an asked one are its candidates.
    """
    cell = lambda n: F.floor(F.log2(n.cast("double")) * 6).cast("int")
    n, at = F.col("n"), F.shiftright("pl", 32)
    early = (100 + percent) * (n - at) >= 2 * percent * n
    low, high = cell(F.ceil(n * percent / 100)), cell(F.floor(n * 100 / percent))
    upto = F.when(early, high).otherwise(cell(n))
    kinds = F.array(F.struct(F.lit(True).alias("early"), F.sequence(low, upto).alias("cells")), F.struct(F.lit(False).alias("early"), F.sequence(cell(n), F.when(early, high).otherwise(cell(n))).alias("cells")))
    asked = marked.where("asked").select("token", "doc_id", F.explode(kinds).alias("k")).select("token", "doc_id", F.col("k.early").alias("__early"), F.explode("k.cells").alias("__cell"))
    asked = stored(asked.groupBy(F.col("token").alias("__token"), "__early", "__cell").agg(F.max("doc_id").alias("__last")), "asked-tokens")
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    met = (F.col("token") == F.col("__token")) & (early == F.col("__early")) & (cell(n) == F.col("__cell")) & (F.col("doc_id") <= F.col("__last"))
    return marked.join(asked, met, "left_semi")


def _all_candidates(rows: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """Every candidate pair (a, b) of the open classes b; only rows that may be like theirs take part."""
    n = open_.count()
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    marked = rows.drop("asked").join(small(open_, n), F.col("key") == F.col("__open"), "left").withColumn("asked", F.col("__open").isNotNull()).drop("__open")
    return _met(near_asked(marked, percent), percent, None).select("a", "b")


def _similar(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, min_words: int) -> DataFrame:
    """The pairs (a, b) of keys whose full sets are similar, stored."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(classes.select("key", "rank"), "key")
    wanted = stored(wanted.groupBy(F.col("rank.doc_id").alias("__id")).agg(F.collect_list(F.col("rank.line").cast("long")).alias("__wanted")), "wanted-lines")
    if (wanted.agg(F.sum(F.size("__wanted"))).first()[0] or 0) <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, F.col("doc_id") == F.col("__id")).select("text", "__wanted")
    sets = texts.mapInArrow(_token_sets(min_words, percent), "key long, words binary").groupBy("key").agg(F.first("words").alias("words"))
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("words").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("words").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInPandas(_confirmed(percent), "a long, b long"), "similar-lines")


def removed(docs: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, line, start and end (in characters) of every line of docs(doc_id, text) that goes."""
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = stored(docs.mapInArrow(_lines(rarity(docs), percent, min_words), LINE), "lines")
    rank = F.struct("doc_id", "line")
    classes = stored(lines.groupBy("key").agg(F.min(rank).alias("rank"), F.count("*").alias("copies")), "line-classes")
    # Of equal sets only the first line's prefix is looked at. Repeated rows of one doc_id have more than one such line.
    others = lines.select("key", "doc_id", "line").join(classes.where("copies > 1").select(F.col("key").alias("__key"), "rank"), F.col("key") == F.col("__key")).where(rank != F.col("rank")).select(F.col("doc_id").alias("__doc"), F.col("line").alias("__line"))
    others = stored(others, "other-lines")
    if others.count() <= BROADCAST_ROWS:
        others = F.broadcast(others)
    firsts = lines.join(others, (F.col("doc_id") == F.col("__doc")) & (F.col("line") == F.col("__line")), "left_anti")
    rows = prefixes(firsts)
    taken = _met(rows, percent, FIRST)
    later = _similar(docs, classes, taken.where("kind = 0").select("a", "b"), percent, min_words).select(F.col("b").alias("__later")).distinct()
    open_ = stored(taken.where("kind = 1").select(F.col("b").alias("__open")).join(later, F.col("__open") == F.col("__later"), "left_anti").distinct(), "open-classes")
    if open_.take(1):
        rest = _all_candidates(rows, open_, percent)
        later = later.unionByName(_similar(docs, classes, rest, percent, min_words).select(F.col("b").alias("__later"))).distinct()
    going = stored(classes.join(later, F.col("key") == F.col("__later"), "left").where("copies > 1 OR __later IS NOT NULL").select(F.col("key").alias("__key"), "rank", F.col("__later").isNotNull().alias("all")), "going")
    if going.count() <= BROADCAST_ROWS:
        going = F.broadcast(going)
    found = lines.select("doc_id", "line", "start", "end", "key").join(going, F.col("key") == F.col("__key"))
    return found.where(F.col("all") | (rank != F.col("rank"))).select("doc_id", "line", "start", "end")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed and the removed lines (line, start, end) of every row of docs(doc_id, text)."""
    gone = removed(docs, **options).distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "start", "end"))).alias("removed"))
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).alias("n_lines"))
    none = F.array().cast("array<struct<line: int, start: int, end: int>>")
    return rows.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce("removed", none).alias("removed"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs without the lines that go, and without the documents that lose all their words so; n_chars, if there is such a column, follows the text."""
    gone = removed(docs, **options).groupBy("doc_id").agg(F.collect_set("line").alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("was"))
    rows = rows.join(gone, F.col("id") == F.col("doc_id"), "left")
    left = F.array_join(F.filter(F.split("was", "\n"), lambda _, i: ~F.array_contains("gone", i)), "\n")
    rows = rows.withColumn("text", F.when(F.col("gone").isNull(), F.col("was")).otherwise(left)).where(F.col("gone").isNull() | F.col("text").rlike(r"\S"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
