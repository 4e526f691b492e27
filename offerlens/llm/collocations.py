"""Phrases that occur together more often than their parts do, counted by prefix-free parsing.

Parsing. The words of a text are cut where its content says so: a window of OVERLAP words whose hash is 0 modulo PERIOD ends a chunk and
begins the next one, so neighbours overlap by these words, and equal passages give equal chunks wherever they stand. The distinct
chunks of a language are the dictionary, how often each occurs is the parse. An n-gram of OVERLAP + 1 words or fewer that begins in
a chunk lies in it as a whole; it is counted in the chunk in which it begins before the last OVERLAP words, or in the text's last chunk; so overlaps
count once. A chunk without a trigger ends after LONGEST words, wherever that is.

Counting. N-grams are counted inside distinct chunks, times the chunk's frequency: words first, then pairs of frequent words, then triples
of frequent pairs. Pairs and triples are summed by 64-bit hashes first; what reaches the least count is then counted by
its own words, so that the numbers are exact. Frequent words and pairs reach the tasks as bits of their hashes: 2 to the power of FILTER_BITS of them
at any size of the table. A full filter lets more n-grams into the shuffle, never fewer.

Nothing is kept together but sums: a word, pair or chunk that a third of all texts hold is added up in each task first.

Cases. Null texts are empty; a null lang is `und`. Texts without words give nothing. Scores are floored, ties of the cut go to
the shorter first part; phrases of equal score and count go by their bytes. Repeated rows count again. Extra columns are ignored. Empty
tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import Words, mixed, only, pieces, stored

#: Words by which chunks overlap: the longest phrase has one more.
OVERLAP = 2
#: A chunk has so many words on average, and so many at most.
PERIOD, LONGEST = 32, 4_096
FILTER_BITS = 27
#: Sums that a task holds before it gives them on.
HELD = 400_000
#: Parts into which a language's phrases are dealt before they are ranked.
DEALT = 16

_SPLIT = b".,;:!?\n\v\f\r"
#: What divides words becomes a space; A-Z are lower-cased.
_WORDS = bytes(32 if c == 9 or c in _SPLIT else c for c in range(256)).lower()
_ENDS = np.isin(np.arange(256), list(_SPLIT))


def chunks_of(texts: list[bytes | None], period: int = PERIOD, longest: int = LONGEST) -> Iterator[tuple[int, bool, bytes]]:
    """Number of the text, whether the chunk is its last one, and its words: a space between those of one piece, a line feed where a piece ends."""
    words = Words(texts, _WORDS)
    n = len(words.begin)
    if not n:
        return
    data = np.frombuffer(words.raw.translate(_WORDS), np.uint8)
    ends = np.concatenate([[0], np.cumsum(_ENDS[np.frombuffer(words.raw, np.uint8)])])
    # A word and what follows it: the next word begins a piece if a dividing mark stands between.
    following = np.append(words.begin[1:], len(data))
    parted = ends[following] > ends[words.end]
    size = words.end - words.begin + 1
    start = np.concatenate([[0], np.cumsum(size)])
    keep = np.zeros(len(data) + 1, np.int8)
    np.add.at(keep, words.begin, 1)
    np.add.at(keep, words.end, -1)
    inside = np.cumsum(keep[:-1]).astype(bool)
    inside[words.end] = True
    canonical = data.copy()
    canonical[words.end] = np.where(parted, 10, 32)
    canonical = canonical[inside].tobytes()
    first = words.first
    last = first[1:]
    text = np.searchsorted(last, np.arange(n), "right")
    trigger = mixed(words.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + words.hash[1:]) % np.uint64(period) == 0
    at = np.flatnonzero(trigger)
    at = at[(at > first[text[at]]) & (at + OVERLAP < last[text[at]])]
    begin = np.unique(np.concatenate([first[:-1][first[:-1] < last], at]))
    gap = np.diff(np.append(begin, n))
    for i in np.flatnonzero(gap > longest):  # few: stretches without a trigger
        to = min(begin[i] + gap[i], last[text[begin[i]]])
        begin = np.append(begin, np.arange(begin[i] + longest, to - OVERLAP, longest))
    begin.sort()
    own = text[begin]
    final = np.append(own[1:] != own[:-1], True)
    end = np.where(final, last[own], np.append(begin[1:], n) + OVERLAP)
    for t, f, b, e in zip(own.tolist(), final.tolist(), start[begin].tolist(), (start[end] - 1).tolist(), strict=True):
        yield t, f, canonical[b:e]


def _parse(period: int, longest: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            lang = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            found = Counter((lang[t], f, c) for t, f, c in chunks_of(texts, period, longest))
            if found:
                keys = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.bool_()), pa.array(keys[2], pa.binary()), pa.array(list(found.values()), pa.int64())], ["lang", "final", "chunk", "n"])

    return run


def dictionary(docs: DataFrame, period: int = PERIOD, longest: int = LONGEST) -> DataFrame:
    """lang, final, chunk and n, how often it occurs, of the distinct chunks of docs(text, lang)."""
    rows = only(docs, "text", "lang").select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    return rows.mapInArrow(_parse(period, longest), "lang string, final boolean, chunk binary, n long").groupBy("lang", "final", "chunk").agg(F.sum("n").alias("n"))


class Chunks:
    """N-grams of some chunks: where they begin, hashed and as they are written."""

    def __init__(self, batch: pa.RecordBatch):
        self.lang = np.array(batch.column(0).to_pylist(), object)
        final = np.array(batch.column(1).to_pylist(), bool)
        self.n = batch.column(3).to_numpy()
        words = Words(batch.column(2).to_pylist(), _LINES)
        self.words, self.first = words, words.first
        count = np.diff(words.first)
        self.chunk = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(words.hash)) - words.first[:-1][self.chunk]
        #: Words that begin n-grams of this chunk, and those that the next one of the text counts.
        self.counts = final[self.chunk] | (place < count[self.chunk] - OVERLAP)
        data = np.frombuffer(words.raw, np.uint8)
        goes_on = data[words.end] == 32
        self.joined = np.append(goes_on[:-1] & (self.chunk[1:] == self.chunk[:-1]), False) if len(goes_on) else goes_on
        seeds = {x: _text_hash(x) for x in set(self.lang)}
        self.seed = np.array([seeds[x] for x in self.lang], np.uint64)

    def keys(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the n-grams of so many words that begin there, with their language."""
        key = self.seed[self.chunk[at]]
        for i in range(length):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + self.words.hash[at + i])
        return key

    def grams(self, length: int) -> np.ndarray:
        """Where n-grams of so many words begin that count here and lie within a piece."""
        fits = self.counts.copy()
        for i in range(length - 1):
            fits[: len(fits) - i] &= self.joined[i:] if i else self.joined
            if i:
                fits[len(fits) - i :] = False
        return np.flatnonzero(fits)

    def spelled(self, at: np.ndarray, length: int) -> list[bytes]:
        raw = self.words.raw
        return [raw[b:e] for b, e in zip(self.words.begin[at].tolist(), self.words.end[at + length - 1].tolist(), strict=True)]


#: Words of a chunk are parted by spaces and line feeds alone.
_LINES = bytes(32 if c == 10 else c for c in range(256))


def _text_hash(text: str) -> int:
    h = np.uint64(14695981039346656037)
    with np.errstate(over="ignore"):
        for b in text.encode():
            h = (h ^ np.uint64(b)) * np.uint64(1099511628211)
    return int(mixed(np.array([h], np.uint64))[0])


class Filter:
    """Bits of hashes: whether one may be among those that were put in."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = keys & np.uint64(64 * len(self.bits) - 1)
        return (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


#: Bits of one row of a filter on its way to the driver.
_ROW = 1 << 16


def _bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task: the rows of a filter whose bits these places are."""
    rows: dict[int, np.ndarray] = {}
    for batch in batches:
        place = np.unique(batch.column(0).to_numpy()).astype(np.uint64)
        for row in np.unique(place // np.uint64(_ROW)).tolist():
            own = place[place // np.uint64(_ROW) == np.uint64(row)] % np.uint64(_ROW)
            np.bitwise_or.at(rows.setdefault(row, np.zeros(_ROW // 64, np.uint64)), own >> np.uint64(6), np.uint64(1) << (own & np.uint64(63)))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int64()), pa.array([b.tobytes() for b in rows.values()], pa.binary())], ["row", "bits"])


def filter_of(keys: DataFrame):
    """A broadcast filter of keys(key). The driver gets 2**FILTER_BITS bits at most, in rows of _ROW."""
    places = keys.select(F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("place"))
    rows = places.repartition(F.expr(f"place div {_ROW}")).mapInArrow(_bits, "row long, bits binary")
    bits = np.zeros(max(1 << FILTER_BITS, _ROW) // 64, np.uint64)
    for row in rows.toLocalIterator():
        bits[row.row * _ROW // 64 : (row.row + 1) * _ROW // 64] = np.frombuffer(row.bits, np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bits[: (1 << FILTER_BITS) // 64])


class _Sums:
    """Sums by language and phrase, as they are spelled."""

    def __init__(self) -> None:
        self.own: dict[str, Counter] = {}

    def add(self, lang: str, phrases: list[bytes], weight: int) -> None:
        own = self.own.setdefault(lang, Counter())
        if weight == 1:
            own.update(phrases)
        else:
            for phrase, n in Counter(phrases).items():
                own[phrase] += n * weight

    def __len__(self) -> int:
        return sum(map(len, self.own.values()))

    def out(self) -> pa.RecordBatch:
        lang = [x for x, own in self.own.items() for _ in own]
        phrases = [p.decode() for own in self.own.values() for p in own]
        n = [n for own in self.own.values() for n in own.values()]
        self.own.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrases, pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task: sums of words. Nothing is hashed: a chunk's words are what white space parts."""
    sums = _Sums()
    for batch in _parts(batches):
        groups: dict[tuple[str, int], list[bytes]] = {}
        for lang, final, chunk, n in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            words = chunk.split()
            groups.setdefault((lang, n), []).extend(words if final else words[:-OVERLAP])
        for (lang, n), words in groups.items():
            sums.add(lang, words, n)
        if len(sums) >= HELD:
            yield sums.out()
    if len(sums):
        yield sums.out()


def _counted(length: int, filters: list, spelled: bool):
    """The task: sums of n-grams of so many words, by hash or as they are spelled. filters: of the words, the pairs, the triples, as far as there are any."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        sums = _Sums()
        may = [Filter(f.value) for f in filters]

        def hashed() -> pa.RecordBatch:
            keys, own = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            total = np.bincount(own, np.concatenate([h[1] for h in held]))  # below 2**53 within one task
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total.astype(np.int64))], ["key", "n"])

        for batch in _parts(batches):
            chunks = Chunks(batch)
            at = chunks.grams(length)
            for n, passes in enumerate(may[:length], 1):
                for i in range(length - n + 1):
                    at = at[passes(chunks.keys(at + i, n))]
            weight = chunks.n[chunks.chunk[at]]
            if spelled and len(at):
                names, lang = np.unique(chunks.lang[chunks.chunk[at]].astype(str), return_inverse=True)
                order = np.lexsort((weight, lang))
                lang, weight = lang[order], weight[order]
                phrases = chunks.spelled(at[order], length)
                edges = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (weight[1:] != weight[:-1])])
                for b, e in zip(edges.tolist(), np.append(edges[1:], len(at)).tolist(), strict=True):
                    sums.add(str(names[lang[b]]), phrases[b:e], int(weight[b]))
                if len(sums) >= HELD:
                    yield sums.out()
            elif len(at):
                held.append((chunks.keys(at, length), weight))
                size += len(at)
                if size >= 2 * HELD:
                    yield hashed()
                    held, size = [], 0
        if held:
            yield hashed()
        if len(sums):
            yield sums.out()

    return run


def _parts(batches: Iterable[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows with chunks of about so many bytes together."""
    for batch in batches:
        sizes = np.cumsum([len(c) for c in batch.column(2).to_pylist()])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def counts(chunks: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Exact counts (lang, words, phrase, n) of the phrases of one to three words that occur so often, and all word occurrences (lang, n)."""
    words = stored(chunks.mapInArrow(_words, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    found = words.where(F.col("n") >= least).select("lang", F.lit(1).alias("words"), "phrase", "n")
    filters = [filter_of(found.select("lang", "phrase").mapInArrow(_keys, "key long"))]
    for length in (2, 3):
        keys = chunks.mapInArrow(_counted(length, list(filters), False), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        filters.append(filter_of(keys))
        own = chunks.mapInArrow(_counted(length, list(filters), True), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        found = found.unionByName(stored(own.select("lang", F.lit(length).alias("words"), "phrase", "n"), "phrases"))
    return found, total


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words as Chunks.keys has them."""
    for batch in batches:
        n = batch.num_rows
        if n:
            words = [w.encode() for w in batch.column(1).to_pylist()]
            chunks = Chunks(pa.RecordBatch.from_arrays([batch.column(0), pa.array([True] * n), pa.array(words, pa.binary()), pa.array([1] * n, pa.int64())], ["lang", "final", "chunk", "n"]))
            yield pa.RecordBatch.from_arrays([pa.array(chunks.keys(np.arange(len(chunks.words.hash)), 1).view(np.int64))], ["key"])


def collocations(docs: DataFrame, *, least: int = 10, inside: int = 50, first: int = 2_000, period: int = PERIOD, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases of two and three words in docs(text, lang).

    a: the phrase's count, at least `least`; l and r: those of its two parts at the cut that scores least, a * a / (l * r) in millionths; n: the
    language's words. A phrase inside a longer one that occurs at least inside percent as often is left out.
    """
    chunks = stored(dictionary(docs, period, longest), "chunks")
    found, total = counts(chunks, least)
    found = found.withColumn("parts", F.split("phrase", " "))
    phrases = found.where("words > 1")
    cuts = phrases.select("lang", "words", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "parts")
    cuts = cuts.select("lang", "words", "phrase", "a", "k", F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("parts", F.col("k") + 1, F.col("words")), " ").alias("right"))
    of = lambda side, n: found.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    sided = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    scored = sided.withColumn("score", F.expr("CAST(a AS decimal(15,0)) * CAST(a AS decimal(15,0)) * 1000000 div (CAST(l AS decimal(15,0)) * CAST(r AS decimal(15,0)))").cast("long"))
    best = scored.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    within = phrases.where("words = 3").select("lang", "n", F.explode(F.array_distinct(F.array(*[F.array_join(F.slice("parts", i, 2), " ") for i in (1, 2)]))).alias("phrase"))
    longer = within.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("longer") < F.lit(inside) * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    # A language may hold most phrases: each part gives its own first ones, then these are ranked.
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.join(total.withColumnRenamed("total", "n"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
