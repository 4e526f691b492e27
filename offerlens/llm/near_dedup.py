"""Near-duplicate documents by a chosen-path set similarity join.

1. Each document's set of word shingles is hashed; documents with equal sets are one class, which stands for them all from
   here on. A class has a signature of COORDINATES minwise tokens (16 bits each), and a sketch: one bit of each.
2. Trees. A node draws one or two coordinates (1 / SIMILARITY on average) from its own path; its classes go on to the child
   that their minwise token at the coordinate names. So two classes with similarity s share about s / SIMILARITY children of
   a node, and meet again and again if they are similar, but part soon if they aren't. All trees grow level by level; a
   node of NODE_ROWS classes or fewer is a leaf, and lone classes are dropped. A node that keeps most of its parent's classes is
   dense: its classes are alike, and splitting it further wouldn't help. (So are the large nodes at depth MAX_DEPTH.)
3. Leaves are compared exhaustively within, by their sketches. A dense node is dealt out in blocks, each with the
   node's pivots; at first a class takes part in two of its dense nodes only. Of the candidates a spanning forest is verified,
   on the full sets; it links what is alike with as many pairs as there are classes, not all pairs of a group.
4. Then every node is searched for candidates between classes that still lie in different components: leaves as a whole, dense
   nodes block by block, the classes outside the main component against all. Only the classes of such candidates are given, a
   row for each; their full sets meet in a task that verifies the candidates there and gives a spanning forest of those that
   hold. This is the exact way for whatever the first forest left, and no step makes more rows than a node's classes times its blocks.
5. Components of the verified links come from alternating stars (components.py).

The number of trees follows from the depth that nodes really reach: at depth 4 a tree keeps a pair that is just similar enough
together with a probability of about 0.57, at depth 12 of about 0.32. After TREES trees, independent ones are added until all of
them part such a pair with a probability of MISS at most, as at the deepest level of any (trees_for: with the spread of what a pair's
signatures agree on). More similar pairs are missed less often.

Cases. Texts without words, and null ones, have an empty set, which is linked with nothing. Shorter texts than a shingle are
one shingle. Rows with a null doc_id take part; a component's id is its least doc_id, null if it has none. Repeated rows are
one class, and all of them are kept if they have the least doc_id. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import SPACED, Words, mixed, only, pieces, shingles, stored
from offerlens.llm.components import components

COORDINATES, TREES, NODE_ROWS, MAX_DEPTH, DENSE = 256, 8, 512, 12, 0.7
#: The chance that a pair at the threshold shares no node at the end is this at most.
MISS = 0.001
#: Of the sketch's bits, a pair at the threshold agrees on so many standard deviations less than it should at the least.
SLACK = 3.7
PIVOTS = 3
#: Classes of a block of a dense node, in the first and in the second comparison; there a class is sent once for each block of the other side.
FIRST_ROWS, BLOCK_ROWS = 512, 512
#: Ids of documents whose sets are read again go to every task up to this number (8 bytes each); beyond it they are joined.
BROADCAST_IDS = 400_000
_A = np.random.default_rng(20).integers(1, 2**31, 1024, np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """Minwise tokens of each set of hashes; those of empty sets mean nothing."""
    values, a = (sets >> np.uint64(32)).astype(np.uint32)[:, None], _A[:coordinates]
    out = np.zeros((len(first) - 1, coordinates), np.uint32)
    room = np.empty((256, coordinates), np.uint32)
    for k, (start, end) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        for i in range(start, end, 256):
            part = room[: min(256, end - i)]
            np.multiply(values[i : i + len(part)], a, out=part)
            out[k] = part.min(0) if i == start else np.minimum(out[k], part.min(0))
    # The least value of a large set is small; its bits are spread again, so that any of them tells two apart.
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    out *= np.uint32(0x297A2D39)
    return (out >> np.uint32(16)).astype(np.uint16)


def set_key(sets: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(sets.tobytes()) - (1 << 63)


SIGNED = "doc_id long, n_shingles long, key long, signature binary"


def _signed(width: int, coordinates: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(frames):
            words = Words(texts, SPACED)
            sets, first = shingles(words.hash, words.first, width)
            tokens, n = signatures(sets, first, coordinates), np.diff(first)
            keys = [set_key(sets[s:e]) if e > s else None for s, e in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": n, "key": pa.array(keys, pa.int64()), "signature": pa.array([t.tobytes() if k else None for t, k in zip(tokens, n, strict=True)], pa.binary())})

    return run


CHILD = "path long, key long, parent long"


def _children(trees: range, coordinates: int, roots: int):
    """Rows of classes with their signatures go on to the children of their node (path), or of the root of each of these trees."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            if not (n := batch.num_rows):
                continue
            tokens = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(n, coordinates)
            keys = batch.column("key").to_numpy()
            if "path" in batch.schema.names:
                starts = [(batch.column("path").to_numpy().view(np.uint64), batch.column("parent").to_numpy())]
            else:
                starts = [(np.full(n, mixed(np.array([t + 1], np.uint64))[0]), np.full(n, roots)) for t in trees]
            for path, parent in starts:
                one = mixed(path ^ np.uint64(0xA5A5A5A5)) % np.uint64(coordinates)
                other = (one + np.uint64(1) + mixed(path ^ np.uint64(0x5A5A5A5A)) % np.uint64(coordinates - 1)) % np.uint64(coordinates)
                twice = mixed(path ^ np.uint64(0xC3C3C3C3)) % np.uint64(4) == 0
                for rows, picked in ((slice(None), one), (twice, other[twice])):
                    token = tokens[rows][np.arange(len(picked)), picked.astype(np.int64)].astype(np.uint64)
                    child = mixed(path[rows] * np.uint64(0x9E3779B97F4A7C15) + mixed(picked << np.uint64(32) | token))
                    yield pa.RecordBatch.from_pydict({"path": child.view(np.int64), "key": keys[rows], "parent": parent[rows]})

    return run


def _sketched(coordinates: int):
    """A bit of each minwise token, as whole numbers of 64 bits."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            if n := batch.num_rows:
                bits = np.packbits(np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(n, coordinates) >> 15, axis=1)
                bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))
                yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "n": batch.column("n"), "sketch": pa.FixedSizeListArray.from_arrays(pa.array(bits.view(np.int64).ravel()), bits.shape[1] // 8).cast(pa.list_(pa.int64()))})

    return run


SKETCH = "key long, n long, sketch array<long>"


def most_differing(coordinates: int, percent: int) -> int:
    """How many bits of their sketches two classes at the threshold differ in at the most."""
    p = (1 - percent / 100) / 2
    return int(coordinates * p + SLACK * (coordinates * p * (1 - p)) ** 0.5)


class Node:
    """The classes of one node: a row for each, without repeats of one side."""

    def __init__(self, columns: dict[str, np.ndarray]):
        both = np.stack([columns["key"], columns["side"]]) if "side" in columns else columns["key"][None]
        at = np.unique(both, axis=1, return_index=True)[1]
        self.columns = {c: x[at] for c, x in columns.items()}
        self.key, self.n, self.sketch = self.columns["key"], self.columns["n"], self.columns["sketch"]
        self.node = int(self.columns["node"][0])

    def differ(self, of: np.ndarray, percent: int) -> np.ndarray:
        """In how many bits the sketches of these rows differ from every other one's; a large number where the sizes rule a pair out."""
        out = np.zeros((len(of), len(self.key)), np.int32)
        for k in range(self.sketch.shape[1]):
            out += np.bitwise_count(self.sketch[of, k, None] ^ self.sketch[None, :, k])
        n = self.n
        out[np.minimum(n[of, None], n[None]) * 100 < percent * np.maximum(n[of, None], n[None])] = 1 << 20
        out[self.key[of, None] == self.key[None]] = 1 << 20
        return out

    def crossing(self, percent: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """A row and the rows of other components, and of the other side if there are sides, that it is a candidate with; some rows at a time."""
        root, side = self.columns["root"], self.columns["side"]
        for start in range(0, len(self.key), 256):
            of = np.arange(start, min(start + 256, len(self.key)))
            of = of[side[of] != 0]
            fits = (self.differ(of, percent) <= most) & (root[of, None] != root[None]) & ((side[of, None] < 0) | (side[None] == 0))
            for i in np.flatnonzero(fits.any(1)):
                yield int(of[i]), np.flatnonzero(fits[i])


#: Nodes of so many rows are small; pairs of small nodes' rows that are looked at in one go.
_SMALL, _PAIRS = 64, 250_000


def _promising(x: dict[str, np.ndarray], starts: np.ndarray, percent: int, most: int) -> np.ndarray:
    """Which groups of rows hold a candidate pair, of different components if there are such. Large groups are taken to."""
    size = np.diff(starts)
    found = size > _SMALL
    group = np.repeat(np.arange(len(size)), size)
    counts = np.where(found[group], 0, np.arange(len(group)) - starts[:-1][group])
    upto, at = np.cumsum(counts), 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _PAIRS, "right")))
        j = np.repeat(np.arange(at, to), counts[at:to])
        i = np.arange(len(j)) + np.repeat(starts[:-1][group[at:to]] - np.cumsum(counts[at:to]) + counts[at:to], counts[at:to])
        good = (np.minimum(x["n"][i], x["n"][j]) * 100 >= percent * np.maximum(x["n"][i], x["n"][j])) & (x["key"][i] != x["key"][j])
        if "root" in x:
            good &= x["root"][i] != x["root"][j]
        i, j = i[good], j[good]
        found[group[j[np.bitwise_count(x["sketch"][i] ^ x["sketch"][j]).sum(1) <= most]]] = True
        at = to
    return np.flatnonzero(found)


def nodes(frames: Iterator[pa.RecordBatch], percent: int, most: int) -> Iterator[Node]:
    """The nodes with a candidate pair, and all large ones, of rows sorted by node; a node's rows may go on in the next batch."""
    held: list[pa.RecordBatch] = []

    def found(batches: list[pa.RecordBatch]) -> Iterator[Node]:
        table = pa.Table.from_batches(batches).combine_chunks()
        x = {c: table.column(c).chunk(0).to_numpy(zero_copy_only=False) for c in table.schema.names if c != "sketch"}
        x["sketch"] = table.column("sketch").chunk(0).flatten().to_numpy().view(np.uint64).reshape(len(table), -1)
        starts = np.concatenate([[0], np.flatnonzero(x["node"][1:] != x["node"][:-1]) + 1, [len(table)]])
        for k in _promising(x, starts, percent, most).tolist():
            yield Node({c: v[starts[k] : starts[k + 1]] for c, v in x.items()})

    for batch in frames:
        if batch.num_rows:
            of = batch.column("node").to_numpy()
            last = int(np.flatnonzero(of == of[-1])[0])
            if last or (held and held[-1].column("node")[-1].as_py() != of[0]):
                done = [*held, *([batch.slice(0, last)] if last else [])]
                yield from found(done)
                held = []
            held.append(batch.slice(last))
    if held:
        yield from found(held)


#: kind 0: a candidate pair of classes; 1: a node (a) that has more of them.
PAIR = "kind int, a long, b long"


def _forest(coordinates: int, percent: int):
    """Of each node: a spanning forest of its candidates, the most alike first; and its id if it has more of them."""
    most = most_differing(coordinates, percent)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for x in nodes(frames, percent, most):
            differ = x.differ(np.arange(len(x.key)), percent)
            near = (differ <= most).sum(1)
            if not near.any():
                continue
            rows = np.flatnonzero(near)
            differ, keys, n_forest = differ[np.ix_(rows, rows)], x.key[rows], 0
            best, by, todo = np.full(len(rows), 1 << 20), np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
            for _ in range(len(rows)):
                at = int(np.where(todo, best, 1 << 21).argmin())
                if best[at] <= most:
                    out.append((0, int(keys[by[at]]), int(keys[at])))
                    n_forest += 1
                todo[at] = False
                nearer = todo & (differ[at] < best)
                best[nearer], by[nearer] = differ[at][nearer], at
            if near.sum() // 2 > n_forest:
                out.append((1, x.node, 0))
            if len(out) > 50_000:
                yield from rows_of(out)
                out = []
        yield from rows_of(out)

    return run


def rows_of(pairs: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        kind, a, b = zip(*pairs, strict=True)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "a": a, "b": b})


MEMBER = "node long, key long, root long, side int, n long, sketch array<long>"


def _crossing(coordinates: int, percent: int):
    """Of each node: the rows that are candidates with a row of another component."""
    most = most_differing(coordinates, percent)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in nodes(frames, percent, most):
            found = np.zeros(len(x.key), bool)
            for i, others in x.crossing(percent, most):
                found[i] = True
                found[others] = True
            if found.any():
                own = {c: v[found] for c, v in x.columns.items()}
                own["sketch"] = pa.FixedSizeListArray.from_arrays(pa.array(own["sketch"].view(np.int64).ravel()), x.sketch.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({c.split()[0]: own[c.split()[0]] for c in MEMBER.split(", ")})

    return run


def _verified(coordinates: int, percent: int):
    """Of each node: a spanning forest of the candidates between components whose full sets are similar."""
    most = most_differing(coordinates, percent)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in nodes(frames, percent, most):
            root, sets = x.columns["root"].copy(), [np.frombuffer(w, np.uint64) for w in x.columns["words"]]
            out = []
            for i, others in x.crossing(percent, most):
                others = others[root[others] != root[i]]
                if not len(others):
                    continue
                n = np.array([len(sets[j]) for j in others])
                every = np.concatenate([sets[j] for j in others])
                at = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
                both = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.cumsum(n) - n)
                for j in others[100 * both >= percent * (n + len(sets[i]) - both)]:
                    if root[i] != root[j]:
                        out.append((int(x.key[i]), int(x.key[j])))
                        root[root == root[j]] = root[i]
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    return run


def _sets(width: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(frames):
            words = Words(texts, SPACED)
            sets, first = shingles(words.hash, words.first, width)
            own = {set_key(x): x.tobytes() for s, e in zip(first[:-1], first[1:], strict=True) if len(x := sets[s:e])}
            yield pa.RecordBatch.from_pydict({"key": pa.array(own.keys(), pa.int64()), "words": pa.array(own.values(), pa.binary())})

    return run


def _confirmed(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for x, y in zip(frame["x"], frame["y"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield frame.loc[keep, ["a", "b"]]

    return run


def _full_sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """key and words (its sorted hashes) of these classes, read again from a document of each."""
    wanted = stored(keys.join(classes.select("key", "first_id"), "key"), "wanted").select(F.col("key").alias("__key"), F.col("first_id").alias("__id"))
    small = wanted.count() <= BROADCAST_IDS
    ids, own = wanted.select("__id").distinct(), wanted.select("__key")
    texts = docs.join(F.broadcast(ids) if small else ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(width), "key long, words binary")
    return sets.join(F.broadcast(own) if small else own, F.col("key") == F.col("__key"), "left_semi").groupBy("key").agg(F.first("words").alias("words"))


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough, stored."""
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "pairs")
    sets = _full_sets(docs, classes, pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).select(F.col("a").alias("key")).distinct(), width)
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("words").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("words").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInPandas(_confirmed(percent), "a long, b long"), "confirmed")


def trees_for(depth: int, percent: int, coordinates: int, miss: float = MISS) -> int:
    """How many trees part a pair at the threshold with a probability of miss at most if all nodes are as deep as that."""
    s, agreed = percent / 100, np.arange(coordinates + 1) / coordinates
    logs = np.array([math.lgamma(coordinates + 1) - math.lgamma(k + 1) - math.lgamma(coordinates - k + 1) + k * math.log(s) + (coordinates - k) * math.log(1 - s) if 0 < s < 1 else (0.0 if k == coordinates else -math.inf) for k in range(coordinates + 1)])
    parted = np.zeros(coordinates + 1)
    for _ in range(depth):  # a node has one child for the pair's sake, and a second one with probability 1/4
        one = 1 - agreed + agreed * parted
        parted = one * (0.75 + 0.25 * one)
    trees = 1
    while (np.exp(logs) * parted**trees).sum() > miss and trees < 1_000:
        trees += 1
    return trees


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, trees: int = TREES, node_rows: int = NODE_ROWS, max_depth: int = MAX_DEPTH, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs(doc_id, text)."""
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = stored(docs.mapInArrow(_signed(width, coordinates), SIGNED), "signed")
    classes = stored(signed.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.first("signature").alias("signature")), "classes")
    roots = classes.count()

    # Trees: some at first, then as many more as the deepest level asks for.
    leaves, dense, grown, deepest = [], [], 0, 0
    while grown < trees:
        own = range(grown, trees)
        frontier = classes.select("key", "signature").mapInArrow(_children(own, coordinates, roots), CHILD)
        for depth in range(1, max_depth + 1):
            counts = stored(frontier.groupBy("path").agg(F.count("*").alias("n"), F.max("parent").alias("parent")).where("n > 1"), "counts")
            rows = stored(frontier.drop("parent").join(counts, "path"), "level")
            leaves.append(rows.where(F.col("n") <= node_rows).select(F.col("path").alias("node"), "key"))
            alike = F.lit(True) if depth == max_depth else F.col("n") >= DENSE * F.col("parent")
            large = rows.where(F.col("n") > node_rows)
            dense.append(large.where(alike).select("path", "key", "n"))
            more = large.where(~alike)
            deepest = max(deepest, depth)
            if depth == max_depth or not counts.where((F.col("n") > node_rows) & ~alike).take(1):
                break
            frontier = more.select("path", "key", F.col("n").alias("parent")).join(classes.select("key", "signature"), "key").mapInArrow(_children(own, coordinates, roots), CHILD)
        grown, trees = trees, max(trees, trees_for(deepest, percent, coordinates))
    for frames in (leaves, dense):
        while len(frames) > 1:
            frames[0] = frames[0].unionByName(frames.pop())
    leaves, dense = leaves[0], dense[0]

    # A first forest: every leaf, and of each class two dense nodes, dealt out in blocks that share some pivots.
    sketches = stored(classes.mapInArrow(_sketched(coordinates), SKETCH), "sketches")
    blocks = lambda n, rows: F.ceil(F.col(n) / rows).cast("int")
    every = lambda n, rows: F.explode(F.sequence(F.lit(0), blocks(n, rows) - 1))
    chosen = dense.groupBy("key").agg(F.array_distinct(F.array(F.min("path"), F.max("path"))).alias("paths")).select(F.explode("paths").alias("path"), "key")
    firsts = chosen.groupBy("path").agg(F.count("*").alias("n"), *[F.min(F.struct(F.xxhash64("key", F.lit(i)).alias("h"), "key"))["key"].alias(f"p{i}") for i in range(PIVOTS)])
    of_block = lambda block: F.xxhash64("path", block)
    dealt = chosen.join(firsts.select("path", "n"), "path").select(of_block(F.pmod(F.xxhash64("key", "path"), blocks("n", FIRST_ROWS)).cast("int")).alias("node"), "key")
    pivots = firsts.select("path", every("n", FIRST_ROWS).alias("block"), F.array(*[f"p{i}" for i in range(PIVOTS)]).alias("p")).select(of_block("block").alias("node"), F.explode("p").alias("key"))
    members = leaves.unionByName(dealt).unionByName(pivots)
    met = members.join(sketches, "key").select("node", "key", "n", "sketch").repartition("node").sortWithinPartitions("node")
    pairs = stored(met.mapInArrow(_forest(coordinates, percent), PAIR), "forest")
    links = _links(docs, classes, pairs.where("kind = 0").select("a", "b"), width, percent)
    roots_of = components(links).withColumnRenamed("node", "node_")
    rooted = lambda df: df.join(roots_of, F.col("key") == F.col("node_"), "left").withColumn("root", F.coalesce("root", "key")).drop("node_")

    # What still lies in different components.
    again = pairs.where("kind = 1").select(F.col("a").alias("node")).distinct()
    small = rooted(leaves.join(again, "node", "left_semi")).withColumn("side", F.lit(-1))
    parts = rooted(dense)
    tally = parts.groupBy("path", "root").agg(F.count("*").alias("c")).groupBy("path").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.max("c").alias("c"), F.sum("c").alias("all"))
    tally = tally.where(F.col("c") < F.col("all")).withColumn("__minor", F.col("all") - F.col("c"))
    mixed_nodes = parts.join(tally, "path")
    block = lambda n: F.pmod(F.xxhash64("key", F.lit(1)), blocks(n, BLOCK_ROWS)).cast("int")
    theirs = mixed_nodes.select("path", "key", "root", every("__minor", BLOCK_ROWS).alias("i"), block("n").alias("j"), F.lit(0).alias("side"))
    minor = mixed_nodes.where(F.col("root") != F.col("main")).select("path", "key", "root", block("__minor").alias("i"), every("n", BLOCK_ROWS).alias("j"), F.lit(1).alias("side"))
    large = theirs.unionByName(minor).select(F.xxhash64("path", "i", "j").alias("node"), "key", "root", "side")
    met = small.select("node", "key", "root", "side").unionByName(large).join(sketches, "key").repartition("node").sortWithinPartitions("node")
    crossing = stored(met.mapInArrow(_crossing(coordinates, percent), MEMBER), "crossing")
    sets = _full_sets(docs, classes, crossing.select("key").distinct(), width)
    met = crossing.join(sets, "key").repartition("node").sortWithinPartitions("node")
    more_links = stored(met.mapInArrow(_verified(coordinates, percent), "a long, b long"), "more-links")
    if more_links.take(1):
        roots_of = components(links.unionByName(more_links)).withColumnRenamed("node", "node_")

    # Every row's component.
    labelled = rooted(classes.select("key", "first_id"))
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = stored(labelled.join(least, "root").select(F.col("key").alias("__key"), "component_id"), "of-class")
    found = signed.select("doc_id", "n_shingles", "key").join(of_class, F.col("key") == F.col("__key"), "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: one of each component, its least doc_id (repeated rows of it once), and all without a doc_id."""
    found = near_duplicates(docs, **options).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    stay = rows.where("id IS NOT NULL").join(found, F.col("id") == F.col("doc_id"), "left_semi").dropDuplicates(["id"])
    return stay.unionByName(rows.where("id IS NULL")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
