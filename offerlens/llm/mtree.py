"""Exact top-k search by inner product with an M-tree.

Vectors are whole numbers: floor(scale * x) of each component, as doubles. Their metric is the Euclidean distance d, and an inner product
follows from it: 2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2. So an upper bound of the inner product is a lower bound of the distance together
with the largest norm below a node.

Tree. Each task loads its rows, in blocks of TREE_ROWS, in bulk: rows go to the nearest of some pivots, again and again, until a
node fits a page (PAGE entries). A node keeps its centre, the covering radius, the distance to its parent's centre and the largest norm
below it; a row keeps the distance to its page's centre and its norm. A node whose rows all are equally near to every pivot (copies)
is dealt into pages by order.

Search. Best first: nodes wait in a heap by their bound, and the search ends as the best bound is below the k-th score. Of an open
node's children the stored distances are tried first: |d(q, parent) - d(parent, child)| - radius bounds d(q, x) from below without a
distance of the child's own; only those that pass are computed. The rows of a page likewise. Bounds have a slack for rounding;
scores are computed in whole numbers, so the result is exact. On vectors without any clusters the bounds exclude little, and every row is
looked at; that costs time, never a row.

Queries are a stated set. They go to the tasks in blocks of QUERY_BLOCK vectors, and each task gives k rows a query at most; those
are what is shuffled. Blocks follow one another, so neither the driver nor a task holds more than one.

Cases. Vectors that are null or hold null or non-finite components, and rows without an id, take no part; zero and empty vectors do. Vectors of
different lengths meet as if zeros followed the shorter one. A query's own id is no candidate, on however many rows it stands;
other repeated rows each count. Of a query id on several rows, the least vector asks. Ties go to the smaller id. Scores are exact in 64 bits;
vectors whose products could pass that are computed with Python's whole numbers, and a score outside 64 bits is an error. Extra
columns are ignored. Empty tables, or no queries, give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import batches, stored

#: Vectors of one block of queries: 16 MB at 64 components.
QUERY_BLOCK = 32_768
#: Rows of one tree; a task with more builds one after another.
TREE_ROWS = 65_536
#: Entries of a page, which is a node's children or a leaf's rows.
PAGE = 256
#: Below this norm the products of two vectors are exact in doubles.
EXACT_NORM = 2.0**26
FOUND = "query_id long, vec_id long, score long"


def whole(vectors: pd.Series, scale: int) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector, as doubles; null for those that take no part."""
    out = []
    for v in vectors:
        x = None if v is None else np.asarray([np.nan if c is None else c for c in v] if not isinstance(v, np.ndarray) or v.dtype == object else v, np.float64)
        out.append(None if x is None or not np.isfinite(x).all() else np.floor(scale * x))
    return out


def padded(vectors: list[np.ndarray], dim: int) -> np.ndarray:
    """The vectors as rows of one array, with zeros behind the shorter ones; dim is the least width."""
    out = np.zeros((len(vectors), max([dim, *map(len, vectors)])))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Tree:
    """An M-tree over the rows of x. Nodes are numbered from 0, the root, and children of a node follow one another."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, page: int = PAGE, seed: int = 7):
        self.rng, self.page = np.random.default_rng(seed), page
        self.exact = not len(x) or float(np.sqrt((x * x).sum(1)).max()) < EXACT_NORM
        centres, radius, far, first, last, leaf, parts = [], [], [], [], [], [], []

        def node(rows: np.ndarray, parent: np.ndarray | None) -> np.ndarray:
            centre = x[rows].mean(0)
            centres.append(centre)
            radius.append(float(np.sqrt(((x[rows] - centre) ** 2).sum(1).max())))
            far.append(0.0 if parent is None else float(np.sqrt(((centre - parent) ** 2).sum())))
            first.append(0), last.append(0), leaf.append(True), parts.append(rows)
            return rows

        node(np.arange(len(x)), None)
        at = 0
        while at < len(parts):
            rows = parts[at]
            if len(rows) > page:
                first[at], leaf[at] = len(parts), False
                for part in self._divided(x, rows):
                    node(part, centres[at])
                last[at], parts[at] = len(parts), None
            at += 1
        start = 0
        order = []
        for i, rows in enumerate(parts):
            if rows is not None:
                first[i], last[i] = start, start + len(rows)
                start += len(rows)
                order.append(rows)
        order = np.concatenate(order)
        self.ids, self.x = ids[order], x[order]
        self.centre, self.radius, self.far = np.array(centres), np.array(radius), np.array(far)
        self.first, self.last, self.leaf = np.array(first), np.array(last), np.array(leaf)
        self.norm2 = (self.x**2).sum(1)
        self.own = np.zeros(len(self.x))
        self.top = np.zeros(len(first))
        for i in range(len(first) - 1, -1, -1):
            own = slice(self.first[i], self.last[i])
            if self.leaf[i]:
                self.own[own] = np.sqrt(((self.x[own] - self.centre[i]) ** 2).sum(1))
            self.top[i] = (self.norm2 if self.leaf[i] else self.top)[own].max()
        #: Distances and products that searches have computed, and all that there were.
        self.computed = 0

    def _divided(self, x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        pivots = x[self.rng.choice(rows, min(self.page, -(-len(rows) // self.page) + 1), replace=False)]
        own = x[rows]
        near = np.argmin((pivots**2).sum(1) - 2 * own @ pivots.T, axis=1)
        parts = [rows[near == j] for j in np.unique(near)]
        if len(parts) == 1:
            return np.array_split(rows, min(self.page, -(-len(rows) // self.page)))
        return parts

    def _bound(self, q2: float, top: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """The largest inner product of a query with vectors of at most these norms (squared), at these distances at least."""
        gap = np.maximum(0.0, gap)
        return (q2 + top - gap * gap) / 2 + 1e-9 * (q2 + top) + 1e-6

    def _scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.exact and float(q @ q) < EXACT_NORM**2:
            return (self.x[rows] @ q).astype(np.int64)
        own = [int(c) for c in q]
        return np.array([sum(int(a) * b for a, b in zip(v, own, strict=True)) for v in self.x[rows]], np.int64)

    def search(self, query: int, q: np.ndarray, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, those below least left out."""
        q2 = float(q @ q)
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        floor = -np.inf if least is None else float(least)
        distance = float(np.sqrt(((self.centre[0] - q) ** 2).sum()))
        heap = [(-float(self._bound(q2, self.top[:1], np.array([distance - self.radius[0]]))[0]), 0, distance)]
        self.computed += 1
        while heap and -heap[0][0] >= floor:
            _, i, distance = heapq.heappop(heap)
            own = np.arange(self.first[i], self.last[i])
            if self.leaf[i]:
                rows = own[self._bound(q2, self.norm2[own], np.abs(distance - self.own[own])) >= floor]
                rows = rows[self.ids[rows] != query]
                if not len(rows):
                    continue
                self.computed += len(rows)
                own_scores = self._scores(q, rows)
                hit = own_scores >= floor
                if not hit.any():
                    continue
                ids, scores = np.concatenate([ids, self.ids[rows[hit]]]), np.concatenate([scores, own_scores[hit]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    floor = max(floor, float(scores[-1]))
            else:
                child = own[self._bound(q2, self.top[own], np.abs(distance - self.far[own]) - self.radius[own]) >= floor]
                if not len(child):
                    continue
                self.computed += len(child)
                d = np.sqrt(((self.centre[child] - q) ** 2).sum(1))
                bound = self._bound(q2, self.top[child], d - self.radius[child])
                for b, c, far in zip(bound.tolist(), child.tolist(), d.tolist(), strict=True):
                    if b >= floor:
                        heapq.heappush(heap, (-b, c, far))
        return ids, scores


def _search(q_ids: np.ndarray, q_x: np.ndarray, k: int, scale: int, page: int):
    """The task: a tree for each block of its rows, each query's best of all of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q_ids)
        held: list[tuple[np.ndarray, list[np.ndarray]]] = []
        n = 0

        def looked_up() -> None:
            x = padded([v for _, part in held for v in part], q_x.shape[1])
            tree = Tree(np.concatenate([ids for ids, _ in held]), x, page)
            asked = np.pad(q_x, ((0, 0), (0, x.shape[1] - q_x.shape[1])))
            for i, (query, q) in enumerate(zip(q_ids, asked, strict=True)):
                ids, scores = found[i]
                more = tree.search(int(query), q, k, int(scores[-1]) if len(ids) == k else None)
                ids, scores = np.concatenate([ids, more[0]]), np.concatenate([scores, more[1]])
                best = np.lexsort((ids, -scores))[:k]
                found[i] = ids[best], scores[best]

        for frame in batches(frames):
            vectors = whole(frame["embedding"], scale)
            keep = [i for i, v in enumerate(vectors) if v is not None]
            if keep:
                held.append((frame["vec_id"].to_numpy(np.int64)[keep], [vectors[i] for i in keep]))
                n += len(keep)
            if n >= TREE_ROWS:
                looked_up()
                held, n = [], 0
        if held:
            looked_up()
        if len(q_ids):
            yield pd.DataFrame({"query_id": np.repeat(q_ids, [len(f[0]) for f in found]), "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])})

    return run


def best_products(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, page: int = PAGE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score (inner product of floor(scale * x)) of each query's k best rows of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    data = rows.select("vec_id", "embedding")
    asked = stored(rows.where(F.col("asks") & fine).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "asked")
    n_blocks = max(1, -(-asked.count() // query_block))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for i in range(n_blocks):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == i).orderBy("vec_id").toPandas()
        if not len(got):
            continue
        own = data.mapInPandas(_search(got["vec_id"].to_numpy(np.int64), padded(whole(got["embedding"], scale), 0), k, scale, page), FOUND)
        best = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if n_blocks > 1:
            best = stored(best, "best")
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out
