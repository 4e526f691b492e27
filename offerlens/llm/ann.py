"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Fit. On a bounded sample (SAMPLE_ROWS vectors, picked by a hash of their id) iterative quantisation learns rotations of the
centred vectors whose signs lose least; a code has one bit for each rotated axis. Of queries within the sample, the radius is
the Hamming distance that holds RECALL of their true neighbours there; the whole table's neighbours are nearer than those.

Search. Every row is indexed: each task cuts its rows' codes into substrings of eight bits and has a bucket table for each.
By the pigeonhole principle a code within radius r of a query agrees with it in some substring j up to t_j bits where
sum(t_j + 1) > r; so probing those buckets retrieves every code within the radius. Their floats are then compared in double
precision. A query with fewer than k codes within the radius gets an exact scan.

The queries are a stated set; they go to the tasks in blocks of QUERY_BLOCK, a bounded broadcast each. Only k rows a query
and task are shuffled, so that a vector that makes up a third of the table costs nothing extra.

Cases. Vectors that are null, zero, of another length than most of the sample, or that hold null or non-finite components
take no part. Rows with the query's own id aren't its neighbours, repeated rows of other ids each count. Ties go to the
smaller id. Extra columns are ignored. Empty tables, or no queries, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.llm.common import batches, stored

SAMPLE_ROWS = 12_000
QUERY_BLOCK = 4_096
#: Rows of one bucket index; a task with more builds one after another.
INDEX_ROWS = 65_536
RECALL = 0.985
FOUND = "query_id long, vec_id long, score double"
#: Bits that differ, of two bytes' exclusive or; and all bytes within so many bits of zero.
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_WITHIN = [np.flatnonzero(_ONES <= t).astype(np.uint8) for t in range(9)]


def usable(ids: pd.Series, vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (double precision) of the rows that take part."""
    keep = [i for i, (k, v) in enumerate(zip(ids, vectors, strict=True)) if v is not None and not pd.isna(k) and len(v) == dim]
    if not keep:
        return np.empty(0, np.int64), np.empty((0, dim))
    x = np.array([np.asarray(vectors.iloc[i], np.float64) for i in keep])
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    return ids.iloc[keep].to_numpy(np.int64)[fine], x[fine]


def _rotation(v: np.ndarray, rng: np.random.Generator, rounds: int) -> np.ndarray:
    """Iterative quantisation: alternates the signs and the orthogonal rotation that fits them best."""
    r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return r


@dataclass
class Codes:
    """Learned codes: signs of (x - mean) @ axes, packed in bytes, a byte for each substring."""

    mean: np.ndarray
    axes: np.ndarray
    radius: int = 0
    #: Bits in which substring j may differ; below zero: no need to look there.
    reach: list[int] = field(default_factory=list)

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.axes >= 0, axis=1)

    def within(self, radius: int) -> Codes:
        """The same codes, to be searched to this radius: the reaches add up so that any code within it is met."""
        m = self.axes.shape[1] // 8
        least, more = divmod(radius + 1, m)
        self.radius, self.reach = radius, [min(8, least + (j < more) - 1) for j in range(m)]
        return self


def fit(ids: np.ndarray, x: np.ndarray, k: int, bits: int, seed: int) -> Codes:
    rng, dim = np.random.default_rng(seed), x.shape[1]
    mean = x.mean(0)
    axes = np.linalg.eigh((x - mean).T @ (x - mean))[1][:, ::-1]
    v = (x - mean) @ axes
    rotated = [axes @ _rotation(v, rng, 25) for _ in range(-(-bits // dim))]
    codes = Codes(mean, np.hstack(rotated)[:, : bits // 8 * 8])
    packed, met = codes.of(x), []
    for i in range(0, min(len(x), 300)):
        d = ((x - x[i]) ** 2).sum(1)
        d[ids == ids[i]] = np.inf
        near = np.argsort(d, kind="stable")[:k]
        met.append(_ONES[packed[near[np.isfinite(d[near])]] ^ packed[i]].sum(1))
    met = np.concatenate(met) if met else np.empty(0)
    return codes.within(int(np.quantile(met, RECALL, method="higher")) if len(met) else codes.axes.shape[1])


class Index:
    """Bucket tables of one block of rows."""

    def __init__(self, codes: Codes, ids: np.ndarray, x: np.ndarray):
        self.codes, self.ids, self.x, self.packed = codes, ids, x, codes.of(x)
        self.order, self.start = [], []
        for j in range(self.packed.shape[1]):
            self.order.append(np.argsort(self.packed[:, j], kind="stable"))
            self.start.append(np.searchsorted(self.packed[self.order[j], j], np.arange(257)))

    def rows_within(self, code: np.ndarray) -> np.ndarray:
        """Every row whose code is within the radius."""
        hit = np.zeros(len(self.ids), bool)
        for j, reach in enumerate(self.codes.reach):
            if reach >= 0:
                start, order = self.start[j], self.order[j]
                for b in (_WITHIN[reach] ^ code[j]).tolist():
                    hit[order[start[b] : start[b + 1]]] = True
        rows = np.flatnonzero(hit)
        return rows[_ONES[self.packed[rows] ^ code].sum(1) <= self.codes.radius]

    def nearest(self, query: int, q: np.ndarray, code: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(self.ids)) if code is None else self.rows_within(code)
        rows = rows[self.ids[rows] != query]
        d = ((self.x[rows] - q) ** 2).sum(1)
        if len(rows) > k:
            near = d <= np.partition(d, k - 1)[k - 1]
            rows, d = rows[near], d[near]
        best = np.lexsort((self.ids[rows], d))[:k]
        return self.ids[rows[best]], np.sqrt(d[best])


def _search(codes: Codes, queries: tuple[np.ndarray, np.ndarray], k: int, exact: bool):
    """The task: indexes its rows block by block and gives each query's k nearest of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q_x = queries
        if not len(q_ids):
            return
        q_codes, held, n = codes.of(q_x), [], 0

        def answers() -> pd.DataFrame:
            index = Index(codes, *(np.concatenate(part) for part in zip(*held, strict=True)))
            found = [index.nearest(i, x, None if exact else c, k) for i, x, c in zip(q_ids, q_x, q_codes, strict=True)]
            return pd.DataFrame({"query_id": np.repeat(q_ids, [len(f[0]) for f in found]), "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])})

        for frame in batches(frames):
            ids, x = usable(frame["vec_id"], frame["embedding"], len(codes.mean))
            if len(ids):
                held.append((ids, x))
                n += len(ids)
            if n >= INDEX_ROWS:
                yield answers()
                held, n = [], 0
        if held:
            yield answers()

    return run


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 10, bits: int = 128, sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's k nearest rows of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("__query")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    total = rows.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < min(1.0, sample_rows / max(1, total)) * 1_000_000)
    sample = picked.select("vec_id", "embedding").orderBy("vec_id").limit(2 * sample_rows).toPandas()
    if not len(sample):
        sample = rows.select("vec_id", "embedding").limit(sample_rows).toPandas()
    if not len(sample):
        return empty
    dim = int(sample["embedding"].map(len).mode().iloc[0])
    ids, x = usable(sample["vec_id"], sample["embedding"], dim)
    if not len(ids):
        return empty
    codes = fit(ids, x, k, bits, seed)
    asked = rows.where("__query").select("vec_id", "embedding")
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    data = rows.select("vec_id", "embedding")

    def block(wanted: DataFrame, exact: bool) -> DataFrame:
        got = wanted.orderBy("vec_id").toPandas().drop_duplicates("vec_id")
        queries = usable(got["vec_id"], got["embedding"], dim)
        own = data.mapInPandas(_search(codes, queries, k, exact), FOUND)
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    out = []
    for i in range(n_blocks):
        wanted = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == i)
        found = stored(block(wanted, False), "neighbours")
        full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
        short = wanted.join(full, "vec_id", "left_anti")
        if short.take(1):  # also queries that take no part; they get no rows here either
            rest = stored(block(short, True), "neighbours")
            found = found.join(full, found["query_id"] == full["vec_id"], "left_semi").unionByName(rest)
        out.append(found)
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]
