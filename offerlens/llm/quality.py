"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Fit. Up to BANK_ROWS labelled rows, half of each class where there are enough, are picked by a hash (the documented bound of
what is fitted). Their texts become hashed term counts: lower-cased words, the words' shapes (letter cases, marks, digits), and
buckets of a few statistics of the text (repetition, line lengths, shares of marks). Weighted by inverse document frequency and
reduced by a truncated singular value decomposition they are the labelled latent-semantic vectors, sent to every task
(BANK_ROWS x DIMENSIONS floats at most).

Score. For every document, block by block, the exact cosines with all labelled vectors are one matrix product; its NEIGHBOURS
nearest vote for their labels, weighted by similarity and by how rare their class is in the bank against all labels.

Labels serve the fit only. lang, source and doc_id are never inputs of a score.

Cases. A null, empty or blank text has the score 0. Repeated rows are scored each. A null doc_id gives a null doc_id, not held
out. Null labels are ignored. Labels of unknown documents teach nothing; they count where classes are weighed against each other; without labels every other text scores 0.5, with labels of one
class that class. Extra columns are ignored (scores) or kept (kept). An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import only

BANK_ROWS, TERMS, DIMENSIONS, NEIGHBOURS, THRESHOLD = 4_096, 4_096, 48, 25, 0.7
#: Documents of one matrix product, and words whose cells a task remembers (some 100 bytes each).
BLOCK, CACHED_WORDS = 256, 150_000


class _Cells(dict):
    """Term cells of words, remembered up to a bound: one of the word, one of its shape, as one number."""

    def __init__(self, of: int):
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "0", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", word)))
        cell = lambda kind, x: xxhash.xxh3_64_intdigest(f"{kind}{x}".encode("utf-8", "surrogatepass"))
        half = self.of // 2
        self[word] = found = cell("w", word.lower()) % half * self.of + half + cell("s", shape) % (half - 256)
        return found


_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_ASCII = re.compile("[\x00-\x7f]+")


def _share(text: str, data: bytes, of: bytes, kind: Callable[[str], bool]) -> int:
    """How many characters are of a kind: the ASCII ones by their bytes, the others one by one."""
    n = len(data) - len(data.translate(None, of))
    return n if len(data) == len(text) else n + sum(map(kind, _ASCII.sub("", text)))


def terms(text: str, cells: _Cells) -> np.ndarray:
    """Damped counts of a text's terms; the last 256 cells are buckets of its statistics."""
    words = text.split()
    found = np.fromiter(map(cells.__getitem__, words), np.int64, len(words))
    out = np.log1p(np.bincount(np.concatenate([found // cells.of, found % cells.of]), minlength=cells.of)).astype(np.float32)
    n, lines, data = max(1, len(words)), text.split("\n"), text.encode("utf-8", "surrogatepass")
    shares = (
        len(set(words)) / n,
        max(map(len, words), default=0) / 40,
        sum(map(len, words)) / n / 12,
        len(set(lines)) / len(lines),
        len(words) / len(lines) / 80,
        _share(text, data, _UPPER, str.isupper) / max(1, len(text)) * 2,
        (len(data) - len(data.translate(None, b"#*$%&|!{}<>=_~^"))) / n,
        _share(text, data, _DIGITS, str.isdigit) / max(1, len(text)) * 4,
        np.log1p(len(words)) / 10,
    )
    base = cells.of - 256
    for i, share in enumerate(shares):
        out[base + i * 16 + min(15, int(share * 15))] += 2.0
    return out


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest of each row. The bank is in a fixed order, and of equal similarities the first ones count."""
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(near, best, 1).min(1, keepdims=True)
    for i in np.flatnonzero((near >= least).sum(1) > k):  # a tie at the end
        best[i] = np.argsort(-near[i], kind="stable")[:k]
    return best


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    bank: np.ndarray
    label: np.ndarray
    weight: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = (counts * self.idf) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str | None], cells: _Cells) -> np.ndarray:
        out = np.zeros(len(texts))
        for i in range(0, len(texts), BLOCK):
            rows = [j for j in range(i, min(i + BLOCK, len(texts))) if texts[j] and not texts[j].isspace()]
            if not rows:
                continue
            if not len(self.bank):
                out[rows] = 0.5
                continue
            near = self.vectors(np.stack([terms(texts[j], cells) for j in rows])) @ self.bank.T
            k = min(NEIGHBOURS, near.shape[1])
            best = nearest(near, k)
            vote = np.maximum(np.take_along_axis(near, best, 1), 1e-6) ** 4 * self.weight[best]
            out[rows] = (vote * self.label[best]).sum(1) / vote.sum(1)
        return out


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each text's damped counts, as places and values of those above zero."""
    cells = _Cells(TERMS)
    for frame in frames:
        counts = [terms(t or "", cells) for t in frame["text"]]
        at = [np.flatnonzero(x).astype(np.uint16) for x in counts]
        yield pd.DataFrame({"quality": frame["quality"], "__order": frame["__order"], "at": [i.tobytes() for i in at], "counts": [x[i].astype(np.float16).tobytes() for x, i in zip(counts, at, strict=True)]})


def fit(labelled: DataFrame, sizes: dict[int, int], *, bank_rows: int = BANK_ROWS, seed: int = 3) -> Model:
    """labelled(text, quality, __key): the picked rows, of which bank_rows at most are taken; sizes: how many labels of each class there are in all."""
    none = Model(np.ones(TERMS), np.zeros((TERMS, 1)), np.empty((0, 1)), np.empty(0), np.empty(0))
    picked = labelled.withColumn("__order", F.xxhash64("__key", F.lit(seed)))
    rows = picked.select("text", "quality", "__order").mapInPandas(_counted, "quality int, __order long, at binary, counts binary").orderBy("__order", "at", "counts", "quality").limit(bank_rows).toPandas()
    if not len(rows):
        return none
    label = rows["quality"].to_numpy(np.float64)
    x = np.zeros((len(rows), TERMS), np.float32)
    for own, at, counts in zip(x, rows["at"], rows["counts"], strict=True):
        own[np.frombuffer(at, np.uint16)] = np.frombuffer(counts, np.float16)
    idf = (np.log((1 + len(rows)) / (1 + np.bincount(np.concatenate([np.frombuffer(at, np.uint16) for at in rows["at"]]), minlength=TERMS))) + 0.3).astype(np.float32)
    del rows
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    rank = min(DIMENSIONS, *x.shape)
    y = x.T @ (x @ np.random.default_rng(seed).standard_normal((TERMS, rank + 8)).astype(np.float32))
    for _ in range(3):
        y = x.T @ (x @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    axes = np.ascontiguousarray((q @ np.linalg.svd(x @ q, full_matrices=False)[2].T)[:, :rank]).astype(np.float32)
    model = Model(idf, axes, np.empty((0, rank)), label, np.empty(0))
    model.bank = x @ axes
    model.bank /= np.maximum(np.linalg.norm(model.bank, axis=1, keepdims=True), 1e-12)
    model.weight = np.array([sizes[v] / sum(sizes.values()) / (label == v).mean() for v in label])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, *, bank_rows: int = BANK_ROWS, seed: int = 3) -> Model:
    """Learns from the labelled documents that aren't held out."""
    known = only(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("__key"), F.col("quality").cast("int").alias("quality")).distinct()
    order = F.xxhash64("__key", F.lit(seed))
    # Only the picked labels meet the texts: at most a few thousand, so they go to the tasks and no text is shuffled.
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("quality") == label, min(1.0, bank_rows / max(1, len(sizes)) / n)).otherwise(share)
    picked = known.where(F.pmod(order, F.lit(1_000_000)) < share * 1_000_000)
    texts = only(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(picked), F.col("doc_id") == F.col("__key"))
    return fit(texts.select("text", "quality", "__key"), sizes, bank_rows=bank_rows, seed=seed)


def _scored(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = _Cells(TERMS)
        for frame in frames:
            score = model.scores(frame["text"].tolist(), cells)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "held_out": frame["held_out"], "score": score, "predicted": (score >= THRESHOLD).astype(int)})

    return run


def scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text)."""
    model = trained(docs, labels, **options)
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInPandas(_scored(model), "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, that score THRESHOLD or more."""
    model = trained(docs, labels, **options)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(TERMS)
        for frame in frames:
            yield frame.filter(pa.array(model.scores(frame.column("text").to_pylist(), cells) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
