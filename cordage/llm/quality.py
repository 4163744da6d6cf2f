"""Quality of a whole text by a convolutional network over its bytes, trained in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it: ``CHUNK`` bytes, each
``STRIDE`` after the one before, the last one padded with zeros. Each byte has a vector; learned filters
two to six bytes wide run over a chunk, and the largest value of each enters a small hidden layer. The
chunks' hidden values are combined, as their mean by bytes and as their maximum, into one logit, so
a text that is bad in one place can be told from one that is good throughout.

Training takes one text of each of at most ``MAX_EACH`` labelled ids of either label, chosen by a hash of
the id, and up to ``CHUNKS`` chunks of each, spread evenly; these bound what the driver holds, in bytes too. Scoring reads
every chunk of every text, and holds a bounded number of them at a time.

Defined cases: null and empty texts are one chunk of zeros. If there are not both labels to learn from, every
score is the share of label 1 (0.5 without labels). Labels that are null or whose id is null are not used;
labels that differ for one id count by the smallest; an id that many rows repeat gives one of its texts to learn
from. Repeated rows are scored each. An empty table gives no rows. Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .adam import Adam

MAX_EACH, CHUNKS = 3000, 4
CHUNK, STRIDE, DIM, HIDDEN = 512, 384, 6, 16
WIDTHS, PER_WIDTH = (2, 3, 4, 6), 8
REACH = max(WIDTHS)
HELD, TOGETHER = 1024, 16  # chunks waiting to be scored, chunks convolved at a time


def chunks_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's chunks, as rows, and how many of its bytes each holds (1 for an empty text)."""
    n = 1 + max(0, -(-(len(data) - CHUNK) // STRIDE))
    padded = np.frombuffer(data.ljust((n - 1) * STRIDE + CHUNK, b"\0"), np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]
    return rows, np.clip(len(data) - STRIDE * np.arange(n), 1, CHUNK)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


@dataclass
class ByteScorer:
    bytes_: np.ndarray  # 256 x DIM
    filters: np.ndarray  # REACH * DIM x filters; a narrower filter has zeros beyond its width
    bias: np.ndarray
    hidden: np.ndarray  # filters x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # 2 * HIDDEN: mean and maximum over the chunks
    out_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.bytes_, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def columns(self, chunks: np.ndarray) -> np.ndarray:
        """For each chunk and place, the vectors of the bytes from there on."""
        x = np.ascontiguousarray(self.bytes_[chunks])
        n, w, d = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, w - REACH + 1, REACH * d), s).reshape(-1, REACH * d)

    def convolved(self, chunks: np.ndarray) -> Iterator[np.ndarray]:
        """The filters' values at each place, few chunks at a time (they stay in the processor's cache)."""
        for at in range(0, len(chunks), TOGETHER):
            part = chunks[at : at + TOGETHER]
            yield (self.columns(part) @ self.filters).reshape(len(part), -1, self.filters.shape[1])

    def chunk_values(self, chunks: np.ndarray) -> np.ndarray:
        """The hidden values of each chunk."""
        z = np.concatenate([z.max(1) for z in self.convolved(chunks)])
        return np.maximum(np.maximum(z + self.bias, 0) @ self.hidden + self.hidden_bias, 0)

    def combine(self, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
        return _sigmoid(np.hstack([mean, top]) @ self.out + self.out_bias[0])

    def loss_and_gradients(self, chunks: np.ndarray, size: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean log loss of texts whose chunks begin at ``first``, and its gradients in the order of ``params``."""
        n, texts = len(chunks), len(first)
        of = np.repeat(np.arange(texts), np.diff(np.append(first, n)))
        share = (size / np.add.reduceat(size, first)[of]).astype(self.out.dtype)[:, None]
        found = [(at := z.argmax(1), np.take_along_axis(z, at[:, None], 1)[:, 0]) for z in self.convolved(chunks)]
        at, before = np.concatenate([a for a, _ in found]), np.concatenate([z for _, z in found]) + self.bias
        p = np.maximum(before, 0)
        raw = p @ self.hidden + self.hidden_bias
        h = np.maximum(raw, 0)
        top = np.maximum.reduceat(h, first)
        joined = np.hstack([np.add.reduceat(h * share, first), top])
        score = _sigmoid(joined @ self.out + self.out_bias[0])
        loss = -np.mean(np.where(labels > 0, np.log(score), np.log1p(-score)))
        g = ((score - labels) / texts).astype(self.out.dtype)
        won = h == top[of]  # equal largest values share the gradient
        won = won / np.add.reduceat(won, first)[of]
        gh = (g[of, None] * (self.out[:HIDDEN] * share + self.out[HIDDEN:] * won) * (raw > 0)).astype(self.out.dtype)
        gp = (gh @ self.hidden.T) * (before > 0)
        under = np.take_along_axis(chunks, (at[:, :, None] + np.arange(REACH)).reshape(n, -1), 1)  # the bytes under each filter's largest value
        g_filters = np.einsum("nf,nfk->kf", gp, self.bytes_[under].reshape(n, -1, REACH * DIM)) * (self.filters != 0)
        g_bytes = np.zeros_like(self.bytes_)
        np.add.at(g_bytes, under.ravel(), (gp[:, :, None] * self.filters.T[None]).reshape(-1, DIM))
        return float(loss), [g_bytes, g_filters, gp.sum(0), p.T @ gh, gh.sum(0), joined.T.astype(g.dtype) @ g, g.sum(keepdims=True)]


def fresh(seed: int = 13, dtype: type = np.float32) -> ByteScorer:
    rng, n = np.random.default_rng(seed), PER_WIDTH * len(WIDTHS)
    filters = rng.normal(0, 0.3, (REACH, DIM, n))
    for k, width in enumerate(WIDTHS):
        filters[width:, :, k * PER_WIDTH : (k + 1) * PER_WIDTH] = 0
    made = [rng.normal(0, 1, (256, DIM)), filters.reshape(-1, n), np.zeros(n), rng.normal(0, 0.2, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, 2 * HIDDEN), np.zeros(1)]
    return ByteScorer(*(x.astype(dtype) for x in made))


@dataclass
class Example:
    label: float
    chunks: np.ndarray
    size: np.ndarray


def fit(examples: list[Example], steps: int = 500, seed: int = 13, batch: int = 32) -> ByteScorer | float:
    """The trained network; without both labels the share of label 1."""
    labels = np.array([e.label for e in examples], np.float32)
    if not len(labels) or labels.min() == labels.max():
        return float(labels.mean()) if len(labels) else 0.5
    model, rng = fresh(seed), np.random.default_rng(seed)
    sides = [np.flatnonzero(labels == y) for y in (0, 1)]
    prior = float(np.log(len(sides[1]) / len(sides[0])))
    adam = Adam(model.params(), 0.01)
    for step in range(steps):
        adam.rate = 0.01 * min(1, 2 * (1 - step / steps)) + 1e-5
        pick = [examples[i] for side in sides for i in rng.choice(side, batch // 2)]
        sizes = [len(e.chunks) for e in pick]
        adam.step(model.loss_and_gradients(np.concatenate([e.chunks for e in pick]), np.concatenate([e.size for e in pick]), np.cumsum([0, *sizes[:-1]]), np.array([e.label for e in pick]))[1])
    model.out_bias += np.float32(prior * 0.5)  # batches hold as many of either label; half way back to the shares
    return model


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> list[Example]:
    """The bounded sample; ``learn`` says which rows of labels may be used."""
    known = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    sample = known.where("label = 1").orderBy(order).limit(MAX_EACH).unionByName(known.where("label <> 1").orderBy(order).limit(MAX_EACH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks, sizes = [], []
            for text in b.column(2).cast(pa.binary()):
                rows, size = chunks_of(text.as_py() or b"")
                keep = np.unique(np.linspace(0, len(rows) - 1, CHUNKS).astype(int))
                chunks.append(rows[keep].tobytes()), sizes.append(size[keep].tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(chunks, pa.binary()), pa.array(sizes, pa.list_(pa.int32()))], ["doc_id", "label", "chunks", "sizes"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(sample), "doc_id")  # at most two times MAX_EACH ids
    chosen = chosen.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = chosen.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, label int, chunks binary, sizes array<int>").toArrow().sort_by("doc_id")
    return [Example(float(r["label"] == 1), np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK), np.array(r["sizes"], np.int64)) for r in got.to_pylist()]


def with_scores(docs: DataFrame, model: ByteScorer | float, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in a further column."""
    docs = docs.drop(score_col)
    if isinstance(model, float):
        return docs.withColumn(score_col, F.lit(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mean, top, whole = np.zeros((b.num_rows, HIDDEN)), np.zeros((b.num_rows, HIDDEN)), np.zeros(b.num_rows)
            held: list[tuple[int, np.ndarray, np.ndarray]] = []

            def flush(mean=mean, top=top, whole=whole, held=held) -> None:
                rows, size = np.concatenate([c for _, c, _ in held]), np.concatenate([s for *_, s in held])
                of = np.repeat([i for i, *_ in held], [len(s) for *_, s in held])
                h = model.chunk_values(rows)
                np.add.at(mean, of, h * size[:, None])
                np.maximum.at(top, of, h)
                np.add.at(whole, of, size)
                held.clear()

            waiting = 0
            for i, text in enumerate(b.column(b.schema.get_field_index(text_col)).cast(pa.string()).cast(pa.binary())):
                rows, size = chunks_of(text.as_py() or b"")
                for at in range(0, len(rows), HELD):
                    held.append((i, rows[at : at + HELD], size[at : at + HELD]))
                    waiting += len(held[-1][2])
                    if waiting >= HELD:
                        flush()
                        waiting = 0
            if held:
                flush()
            score = model.combine(mean / np.maximum(whole, 1)[:, None], top)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], [*b.schema.names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``."""
    model = fit(training_rows(docs, labels, learn))
    return with_scores(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).select("doc_id", "score")
