"""Language identification: a convolutional network over bytes, trained in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes, the last one padded with zeros. Each
byte has a vector; filters two to five bytes wide run over it, the largest value of each over the
window enters a softmax over the languages. A text's score for a language is the mean over all its
windows, weighted by their bytes; every byte counts.

Training takes at most ``MAX_DOCS`` texts of each language and about ``MAX_ROWS`` of all (one of each at
least, so every language is learned), chosen by a hash of the id, and up to ``WINDOWS`` windows of each;
classification reads every whole text.

Defined cases: null texts and texts without a letter (``str.isalpha``) are ``und`` with score 0. With no
labelled text to learn from, every text is ``und``. Ties go to the language first in order. Rows repeat
as given; to learn from, rows that repeat an id and language give one of their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .adam import Adam
from .common import cut

MAX_DOCS, MAX_ROWS, WINDOWS = 1200, 24_000, 3
WINDOW, DIM = 256, 6
WIDTHS = (2, 3, 4, 5)
PER_WIDTH = 8
REACH = max(WIDTHS)


@dataclass
class ByteNetwork:
    langs: list[str]
    bytes_: np.ndarray  # 256 x DIM
    filters: np.ndarray  # REACH * DIM x filters; a narrower filter has zeros beyond its width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return _softmax(self._pooled(windows)[0] @ self.out + self.out_bias)

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """For each window and place, the vectors of the bytes from there on."""
        x = self.bytes_[windows]
        n, w, d = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, w - REACH + 1, REACH * d), (s[0], s[1], s[2])).reshape(-1, REACH * d)

    def _pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (self.columns(windows) @ self.filters).reshape(len(windows), -1, self.filters.shape[1])
        z = z.max(1)
        return np.maximum(z + self.bias, 0), z

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int, seed: int) -> None:
        rng, mask = np.random.default_rng(seed), self.filters != 0
        adam = Adam([self.bytes_, self.filters, self.bias, self.out, self.out_bias], 0.01)
        for _ in range(steps):
            pick = rng.integers(0, len(windows), 64)
            w, n = windows[pick], 64
            cols = self.columns(w).reshape(n, -1, REACH * DIM)
            z = cols @ self.filters
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None], 1)[:, 0] + self.bias
            h = np.maximum(top, 0)
            g = _softmax(h @ self.out + self.out_bias)
            g[np.arange(n), labels[pick]] -= 1
            g /= n
            gh = (g @ self.out.T) * (top > 0)
            seen = cols[np.arange(n)[:, None], at]  # n x filters x REACH * DIM
            g_filters = np.einsum("nf,nfk->kf", gh, seen) * mask
            g_cols = (gh[:, :, None] * self.filters.T[None]).reshape(-1, DIM)
            place = (at[:, :, None] + np.arange(REACH)).reshape(n, -1)
            g_bytes = np.zeros_like(self.bytes_)
            np.add.at(g_bytes, np.take_along_axis(w, place, 1).ravel(), g_cols)
            adam.step([g_bytes, g_filters, gh.sum(0), h.T @ g, g.sum(0)])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fresh(langs: list[str], seed: int = 11) -> ByteNetwork:
    rng = np.random.default_rng(seed)
    n = PER_WIDTH * len(WIDTHS)
    filters = rng.normal(0, 0.3, (REACH, DIM, n)).astype(np.float32)
    for k, width in enumerate(WIDTHS):
        filters[width:, :, k * PER_WIDTH : (k + 1) * PER_WIDTH] = 0
    return ByteNetwork(langs, rng.normal(0, 1, (256, DIM)).astype(np.float32), filters.reshape(-1, n), np.zeros(n, np.float32), rng.normal(0, 0.1, (n, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def windows_of(data: bytes) -> np.ndarray:
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(docs: DataFrame, learn: Column, steps: int = 500, seed: int = 11) -> ByteNetwork | None:
    """Learn from the bounded sample of rows for which ``learn`` holds and lang is known."""
    lang = F.col("lang").cast("string")
    known = docs.where(learn & F.col("lang").isNotNull())
    order = F.xxhash64("doc_id")
    counts = cut(known.groupBy(lang.alias("lang")).agg(F.approx_count_distinct("doc_id").alias("n")))  # a row for each class of the network
    each = max(1, min(MAX_DOCS, MAX_ROWS // max(1, counts.count())))
    # the ids come first, without texts: by a hash, over twice as many of each language as are taken
    few = known.select("doc_id", lang.alias("lang")).join(F.broadcast(counts), "lang").where(F.pmod(order, F.lit(1_000_003)) < (2 * each + 20) / F.col("n") * 1_000_003)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    ids = few.select("doc_id", "lang").distinct().withColumn("rank", rank).where(F.col("rank") <= each).select("doc_id", "lang")
    texts = known.select("doc_id", lang.alias("lang"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, found = [], []
            for lang, text in zip(b.column(1), b.column(2), strict=True):
                if (t := text.as_py()) and has_letter(t):
                    w = windows_of(t.encode("utf-8", "replace"))
                    for i in sorted({0, len(w) // 2, max(0, len(w) - 2)})[:WINDOWS]:
                        langs.append(lang.as_py()), found.append(w[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "window"])

    got = chosen.select("doc_id", "lang", "text").mapInArrow(run, "lang string, window binary").toArrow().sort_by([("lang", "ascending"), ("window", "ascending")])
    if not len(got):
        return None
    langs, of = np.unique(np.array(got.column("lang").to_pylist()), return_inverse=True)
    model = fresh(langs.tolist(), seed)
    model.fit(np.frombuffer(b"".join(got.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW), of, steps * max(1, len(langs) // 8), seed)
    return model


def classify(docs: DataFrame, model: ByteNetwork | None, batch: int = 128) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row of ``docs``."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if model is None:
        return texts.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, weight = np.zeros((b.num_rows, len(model.langs))), np.zeros(b.num_rows)
            held: list[np.ndarray] = []
            owner: list[np.ndarray] = []
            sizes: list[np.ndarray] = []

            def flush(held=held, owner=owner, sizes=sizes, total=total, weight=weight) -> None:
                w, own, size = np.concatenate(held), np.concatenate(owner), np.concatenate(sizes)
                for at in range(0, len(w), batch):
                    part = slice(at, at + batch)
                    np.add.at(total, own[part], model.probabilities(w[part]) * size[part, None])
                np.add.at(weight, own, size)
                held.clear(), owner.clear(), sizes.clear()

            waiting = 0
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                if text is None or not has_letter(text):
                    continue
                data = text.encode("utf-8", "replace")
                w = windows_of(data)
                held.append(w), owner.append(np.full(len(w), i))
                sizes.append(np.minimum(WINDOW, len(data) - WINDOW * np.arange(len(w))))
                waiting += len(w)
                if waiting >= 4096:
                    flush()
                    waiting = 0
            if held:
                flush()
            best, known = total.argmax(1), weight > 0
            score = np.where(known, total.max(1) / np.maximum(weight, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)], pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "lang_pred", "score"])

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, lang_pred string, score double")
