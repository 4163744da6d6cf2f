"""Toxicity: a factorization machine over the hashed terms of a whole text.

Terms are lower-cased words and their beginnings of four and five letters (inflected forms share
them), each counted once a text and hashed. The machine has a weight for each term and a vector of
``FACTORS`` numbers, whose products are the weights of term pairs, so that an insult together with
the mention of a group can weigh more than both alone. Only terms that tell the label in the training
rows enter, alone (chi-square) or in a pair (contrast of the pair's four cells, so that terms which say
nothing alone are found too); all others have weight zero, so a text's length alone does not move its
score.

Training takes one text of each of at most ``MAX_POSITIVE`` and ``MAX_NEGATIVE`` labelled ids, chosen by
a hash of the id; they bound what the driver holds. Scoring reads every whole text.

Defined cases: null and empty texts get the score of a text without terms. If no label of both
kinds can be learned from, every score is the share of label 1 (0 without labels). Repeated rows are
scored each; to learn from, an id that many rows repeat gives one of its texts. Labels that are null or
differ for one id count by their largest value. Other columns are kept as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .adam import Adam
from .common import releasing

MAX_POSITIVE, MAX_NEGATIVE = 4000, 8000
SPACE, TERMS, FACTORS = 1 << 18, 2048, 4
REJECT = 0.7
MIN_CHI, MIN_CONTRAST = 20, 6  # chi-square from which a term counts, standard errors from which a pair does
L2_W, L2_V = 1e-5, 1e-4  # penalties on weights and factors
BATCH = 256
PAIR_TERMS = 1536  # the commonest terms of the training rows, whose pairs are looked at
WORD = re.compile(r"\w+")


def word_terms(word: str) -> set[int]:
    forms = {"w" + word} | {f"{n}{word[:n]}" for n in (4, 5) if len(word) >= n}
    return {zlib.crc32(f.encode("utf-8", "replace")) % SPACE for f in forms}


def text_terms(text: str | None) -> np.ndarray:
    found: set[int] = set()
    for word in set(WORD.findall((text or "").lower())):
        found |= word_terms(word)
    return np.fromiter(sorted(found), np.int32, len(found))


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum of weights + sum over pairs of the vectors' products)."""

    terms: np.ndarray  # hashed terms that count
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_margin(x, np.float32(self.bias), self.weights, self.factors))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


def _margin(x: np.ndarray, b: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    s = x @ v
    return b + x @ w + 0.5 * ((s * s).sum(1) - (x * x) @ (v * v).sum(1))


def _dense(rows: list[np.ndarray], terms: np.ndarray) -> np.ndarray:
    """One row per text, 1 where it holds the term."""
    index = np.full(SPACE, -1, np.int32)
    index[terms] = np.arange(len(terms))
    x = np.zeros((len(rows), len(terms)), np.float32)
    for k, r in enumerate(rows):
        x[k, (i := index[r])[i >= 0]] = 1
    return x


def informative_terms(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Terms that tell the label alone (chi-square), and terms that tell it only in pairs.

    For a pair, the rates of label 1 in the four cells of the two terms are compared: their contrast
    p11 - p10 - p01 + p00 is 0 where the terms add up, whatever each does alone. Pairs whose contrast is
    ``MIN_CONTRAST`` standard errors or more bring in both terms.
    """
    n, pos = len(labels), float(labels.sum())
    flat = np.concatenate(rows)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    df = np.bincount(flat, minlength=SPACE)
    df1 = np.bincount(flat[labels[of] > 0], minlength=SPACE)
    expected = df * pos / n
    chi = np.where(df >= max(3, n // 2000), (df1 - expected) ** 2 / np.maximum(expected * (1 - df / n) * (1 - pos / n), 1e-9), 0)
    alone = np.argsort(-chi, kind="stable")[:TERMS]
    alone = alone[chi[alone] > MIN_CHI]
    common = np.sort(np.argsort(-df, kind="stable")[:PAIR_TERMS])
    common = common[(df[common] >= 5) & (df[common] <= n - 5)]
    both, both1 = np.zeros((2, len(common), len(common)), np.float32)  # counts, so exact
    for at in range(0, n, 1024):
        x = _dense(rows[at : at + 1024], common)
        both += x.T @ x
        x = x[labels[at : at + 1024] > 0]
        both1 += x.T @ x
    d, d1, strength = df[common].astype(np.float64), df1[common].astype(np.float64), np.zeros(len(common))
    for at in range(0, len(common), 64):  # a strip of pairs at a time
        own = slice(at, at + 64)
        c, c1, e, e1 = both[own].astype(np.float64), both1[own].astype(np.float64), d[own, None], d1[own, None]
        cells = ((1, c, c1), (-1, e - c, e1 - c1), (-1, d[None] - c, d1[None] - c1), (1, n - e - d[None] + c, pos - e1 - d1[None] + c1))
        contrast = error = 0.0
        for sign, total, ones in cells:
            rate = (ones + 0.5) / (total + 1)
            contrast, error = contrast + sign * rate, error + rate * (1 - rate) / (total + 1)
        enough = np.minimum.reduce([total for _, total, _ in cells]) >= 5
        strength[own] = np.where(enough, np.abs(contrast) / np.sqrt(error), 0).max(1, initial=0)
    paired = common[strength >= MIN_CONTRAST]
    return np.unique(np.concatenate([alone, paired[np.argsort(-strength[strength >= MIN_CONTRAST], kind="stable")][:TERMS]]))


def fit(rows: list[np.ndarray], labels: np.ndarray, steps: int = 2000, seed: int = 7) -> FactorizationMachine:
    labels = np.asarray(labels, np.float32)
    n, pos = len(labels), float(labels.sum())
    if not pos or pos == n:
        share = min(max(pos / n, 1e-9), 1 - 1e-9) if n else 1e-9
        return FactorizationMachine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    terms = informative_terms(rows, labels)
    index = np.full(SPACE, -1, np.int32)
    index[terms] = np.arange(len(terms))
    rows = [(i := index[r])[i >= 0] for r in rows]
    rng = np.random.default_rng(seed)
    b, w = np.zeros(1, np.float32), np.zeros(len(terms), np.float32)
    v = rng.normal(0, 0.02, (len(terms), FACTORS)).astype(np.float32)
    adam = Adam([b, w, v], 0.03)
    for _ in range(steps):
        pick = rng.integers(0, n, BATCH)
        x = np.zeros((len(pick), len(terms)), np.float32)
        for k, i in enumerate(pick):
            x[k, rows[i]] = 1
        g = ((_sigmoid(_margin(x, b[0], w, v)) - labels[pick]) / len(pick)).astype(np.float32)
        s = x @ v
        xg = x.T @ g
        adam.step([g.sum(keepdims=True), xg + L2_W * w, x.T @ (g[:, None] * s) - v * xg[:, None] + L2_V * v])
    return FactorizationMachine(terms, float(b[0]), w, v)


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[list[np.ndarray], np.ndarray]:
    """Terms and labels of the bounded sample; ``learn`` says which rows of labels may be used."""
    known = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    sample = known.where("toxic = 1").orderBy(order).limit(MAX_POSITIVE).unionByName(known.where("toxic <> 1").orderBy(order).limit(MAX_NEGATIVE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = pa.array([text_terms(t.as_py()) for t in b.column(0)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), terms], ["doc_id", "toxic", "terms"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(sample), "doc_id")  # at most MAX_POSITIVE + MAX_NEGATIVE ids
    chosen = chosen.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "doc_id", "toxic")
    got = chosen.mapInArrow(releasing(run), "doc_id long, toxic int, terms array<int>").toArrow().sort_by("doc_id")
    terms = got.column("terms").combine_chunks()
    flat, ends = terms.values.to_numpy(), terms.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], (got.column("toxic").to_numpy() == 1).astype(np.float32)


def with_scores(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in a further column."""
    docs = docs.drop(score_col)
    position = {int(t): i for i, t in enumerate(model.terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}

        def of(word: str) -> tuple[int, ...]:
            if len(known) > 200_000:
                known.clear()
            known[word] = found = tuple(position[t] for t in word_terms(word) if t in position)
            return found

        for b in batches:
            texts, scores = b.column(b.schema.get_field_index(text_col)), np.empty(b.num_rows)
            for at in range(0, b.num_rows, 256):
                x = np.zeros((min(256, b.num_rows - at), len(position)), np.float32)
                for k in range(len(x)):
                    found: set[int] = set()
                    for word in set(WORD.findall((texts[at + k].as_py() or "").lower())):
                        if got := known[word] if word in known else of(word):
                            found.update(got)
                    x[k, list(found)] = 1
                scores[at : at + len(x)] = model.scores(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], [*b.schema.names, score_col])

    return docs.mapInArrow(releasing(run), StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``."""
    model = fit(*training_rows(docs, labels, learn))
    return with_scores(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).select("doc_id", "score")
