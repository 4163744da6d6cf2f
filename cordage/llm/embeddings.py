"""Embedding near-duplicates: Euclidean p-stable hashing, then exact cosines.

Vectors are scaled to length one and projected on Gaussian directions; a table's bucket is the tuple
of ``k`` quantised projections. With n vectors, k is chosen so that a bucket holds about ``FILL``
unrelated vectors, and the number of tables so that a pair right at the threshold shares a bucket
with chance ``RECALL``; closer pairs are found with more. Inside a bucket all cosines are exact, in
double precision. A pair that meets in several tables counts in the first of them only.

Equal vectors are one row with a count, so copies are never paired. A bucket of more than ``BLOCK``
rows is compared block by block, every two blocks in some task; tasks give a row per vector (its
number of links and the smallest vector it is joined to), never a row per pair.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing (n_links 0, a component of their own). Vectors of different dimensions never link. Repeated
rows of one id and vector are one vector with a result for each row. A null id has no component,
no links, and is not kept. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, deal_blocks

WIDTH, FILL, RECALL, BLOCK, SEED = 2.0, 24, 0.93, 1024, 5


def meeting_chance(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection agrees for two vectors at this distance (Datar et al. 2004)."""
    r = width / max(distance, 1e-12)
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, threshold: float) -> tuple[int, int]:
    """Projections a table and tables for n vectors."""
    far, near = meeting_chance(math.sqrt(2)), meeting_chance(math.sqrt(2 - 2 * threshold))
    k = max(4, math.ceil(math.log(max(n, 1) / FILL) / -math.log(far))) if n > FILL else 4
    return k, max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k)))


def _codes(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """A 32-bit bucket of each vector in each table; the same for the same dimension everywhere."""
    rng = np.random.default_rng([SEED, x.shape[1]])
    directions, offset = rng.normal(size=(x.shape[1], tables * k)), rng.uniform(0, WIDTH, tables * k)
    q = np.floor((x @ directions + offset) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
    odd = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (q * odd).sum(2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _buckets(vectors: DataFrame, k: int, tables: int, dtype: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, n, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            ends = np.cumsum(size)
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                for at in range(0, len(rows), 512):
                    own = rows[at : at + 512]
                    x = flat[(ends[own] - dim)[:, None] + np.arange(dim)].astype(dtype)
                    codes = _codes(_unit(x), k, tables)
                    packed = [c.tobytes() for c in codes]
                    raw = [v.tobytes() for v in x]
                    m = len(own)
                    cols = [np.tile(np.arange(tables, dtype=np.int32), m), codes.ravel(), np.full(m * tables, dim, np.int32), np.repeat(rep[own], tables), np.repeat(n[own], tables)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(raw, pa.binary()).take(pa.array(np.repeat(np.arange(m), tables))), pa.array(packed, pa.binary()).take(pa.array(np.repeat(np.arange(m), tables)))], ["tab", "code", "dim", "rep", "n", "vec", "codes"])

    return vectors.select("rep", "n", "vec").mapInArrow(run, "tab int, code int, dim int, rep long, n long, vec binary, codes binary")


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, dtype: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; the last group of a batch is carried on (it is bounded)."""
    names, rest = ["tab", "code", "dim", "pair"], None

    def group(t: pa.Table, out: list) -> None:
        tab, dim = t.column("tab")[0].as_py(), t.column("dim")[0].as_py()
        rep, n, own = (t.column(c).to_numpy() for c in ("rep", "n", "own"))
        x = _unit(np.frombuffer(b"".join(t.column("vec").to_pylist()), dtype).reshape(len(rep), dim))
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if own[0] != own[-1] or (own != own[0]).any():
            near &= own[:, None] != own[None, :]  # two blocks: each was compared with itself elsewhere
        i, j = np.nonzero(near)
        if not len(i):
            return
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int32).reshape(len(rep), -1)
        first = np.ones(len(i), bool)
        for s in range(0, len(i), 1 << 16):
            p = slice(s, s + (1 << 16))
            first[p] = ~(codes[i[p], :tab] == codes[j[p], :tab]).any(1)
        links = np.bincount(i[first], n[j[first]], len(rep)).astype(np.int64)
        order = np.argsort(rep, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(rep))
        label = place.copy()
        while True:  # the smallest vector that each is joined to inside the group
            new = label.copy()
            np.minimum.at(new, i, label[j])
            new = np.minimum(new, new[order[new]])
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero((links > 0) | (label != place))
        out.append((rep[some], rep[order[label[some]]], links[some]))

    def links_of(t: pa.Table) -> pa.RecordBatch:
        key = [t.column(c).to_numpy() for c in names]
        new = np.ones(len(t), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        start = np.flatnonzero(new)
        size, out = np.diff(np.append(start, len(t))), []
        for k in np.flatnonzero(size > 1):
            group(t.slice(start[k], size[k]), out)
        cols = [np.concatenate([np.zeros(0, np.int64), *(o[c] for o in out)]) for c in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "links"])

    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not len(t):
            continue
        key = [t.column(c).to_numpy() for c in names]
        cutoff = int(np.flatnonzero(np.logical_and.reduce([k == k[-1] for k in key]))[0])
        rest = t.slice(cutoff)
        if cutoff:
            yield links_of(t.slice(0, cutoff))
    if rest is not None:
        yield links_of(rest)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``."""
    kind = dict(vectors.dtypes)["embedding"]
    dtype = "float32" if kind == "array<float>" else "float64"
    vec = F.col("embedding").cast("array<float>" if dtype == "float32" else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    rows = rows.withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64(F.lit(1), F.col("vec")))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("vec_id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    once = rows.where(sound).groupBy("k1", "k2", "vec_id").agg(F.first("vec").alias("vec"))  # equal keys hold equal vectors
    unique = cut(once.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")))
    k, tables = parameters(unique.count(), threshold)
    dealt = deal_blocks(_buckets(unique, k, tables, dtype), ["tab", "code", "dim"], "rep", block)
    found = dealt.repartition("tab", "code", "dim", "pair").sortWithinPartitions("tab", "code", "dim", "pair")
    found = cut(found.mapInArrow(lambda it: _compare(it, threshold, dtype), "a long, b long, links long"))
    degree = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comp = connected_components(found.select("a", "b")).withColumnRenamed("node", "rep")
    told = unique.select("k1", "k2", "rep", "n").join(degree, "rep", "left").join(comp, "rep", "left")
    told = told.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "k1", "k2", sound.alias("sound")).join(told, ["k1", "k2"], "left")
    links = F.when(F.col("sound"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links")
    component = F.when(F.col("sound"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id")
    return out.select("vec_id", links, component, F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
