"""SimHash near-duplicates: generalised pigeonhole over partitions of correlated bits.

Words are runs of anything but ASCII white space, after A-Z were lower-cased; shingles are three
words. A bit of the fingerprint is 1 if it is set in over half of the shingles' XXH64 values.
Fingerprints that differ in at most ``tau`` bits are linked.

Search. The 64 bits are dealt to m partitions so that correlated bits lie together. If the
partitions' thresholds add up to tau - m + 1 (a threshold of -1 leaves a partition out), every
linked pair is within the threshold of at least one of them. A dynamic program chooses m and the
thresholds by the estimated number of candidates and of signatures to enumerate. Each distinct
fingerprint is written under its signature and those within the partition's threshold; fingerprints
under one signature are compared in full.

Defined cases: null or wordless text has fingerprint zero, linked like any other. Repeated rows are
kept, one result each. A null id keeps its fingerprint, links with nothing and has a null component.
Ties of the half are 0 bits. Very long texts are read whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, deal_blocks, releasing

BITS = 64
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
BLOCK = 1024  # fingerprints compared at once; larger groups are compared block by block
SMALL = 16  # up to here all links of a group are written, beyond it a spanning forest


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; fewer words: of the whole sequence."""
    words = [w.encode("utf-8", "replace") for w in WORD.findall((text or "").translate(LOWER))]
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a : b - 1], 42) for a, b in zip(starts, starts[width:], strict=False)), np.uint64, len(words) - width + 1)


def fingerprint(text: str | None, width: int = 3) -> int:
    return fingerprint_of(shingle_hashes(text, width))


def fingerprint_of(h: np.ndarray) -> int:
    if not len(h):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):  # little-endian bytes: bit i of the number is column i
        counts += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` per row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(releasing(run), "doc_id long, fp long")


# --- partitions and thresholds ------------------------------------------------------------------


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often bits i and j are both set, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = _bits(b.column(0).to_numpy()).astype(np.float32)
            total += (x.T @ x).astype(np.float64)
            n += len(x)
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(j, -1).astype(np.int32)), pa.array(np.append(total.ravel(), n))], ["i", "j", "n"])

    out, n = np.zeros((BITS, BITS)), 0
    for r in fps.select("fp").mapInArrow(releasing(run), "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 4,097 rows at most
        if r["i"] < 0:
            n = int(r["n"])
        else:
            out[r["i"], r["j"]] = r["n"]
    return n, out


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits to m partitions; each grows by the bit most correlated with what it holds."""
    p = both.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, parts = list(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        part = [max(left, key=lambda i: (corr[i, left].sum() - corr[i, i], -i))]
        left.remove(part[0])
        while len(part) < width:
            best = max(left, key=lambda i: (corr[i, part].sum(), -i))
            part.append(best)
            left.remove(best)
        parts.append(sorted(part))
    return parts


def _within(p: np.ndarray, both: np.ndarray, part: list[int], tau: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0, 1 .. tau bits of a partition.

    The number of differing bits has a mean and a variance that follow from how often each two bits are
    set together, over all fingerprints; a beta-binomial with these two stands for its distribution, so
    bits that go together make agreement likelier than independent bits would.
    """
    i = np.ix_(part, part)
    p11, p10 = both[i], p[part][:, None] - both[i]
    p01 = p[part][None] - both[i]
    differ2 = 2 * np.maximum(p11 * (1 - p11 - p10 - p01) + p10 * p01, 0)  # both bits differ
    n, q = len(part), 2 * p[part] * (1 - p[part])
    np.fill_diagonal(differ2, q)
    mean = min(max(q.sum() / n, 1e-6), 1 - 1e-6)
    together = (differ2.sum() - q.sum() ** 2) / (n * mean * (1 - mean))  # 1 for independent bits, n for equal ones
    rho = min(max((together - 1) / max(n - 1, 1), 1e-6), 1 - 1e-6)
    a, b = mean * (1 / rho - 1), (1 - mean) * (1 / rho - 1)
    beta = lambda x, y: math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)
    return np.cumsum([math.comb(n, k) * math.exp(beta(k + a, n - k + b) - beta(a, b)) if k <= n else 0.0 for k in range(tau + 1)])


def thresholds(n: int, both: np.ndarray, parts: list[list[int]], tau: int) -> tuple[float, list[int]]:
    """Cost and thresholds that add up to tau - m + 1, by dynamic programming over the partitions.

    Cost counts rows to write (enumerated signatures) and the estimated pairs to compare.
    """
    p, m, row, compare = both.diagonal() / max(n, 1), len(parts), 1.0, 0.01
    cost = []
    for part in parts:
        within, of = _within(p, both / max(n, 1), part, tau), {-1: 0.0}
        for t in range(tau + 1):
            rows = sum(math.comb(len(part), k) for k in range(t + 1))
            of[t] = row * n * rows + compare * n * n / 2 * within[t] * max(1, rows)
        cost.append(of)
    best = {0: (0.0, [])}
    for of in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t, more in of.items():
                if used + t not in step or step[used + t][0] > c + more:
                    step[used + t] = (c + more, [*ts, t])
        best = step
    return best[tau - m + 1]


def plan(n: int, both: np.ndarray, tau: int) -> tuple[list[list[int]], list[int]]:
    found = []
    for m in range(2, tau + 2):
        parts = correlated_partitions(n, both, m)
        found.append((*thresholds(n, both, parts, tau), parts))
    _, ts, parts = min(found, key=lambda x: x[0])
    return parts, ts


# --- probing and verifying ----------------------------------------------------------------------


def _signatures(fps: DataFrame, parts: list[list[int]], ts: list[int]) -> DataFrame:
    """``(part, sig, fp, rep)``: each fingerprint under every signature within its thresholds."""
    probes = []
    for k, (part, t) in enumerate(zip(parts, ts, strict=True)):
        if t >= 0:
            masks = [sum(1 << i for i in c) for r in range(t + 1) for c in itertools.combinations(part, r)]
            probes.append((k, sum(1 << i for i in part), np.array(masks, np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, rep = (b.column(i).to_numpy() for i in (0, 1))
            for k, keep, masks in probes:
                step = max(1, (1 << 17) // len(masks))
                for at in range(0, len(fp), step):
                    own = fp[at : at + step]
                    sig = ((own.view(np.uint64) & np.uint64(keep))[:, None] ^ masks[None, :]).ravel().view(np.int64)
                    cols = [np.full(len(sig), k, np.int32), sig, np.repeat(own, len(masks)), np.repeat(rep[at : at + step], len(masks))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["part", "sig", "fp", "rep"])

    return fps.select("fp", "rep").mapInArrow(releasing(run), "part int, sig long, fp long, rep long")


def _forest(fp: np.ndarray, rep: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a large group that join what all its links join."""
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= tau
    label = np.arange(len(fp))
    while True:
        new = np.where(near, label[None, :], len(fp)).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(fp)))
    return rep[at], rep[label[at]]


def _compare(batches: Iterator[pa.RecordBatch], tau: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group that goes over a batch's end is carried on (it is bounded)."""
    names, rest = ["part", "sig", "pair"], None

    def links(t: pa.Table) -> pa.RecordBatch:
        key = [t.column(c).to_numpy() for c in names]
        fp, rep = t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy()
        new = np.ones(len(fp), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(fp)))
        size_of, found = np.repeat(size, size), ([], [])
        last = np.repeat(start + size, size)
        small = np.flatnonzero((size_of > 1) & (size_of <= SMALL))
        for lag in range(1, SMALL):
            small = small[small + lag < last[small]]
            if not len(small):
                break
            hit = small[np.bitwise_count(fp[small] ^ fp[small + lag]) <= tau]
            found[0].append(rep[hit]), found[1].append(rep[hit + lag])
        for k in np.flatnonzero(size > SMALL):
            a, b = _forest(*(x[start[k] : start[k] + size[k]] for x in (fp, rep)), tau)
            found[0].append(a), found[1].append(b)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in found], ["a", "b"])

    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not len(t):
            continue
        key = [t.column(c).to_numpy() for c in names]
        cutoff = int(np.flatnonzero(np.logical_and.reduce([k == k[-1] for k in key]))[0])
        rest = t.slice(cutoff)
        if cutoff:
            yield links(t.slice(0, cutoff))
    if rest is not None:
        yield links(rest)


def links(fps: DataFrame, tau: int = 3, block: int = BLOCK) -> DataFrame:
    """``(a, b)`` of representatives: every pair within tau bits is joined by a path of links."""
    parts, ts = plan(*bit_counts(fps), tau)
    rows = _signatures(fps, parts, ts)
    rows = deal_blocks(rows, ["part", "sig"], "rep", block).select("part", "sig", "pair", "fp", "rep")
    shuffled = rows.repartition("part", "sig", "pair").sortWithinPartitions("part", "sig", "pair")
    return shuffled.mapInArrow(lambda it: _compare(it, tau), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 3, width: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``."""
    prints = cut(fingerprints(docs, id_col, text_col, width))
    fps = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comp = connected_components(links(fps, tau))
    of = fps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")
    return prints.join(of, "fp", "left").select("doc_id", hex16.alias("fingerprint"), component)
