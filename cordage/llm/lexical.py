"""Ranked lexical search: the best documents of each query text by NRA (no random access).

A first pass splits every whole text into terms and writes, a row for each document, its number of
terms and the counts of those that some query has; how often a term occurs, the number of documents
and their length are sums over that table. The search reads the table in shards of bounded size where
they lie, so postings are never shuffled. A shard's postings are sorted by term and falling impact. For
each query its lists are read from the top in growing steps; every document seen has a lower bound (what
has been read) and an upper one (more by the next impact of each list that may still hold it). Reading
ends when no other document can reach the k-th lower bound and those that reach it are resolved, ties
included. A posting's impact is no less than that of a single occurrence in its document, so a list
that has fallen below this cannot hold the document any more: scores are final without reading
lists to their ends. Scores of earlier shards of a task bound the next ones; the shards' best meet in
one ranked window a query, limited before it is shuffled.

Queries are taken in blocks of ``BLOCK_BYTES`` of text, chosen by hash, each with a pass of its own, so what
tasks are sent is bounded whatever the number of queries.

Defined cases: null texts and texts without a term are not documents, and queries of that kind, or that
share no weighted term with a document, have no rows. Each row is a document: repeated ones are counted
and ranked each. Equal scores rank by ascending id, null ids last. Queries repeat once. Empty tables give
no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK_BYTES = 8 << 20
SHARD_DOCS, SHARD_POSTINGS = 65_536, 4_000_000
FIRST_STEP = 256
IMPACT_BITS = 20  # impacts are below a million
#: Letters and digits of ASCII, the large ones small, and every byte of other characters; all else parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document, from its number of terms."""
    if len(n) and 75 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 25 + 75 * n * n_docs // n_terms


def impact(tf: np.ndarray | int, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


@dataclass
class Shard:
    """Impact lists of some documents: list t is ``doc[start[t]:start[t + 1]]``, its impacts falling."""

    start: np.ndarray
    doc: np.ndarray
    impact: np.ndarray
    least: np.ndarray  # each document's impact of a single occurrence
    order: np.ndarray  # each document's place by id

    @classmethod
    def of(cls, ids: pa.Array, n: np.ndarray, term: np.ndarray, tf: np.ndarray, doc: np.ndarray, n_terms: int, norm) -> Shard:
        m = norm(n)
        c = impact(tf, m[doc])
        some = c > 0
        term, c, doc = term[some], c[some], doc[some]
        by = np.argsort((term << IMPACT_BITS) - c, kind="stable")
        order = np.empty(len(n), np.int64)
        order[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(n))
        return cls(np.searchsorted(term[by], np.arange(n_terms + 1)), doc[by], c[by], impact(1, m), order)


def nra(shard: Shard, terms: np.ndarray, weights: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best documents of a shard and their scores (at least ``floor``, above 0), and the postings read."""
    at, end = shard.start[terms], shard.start[terms + 1]
    begin, step = at.copy(), np.full(len(terms), FIRST_STEP)
    lower, seen = np.zeros(len(shard.least), np.int64), np.zeros(len(shard.least), bool)
    wanted = np.ones(len(terms), bool)
    while True:
        for t in np.flatnonzero(wanted & (at < end)):
            to = min(end[t], at[t] + step[t])
            lower[shard.doc[at[t] : to]] += weights[t] * shard.impact[at[t] : to]
            at[t], step[t] = to, 2 * step[t]
        left = at < end
        next_impact = np.where(left, shard.impact[np.minimum(at, len(shard.impact) - 1)], 0) if len(shard.impact) else np.zeros(len(terms), np.int64)
        rest = int((weights * next_impact).sum())  # what a document not seen yet can still reach
        found = np.flatnonzero(lower)
        kth = max(floor, 1, int(np.partition(lower[found], -k)[-k]) if len(found) >= k else 0)
        found = found[lower[found] + rest >= kth]
        more, may = np.zeros(len(found), np.int64), []
        for t in np.flatnonzero(left):
            read = shard.doc[begin[t] : at[t]]
            seen[read] = True
            may.append((t, (next_impact[t] >= shard.least[found]) & ~seen[found]))
            seen[read] = False
            more += np.where(may[-1][1], weights[t] * next_impact[t], 0)
        kept = lower[found] + more >= kth
        if rest >= kth:
            wanted = left
        elif (unsure := kept & (more > 0)).any():
            wanted = np.zeros(len(terms), bool)
            for t, open_ in may:
                wanted[t] = (open_ & unsure).any()
        else:
            found = found[kept]
            best = found[np.lexsort((shard.order[found], -lower[found]))[:k]]
            return best, lower[best], int((at - begin).sum())


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` for each document: its terms that the vocabulary has, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, sizes, terms, tfs = [], [], [], []
            for text in b.column(1).cast(pa.binary()):
                words = terms_of(text.as_py() or b"")
                found = Counter(filter(vocabulary.__contains__, words))
                ns.append(len(words)), sizes.append(len(found))
                terms.extend(map(vocabulary.__getitem__, found)), tfs.extend(found.values())
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            made = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), *made], ["doc_id", "n", "terms", "tfs"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, n long, terms array<int>, tfs array<int>").where("n > 0")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, docs, size = [], 0, 0
    for b in batches:
        held.append(b)
        docs, size = docs + b.num_rows, size + len(b.column(2).flatten())
        if docs >= SHARD_DOCS or size >= SHARD_POSTINGS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, docs, size = [], 0, 0
    if docs:
        yield pa.Table.from_batches(held).combine_chunks()


def best_of_shards(index: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], n_terms: int, norm, k: int) -> DataFrame:
    """``(query, doc_id, score)``: for each shard the documents that can be among a query's k best of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [np.zeros(0, np.int64) for _ in queries]
        for rows in _shards(batches):
            ids, n, terms, tfs = (rows.column(i).combine_chunks() for i in range(4))
            doc = np.repeat(np.arange(len(n)), pa.compute.list_value_length(terms).to_numpy())
            shard = Shard.of(ids, n.to_numpy(), terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64), doc, n_terms, norm)
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            for q, (of, weights) in enumerate(queries):
                best, scores, _ = nra(shard, of, weights, k, int(top[q][-1]) if len(top[q]) == k else 0)
                top[q] = -np.sort(-np.concatenate([top[q], scores]))[:k]
                out.append((q, best, scores))
            which, best, scores = np.repeat([q for q, *_ in out], [len(b) for _, b, _ in out]), np.concatenate([b for _, b, _ in out]), np.concatenate([s for *_, s in out])
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), ids.take(pa.array(best)), pa.array(scores, pa.int64())], ["query", "doc_id", "score"])

    return index.mapInArrow(run, f"query int, doc_id {dict(index.dtypes)['doc_id']}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents of each item."""
    texts = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    parts = [_search_block(docs, texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), k) for b in range(blocks)]
    return functools.reduce(DataFrame.unionByName, parts)


def _search_block(docs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = texts.toArrow()  # a block's texts
    found = [Counter(terms_of(t.as_py())) for t in rows.column("text").cast(pa.binary())]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*found)))}
    index = cut(postings(docs, vocabulary))
    total = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    counted = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # a row a term of the block
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    queries = []
    for f in found:
        ids = np.array([vocabulary[t] for t in f], np.int64)
        w = np.array([weight(total["docs"], int(d)) for d in df[ids]], np.int64) * np.array(list(f.values()), np.int64)
        queries.append((ids[(w > 0) & (df[ids] > 0)], w[(w > 0) & (df[ids] > 0)]))
    norm = functools.partial(length_norm, n_docs=total["docs"], n_terms=total["terms"] or 1)
    best = best_of_shards(index, queries, len(vocabulary), norm, k)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    ids = spark.createDataFrame(pa.table({"query": pa.array(range(len(rows)), pa.int32()), "item_id": rows.column("item_id")}), f"query int, item_id {dict(texts.dtypes)['item_id']}")
    return ranked.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")
