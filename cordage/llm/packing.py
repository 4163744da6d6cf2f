"""Packing into length buckets that a dynamic program chooses over the whole histogram.

Texts are tokenised by a public byte-level BPE vocabulary (a path), and padded to their bucket's boundary.
The exact histogram of all token counts goes to the driver, a row for each count that occurs: their number is at most
the square root of twice all tokens, and no more than the longest text has. The program finds the boundaries with the
least padding of all; a bucket's padding is a straight line in its end, so each of its rounds takes the lower hull of such lines
and is linear in the number of counts. Inside a bucket, documents are dealt to shards of a bounded number of rows by a
hash of id and count, and each shard forms batches whose padded tokens keep to the budget; a shard leaves
at most one short batch. Rows that repeat one id and count more often than a shard holds are dealt one by
one.

``pack`` tells each document's batch and place; with ``keep_tokens`` also its padded token ids. A caller
may give a count of its own instead (``tokens``, a column expression).

Defined cases: null and empty texts have no tokens, a bucket boundary of one cell and fill batches
like any other. A text longer than the budget is a batch of its own, whole. Control strings in texts are
ordinary text. Repeated rows are packed each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, releasing

BUCKETS, BUDGET, SHARD_ROWS, PAD = 8, 8192, 20_000, -1
VOCABULARY = "/opt/tokenizers/byte_bpe_50k"  # .tiktoken and .json, one vocabulary in two forms
# Fixed value: how byte-level BPE cuts texts into pieces.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = re.compile(r"\S{1000}|\s{1000}")  # may be one piece, which tiktoken merges in the square of its length


@functools.lru_cache(2)
def _encoder(path: str):
    import tiktoken

    with open(f"{path}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(2)
def _for_long_pieces(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(f"{path}.json")
    made.encode_special_tokens = True
    return made


def encode(text: str | None, path: str = VOCABULARY) -> list[int]:
    if not text:
        return []
    text = text.encode("utf-8", "replace").decode()
    return _for_long_pieces(path).encode(text, add_special_tokens=False).ids if LONG.search(text) else _encoder(path).encode_ordinary(text)


def tokenized(docs: DataFrame, path: str = VOCABULARY, keep_tokens: bool = False) -> DataFrame:
    """``(doc_id, n_tokens)`` per row, and ``tokens`` if they are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = [encode(t.as_py(), path) for t in part.column(1)]
                columns = [part.column(0), pa.array(list(map(len, ids)), pa.int64()), *([pa.array(ids, pa.list_(pa.int32()))] if keep_tokens else [])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", *(["tokens"] if keep_tokens else [])])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(releasing(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long" + (", tokens array<int>" if keep_tokens else ""))


def best_boundaries(top: np.ndarray, rows: np.ndarray, buckets: int) -> list[int]:
    """Ends (positions in ``top``, the counts in order) of at most ``buckets`` buckets with the least padding.

    A bucket from position i to j pads every text to ``top[j]``: top[j] * (r[j + 1] - r[i]) tokens less those it has, with r
    the running number of rows. For each j the best start is the lowest of the lines cost[i - 1] - r[i] * x at x = top[j]; their
    slopes fall as i grows and x grows with j, so one pass keeps the lines that can still be lowest. Whole numbers, no rounding.
    """
    n, top = len(top), [int(x) for x in top]
    if not n:
        return []
    r = [0, *itertools.accumulate(int(x) for x in rows)]
    cost, back = [top[j] * r[j + 1] for j in range(n)], []  # padded tokens, of which the tokens themselves are the same for all
    for _ in range(1, min(buckets, n)):
        lines, at, best, start = [], 0, [cost[0]], [0]
        for j in range(1, n):
            slope, height = -r[j], cost[j - 1]
            while len(lines) > 1 and (height - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - slope):
                lines.pop()  # lies nowhere below both its neighbours
            lines.append((slope, height, j))
            at = min(at, len(lines) - 1)
            while at + 1 < len(lines) and lines[at + 1][0] * top[j] + lines[at + 1][1] <= lines[at][0] * top[j] + lines[at][1]:
                at += 1
            best.append(lines[at][0] * top[j] + lines[at][1] + top[j] * r[j + 1])
            start.append(lines[at][2])
        cost = best
        back.append(start)
    ends, j = [], n - 1
    for start in reversed(back):
        ends.append(j)
        if start[j] == 0:
            return ends[::-1]
        j = start[j] - 1
    return [*reversed([*ends, j])]


def pack(docs: DataFrame, tokens: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, shard_rows: int = SHARD_ROWS, path: str = VOCABULARY, keep_tokens: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, bucket, padded_to, batch_id, place, batch_rows)`` per row of ``docs``, and the padded ``tokens`` if kept."""
    counted = cut(tokenized(docs, path, keep_tokens) if tokens is None else docs.select("doc_id", tokens.cast("long").alias("n_tokens")))
    histogram = counted.groupBy("n_tokens").agg(F.count("*").alias("rows")).toArrow().sort_by("n_tokens")
    top, rows = (histogram.column(c).to_numpy() if len(histogram) else np.zeros(1, np.int64) for c in ("n_tokens", "rows"))
    ends = best_boundaries(top, rows, buckets)
    starts = [0, *(e + 1 for e in ends[:-1])]
    n_tokens = F.col("n_tokens")
    bucket, upper, shards = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for k, (s, e) in reversed(list(enumerate(zip(starts, ends, strict=True)))):
        inside = n_tokens <= int(top[e])
        bucket = F.when(inside, k).otherwise(bucket)
        upper = F.when(inside, F.lit(int(top[e])).cast("long")).otherwise(upper)
        shards = F.when(inside, F.lit(max(1, math.ceil(int(rows[s : e + 1].sum()) / shard_rows))).cast("long")).otherwise(shards)
    hot = counted.groupBy(F.col("doc_id").alias("_d"), F.col("n_tokens").alias("_n")).agg(F.count("*").alias("_copies")).where(F.col("_copies") > shard_rows)
    rows = counted.withColumn("_row", F.monotonically_increasing_id())  # of a table that is written, so a task that runs again sees the same
    rows = rows.join(hot, F.col("doc_id").eqNullSafe(F.col("_d")) & (n_tokens == F.col("_n")), "left")
    dealt = rows.withColumn("bucket", bucket).withColumn("padded_to", upper).withColumn("shard", F.pmod(F.xxhash64("doc_id", "n_tokens", F.when(F.col("_copies").isNotNull(), F.col("_row"))), shards))
    order = Window.partitionBy("bucket", "shard").orderBy(F.xxhash64("doc_id"), "doc_id", "n_tokens")
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_to"), F.lit(1)))).cast("long")
    placed = dealt.withColumn("rank", F.row_number().over(order) - 1).withColumn("size", size)
    batch = F.concat_ws("-", F.col("bucket"), F.col("shard"), F.floor(F.col("rank") / F.col("size")))
    place = (F.col("rank") % F.col("size")).cast("int").alias("place")
    padded = [F.concat("tokens", F.array_repeat(F.lit(PAD), (F.col("padded_to") - n_tokens).cast("int"))).alias("tokens")] if keep_tokens else []
    return placed.select("doc_id", "n_tokens", "bucket", "padded_to", batch.alias("batch_id"), place, F.col("size").alias("batch_rows"), *padded)


def padding(packed: DataFrame) -> DataFrame:
    """``(bucket, rows, tokens, padded, share)`` for each bucket and, with a null bucket, for all: what padding adds, as a share of all."""
    told = packed.select("n_tokens", "padded_to", F.explode(F.array(F.col("bucket"), F.lit(None).cast("int"))).alias("bucket"))
    return told.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"), F.sum("padded_to").alias("padded")).withColumn("share", F.try_divide(F.col("padded") - F.col("tokens"), F.col("padded")))
