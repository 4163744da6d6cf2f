"""Benchmark decontamination by greedy string tiling.

A benchmark item leaks into a text if tiles, runs of at least ``MIN_MATCH`` words that both share,
cover ``COVERAGE`` of the item's words. Tiles are marked longest first and never overlap, so parts
of an item that were moved about still count. Words are lower-cased ``\\w+``.

1. Every text's windows of MIN_MATCH words are hashed by running Karp-Rabin and looked up in a bit
   table of the items' windows. The table's size is set by the number of windows, within
   ``common.MAX_BITS``; a wrong hit costs a join row, none is missed. Only texts with hits go on.
2. Hits are joined to the items' windows, of each item only its rarest: as many as a text that covers it
   can't miss all of. A window that very many items share thus joins nothing to most of them.
3. Each pair of distinct text and item is tiled.

Defined cases: null and wordless texts or items share nothing; null item ids are left out. An item
shorter than MIN_MATCH words leaks if it is in the text whole. Copies of a text, or of an item, are
tiled once and reported for every id; repeated rows are reported once. Equal matches are marked in the
order of their places. Very long texts are read whole; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_table, cut, releasing

MIN_MATCH, COVERAGE = 5, 0.8
WORD = re.compile(r"\w+")
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so that products of its powers lose nothing modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_hashes(found: list[str], known: dict[str, int]) -> np.ndarray:
    if len(known) > 500_000:
        known.clear()
    for w in set(found):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"), 1)
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Running Karp-Rabin: a polynomial over the words' hashes for every window."""
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(BASE) + h[k : k + n]
    return out


class Windows:
    """Karp-Rabin hashes of a sequence's windows of any width, from one pass of prefix sums."""

    def __init__(self, codes: np.ndarray):
        power = lambda base: np.cumprod(np.append(np.uint64(1), np.full(len(codes), base, np.uint64)), dtype=np.uint64)
        self.back = power(INVERSE)
        self.sums = np.append(np.uint64(0), np.cumsum(codes * power(BASE)[:-1], dtype=np.uint64))

    def of(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.back[:n]


def _reach(open_: np.ndarray) -> np.ndarray:
    """How many open places there are in a row from each place on."""
    n = len(open_)
    shut = np.append(np.where(open_, n, np.arange(n)), n)
    return np.minimum.accumulate(shut[::-1])[::-1][:n] - np.arange(n)


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which of h are in the sorted table."""
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def tiles(text: list[str], item: list[str], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in text, place in item, length), longest first, ties by place in text, then in item.

    The greatest width at which both have an unmarked window in common is found by halving; all tiles
    of that width are marked from left to right, and so on below it. Memory is a few numbers a word.
    """
    if not item:
        return []
    least = max(1, min(min_match, len(item)))
    index = {w: i for i, w in enumerate(dict.fromkeys(item))}
    b = np.array([index[w] for w in item], np.int64)
    a = np.fromiter((index.get(w, -1) for w in text), np.int64, len(text))
    mixed = np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 7) for i in range(len(index))], np.uint64)
    in_a, in_b = Windows(np.where(a < 0, np.uint64(0), mixed[a])), Windows(mixed[b])
    free_a, free_b, found = a >= 0, np.ones(len(b), bool), []  # words that the item lacks count as marked

    def common(width: int) -> bool:
        at_a, at_b = np.flatnonzero(reach_a >= width), np.flatnonzero(reach_b >= width)
        return bool(len(at_a) and len(at_b) and _among(in_a.of(width)[at_a], np.sort(in_b.of(width)[at_b])).any())

    width = min(len(a), len(b)) + 1
    while True:
        reach_a, reach_b = _reach(free_a), _reach(free_b)
        low, high = least - 1, min(width - 1, int(reach_a.max(initial=0)), int(reach_b.max(initial=0)))
        while low < high:  # the greatest width with a common window
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        width = low
        if width < least:
            return found
        at, of_b = np.flatnonzero(reach_a >= width), in_b.of(width)
        of_a = in_a.of(width)[at]
        while len(at):
            at_b = np.flatnonzero(_reach(free_b) >= width)
            hit = np.flatnonzero(_among(of_a, np.sort(of_b[at_b]))) if len(at_b) else at_b
            if not len(hit):
                break
            x, h = int(at[hit[0]]), of_a[hit[0]]
            y = next((int(y) for y in at_b[of_b[at_b] == h] if (a[x : x + width] == b[y : y + width]).all()), None)
            if y is not None:
                free_a[x : x + width] = free_b[y : y + width] = False
                found.append((x, y, width))
            after = np.searchsorted(at, x + (1 if y is None else width))
            at, of_a = at[after:], of_a[after:]


def _rare_seeds(items: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """``(item_key, seed, width)``: the windows by which each item is found, its rarest ones among all items.

    Tiles that cover C words of an item hold at least C / min_match of its windows. So of P windows any
    P - C / min_match + 1 will do, and those that fewest items share make the smallest join.
    """

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for item, text in zip(b.column(0), b.column(1), strict=True):
                h = word_hashes(words(text.as_py()), known)
                width = min(min_match, len(h))
                if width:
                    own, n = np.unique(window_hashes(h, width).view(np.int64), return_counts=True)
                    need = max(1, math.ceil(math.ceil(coverage * len(h) - 1e-9) / width))
                    for column, value in zip(out, ([item.as_py()] * len(own), own.tolist(), [width] * len(own), n.tolist(), [int(n.sum()) - need + 1] * len(own)), strict=True):
                        column.extend(value)
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["item_key", "seed", "width", "n", "enough"])

    found = cut(items.mapInArrow(releasing(seeds), "item_key string, seed long, width int, n long, enough long"))
    shared = found.groupBy("seed").agg(F.count("*").alias("shared"))
    order = Window.partitionBy("item_key").orderBy("shared", "seed").rowsBetween(Window.unboundedPreceding, 0)
    ranked = found.join(shared, "seed").withColumn("before", F.sum("n").over(order) - F.col("n"))
    return ranked.where("before < enough").select("item_key", "seed", "width")


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, text_key, item_id, coverage, n_tiles, longest)``; text_key is the text's sha256."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    named = benchmark.select("item_id", F.col("text").cast("string").alias("item_text")).where("item_text is not null and item_id is not null").distinct()
    named = named.withColumn("item_key", F.sha2("item_text", 256))
    items = named.select("item_key", "item_text").distinct()
    item_seeds = cut(_rare_seeds(items, min_match, coverage))
    facts = item_seeds.agg(F.count("*").alias("n"), F.collect_set("width").alias("widths")).first()
    table, widths = bit_table(item_seeds.select("seed"), facts["n"]), sorted(facts["widths"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            at, hits = [], []
            for i, text in enumerate(b.column(1)):
                h = word_hashes(words(text.as_py()), known)
                got = [s[table.has(s)] for s in (window_hashes(h, w) for w in widths)]
                if any(map(len, got)):
                    at.append(i), hits.append(np.unique(np.concatenate(got)).view(np.int64))
            kept = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "text", "seeds"])

    found = cut(texts.mapInArrow(releasing(probe), f"doc_id {dict(texts.dtypes)['doc_id']}, text string, seeds array<long>").withColumn("text_key", F.sha2("text", 256)))
    pairs = found.select("text_key", F.explode("seeds").alias("seed")).distinct().join(item_seeds.select("item_key", "seed"), "seed").select("text_key", "item_key").distinct()
    one = found.groupBy("text_key").agg(F.first("text").alias("text"))  # equal keys hold equal texts
    work = pairs.join(one, "text_key").join(items, "item_key").select("text_key", "item_key", "text", "item_text")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                item = words(b.column(3)[i].as_py())
                got = tiles(words(b.column(2)[i].as_py()), item, min_match)
                rows.append((sum(n for *_, n in got) / max(1, len(item)), len(got), max((n for *_, n in got), default=0)))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["text_key", "item_key", "coverage", "n_tiles", "longest"])

    tiled = work.mapInArrow(releasing(tile), "text_key string, item_key string, coverage double, n_tiles int, longest int")
    leaked = tiled.where(F.col("coverage") >= coverage).join(named.select("item_key", "item_id"), "item_key")
    return found.select("doc_id", "text_key").distinct().join(leaked, "text_key").select("doc_id", "text_key", "item_id", "coverage", "n_tiles", "longest")
