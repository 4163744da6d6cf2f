"""SimHash near-duplicates of five-word shingles, verified by exact Jaccard similarity, none missed.

A text is the set of its five-word shingles (words as in ``simhash``; fewer words make one shingle). A
shingle's hash is made of its words' hashes and a word's of its bytes, by running Karp-Rabin, all at once.
Two texts are linked if their sets' similarity is at least 4/5; wordless and null texts are copies
of each other.

1. Equal sets are one node. Nodes are probed by their SimHash fingerprints (``simhash.links``), and what
   is found is verified on the full sets. Fingerprints within three bits are not all that is 4/5 similar,
   so two further steps complete the search.
2. In one order of all shingles, two sets within the similarity share a shingle among the first
   n - ceil(4n/5) + 1 of each (n its size), whatever the order. Common shingles, known from a sample that
   grows with the input, come last, which keeps groups small. Shingles under which one node stands are
   sifted out by a bit table before rows are joined. The nodes under a shingle are compared with one of
   them: each node with the ``STAR`` centres that it shares most shingles with.
3. Nodes under one shingle that no path joins by then are compared all with all, by size and place: a set
   whose first shared shingle stands at some place can be similar only to sets of certain sizes. Only ids,
   sizes, places and short parities of small sets are shuffled for that. Large groups are dealt to several tasks. Of the pairs that are
   left, those with the most alike parities are verified first, ``STAR`` for each node, and then those that
   no path joins even so.

Before full sets are read, a pair must pass by parities: every element that two sets do not share changes
at most one bit of a table of parities, so tables that differ in more bits than similar sets of these
sizes may differ in elements rule a pair out. A set's table has as many bits as the set has elements.

So a large group of copies costs rows, not pairs; every candidate is verified on the full sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import bit_table, connected_components, cut, forget, releasing
from .decontaminate import BASE, INVERSE, window_hashes

WIDTH, STAR, BLOCK, SLICE = 5, 4, 1024, 512
LEAST_BITS = 512  # in a set's table of parities, a power of two
BEFORE = 4  # shingles before its own that a row knows, so that a pair is made under the first that it shares
SAMPLE, SHARE, COMMON, OFTEN = 4_000, 32, 200_000, 3  # texts to look for common shingles, or one in so many; how many of them to know, the least count
SMALL, SMALL_BITS = 512, 256  # sets up to this size have a short table of parities beside, which their rows under shingles carry
SHORT_ODD = [f"odd{k}" for k in range(SMALL_BITS // 64)]
CHUNK = 1 << 16  # rows under shingles that are compared at once, beside a group's rest
SHORT = (1 << 40) - 1  # the part of a hash that is shuffled; more meet under it, none is missed


# Each byte's number: 0 for white space, and A-Z as a-z.
CODES = np.array([0 if c == 32 or 9 <= c <= 13 else 1 + (c + 32 if 65 <= c <= 90 else c) for c in range(256)], np.uint64)


@functools.lru_cache(4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    power = lambda base: np.cumprod(np.append(np.uint64(1), np.full((1 << bits) - 1, base, np.uint64)), dtype=np.uint64)
    return power(BASE), power(INVERSE)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(text: str | None) -> np.ndarray:
    codes = CODES[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]
    n = len(codes)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], codes != 0, [False]])))
    start, stop = edges[::2], edges[1::2]
    up, back = _powers(max(12, n.bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[:n], dtype=np.uint64)])
    return _mix((sums[stop] - sums[start]) * back[start])


def shingle_hashes(text: str | None) -> np.ndarray:
    """A mixed 64-bit hash of every shingle, repeats included."""
    h = _word_hashes(text)
    return _mix(window_hashes(h, min(WIDTH, len(h)))) if len(h) else h


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text))


def _node(own: np.ndarray) -> int:
    """The set's name: XXH64 of its sorted hashes, as a signed long."""
    return int(np.array(xxhash.xxh64_intdigest(own.tobytes(), 42), np.uint64).view(np.int64))


def _parities(own: np.ndarray, bits: int = 0) -> bytes:
    """Bit i tells whether an odd number of elements falls on it; there are as many bits as elements, rounded up to a power of two."""
    bits = bits or max(LEAST_BITS, 1 << (len(own) - 1).bit_length() if len(own) else 0)
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _differing(x: pa.Array, y: pa.Array) -> np.ndarray:
    """In how many bits two tables of parities differ, row by row; the longer one is folded to the length of the shorter."""
    lengths = [np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for c in (x, y)]
    out = np.zeros(len(x), np.int64)
    for shape in set(zip(*(n.tolist() for n in lengths), strict=True)):
        at, tables = np.flatnonzero((lengths[0] == shape[0]) & (lengths[1] == shape[1])), []
        for c, width in zip((x, y), shape, strict=True):
            t = np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), width)
            while t.shape[1] > min(shape):
                t = t[:, : t.shape[1] // 2] ^ t[:, t.shape[1] // 2 :]
            tables.append(t)
        out[at] = np.bitwise_count(tables[0] ^ tables[1]).sum(1)
    return out


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many texts of a sample hold; it only sets the order.

    As the sample grows with the input, what it misses is held by about as few texts, however many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.zeros(0, np.uint64), *(shingle_set(t.as_py()) for t in b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    texts = docs.select(F.col("text").cast("string").alias("text")).sample(min(1.0, max(SAMPLE / max(1, docs.count()), 1 / SHARE)), 42)
    often = texts.mapInArrow(releasing(run), "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    return np.sort(often.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow().column(0).to_numpy().view(np.uint64))


def prints(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """``(doc_id, text_hash, node, n, fp, prefix)`` per row: the text's XXH64 as Spark has it, the set's name and size, the
    text's fingerprint, the shingles that the set is found by and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            nodes, sizes, fps, first, odd, short = [], [], [], [], [], []
            for t in b.column(1):
                h = shingle_hashes(t.as_py())
                own = np.unique(h)
                known = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own if len(common) else np.zeros(len(own), bool)
                nodes.append(_node(own)), sizes.append(len(own)), fps.append(simhash.fingerprint_of(h)), odd.append(_parities(own))
                short.append(np.frombuffer(_parities(own, SMALL_BITS), np.int64) if len(own) <= SMALL else np.zeros(len(SHORT_ODD), np.int64))
                first.append((np.concatenate([own[~known], own[known]])[: prefix_length(len(own))] & np.uint64(SHORT)).view(np.int64))
            columns = [b.column(0), b.column(2), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(first, pa.list_(pa.int64())), pa.array(odd, pa.binary())]
            columns += [pa.array(c) for c in np.stack(short).T]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "n", "fp", "prefix", "odd", *SHORT_ODD])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(releasing(run), "doc_id long, text_hash long, node long, n int, fp long, prefix array<long>, odd binary" + "".join(f", {c} long" for c in SHORT_ODD))


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, set)`` for each of ``nodes(node, doc_id)``, read again from the texts where they stand."""
    table = bit_table(nodes.select("doc_id"), nodes.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            hits = np.flatnonzero(table.has(ids.fill_null(0).to_numpy().view(np.uint64)) & ids.is_valid().to_numpy(zero_copy_only=False))
            for at in range(0, len(hits), SLICE):
                own = [shingle_set(b.column(1)[i].as_py()) for i in hits[at : at + SLICE].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in own], pa.int64()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], ["node", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(releasing(run), "node long, set array<long>").join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b, n_a, n_b, far)`` of those of ``pairs(a, b)`` that sizes and parities let be 4/5 similar; far: the share of bits that differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            differ, both = _differing(b.column(4), b.column(5)), b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
            near = np.flatnonzero(9 * differ <= both)
            far = pa.array((differ / np.maximum(both, 1))[near].astype(np.float32))
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(near)) for i in range(4)), far], ["a", "b", "n_a", "n_b", "far"])

    size = nodes.select("node", "n", "odd")
    near = pairs.join(size.toDF("a", "n_a", "odd_a"), "a").join(size.toDF("b", "n_b", "odd_b"), "b").where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
    return near.select("a", "b", "n_a", "n_b", "odd_a", "odd_b").mapInArrow(releasing(run), "a long, b long, n_a int, n_b int, far float")


def _verified(near: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``near(a, b, n_a, n_b)`` whose sets are at least 4/5 similar; ``near`` is read twice."""
    own = cut(nodes.select("node", "doc_id").join(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"))
    sets = cut(_sets(docs, own))
    full = near.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    both = F.size(F.array_intersect("set_a", "set_b"))
    links = cut(full.where(9 * both >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b"))
    forget(own, sets)
    return links


def _can(n_a: str, at_a: str, n_b: str, at_b: str) -> Column:
    """Whether two sets can be 4/5 similar if the first shingle they share stands at these places."""
    return 9 * F.least(F.col(n_a) - F.col(at_a), F.col(n_b) - F.col(at_b)) >= 4 * (F.col(n_a) + F.col(n_b))


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b)``: the pairs of each group of ``(h, pair)`` that sizes, places and short parities allow, of different components.

    Rows come sorted by group and size; a group that goes over a chunk's end is carried on (it is bounded).
    """

    def pairs(t: pa.Table) -> pa.RecordBatch:
        h, pair, own, node, n, at, c = (t.column(k).to_numpy() for k in ("h", "pair", "own", "node", "n", "at", "c"))
        before, odd = (np.stack([t.column(k).to_numpy() for k in names]) for names in ([f"before{k}" for k in range(BEFORE)], SHORT_ODD))
        new = np.append(True, (h[1:] != h[:-1]) | (pair[1:] != pair[:-1]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(h)))
        last, within = np.repeat(start + size, size), (pair >> 31) == (pair & ((1 << 31) - 1))
        n, at, found, i, lag = n.astype(np.int64), at.astype(np.int64), ([], []), np.arange(len(h)), 0
        while len(i):
            lag += 1
            i = i[i + lag < last[i]]
            i = i[4 * n[i + lag] <= 5 * n[i]]  # the next are larger still
            j = i + lag
            can = (c[i] != c[j]) & (within[i] | (own[i] != own[j])) & (9 * np.minimum(n[i] - at[i], n[j] - at[j]) >= 4 * (n[i] + n[j]))
            x, y = i[can], j[can]
            near = (np.maximum(n[x], n[y]) > SMALL) | (9 * np.bitwise_count((odd[:, x] ^ odd[:, y]).view(np.uint64)).sum(0, dtype=np.int64) <= n[x] + n[y])
            x, y = x[near], y[near]
            known = ((before[:, None, x] == before[None, :, y]) & (before[:, None, x] >= 0)).any((0, 1))
            found[0].append(node[x[~known]]), found[1].append(node[y[~known]])
        a, b = (np.concatenate([np.zeros(0, np.int64), *f]) for f in found)
        once = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in once], ["a", "b"])

    rest: list[pa.RecordBatch] = []
    for b in batches:
        rest.append(b)
        if sum(r.num_rows for r in rest) < CHUNK:
            continue
        t = pa.Table.from_batches(rest).combine_chunks()
        h, pair = t.column("h").to_numpy(), t.column("pair").to_numpy()
        cutoff = int(np.flatnonzero((h == h[-1]) & (pair == pair[-1]))[0])
        rest = t.slice(cutoff).to_batches()
        if cutoff:
            yield pairs(t.slice(0, cutoff))
    if sum(r.num_rows for r in rest):
        yield pairs(pa.Table.from_batches(rest).combine_chunks())


def _apart(rows: DataFrame, odd: DataFrame, comp: DataFrame, block: int) -> DataFrame:
    """``(a, b)`` under one shingle that no path joins yet and whose sizes and places allow the similarity.

    A pair that also shares one of the ``BEFORE`` shingles before this one is left to that one: what allows it here allows it
    at the earlier place too, so it is made there. Few pairs are made twice, and none is missed.
    """
    rows = rows.join(comp.withColumnRenamed("component", "_c"), "node", "left").select("h", "node", "n", "at", F.coalesce("_c", "node").alias("c"))
    groups = rows.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size")).where("low <> high")
    blocks = F.when(F.col("size") > block, F.ceil(F.col("size") * 2 / block)).otherwise(1).cast("int")
    place = Window.partitionBy("node").orderBy("at")
    rows = rows.join(groups.select("h", blocks.alias("blocks")), "h")
    rows = rows.select("*", *(F.coalesce(F.lag("h", k + 1).over(place), F.lit(-1)).alias(f"before{k}") for k in range(BEFORE))).join(odd, "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("own", "other").cast("long") * F.lit(1 << 31) + F.greatest("own", "other")
    rows = rows.select("h", pair.alias("pair"), "own", "node", "n", "at", "c", *(f"before{k}" for k in range(BEFORE)), *SHORT_ODD)
    return rows.repartition("h", "pair").sortWithinPartitions("h", "pair", "n").mapInArrow(releasing(_crossed), "a long, b long").distinct()


def _under(nodes: DataFrame) -> DataFrame:
    """``(h, node, n, at, centre, n_c, at_c)``: nodes under every shingle that is in the prefix of two or more."""
    all_ = nodes.select("node", "n", F.posexplode("prefix").alias("at", "h"))
    mixed = F.col("node").bitwiseXOR(F.col("h"))  # another order of the nodes under each shingle, so that a group has many centres
    shared = cut(all_.groupBy("h").agg(F.min(mixed).alias("low"), F.max(mixed).alias("high")).where("low <> high").select("h", F.col("low").bitwiseXOR(F.col("h")).alias("centre")))
    table = bit_table(shared.select("h"), shared.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            h, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            hit = np.flatnonzero(table.has(h.view(np.uint64))) if len(h) else np.zeros(0, np.int64)
            of = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([pa.array(h[hit]), b.column(0).take(of), b.column(1).take(of), pa.array(at[hit].astype(np.int32))], ["h", "node", "n", "at"])

    rows = nodes.select("node", "n", "prefix").mapInArrow(releasing(run), "h long, node long, n int, at int")
    joined = cut(rows.join(shared, "h"))
    centres = joined.where("node = centre").select("h", F.col("n").alias("n_c"), F.col("at").alias("at_c"))
    under = cut(joined.join(centres, "h"))
    forget(shared, joined)
    return under


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(doc_id, text_hash, component, component_id)``, one row per row of ``docs``; a null id links with nothing and has a null component.

    Different components have different ``component``; unlinked texts of one id can share a component id. Component ids are the smallest doc_id reached. Repeated rows get a row each; an
    empty table gives none; other columns are ignored.
    """
    rows = cut(prints(docs, common_shingles(docs)))
    name = cut(rows.select("doc_id", "text_hash", "node"))
    found = cut(rows.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ("n", "prefix", "odd", *SHORT_ODD))))
    forget(rows)
    under = _under(found)
    nodes = cut(found.drop("prefix"))
    forget(found)
    fps = cut(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    alike = nodes.join(fps, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    probed = simhash.links(fps, block=block).unionByName(alike)
    star = under.where("centre <> node").where(_can("n", "at", "n_c", "at_c")).groupBy("node", "centre").agg(F.count("*").alias("shared"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "centre"))
    star = star.withColumn("place", best).where(F.col("place") <= STAR).select(F.col("node").alias("a"), F.col("centre").alias("b"))
    first = cut(probed.unionByName(star).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    near = cut(_alike(first, nodes))
    links = _verified(near, nodes, docs)
    pairs = cut(_apart(under.select("h", "node", "n", "at"), nodes.select("node", *SHORT_ODD), connected_components(links), block))
    forget(under, near)
    more = cut(_alike(pairs.join(first, ["a", "b"], "left_anti"), nodes))
    forget(first, pairs)
    ends = more.select("*", F.explode(F.array("a", "b")).alias("node"))
    best = F.row_number().over(Window.partitionBy("node").orderBy("far", "a", "b"))
    nearest = cut(ends.withColumn("place", best).where(F.col("place") <= STAR).select("a", "b", "n_a", "n_b").distinct())
    links = links.unionByName(_verified(nearest, nodes, docs))
    of = connected_components(links).withColumnRenamed("component", "c")
    rest = more.join(nearest, ["a", "b"], "left_anti").join(of.toDF("a", "c_a"), "a", "left").join(of.toDF("b", "c_b"), "b", "left")
    rest = cut(rest.where(~F.coalesce("c_a", "a").eqNullSafe(F.coalesce("c_b", "b"))).select("a", "b", "n_a", "n_b"))
    links = links.unionByName(_verified(rest, nodes, docs))
    of = nodes.select("node", "doc_id").join(connected_components(links), "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = cut(of.join(least, "component").select("node", "component", "component_id"))
    known = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    out = cut(name.join(named, "node", "left").select("doc_id", "text_hash", known("component"), known("component_id")))
    forget(name, nodes, fps, more, nearest, rest, named)
    return out
