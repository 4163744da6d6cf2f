"""Spelling variants: words that differ by one letter, found by probing generated edits against Bloom filters.

Words are counted inside each task before they are shuffled. The vocabulary's filters are sharded by
word length and blocked: a word sets ``PROBES`` bits in one block of 64. For each word its deletions and
half of its replacements (by letters behind the one replaced; the other half is found from the other
word; insertions are deletions seen from the longer word) are probed in numpy by hashes that follow
from the word's own. Only positives become strings and are shuffled, to an exact join with the vocabulary,
which removes the false ones. Each near pair is so found once, and then counted from both ends.

The filters that tasks are sent hold at most ``FILTER_BYTES``: a larger vocabulary is probed in rounds,
each with some lengths (or a slice by hash of one), for which only words of those lengths, or longer by
one, generate edits. Nothing is left out.

Defined cases: null texts have no words; with a null id nothing is deleted. Repeated rows count each. Very
long runs are words like any other. An empty table gives no rows. Ties of the largest count go to the word that is first in
code-point order. A form has at least twice the count of its word, so chains of forms end. Other columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

MIN_LENGTH, MIN_COUNT, DROP = 5, 3, 97
FILTER_BYTES, BITS_A_WORD, PROBES = 32 << 20, 24, 5
HELD_WORDS = 400_000  # counted in a task before they are handed on
STEP = 1 << 21  # edits whose hashes a task holds at a time
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: Bytes of Latin-1 that words are made of, A-Z made small; all else parts them.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str) -> list[bytes]:
    """The runs of letters, a byte a code point; what Latin-1 lacks becomes a question mark, which parts runs."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of the documents' words, after the deletions that the ids and runs decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for b in batches:
            for id_, text in zip(b.column(0), b.column(1), strict=True):
                head = None if (i := id_.as_py()) is None else zlib.crc32(f"{i}:".encode())
                for word, times in Counter(runs_of(text.as_py())).items():
                    if len(word) < MIN_LENGTH:
                        continue
                    if head is not None and (h := zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), head)) % DROP == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) < MIN_LENGTH:
                            continue
                    held[word] = held.get(word, 0) + times
                if len(held) >= HELD_WORDS:
                    yield out()
        yield out()

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mix(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (keys ^ (keys >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return keys ^ (keys >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), BASE, np.uint64)]), dtype=np.uint64)[:n]


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the words' places and a matrix of their bytes."""
    sizes = np.array([len(w) for w in words], np.int64)
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        yield at, np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), length)


def hashes(letters: np.ndarray) -> np.ndarray:
    """A polynomial in ``BASE`` for each row of letters."""
    return (letters * _powers(letters.shape[1])).sum(1, dtype=np.uint64)


@dataclass
class Shards:
    """Where each length's filter begins and how many blocks it has, and which slice of its words it holds."""

    of: dict[int, tuple[int, int, int, int]]  # length: first block, blocks, slice, slices
    blocks: int

    def places(self, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' blocks and bits, and whether they are in the slice."""
        first, blocks, part, parts = self.of[length]
        mixed = _mix(keys)
        bits = np.zeros(mixed.shape, np.uint64)
        for k in range(PROBES):
            bits |= np.uint64(1) << ((mixed >> np.uint64(6 * k)) & np.uint64(63))
        block = (first + ((mixed >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        return block, bits, (_mix(mixed) % np.uint64(parts) == part) if parts > 1 else np.ones(mixed.shape, bool)


def plan_rounds(counts: dict[int, int], filter_bytes: int = FILTER_BYTES) -> list[Shards]:
    """Shards of the lengths' filters, dealt to rounds of bounded size."""
    most, rounds = filter_bytes // 8, [Shards({}, 0)]
    for length, n in sorted(counts.items()):
        blocks = max(16, -(-n * BITS_A_WORD // 64))
        parts = -(-blocks // most)
        for part in range(parts):
            own = -(-blocks // parts)
            if rounds[-1].of and (rounds[-1].blocks + own > most or length in rounds[-1].of):
                rounds.append(Shards({}, 0))
            rounds[-1].of[length] = (rounds[-1].blocks, own, part, parts)
            rounds[-1].blocks += own
    return rounds


def _encoded(column: pa.Array) -> list[bytes]:
    return [w.as_py().encode("latin-1") for w in column]


def build_filter(vocabulary: DataFrame, shards: Shards) -> np.ndarray:
    """The blocks of a round's filters: bits set in tasks, joined by OR."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for _, letters in _by_length(_encoded(b.column(0))):
                block, mask, own = shards.places(hashes(letters), letters.shape[1])
                blocks.append(block[own]), bits.append(mask[own])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks)), pa.array(np.concatenate(bits).view(np.int64))], ["block", "bits"])

    words = vocabulary.where(F.length("word").isin(list(shards.of))).select("word")
    rows = words.mapInArrow(fill, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()  # FILTER_BYTES / 8 rows at most
    made = np.zeros(max(1, shards.blocks), np.uint64)
    made[rows.column("block").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return made


def edits(letters: np.ndarray, alphabet: np.ndarray, shards: Shards, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, letter) of the edits that the filters may hold; letter -1 stands for a deletion.

    Deleting any of several equal letters gives one word: only the first of them is deleted.
    """
    rows, length = letters.shape
    power = _powers(length)
    part = letters * power
    whole = part.sum(1, dtype=np.uint64)

    def held(keys: np.ndarray, of: int) -> np.ndarray:
        block, bits, own = shards.places(keys, of)
        return own & (table[block] & bits == bits)

    if length - 1 in shards.of:
        before = np.cumsum(part, 1, dtype=np.uint64) - part
        keys = before + (whole[:, None] - before - part) * np.uint64(BACK)
        first = np.ones(letters.shape, bool)
        first[:, 1:] = letters[:, 1:] != letters[:, :-1]
        row, at = np.nonzero(held(keys, length - 1) & first)
        yield row, at, np.full(len(row), -1)
    if length in shards.of:
        places, deep = max(1, STEP // (len(alphabet) * min(rows, 1024))), min(rows, 1024)
        for top in range(0, rows, deep):
            for left in range(0, length, places):
                own = letters[top : top + deep, left : left + places]
                other = alphabet[None, None].astype(np.uint64) - own[..., None].astype(np.uint64)  # wraps, as the hash does
                keys = whole[top : top + deep, None, None] + other * power[left : left + places, None]
                row, at, letter = np.nonzero(held(keys, length) & (alphabet > own[..., None]))
                yield row + top, at + left, alphabet[letter].astype(np.int64)


def probe(vocabulary: DataFrame, alphabet: np.ndarray, shards: Shards, table: np.ndarray) -> DataFrame:
    """``(word, n, other)``: the edits of each word that the round's filters may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, source, other = _encoded(b.column(0)), [], []
            for at, letters in _by_length(words):
                for row, place, letter in edits(letters, alphabet, shards, table):
                    for r, p, c in zip(at[row].tolist(), place.tolist(), letter.tolist(), strict=True):
                        w = words[r]
                        source.append(r), other.append((w[:p] + w[p + 1 :] if c < 0 else w[:p] + bytes((c,)) + w[p + 1 :]).decode("latin-1"))
            took = b.take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(other, pa.string())], ["word", "n", "other"])

    sizes = sorted({x + d for x in shards.of for d in (0, 1)})
    return vocabulary.where(F.length("word").isin(sizes)).select("word", "n").mapInArrow(run, "word string, n long, other string")


def letters_of(vocabulary: DataFrame) -> np.ndarray:
    """The letters that occur, in order (at most 90)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(b"".join(_encoded(b.column(0))))), pa.int32())], ["letter"])

    found = vocabulary.select("word").mapInArrow(run, "letter int").distinct().toArrow()
    return np.sort(found.column("letter").to_numpy()).astype(np.uint8)


def near_pairs(vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``(word, n, other, other_n)``: every two words that differ by one edit, once."""
    counts = {r["length"]: r["n"] for r in vocabulary.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    alphabet, known, found = letters_of(vocabulary), vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), []
    for shards in plan_rounds(counts, filter_bytes):
        found.append(probe(vocabulary, alphabet, shards, build_filter(vocabulary, shards)))
    return functools.reduce(DataFrame.unionByName, found).join(known, "other").select("word", "n", "other", "other_n")


def last_forms(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of words that have a form: forms followed to the last, twice as far each round."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        old, at = at, cut(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        forget(old)
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def variants(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of the vocabulary."""
    vocabulary = cut(count_words(docs).where(F.col("n") >= MIN_COUNT))
    ends = F.explode(F.array(F.struct("word", "n", F.col("other").alias("near"), F.col("other_n").alias("near_n")), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    both = near_pairs(vocabulary, filter_bytes).select(ends.alias("x")).select("x.*")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    form = F.col("best.less") <= -2 * F.col("n")
    told = cut(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.form")).alias("form"), F.when(form, -F.col("best.less")).alias("form_n")))
    forget(vocabulary)
    return told.join(last_forms(told.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
