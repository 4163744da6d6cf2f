"""The pipeline's near-duplicates stage against exact Jaccard similarity of all pairs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cordage.llm import jaccard
from test_llm_operators import docs, roots, say


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(7)
    texts = [t for n in (6, 12, 40, 90) for base in [say(rng, n) for _ in range(4)] for t in [base, base, *(edited(rng, base, k) for k in (1, 1, 1, 2, 3))]]
    hot = say(rng, 120)
    texts += [edited(rng, hot, k % 5) for k in range(90)]  # some of these are linked to none
    texts += [hot + " " + say(rng, 25) for _ in range(8)] + ["", None, " ", "two words", "Two  Words", "two word"]
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [8, 1024])
def test_all_pairs_of_similarity_four_fifths_are_joined(spark, block):
    texts = corpus()
    own = [shingles(t) for _, t in texts]
    want = roots(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if similar(own[a], own[b])])
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs(spark, [*texts, (None, "two words")]), block).collect()}
    assert got.pop(None) is None and got == dict(enumerate(want))


def test_stage_keeps_one_of_each_component(spark):
    texts = corpus()
    own = [shingles(t) for _, t in texts]
    want = roots(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if similar(own[a], own[b])])
    kept = corpus_pipeline.drop_near_duplicates(spark, docs(spark, [*texts, (None, "x"), (None, "x")]), "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want)) and sum(r.doc_id is None for r in kept) == 2
    assert jaccard.near_duplicates(docs(spark, [])).count() == 0


def test_prefix_is_long_enough():
    assert all(5 * (n - jaccard.prefix_length(n) + 1) >= 4 * n > 5 * (n - jaccard.prefix_length(n)) for n in range(1, 500))
    assert jaccard.prefix_length(0) == 0 and np.array_equal(jaccard.shingle_set(None), np.zeros(0, np.uint64))


def test_parities_rule_out_large_sets_that_share_a_part_and_no_similar_ones():
    rng = np.random.default_rng(3)
    for n in (1, 30, 512, 700, 1100, 5000, 20000):
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        like = np.unique(np.concatenate([base[: n - n // 10], base[n : n + n // 12]]))  # 4/5 similar at least
        far = np.unique(np.concatenate([base[: n // 2], base[n : n + n // 2]]))  # 1/3
        tables = [pa.array([jaccard._parities(np.unique(base[:n])), jaccard._parities(like), jaccard._parities(like)], pa.binary()).slice(1)]
        tables.append(pa.array([jaccard._parities(np.unique(base[:n])), jaccard._parities(far)], pa.binary()))
        differ = jaccard._differing(*tables)
        exact = len(np.setxor1d(base[:n], like))
        assert differ[0] <= exact and (n < 30 or 9 * differ[0] <= n + len(like))
        assert n < 30 or 9 * jaccard._differing(pa.array([jaccard._parities(np.unique(base[:n]))], pa.binary()), tables[1][1:])[0] > n + len(far)


def test_only_as_many_pairs_are_verified_as_there_are_texts(spark, monkeypatch):
    """Before, every pair of long texts that share a passage was verified, and every pair of a dense group."""
    rng, seen = random.Random(11), []
    passage, hot = say(rng, 700), say(rng, 100)
    texts = [passage + " " + say(rng, 900) for _ in range(60)] + [edited(rng, hot, 2 + k % 3) for k in range(60)]
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "OFTEN", 1000)  # as in a large table, of which the sample does not know the passage
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs(spark, list(enumerate(texts)))).collect()}
    own = [shingles(t) for t in texts]
    assert got == dict(enumerate(roots(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if similar(own[a], own[b])])))
    assert sum(seen) <= 8 * len(texts), seen


def test_blocks_of_a_large_group_meet_each_other():
    """Rows of one shingle in two blocks: pairs across them are made once, pairs inside one are left to its own group."""
    row = lambda node, own, c, pair=1, n=10, at=0, before=-1, bits=0: {"h": 5, "pair": pair, "own": own, "node": node, "n": n, "at": at, "c": c, **{f"before{k}": before for k in range(jaccard.BEFORE)}, **{k: bits for k in jaccard.SHORT_ODD}}
    pairs = lambda rows: sorted(tuple(r.values()) for b in jaccard._crossed(pa.Table.from_pylist(rows).to_batches(max_chunksize=2)) for r in b.to_pylist())
    assert pairs([row(1, 0, 1), row(2, 0, 2), row(3, 1, 3), row(4, 1, 1)]) == [(1, 3), (2, 3), (2, 4)]
    assert pairs([row(1, 0, 1, 0), row(2, 0, 2, 0), row(3, 0, 3, 0, n=13)]) == [(1, 2)]
    assert pairs([row(1, 0, 1, 0, before=7), row(2, 0, 2, 0, before=7), row(3, 0, 3, 0, before=8)]) == [(1, 3), (2, 3)]
    assert pairs([row(1, 0, 1, 0), row(2, 0, 2, 0, bits=1), row(3, 0, 3, 0, bits=0)]) == [(1, 3)]
    assert pairs([row(1, 0, 1, 0, n=600), row(2, 0, 2, 0, n=500, bits=-1)]) == pairs([row(1, 0, 1, 0, n=600), row(2, 0, 2, 0, n=600)]) == [(1, 2)]
    assert pairs([row(1, 0, 1, 0, n=100), row(2, 0, 2, 0, n=100, bits=1 - (1 << 63))]) == [(1, 2)]  # two bits of each word
