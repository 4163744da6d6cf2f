"""Ranked search, spelling variants and quality against plain versions, with their defined cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cordage.llm import lexical, quality, spelling
from cordage.llm.common import fold
from test_llm_operators import docs, say

# --- ranked search ------------------------------------------------------------------------------

SPLIT = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_search(texts, items, k=10):
    """Every score of every row, then the k best."""
    rows = [(i, Counter(re.findall(SPLIT, small(t)))) for i, t in texts]
    rows = [(i, c) for i, c in rows if c]
    n_docs, length = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for i, c in rows:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // length
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in Counter(re.findall(SPLIT, small(text))).items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_equals_brute_force(spark):
    rng = random.Random(31)
    texts = [(i, say(rng, rng.randrange(1, 120))) for i in range(300)]
    texts += [(1000 + i, texts[7][1]) for i in range(40)] + [(500 - i, texts[8][1]) for i in range(30)]  # ties
    texts += [(700, None), (701, ""), (702, "?! \x00"), (703, "É é ÀB 9a_b"), (704, say(rng, 30_000)), (705, "x" * 70_000), (None, texts[7][1]), (None, texts[8][1]), (7, texts[7][1])]
    items = [(i, say(rng, rng.randrange(1, 25))) for i in range(25)]
    items += [(30, texts[7][1]), (30, texts[7][1]), (31, texts[8][1]), (32, "É é 9A nothing nothing"), (33, None), (34, ""), (35, "never-seen"), (None, texts[9][1]), (36, say(rng, 8000))]
    items_df = spark.createDataFrame([(i, t, 5, "x") for i, t in items], "item_id long, text string, rank int, query string")
    want = plain_search(texts, [x for x in items if x[1] is not None])
    assert len({i for i, *_ in want}) == 30
    assert found(lexical.search(docs(spark, texts).repartition(3), items_df)) == want
    assert found(lexical.search(docs(spark, texts), items_df, block_bytes=20_000)) == want
    assert found(lexical.search(docs(spark, texts), items_df.where("item_id = 30"), k=60)) == plain_search(texts, items[25:26], 60)
    assert lexical.search(docs(spark, []), items_df).count() == 0
    assert lexical.search(docs(spark, texts), items_df.where("false")).count() == 0


def made_shard(rng, n, n_terms):
    """Documents of few to many of ``n_terms`` terms, some with copies."""
    own = [rng.choice(n_terms, rng.integers(1, n_terms), replace=False) for _ in range(n)]
    own = [own[i % (n // 3)] for i in range(n)]
    tf = [np.resize(np.arange(1, 4), len(o)) for o in own]
    size = np.array([t.sum() + len(o) % 7 for t, o in zip(tf, own, strict=True)])
    size = size + (np.arange(n) % (n // 3)) % 50 * 20
    norm = lambda x: lexical.length_norm(x, n, int(size.sum()))
    doc = np.repeat(np.arange(n), [len(o) for o in own])
    ids = pa.array(rng.permutation(n))
    return lexical.Shard.of(ids, size, np.concatenate(own).astype(np.int64), np.concatenate(tf), doc, n_terms, norm), ids.to_numpy(), own, tf, norm(size)


@pytest.mark.parametrize("k", [1, 10, 300])
def test_nra_resolves_members_ties_and_scores(k):
    rng = np.random.default_rng(k)
    shard, ids, own, tf, m = made_shard(rng, 3000, 30)
    for _ in range(20):
        terms = rng.choice(30, rng.integers(1, 12), replace=False)
        weights = rng.integers(1, 9000, len(terms))
        scores = np.zeros(3000, np.int64)
        for d, (o, f) in enumerate(zip(own, tf, strict=True)):
            at = {int(t): int(x) for t, x in zip(o, f, strict=True)}
            scores[d] = sum(int(w) * (10**9 * at[int(t)] // (1000 * at[int(t)] + 8 * int(m[d]))) for t, w in zip(terms, weights, strict=True) if int(t) in at)
        order = np.lexsort((ids, -scores))[:k]
        order = order[scores[order] > 0]
        best, got, _ = lexical.nra(shard, terms, weights, k)
        assert ids[best].tolist() == ids[order].tolist() and got.tolist() == scores[order].tolist()
        floor = int(scores[order[len(order) // 2]])
        best, got, _ = lexical.nra(shard, terms, weights, k, floor)
        assert ids[best].tolist() == ids[order[scores[order] >= floor]].tolist()


def test_nra_reads_no_more_than_it_must():
    """Ten short documents hold the rare term: the common term's list is not read to its end."""
    n = 50_000
    size = np.where(np.arange(n) < 10, 5, 100)
    term = np.concatenate([np.zeros(n, np.int64), np.ones(10, np.int64)])
    doc = np.concatenate([np.arange(n), np.arange(10)])
    norm = lambda x: lexical.length_norm(x, n, int(size.sum()))
    shard = lexical.Shard.of(pa.array(np.arange(n)), size, term, np.ones(len(term), np.int64), doc, 2, norm)
    best, _, read = lexical.nra(shard, np.array([0, 1]), np.array([5, 9000]), 10)
    assert sorted(best.tolist()) == list(range(10)) and read < 1000
    assert lexical.nra(shard, np.array([], np.int64), np.array([], np.int64), 10)[0].size == 0


def test_shards_are_bounded(monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 100)
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 500)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([9] * 40), pa.array([[1, 2]] * 40, pa.list_(pa.int32())), pa.array([[1, 1]] * 40, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])
    assert [len(t) for t in lexical._shards(iter([batch] * 7))] == [120, 120, 40]


def test_long_lengths_do_not_overflow():
    got = lexical.length_norm(np.array([10, 10**7]), 10**11, 10**13)
    assert got.tolist() == [25 + 75 * 10 * 10**11 // 10**13, 25 + 75 * 10**7 * 10**11 // 10**13]


# --- spelling variants --------------------------------------------------------------------------


def plain_words(texts):
    out = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = small(run)
            if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if words[b] >= 2 * words[w]}
    rows = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(rows)


def variants(df, **kw):
    return sorted(map(tuple, spelling.variants(df, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def spelt_texts():
    rng = random.Random(41)
    base = ["station", "nation", "nations", "naïveté", "ÀÉÎÕÜ", "aabbcc", "aaaaaa", "letters", "ration", "÷over×"]
    texts = []
    for i in range(250):
        words = []
        for w in rng.choices(base, [9, 20, 3, 4, 4, 3, 5, 8, 5, 2], k=30):
            at = rng.randrange(len(w))
            words.append(rng.choice([w] * 8 + [w.upper(), w[:at] + w[at + 1 :], w[:at] + rng.choice("xéß") + w[at:], w[:at] + rng.choice("aeÿ") + w[at + 1 :]]))
        texts.append((i, " ".join(words)))
    return texts + [(400, None), (401, ""), (402, "tiny a b ccc"), (403, "中文nation中文 NATIONłstation")] + [(404, "repeated wordy words") for _ in range(3)] + [(None, "nullid nullid nullid nation")]


def test_spelling_equals_brute_force(spark):
    long = "long" * 1500
    texts = spelt_texts() + [(500 + i, long) for i in range(8)] + [(600 + i, long[:-1]) for i in range(3)] + [(700 + i, "x" + long[1:]) for i in range(3)]
    words = plain_words(texts)
    want = plain_variants(words)
    assert len(want) > 100 and any(f and r != f for _, f, r, *_ in want) and any(len(w) == 6000 for w in words)
    assert variants(docs(spark, texts).repartition(3)) == want
    assert variants(docs(spark, []),) == [] and variants(docs(spark, [(1, None), (2, "few wordy")])) == []


def test_spelling_in_rounds(spark):
    """Filters too small for the vocabulary: lengths go to several rounds, and large ones are sliced."""
    texts = spelt_texts()
    words = plain_words(texts)
    rounds = spelling.plan_rounds(dict(Counter(map(len, words))), 160)
    assert len(rounds) > 4 and all(r.blocks <= 20 for r in rounds) and any(p[3] > 1 for r in rounds for p in r.of.values())
    assert variants(docs(spark, texts), filter_bytes=160) == plain_variants(words)


def test_filters_hold_every_word_and_few_others():
    rng = random.Random(42)
    words = {"".join(rng.choices("abcdefghij", k=8)).encode() for _ in range(20_000)}
    shards = spelling.plan_rounds({8: len(words)})[0]
    table = np.zeros(shards.blocks, np.uint64)
    for _, letters in spelling._by_length(sorted(words)):
        block, bits, own = shards.places(spelling.hashes(letters), 8)
        np.bitwise_or.at(table, block, bits)
        assert own.all()
    other = [w for w in ("".join(rng.choices("klmnopqr", k=8)).encode() for _ in range(50_000)) if w not in words]
    block, bits, _ = shards.places(spelling.hashes(np.frombuffer(b"".join(other), np.uint8).reshape(-1, 8)), 8)
    assert np.mean(table[block] & bits == bits) < 0.01


def test_hashes_of_edits_follow_from_the_word(monkeypatch):
    words = [b"abcde", b"aabba", b"\xe9tude"]
    letters = np.frombuffer(b"".join(words), np.uint8).reshape(3, 5)
    alphabet = np.array(sorted(set(b"".join(words)) | {120}), np.uint8)
    shards = spelling.plan_rounds({4: 40, 5: 400})[0]
    want = {(w, w[:i] + w[i + 1 :]) for w in words for i in range(5)} | {(w, w[:i] + bytes((c,)) + w[i + 1 :]) for w in words for i in range(5) for c in alphabet if c > w[i]}
    table = np.zeros(shards.blocks, np.uint64)
    for e in {e for _, e in want}:
        block, bits, _ = shards.places(spelling.hashes(np.frombuffer(e, np.uint8)[None]), len(e))
        table[block] |= bits
    for step in (1 << 21, 7):
        monkeypatch.setattr(spelling, "STEP", step)
        got = [(words[r], words[r][:p] + (bytes((c,)) if c >= 0 else b"") + words[r][p + 1 :]) for rows, ps, cs in spelling.edits(letters, alphabet, shards, table) for r, p, c in zip(rows, ps, cs, strict=True)]
        assert sorted(got) == sorted(want)


# --- quality ------------------------------------------------------------------------------------


def test_chunks_cover_and_overlap():
    for n in (0, 1, 511, 512, 513, 896, 897, 5000):
        data = bytes(1 + i % 255 for i in range(n))
        rows, size = quality.chunks_of(data)
        assert rows.shape[1] == quality.CHUNK and len(rows) == len(size) and (size >= 1).all()
        assert b"".join(r[: quality.STRIDE].tobytes() for r in rows[:-1]) + rows[-1].tobytes().rstrip(b"\0") == data
        assert all((a[quality.STRIDE :] == b[: quality.CHUNK - quality.STRIDE]).all() for a, b in zip(rows, rows[1:], strict=False))


def plain_score(model, data):
    """The network written out, a filter and a place at a time."""
    rows, size = quality.chunks_of(data)
    hidden = []
    for chunk in rows:
        pooled = []
        for f in range(model.filters.shape[1]):
            kernel = model.filters[:, f].reshape(quality.REACH, quality.DIM)
            pooled.append(max(0, model.bias[f] + max(sum(float(model.bytes_[chunk[at + k]] @ kernel[k]) for k in range(quality.REACH)) for at in range(quality.CHUNK - quality.REACH + 1))))
        hidden.append(np.maximum(np.array(pooled) @ model.hidden + model.hidden_bias, 0))
    hidden = np.array(hidden)
    mean = (hidden * size[:, None]).sum(0) / size.sum()
    return 1 / (1 + math.exp(-(mean @ model.out[: quality.HIDDEN] + hidden.max(0) @ model.out[quality.HIDDEN :] + model.out_bias[0])))


def test_network_equals_plain_loops(spark):
    model = quality.fresh(5)
    texts = ["short é", "many words " * 60, None]
    got = {r.doc_id: r.score for r in quality.with_scores(docs(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_score(model, (t or "").encode()), abs=1e-5)


def test_gradients_are_those_of_the_loss():
    rng, model = np.random.default_rng(6), quality.fresh(6, np.float64)
    parts = [quality.chunks_of(bytes(rng.integers(97, 110, n).astype(np.uint8))) for n in (30, 700, 1500)]
    args = np.concatenate([c for c, _ in parts]), np.concatenate([s for _, s in parts]), np.cumsum([0, *(len(s) for _, s in parts[:-1])]), np.array([1.0, 0.0, 1.0])
    _, grads = model.loss_and_gradients(*args)
    for param, grad in zip(model.params(), grads, strict=True):
        for at in rng.choice(param.size, min(6, param.size), replace=False):
            if param is model.filters and param.flat[at] == 0:
                continue
            kept, step = param.flat[at], 1e-6
            param.flat[at] = kept + step
            up = model.loss_and_gradients(*args)[0]
            param.flat[at] = kept - step
            down = model.loss_and_gradients(*args)[0]
            param.flat[at] = kept
            assert grad.flat[at] == pytest.approx((up - down) / (2 * step), abs=2e-5)


def test_quality_finds_what_is_bad_in_one_place(spark):
    rng = random.Random(7)
    good = lambda n: " ".join(say(rng, 8).capitalize() + "." for _ in range(n))
    bad = lambda n: good(n) + " " + " ".join(w + rng.choice(["%%%", "$$$", "###"]) for w in say(rng, 40).split()) + " " + good(n)
    rows = [(i, (bad if i % 3 == 0 else good)(rng.randrange(1, 30)) if i % 50 else None) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), "x") for i, _ in rows] + [(None, 1, "x"), (3, None, "x"), (9, 0, "x")], "doc_id long, quality int, score string")
    learn = fold("doc_id", 3) != 1
    got = {r.doc_id: r.score for r in quality.quality(docs(spark, rows + rows[:3]), labels, learn).collect()}
    held = [i for i, t in rows if zlib.crc32(str(i).encode()) % 3 == 1 and t]
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in held]) >= 0.97
    assert all(0 <= s <= 1 for s in got.values())
    huge = good(40_000) + bad(1)
    model = quality.fit(quality.training_rows(docs(spark, rows), labels, learn), steps=20)
    one = quality.with_scores(docs(spark, [(1, huge), (1, huge), (2, "")]), model)
    scores = [r.score for r in one.orderBy("doc_id").collect()]
    h = np.concatenate([model.chunk_values(quality.chunks_of(huge.encode())[0])])
    size = quality.chunks_of(huge.encode())[1]
    want = model.combine((h * size[:, None]).sum(0, keepdims=True) / size.sum(), h.max(0, keepdims=True))[0]
    assert scores[0] == scores[1] == pytest.approx(want, abs=1e-6)
    assert one.columns == [c for c in docs(spark, []).columns if c != "score"] + ["score"]


def test_quality_without_labels(spark):
    rows, none = docs(spark, [(1, "a"), (2, None)]), spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.quality(rows, none, F.lit(True)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.score for r in quality.quality(rows, one, F.lit(True)).collect()] == [1.0, 1.0]
    assert quality.quality(docs(spark, []), one, F.lit(True)).count() == 0
