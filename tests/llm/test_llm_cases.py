"""The operators' defined cases and methods: what the brute-force comparisons next door leave out."""

import html as entities
import itertools
import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cordage.llm import chat, decontaminate, embeddings, html, language, packing, secrets, simhash, toxicity, urls
from cordage.llm.common import BitTable, bit_table, fold, may_hold
from test_llm_operators import PAGE, brute_tiles, docs, say


# --- op1 ----------------------------------------------------------------------------------------


def plain_fingerprint(text):
    """The bit rule written out: words, shingles, one hash at a time."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprints_by_the_rule(spark):
    rng = random.Random(21)
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "É é b c", "x" * 5000, "same " * 3000, *(say(rng, n) for n in (3, 4, 50, 400))]
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs(spark, list(enumerate(texts)))).collect()}
    assert got == {i: format(plain_fingerprint(t), "016x") for i, t in enumerate(texts)}
    spark_hash = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % (1 << 64)
    assert spark_hash == xxhash.xxh64(b"a b c", seed=42).intdigest()


def test_correlated_bits_make_agreement_likelier():
    rng = np.random.default_rng(22)
    apart = rng.integers(0, 2, (20_000, 8))
    alike = np.where(rng.random((20_000, 8)) < 0.7, rng.integers(0, 2, (20_000, 1)), apart)  # bits that follow one hidden bit
    for bits, more in ((alike, True), (apart, False)):
        x = np.zeros((len(bits), 64))
        x[:, :8] = bits
        both = x.T @ x
        got = simhash._within(both.diagonal() / len(x), both / len(x), list(range(8)), 3)
        pairs = bits[rng.permutation(len(bits))] != bits
        true = [(pairs.sum(1) <= t).mean() for t in range(4)]
        assert np.allclose(got, true, atol=0.05) and (true[0] > 0.01) == (got[0] > 0.01) == more


# --- op2 ----------------------------------------------------------------------------------------


def pair_texts(n, seed):
    """The label is 1 if both words of two pairs are of the same side: no word says anything alone."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        p, q = rng.random() < 0.5, rng.random() < 0.5
        words = [f"word{rng.randrange(400)}" for _ in range(rng.randrange(5, 60))] + ["scorn" if p else "praise", "group" if q else "friend"]
        rng.shuffle(words)
        out.append((" ".join(words), int(p == q)))
    return out


def test_toxicity_learns_pairs():
    rows, held = pair_texts(2000, 1), pair_texts(600, 2)
    model = toxicity.fit([toxicity.text_terms(t) for t, _ in rows], np.array([y for _, y in rows], np.float32))
    x = toxicity._dense([toxicity.text_terms(t) for t, _ in held], model.terms)
    y = np.array([y for _, y in held])
    linear = toxicity._sigmoid(model.bias + x @ model.weights)
    assert np.mean((model.scores(x) >= 0.5) == y) >= 0.95 and np.mean((linear >= 0.5) == y) < 0.7
    k = [i for i in range(20) if x[i].any()][0]
    on = np.flatnonzero(x[k])
    double = model.bias + model.weights[on].sum() + sum(float(model.factors[i] @ model.factors[j]) for i, j in itertools.combinations(on, 2))
    assert abs(double - toxicity._margin(x[k : k + 1], model.bias, model.weights, model.factors)[0]) < 1e-3


def test_toxicity_of_repeated_ids_and_empty_tables(spark):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id long, toxic int")
    texts = [(i, "vile moron here" if i % 2 else "kind words here") for i in range(60)]
    rows = docs(spark, texts + [(7, "vile moron here")] * 300)
    sample, y = toxicity.training_rows(rows, labels, F.lit(True))
    assert len(sample) == 60 and y.sum() == 30
    got = toxicity.toxicity(rows, labels, fold("doc_id", 3) != 1)
    assert got.count() == 360 and {round(r.score, 9) for r in got.where("doc_id = 7").collect()}.__len__() == 1
    assert toxicity.toxicity(docs(spark, []), labels, F.lit(True)).count() == 0


# --- op3 ----------------------------------------------------------------------------------------


def test_tokens_round_trip_and_padding(spark):
    rng = random.Random(23)
    texts = [(i, say(rng, rng.randrange(1, 120))) for i in range(60)] + [(70, "<|endoftext|> é😀"), (71, None), (72, ""), (73, "ab" * 3000), (74, " " * 3000)] + [(75, "same")] * 50
    fast, slow = packing._encoder(packing.VOCABULARY), packing._for_long_pieces(packing.VOCABULARY)
    assert all(fast.decode(packing.encode(t)) == t and packing.encode(t) == slow.encode(t, add_special_tokens=False).ids for _, t in texts if t)
    rows = packing.pack(docs(spark, texts), budget=600, shard_rows=20, keep_tokens=True).collect()
    of = {r.doc_id: r for r in rows}
    for i, t in texts:
        own = [x for x in of[i].tokens if x != packing.PAD]
        assert own == packing.encode(t) and len(of[i].tokens) == of[i].padded_to
    assert len({r.batch_id.rsplit("-", 1)[0] for r in rows if r.doc_id == 75}) > 1  # equal rows are dealt to several shards
    told = {r.bucket: r for r in packing.padding(packing.pack(docs(spark, texts))).collect()}
    assert told[None].rows == len(texts) and told[None].tokens == sum(len(packing.encode(t)) for _, t in texts)
    assert told[None].padded == sum(r.padded for b, r in told.items() if b is not None)


# --- op4 ----------------------------------------------------------------------------------------


def test_tiles_are_those_of_brute_force():
    rng = random.Random(24)
    for _ in range(200):
        a = [rng.choice("abcdz") for _ in range(rng.randrange(0, 40))]
        b = [rng.choice("abcd"[: rng.choice([1, 2, 4])]) for _ in range(rng.randrange(1, 20))]
        got = decontaminate.tiles(a, b, 3)
        assert all(a[x : x + n] == b[y : y + n] for x, y, n in got)
        for side in (0, 1):
            places = [p for t in got for p in range(t[side], t[side] + t[2])]
            assert len(places) == len(set(places))
        assert sum(n for *_, n in got) == brute_tiles(a, b, 3)


def test_tiles_of_very_long_repetitive_texts():
    tracemalloc.start()
    assert decontaminate.tiles(["same"] * 10**6, ["same"] * 200) == [(0, 0, 200)]
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_rare_seeds_miss_no_leak(spark):
    rng = random.Random(25)
    common = "choose the one right answer of these"
    items = [(i, f"{common} {say(rng, rng.randrange(2, 30))} {common}") for i in range(30)] + [(40, "short item"), (41, items_text := say(rng, 12)), (42, items_text)]
    texts = []
    for i, t in items:
        w = t.split()
        keep = w[: max(1, int(len(w) * rng.choice([0.5, 0.79, 0.8, 0.85, 1])))]
        texts += [(1000 + i, " ".join(["before", *keep, "after"])), (2000 + i, " ".join(w[len(w) // 2 :] + ["between"] + w[: len(w) // 2]))]
    texts += [(3000, common), (None, items[3][1]), (3001, items[4][1]), (3001, items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.coverage, 6)) for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    want = set()
    for d, t in texts:
        for i, u in items:
            a, b = decontaminate.words(t), decontaminate.words(u)
            c = brute_tiles(a, b, 5) / len(b)
            if c >= 0.8:
                want.add((d, i, round(c, 6)))
    assert got == want
    assert decontaminate.leaks(docs(spark, []), bench).count() == 0


def test_bit_tables(spark):
    keys = [*range(-500, 500), 1 << 62]
    table = bit_table(spark.createDataFrame([(k,) for k in keys], "k long"), len(keys))
    own = BitTable(len(keys))
    own.add(np.array(keys, np.int64).view(np.uint64))
    assert (own.table == table.table).all()
    df = spark.createDataFrame([(k,) for k in [*keys, None, *range(10**6, 10**6 + 1000)]], "k long")
    hits = [r.k for r in df.where(may_hold(table, F.col("k"))).collect()]
    assert set(keys) <= set(hits) and None not in hits and len(hits) < len(keys) + 20
    small = BitTable(1000)  # ids from 0 on spread too
    small.add(np.arange(0, 4000, 4, dtype=np.uint64))
    assert small.has(np.arange(0, 4000, 4, dtype=np.uint64)).all() and small.has(np.arange(1, 4000, 4, dtype=np.uint64)).sum() < 20


# --- op5 ----------------------------------------------------------------------------------------


def test_secrets_by_owners_and_repositories(spark):
    key, other, wide = "aB3" * 9, "xY9" * 9, "kL5" * 9
    rows = [(1, f"own {key}", "s1"), (2, f"own {key}", "s1")] + [(10 + i, f"spread {other}", "s1") for i in range(9)]
    rows += [(30, f"same {wide}", s) for s in ("s1", "s2", None)] + [(None, f"none {key[::-1]}", "s1"), (40, None, "s2"), (41, "", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r.doc_id, r.spans, r.max_owners, r.max_repos) for r in secrets.by_document(df).collect()}
    assert (1, "owned:4:31", 1, 2) in got and (None, "owned:5:32", 1, 1) in got and (40, "", 0, 0) in got
    assert all(s == "" for i, s, *_ in got if i in (*range(10, 19), 30))  # nine repositories of one owner, three owners of one repeated row
    assert secrets.by_document(df).count() == len(rows) and secrets.by_document(df.limit(0)).count() == secrets.redact(df.limit(0)).count() == 0


# --- op6, op7 -----------------------------------------------------------------------------------


def test_embeddings_of_repeated_rows_and_clashing_columns(spark):
    v, w = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(1, v), (1, v), (1, w), (2, v), (3, w)]
    df = spark.createDataFrame([(i, x, 1, 2, 3.0, b"x") for i, x in rows], "vec_id long, embedding array<float>, rep long, n long, code double, vec binary")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_urls_without_pages_or_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", 1), (2, None, 1), (1, "http://a.net/x", 1)], "page_id long, url string, key int")
    rules = spark.createDataFrame([("block", "net", "/")], "action string, host string, path string")
    assert sorted(map(tuple, urls.judge(pages, rules).collect())) == [(1, "a.net", "/x", "net/", "block")] * 2 + [(2, "", "", None, "allow")]
    assert {r.verdict for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"} and urls.judge(pages.limit(0), rules).count() == 0
    renamed = pages.select("page_id", F.col("url").alias("link"))
    host, path = urls.host_and_path(F.col("link"))
    assert [tuple(r) for r in renamed.where("page_id = 1").select(host, path).distinct().collect()] == [("a.net", "/x")]


# --- op8 ----------------------------------------------------------------------------------------


def test_every_language_is_learned(spark):
    rows = [(100 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}x{j}" for j in range(20)), f"l{k:02d}") for k in range(70) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, F.lit(True), steps=20)
    assert len(model.langs) == 70
    hot = spark.createDataFrame([(1, f"only text {i}", "aa") for i in range(500)] + [(2, "other words", "bb")], "doc_id long, text string, lang string")
    assert language.train(hot, F.lit(True), steps=5).langs == ["aa", "bb"]


def test_texts_without_letters(spark):
    odd = ["½ ² ①", "Ⅷ", "12_3", "́", "", None, " "]
    rows = [(i, t, "en", 1.0, "x") for i, t in enumerate(odd)] + [(90, "the and with", "en", 1.0, "x"), (90, "the and with", "en", 1.0, "x"), (91, "и", "ru", 1.0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    got = language.classify(df, language.train(df, F.lit(True), steps=10)).collect()
    assert len(got) == len(rows) and all((r.lang_pred, r.score) == ("und", 0) for r in got if r.doc_id < 90) and all(r.lang_pred in ("en", "ru") for r in got if r.doc_id >= 90)
    model = language.fresh(["a", "b"])
    model.out[:] = 0
    assert language.classify(df.where("doc_id = 90"), model).first().lang_pred == "a"  # a tie


# --- op9 ----------------------------------------------------------------------------------------


def article(rng, blocks, comments):
    body = "".join(f"<p>{say(rng, 6)} &amp; more.</p>" for _ in range(blocks))
    talk = "".join(f"<li><p>{say(rng, 4)}</p></li>" for _ in range(comments))
    return f'<html><head><title>t</title></head><body><nav><a href="/">menu</a></nav><article><h1>head</h1>{body}</article><section class="comments"><ul>{talk}</ul></section><footer><p>about us</p></footer></body></html>'


def test_late_blocks_and_very_long_pages(spark):
    rng = random.Random(26)
    pages = [article(rng, rng.choice([3, 8, 150]), rng.choice([2, 30])) for _ in range(40)]
    model = html.fit(pages)
    want = lambda page: "\n\n".join([t for t in ["head", *(" ".join(entities.unescape(x).split()) for x in re.findall("<p>(.*?)</p>", page.split("</article>")[0]))]])
    fresh = [article(rng, n, c) for n, c in ((2, 1), (5, 3), (200, 40), (400, 5))]
    assert html.main_texts(fresh, model, html.Features()) == [want(p) for p in fresh]
    long = article(rng, 20_000, 3)
    tracemalloc.start()
    out = html.main_texts([*fresh[:2] * 30, long], model, html.Features())
    assert tracemalloc.get_traced_memory()[1] < 400 << 20 and out[-1].count("\n\n") == 20_000
    tracemalloc.stop()
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, "", 5)], "page_id long, url string, html string, n_chars int")
    got = html.extract(df, model).collect()
    assert len(got) == 3 and got[0] == got[1] and got[2].text == "" and html.extract(df.limit(0), html.train(df.limit(0))).count() == 0


# --- op10 ---------------------------------------------------------------------------------------


def test_chat_of_empty_and_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, pieces int"
    rows = [(1, None, "user", "a", 1), (1, None, "user", "a", 1), (None, None, None, None, 1), (2, 5, "assistant", None, 1)]
    got = {r.conv_id: r for r in chat.read_back(chat.windows(spark.createDataFrame(rows, schema))).collect()}
    assert (got[1].n_turns, got[None].n_turns, got[2].loss_chars) == (2, 1, 0)
    assert chat.windows(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_repeated_rows_of_simhash(spark, n):
    got = simhash.near_duplicates(docs(spark, [(4, "a b c d")] * n + [(2, "a b c d"), (None, None)])).collect()
    assert len(got) == n + 2 and {r.component_id for r in got if r.doc_id} == {2}
