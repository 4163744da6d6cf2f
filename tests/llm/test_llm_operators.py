"""Each operator against a brute-force version, with nulls, empty and long texts, repeats and empty tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cordage.llm import chat, decontaminate, embeddings, html, language, packing, secrets, simhash, toxicity, urls
from cordage.llm.common import connected_components, fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, text_key string, bucket int"


def docs(spark, texts, lang="en"):
    """Rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, f"s{(i or 0) % 3}", None, "x", 0.5, "y", 9) for i, t in texts], DOCS)


def say(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(n))


def roots(n, links):
    at = list(range(n))
    for a, b in links:
        ra, rb = at[a], at[b]
        at = [min(ra, rb) if x in (ra, rb) else x for x in at]
    return at


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(200 + i, 201 + i) for i in range(40)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    want = roots(241, links)
    assert got == {k: want[k] for k in got} and {x for p in links if p[0] != p[1] for x in p} == set(got)


def test_simhash_equals_brute_force(spark):
    rng = random.Random(2)
    base = [say(rng, 300) for _ in range(12)]
    texts = [(i, base[i % 12] if i < 40 else base[i % 12].replace(" ", "  ", 3) + f" extra{i}") for i in range(80)]
    texts += [(90, None), (91, ""), (92, "Two Words"), (93, "two\twords"), (None, "two words"), (94, say(rng, 20_000)), (94, base[0])]
    rows = simhash.near_duplicates(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    assert all(r.fingerprint == "0" * 16 for r in rows if r.doc_id in (90, 91))
    want = {i: format(simhash.fingerprint(t), "016x") for i, t in texts if i != 94}
    assert all(r.fingerprint == want[r.doc_id] for r in rows if r.doc_id != 94)
    known = [r for r in rows if r.doc_id is not None]
    fp = [int(r.fingerprint, 16) for r in known]
    links = [(a, b) for a, b in itertools.combinations(range(len(fp)), 2) if (fp[a] ^ fp[b]).bit_count() <= 3]
    comp = roots(len(fp), links)
    least = {c: min(known[i].doc_id for i in range(len(fp)) if comp[i] == c) for c in set(comp)}
    assert [r.component_id for r in known] == [least[c] for c in comp]
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_finds_all_links_in_blocks(spark):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 400)}
    centre = int(rng.integers(0, 1 << 62))
    fps |= {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (150, 2))}
    fps = sorted(fps)
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    got = [tuple(r) for r in simhash.links(df, block=32).collect()]
    true = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert roots(len(fps), got) == roots(len(fps), true)


@pytest.mark.parametrize("n", [10, 10**5, 10**8, 10**10])
def test_thresholds_keep_the_pigeonhole(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 2, (500, 64)).astype(float)
    parts, ts = simhash.plan(n, x.T @ x * (n / 500), 3)
    assert sorted(itertools.chain(*parts)) == list(range(64)) and sum(ts) == 3 - len(parts) + 1


def test_toxicity(spark):
    rng = random.Random(4)
    texts = [(i, say(rng, 60) + (" you idiot moron " if i % 4 == 0 else " ") + say(rng, 20)) for i in range(400)]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i, _ in texts] + [(999, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    more = [(1000, None), (1001, ""), (None, "idiot moron"), (1002, say(rng, 20_000))]
    rows = toxicity.toxicity(docs(spark, texts + more), labels, fold("doc_id", 3) != 1).collect()
    assert len(rows) == len(texts) + 4 and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 400]
    assert np.mean([(r.score >= toxicity.REJECT) == (r.doc_id % 4 == 0) for r in held]) > 0.97
    none = toxicity.toxicity(docs(spark, more), labels.limit(0), fold("doc_id", 3) != 1).collect()
    assert all(r.score < 0.5 for r in none)


def test_language(spark):
    rng = random.Random(5)
    word = {"de": "und der die schön über nicht straße".split(), "en": "the and with that this from which".split(), "es": "el los para niño según está".split()}
    rows = [(i, " ".join(rng.choice(word[lang]) for _ in range(40)), lang, "s") for i in range(300) for lang in [rng.choice("de en es".split())]]
    df = spark.createDataFrame([*rows, (900, None, "de", "s"), (901, "12 34 !", None, "s"), (902, "", "en", "s"), (903, "und der " * 9000, None, "s")], "doc_id long, text string, lang string, source string")
    model = language.train(df, fold("doc_id", 5) != 0, steps=250)
    got = {r.doc_id: r for r in language.classify(df, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902)) and got[903].lang_pred == "de"
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in rows if __import__("zlib").crc32(str(i).encode()) % 5 == 0]) > 0.95
    assert language.train(df.limit(0), fold("doc_id", 5) != 0) is None


def brute_tiles(a, b, least):
    """Greedy string tiling as defined: mark the longest common run of unmarked words, again and again."""
    ma, mb, total = [False] * len(a), [False] * len(b), 0
    least = max(1, min(least, len(b)))
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < least:
            return total
        for k in range(best[0]):
            ma[k - best[1]] = mb[k - best[2]] = True
        total += best[0]


def test_tiles_equal_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        a = [rng.choice("abcd") for _ in range(rng.randrange(1, 40))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(1, 20))]
        got = decontaminate.tiles(a, b, 3)
        assert all(a[x : x + n] == b[y : y + n] for x, y, n in got)
        places = [p for _, y, n in got for p in range(y, y + n)]
        assert len(places) == len(set(places)) and abs(sum(n for *_, n in got) - brute_tiles(a, b, 3)) <= 3


def test_decontamination(spark):
    rng = random.Random(7)
    item = say(rng, 40)
    w = item.split()
    moved = " ".join([*w[20:], "so", *w[:20]])
    texts = [(1, say(rng, 30) + " " + item.upper() + " " + say(rng, 30)), (2, moved), (3, " ".join(w[:20])), (4, say(rng, 300)), (5, None), (6, ""), (7, moved), (None, item), (8, say(rng, 15_000) + " " + item), (9, "Tiny Item here")]
    bench = spark.createDataFrame([(0, item), (1, None), (2, ""), (3, "tiny item"), (4, "gone astray")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    assert got == {(1, 0), (2, 0), (7, 0), (None, 0), (8, 0), (9, 3)}
    assert decontaminate.leaks(docs(spark, texts), bench.limit(0)).count() == 0


def test_boundaries_equal_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(20):
        top = np.sort(rng.choice(100, 8, replace=False)) + 1
        rows = rng.integers(1, 9, 8)
        cost = lambda ends: sum(rows[s : e + 1] @ (top[e] - top[s : e + 1]) for s, e in zip([0, *(x + 1 for x in ends[:-1])], ends, strict=True))  # noqa: B023, E731
        best = min(cost([*c, 7]) for k in range(3) for c in itertools.combinations(range(7), k))
        ends = packing.best_boundaries(top, rows, 3)
        assert len(ends) <= 3 and ends[-1] == 7 and cost(ends) == best


@pytest.mark.parametrize("buckets", [1, 2, 5, 40])
def test_boundaries_pad_least_over_exact_counts(buckets):
    rng = np.random.default_rng(buckets)
    top = np.sort(rng.choice(100_000, 300, replace=False))
    rows = rng.integers(1, 10**6, 300) ** 2
    cost = lambda s, e: int(sum(int(x) * int(top[e] - t) for x, t in zip(rows[s : e + 1], top[s : e + 1], strict=True)))
    pad = [[cost(s, e) if s <= e else None for e in range(300)] for s in range(300)]
    best = pad[0][:]
    for _ in range(1, buckets):
        best = [min([pad[0][e], *(best[s - 1] + pad[s][e] for s in range(1, e + 1))]) for e in range(300)]
    ends = packing.best_boundaries(top, rows, buckets)
    assert len(ends) <= buckets and sum(pad[s][e] for s, e in zip([0, *(x + 1 for x in ends[:-1])], ends, strict=True)) == best[-1]


def test_packing(spark):
    rng = random.Random(9)
    texts = [(i, say(rng, rng.randrange(1, 300))) for i in range(300)] + [(400, None), (401, ""), (402, say(rng, 20_000)), (5, "again"), (None, "x y")]
    rows = packing.pack(docs(spark, texts), budget=1000, shard_rows=40).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        assert r.n_tokens <= r.padded_to
        by.setdefault(r.batch_id, []).append(r)
    for batch in by.values():
        assert sorted(r.place for r in batch) == list(range(len(batch)))
        assert len(batch) == 1 or sum(r.padded_to for r in batch) <= 1000
    assert packing.pack(docs(spark, [])).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    s = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(s)


def test_secrets(spark):
    key = "aB3" * 10
    texts = [
        (1, "é😀 Password = 'abcdef12' and token=short api-key: x API_KEY:\"zzzzzzz\" AKIA" + "Q7" * 8 + " " + "0af9" * 8), (2, None), (3, ""), (4, "token=token=abcdef123 secret : pass"), (5, f"own {key} here"),
        (6, "copied " + "xY9" * 9), (7, "copied " + "xY9" * 9), (8, "copied " + "xY9" * 9), (9, "password = token: abcdefgh"), (1, "other text"), (10, "deadbeef" * 4 + " word " * 9000), (10, "deadbeef" * 4 + " word " * 9000),
    ]
    rows = secrets.by_document(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    digest = lambda t: hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(t or "")).encode()).hexdigest()
    assert sorted((r.doc_id, r.base_sha256) for r in rows) == sorted((i, digest(t)) for i, t in texts)
    at = {r.doc_id: r.spans for r in rows if r.doc_id > 1}
    assert at[5] == "owned:4:34" and at[6] == at[7] == ""
    clean = {r.doc_id: r.text for r in secrets.redact(docs(spark, texts)).where("doc_id > 1").collect()}
    assert clean[5] == "own [SECRET] here" and clean[6] == texts[5][1] and clean[2] is None and clean[4].startswith("[SECRET]")


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(150, 24)).astype(np.float32)
    near = x[0] + rng.normal(0, 0.05, (80, 24)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, near, x[:5], x[:5] * 2]))]
    bad = [(900, None, 0), (901, [], 0), (902, [0.0] * 24, 0), (903, [float("nan")] * 24, 0), (904, [None] * 24, 0), (905, [1.0, 2.0], 0), (None, x[1].tolist(), 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, block=16).collect()}
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.9) & ~np.eye(len(v), dtype=bool)
    comp = roots(len(v), [tuple(map(int, p)) for p in np.argwhere(near)])
    assert [got[i].n_links for i in range(len(v))] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(len(v))] == comp
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905)) and not got[None].kept
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embedding_parameters_reach_the_recall():
    k, tables = embeddings.parameters(10**6, 0.9)
    near = embeddings.meeting_chance(np.sqrt(0.2))
    assert 1 - (1 - near**k) ** tables >= 0.9


def test_urls_equal_brute_force(spark):
    rng = random.Random(11)
    hosts = ["net", "example.net", "a.example.net", "org", "b.org", "com", "x.com"]
    rules = [(rng.choice(["block", "allow"]), h, p) for h in hosts for p in ["/", "/en/", "/en/deep/", "/fr"] if rng.random() < 0.6] + [("block", "net", "/"), ("allow", "net", "/")]
    made = [f"http{rng.choice(['', 's'])}://{rng.choice(['', 'A.', 'q.a.', 'm.'])}{rng.choice([*hosts, 'badnet', 'Example.NET'])}{rng.choice(['', '/', '/en/', '/en/deep/1', '/en', '/fr/2?x=/en/', '#/en/', '?y'])}" for _ in range(300)]
    rows = list(enumerate(made + [None, "", "no scheme", "://", "http://net/"])) + [(0, made[0])]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in rows], "page_id long, url string, host string, path string")
    table = {}
    for action, h, p in rules:
        table[h, p] = "block" if "block" in (action, table.get((h, p))) else "allow"

    def judge(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        h, p = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(a + b), len(a), table[a, b] == "block", a + b) for a, b in table if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fit, default=None)
        return h, p, best and best[3], ("block" if best[2] else "allow") if best else "allow"

    got = urls.judge(df, spark.createDataFrame(rules, "action string, host string, path string"), partitions=5).collect()
    assert sorted((r.page_id, *map(str, r[1:])) for r in got) == sorted((i, *map(str, judge(u))) for i, u in rows)


PAGE = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href="/">Menu</a></nav><div class="ad">Buy</div><article><h1>Head</h1><p><b>One &amp; two<br> three.<br><p>Four\n five &eacute;.</p></article><footer>&copy; x</footer></body></html>'


def test_html_blocks():
    found = html.blocks(PAGE)
    assert [b.text for b in found] == ["T", "Menu", "Buy", "Head", "One & two three.", "Four five é.", "© x"]
    assert html.weak_labels(found).tolist() == [0, 0, 0, 1, 1, 1, 0]
    assert html.blocks(None) == html.blocks("") == html.blocks("<script>never closed") == []


def test_html(spark):
    rng = random.Random(12)
    make = lambda: PAGE.replace("Head", say(rng, 5)).replace("One", say(rng, 30)).replace("Buy", say(rng, 6))
    rows = [(i, "u", make(), "x") for i in range(80)] + [(90, None, None, "x"), (91, "u", "", "x"), (92, "u", PAGE + "<p>tail</p>" * 2000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(df, html.train(df)).collect()}
    assert len(got) == 83 and got[90].text == got[91].text == "" and all(r.n_chars == len(r.text) for r in got.values())
    right = ["\n\n".join(b.text for b, y in zip(f, html.weak_labels(f), strict=True) if y) == got[i].text for i, _, p, _ in rows[:80] for f in [html.blocks(p)]]
    assert np.mean(right) > 0.95


def test_chat_round_trip(spark):
    rng = random.Random(13)
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [(c, t, "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2], rng.choice([odd, "a\\b<\\p|", "\\", "<|", "é😀 " * rng.randrange(400), None, ""])) for c in range(30) for t in range(rng.randrange(1, 14))]
    rows += [(None, 0, None, "x\n"), (50, 0, "assistant\n", "y"), (51, 0, "user", "z"), (51, 0, "user", "z"), (52, 0, "assistant", "w " * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    made = chat.windows(df, budget=200, history=50)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        aim = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in own))
        assert got[c].loss_chars == len(aim) and got[c].loss_sha256 == sha(aim)
    for r in made.collect():
        texts = re.findall(r"(?s)<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", r.formatted)
        cost = sum(-(-len(x.encode()) // 4) + 4 for _, x in texts)
        assert cost <= 230 or r.n_new == 1 or len(texts) <= 2
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0
