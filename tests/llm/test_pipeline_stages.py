"""Every stage of the pipeline against a brute-force version, on nulls, empty and long texts, repeats, ties, clashing names and empty tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cordage.llm import decontaminate, packing, toxicity
from cordage.llm.common import fold
from test_llm_operators import brute_tiles, roots, say
from test_near_duplicates_stage import shingles, similar

#: The columns of documents with names that the stages use inside, and types that can't be compared.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key string, score double, row string, hit boolean, one int, text_hash long, component_id long, extra map<string,int>"


def rows_of(texts):
    return [(i, t, "en", f"s{(i or 0) % 4}", len(t) if t is not None else None, f"k{n}", 0.5, "r", True, 1, 2, 3, {"a": n}) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(31)
    item = say(rng, 40)
    base = [say(rng, n) for n in (8, 30, 60)]
    texts = [(i, t) for i, t in enumerate(base * 2)] + [(10, say(rng, 12)), (10, say(rng, 12)), (11, base[0]), (11, base[0]), (12, None), (12, None), (13, ""), (14, " "), (None, base[1]), (None, base[1]), (None, None)]
    texts += [(20, base[2] + " end"), (21, say(rng, 4000)), (22, "you vile moron " + say(rng, 10)), (23, say(rng, 9) + " vile moron"), (24, f"before {item} after"), (25, f"{item} {say(rng, 5)}"), (25, say(rng, 7)), (None, f"x {item}")]
    texts += [(26, "password = abcdef12 and " + "aB3" * 9), (27, "token: é😀 secret=zzzzzz9"), (28, "copied " + "xY9" * 9), (29, "copied " + "xY9" * 9), (30, "copied " + "xY9" * 9), (31, "0af9" * 8)]
    return texts, item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, corpus):
    d = tmp_path_factory.mktemp("tables")
    rng = random.Random(32)
    spark.createDataFrame([(0, corpus[1]), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1000 + i, int(i % 2)) for i in range(200)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    learn = [(1000 + i, ("vile moron " if i % 2 else "") + say(rng, 10)) for i in range(200)]
    spark.createDataFrame(rows_of([*corpus[0], *learn]), SCHEMA).write.parquet(f"{d}/documents.parquet")
    return str(d)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def run(spark, name, texts, folder):
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    out = stage(name)(spark, docs, folder)
    if name != "packing":
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    return out.collect()


def whole(rows):
    return Counter(tuple(str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, folder, name):
    assert run(spark, name, [], folder) == []


def test_toxicity(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = stage("toxicity")(spark, docs, folder)
    assert kept.columns == docs.columns
    model = toxicity.fit(*toxicity.training_rows(docs, spark.read.parquet(f"{folder}/labels.parquet"), fold("doc_id", 3) != 1))
    one = lambda t: float(model.scores(toxicity._dense([toxicity.text_terms(t)], model.terms))[0])
    want = [r for r in docs.collect() if one(r.text) < toxicity.REJECT]
    assert whole(kept.collect()) == whole(want)
    ids = {r.doc_id for r in want}
    assert not {22, 23} & ids and {0, 12, 13, 21, None} <= ids


def test_near_duplicates(spark, folder, corpus):
    texts = corpus[0]
    rows = [r for r in rows_of(texts) if r[0] is not None]
    own = [shingles(r[1]) for r in rows]
    comp = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if similar(own[a], own[b])])
    least = {c: min(rows[i][0] for i in range(len(rows)) if comp[i] == c) for c in set(comp)}
    kept = run(spark, "near_duplicates", texts, folder)
    got = Counter((r.doc_id, r.text) for r in kept if r.doc_id is not None)
    groups = {}
    for i, r in enumerate(rows):
        if r[0] == least[comp[i]]:
            groups.setdefault(comp[i], set()).add((r[0], r[1]))
    assert not [g for g in groups.values() if sum(k in got for k in g) != 1] and len(got) == len(groups) and max(got.values()) == 1 and all(any(k in g for g in groups.values()) for k in got)
    assert sum(i == 10 for i, _ in got) == 2  # two unlinked texts of one id
    assert Counter(r.text for r in kept if r.doc_id is None) == Counter(t for i, t in texts if i is None)
    assert {r.text_key for r in kept} <= {r[5] for r in rows_of(texts)}


def test_decontamination(spark, folder, corpus):
    texts, item = corpus
    words = decontaminate.words(item)
    leaks = lambda t: t is not None and brute_tiles(decontaminate.words(t)[:200], words, decontaminate.MIN_MATCH) >= 0.8 * len(words)
    assert whole(run(spark, "decontamination", texts, folder)) == whole([r for r in rows_of(texts) if not leaks(r[1])])
    assert sum(leaks(t) for _, t in texts) == 3


def test_secrets(spark, folder, corpus):
    """Spans by Python's expressions, values counted over all rows."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    texts = corpus[0]
    owners = {}

    def spans(t):
        found = [m.span() for m in assign.finditer(t) if len(m[2]) >= 6] + [m.span() for p in ("AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}") for m in re.finditer(p, t)]
        free = [m for m in re.finditer("[A-Za-z0-9+/_-]{24,}", t) if all(re.search(p, m[0]) for p in ("[0-9]", "[a-z]", "[A-Z]")) and not any(a < m.end() and b > m.start() for a, b in found)]
        return found, free

    for i, t in texts:
        for m in spans(t or "")[1]:
            owners.setdefault(m[0], set()).add((i or 0) % 4)

    def clean(t):
        found, free = spans(t)
        for a, b in sorted(found + [m.span() for m in free if len(owners[m[0]]) <= 2], reverse=True):
            t = t[:a] + "[SECRET]" + t[b:]
        return t

    want = [(i, t if t is None else clean(t)) for i, t in texts]
    got = run(spark, "secrets", texts, folder)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert sum("[SECRET]" in (t or "") for _, t in want) == 3 and ("copied " + "xY9" * 9) in {t for _, t in want}


def test_packing(spark, folder, corpus):
    texts = corpus[0]
    rows = run(spark, "packing", texts, folder)
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((i, len(packing.encode(t))) for i, t in texts)
    batches = Counter(r.batch_id for r in rows)
    assert all(batches[r.batch_id] <= r.batch_rows and r.n_tokens <= r.padded_to and (r.batch_rows == 1 or r.batch_rows * r.padded_to <= packing.BUDGET or not r.padded_to) for r in rows)


def test_run_applies_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in out.collect()}
    assert not {22, 23, 24, 25} & (ids - {25}) and {0, 10, 21, None} <= ids and 3 not in ids
    assert out.where("doc_id = 25").count() == 1 and out.select(F.min("n_tokens")).first()[0] == 0
