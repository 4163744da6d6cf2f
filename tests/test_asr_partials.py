"""Every prefix of a user turn's words, against a loop over the turns."""

from collections import Counter

from cordage.plans.queries import QUERIES


def test_every_prefix(spark, tmp_path):
    texts = ["one", "one two three four five", "a  b\nc d e", "", None, " ".join(f"w{i}" for i in range(200))]
    rows = [(c, t, role, text) for c, text in enumerate(texts) for t, role in enumerate(("user", "assistant"))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = Counter((c, t, k, " ".join(text.split(" ")[:k])) for c, t, role, text in rows if role == "user" and text for k in range(1, len(text.split(" ")) + 1))
    assert Counter(map(tuple, QUERIES["asr_partials"](spark, str(tmp_path)).collect())) == want
