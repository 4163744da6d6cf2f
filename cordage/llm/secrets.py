"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Base kinds are found by pattern in every whole text; their spans always stay. The method adds the
kind ``owned``: long mixed tokens outside base spans that look like keys but match no known form.
Every candidate's value is hashed and counted over the corpus: by distinct owners (``owner_col``)
and distinct repositories (``repo_col``). A value of more than ``max_owners`` owners, or of more than
``max_repos`` repositories, is a copied example; one that stays with few of both looks live. Only live
``owned`` candidates become spans.

Places: a text split at a kind's matches gives the pieces between them, so running sums of the
pieces' and matches' lengths are the matches' places, in code points.

Skew: candidates are counted by (hash, owner, repository) with partial aggregates before any
shuffle by hash, and joined back in a join that Spark can split. Rows that repeat an id and text share
their spans, but each of their owners and repositories counts.

Defined cases: null and empty texts have no spans (digest of the empty string). A null owner or
repository counts as one more owner or repository. Repeated rows get a result each. An empty table
gives no rows. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name

# Kinds in their order and their patterns.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",  # AKIA[A-Z0-9]+ of 20 or more: a run has one such match
    "hex": r"[0-9a-f]{24,}",  # [0-9a-f]+ of 24 or more: matches are whole runs
    "owned": r"[A-Za-z0-9+/_-]{24,}",
}
BASE = ("assign", "access", "hex")
ASSIGN_VALUE, MAX_OWNERS, MAX_REPOS = 6, 2, 8


def _pieces(text: Column) -> Column:
    """For each kind the matches with the length of the text before each of them since the last."""
    none = F.array().cast("array<struct<kind:string,at:int,gap:int,match:string>>")

    def of(kind: str, pattern: str) -> Column:
        matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
        both = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), lambda x: x["match"].isNotNull())
        rows = F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["gap"].alias("gap"), x["match"].alias("match")))
        return F.when(text.rlike(pattern), rows).otherwise(none)

    found = [of(kind, pattern) for kind, pattern in KINDS.items()]
    return F.concat(*found)


def candidates(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_hash, kind, start, stop, value)``: base spans and ``owned`` candidates of each id and
    text; and ``(doc_id, text_hash, owner, repo)``: who holds them."""
    text = F.col("text").cast("string")
    keep = [F.col("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo")]
    found = cut(docs.where(text.isNotNull()).select(*keep, _pieces(text).alias("pieces")).where(F.size("pieces") > 0))
    holders = found.select("doc_id", "text_hash", "owner", "repo").distinct()
    rows = found.select("doc_id", "text_hash", F.explode("pieces").alias("x")).select("doc_id", "text_hash", "x.*").distinct()  # repeated rows meet
    run = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("match")).over(run)
    value = F.when(F.col("kind") == "assign", F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    rows = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("match")).withColumn("value", value)
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    rows = rows.where(F.when(F.col("kind") == "assign", F.length("value") >= ASSIGN_VALUE).when(F.col("kind") == "owned", mixed).otherwise(True))
    # an ``owned`` candidate must not touch a base span: the farthest stop before it, the nearest start after it
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", "stop")
    base = F.col("kind") != "owned"
    before = F.max(F.when(base, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("clear", F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("stop"), F.lit(True)))
    return rows.where(base | F.col("clear")).select("doc_id", "text_hash", "kind", "start", "stop", "value"), holders


def ownership(found: DataFrame, holders: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """``found`` with ``owners``, ``repos`` and ``live`` of each value over the corpus."""
    valued = found.withColumn("value_hash", F.sha2("value", 256)).drop("value")
    of = holders.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "owner", "repo")
    held = valued.select("doc_id", "text_hash", "value_hash").distinct().join(of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    pairs = held.groupBy("value_hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = pairs.groupBy("value_hash", "owner").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("*").alias("owners"))
    repos = pairs.groupBy("value_hash", "repo").agg(F.lit(1).alias("one")).groupBy("value_hash").agg(F.count("*").alias("repos"))
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    return valued.join(owners.join(repos, "value_hash"), "value_hash").withColumn("live", live)


def spans(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """``(doc_id, text_hash, kind, start, stop, owners, repos, live)``: base spans and live ``owned`` ones."""
    found, holders = candidates(docs, owner_col, repo_col)
    return ownership(cut(found), holders, max_owners, max_repos).where(F.col("live") | F.col("kind").isin(*BASE))


def by_document(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per row of ``docs``: counts, digests, spans, and the most owners and repositories of a value."""
    found = spans(docs, owner_col, repo_col, max_owners, max_repos)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.struct(F.col("start"), rank.alias("rank"), F.col("stop"), F.col("kind"), F.col("live"), F.col("owners"), F.col("repos"))
    lists = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(one)).alias("all"))
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    base = F.filter("all", lambda x: x["rank"] <= len(BASE))
    count = lambda kind: F.size(F.filter("all", lambda x: x["kind"] == kind)).cast("long")
    most = lambda name: F.array_max(F.transform("all", lambda x: x[name]))
    digests = lists.select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), *(count(k).alias(f"n_{k}") for k in KINDS),
        told(base).alias("base"), told(F.col("all")).alias("spans"), F.size(F.filter("all", lambda x: x["live"])).cast("long").alias("n_live"),
        most("owners").alias("max_owners"), most("repos").alias("max_repos"),
    )
    digests = cut(digests)
    ids = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    joined = ids.join(digests, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select("doc_id", n("n_assign"), n("n_access"), n("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), n("n_owned"), n("n_live"), n("max_owners"), n("max_repos"))


def redact(docs: DataFrame, owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span's text replaced; rows without spans stay as they are."""
    found = spans(docs, owner_col, "doc_id", max_owners, max_repos)
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(F.coalesce(F.col("reach") > F.col("start"), F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = found.withColumn("reach", reach).withColumn("g", group).groupBy("doc_id", "text_hash", "g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    d, h, c = (free_name(docs, name) for name in ("doc", "hash", "cuts"))
    cuts = merged.groupBy(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(c))
    cuts = cut(cuts)  # of known size, so that Spark can choose not to shuffle the texts
    text = F.col("text").cast("string")
    joined = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(h)), "left")
    # the text between each cut and the next one's start, or the end
    ends = F.concat(F.transform(c, lambda x: x["start"]), F.array(F.length(text).cast("long")))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(c, lambda x: x["stop"]))
    parts = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), lambda x: F.substring(text, (x["b"] + 1).cast("int"), (x["e"] - x["b"]).cast("int")))
    return joined.withColumn("text", F.when(F.col(c).isNull(), F.col("text")).otherwise(F.array_join(parts, mark))).select(*docs.columns)
