"""Secrets in texts, with DataFrame functions only, and corpus-wide ownership of their values.

The values of all findings, and of other long tokens that look like keys, are hashed and
counted by distinct owners and repositories.  A value that several owners have, or that one
owner has in many repositories, is a widely copied example.  Any other one belongs to its
owner, looks live and gets a span of its own, kind live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithline.llm.scratch import materialise

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run is either long enough or fails as a whole, so the lengths can stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OTHER = r"[A-Za-z0-9+/_-]{20,}"
#: A token without a name beside it looks like a key if it has both cases and digits, and so many different characters.
DIFFERENT = 12
MAX_OWNERS, MAX_REPOSITORIES = 1, 2
KINDS = ("assign", "access", "hex", "other")
#: The order of kinds among spans with the same start.
ORDER = {"assign": 0, "access": 1, "hex": 2, "live": 3}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _found(text: Column, pattern: str, group: int | None, likely: Column) -> Column:
    """Each match, the length of the text between it and the match before, and its value.

    The pattern is only run where it is likely to match.
    """
    none = F.array().cast("array<string>")
    matches = F.when(likely, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    values = F.when(likely, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none) if group else matches
    gaps = F.when(likely, F.transform(F.split(text, pattern, -1), F.char_length)).otherwise(F.array().cast("array<int>"))
    return F.arrays_zip(gaps.alias("gap"), matches.alias("match"), values.alias("value"))


def findings(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """(rid, doc_id, kind, start, end, value, value_start, owner, repository); also a row with null kind for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    keyword = low.contains(KEYWORDS[0])
    for k in KEYWORDS[1:]:
        keyword = keyword | low.contains(k)
    likely = {"assign": keyword, "access": text.contains("AKIA"), "hex": text.rlike("[0-9a-f]{16}"), "other": text.rlike("[A-Za-z0-9+/_-]{20}")}
    patterns = {"assign": (ASSIGN, 2), "access": (ACCESS, None), "hex": (HEX, None), "other": (OTHER, None)}
    scanned = materialise(docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", owner.cast("string").alias("owner"), repository.cast("string").alias("repository"),
        *(_found(text, *patterns[k], likely[k]).alias(k) for k in KINDS)), "secrets")
    parts = None
    for k in KINDS:
        part = scanned.select("rid", "doc_id", "owner", "repository", F.lit(k).alias("kind"), F.posexplode(k).alias("i", "m"))
        parts = part if parts is None else parts.unionByName(part)
    parts = parts.select("rid", "doc_id", "owner", "repository", "kind", "i", "m.gap", "m.match", "m.value")
    # arrays_zip has one row more than matches: the text after the last one.
    parts = parts.filter("match is not null").withColumn("size", F.char_length("match"))
    so_far = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("rid", "kind").orderBy("i"))
    placed = parts.withColumn("end", so_far).withColumn("start", F.col("end") - F.col("size"))
    different = F.size(F.array_distinct(F.array_remove(F.split("match", ""), "")))
    mixed = F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Z]") & F.col("match").rlike("[a-z]") & (different >= DIFFERENT)
    good = F.when(F.col("kind") == "assign", F.length("value") >= 12).when(F.col("kind") == "other", mixed).otherwise(F.lit(True))
    placed = placed.filter(good).select("rid", "doc_id", "kind", "start", "end", "value", (F.col("end") - F.char_length("value")).alias("value_start"), "owner", "repository")
    every = scanned.select("rid", "doc_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in placed.schema.fields[2:]))
    return placed.unionByName(every)


def scan_secrets(docs: DataFrame, owner: str | None = "source", repository: Column | None = None, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_live, n_copied, owners, repositories, base, spans), one row per row of docs.

    docs needs doc_id and text.  base and spans: kind:start:end by start, then kind,
    comma-joined; code points from 0, end exclusive; spans has kind live too, of values with at
    most max_owners owners and max_repositories repositories.  n_copied counts the values that
    have more; owners and repositories are the largest counts of any value of the row, 0 without
    any.  owner names the column of the owner (None: no owner is known); a null owner or
    repository counts as one of its own, shared by all nulls.  A null or empty text has no spans.  Repeated rows are
    scanned each.  No rows give no rows.
    """
    who = F.coalesce(F.col(owner).cast("string"), F.lit("")) if owner else F.lit("")
    where = F.coalesce(repository, F.lit("")) if repository is not None else who
    found = materialise(findings(docs, who, where), "findings")
    values = found.filter("kind is not null").select(F.sha2("value", 256).alias("hash"), "owner", "repository")
    # Combined before each shuffle, so a value that a third of all documents have is a row for each task and repository.
    owned = values.distinct().groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    placed = found.filter("kind is not null").withColumn("hash", F.sha2("value", 256)).join(owned, "hash")
    is_live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    extra = placed.select("rid", "doc_id", F.when(is_live, "live").otherwise("copied").alias("kind"), F.col("value_start").alias("start"), "end", "owners", "repositories").distinct()
    none = [F.lit(0).cast("long").alias(c) for c in ("owners", "repositories")]
    spans = found.filter("kind is null or kind <> 'other'").select("rid", "doc_id", "kind", "start", "end", *none).unionByName(extra)
    rank = F.create_map(*(x for k, n in ORDER.items() for x in (F.lit(k), F.lit(n))))
    label = F.concat_ws(":", "kind", "start", "end")
    entry = F.when(F.col("kind") != "copied", F.struct("start", rank[F.col("kind")].alias("rank"), "end", label.alias("label")))
    both = spans.groupBy("rid", "doc_id").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in (*ORDER, "copied")), F.max("owners").alias("owners"), F.max("repositories").alias("repositories"),
        F.array_sort(F.collect_list(F.when(~F.col("kind").isin("live", "copied"), entry))).alias("base"), F.array_sort(F.collect_list(entry)).alias("spans"))
    return both.select("doc_id", *(f"n_{k}" for k in (*ORDER, "copied")), "owners", "repositories", F.array_join("base.label", ",").alias("base"), F.array_join("spans.label", ",").alias("spans"))
