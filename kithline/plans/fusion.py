"""Whole-graph fusion, resolution of newly extracted entities, and execution of decisions.

A judge is a function of a DataFrame of escalated pairs that returns (pair_id, action,
keep_vid, reason); None leaves every escalated pair to people.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.functions.replies import batch_answers, batch_prompt
from kithline.operators.blocking import blocked_pairs, similar_pairs, with_sides
from kithline.operators.graph import merge_vertices
from kithline.operators.listing import best_candidate, numbered
from kithline.operators.scorer import PRODUCTION, Profile, adaptive, candidate_properties, compare_fields, l1_score, normalised, with_name
from kithline.scratch import materialise

Judge = Callable[[DataFrame], DataFrame]


def prepared(pairs: DataFrame, profile: Profile = PRODUCTION) -> DataFrame:
    """With _a, _b and _fields: values are normalised and fields compared once, as columns of their own."""
    own = lambda s: F.col(f"values_{s}") if f"values_{s}" in pairs.columns else normalised(F.col(f"props_{s}"), profile)
    values = pairs.withColumn("_a", own("a")).withColumn("_b", own("b"))
    return values.withColumn("_fields", compare_fields(F.col("props_a"), F.col("props_b"), profile, (F.col("_a"), F.col("_b"))))


def spread(pairs: DataFrame, *keys: str) -> DataFrame:
    """The pairs in at least as many tasks as there are cores: they may come from a small file or a join in few partitions, but comparing them is the work."""
    spark = pairs.sparkSession
    return pairs.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def score_pairs(pairs: DataFrame, profile: Profile = PRODUCTION) -> DataFrame:
    """With score, decision and detail; pairs: entity_type and name, props of both sides.

    values_a and values_b, if there are any, are the props as normalised gives them: made
    once for each entity, not once for each of its pairs.
    """
    if {"vid_a", "vid_b"} <= set(pairs.columns):
        pairs = spread(pairs, "vid_a", "vid_b")
    base = l1_score(F.col("props_a"), F.col("props_b"), F.col("entity_type"), profile, compared=F.col("_fields"), values=(F.col("_a"), F.col("_b")))
    scored = prepared(pairs, profile).withColumn("_base", base).withColumn("_s", with_name(F.col("_base"), F.col("name_a"), F.col("name_b")))
    return scored.select(*(c for c in pairs.columns if c not in ("values_a", "values_b")), "_s.score", "_s.decision", "_s.detail")


def fuse(entities: DataFrame, judge: Judge | None = None, exact: bool = True, max_key_size: int | None = None) -> DataFrame:
    """The decision on every blocked pair but rejects: (pair_id, entity_type, vid_a, vid_b, name_a, name_b, similarity, status, keep_vid, notes).

    entities: vid, entity_type, name, aliases (array), props (map).
    """
    clean = entities.withColumn("values", normalised(F.col("props")))
    pairs = with_sides(blocked_pairs(entities, exact, max_key_size), clean).withColumn("pair_id", F.concat_ws("|", "vid_a", "vid_b"))
    scored = score_pairs(pairs).filter("decision <> 'reject'")
    merged = F.col("decision") == "merge"
    keys = ("pair_id", "entity_type", "vid_a", "vid_b", "name_a", "name_b")
    if judge is None:
        return scored.select(*keys, F.col("score").alias("similarity"), F.when(merged, "merged").otherwise("pending").alias("status"), F.when(merged, F.col("vid_a")).alias("keep_vid"), F.when(merged, "l1_auto_merge").otherwise("escalated").alias("notes"))
    answers = judge(scored.filter(~merged)).select("pair_id", "action", F.col("keep_vid").alias("_keep"), "reason")
    out = scored.join(answers, "pair_id", "left")
    status = F.when(merged | (F.col("action") == "merge"), "merged").when(F.col("action") == "different", "disambig").when(F.col("action") == "discard", "discarded").otherwise("pending")
    keep = F.when(F.col("_keep").isin(F.col("vid_a"), F.col("vid_b")), F.col("_keep")).otherwise(F.col("vid_a"))
    return out.withColumn("status", status).select(*keys, F.col("score").alias("similarity"), "status", F.when(F.col("status") == "merged", keep).alias("keep_vid"), F.when(merged, "l1_auto_merge").otherwise(F.coalesce("reason", F.lit("no answer"))).alias("notes"))


def execute(queue: DataFrame, judge: Judge) -> DataFrame:
    """Pending pairs by the judge's answer; whatever is not a merge, a missing answer too, is kept apart."""
    own = queue.filter("status = 'pending'")
    answers = judge(own).select("pair_id", "action", F.col("keep_vid").alias("_keep"), "reason")
    merged = F.coalesce(F.col("action") == "merge", F.lit(False))
    keep = F.when(F.col("_keep").isin(F.col("vid_a"), F.col("vid_b")), F.col("_keep")).otherwise(F.col("vid_a"))
    out = own.drop("keep_vid", "notes", "status").join(answers, "pair_id", "left")
    return out.select(*(c for c in out.columns if c not in ("action", "_keep", "reason")), F.when(merged, "merged").otherwise("disambig").alias("status"), F.when(merged, keep).alias("keep_vid"), F.coalesce("reason", F.lit("")).alias("notes"))


def resolve_by_hand(queue: DataFrame, pair_id: str, action: str, who: str, target_vid: str | None = None) -> DataFrame:
    """The new row of the decision log for a pending pair: merge into target_vid, discard or keep.

    There is none for a pair that is not pending, and none for a merge into a vertex that is not of the pair.
    """
    status = {"merge": "merged", "discard": "discarded", "keep": "disambig"}[action]
    own = queue.filter((F.col("pair_id") == pair_id) & (F.col("status") == "pending"))
    if action == "merge":
        if target_vid is None:
            raise ValueError("a merge needs the vertex that stays")
        own = own.filter(F.lit(target_vid).isin(F.col("vid_a"), F.col("vid_b")))
    return own.withColumns({"status": F.lit(status), "keep_vid": F.lit(target_vid if action == "merge" else None).cast("string"), "notes": F.lit(f"manual {action}"), "resolved_by": F.lit(who)})


def apply_merges(vertices: DataFrame, edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after the merged pairs; the vertices that the decisions keep stay (see graph.merge_map)."""
    columns = ["vid_a", "vid_b", *(c for c in ("keep_vid", "ordinal") if c in decisions.columns)]
    return merge_vertices(vertices, edges, decisions.filter("status = 'merged'").select(*columns))


def summary(entities: DataFrame, pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(entity_type, entities, candidates, merge, pending, different): one row for each type, and the counts of fuse.

    pairs: the candidate pairs; decisions: as fuse gives them.  What is neither merged nor pending is different.
    """
    n = entities.groupBy("entity_type").agg(F.count("*").alias("entities"))
    met = pairs.groupBy("entity_type").agg(F.count("*").alias("candidates"))
    own = decisions.groupBy("entity_type").agg(F.count_if(F.col("status") == "merged").alias("merge"), F.count_if(F.col("status") == "pending").alias("pending"))
    out = n.join(met, "entity_type", "left").join(own, "entity_type", "left").fillna(0, ["candidates", "merge", "pending"])
    return out.withColumn("different", F.col("candidates") - F.col("merge") - F.col("pending"))


def judge_in_batches(ask: Callable[[DataFrame], DataFrame], size: int = 10) -> Judge:
    """A judge that asks about `size` pairs of a type at once.

    ask: (entity_type, batch, prompt) -> (entity_type, batch, reply).  A pair without an answer
    in its batch's reply, or whose reply is no JSON, has none.
    """

    def judge(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs.select("pair_id", "entity_type", "vid_a", "name_a", "vid_b", "name_b", (F.col("score") if "score" in pairs.columns else F.col("similarity")).alias("similarity")), "pairs")
        placed = numbered(pairs, "pair_id", "entity_type", name="n").withColumns({"batch": F.floor(F.col("n") / size), "i": F.col("n") % size})
        asked = placed.groupBy("entity_type", "batch").agg(F.array_sort(F.collect_list(F.struct("i", "vid_a", "name_a", "vid_b", "name_b", "similarity"))).alias("own"))
        replies = ask(asked.select("entity_type", "batch", batch_prompt(F.col("own")).alias("prompt")))
        answers = replies.select("entity_type", "batch", F.explode(batch_answers(F.col("reply"))).alias("key", "a"))
        keyed = placed.select("entity_type", "batch", F.concat(F.lit("pair_"), F.col("i").cast("string")).alias("key"), "pair_id")
        return keyed.join(answers, ["entity_type", "batch", "key"]).select("pair_id", F.lower("a.action").alias("action"), "a.keep_vid", "a.reason")

    return judge


def dedup_type(entities: DataFrame, entity_type: str, judge: Judge) -> DataFrame:
    """The merges (pair_id, vid_a, vid_b, keep_vid) of one type's similar pairs that the judge confirms; an invalid choice keeps vid_a."""
    own = entities.filter(F.col("entity_type") == entity_type)
    pairs = similar_pairs(own).withColumn("pair_id", F.concat_ws("|", "vid_a", "vid_b"))
    answers = judge(pairs).filter("action = 'merge'").select("pair_id", F.col("keep_vid").alias("_keep"))
    keep = F.when(F.col("_keep").isin(F.col("vid_a"), F.col("vid_b")), F.col("_keep")).otherwise(F.col("vid_a"))
    return pairs.join(answers, "pair_id").select("pair_id", "vid_a", "vid_b", keep.alias("keep_vid"))


def resolve_new(new: DataFrame, known: DataFrame, verdicts: DataFrame | None = None, profile: Profile = PRODUCTION, typed_model: Column | None = None, common_model: Column | None = None) -> DataFrame:
    """(entity_type, name, vid, route, candidates): what each newly extracted entity is, and whom it was compared with.

    new: entity_type, name, designation, props; known: entity_type, vid, name, aliases, props.
    Equal (entity_type, name) of a batch are one entity.  Candidates have the same name or
    the designation as name, and an id of their type; the best one decides.  verdicts
    (entity_type, name, match_vid, confidence, reason) settle what is escalated; without a
    match and with little confidence the entity is uncertain.
    """
    from kithline.functions.text import vid_type

    one = new.dropDuplicates(["entity_type", "name"])
    own = known.filter(vid_type(F.col("vid")) == F.col("entity_type")).select("entity_type", F.col("vid").alias("candidate"), F.col("name").alias("_name"), F.col("props").alias("_props"))
    keys = one.select("*", F.explode(F.array_compact(F.array(F.struct(F.lit(1).alias("ordinal"), F.col("name").alias("_name")), F.when(F.coalesce("designation", F.lit("")) != "", F.struct(F.lit(0).alias("ordinal"), F.col("designation").alias("_name")))))).alias("k")).select("*", "k.ordinal", "k._name").drop("k")
    met = keys.join(own, ["entity_type", "_name"])
    sides = met.withColumn("props_a", F.col("props")).withColumn("props_b", candidate_properties(F.col("_props"), F.col("entity_type")))
    scored = adaptive(sides, typed_model, common_model, profile).withColumn("score", F.col("s.score")).withColumn("entity", F.concat_ws("|", "entity_type", "name"))
    scored = materialise(scored.select("entity_type", "name", "_name", "candidate", "ordinal", "s", "score", "entity"), "candidates")
    best = best_candidate(scored.withColumn("ordinal", F.struct("ordinal", "candidate"))).select("entity_type", "name", "candidate", "s.decision")
    met = scored.groupBy("entity_type", "name").agg(F.array_sort(F.collect_set(F.struct(F.col("candidate").alias("vid"), F.col("_name").alias("name")))).alias("candidates"))
    out = one.select("entity_type", "name").join(best, ["entity_type", "name"], "left").join(met, ["entity_type", "name"], "left")
    if verdicts is None:
        verdicts = out.select("entity_type", "name", F.lit(None).cast("string").alias("match_vid"), F.lit(0.0).alias("confidence"), F.lit("no_api_key").alias("reason")).filter(F.lit(False))
    out = out.join(verdicts.select("entity_type", "name", "match_vid", "confidence", "reason"), ["entity_type", "name"], "left")
    unsure = F.col("match_vid").isNull() & (F.coalesce("confidence", F.lit(0.0)) < 0.5) & ~F.coalesce("reason", F.lit("no_api_key")).isin("timeout", "no_api_key", "parse_fail")
    route = F.when(F.col("candidate").isNull(), "new").when(F.col("decision") == "merge", "merge").when(F.col("decision") == "reject", "new").when(F.col("match_vid").isNotNull(), "merge").when(unsure, "uncertain").otherwise("new")
    vid = F.when(F.col("decision") == "merge", F.col("candidate")).when(F.col("decision") == "escalate", F.col("match_vid"))
    return out.select("entity_type", "name", vid.alias("vid"), route.alias("route"), F.coalesce("candidates", F.array().cast("array<struct<vid:string,name:string>>")).alias("candidates"))


def resolve_names(wanted: DataFrame, local: DataFrame, known: DataFrame) -> DataFrame:
    """(entity_type, name, vid): by the batch's own names, else by a known name, else by an alias joined with '||'."""
    by_name = known.groupBy("entity_type", "name").agg(F.min("vid").alias("_n"))
    alias = known.select("entity_type", "vid", F.explode(F.split(F.coalesce("aliases", F.lit("")), r"\|\|")).alias("name")).filter("name <> ''").groupBy("entity_type", "name").agg(F.min("vid").alias("_a"))
    mine = local.groupBy("entity_type", "name").agg(F.min("vid").alias("_l"))
    on = ["entity_type", "name"]
    return wanted.join(mine, on, "left").join(by_name, on, "left").join(alias, on, "left").select(*on, F.coalesce("_l", "_n", "_a").alias("vid"))


def verdict_table(verdicts: DataFrame) -> Judge:
    """A judge that looks the answers up: (pair_id, action, keep_vid, reason)."""
    return lambda pairs: pairs.select("pair_id").join(verdicts, "pair_id")
