"""Queries of plans, changes of tables, parsers, readers and streams; see catalogue for the stand-ins of entities."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithline.catalogue import _query, _t
from kithline.functions import replies, text
from kithline.operators import crosslingual, evaluation, graph, learning, listing, lookups, mutations, scorer
from kithline.plans import extraction, fusion
from kithline.scratch import materialise, shared_dir
from kithline.sources import feeds, files
from kithline.streaming import lifecycle, streams


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix + "_"), F.col(column).cast("string"))


def _now():
    return F.lit("2024-01-31 00:00:00")

# --- merges ---------------------------------------------------------------------------


def _merges(s: SparkSession, d: str) -> DataFrame:
    """Customers of a nation, merged along a chain in the order of their keys; every third decision keeps the later one."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    pairs = _t(s, d, "customer").select("c_custkey", F.lag("c_custkey").over(w).alias("p")).filter("p is not null")
    return pairs.select(_key("person", "p").alias("vid_a"), _key("person", "c_custkey").alias("vid_b"), F.when(F.col("c_custkey") % 3 == 0, _key("person", "c_custkey")).otherwise(_key("person", "p")).alias("keep_vid"), F.col("c_custkey").alias("ordinal"), F.lit("merged").alias("status"))


_MERGES_SQL = """mg AS (SELECT c_custkey AS b, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS a, c_nationkey AS g FROM customer),
dc AS (SELECT g, b AS ordinal, CASE WHEN b % 3 = 0 THEN b ELSE a END AS wins, CASE WHEN b % 3 = 0 THEN a ELSE b END AS loses FROM mg WHERE a IS NOT NULL),
vt AS (SELECT g, wins, max(ordinal) AS ordinal FROM dc GROUP BY 1, 2),
kp AS (SELECT g, wins AS keep FROM vt QUALIFY row_number() OVER (PARTITION BY g ORDER BY wins IN (SELECT loses FROM dc), ordinal DESC, wins) = 1),
mp AS (SELECT c_custkey AS k, keep FROM customer JOIN kp ON c_nationkey = g)"""


@_query(f"WITH {_MERGES_SQL} SELECT 'person_' || k AS vid, 'person_' || keep AS keep FROM mp")
def merge_map_chain(s, d):
    return graph.merge_map(_merges(s, d))


def _people(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, o = _t(s, d, "customer"), _t(s, d, "orders")
    v = c.select(_key("person", "c_custkey").alias("vid"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("aliases"))
    rows = [c.select(_key("person", "c_custkey").alias("src"), _key("loc", "c_nationkey").alias("dst"), F.lit("locate").alias("type")),
            c.filter("c_custkey % 10 = 0").select(_key("person", "c_custkey").alias("src"), _key("person", "c_custkey").alias("dst"), F.lit("social").alias("type")),
            o.select(_key("record", "o_orderkey").alias("src"), _key("person", "o_custkey").alias("dst"), F.lit("trace").alias("type"))]
    e = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return v, e.select("*", F.lit("generate").alias("sub_type"), F.lit(0.9).alias("confidence"), F.lit("article").alias("source"), F.lit("t").alias("created_at"))


_ALONE = "unmerged AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT g FROM kp)), mm AS (SELECT k, keep FROM mp UNION ALL SELECT k, k FROM unmerged)"


@_query(f"""WITH {_MERGES_SQL}, {_ALONE}, al AS (SELECT keep, c_mktsegment AS a FROM mm JOIN customer ON c_custkey = k UNION SELECT keep, c_name FROM mm JOIN customer ON c_custkey = k WHERE k <> keep)
SELECT 'person_' || keep AS vid, array_to_string(list_sort(list_distinct(list(a))), ',') AS aliases FROM al GROUP BY 1""")
def merge_vertices_full(s, d):
    v, _ = fusion.apply_merges(*_people(s, d), _merges(s, d))
    return v.select("vid", F.array_join("aliases", ",").alias("aliases"))


@_query(f"""WITH {_MERGES_SQL}, {_ALONE}, e AS (
  SELECT 'person_' || keep AS src, 'loc_' || c_nationkey AS dst, 'locate' AS type, 'generate' AS sub_type, 0.9 AS confidence FROM customer JOIN mm ON c_custkey = k
  UNION SELECT 'person_' || k, 'person_' || k, 'social', 'generate', 0.9 FROM mm WHERE k % 10 = 0 AND k = keep
  UNION SELECT 'record_' || o_orderkey, 'person_' || keep, 'trace', CASE WHEN k <> keep THEN 'merge' ELSE 'generate' END, CASE WHEN k <> keep THEN 1.0 ELSE 0.9 END FROM orders JOIN mm ON o_custkey = k)
SELECT src, dst, type, sub_type, CAST(confidence AS DOUBLE) AS confidence FROM e""")
def merge_edges_full(s, d):
    _, e = fusion.apply_merges(*_people(s, d), _merges(s, d))
    return e.select("src", "dst", "type", "sub_type", "confidence")


# --- fusion of the whole graph --------------------------------------------------------


def _things(s: SparkSession, d: str) -> DataFrame:
    """Names of parts, nations and regions as locations and organizations."""
    n = _t(s, d, "part").select(F.col("p_name").alias("name")).unionByName(_t(s, d, "nation").select(F.col("n_name").alias("name"))).unionByName(_t(s, d, "region").select(F.col("r_name").alias("name"))).distinct()
    kind = F.when(F.length("name") % 2 == 0, "location").otherwise("organization")
    props = F.create_map(F.lit("region"), F.substring("name", 1, 1), F.lit("state"), F.concat(F.lit("s"), (F.length("name") % 3).cast("string")))
    return n.select(kind.alias("entity_type"), F.concat(F.lit("loc_"), "name").alias("vid"), "name", F.array(F.reverse("name")).alias("aliases"), props.alias("props"))


def _answers(pairs: DataFrame) -> DataFrame:
    k = (F.length("name_a") + F.length("name_b")) % 4
    action = F.when(k == 0, "merge").when(k == 1, "different").when(k == 3, "discard")
    return pairs.select("pair_id", action.alias("action"), F.when(F.length("name_a") > F.length("name_b"), F.col("vid_b")).otherwise("neither").alias("keep_vid"), F.lit("told").alias("reason")).filter("action is not null")


_THINGS_SQL = """n AS (SELECT 'loc_' || name AS vid, name AS raw, CASE WHEN length(name) % 2 = 0 THEN 'location' ELSE 'organization' END AS entity_type, lower(name) AS name, lower(substring(name, 1, 1)) AS region, length(name) % 3 AS st,
    list_filter(string_split(lower(name), ' '), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'uss', 'usns', 'hmas', 'hmcs', 'in', 'of', 'on', 'at', 'to')) AS words, list_distinct(string_split(lower(name), ' ')) AS toks, [lower(name), lower(reverse(name))] AS keys
  FROM (SELECT p_name AS name FROM part UNION SELECT n_name FROM nation UNION SELECT r_name FROM region)),
pr AS (SELECT a.entity_type, a.vid AS vid_a, b.vid AS vid_b, a.raw AS name_a, b.raw AS name_b,
    greatest(-1.0, least(1.0, CASE WHEN a.region = b.region THEN 0.5 ELSE -0.75 END + CASE WHEN a.st = b.st THEN 0.5 ELSE -0.75 END)) AS base,
    CASE WHEN a.name = b.name THEN 0.3 WHEN contains(a.name, b.name) OR contains(b.name, a.name) THEN 0.2 WHEN len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) >= 0.5 THEN 0.15 ELSE 0.0 END AS bonus
  FROM n a JOIN n b ON a.entity_type = b.entity_type AND a.vid < b.vid WHERE contains(a.name, b.name) OR contains(b.name, a.name) OR list_has_any(a.keys, b.keys) OR list_has_any(a.words, b.words)),
sc AS (SELECT *, CAST(CASE WHEN base <= -0.9 THEN base ELSE greatest(-1.0, least(1.0, base + bonus)) END AS DOUBLE) AS score FROM pr),
dd AS (SELECT *, CASE WHEN base <= -0.9 OR score <= -0.4 THEN 'reject' WHEN score >= 0.6 THEN 'merge' ELSE 'escalate' END AS decision, (length(name_a) + length(name_b)) % 4 AS k, CASE WHEN length(name_a) > length(name_b) THEN vid_b ELSE vid_a END AS told FROM sc)"""
_STATUS = "CASE WHEN decision = 'merge' OR k = 0 THEN 'merged' WHEN k = 1 THEN 'disambig' WHEN k = 3 THEN 'discarded' ELSE 'pending' END"


@_query(f"""WITH {_THINGS_SQL} SELECT entity_type, vid_a, vid_b, round(score, 6) AS similarity, {_STATUS} AS status, CASE WHEN decision = 'merge' THEN vid_a WHEN k = 0 THEN told END AS keep_vid,
  CASE WHEN decision = 'merge' THEN 'l1_auto_merge' WHEN k = 2 THEN 'no answer' ELSE 'told' END AS notes FROM dd WHERE decision <> 'reject'""")
def fuse_with_judge(s, d):
    out = fusion.fuse(_things(s, d), _answers)
    return out.select("entity_type", "vid_a", "vid_b", F.round("similarity", 6).alias("similarity"), "status", "keep_vid", "notes")


@_query(f"""WITH {_THINGS_SQL}, e AS (SELECT entity_type, count(*) AS entities FROM n GROUP BY 1), c AS (SELECT entity_type, count(*) AS candidates, count(*) FILTER (decision <> 'reject' AND {_STATUS} = 'merged') AS merge, count(*) FILTER (decision <> 'reject' AND {_STATUS} = 'pending') AS pending FROM dd GROUP BY 1)
SELECT entity_type, entities, coalesce(candidates, 0) AS candidates, coalesce(merge, 0) AS merge, coalesce(pending, 0) AS pending, coalesce(candidates - merge - pending, 0) AS "different" FROM e LEFT JOIN c USING (entity_type)""")
def fusion_summary_by_type(s, d):
    from kithline.operators.blocking import blocked_pairs

    e = _things(s, d)
    return fusion.summary(e, blocked_pairs(e), fusion.fuse(e, _answers))


@_query(f"""WITH {_THINGS_SQL} SELECT vid_a, vid_b, CASE WHEN k = 0 THEN 'merged' ELSE 'disambig' END AS status, CASE WHEN k = 0 THEN told END AS keep_vid, CASE WHEN k = 2 THEN '' ELSE 'told' END AS notes FROM dd WHERE decision = 'escalate'""")
def execute_queue(s, d):
    return fusion.execute(fusion.fuse(_things(s, d)), _answers).select("vid_a", "vid_b", "status", "keep_vid", "notes")


@_query(f"""WITH {_THINGS_SQL}, t AS (SELECT entity_type, vid_a, vid_b, name_a, name_b FROM (SELECT a.entity_type, a.vid AS vid_a, b.vid AS vid_b, a.raw AS name_a, b.raw AS name_b,
    CASE WHEN list_contains(b.keys[2:2], a.name) OR list_contains(a.keys[2:2], b.name) THEN 0.95 ELSE len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) END AS score
    FROM n a JOIN n b ON a.entity_type = b.entity_type AND a.vid < b.vid AND (list_has_any(a.keys, b.keys) OR list_has_any(a.words, b.words))) WHERE score > 0.3)
SELECT vid_a, vid_b, CASE WHEN length(name_a) > length(name_b) THEN vid_b ELSE vid_a END AS keep_vid FROM t WHERE entity_type = 'location' AND (length(name_a) + length(name_b)) % 4 = 0""")
def dedup_one_type(s, d):
    return fusion.dedup_type(_things(s, d), "location", _answers).select("vid_a", "vid_b", "keep_vid")


@_query(f"WITH {_THINGS_SQL} SELECT vid_a, vid_b, 'merge' AS action, vid_a AS keep_vid FROM dd WHERE decision = 'escalate'")
def judge_in_batches(s, d):
    """A judge that answers merge to every pair of a batch, keeping its first vertex."""
    pairs = fusion.fuse(_things(s, d)).filter("status = 'pending'")
    first = F.regexp_extract_all("prompt", F.lit(r"(?m)^pair_\d+: \[([^\]]*)\]"), F.lit(1))
    entries = F.transform(first, lambda v, i: F.concat(F.lit('"pair_'), i.cast("string"), F.lit('": {"action": "MERGE", "reason": "x", "keep_vid": "'), v, F.lit('"}')))
    ask = lambda asked: asked.withColumn("reply", F.concat(F.lit("```json\n{"), F.array_join(entries, ", "), F.lit("}\n```")))
    answers = fusion.judge_in_batches(ask)(pairs)
    return pairs.select("pair_id", "vid_a", "vid_b").join(answers, "pair_id").select("vid_a", "vid_b", "action", "keep_vid")


@_query("SELECT CAST(min(event_id) AS VARCHAR) AS pair_id, 'merged' AS status, 'y' AS keep_vid, 'manual merge' AS notes FROM events WHERE event_type = 'error'")
def resolve_by_hand(s, d):
    q = _t(s, d, "events").select(F.col("event_id").cast("string").alias("pair_id"), "event_id", F.when(F.col("event_type") == "error", "pending").otherwise("merged").alias("status"), F.lit("x").alias("vid_a"), F.lit("y").alias("vid_b"))
    first = q.filter("status = 'pending'").agg(F.min("event_id")).first()[0]
    return fusion.resolve_by_hand(q, str(first), "merge", "someone", "y").select("pair_id", "status", "keep_vid", "notes")


# --- resolution of new entities, rules and learned scores -----------------------------


def _known(s: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("p_partkey") % 3 == 0, "active").otherwise("retired")
    props = F.create_map(F.lit("category"), F.lower("p_brand"), F.lit("state"), state, F.lit("unused"), F.lit("x"))
    return _t(s, d, "part").filter("p_size < 25").select(F.lit("equipment").alias("entity_type"), _key("equip", "p_partkey").alias("vid"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("||"), F.reverse("p_name"))).otherwise("").alias("aliases"), props.alias("props"), "p_partkey")


@_query("""WITH k AS (SELECT 'equip_' || p_partkey AS vid, p_name AS name, lower(p_brand) AS category, CASE WHEN p_partkey % 3 = 0 THEN 'active' ELSE 'retired' END AS state FROM part WHERE p_size < 25),
w AS (SELECT DISTINCT p_name AS name, 'brand#1' || (length(p_name) % 5) AS category FROM part),
m AS (SELECT w.name, vid, (CASE WHEN w.category = k.category OR contains(w.category, k.category) OR contains(k.category, w.category) THEN 0.5 ELSE -0.75 END) + CASE WHEN state = 'active' THEN 0.5 ELSE -0.75 END AS score FROM w JOIN k USING (name)),
b AS (SELECT name, vid, greatest(-1.0, least(1.0, score)) AS score FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY greatest(-1.0, least(1.0, score)) DESC, vid) = 1),
r AS (SELECT w.name, b.vid, CASE WHEN score >= 0.6 THEN 'merge' WHEN score <= -0.4 THEN 'reject' WHEN score IS NULL THEN NULL ELSE 'escalate' END AS decision, length(w.name) % 3 AS v FROM w LEFT JOIN b USING (name))
SELECT name, CASE WHEN decision IS NULL OR decision = 'reject' THEN 'new' WHEN decision = 'merge' OR v = 0 THEN 'merge' WHEN v = 1 THEN 'uncertain' ELSE 'new' END AS route, CASE WHEN decision = 'merge' THEN vid WHEN decision = 'escalate' AND v = 0 THEN 'told' END AS vid FROM r""")
def resolve_new_routes(s, d):
    names = _t(s, d, "part").select(F.col("p_name").alias("name")).distinct()
    props = F.create_map(F.lit("category"), F.concat(F.lit("brand#1"), (F.length("name") % 5).cast("string")), F.lit("state"), F.lit("active"))
    new = names.select(F.lit("equipment").alias("entity_type"), "name", F.lit(None).cast("string").alias("designation"), props.alias("props"))
    k = F.length("name") % 3
    verdicts = new.filter(k < 2).select("entity_type", "name", F.when(k == 0, "told").alias("match_vid"), F.lit(0.2).alias("confidence"), F.lit("unclear").alias("reason"))
    return fusion.resolve_new(new, _known(s, d), verdicts).select("name", "route", "vid")


@_query("""WITH k AS (SELECT 'equip_' || p_partkey AS vid, p_name AS name, lower(p_brand) AS category, CASE WHEN p_partkey % 3 = 0 THEN 'active' ELSE 'retired' END AS state FROM part WHERE p_size < 25),
w AS (SELECT CASE WHEN length(a.p_name) % 3 = 0 THEN reverse(a.p_name) ELSE a.p_name END AS name, min(b.p_name) AS designation FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1 GROUP BY 1),
c AS (SELECT *, 'brand#1' || (length(name) % 5) AS category FROM w),
t AS (SELECT name, category, 1 AS ordinal, name AS key FROM c UNION ALL SELECT name, category, 0, designation FROM c WHERE designation IS NOT NULL),
m AS (SELECT t.name, ordinal, vid, (CASE WHEN t.category = k.category OR contains(t.category, k.category) OR contains(k.category, t.category) THEN 0.5 ELSE -0.75 END) + CASE WHEN state = 'active' THEN 0.5 ELSE -0.75 END AS raw FROM t JOIN k ON k.name = t.key),
s AS (SELECT name, ordinal, vid, greatest(-1.0, least(1.0, raw)) AS score FROM m),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, ordinal, vid) = 1),
n AS (SELECT name, count(DISTINCT vid) AS n_candidates FROM s GROUP BY 1)
SELECT name, CASE WHEN score IS NULL OR score <= -0.4 THEN 'new' WHEN score >= 0.6 THEN 'merge' ELSE 'new' END AS route, CASE WHEN score >= 0.6 THEN vid END AS vid, coalesce(n_candidates, 0) AS n_candidates
FROM w LEFT JOIN b USING (name) LEFT JOIN n USING (name)""")
def resolve_designations(s, d):
    """New entities that are met by their designation, by their name or by both; the name of a third of them is known to nobody."""
    p = _t(s, d, "part")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("designation"))
    name = F.when(F.length("p_name") % 3 == 0, F.reverse("p_name")).otherwise(F.col("p_name"))
    own = p.join(after, "p_partkey", "left").groupBy(name.alias("name")).agg(F.min("designation").alias("designation"))
    props = F.create_map(F.lit("category"), F.concat(F.lit("brand#1"), (F.length("name") % 5).cast("string")), F.lit("state"), F.lit("active"))
    new = own.select(F.lit("equipment").alias("entity_type"), "name", "designation", props.alias("props"))
    return fusion.resolve_new(new, _known(s, d)).select("name", "route", "vid", F.size("candidates").cast("long").alias("n_candidates"))


@_query("SELECT DISTINCT 'source ' || l_suppkey AS name FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)")
def new_sources(s, d):
    known = _t(s, d, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("source "), F.col("s_suppkey").cast("string")).alias("name"))
    wanted = _t(s, d, "lineitem").select(F.concat(F.lit("source "), F.col("l_suppkey").cast("string")).alias("name"))
    return feeds.new_sources(known, wanted)


@_query("SELECT DISTINCT 'record_article_' || l_orderkey AS src, 'equipment_' || l_partkey AS dst FROM lineitem")
def legacy_mention_edges(s, d):
    rows = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("equipment_id"))
    return mutations.legacy_mentions(rows, "equipment", "equipment_id")


@_query("""SELECT 'persons_' || c_custkey AS vid, 'person' AS tag, c_name AS name FROM customer UNION ALL SELECT 'equipment_' || p_partkey, 'equipment', p_name FROM part
UNION ALL SELECT 'locations_' || n_nationkey, 'location', n_name FROM nation""")
def legacy_vertex_rows(s, d):
    c, p, n = _t(s, d, "customer"), _t(s, d, "part"), _t(s, d, "nation")
    return mutations.legacy_vertices({"persons": (c.withColumn("name", F.col("c_name")), "c_custkey", "person"), "equipment": (p.withColumn("name", F.col("p_name")), "p_partkey", "equipment"), "locations": (n.withColumn("name", F.col("n_name")), "n_nationkey", "location")})


@_query("""WITH k AS (SELECT 'equip_' || p_partkey AS vid, p_name AS name, p_partkey % 5 = 0 AS aliased FROM part WHERE p_size < 25), l AS (SELECT p_name AS name, 'local' AS vid FROM part WHERE p_size = 30 GROUP BY 1),
w AS (SELECT p_name AS name FROM part UNION SELECT reverse(p_name) FROM part),
a AS (SELECT x AS name, min(vid) AS vid FROM (SELECT vid, unnest([name, reverse(name)]) AS x FROM k WHERE aliased) GROUP BY 1), n AS (SELECT name, min(vid) AS vid FROM k GROUP BY 1)
SELECT w.name, coalesce(l.vid, n.vid, a.vid) AS vid FROM w LEFT JOIN l USING (name) LEFT JOIN n USING (name) LEFT JOIN a USING (name)""")
def resolve_names_and_aliases(s, d):
    p = _t(s, d, "part")
    kind = F.lit("equipment").alias("entity_type")
    wanted = p.select(kind, F.col("p_name").alias("name")).unionByName(p.select(kind, F.reverse("p_name").alias("name"))).distinct()
    local = p.filter("p_size = 30").select(kind, F.col("p_name").alias("name"), F.lit("local").alias("vid")).distinct()
    return fusion.resolve_names(wanted, local, _known(s, d)).select("name", "vid")


def _neighbours(s: SparkSession, d: str) -> DataFrame:
    """Each customer and the one with the next key, as persons with gender, card and industry."""
    c = _t(s, d, "customer")
    gender = F.when(F.col("k") % 3 == 0, "male").when(F.col("k") % 3 == 1, "Female").otherwise("")
    props = F.create_map(F.lit("gender"), gender, F.lit("id_card"), F.when(F.col("k") % 2 == 0, F.floor(F.col("k") / 4).cast("string")).otherwise("__NULL__"), F.lit("industry"), F.col("seg"), F.lit("note"), F.concat_ws(" ", "seg", F.lit("of"), "nation"))
    own = c.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nation")).withColumn("props", props)
    a, b = own.select("k", F.col("props").alias("props_a")), own.select((F.col("k") - 2).alias("k"), F.col("props").alias("props_b"))
    return a.join(b, "k")


_NEIGHBOURS_SQL = """c AS (SELECT c_custkey AS k, lower(c_mktsegment) AS seg, 'n' || c_nationkey AS nation, CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE '' END AS g, CASE WHEN c_custkey % 2 = 0 THEN CAST(CAST(floor(c_custkey / 4) AS BIGINT) AS VARCHAR) ELSE '' END AS card FROM customer),
p AS (SELECT a.k, a.g AS ga, b.g AS gb, a.card AS ca, b.card AS cb, CASE WHEN a.seg = b.seg THEN 'match' ELSE 'conflict' END AS i,
    CASE WHEN a.seg = b.seg AND a.nation = b.nation OR contains(a.seg || ' of ' || a.nation, b.seg || ' of ' || b.nation) OR contains(b.seg || ' of ' || b.nation, a.seg || ' of ' || a.nation) THEN 'match'
         WHEN len(list_intersect([a.seg, 'of', a.nation], [b.seg, 'of', b.nation])) / len(list_distinct([a.seg, 'of', a.nation, b.seg, 'of', b.nation])) >= 0.65 THEN 'match' ELSE 'conflict' END AS n
  FROM c a JOIN c b ON b.k = a.k + 2),
r AS (SELECT *, list_filter([CASE WHEN ga = '' AND gb = '' THEN NULL WHEN ga = '' OR gb = '' THEN 'unknown' WHEN ga = gb OR contains(ga, gb) OR contains(gb, ga) THEN 'match' ELSE 'conflict' END, CASE WHEN ca = '' AND cb = '' THEN NULL WHEN ca = '' OR cb = '' THEN 'unknown' WHEN ca = cb OR contains(ca, cb) OR contains(cb, ca) THEN 'match' ELSE 'conflict' END, i, n], lambda x: x IS NOT NULL) AS f FROM p),
q AS (SELECT *, len(list_filter(f, lambda x: x = 'match')) / len(f) AS overlap, len(list_filter(f, lambda x: x = 'conflict')) / len(f) AS clash FROM r)"""
_MODEL = (("property_overlap_rate", 0.4, 0.25, 2.0), ("property_conflict_rate", 0.3, 0.5, -1.5))


@_query(f"""WITH {_NEIGHBOURS_SQL}, z AS (SELECT *, 1 / (1 + exp(-(0.1 + 2.0 * (overlap - 0.4) / 0.25 - 1.5 * (clash - 0.3) / 0.5))) AS prob FROM q)
SELECT k, CASE WHEN ga <> '' AND gb <> '' AND ga <> gb THEN -1.0::DOUBLE WHEN ca <> '' AND ca = cb THEN 0.95::DOUBLE ELSE round(prob, 4) END AS score,
  CASE WHEN ga <> '' AND gb <> '' AND ga <> gb THEN 'reject' WHEN ca <> '' AND ca = cb THEN 'merge' WHEN prob >= 0.7 THEN 'merge' WHEN prob <= 0.3 THEN 'reject' ELSE 'escalate' END AS decision FROM z""")
def adaptive_scores(s, d):
    model = learning.Scorer([m[0] for m in _MODEL], [m[1] for m in _MODEL], [m[2] for m in _MODEL], [m[3] for m in _MODEL], 0.1, 0.7, 0.3).column()
    out = scorer.adaptive(_neighbours(s, d).withColumn("entity_type", F.lit("person")), None, model)
    return out.select("k", "s.score", "s.decision")


@_query(f"""WITH {_NEIGHBOURS_SQL} SELECT k, CASE WHEN ga <> '' AND gb <> '' AND ga <> gb THEN 'hard conflict' WHEN ca <> '' AND ca = cb THEN 'near-perfect identifier match' ELSE 'scored' END AS rule FROM q""")
def settled_by_rules(s, d):
    out = scorer.adaptive(_neighbours(s, d).withColumn("entity_type", F.lit("person")))
    return out.select("k", F.when(F.col("s.detail").startswith("fields="), "scored").otherwise(F.col("s.detail")).alias("rule"))


_FEATURES_SQL = """m AS (SELECT *, len(f) AS nf, len(list_filter(f, lambda x: x = 'match')) AS nm, len(list_filter(f, lambda x: x = 'conflict')) AS nc, len(f) - 1 AS ns FROM q),
l AS (SELECT k, unnest(['property_overlap_rate', 'property_conflict_rate', 'n_effective_fields', 'n_strong_fields', 'n_weak_fields', 'strong_overlap_rate', 'weak_overlap_rate', 'strong_conflict_rate', 'weak_conflict_rate', 'hard_conflict', 'near_perfect_match', 'name_similarity', 'name_exact', 'name_containment']) AS feature,
  unnest([nm / nf, nc / nf, nf, ns, 1, (nm - (n = 'match')::INT) / ns, (n = 'match')::INT, (nc - (n = 'conflict')::INT) / ns, (n = 'conflict')::INT, (ga <> '' AND gb <> '' AND ga <> gb)::INT, (ca <> '' AND ca = cb)::INT, 0, 0, 0]::DOUBLE[]) AS value FROM m)"""


@_query(f"WITH {_NEIGHBOURS_SQL}, {_FEATURES_SQL} SELECT feature, round(avg(value), 6) AS mean, count(*) AS n FROM l GROUP BY 1")
def every_pair_feature(s, d):
    m = scorer.features(F.col("props_a"), F.col("props_b"), F.lit("person"), F.lit(""), F.lit(""), compared=F.col("_fields"), values=(F.col("_a"), F.col("_b")))
    long = fusion.prepared(fusion.spread(_neighbours(s, d), "k")).select(F.explode(m).alias("feature", "value")).filter("feature not like 'fld%'")
    return long.groupBy("feature").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@_query("SELECT c_custkey AS k, 'equip_' || c_custkey AS vid, CASE c_custkey % 3 WHEN 0 THEN 'category,name' WHEN 1 THEN 'gender,name' ELSE '' END AS fields FROM customer")
def candidate_fields(s, d):
    c = _t(s, d, "customer")
    kind = F.when(F.col("c_custkey") % 3 == 0, "equipment").when(F.col("c_custkey") % 3 == 1, "person").otherwise("other")
    props = F.create_map(*(x for k in ("name", "category", "gender", "vid") for x in (F.lit(k), F.lit("v"))))
    return c.select(F.col("c_custkey").alias("k"), _key("equip", "c_custkey").alias("vid"), F.array_join(F.array_sort(F.map_keys(scorer.candidate_properties(props, kind))), ",").alias("fields"))


# --- strings, replies and prompts -----------------------------------------------------


@_query("SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN c_name || ';' || c_mktsegment WHEN 1 THEN c_name || ';' || c_mktsegment WHEN 2 THEN c_name || ';' || c_mktsegment WHEN 3 THEN c_name ELSE '' END AS aliases FROM customer")
def parse_aliases(s, d):
    k, n, m = F.col("c_custkey") % 5, F.col("c_name"), F.col("c_mktsegment")
    raw = F.when(k == 0, F.concat(F.lit("{'"), n, F.lit("' , "), m, F.lit("}"))).when(k == 1, F.concat_ws("||", n, F.lit(" "), m)).when(k == 2, F.concat(F.lit('["'), n, F.lit('","'), m, F.lit('"]'))).when(k == 3, F.concat(F.lit(" "), n))
    return _t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.array_join(text.parse_aliases(raw), ";").alias("aliases"))


@_query("""SELECT conv_id, turn, CASE (turn + length(conv_id::VARCHAR)) % 6 WHEN 0 THEN 'same' WHEN 1 THEN 'different' WHEN 2 THEN 'different' WHEN 3 THEN 'same' WHEN 4 THEN 'unknown' ELSE 'unknown' END AS verdict,
  CASE (turn + length(conv_id::VARCHAR)) % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE -1 END AS label, CASE (turn + length(conv_id::VARCHAR)) % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 5 THEN 1 ELSE -1 END AS matched FROM conversations""")
def verdict_replies(s, d):
    c, k = _t(s, d, "conversations"), (F.col("turn") + F.length(F.col("conv_id").cast("string"))) % 6
    reply = (F.when(k == 0, "<think>different?</think>```\nSame thing").when(k == 1, "Different: no").when(k == 2, "I would say they are different ones").when(k == 3, "It is the same one")
             .when(k == 4, "UNKNOWN").otherwise("a match, perhaps"))
    v = replies.verdict(reply)
    return c.select("conv_id", "turn", v.alias("verdict"), replies.verdict_label(v).alias("label"), replies.match_reply(reply).alias("matched"))


@_query("SELECT c_custkey AS k, CASE WHEN c_custkey % 4 IN (0, 1) THEN 'person_' || c_custkey END AS match_vid, CAST(CASE c_custkey % 4 WHEN 3 THEN 0.0 ELSE 0.75 END AS DOUBLE) AS confidence, CASE c_custkey % 4 WHEN 3 THEN 'parse_fail' ELSE c_mktsegment END AS reason FROM customer")
def judge_replies(s, d):
    k, own = F.col("c_custkey") % 4, _key("person", "c_custkey")
    body = lambda vid: F.concat(F.lit('{"match_vid": "'), vid, F.lit('", "confidence": 0.75, "reason": "'), F.col("c_mktsegment"), F.lit('"}'))
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), body(own), F.lit("\n```"))).when(k == 1, F.concat(F.lit("<think>hm</think>So: "), body(own), F.lit(" it is."))).when(k == 2, body(F.lit("nobody"))).otherwise("no idea")
    return _t(s, d, "customer").select(F.col("c_custkey").alias("k"), replies.judge_reply(reply, F.array(own)).alias("j")).select("k", "j.match_vid", "j.confidence", "j.reason")


@_query("""WITH x AS (SELECT c_custkey AS k, lower(c_name) AS a, lower(s_name) AS b, c_mktsegment AS m FROM customer JOIN supplier ON c_custkey = s_suppkey)
SELECT k, 'person' AS kind, k AS number, CASE WHEN contains(b, right(a, 4)) THEN CAST(round(0.4 + 0.3 * 4 / length(b), 6) AS DOUBLE) ELSE 0.0::DOUBLE END AS containment, CAST(CASE WHEN k % 2 = 0 THEN 0.3 ELSE 0.25 END AS DOUBLE) AS crossed, k % 10 <= 1 AS near FROM x""")
def name_helpers(s, d):
    x = _t(s, d, "customer").join(_t(s, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    ka = F.array(F.lower("c_name"), F.lit("arabian gulf"))
    kb = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lower("c_name"))).otherwise(F.array(F.lit("persian gulf")))
    years = text.years_close(F.lit("2020-05-01"), F.concat(F.lit("202"), (F.col("c_custkey") % 10).cast("string")))
    vid = _key("person", "c_custkey")
    return x.select(F.col("c_custkey").alias("k"), text.vid_type(vid).alias("kind"), text.vid_number(vid).alias("number"), F.round(text.containment_score(F.expr("right(c_name, 4)"), F.col("s_name")), 6).alias("containment"), text.alias_cross_score(ka, kb).alias("crossed"), years.alias("near"))


@_query("SELECT p_partkey, substring(split_part(lower(p_name), ' ', 1), 1, 3) AS k FROM part")
def block_keys(s, d):
    return _t(s, d, "part").select("p_partkey", crosslingual.block_key(F.col("p_name")).alias("k"))


@_query("""SELECT event_id, date_trunc('second', ts) AS compact, date_trunc('second', ts) AS iso, CASE WHEN event_id % 7 = 0 THEN 'Infinity'::DOUBLE ELSE round(epoch(TIMESTAMP '2024-03-01' - date_trunc('second', ts)) / 86400.0::DOUBLE, 3) END AS days FROM events""")
def feed_times(s, d):
    ts = F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    days = text.days_since(F.when(F.col("event_id") % 7 == 0, "bad").otherwise(iso), F.lit("2024-03-01").cast("timestamp"))
    # SQL rounds the product, which may be just below a half where the decimal number is one.
    return _t(s, d, "events").select("event_id", text.feed_time(F.date_format(ts, "yyyyMMdd't'HHmmss'z'")).cast("timestamp_ntz").alias("compact"), text.feed_time(iso).cast("timestamp_ntz").alias("iso"), (F.round(days * 1000) / 1000).alias("days"))


@_query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'industry: ' || c_mktsegment || chr(10) || 'name: ' || c_name ELSE 'name: ' || c_name END AS shown FROM customer")
def cleaned_attributes(s, d):
    industry = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.when(F.col("c_custkey") % 3 == 0, "__EMPTY__").otherwise(" "))
    props = F.create_map(F.lit("name"), F.col("c_name"), F.lit("industry"), industry, F.lit("created_at"), F.lit("x"), F.lit("vid"), F.lit("y"))
    return _t(s, d, "customer").select(F.col("c_custkey").alias("k"), replies.format_attributes(props).alias("shown"))


@_query("""SELECT c_custkey AS k, 'Which candidate is the new entity, if any? Compare full names, organisations and posts; an equal name alone is not enough.' || chr(10) || chr(10) || 'New person: ' || c_name || chr(10) || 'industry: ' || c_mktsegment || chr(10) || 'Sources:' || chr(10)
  || CASE WHEN c_custkey % 2 = 0 THEN '- ' || c_mktsegment || ' of ' || c_name || chr(10) || '- ' || c_name ELSE '- excerpt' END || chr(10) || chr(10) || 'Candidates:' || chr(10) || '[person_1] ' || c_name || chr(10) || '(no attributes)' || chr(10) || 'Source: seen' || chr(10) || chr(10)
  || 'Answer as JSON: {"match_vid": id or null, "confidence": 0 to 1, "reason": text}.' AS prompt FROM customer""")
def candidate_prompts(s, d):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    fragments = F.when(F.col("c_custkey") % 2 == 0, F.array(n, F.concat(m, F.lit(" of "), n), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    none = F.create_map().cast("map<string,string>")
    known = F.array(F.struct(F.lit("person_1").alias("vid"), n.alias("name"), none.alias("props"), F.array(F.lit("seen")).alias("fragments")))
    return _t(s, d, "customer").select(F.col("c_custkey").alias("k"), replies.candidates_prompt(F.lit("person"), n, F.create_map(F.lit("industry"), m), fragments, F.lit("excerpt"), known).alias("prompt"))


@_query("""WITH e AS (SELECT 't' || (event_id % 3) AS entity_type, event_id AS o, 'a' || user_id AS a, 'b' || event_id AS b, event_type FROM events WHERE event_type IN ('click', 'signup'))
SELECT entity_type, 'Reference examples (from expert human judgments):' || chr(10) || string_agg('  "' || a || '" vs "' || b || '" ' || CASE WHEN event_type = 'click' THEN '→ SAME (seen)' ELSE '→ DIFFERENT' END, chr(10) ORDER BY o) || chr(10) AS text FROM e WHERE o <= 500 GROUP BY 1""")
def few_shot_texts(s, d):
    e = _t(s, d, "events").filter("event_type in ('click', 'signup') and event_id <= 500")
    one = F.col("event_type") == "click"
    rows = e.select(F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string")).alias("entity_type"), F.col("event_id").alias("ordinal"), F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("name_a"), F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("name_b"), one.cast("int").alias("label"), F.when(one, "seen").alias("reason"))
    return learning.few_shot_text(rows)


@_query("""WITH a AS (SELECT doc_id AS id, left(coalesce(text, ''), 500) AS c, n_chars FROM documents), u AS (SELECT id, n_chars, i, unnest(s) AS s FROM (SELECT id, n_chars, generate_subscripts(sp, 1) AS i, [sp[generate_subscripts(sp, 1)]] AS s FROM (SELECT id, n_chars, string_split_regex(c, '[。！？；\\n]') AS sp FROM a))),
r AS (SELECT 'loc_' || (id % 50) AS vid, id, i, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s, row_number() OVER (PARTITION BY id % 50 ORDER BY id) AS rank_ FROM u),
x AS (SELECT *, dense_rank() OVER (PARTITION BY vid ORDER BY id) AS rank FROM r)
SELECT v.vid, coalesce(left(max_by(x.s, (length(x.s), -x.rank, -x.i)), 300), '') AS sentence FROM (SELECT DISTINCT 'loc_' || (doc_id % 50) AS vid FROM documents) v LEFT JOIN x ON v.vid = x.vid AND contains(x.s, 'e') AND x.s <> '' GROUP BY 1""")
def longest_sentence_per_entity(s, d):
    docs = _t(s, d, "documents")
    vid = F.concat(F.lit("loc_"), (F.col("doc_id") % 50).cast("string")).alias("vid")
    related = docs.select(vid, F.col("doc_id").alias("article_id"), F.substring(F.coalesce("text", F.lit("")), 1, 500).alias("content"), F.dense_rank().over(Window.partitionBy(F.col("doc_id") % 50).orderBy("doc_id")).alias("rank"))
    return graph.longest_sentences(docs.select(vid, F.lit("e").alias("name")).distinct(), related)


# --- provenance, details and traversals -----------------------------------------------


def _traced(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Vertices, edges, records and articles: orders are articles, traced to their customers and parts."""
    o, line, p, c = (_t(s, d, n) for n in ("orders", "lineitem", "part", "customer"))
    v = p.select(_key("equip", "p_partkey").alias("vid"), F.lit("equip").alias("tag"), F.col("p_name").alias("name")).unionByName(c.select(_key("person", "c_custkey").alias("vid"), F.lit("person").alias("tag"), F.col("c_name").alias("name")))
    trace = line.select(_key("record_article", "l_orderkey").alias("src"), _key("equip", "l_partkey").alias("dst")).distinct().unionByName(o.select(_key("record_article", "o_orderkey").alias("src"), _key("person", "o_custkey").alias("dst")))
    e = trace.select("*", F.lit("trace").alias("type"), F.lit("article").alias("source")).unionByName(c.select(_key("person", "c_custkey").alias("src"), _key("loc", "c_nationkey").alias("dst"), F.lit("locate").alias("type"), F.lit("seed").alias("source")))
    records = o.select(_key("record_article", "o_orderkey").alias("vid"), F.col("o_orderkey").cast("string").alias("source_pk"))
    articles = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.concat_ws("\n", F.concat(F.lit("of Customer#"), F.col("o_custkey").cast("string")), "o_orderpriority", F.col("o_orderdate").cast("string")).alias("content"), F.col("o_orderdate").alias("published_at"))
    return v, e, records, articles


@_query("""WITH t AS (SELECT DISTINCT 'record_article_' || l_orderkey AS src, 'equip_' || l_partkey AS dst FROM lineitem UNION SELECT 'record_article_' || o_orderkey, 'person_' || o_custkey FROM orders)
SELECT CAST(split_part(src, '_', 3) AS BIGINT) AS article_id, dst AS vid FROM t""")
def article_entities(s, d):
    v, e, _, articles = _traced(s, d)
    return graph.article_entities(articles, e, v).select("article_id", "vid")


@_query("""WITH f AS (SELECT min(o_orderkey) AS k FROM orders), t AS (SELECT DISTINCT l_orderkey AS o, 'equip_' || l_partkey AS dst FROM lineitem UNION SELECT o_orderkey, 'person_' || o_custkey FROM orders),
gone AS (SELECT dst FROM t WHERE o = (SELECT k FROM f) AND dst NOT IN (SELECT dst FROM t WHERE o <> (SELECT k FROM f)))
SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM customer) - (SELECT count(*) FROM gone) AS n_vertices, (SELECT count(*) FROM t WHERE o <> (SELECT k FROM f)) AS n_traces, (SELECT count(*) FROM customer WHERE 'person_' || c_custkey NOT IN (SELECT dst FROM gone)) AS n_other""")
def retract_article(s, d):
    v, e, _, articles = _traced(s, d)
    first = articles.agg(F.min("id")).first()[0]
    vertices, edges = graph.retract(v, e, f"record_article_{first}")
    n = edges.agg(F.count_if(F.col("type") == "trace").alias("n_traces"), F.count_if(F.col("type") != "trace").alias("n_other"))
    return vertices.agg(F.count("*").alias("n_vertices")).crossJoin(n)


_OWN_TRACES = "tr AS (SELECT DISTINCT l_orderkey AS o, 'equip_' || l_partkey AS vid FROM lineitem UNION SELECT o_orderkey, 'person_' || o_custkey FROM orders)"


@_query(f"WITH {_OWN_TRACES}, x AS (SELECT vid, count(*) FILTER (o % 2 = 0) AS own, count(*) FILTER (o % 2 = 1) AS other FROM tr GROUP BY 1) SELECT vid, CASE WHEN other = 0 THEN 'only' ELSE 'shared' END AS support FROM x WHERE own > 0")
def supported_and_shared(s, d):
    _, e, _, _ = _traced(s, d)
    own = F.substring_index("src", "_", -1).cast("long") % 2 == 0
    return graph.supported_only_by(e, own).withColumn("support", F.lit("only")).unionByName(graph.shared_with_others(e, own).withColumn("support", F.lit("shared")))


@_query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), t AS (SELECT DISTINCT 'record_article_' || l_orderkey AS src, 'equip_' || l_partkey AS dst FROM lineitem UNION SELECT 'record_article_' || o_orderkey, 'person_' || o_custkey FROM orders)
SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM customer WHERE c_nationkey <> 3) AS n_vertices, (SELECT count(*) FROM t WHERE dst NOT IN (SELECT 'person_' || c_custkey FROM g)) + (SELECT count(*) FROM customer WHERE c_nationkey <> 3) AS n_edges""")
def delete_vertices(s, d):
    v, e, _, _ = _traced(s, d)
    gone = _t(s, d, "customer").filter("c_nationkey = 3").select(_key("person", "c_custkey").alias("vid"))
    vertices, edges = graph.delete_vertices(v, e, gone)
    return vertices.agg(F.count("*").alias("n_vertices")).crossJoin(edges.agg(F.count("*").alias("n_edges")))


@_query("""WITH e AS (SELECT 'person_' || c_custkey AS a, 'loc_' || c_nationkey AS b FROM customer), n AS (SELECT a AS vid, 'out' AS dir, b AS x, coalesce(n_name, b) AS name FROM e LEFT JOIN nation ON b = 'loc_' || n_nationkey UNION ALL SELECT b, 'in', a, c_name FROM e JOIN customer ON a = 'person_' || c_custkey)
SELECT vid, string_agg(name, ',' ORDER BY dir, x) AS related FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY dir, x) AS r FROM n) WHERE r <= 5 GROUP BY 1""")
def related_context(s, d):
    c, n = _t(s, d, "customer"), _t(s, d, "nation")
    e = c.select(_key("person", "c_custkey").alias("src"), _key("loc", "c_nationkey").alias("dst"), F.lit("locate").alias("type"))
    v = c.select(_key("person", "c_custkey").alias("vid"), F.col("c_name").alias("name")).unionByName(n.select(_key("loc", "n_nationkey").alias("vid"), F.col("n_name").alias("name")))
    return graph.related_context(v.select("vid"), e, v).select("vid", F.array_join("related", ",").alias("related"))


@_query(f"""WITH {_OWN_TRACES}, h AS (SELECT vid, 'in' AS direction, 'record_article_' || o AS neighbour FROM tr UNION ALL SELECT 'record_article_' || o, 'out', vid FROM tr)
SELECT vid, direction, count(*) AS n, min(neighbour) AS first FROM h GROUP BY 1, 2""")
def one_hop_over_traces(s, d):
    v, e, records, _ = _traced(s, d)
    vids = v.select("vid").unionByName(records.select("vid"))
    hops = graph.one_hop(vids, e.filter("type = 'trace'"), v)
    return hops.groupBy("vid", "direction").agg(F.count("*").alias("n"), F.min("neighbour").alias("first"))


@_query("SELECT 'equip_' || p_partkey AS src, min('loc_' || n_nationkey) AS dst, 'home_base' AS sub_type FROM part JOIN nation ON n_nationkey = p_partkey % 40 GROUP BY p_partkey")
def home_bases(s, d):
    n = _t(s, d, "nation")
    ships = _t(s, d, "part").select(_key("equip", "p_partkey").alias("vid"), (F.col("p_partkey") % 40).alias("k")).join(n.select(F.col("n_nationkey").alias("k"), "n_name"), "k", "left").select("vid", F.coalesce("n_name", F.when(F.col("k") == 30, "").otherwise("nowhere")).alias("home_base"))
    return graph.home_base_links(ships, n.select(_key("loc", "n_nationkey").alias("vid"), F.col("n_name").alias("name")), _now()).select("src", "dst", "sub_type")


@_query("""WITH t AS (SELECT 'person_' || o_custkey AS vid, 'record_article_' || o_orderkey AS r, c_name, o_custkey, o_orderpriority || chr(10) || o_orderdate AS rest FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY r) AS k FROM t), w AS (SELECT vid, o_custkey, 'of Customer#' || o_custkey || chr(10) || rest AS f FROM f WHERE k <= 5),
g AS (SELECT vid, f, row_number() OVER (PARTITION BY vid ORDER BY length(f) DESC, f) AS n FROM w)
SELECT 'person_' || c_custkey AS vid, coalesce(string_agg(f, '|' ORDER BY n), '') AS fragments FROM customer LEFT JOIN g ON g.vid = 'person_' || c_custkey AND n <= 2 GROUP BY 1""")
def source_fragments(s, d):
    _, e, records, articles = _traced(s, d)
    people = _t(s, d, "customer").select(_key("person", "c_custkey").alias("vid"), F.concat(F.lit(" customer#"), F.col("c_custkey").cast("string")).alias("name"))
    return graph.source_fragments(people, e, records, articles).select("vid", F.array_join("fragments", "|").alias("fragments"))


@_query("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rank FROM orders),
s AS (SELECT c_custkey AS k, coalesce(string_agg(id, ',' ORDER BY rank), '') AS ids, CASE WHEN count(id) > 0 THEN 'of Customer#' || c_custkey ELSE '' END AS sentence FROM customer LEFT JOIN a ON k = c_custkey AND rank <= 10 GROUP BY c_custkey)
SELECT x.k AS pair_id, x.ids AS articles_a, y.ids AS articles_b, x.sentence AS sentence_a, y.sentence AS sentence_b, 'name,org_name' AS shown FROM s x JOIN s y ON y.k = x.k + 1""")
def pair_details(s, d):
    _, e, records, articles = _traced(s, d)
    c = _t(s, d, "customer")
    name = F.concat(F.lit("Customer#"), F.col("c_custkey").cast("string"))
    people = c.select(_key("person", "c_custkey").alias("vid"), name.alias("name"), F.create_map(F.lit("name"), name, F.lit("org_name"), F.col("c_mktsegment"), F.lit("hidden"), F.lit("x")).alias("props"))
    a = c.select(F.col("c_custkey").alias("pair_id"), _key("person", "c_custkey").alias("vid_a"), F.concat(F.lit("person_"), (F.col("c_custkey") + 1).cast("string")).alias("vid_b"), F.lit("person").alias("entity_type"))
    queue = a.join(c.select((F.col("c_custkey") - 1).alias("pair_id")), "pair_id")
    out = graph.pair_details(queue, people, e, records, articles)
    ids = lambda x: F.array_join(F.transform(F.coalesce(F.col(f"articles_{x}"), F.array().cast("array<struct<rank:int,article_id:bigint,title:string,content:string>>")), lambda r: r["article_id"].cast("string")), ",").alias(f"articles_{x}")
    return out.select("pair_id", ids("a"), ids("b"), F.col("longest_sentence_a").alias("sentence_a"), F.col("longest_sentence_b").alias("sentence_b"), F.array_join(F.array_sort(F.map_keys("props_a")), ",").alias("shown"))


@_query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT user_id AS k, count(*) AS n, max(ts) AS newest FROM events GROUP BY 1)
SELECT 'person_' || c_custkey AS vid, 1 + coalesce(a.n, 0) AS n_relations, least(coalesce(a.n, 0), 20) AS n_articles, least(coalesce(p.n, 0), 50) AS n_positions, p.newest, CASE WHEN a.n > 0 THEN 'news_extract' ELSE 'seed' END AS source FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN p ON p.k = c_custkey""")
def entity_details(s, d):
    v, e, records, articles = _traced(s, d)
    ev = _t(s, d, "events").select(F.col("event_id").alias("id"), _key("person", "user_id").alias("vid"), F.col("ts").alias("reported_at"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng"))
    out = listing.entity_detail(v.filter("tag = 'person'").select("vid", "name"), e, v, records, articles, ev)
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    return out.select("vid", "n_relations", size("articles").alias("n_articles"), size("positions").alias("n_positions"), F.get("positions", F.lit(0))["reported_at"].alias("newest"), "source")


# --- lists ----------------------------------------------------------------------------


def _events_as_activities(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "military").when(F.col("event_type") == "view", "social").otherwise(F.col("event_type"))
    return _t(s, d, "events").select(_key("event", "event_id").alias("vid"), F.concat(F.lit("e"), F.col("user_id").cast("string")).alias("name"), kind.alias("event_type"))


@_query("SELECT 'event_' || event_id AS vid, 'military' AS activity_type FROM events WHERE event_type = 'click' ORDER BY 'event_' || event_id LIMIT 200")
def activity_list(s, d):
    return listing.activity_list(_events_as_activities(s, d), "exercise", 500).select("vid", "activity_type")


@_query("SELECT DISTINCT 'event_type' AS field, event_type AS value FROM events WHERE event_type <> '' UNION SELECT DISTINCT 'user', CAST(user_id AS VARCHAR) FROM events")
def distinct_filters(s, d):
    return listing.distinct_values(_t(s, d, "events").select("event_type", F.col("user_id").alias("user")), "event_type", "user")


@_query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value")
def types_by_count(s, d):
    return listing.counts_descending(_t(s, d, "part"), "p_type")


@_query("SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_partkey % 3 <> 1 AND p_brand LIKE 'Brand#1%'")
def active_ships(s, d):
    kind = F.when(F.col("p_type") == "ECONOMY", "ship").otherwise("other")
    state = F.when(F.col("p_partkey") % 3 == 0, "active").when(F.col("p_partkey") % 3 == 1, "retired")
    e = _t(s, d, "part").select("p_partkey", kind.alias("equip_type"), state.alias("state"), F.substring("p_brand", 1, 7).alias("category"))
    return listing.active_ships(e, "Brand#1").select("p_partkey")


@_query("SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN round(value % 90, 4) END AS lat, CASE WHEN event_id % 4 IN (0, 1) THEN 7.5::DOUBLE END AS lng FROM events")
def location_details(s, d):
    lat, k = F.round(F.col("value") % 90, 4).cast("string"), F.col("event_id") % 4
    c = F.when(k == 0, F.concat_ws(",", lat, F.lit("7.5"))).when(k == 1, F.concat_ws(" , ", lat, F.lit("7.5"))).when(k == 2, lat)
    return listing.location_detail(_t(s, d, "events").select("event_id", c.alias("coordinates"))).select("event_id", "lat", "lng")


@_query("SELECT event_type AS status, 'person' AS entity_type, count(*) AS total FROM events GROUP BY 1")
def queue_totals(s, d):
    return listing.queue_totals(_t(s, d, "events").select(F.col("event_type").alias("status"), F.lit("person").alias("entity_type")))


# --- changes of tables ----------------------------------------------------------------


@_query("SELECT 'person_' || c_custkey AS vid, c_name AS name, '' AS state, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, '') AS category FROM customer WHERE c_custkey % 3 <> 0")
def new_vertices(s, d):
    c = _t(s, d, "customer").select(_key("person", "c_custkey").alias("vid"), F.col("c_name").alias("name"), "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("category"))
    table = c.filter("c_custkey % 3 = 0").select("vid", "name", "category", F.lit("x").alias("state"))
    return mutations.new_vertices(c.select("vid", "name", "category").unionByName(c.select("vid", "name", "category")), table).select("vid", "name", "state", "category")


@_query("SELECT 'person_' || o_custkey AS src, 'equip_' || o_orderkey AS dst, CASE o_orderkey % 4 WHEN 0 THEN 'use_edge' WHEN 1 THEN 'locate' WHEN 2 THEN 'org_relation' ELSE 'social' END AS type, CASE WHEN o_orderkey % 5 = 0 THEN 'sub' ELSE ['use', ' Locate ', 'org_relation', 'likes'][CAST(o_orderkey % 4 AS INT) + 1] END AS sub_type, CAST(0.9 AS DOUBLE) AS confidence, CAST(o_orderkey AS VARCHAR) AS source FROM orders")
def new_edges(s, d):
    relation = F.element_at(F.array(*map(F.lit, ("use", " Locate ", "org_relation", "likes"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = _t(s, d, "orders").select(_key("person", "o_custkey").alias("src"), _key("equip", "o_orderkey").alias("dst"), relation.alias("relation"), F.when(F.col("o_orderkey") % 5 == 0, "sub").otherwise("").alias("sub_type"), F.col("o_orderkey").alias("source"))
    return mutations.new_edges(rows, _now()).drop("created_at")


@_query("SELECT 'record_article_' || o_orderkey AS vid, 'articles' AS source_table, CAST(o_orderkey AS VARCHAR) AS source_pk, o_orderpriority AS summary FROM orders UNION ALL SELECT 'record_import_person_' || c_custkey, 'manual_import', 'person_' || c_custkey, 'manual import: file' FROM customer")
def provenance_records(s, d):
    articles = mutations.article_records(_t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title")), _now())
    imports, _ = mutations.import_records(_t(s, d, "customer").select(_key("person", "c_custkey").alias("vid")), _now(), "file")
    return articles.unionByName(imports).select("vid", "source_table", "source_pk", "summary")


@_query("SELECT 'record_article_' || o_orderkey AS src, 'person_' || o_custkey AS dst, CAST(0.9 AS DOUBLE) AS confidence, 'article' AS source FROM orders UNION ALL SELECT 'record_import_person_' || c_custkey, 'person_' || c_custkey, 1.0, 'manual_import' FROM customer")
def provenance_traces(s, d):
    own = mutations.trace_edges(_t(s, d, "orders").select(_key("record_article", "o_orderkey").alias("record"), _key("person", "o_custkey").alias("vid")), _now())
    _, imports = mutations.import_records(_t(s, d, "customer").select(_key("person", "c_custkey").alias("vid")), _now())
    return own.unionByName(imports).select("src", "dst", "confidence", "source")


@_query("""WITH i AS (SELECT s_suppkey AS k, s_nationkey, s_suppkey AS ordinal, 'S' || (s_suppkey % 40) AS name FROM supplier), e AS (SELECT c_custkey AS k, 'S' || c_custkey AS name FROM customer WHERE c_custkey % 2 = 0),
u AS (SELECT e.k, max_by(CAST(s_nationkey AS VARCHAR), ordinal) AS category FROM e JOIN i USING (name) GROUP BY 1)
SELECT 'equip_' || e.k AS vid, e.name, coalesce(u.category, 'old') AS category FROM e LEFT JOIN u USING (k)""")
def upsert_known_equipment(s, d):
    e = _t(s, d, "customer").filter("c_custkey % 2 = 0").select(_key("equip", "c_custkey").alias("vid"), F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("name"), F.lit("old").alias("category"), F.lit("").alias("state"))
    i = _t(s, d, "supplier").select(F.col("s_suppkey").alias("ordinal"), F.concat(F.lit("S"), (F.col("s_suppkey") % 40).cast("string")).alias("name"), F.lit("").alias("designation"), F.col("s_nationkey").cast("string").alias("category"), F.lit("").alias("state"))
    out = mutations.upsert_equipment(e, i)
    return out.join(e.select("vid"), "vid").select("vid", "name", "category")


@_query("""WITH p AS (SELECT 'equip_' || user_id AS vid, max_by(CAST(round(value, 3) AS VARCHAR) || ',1.5', event_id) AS at, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT c.vid, coalesce(p.at, 'none') AS coordinates, coalesce(p.n, 0) AS n FROM (SELECT 'equip_' || c_custkey AS vid FROM customer WHERE c_custkey % 2 = 0) c LEFT JOIN p USING (vid)""")
def import_positions(s, d):
    e = _t(s, d, "customer").filter("c_custkey % 2 = 0").select(_key("equip", "c_custkey").alias("vid"), _key("n", "c_custkey").alias("name"), F.lit("none").alias("coordinates"))
    even = F.col("event_id") % 2 == 0
    items = _t(s, d, "events").select(F.col("event_id").alias("ordinal"), F.when(even, _key("n", "user_id")).otherwise("").alias("designation"), F.when(even, F.lit("other")).otherwise(_key("n", "user_id")).alias("name"), F.round("value", 3).alias("lat"), F.lit(1.5).alias("lng"), F.col("ts").cast("string").alias("reported_at"))
    history, own = mutations.import_positions(e, s.createDataFrame([], "vid string, lat double, lng double, reported_at string"), items)
    n = history.groupBy("vid").agg(F.count("*").alias("n"))
    return own.join(n, "vid", "left").select("vid", "coordinates", F.coalesce("n", F.lit(0)).alias("n"))


@_query("SELECT count(*) AS n, count(*) + 50 AS highest, 51 AS lowest FROM (SELECT DISTINCT c_name FROM customer WHERE c_custkey > 20)")
def import_by_name(s, d):
    c = _t(s, d, "customer").select(F.col("c_name").alias("name"), "c_custkey")
    table = c.filter("c_custkey <= 20").select(F.when(F.col("c_custkey") == 1, "loc_50").otherwise(_key("loc", "c_custkey")).alias("vid"), "name")
    out = mutations.import_by_name(table, c.select("name").unionByName(c.select("name")), "loc").withColumn("k", text.vid_number(F.col("vid")))
    return out.agg(F.count("*").alias("n"), F.max("k").alias("highest"), F.min("k").alias("lowest"))


@_query(r"""SELECT url, substring(CASE WHEN page_id % 2 = 0 THEN 'plain' ELSE trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) END, 1, 10000) AS content
FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1""")
def import_articles_into_table(s, d):
    p = _t(s, d, "pages")
    items = p.select("url", F.when(F.col("page_id") % 2 == 0, "plain").otherwise(F.col("html")).alias("content"), "page_id")
    first = items.withColumn("r", F.row_number().over(Window.partitionBy("url").orderBy("page_id"))).filter("r = 1").select("url", "content")
    return mutations.import_articles(p.filter("page_id % 3 = 0").select("url"), first.unionByName(first.limit(0))).select("url", "content")


@_query("SELECT 1 + (row_number() OVER (ORDER BY source) - 1) * 0 AS one, source AS name FROM (SELECT DISTINCT source FROM documents WHERE source <> '')")
def known_sources(s, d):
    docs = _t(s, d, "documents").select("source")
    first = docs.filter("source <> ''").agg(F.min("source").alias("name")).filter("name is not null").select(F.lit(7).cast("long").alias("id"), "name")
    out = mutations.known_sources(first, docs)
    return out.select(F.lit(1).cast("long").alias("one"), "name")


@_query("SELECT event_id AS id FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id + 1000000 FROM events WHERE event_id % 3 <> 0")
def cleared_and_remaining(s, d):
    e = _t(s, d, "events")
    queue = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "pending").otherwise("merged").alias("status"))
    todo = e.select((F.col("event_id") + 1_000_000).alias("pair_id"))
    left = mutations.remaining(todo, todo.filter("(pair_id - 1000000) % 3 = 0"))
    return mutations.cleared(queue).select("id").unionByName(left.select(F.col("pair_id").alias("id")))


@_query("SELECT doc_id AS id, CASE WHEN doc_id % 6 = 0 THEN 'done' WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN repeat('long text ', 5) || 'end' ELSE 'old' END AS content FROM documents")
def article_lifecycle(s, d):
    docs = _t(s, d, "documents").select(F.col("doc_id").alias("id"))
    a = docs.withColumns({"status": F.lit("failed"), "content": F.lit("old"), "entities_extracted": F.lit(True)})
    reset = mutations.reset_articles(a, docs.filter("id % 3 = 0"))
    pages = docs.filter("id % 5 = 0").withColumn("html", F.when(F.col("id") % 2 == 0, F.concat(F.lit("<p>"), F.repeat(F.lit("long text "), 5), F.lit("end</p>"))).otherwise("<p>short</p>"))
    done = mutations.finished_articles(mutations.refetched(reset, pages), docs.filter("id % 6 = 0").unionByName(docs.select(-F.col("id")).toDF("id")))
    return done.select("id", "status", "content")


# --- what extraction saves ------------------------------------------------------------


def _results(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each order is an article in which its first part was seen at a nation by its customer; results, articles and known entities."""
    o, line = _t(s, d, "orders"), _t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("part"))
    n, c = _t(s, d, "nation"), _t(s, d, "customer")
    rows = o.join(line, "o_orderkey").join(c.select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey")), "o_custkey").join(n.select("n_nationkey", "n_name"), "n_nationkey")
    none = F.lit(None).cast("string")
    no_alias = F.array().cast("array<string>")
    part = F.concat(F.lit("Ship "), F.col("part").cast("string"))
    relation = F.when(F.col("o_orderkey") % 4 == 0, "locate").when(F.col("o_orderkey") % 4 == 1, "based_at").when(F.col("o_orderkey") % 4 == 2, "mentioned").otherwise("use")
    rel = lambda *x: F.struct(*(v.alias(k) for k, v in zip(("subject_type", "subject_name", "relation", "sub_type", "object_type", "object_name"), x, strict=True)))
    schema = dict(f.split(" ", 1) for f in extraction.RESULT.strip().replace(",\n", "\n").split("\n"))
    arrays = {
        "equipment": F.array(F.struct(part.alias("name"), F.array(F.concat(F.lit("No "), F.col("part").cast("string"))).alias("aliases"), none.alias("designation"), F.lit("ship").alias("equipment_type"), F.lit("c").alias("category"), none.alias("status"))),
        "persons": F.array(F.struct(F.col("c_name").alias("name"), no_alias.alias("aliases"), none.alias("rank"), F.lit("captain").alias("position"), none.alias("service_branch"))),
        "locations": F.array(F.struct(F.col("n_name").alias("name"), no_alias.alias("aliases"), none.alias("location_type"), none.alias("country"), F.lit("r").alias("region"), (F.col("n_nationkey") + 1.5).alias("lat"), F.when(F.col("n_nationkey") % 2 == 0, 2.5).alias("lng"))),
        "organizations": F.array(), "activities": F.lit(None),
        "relations": F.array(rel(F.lit("ship"), part, relation, F.lit("located_at"), F.lit("base"), F.col("n_name")), rel(F.lit("person"), F.col("c_name"), F.lit("use"), none, F.lit("equipment"), F.concat(F.lit("No "), F.col("part").cast("string"))), rel(F.lit("person"), F.lit("Nobody"), F.lit("use"), none, F.lit("equipment"), part)),
    }
    results = rows.select(F.col("o_orderkey").alias("article_id"), *(v.cast(schema[k]).alias(k) for k, v in arrays.items()))
    articles = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lit("Seen. Here was it. End").alias("content"))
    parts = _t(s, d, "part").filter("p_partkey % 2 = 0")
    known = parts.select(F.lit("equipment").alias("entity_type"), _key("equip", "p_partkey").alias("vid"), F.concat(F.lit("Ship "), F.col("p_partkey").cast("string")).alias("name"), F.concat(F.lit("No "), F.col("p_partkey").cast("string")).alias("aliases"), F.create_map(F.lit("category"), F.lit("c"), F.lit("state"), F.lit("x")).alias("props"))
    return results, articles, known


def _saved(s: SparkSession, d: str) -> extraction.Saved:
    results, articles, known = _results(s, d)
    names = results.select(F.explode("equipment.name").alias("name")).distinct()
    unsure = names.filter("cast(substring(name, 6) as int) % 4 = 0").select(F.lit("equipment").alias("entity_type"), "name", F.lit(None).cast("string").alias("match_vid"), F.lit(0.1).alias("confidence"), F.lit("unclear").alias("reason"))
    told = names.filter("cast(substring(name, 6) as int) % 4 = 2").select(F.lit("equipment").alias("entity_type"), "name", F.concat(F.lit("equip_"), F.substring("name", 6, 20)).alias("match_vid"), F.lit(0.9).alias("confidence"), F.lit("same").alias("reason"))
    return extraction.save_extraction(results, articles, known, _now(), unsure.unionByName(told))


_SEEN_SQL = "ar AS (SELECT o_orderkey AS id, (SELECT min(l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS part, c_name, c_nationkey AS nk, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey), sn AS (SELECT * FROM ar WHERE part IS NOT NULL)"


@_query(f"""WITH {_SEEN_SQL} SELECT 'equipment' AS entity_type, 'Ship ' || part AS name, 'No ' || part AS aliases, 'active' AS probe FROM sn WHERE part % 4 <> 2 GROUP BY part UNION ALL SELECT 'person', c_name, '', 'captain' FROM sn GROUP BY c_name
UNION ALL SELECT 'location', n_name, '', CASE WHEN nk % 2 = 0 THEN (nk + 1.5) || ',2.5' ELSE '' END FROM sn GROUP BY n_name, nk""")
def extraction_vertices(s, d):
    probe = F.coalesce(*(F.try_element_at("props", F.lit(k)) for k in ("state", "occupation", "coordinates")))
    return _saved(s, d).vertices.select("entity_type", "name", "aliases", probe.alias("probe"))


@_query(f"""WITH {_SEEN_SQL} SELECT split_part('equip_x', '_', 1) AS src, 'loc' AS dst, CASE id % 4 WHEN 0 THEN 'locate' ELSE 'social' END AS type, 'located_at' AS sub_type, CAST(id AS VARCHAR) AS source FROM sn WHERE id % 4 < 2
UNION ALL SELECT 'equip', 'loc', 'use_edge', 'located_at', CAST(id AS VARCHAR) FROM sn WHERE id % 4 = 3 UNION ALL SELECT 'person', 'equip', 'use_edge', 'other', CAST(id AS VARCHAR) FROM sn WHERE part % 2 = 0""")
def extraction_edges(s, d):
    kind = lambda c: F.substring_index(c, "_", 1).alias(c)
    return _saved(s, d).edges.select(kind("src"), kind("dst"), "type", "sub_type", "source")


@_query(f"WITH {_SEEN_SQL} SELECT id AS article_id, CAST(nk + 1.5 AS DOUBLE) AS lat, CAST(2.5 AS DOUBLE) AS lng, CASE id % 4 WHEN 0 THEN 'located_at' ELSE 'based_at' END || ' → ' || n_name AS notes FROM sn WHERE id % 4 < 2 AND nk % 2 = 0")
def extraction_positions(s, d):
    return _saved(s, d).positions.select("article_id", "lat", "lng", "notes")


@_query(f"WITH {_SEEN_SQL} SELECT 'equip_' || part AS vid_b, 'Ship ' || part AS name_a, CAST(id AS BIGINT) AS source_article, 'Seen. Here was it. End' AS context FROM sn WHERE part % 4 = 0")
def extraction_uncertain(s, d):
    return _saved(s, d).uncertain.select("vid_b", "name_a", "source_article", "context")


@_query(f"WITH {_SEEN_SQL} SELECT id AS article_id, 1 AS n_equipment, 1 AS n_persons, 0 AS n_activities, 3 AS n_relations FROM sn")
def extraction_counts(s, d):
    return extraction.extraction_counts(_results(s, d)[0]).select("article_id", "n_equipment", "n_persons", "n_activities", "n_relations")


# --- readers of staged files ----------------------------------------------------------


def _staged(rows: DataFrame, name: str) -> str:
    """The path of a text file's folder with these lines, in the shared folder; rows: line."""
    path = f"{shared_dir(rows.sparkSession)}/kithline-staged-{name}-{uuid.uuid4().hex}"
    rows.select("line").coalesce(1).write.text(path)
    return path


def _lines(rows: DataFrame, *columns) -> DataFrame:
    return rows.select(F.concat_ws("\t", *columns).alias("line"))


@_query("SELECT 'http://x/' || n_nationkey AS uri, n_name AS label, CASE WHEN n_nationkey % 2 = 0 THEN 'T' || n_name ELSE n_name END AS trans FROM nation")
def read_labels(s, d):
    n = _t(s, d, "nation")
    uri = F.concat(F.lit("http://x/"), F.col("n_nationkey").cast("string"))
    own = _lines(n, uri, "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("T"), "n_name")))
    return files.labels(s, _staged(own.unionByName(_lines(n, uri)), "labels"))


@_query("SELECT 'a' || c_custkey AS uri_a, 'b' || c_nationkey AS uri_b FROM customer WHERE c_custkey % 3 <> 0")
def read_alignment(s, d):
    third = F.when(F.col("c_custkey") % 3 == 0, "more")
    return files.alignment(s, _staged(_lines(_t(s, d, "customer"), F.concat(F.lit("a"), F.col("c_custkey").cast("string")), F.concat(F.lit("b"), F.col("c_nationkey").cast("string")), third), "alignment"))


@_query("SELECT 'http://x/' || c_custkey AS uri, array_to_string(list_sort(list_distinct([lower(c_mktsegment), 'n' || c_nationkey])), ',') AS attributes FROM customer")
def read_attributes(s, d):
    own = _lines(_t(s, d, "customer"), F.concat(F.lit("http://x/"), F.col("c_custkey").cast("string")), F.concat(F.lit("p/"), "c_mktsegment"), F.concat(F.lit("q/N"), F.col("c_nationkey").cast("string")), F.concat(F.lit("r/"), F.lower("c_mktsegment")))
    return files.attributes(s, _staged(own, "attributes"), True).select("uri", F.array_join(F.array_sort("attributes"), ",").alias("attributes"))


@_query("SELECT 's' || s_suppkey AS s, 'in' AS p, 'n' || s_nationkey AS o FROM supplier WHERE s_suppkey % 2 = 0")
def read_triples(s, d):
    end = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    return files.triples(s, _staged(_lines(_t(s, d, "supplier"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.lit("in"), end), "triples"))


def _object(rows: DataFrame, key: str, item) -> DataFrame:
    """One line: a JSON object with the items in a list; small tables only."""
    return rows.agg(F.to_json(F.struct(F.collect_list(item).alias(key))).alias("line"))


@_query("SELECT CAST(n_nationkey AS VARCHAR) AS pair_id, CASE WHEN n_nationkey % 2 = 0 THEN 'activity' ELSE 'person' END AS entity_type, n_name AS name_a, 'v' AS k FROM nation")
def read_pair_set(s, d):
    kind = F.when(F.col("n_nationkey") % 2 == 0, "event").otherwise("person")
    item = F.struct(F.col("n_nationkey").cast("string").alias("pair_id"), F.col("n_name").alias("name_a"), kind.alias("type_a"), F.create_map(F.lit("k"), F.lit("v")).alias("props_a"))
    out = files.pair_set(s, _staged(_object(_t(s, d, "nation"), "same_type_pairs", item), "pairs"))
    return out.select("pair_id", "entity_type", "name_a", F.col("props_a")["k"].alias("k"))


@_query("SELECT CAST(n_nationkey AS VARCHAR) AS pair_id, CASE n_nationkey % 3 WHEN 0 THEN 1 ELSE 0 END AS label FROM nation WHERE n_nationkey % 3 < 2")
def read_ground_truth(s, d):
    label = F.when(F.col("n_nationkey") % 3 == 0, "same").when(F.col("n_nationkey") % 3 == 1, "different").otherwise("unsure")
    return files.ground_truth(s, _staged(_object(_t(s, d, "nation"), "records", F.struct(F.col("n_nationkey").cast("string").alias("pair_id"), label.alias("final_label"))), "truth"))


@_query("SELECT 'v' || n_nationkey AS key, n_name AS verdict FROM nation")
def read_keyed_json(s, d):
    entry = F.struct(F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("k"), F.struct(F.col("n_name").alias("verdict")).alias("v"))
    line = _t(s, d, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("line"))
    return files.keyed_json(s, _staged(line, "keyed"), "struct<verdict:string>")


@_query("SELECT 'equipment' AS section, n_name AS name, row_number() OVER (ORDER BY n_nationkey) - 1 AS ordinal FROM nation UNION ALL SELECT 'locations', r_name, row_number() OVER (ORDER BY r_regionkey) - 1 FROM region")
def read_import(s, d):
    ordered = lambda t, k, n: _t(s, d, t).agg(F.transform(F.array_sort(F.collect_list(F.struct(k, n))), lambda x: F.struct(x[n].alias("name"))).alias("x"))
    both = ordered("nation", "n_nationkey", "n_name").withColumnRenamed("x", "equipment").crossJoin(ordered("region", "r_regionkey", "r_name").withColumnRenamed("x", "locations"))
    parts = files.import_file(s, _staged(both.select(F.to_json(F.struct("equipment", "locations")).alias("line")), "import"))
    section = lambda k: parts[k].select(F.lit(k).alias("section"), "name", F.col("ordinal").cast("long").alias("ordinal"))
    return section("equipment").unionByName(section("locations")).unionByName(parts["articles"].select(F.lit("x").alias("section"), F.col("title").alias("name"), F.col("ordinal").cast("long").alias("ordinal")))


@_query("SELECT max('unified_v' || n_nationkey) AS version FROM nation")
def newest_model_version(s, d):
    v = _t(s, d, "nation").select(F.concat(F.when(F.col("n_nationkey") < 100, "unified_v").otherwise("x"), F.col("n_nationkey").cast("string")).alias("version"))
    return files.newest_version(v.unionByName(s.createDataFrame([("zzz_v9",)], "version string")), "unified")


@_query("SELECT 'u' || n_nationkey AS url, 'Navy ' || n_name AS title, 'text of ' || n_name AS content FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 30)")
def read_rss(s, d):
    n = _t(s, d, "nation")
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(
        F.lit("<item><title>Navy "), x["n_name"], F.lit("</title><link>u"), x["n_nationkey"].cast("string"), F.lit("</link><description>&lt;p&gt;text of "), x["n_name"], F.lit("&lt;/p&gt;</description></item>"))), "")
    path = _staged(n.agg(F.concat(F.lit("<rss><channel><item><title>cooking</title><link>c</link><description>x</description></item>"), items, F.lit("</channel></rss>")).alias("line")), "rss")
    return feeds.rss(s, path, "daily").select("url", "title", "content")


@_query("SELECT 'u' || n_nationkey AS url, 'fleet ' || n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN repeat('word ', 60) || 'end' ELSE '' END AS content FROM nation WHERE n_nationkey % 5 <> 0")
def read_json_feed(s, d):
    n = _t(s, d, "nation")
    title = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("fleet yoga "), "n_name")).otherwise(F.concat(F.lit("fleet "), "n_name"))
    path = _staged(_object(n, "articles", F.struct(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("url"), title.alias("title"), F.lit("20240131T120000Z").alias("seendate"))), "feed")
    bodies = n.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("url"), F.concat(F.lit("<article>"), F.repeat(F.lit("word "), 60), F.lit("end</article>")).alias("html"))
    return feeds.json_feed(s, path, "daily", bodies).select("url", "title", "content")


# --- streams --------------------------------------------------------------------------


def _stream(s: SparkSession, d: str) -> DataFrame:
    schema = s.read.parquet(f"{d}/events.parquet").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _ended(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream's last micro-batch gives in complete mode, or all of them in append mode."""
    s = stream.sparkSession
    base = f"{shared_dir(s)}/kithline-stream-{uuid.uuid4().hex}"
    put = lambda rows, _: rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")
    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{base}/out")


@_query("SELECT 'equip_' || user_id AS vid, max(ts) AS reported_at FROM events GROUP BY 1")
def stream_latest_positions(s, d):
    rows = _stream(s, d).select(_key("equip", "user_id").alias("vid"), F.col("value").alias("lat"), F.lit(0.0).alias("lng"), F.col("ts").alias("reported_at"))
    return _ended(streams.latest_positions(rows), "complete").select("vid", F.col("reported_at").cast("timestamp_ntz").alias("reported_at"))


@_query("WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) - to_days(CAST(k AS INT)) AS start FROM events, range(7) r(k)) SELECT event_type, start, count(*) AS n FROM w GROUP BY 1, 2")
def stream_sliding_counts(s, d):
    return _ended(streams.sliding_counts(_stream(s, d), "ts", "7 days", "1 day", "1 day", "event_type"), "complete").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b, event_id FROM events), k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, session""")
def stream_sessions(s, d):
    return _ended(streams.sessions(_stream(s, d), "user_id"), "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@_query("SELECT DISTINCT user_id FROM events")
def stream_distinct(s, d):
    return _ended(streams.distinct_within(_stream(s, d), "user_id", "ts", "400 days").select("user_id"), "append")


@_query("SELECT 'u' || user_id AS url, count(*) AS n FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 7 <> 0) GROUP BY 1")
def stream_new_articles(s, d):
    table = f"kithline_articles_{uuid.uuid4().hex}"
    rows = _stream(s, d).select(F.when(F.col("user_id") % 7 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("url"), "event_id")
    for k in range(2):  # a second reader finds nothing new
        streams.new_articles(s, rows, table, f"{shared_dir(s)}/kithline-stream-{table}-{k}").awaitTermination()
    return s.table(table).groupBy("url").agg(F.count("*").alias("n"))


def _sliced(s: SparkSession, rows: DataFrame, order: str, parts: int) -> DataFrame:
    """rows as a stream of so many micro-batches, in order: a file each, written one after another."""
    base = f"{shared_dir(s)}/kithline-slices-{uuid.uuid4().hex}"
    share = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10000)).first()[0]
    for i in range(parts):
        low, high = (F.lit(True) if i == 0 else F.col(order) > share[i - 1]), (F.lit(True) if i == parts - 1 else F.col(order) <= share[i])
        rows.filter(low & high).coalesce(1).write.mode("append").parquet(base)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(base)


@_query("SELECT count(*) AS n, count(*) // 50 > 0 AS trained, 4 AS batches FROM events")
def stream_retrain(s, d):
    """Four micro-batches; the count goes on from batch to batch, and a second run of the same stream adds nothing."""
    table, calls = f"kithline_counts_{uuid.uuid4().hex}", []
    rows = _sliced(s, _t(s, d, "events").select("event_id"), "event_id", 4)
    for _ in range(2):
        streams.retrain_every(rows, table, 50, lambda: calls.append(1), f"{shared_dir(s)}/kithline-stream-{table}").awaitTermination()
    return s.table(table).agg(F.sum("n").alias("n"), F.count("*").cast("int").alias("batches")).withColumn("trained", F.lit(1 <= len(calls) <= 4))


_KINDS = ("arrived", "claimed", "extracted", "no_result", "error", "reset")


def _article_events(s: SparkSession, d: str) -> DataFrame:
    """Each user's events as those of an article: it arrives first, then whatever the events' values say."""
    e = _t(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("article_id"), "value")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.pmod(F.floor(F.col("value") * 10), F.lit(6)) + 1).cast("int"))
    first = F.row_number().over(Window.partitionBy("article_id").orderBy("ts", "event_id")) == 1
    return e.select("article_id", "event_id", "ts", F.when(first, "arrived").otherwise(kind).alias("kind"), (F.col("article_id") % 5 == 0).alias("empty"))


@_query()
def stream_article_status(s, d):
    """Transitions of all articles, from five micro-batches."""
    import datetime as dt

    out = _ended(lifecycle.transitions(_sliced(s, _article_events(s, d), "ts", 5), dt.timedelta(hours=6)), "append")
    return out.select("article_id", F.col("at").cast("timestamp_ntz").alias("at"), "was", "now", "why")


@_query("SELECT event_id, user_id, upper(event_type) AS label FROM events")
def stream_resumed(s, d):
    """A stream of four micro-batches that stops twice, once with a batch written but not committed, and goes on."""
    base = f"{shared_dir(s)}/kithline-ledger-{uuid.uuid4().hex}"
    rows, stops = _sliced(s, _t(s, d, "events").select("event_id", "user_id", "event_type"), "event_id", 4), [1, 2]

    def stop(number: int) -> None:
        if stops and number == stops[0]:
            stops.pop(0)
            raise lifecycle.Stopped(f"batch {number}")

    while True:
        query = lifecycle.ledgered(rows, lambda r: r.select("event_id", "user_id", F.upper("event_type").alias("label")), base, f"{base}/checkpoint", stop)
        try:
            query.awaitTermination()
            break
        except Exception as e:  # noqa: BLE001
            if "Stopped" not in str(e):
                raise
    assert not stops
    return lifecycle.ledger_rows(s, base)


# --- learning -------------------------------------------------------------------------


def _feature_rows(s: SparkSession, d: str) -> DataFrame:
    x = _t(s, d, "labels")
    k = ((F.col("doc_id") * 37) % 101) / 101.0
    p = F.when(F.col("quality") == 1, 0.3 + 0.7 * k).otherwise(0.8 * k)
    f = F.create_map(F.lit("p"), p, F.lit("toxic"), F.col("toxic").cast("double"), F.lit("constant"), F.lit(3.0))
    return x.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).select(F.col("doc_id").alias("pair_id"), F.col("quality").alias("label"), F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("entity_type"), f.alias("features"))


_FEATURE_SQL = "u AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1), fr AS (SELECT doc_id AS pair_id, CASE WHEN quality = 1 THEN 0.3::DOUBLE + 0.7::DOUBLE * (((doc_id * 37) % 101) / 101.0::DOUBLE) ELSE 0.8::DOUBLE * (((doc_id * 37) % 101) / 101.0::DOUBLE) END AS p, toxic::DOUBLE AS toxic, quality AS label FROM u)"


@_query(f"WITH {_FEATURE_SQL}, m AS (SELECT avg(p) AS a, stddev_pop(p) AS b, avg(toxic) AS c, stddev_pop(toxic) AS d FROM fr) SELECT pair_id, round((p - a) / b, 6) AS p, CASE WHEN d > 0 THEN round((toxic - c) / d, 6) ELSE 0.0 END AS toxic, 0.0::DOUBLE AS constant FROM fr, m")
def training_matrix(s, d):
    rows = _feature_rows(s, d)
    names = learning.feature_names(rows)
    z, _, _ = learning.standardise(learning.matrix(rows, names), len(names))
    return z.select("pair_id", *(F.round(F.col("z")[i], 6).alias(n) for i, n in enumerate(names)))


@_query(f"WITH {_FEATURE_SQL} SELECT count(*) AS n, count(DISTINCT label) * 5 AS cells, CAST(1 AS BIGINT) AS spread FROM fr")
def stratified_folds(s, d):
    """Folds differ by one row at most within each label."""
    own = learning.folds(_feature_rows(s, d)).groupBy("label", "fold").agg(F.count("*").alias("n"))
    per = own.groupBy("label").agg((F.max("n") - F.min("n")).alias("spread"), F.sum("n").alias("n"), F.count("*").alias("cells"))
    return per.agg(F.sum("n").alias("n"), F.sum("cells").alias("cells"), F.greatest(F.max("spread"), F.lit(1)).alias("spread"))


def _verdict_rows(s: SparkSession, d: str) -> DataFrame:
    x = _t(s, d, "labels")
    return x.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("pair_id"), F.when((F.col("doc_id") % 5 == 1) != (F.col("quality") == 1), "same").otherwise("different").alias("verdict")).dropDuplicates(["pair_id"])


@_query()
def cross_validation(s, d):
    return learning.cross_validate(_feature_rows(s, d), _verdict_rows(s, d), 70.0)


@_query()
def cross_validation_by_type(s, d):
    return learning.cross_validate(_feature_rows(s, d), _verdict_rows(s, d), 70.0, by_type=True)


@_query()
def trained_scorers(s, d):
    """The scorers of all types together and of each type, saved as versions of one name and loaded again: their weights and thresholds."""
    rows = _feature_rows(s, d)
    found = {"all": learning.train_scorer(rows, floor=0.0)} | learning.train_by_type(rows, ("t0", "t1", "t2"), floor=0.0)
    path, out = f"{shared_dir(s)}/kithline-scorers-{uuid.uuid4().hex}", []
    for name, scorer in found.items():
        if scorer is not None:
            scorer.save(s, path, f"{name}_v1")
            own = learning.Scorer.load(s, path, name)
            top = own.strongest(1)[0]
            out += [(name, n, round(w, 5), round(own.intercept, 5), own.theta_merge, own.theta_reject, top[0]) for n, w in zip(own.names, own.weights, strict=True)]
    return s.createDataFrame(out, "scorer string, feature string, weight double, intercept double, theta_merge double, theta_reject double, strongest string")


@_query()
def feedback_rounds(s, d):
    p = F.col("features")["p"]
    fixed = F.when(p >= 0.8, "merge").when(p < 0.3, "reject").otherwise("escalate")
    return learning.feedback_rounds(_feature_rows(s, d).withColumn("decision", fixed))


@_query()
def learners_compared(s, d):
    return learning.compare_learners(_feature_rows(s, d), trees=20)


def _aligned_labels(s: SparkSession, d: str) -> DataFrame:
    """Parts beside parts with a similar name: the pairs a learned aligner is tested on."""
    x = _t(s, d, "part").select("p_partkey", "p_name", "p_size", "p_brand", "p_type")
    side = lambda e, k: x.select(k.alias("j"), F.col("p_partkey").cast("string").alias(f"id_{e}"), F.concat(F.lit(f"http://{e}/"), F.regexp_replace("p_name", " ", "_")).alias(f"uri_{e}"), F.col("p_name").alias(f"label_{e}"),
                                 F.array("p_brand", "p_type").alias(f"attributes_{e}"), (F.col("p_size") % 9).cast("double").alias(f"degree_{e}"))
    same = side("a", F.col("p_partkey")).join(side("b", F.col("p_partkey")), "j").withColumn("label", F.lit(1))
    other = side("a", F.col("p_partkey")).join(side("b", F.col("p_partkey") - 1), "j").withColumn("label", F.lit(0))
    both = same.unionByName(other)
    noisy = F.col("j") % 4 == 0
    return both.withColumn("label_b", F.when(noisy, F.lit("item")).otherwise(F.col("label_b"))).withColumn("pair_id", F.concat_ws("|", "id_a", "id_b")).drop("j")


@_query()
def aligner_cross_validation(s, d):
    return crosslingual.cross_validated(_aligned_labels(s, d))


_SWEPT = "swept AS (SELECT t.m AS merge_t, count(*) AS n, count(*) FILTER (p >= t.m OR p < 0.3) AS decided, count(*) FILTER (p >= t.m AND label = 1 OR p < 0.3 AND p < t.m AND label = 0) AS correct FROM fr, (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS m) t GROUP BY 1)"


@_query(f"WITH {_FEATURE_SQL}, {_SWEPT} SELECT merge_t, round(decided * 100.0 / n, 2) AS interception_pct, round((0.9 * round(decided * 100.0 / n, 2) / 100 + 0.8 * (1 - round(decided * 100.0 / n, 2) / 100)) * 100, 2) AS adaptive_pct FROM swept")
def adaptive_pipeline_column(s, d):
    """The estimate over a sweep of all pairs."""
    rows = _feature_rows(s, d).select("label", F.col("features")["p"].alias("score"))
    swept = evaluation.merge_threshold_sweep(rows, [0.4, 0.5, 0.6, 0.7, 0.8, 0.9], 0.8).withColumnRenamed("threshold", "merge_t")
    return evaluation.adaptive_pipeline(swept, 0.9, 0.8).select("merge_t", "interception_pct", "adaptive_pct")


@_query(f"WITH {_FEATURE_SQL}, g AS (SELECT unnest([0.5, 0.6]::DOUBLE[]) AS m), h AS (SELECT unnest([0.1, 0.2]::DOUBLE[]) AS r), c AS (SELECT m, r, round(count(*) FILTER (p <= r OR p >= m) * 100.0 / count(*), 3) AS v FROM fr, g, h GROUP BY 1, 2) SELECT m AS merge_t, max(v) FILTER (r = 0.1) AS r_0_1, max(v) FILTER (r = 0.2) AS r_0_2 FROM c GROUP BY 1")
def sweep_matrix(s, d):
    rows = _feature_rows(s, d).select("pair_id", "label", F.col("features")["p"].alias("p"))
    return evaluation.sweep_matrix(evaluation.sweep(rows, evaluation.grid(s, [0.5, 0.6], [0.1, 0.2]), digits=3), "intercept_pct")


@_query("SELECT doc_id AS pair_id, quality AS a, toxic AS b, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE -1 END AS c, CASE WHEN quality = 1 THEN 'x' ELSE 'y' END AS kind FROM labels WHERE doc_id % 2 = 0 QUALIFY count(*) OVER (PARTITION BY doc_id) = 1")
def annotators_joined(s, d):
    once = _t(s, d, "labels").groupBy("doc_id").agg(F.count("*").alias("n"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic")).filter("n = 1")
    a, b = once.select(F.col("doc_id").alias("pair_id"), F.col("quality").alias("label")), once.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("pair_id"), F.col("toxic").alias("label"))
    human = once.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("pair_id"), F.lit(1).alias("label"))
    votes = evaluation.joined_votes(a, b, human)
    kinds = evaluation.with_labels(votes, a).select("pair_id", F.when(F.col("label") == 1, "x").otherwise("y").alias("kind"))
    return votes.join(kinds, "pair_id").select("pair_id", "a", "b", "c", "kind")


@_query("SELECT greatest(count(*) FILTER (event_type IN ('click', 'view') AND user_id % 2 = 0) - 10, 0) AS n FROM events")
def new_feedback(s, d):
    status = F.when(F.col("event_type") == "click", "merged").when(F.col("event_type") == "view", "disambig").otherwise("pending")
    log = _t(s, d, "events").select(status.alias("status"), F.lit("llm").alias("notes"), F.when(F.col("user_id") % 2 == 0, "someone").alias("resolved_by"))
    return learning.new_feedback(log, 10)


@_query("SELECT 'a' || c_custkey AS uri_a, 'b' || c_custkey AS uri_b, 1 AS label FROM customer UNION ALL SELECT 'a' || s_suppkey, 'c' || s_suppkey, 0 FROM supplier")
def labelled_union(s, d):
    pair = lambda t, k, x: _t(s, d, t).select(F.concat(F.lit("a"), F.col(k).cast("string")).alias("uri_a"), F.concat(F.lit(x), F.col(k).cast("string")).alias("uri_b"))
    return crosslingual.labelled_pairs(pair("customer", "c_custkey", "b"), pair("supplier", "s_suppkey", "c"))


@_query(f"WITH {_FEATURE_SQL}, n AS (SELECT count(*) AS n, count(*) FILTER (p >= 0.5 AND label = 1) AS tp, count(*) FILTER (p >= 0.5 AND label = 0) AS fp, count(*) FILTER (p < 0.3 AND label = 0) AS tn, count(*) FILTER (p < 0.3 AND label = 1) AS fn, count(*) FILTER (p >= 0.3 AND p < 0.5) AS escalated FROM fr) SELECT *, round((tp + tn) / greatest(n - escalated, 1), 4) AS accuracy, round((n - escalated) / n, 4) AS interception FROM n")
def escalated_confusion(s, d):
    return crosslingual.escalated_confusion(_feature_rows(s, d).select("label", F.col("features")["p"].alias("score")))


_PAGE_A = "coalesce(nullif(trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9]+', ' ', 'g')), ''), 'none')"


@_query(f"""WITH d AS (SELECT doc_id, {_PAGE_A} AS a FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN CASE WHEN len(a || ' tail of it') > 200 THEN a || ' tail of it' WHEN len(a || ' tail of it') = 200 THEN a || ' tail of it' ELSE a || 'x last' END ELSE a || 'x last' END AS text FROM d""")
def article_texts(s, d):
    """Pages with the text in nested elements of the selectors' kinds, menus before and after, or in paragraphs only."""
    a = F.coalesce(F.nullif(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z0-9]+", " ")), F.lit("")), F.lit("none"))
    x = _t(s, d, "documents").select("doc_id", a.alias("a"))
    kind = F.col("doc_id") % 4
    opens = F.when(kind == 0, '<article data-x="a > b"><article>').when(kind == 1, "<section role='main'><section>").when(kind == 2, '<div class="wide story-body"><div>').otherwise("<ul><li>")
    closes = lambda end: F.when(kind == 0, f"</article>{end}</article>").when(kind == 1, f"</section>{end}</section>").when(kind == 2, f"</div>{end}</div>").otherwise(f"</li>{end}</ul>")
    long = F.concat(F.lit("<html><body><nav>menu</nav><script>var p = '<p>no</p>'</script>"), opens, F.lit("<!-- <p>no</p> -->"), F.col("a"), closes(" tail of it "), F.lit("<footer>foot</footer>"))
    html = F.concat(long, F.lit("<p class='p'>\n "), F.col("a"), F.lit(" <b>x</b></p><p>last</body></html>"))
    return x.select("doc_id", text.article_text(html).alias("text"))


@_query("""WITH p AS (SELECT * FROM part), e AS (SELECT * FROM events)
SELECT 'ship' AS layer, 'equip_' || p_partkey AS vid, p_name AS name, NULL::DOUBLE AS lat, NULL::DOUBLE AS lng, NULL::BIGINT AS n FROM p WHERE p_type = 'ECONOMY' AND p_size % 2 = 0
UNION ALL SELECT 'location', 'loc_' || s_suppkey, s_name, (s_suppkey % 80)::DOUBLE, (s_suppkey % 170)::DOUBLE, NULL FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT 'activity', 'event_' || o_orderkey, 'o' || o_orderkey, NULL, NULL, NULL FROM orders
UNION ALL SELECT 'kpi', NULL, k, NULL, NULL, n FROM (SELECT 'n_ship' AS k, count(*) AS n FROM p WHERE p_type = 'ECONOMY' UNION ALL SELECT 'n_aircraft', count(*) FROM p WHERE p_type = 'SMALL' UNION ALL SELECT 'n_weapon', 0
  UNION ALL SELECT 'n_located', count(*) FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'n_week', count(*) FROM e WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY UNION ALL SELECT 'n_events', count(*) FROM orders)""")
def map_overview(s, d):
    """The map's three layers and its indicators as one result."""
    kind = F.when(F.col("p_type") == "ECONOMY", "ship").when(F.col("p_type") == "SMALL", "aircraft").otherwise("other")
    own = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    equipment = _t(s, d, "part").select(own("equip_", "p_partkey").alias("vid"), F.col("p_name").alias("name"), kind.alias("equip_type"), F.when(F.col("p_size") % 2 == 0, "active").otherwise("sunk").alias("state"))
    place = F.when(F.col("s_suppkey") % 3 != 0, F.concat_ws(",", (F.col("s_suppkey") % 80).cast("string"), (F.col("s_suppkey") % 170).cast("string"))).otherwise("none")
    locations = _t(s, d, "supplier").select(own("loc_", "s_suppkey").alias("vid"), F.col("s_name").alias("name"), place.alias("coordinates"))
    activities = _t(s, d, "orders").select(own("event_", "o_orderkey").alias("vid"), own("o", "o_orderkey").alias("name"))
    return listing.map_overview(equipment, locations, activities, _t(s, d, "events").select(F.col("ts").alias("published_at")), F.lit("2024-01-31").cast("timestamp_ntz"))


# --- look-ups and merges that come later ----------------------------------------------


def _indexed(s: SparkSession, rows: DataFrame, *fields: str) -> str:
    path = f"{shared_dir(s)}/kithline-index-{uuid.uuid4().hex}"
    lookups.build(rows, fields, path)
    return path


@_query("""WITH x AS (SELECT 'c' || c_custkey AS vid, 'name' AS field, lower(c_name) AS value FROM customer UNION ALL SELECT 'c' || c_custkey, 'segment', lower(c_mktsegment) FROM customer UNION ALL SELECT 's' || s_suppkey, 'name', lower(s_name) FROM supplier),
q AS (SELECT DISTINCT lower(right(c_name, 5)) AS q FROM customer WHERE c_custkey % 50 = 0 UNION SELECT lower(substr(c_mktsegment, 2, 4)) FROM customer UNION SELECT 'no such text')
SELECT q, field, value, vid FROM x, q WHERE contains(value, q)""")
def index_texts(s, d):
    """A search for the ends of each fiftieth customer's name and for parts of all segments, by the index of 3-grams."""
    c = _t(s, d, "customer")
    rows = c.select(_key("c", "c_custkey"), "c_name", "c_mktsegment").toDF("vid", "name", "segment").withColumn("vid", F.regexp_replace("vid", "_", ""))
    rows = rows.unionByName(_t(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("vid"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("segment")))
    texts = c.filter("c_custkey % 50 = 0").select(F.expr("right(c_name, 5)").alias("q")).union(c.select(F.substring("c_mktsegment", 2, 4))).union(s.createDataFrame([("no such text",)], "q string"))
    return lookups.containing(s, _indexed(s, rows, "name", "segment"), texts)


@_query("SELECT 'name' AS field, lower(p_name) AS value, 'part_' || p_partkey AS vid FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey % 50 = 0) UNION ALL SELECT 'brand', lower(p_brand), 'part_' || p_partkey FROM part WHERE p_brand = 'Brand#7'")
def index_values(s, d):
    """Exact look-ups: the names of each fiftieth part, and one brand."""
    p = _t(s, d, "part")
    path = _indexed(s, p.select(_key("part", "p_partkey").alias("vid"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")), "name", "brand")
    wanted = p.filter("p_partkey % 50 = 0").select(F.lit("name").alias("field"), F.upper("p_name").alias("value")).union(s.createDataFrame([("brand", "brand#7")], "field string, value string"))
    return lookups.equal(s, path, wanted)


@_query(f"WITH {_MERGES_SQL} SELECT 'person_' || k AS vid, 'person_' || keep AS keep FROM mp")
def merges_in_batches(s, d):
    """The merges of merge_map_chain in three batches that cut its chains anywhere."""
    merges, state = materialise(_merges(s, d), "merges"), None
    for i in range(3):
        state = graph.merged_later(state, merges.filter(F.pmod(F.xxhash64("ordinal"), F.lit(3)) == i))
    return state.select("vid", "keep")


def _staged_sources(s: SparkSession, d: str) -> list[dict]:
    """Staged files of three sources: items of customers and orders, the latter also by an interface; one source is not there."""
    def staged(rows: DataFrame, name: str, line) -> str:
        path = f"{shared_dir(s)}/kithline-staged-{name}-{uuid.uuid4().hex}"
        rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", "title", "url"))).alias("a")).select(line.alias("line")).write.option("maxRecordsPerFile", 1).text(path)
        return path

    item = F.array_join(F.transform("a", lambda a: F.concat(F.lit("<item><title>"), a["title"], F.lit("</title><link>"), a["url"], F.lit("</link><description>&lt;p&gt;about "), a["title"], F.lit("&lt;/p&gt;</description></item>"))), "")
    rss = F.concat(F.lit("<rss><channel>"), item, F.lit("</channel></rss>"))
    c = _t(s, d, "customer").select(F.col("c_custkey").alias("k"), F.floor(F.col("c_custkey") / 25).alias("file"), F.concat(F.when(F.col("c_nationkey") % 2 == 0, "Navy ").otherwise("cooking "), "c_name").alias("title"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("url"))
    o = _t(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(0).alias("file"), F.concat(F.when(F.col("s_suppkey") % 3 == 0, "Navy yoga ").otherwise("Navy "), "s_name").alias("title"), F.concat(F.lit("u"), (F.col("s_suppkey") * 3).cast("string")).alias("url"))
    paths = staged(c, "rss", rss), staged(c.filter("k < 40"), "tracker", rss), staged(o, "json", F.to_json(F.struct(F.transform("a", lambda a: F.struct(a["url"].alias("url"), a["title"].alias("title"))).alias("articles"))))
    return [{"name": n, "type": t, "path": p} for n, t, p in (("daily", "rss", paths[0]), ("fleet tracker", "rss", paths[1]), ("api", "json", paths[2]), ("gone", "rss", f"{shared_dir(s)}/kithline-not-there"))]


_STAGED_SQL = """x AS (SELECT 0 AS o, 'daily' AS source, 'Navy ' || c_name AS title, 'u' || c_custkey AS url, 'about Navy ' || c_name AS content FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT 1, 'fleet tracker', CASE WHEN c_nationkey % 2 = 0 THEN 'Navy ' ELSE 'cooking ' END || c_name, 'u' || c_custkey, 'about ' || CASE WHEN c_nationkey % 2 = 0 THEN 'Navy ' ELSE 'cooking ' END || c_name FROM customer WHERE c_custkey < 40
UNION ALL SELECT 2, 'api', 'Navy ' || s_name, 'u' || s_suppkey * 3, '' FROM supplier WHERE s_suppkey % 3 <> 0)"""


@_query(f"WITH {_STAGED_SQL} SELECT source, title, url, content FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY url ORDER BY o) = 1) UNION ALL SELECT 'gone', 'FileNotFoundError', NULL, NULL")
def staged_feeds(s, d):
    """The articles of all staged sources, one for each URL, and a row for the source that is not there."""
    found, errors = feeds.read_all(s, _staged_sources(s, d))
    failed = errors.select("source", F.substring_index("error", ":", 1).alias("title"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("content"))
    return found.select("source", "title", "url", "content").unionByName(failed)


@_query(f"WITH {_STAGED_SQL} SELECT DISTINCT url FROM x WHERE source <> 'gone'")
def stream_staged_feeds(s, d):
    """The same sources as a stream into a table, which a second run adds nothing to."""
    table, sources = f"kithline_articles_{uuid.uuid4().hex}", _staged_sources(s, d)
    for _ in range(2):
        streams.new_articles(s, feeds.stream_articles(s, sources), table, f"{shared_dir(s)}/kithline-stream-{table}").awaitTermination()
    return s.table(table).select("url")
