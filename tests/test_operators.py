import random

import pytest
from pyspark.sql import functions as F

from kithline.functions import replies, text
from kithline.operators import blocking, crosslingual, evaluation, graph, learning, listing, mutations
from kithline.plans import fusion

ENTITY = "entity_type string, vid string, name string, aliases array<string>, props map<string,string>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    cases = [
        (text.parse_aliases(F.lit("{a, 'b' ,\"c\"}")), ["a", "b", "c"]), (text.parse_aliases(F.lit("x|| y ||")), ["x", "y"]), (text.parse_aliases(F.lit('["p","q"]')), ["p", "q"]),
        (text.parse_aliases(F.lit(" plain ")), ["plain"]), (text.parse_aliases(F.lit(None).cast("string")), []), (text.parse_aliases(F.lit("{}")), []), (text.parse_aliases(F.lit("a||b"), bars=False), ["a||b"]),
        (text.coordinates(F.lit("1.5, -2")), (1.5, -2.0)), (text.coordinates(F.lit("1.5")), None), (text.coordinates(F.lit("x,y")), None),
        (text.vid_type(F.lit("event_12")), "activity"), (text.vid_type(F.lit("record_1")), "unknown"), (text.vid_number(F.lit("loc_42")), 42), (text.vid_number(F.lit("loc_x")), None),
        (text.contained(F.lit(""), F.lit("a")), False), (text.contained(F.lit("Oak"), F.lit("oak bay")), True), (text.normal(F.lit("  X\t")), "x"),
        (text.tokens(F.lit("a b  a")), ["a", "b"]), (text.fold_name(F.lit("A_b-(c)")), "a b c "), (text.uri_tokens(F.lit("http://x/A%20b_c-_d")), ["a", "b", "c", "", "d"]),
        (text.ratio(F.lit(0), F.lit(3)), 0.0), (text.years_close(F.lit("2020-01"), F.lit("2021")), True), (text.years_close(F.lit(""), F.lit("2021")), False),
        (text.mentions(F.lit("Ab"), F.lit("xx ab yy AB"), 1, 2), ["ab y", "AB"]), (text.mentions(F.lit("q"), F.lit("xx")), []), (text.sentences(F.lit("a。b！\nc")), ["a", "b", "c"]),
        (text.first_sentence_with(F.lit("b"), F.lit("a. b c. d")), "b c"), (text.first_sentence_with(F.lit("q"), F.lit("a. b")), "a. b"),
        (text.plain_text(F.lit("<p>a<br>b</p><script>x</script><!-- y --> c")), "a b c"), (text.containment_score(F.lit("ab"), F.lit("abcd")), 0.55),
        (text.any_word(F.lit("the NAVY came"), text.KEYWORDS), True), (text.any_word(F.lit("navyx"), text.KEYWORDS), False),
        (replies.verdict(F.lit("```\nSame, because")), "same"), (replies.verdict(F.lit("they are not the same")), "different"), (replies.verdict(F.lit("hm")), "unknown"), (replies.match_reply(F.lit("MATCH")), 1), (replies.match_reply(F.lit("Different, no match")), 0),
        (replies.status_label(F.lit("merged")), 1), (replies.status_label(F.lit("pending")), None), (replies.verdict_label(F.lit("different")), 0),
        (text.days_since(F.lit("bad"), F.current_timestamp()), float("inf")),
    ]
    got = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    for i, (_, want) in enumerate(cases):
        v = got[f"c{i}"]
        assert (tuple(v) if isinstance(want, tuple) else pytest.approx(v) if isinstance(v, float) else v) == want, (i, v, want)


def test_replies(spark):
    vids = F.array(F.lit("loc_1"))
    ok = one(spark, replies.judge_reply(F.lit('<think>no</think>```json\n{"match_vid":"loc_1","confidence":0.9,"reason":"r"}```'), vids))
    inner = one(spark, replies.judge_reply(F.lit('I say {"match_vid":"loc_2","confidence":0.4,"reason":"r"} so'), vids))
    bad = one(spark, replies.judge_reply(F.lit("nothing"), vids))
    assert tuple(ok) == ("loc_1", 0.9, "r") and tuple(inner) == (None, 0.4, "r") and bad.reason == "parse_fail"
    props = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"), F.lit("vid"), F.lit("x"), F.lit("c"), F.lit(" "))
    assert one(spark, replies.format_attributes(props)) == "a: 1\nb: 2"
    prompt = one(spark, replies.pair_prompt(F.lit("person"), F.lit("N1"), F.lit("N2"), props, props, F.array(F.lit("short"), F.lit("longer one")), F.array().cast("array<string>")))
    assert "Entity A: N1" in prompt and prompt.index("longer one") < prompt.index("short")


def _entities(spark, n=80, seed=1):
    rng = random.Random(seed)
    words = ["oak", "bay", "ford", "oxford", "us", "navy", "station", "the", "persian", "gulf", "arabian", "scs", "south", "china", "sea", "of", ""]
    rows = [(rng.choice(["location", "equipment"]), f"loc_{i:03}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))).strip(), [rng.choice(words) for _ in range(rng.randrange(3))], {"region": rng.choice("ab"), "loc_type": "x"}) for i in range(n)]
    return spark.createDataFrame(rows, ENTITY)


def test_blocking_equals_all_pairs(spark):
    e = _entities(spark)
    want = {tuple(r) for r in blocking.all_related(e).collect()}
    assert want and {tuple(r) for r in blocking.blocked_pairs(e).select("entity_type", "vid_a", "vid_b").collect()} == want
    assert {tuple(r) for r in blocking.token_pairs(e).collect()} <= want
    assert blocking.token_pairs(e, max_key_size=2).count() < blocking.token_pairs(e).count()


def test_fusion(spark):
    e = _entities(spark, 40)
    alone = fusion.fuse(e)
    assert {r.status for r in alone.collect()} <= {"merged", "pending"}
    pending = alone.filter("status = 'pending'").orderBy("pair_id")
    assert not pending.isEmpty()
    answers = pending.select("pair_id", F.lit("merge").alias("action"), F.lit("nobody").alias("keep_vid"), F.lit("r").alias("reason")).limit(1)
    judged = fusion.fuse(e, fusion.verdict_table(answers))
    assert judged.filter("status = 'merged'").count() == alone.filter("status = 'merged'").count() + 1
    done = fusion.execute(alone, fusion.verdict_table(answers))
    assert done.count() == pending.count() and done.filter("status = 'disambig'").count() == pending.count() - 1
    first = pending.first().pair_id
    assert fusion.resolve_by_hand(alone, first, "keep", "me").first().status == "disambig"


def test_resolution(spark):
    known = spark.createDataFrame([("equipment", "equip_1", "USS A", "A1||AA", {"name": "USS A"}), ("person", "person_1", "Jo", "", {"name": "Jo"}), ("person", "equip_9", "Jo", "", {})], "entity_type string, vid string, name string, aliases string, props map<string,string>")
    new = spark.createDataFrame([("equipment", "USS A", None, {"name": "USS A"}), ("equipment", "USS A", None, {}), ("person", "Jo", None, {"rank": "x"}), ("person", "New", None, {"rank": "x"})], "entity_type string, name string, designation string, props map<string,string>")
    got = {(r.entity_type, r.name): (r.vid, r.route) for r in fusion.resolve_new(new, known).collect()}
    assert got[("equipment", "USS A")] in {("equip_1", "merge"), (None, "new")} and got[("person", "Jo")] == (None, "new") and got[("person", "New")] == (None, "new")
    verdicts = spark.createDataFrame([("person", "Jo", None, 0.2, "unclear")], "entity_type string, name string, match_vid string, confidence double, reason string")
    assert {r.name: r.route for r in fusion.resolve_new(new, known, verdicts).collect()}["Jo"] == "uncertain"
    wanted = spark.createDataFrame([("equipment", "AA"), ("equipment", "USS A"), ("person", "No")], "entity_type string, name string")
    local = spark.createDataFrame([("equipment", "USS A", "equip_7")], "entity_type string, name string, vid string")
    assert {r.name: r.vid for r in fusion.resolve_names(wanted, local, known).collect()} == {"AA": "equip_1", "USS A": "equip_7", "No": None}


EDGE = "src string, dst string, type string, sub_type string, confidence double, source string, created_at string"


def _graph(spark):
    v = spark.createDataFrame([(f"v{i}", f"n{i}", [f"a{i}"]) for i in range(8)] + [("r1", "r", []), ("r2", "r", [])], "vid string, name string, aliases array<string>")
    e = [("v0", "v1", "social"), ("v1", "v2", "social"), ("v3", "v0", "locate"), ("v4", "v1", "locate"), ("v2", "v5", "use_edge"), ("r1", "v0", "trace"), ("r1", "v6", "trace"), ("r2", "v0", "trace")]
    return v, spark.createDataFrame([(a, b, t, "", 0.9, "s", "") for a, b, t in e], EDGE)


def test_graph(spark):
    v, e = _graph(spark)
    assert {r.vid for r in graph.supported_only_by(e, F.col("src") == "r1").collect()} == {"v6"} and {r.vid for r in graph.shared_with_others(e, F.col("src") == "r1").collect()} == {"v0"}
    kept, edges = graph.retract(v, e, "r1")
    assert v.count() - kept.count() == 2 and {(r.src, r.dst) for r in edges.filter("type = 'trace'").collect()} == {("r2", "v0")}
    merges = spark.createDataFrame([("v2", "v1"), ("v1", "v0"), ("v4", "v5")], "vid_a string, vid_b string")
    mv, me = graph.merge_vertices(v, e, merges)
    names = {r.vid: r.aliases for r in mv.collect()}
    # v2 is kept by the first decision and removed by none.
    assert names["v2"] == ["a0", "a1", "a2", "n0", "n1"] and not {"v0", "v1", "v5"} & set(names)
    assert {(r.src, r.dst, r.type) for r in me.collect()} == {("v3", "v2", "locate"), ("v4", "v2", "locate"), ("v2", "v4", "use_edge"), ("r1", "v2", "trace"), ("r1", "v6", "trace"), ("r2", "v2", "trace")}
    again = graph.merge_vertices(mv, me, merges.limit(0).unionByName(spark.createDataFrame([("v2", "v2")], "vid_a string, vid_b string")))
    assert {(r.src, r.dst, r.type) for r in again[1].collect()} == {(r.src, r.dst, r.type) for r in me.collect()}
    ids = {r.vid for r in mv.collect()}
    assert all(r.src in ids and r.dst in ids and r.src != r.dst for r in me.collect())
    near = {(r.direction, r.neighbour, r.neighbour_name) for r in graph.one_hop(v.filter("vid = 'v0'").select("vid"), e, v).collect()}
    assert near == {("out", "v1", "n1"), ("in", "v3", "n3"), ("in", "r1", "r"), ("in", "r2", "r")}
    assert {r.vid: r.n_paths for r in graph.two_hop_counts(e).collect()} == {"v0": 1, "v1": 1, "v3": 1, "v4": 1, "r1": 1, "r2": 1}
    assert graph.related_context(v.filter("vid = 'v0'").select("vid"), e, v).first().related == ["n3", "n1"]
    assert graph.delete_vertices(v, e, v.filter("vid = 'v0'").select("vid"))[1].filter("src = 'v0' or dst = 'v0'").isEmpty()


def test_long_chain_of_merges(spark):
    n = 40
    merges = spark.createDataFrame([(f"k{i:03}", f"k{i + 1:03}") for i in range(n)], "vid_a string, vid_b string")
    assert {r.keep for r in graph.merge_map(merges).collect()} == {"k000"}


def test_decisions_say_which_vertex_stays(spark):
    schema = "vid_a string, vid_b string, keep_vid string, ordinal int"
    rows = [("equip_9", "equip_10", "equip_9", 1), ("equip_20", "equip_21", "nobody", 1), ("equip_30", "equip_31", "equip_31", 1), ("equip_31", "equip_32", "equip_32", 2), ("equip_40", "equip_41", "equip_40", 1), ("equip_42", "equip_41", "equip_42", 2)]
    keep = {r.vid: r.keep for r in graph.merge_map(spark.createDataFrame(rows, schema)).collect()}
    assert keep == {"equip_9": "equip_9", "equip_10": "equip_9", "equip_20": "equip_20", "equip_21": "equip_20", "equip_30": "equip_32", "equip_31": "equip_32", "equip_32": "equip_32",
                    "equip_40": "equip_42", "equip_41": "equip_42", "equip_42": "equip_42"}
    edges = [("equip_9", "equip_10", "spatial"), ("equip_50", "equip_50", "social"), ("equip_9", "equip_9", "social"), ("r", "equip_10", "trace"), ("r", "equip_9", "trace")]
    e = spark.createDataFrame([(a, b, t, "generate", 0.9, "article", "t") for a, b, t in edges], EDGE)
    got = {tuple(r)[:6] for r in graph.rewire(e, graph.merge_map(spark.createDataFrame(rows, schema))).collect()}
    assert got == {("equip_50", "equip_50", "social", "generate", 0.9, "article"), ("equip_9", "equip_9", "social", "generate", 0.9, "article"), ("r", "equip_9", "trace", "merge", 1.0, "fusion_merge")}


def test_relations(spark):
    rows = [("ship", "A", "use", "location", "A"), ("base", "A", "locate", "location", "A"), ("person", "B", "", "person", "C"), ("person", "B", "involves", "person", "C"), (None, "B", "likes", "x", "B"), ("aircraft", "P", "based_at", "base", "Q")]
    r = graph.usable_relations(spark.createDataFrame(rows, "subject_type string, subject_name string, relation string, object_type string, object_name string"))
    got = [(x.subject_type, x.relation, x.object_type, x.placed) for x in r.withColumn("placed", graph.places_equipment()).collect()]
    assert got == [("equipment", "use", "location", False), ("", "likes", "x", False), ("equipment", "based_at", "location", True)]
    assert one(spark, graph.edge_type(F.lit(" USE_edge "))) == "use_edge" and one(spark, graph.edge_type(F.lit("other"))) == "social"


def test_metrics(spark):
    rows = [("merge", 1)] * 368 + [("merge", 0)] * 76 + [("reject", 0)] * 425 + [("reject", 1)] * 131 + [("escalate", 1)] * 1591
    r = evaluation.accuracy_report(spark.createDataFrame(rows, "decision string, label int")).first()
    assert (r.accuracy_pct, r.interception_pct, r.merge_precision_pct, r.reject_precision_pct) == (79.3, 38.6, 82.9, 76.4)
    p = [(i, 1, 1) for i in range(793)] + [(i + 793, 1, 0) for i in range(207)] + [(i + 1000, 1, -1) for i in range(1591)]
    v = [(i + 1000, "same" if i < 1430 else "different" if i < 1558 else "unknown") for i in range(1591)]
    c = evaluation.cascade_report(spark.createDataFrame(p, "pair_id int, label int, prediction int"), spark.createDataFrame(v, "pair_id int, verdict string")).first()
    assert (c.strict_pct, c.resolved_pct, c.unresolved) == (85.797, 86.904, 33)
    empty = spark.createDataFrame([], "decision string, label int")
    assert evaluation.accuracy_report(empty).first().accuracy_pct == 0 and evaluation.decision_distribution(empty).count() == 0
    k = evaluation.agreement(spark.createDataFrame([(1, 1)] * 20 + [(1, 0)] * 5 + [(0, 1)] * 10 + [(0, 0)] * 15, "a int, b int")).first()
    assert (k.agreement_pct, k.kappa) == (70.0, 0.4)
    assert evaluation.steps(0.5, 0.96, 0.05)[2] == 0.5 + 2 * 0.05 and len(evaluation.steps(0.05, 0.46, 0.05)) == 9
    th = evaluation.routed(F.col("p"), F.lit(0.4), F.lit(0.5))
    assert [x[0] for x in spark.createDataFrame([(0.45,), (0.6,), (0.3,)], "p double").select(th).collect()] == [0, 1, 0]


def test_learning(spark):
    rng = random.Random(9)
    rows = []
    for i in range(200):
        y = rng.random() < 0.4
        rows.append((f"p{i}", int(y), "person" if i % 2 else "location", {"x": rng.gauss(2.0 if y else 0.0, 1.0), "y": rng.gauss(0, 1), "const": 3.0} | ({"rare": 1.0} if y and i % 5 == 0 else {})))
    df = spark.createDataFrame(rows, "pair_id string, label int, entity_type string, features map<string,double>")
    assert learning.feature_names(df) == ["const", "rare", "x", "y"]
    s = learning.train_scorer(df)
    assert s is not None and s.metrics["accuracy"] >= 0.75 and s.strongest(1)[0][0] == "x" and s.weights[0] == 0
    # The coefficients minimise half the squared weights plus the balanced losses.
    import numpy as np

    scaled, mean, scale = learning.standardise(learning.matrix(df, s.names), 4)
    rows = scaled.select("z", "label").collect()
    z, y = np.array([r.z for r in rows]), np.array([r.label for r in rows])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    p = 1 / (1 + np.exp(-(z @ np.array(s.weights) + s.intercept)))
    assert np.abs(z.T @ (w * (p - y)) + np.array(s.weights)).max() < 1e-3 and abs((w * (p - y)).sum()) < 1e-3
    assert learning.train_scorer(df.limit(10)) is None and learning.train_scorer(df.filter("label = 1")) is None
    assert set(learning.train_by_type(df)) <= {"person", "location"}
    from kithline.operators.scorer import learned_score

    got = df.select(learned_score(F.col("features"), s.column()).alias("s"), "label").select("s.*", "label").collect()
    assert sum((r.score >= 0.5) == (r.label == 1) for r in got) > 150
    assert learning.must_retrain(50, 60, 0) and learning.must_retrain(0, 60, 8) and not learning.must_retrain(50, 40, 9, force=True) and not learning.must_retrain(10, 60, 1)


def test_feedback(spark):
    rows = [(i, s, n, w) for i, (s, n, w) in enumerate([("merged", "manual merge", None), ("disambig", "llm", "me"), ("merged", "llm", None), ("discarded", "manual", "me"), ("pending", "manual", "me")])]
    d = spark.createDataFrame(rows, "id int, status string, notes string, resolved_by string")
    assert [(r.id, r.label) for r in learning.feedback_pairs(d, -1).collect()] == [(0, 1), (1, 0)]


def test_listing_and_mutations(spark):
    t = spark.createDataFrame([("equip_1", "USS A", "x", "", ""), ("equip_7", "B", "", "old", "")], "vid string, name string, category string, state string, aliases string")
    items = spark.createDataFrame([(0, "B", "", "new", ""), (1, "B", "", "", "cat"), (2, "C", "D-1", "s", "c"), (3, "C", "D-1", "s", "c")], "ordinal int, name string, designation string, state string, category string")
    out = {r.name: (r.vid, r.state, r.category) for r in mutations.upsert_equipment(t, items).collect()}
    assert out == {"USS A": ("equip_1", "", "x"), "B": ("equip_7", "new", "cat"), "D-1": ("equip_8", "s", "c")}
    log = spark.createDataFrame([(1, 0, "pending")], "id int, seq long, status string")
    more = mutations.append_decision(log, spark.createDataFrame([(1, "merged"), (2, "pending")], "id int, status string"))
    assert {r.id: r.status for r in listing.latest_status(more).collect()} == {1: "merged", 2: "pending"}
    pos = spark.createDataFrame([(0, "B", "", 1.0, 2.0, "2024-02-01"), (1, "B", "", 3.0, 4.0, "2024-01-01")], "ordinal int, name string, designation string, lat double, lng double, reported_at string")
    hist, eq = mutations.import_positions(t, spark.createDataFrame([], "vid string, lat double, lng double, reported_at string"), pos)
    assert hist.count() == 2 and {r.vid: r.coordinates for r in eq.collect()}["equip_7"] == "3.0,4.0"
    arts = spark.createDataFrame([("u1", "<p>x</p>"), ("u1", "y"), ("u2", "z" * 20), (None, "n")], "url string, content string")
    got = mutations.import_articles(arts.filter("url = 'u3'"), arts, 10)
    assert {r.url: len(r.content) for r in got.collect()}["u2"] == 10 and got.count() == 2
    assert mutations.remaining(log.withColumnRenamed("id", "pair_id"), spark.createDataFrame([(1,)], "pair_id int")).isEmpty()
    ids = [r.vid for r in listing.next_ids(spark.range(200).select(F.col("id").cast("string").alias("name")), t, "equip", "name").collect()]
    assert sorted(int(x[6:]) for x in ids) == list(range(8, 208))
    assert listing.global_search([("equipment", t)], "u").isEmpty() and listing.global_search([("equipment", t)], "us").count() == 1
    old = spark.createDataFrame([(1, "a")], "id int, name string")
    assert mutations.legacy_vertices({"ship": (old, "id", "equipment")}).first().vid == "ship_1"
    now = F.lit("t")
    rel = spark.createDataFrame([("equip_1", "loc_1", "use", "", 5), ("equip_1", "loc_1", "odd", "s", 5)], "src string, dst string, relation string, sub_type string, source int")
    assert {(r.type, r.sub_type) for r in mutations.new_edges(rel, now).collect()} == {("use_edge", "use"), ("social", "s")}
    assert mutations.article_records(spark.createDataFrame([(3, "t")], "id int, title string"), now).first().vid == "record_article_3"
    rec, tr = mutations.import_records(t.select("vid"), now)
    assert rec.count() == tr.count() == 2 and tr.first().confidence == 1.0
    k = mutations.new_vertices(spark.createDataFrame([("equip_1", "q"), ("equip_3", "r")], "vid string, name string"), t).collect()
    assert [(r.vid, r.state) for r in k] == [("equip_3", "")]


def test_crosslingual(spark):
    schema = ", ".join(f"uri_{s} string, label_{s} string, attributes_{s} array<string>, degree_{s} int" for s in "ab")
    rows = [("z/Oak_%20bay", "Oak (Bay)", ["p/A", "p/b"], 4, "e/Oak_bay", "oak bay", ["q/a"], 2), ("z/x", "", [], 9, "e/y", "", [], 0)]
    r = crosslingual.signals(spark.createDataFrame(rows, schema)).collect()
    assert r[0].attr_overlap == 0.5 and r[0].degree_similarity == 0.5 and r[0].uri_similarity == pytest.approx(2 / 3) and r[0].name_similarity == 1.0
    assert r[1].l1_score == 0
    f = crosslingual.features(spark.createDataFrame(rows, schema)).first()
    assert f.attr_overlap == 0 and f.shared_attr_ratio == 0 and f.attr_count_diff == 1 and f.degree_diff == 2
    side = lambda p: spark.createDataFrame([(f"{p}{i}", f"Oak {i}" if i % 2 else f"Elm {i}") for i in range(40)], "uri string, label string")
    gold = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(40)], "uri_a string, uri_b string")
    neg = crosslingual.negatives(side("a"), side("b"), gold).collect()
    assert neg and all(int(n.uri_a[1:]) % 2 == int(n.uri_b[1:]) % 2 and n.uri_a[1:] != n.uri_b[1:] for n in neg)


def test_long_chains_of_merges_end_in_one_vertex(spark):
    from kithline.operators.graph import merge_map

    chain = [0, *range(60, 0, -1)]
    merges = [(f"a{x:03}", f"a{y:03}") for x, y in zip(chain, chain[1:])]
    shuffled = random.Random(3).sample(range(120), 120)
    merges += [(f"b{x:03}", f"b{y:03}") for x, y in zip(shuffled, shuffled[1:])] + [("c1", "c1")]
    found = {r.vid: r.keep for r in merge_map(spark.createDataFrame(merges, "vid_a string, vid_b string")).collect()}
    # The vertices of a chain end in one; which one, its decisions say.
    assert len(found) == 182 and all(len({found[v] for v in found if v[0] == x}) == 1 for x in "abc") and found["a000"] == "a000" and found["b000"] == f"b{shuffled[0]:03}"
