import random

import pytest
from pyspark.sql import functions as F

from kithline.operators.scorer import EXPERIMENT, PRODUCTION, adaptive_score, compare_fields, features, l1_score, learned_score, with_name
from kithline.plans.fusion import score_pairs

MAPS = "entity_type string, name_a string, name_b string, props_a map<string,string>, props_b map<string,string>"
GOLDEN = [
    ("person", "Capt. Paul Lorence", "Paul Lorence", {"occupation": "commander", "org_name": "US Navy", "nationality": "US", "gender": "male"}, {"occupation": "commander", "org_name": "US Navy", "nationality": "US", "gender": "male"}, 1.0, "merge"),
    ("person", "Alex", "Alex", {"gender": "male"}, {"gender": "female"}, -1.0, "reject"),
    ("equipment", "X", "X", {"equip_type": "fighter", "name": "X"}, {"equip_type": "aircraft carrier ship", "name": "X"}, None, None),
    ("equipment", "X", "X", {"equip_type": "fighter", "name": "X"}, {"equip_type": "carrier", "name": "X"}, -1.0, "reject"),
    ("equipment", "USS Y", "USS Y", {"name": "USS Y", "state": "active"}, {"name": "USS Y", "state": "active"}, 1.0, "merge"),
    ("activity", "Fleet Drill", "Fleet Drill", {"event_type": "drill", "description": "fleet drill", "start_date": "2024-01-01", "location_name": "north bay"}, {"event_type": "drill", "description": "fleet drill", "start_date": "2023-02-02", "location_name": "south port"}, 0.05, "escalate"),
    ("location", "A", "B", {}, {"region": "x"}, 0.0, "escalate"),
    ("location", "A", "B", None, {"region": "x"}, 0.0, "escalate"),
    ("location", "A", "B", {"created_at": "1"}, {"created_at": "2"}, 0.0, "escalate"),
    ("location", "Oak Bay", "Oak Bay", {"region": "__NULL__"}, {"region": "x"}, 0.3, "escalate"),
]


def norm(v, p):
    if v is None:
        return ""
    s = str(v).strip()
    if p.sentinels and s in ("__NULL__", "__EMPTY__", "None"):
        return ""
    return "" if p.falsy and s.lower() in ("0", "false") else s.lower()


def jac(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b) if a and b else 0.0


def expected(kind, na, nb, a, b, p):
    """A plain version of the scorer, written from its rules."""
    if a is None or b is None or (p.empty_escalates and (not a or not b)):
        score, decision = 0.0, "escalate"
    else:
        va, vb = ({k: norm(v, p) for k, v in m.items()} for m in (a, b))
        get = lambda m, k: m.get(k, "")
        hard = kind == "person" and get(va, "gender") and get(vb, "gender") and get(va, "gender") != get(vb, "gender")
        if kind == "equipment":
            x, y = get(va, "equip_type"), get(vb, "equip_type")
            sea = ("ship", "carrier", "destroyer", "frigate", "submarine", "vessel")
            air = lambda t: any(k in t for k in p.aircraft)
            ship = lambda t: any(k in t for k in sea)
            hard = bool(x and y and x != y and ((air(x) and ship(y)) or (ship(x) and air(y))))
        near = any(get(va, k) and get(va, k) == get(vb, k) for k in p.near_perfect.get(kind, ()))
        fields = sorted(k for k in {*va, *vb} if k not in p.excluded and (get(va, k) or get(vb, k)))
        if hard:
            return -1.0, "reject"
        if near:
            score, decision = 0.95, "merge"
        elif not fields:
            score, decision = 0.0, "escalate"
        else:
            w, score = 1.0 / len(fields), 0.0
            for k in fields:
                x, y = get(va, k), get(vb, k)
                if not x or not y:
                    continue
                if x == y or x in y or y in x or (k not in p.strong and jac(x, y) >= 0.65):
                    score += w
                else:
                    score -= w * 1.5
            score = max(-1.0, min(1.0, score))
            decision = "merge" if score >= 0.6 else "reject" if score <= -0.4 else "escalate"
    if decision == "reject" and score <= -0.9:
        return score, decision
    if na and nb:
        x, y = na.lower().strip(), nb.lower().strip()
        bonus = 0.3 if x == y else 0.2 if x and y and (x in y or y in x) else 0.15 if jac(x, y) >= 0.5 else None
        if bonus:
            score = max(-1.0, min(1.0, score + bonus))
    return score, "merge" if score >= 0.6 else "reject" if score <= -0.4 else "escalate"


def test_golden(spark):
    got = score_pairs(spark.createDataFrame([g[:5] for g in GOLDEN], MAPS).coalesce(1)).collect()
    for r, g in zip(got, GOLDEN, strict=True):
        want = g[5:] if g[5] is not None else expected(*g[:5], PRODUCTION)
        assert (round(r.score, 9), r.decision) == (round(want[0], 9), want[1]), g


@pytest.mark.parametrize("profile", [PRODUCTION, EXPERIMENT], ids=["production", "experiment"])
def test_equals_plain_version(spark, profile):
    rng = random.Random(8)
    keys = ["equip_type", "category", "state", "gender", "name", "aliases", "description", "region", "odd field", "created_at", "imported_at", "designation", "id_card", "summary"]
    values = ["", None, "__NULL__", "None", "0", "False", "A", "a ", "ship carrier", "Fighter jet", "uav", "blue water navy", "blue water", "water blue deep", "\tx\n"]
    rows = []
    for _ in range(300):
        maps = [None if rng.random() < 0.03 else {k: rng.choice(values) for k in rng.sample(keys, rng.randrange(8))} for _ in "ab"]
        rows.append((rng.choice(["equipment", "person", "location", "activity"]), *(rng.choice(["", None, "Oak Bay", "oak bay ", "bay", "North Oak Bay", "Elm Bay"]) for _ in "ab"), *maps))
    # Sums near both thresholds, whose route depends on the order of the terms.
    for n, m, c in ((15, 12, 2), (20, 7, 10)):
        for seed in range(10):
            kinds = ["m"] * m + ["c"] * c + ["u"] * (n - m - c)
            random.Random(seed).shuffle(kinds)
            rows.append(("location", "", "", {f"f{i:02}": "x" for i in range(n)}, {f"f{i:02}": {"m": "x", "c": "y", "u": None}[k] for i, k in enumerate(kinds)}))
    got = score_pairs(spark.createDataFrame(rows, MAPS).coalesce(1), profile).collect()
    for r, row in zip(got, rows, strict=True):
        assert (r.score, r.decision) == expected(*row, profile), row


def test_symmetry_and_details(spark):
    df = spark.createDataFrame([g[:5] for g in GOLDEN], MAPS).coalesce(1)
    a, b, t = F.col("props_a"), F.col("props_b"), F.col("entity_type")
    out = df.select(l1_score(a, b, t).alias("x"), l1_score(b, a, t).alias("y"), with_name(l1_score(a, b, t), F.col("name_a"), F.col("name_b")).alias("z"), compare_fields(a, b).alias("f")).collect()
    assert all(r.x.score == r.y.score and r.x.decision == r.y.decision for r in out)
    assert out[5].x.detail == "fields=4 matches=2 conflicts=2 unknowns=0; description=match, event_type=match, location_name=conflict, start_date=conflict"
    assert round(out[5].x.score, 9) == -0.25


def test_features_and_learned_scores(spark):
    df = spark.createDataFrame([g[:5] for g in GOLDEN], MAPS).coalesce(1)
    m = features(F.col("props_a"), F.col("props_b"), F.col("entity_type"), F.col("name_a"), F.col("name_b"))
    got = [r[0] for r in df.select(m).collect()]
    assert got[5]["property_overlap_rate"] == 0.5 and got[5]["fld_start_date_conflict"] == 1 and got[5]["name_exact"] == 1 and got[5]["strong_conflict_rate"] == 0.5
    assert got[8]["name_similarity"] == 0 and got[8]["n_effective_fields"] == 0
    model = F.struct(F.array(F.lit("property_overlap_rate")).alias("names"), F.array(F.lit(0.5)).alias("mean"), F.array(F.lit(0.5)).alias("scale"), F.array(F.lit(4.0)).alias("weights"), F.lit(0.0).alias("intercept"), F.lit(0.9).alias("theta_merge"), F.lit(0.1).alias("theta_reject"))
    none = F.lit(None).cast("struct<names:array<string>,mean:array<double>,scale:array<double>,weights:array<double>,intercept:double,theta_merge:double,theta_reject:double>")
    out = df.select(learned_score(m, model).alias("l"), learned_score(m, none).alias("n"), adaptive_score(F.col("props_a"), F.col("props_b"), F.col("entity_type"), none, model).alias("a"), adaptive_score(F.col("props_a"), F.col("props_b"), F.col("entity_type"), none, none).alias("f")).collect()
    assert (out[0].l.score, out[0].l.decision) == (0.982, "merge") and out[0].n is None
    assert out[3].a.decision == "reject" and out[4].a.score == 0.95 and out[5].a.score == 0.5 and round(out[5].f.score, 9) == -0.25
