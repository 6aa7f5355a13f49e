"""The three-valued rule scorer, its features, and scoring with learned weights.

Everything is a Column expression, so a scored pair never leaves the JVM.  Two profiles
exist, which differ in their field lists and in what counts as missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.functions.text import contained, jaccard, let, name_similarity, normal, property_value, tokens

PENALTY, MERGE, REJECT = 1.5, 0.6, -0.4
FIELD_SIMILARITY = 0.65
NAME_EXACT, NAME_CONTAINED, NAME_ALIKE, NAME_SIMILARITY = 0.3, 0.2, 0.15, 0.5

#: Fields whose values must agree.
_STRONG = (
    "equip_type", "category", "state", "loc_type", "event_type", "org_type",
    "region", "coordinates", "start_date", "occurred_at", "end_date",
    "home_location", "latest_reported_at", "gender", "nationality", "industry",
)
_STRONG_IDS = ("designation", "hull_number", "identifier_value", "unified_credit_code", "id_card")
#: Fields that are no attributes.
_EXCLUDED = ("created_at", "updated_at", "confidence", "labels", "vid", "id", "source_pk")
#: Words in an equipment type that tell aircraft from ships.
_AIRCRAFT = ("aircraft", "plane", "helicopter", "fighter", "bomber", "drone")
_SHIP = ("ship", "carrier", "destroyer", "frigate", "submarine", "vessel")
#: Fields of which one equal value settles a merge.
_NEAR_PERFECT = {
    "equipment": ("designation", "hull_number", "name"),
    "identifier": ("value", "identifier_value"),
    "organization": ("unified_credit_code",),
    "person": ("id_card",),
}


@dataclass(frozen=True)
class Profile:
    strong: tuple[str, ...]
    excluded: tuple[str, ...]
    aircraft: tuple[str, ...]
    near_perfect: dict[str, tuple[str, ...]]
    #: Whether '__NULL__' and the like count as missing.
    sentinels: bool
    #: Whether '0' and 'False' count as missing.
    falsy: bool
    #: Whether an empty map cannot be scored; a null map never can.
    empty_escalates: bool
    extra_features: bool


EXPERIMENT = Profile(_STRONG, _EXCLUDED, _AIRCRAFT, {}, False, True, False, False)
PRODUCTION = Profile(_STRONG + _STRONG_IDS, (*_EXCLUDED, "imported_at"), (*_AIRCRAFT, "uav"), _NEAR_PERFECT, True, False, True, True)


def normalised(props: Column, p: Profile = PRODUCTION) -> Column:
    """The map of comparable values: without excluded fields and missing values."""
    if p.falsy:
        clean = lambda v: F.when(property_value(v, p.sentinels).isin("0", "false"), F.lit("")).otherwise(property_value(v, p.sentinels))
    else:
        clean = lambda v: property_value(v, p.sentinels)
    return F.map_filter(F.transform_values(props, lambda k, v: clean(v)), lambda k, v: (v != "") & ~k.isin(*p.excluded))


def _at(values: Column, key: Column | str) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(key) if isinstance(key, str) else key), F.lit(""))


def _both(a: Column, b: Column, p: Profile, values: tuple[Column, Column] | None) -> tuple[Column, Column]:
    return values if values is not None else (normalised(a, p), normalised(b, p))


def effective_fields(a: Column, b: Column, p: Profile = PRODUCTION, values: tuple[Column, Column] | None = None) -> Column:
    """Sorted names of fields with a value on either side."""
    x, y = _both(a, b, p, values)
    return F.array_sort(F.array_union(F.map_keys(x), F.map_keys(y)))


def _compared(k: Column, x: Column, y: Column, p: Profile) -> Column:
    alike = let(F.struct(tokens(x).alias("x"), tokens(y).alias("y")), lambda t: jaccard(t["x"], t["y"]))
    result = (F.when((x == "") | (y == ""), "unknown").when(x == y, "match").when(F.contains(x, y) | F.contains(y, x), "match")
              .when(k.isin(*p.strong), "conflict").when(alike >= FIELD_SIMILARITY, "match").otherwise("conflict"))
    return F.struct(k.alias("field"), result.alias("result"))


def compare_fields(a: Column, b: Column, p: Profile = PRODUCTION, values: tuple[Column, Column] | None = None) -> Column:
    """(field, result) of each effective field; result: match, conflict or unknown.

    values: the normalised maps, if they are columns already; so in the other functions.
    """
    x, y = _both(a, b, p, values)
    each = F.transform(effective_fields(a, b, p, (x, y)), lambda k: F.struct(k.alias("k"), _at(x, k).alias("x"), _at(y, k).alias("y")))
    return F.transform(each, lambda f: _compared(f["k"], f["x"], f["y"], p))


def hard_conflict(a: Column, b: Column, entity_type: Column, p: Profile = PRODUCTION, values: tuple[Column, Column] | None = None) -> Column:
    ga, gb, ea, eb = (_at(m, k) for k in ("gender", "equip_type") for m in _both(a, b, p, values))
    air, sea = "|".join(p.aircraft), "|".join(_SHIP)
    crossed = (ea.rlike(air) & eb.rlike(sea)) | (ea.rlike(sea) & eb.rlike(air))
    return ((entity_type == "person") & (ga != "") & (gb != "") & (ga != gb)) | ((entity_type == "equipment") & (ea != "") & (eb != "") & (ea != eb) & crossed)


def near_perfect(a: Column, b: Column, entity_type: Column, p: Profile = PRODUCTION, values: tuple[Column, Column] | None = None) -> Column:
    out = F.lit(False)
    x, y = _both(a, b, p, values)
    for kind, fields in p.near_perfect.items():
        for f in fields:
            out = out | ((entity_type == kind) & (_at(x, f) != "") & (_at(x, f) == _at(y, f)))
    return out


def route(score: Column, merge: float = MERGE, reject: float = REJECT) -> Column:
    return F.when(score >= merge, "merge").when(score <= reject, "reject").otherwise("escalate")


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def _result(score: Column, decision: Column | str, detail: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, (str, float)) else x
    return F.struct(lit(score).alias("score"), lit(decision).alias("decision"), lit(detail).alias("detail"))


def l1_score(a: Column, b: Column, entity_type: Column, p: Profile = PRODUCTION, penalty: float = PENALTY, merge: float = MERGE, reject: float = REJECT, compared: Column | None = None, values: tuple[Column, Column] | None = None) -> Column:
    """struct(score, decision, detail) from properties alone.

    The terms are added one by one in the order of field names: two sums near the
    thresholds depend on that order.  compared: the pair's compare_fields, if it is a column.
    """
    fields = compare_fields(a, b, p, values) if compared is None else compared
    weight = F.lit(1.0) / F.size(fields)
    step = lambda c: F.when(c["result"] == "match", weight).when(c["result"] == "conflict", -(weight * penalty)).otherwise(F.lit(0.0))
    score = _clamped(F.aggregate(fields, F.lit(0.0), lambda s, c: s + step(c)))
    n = lambda r: F.size(F.filter(fields, lambda c: c["result"] == r)).cast("string")
    detail = F.concat(F.lit("fields="), F.size(fields).cast("string"), F.lit(" matches="), n("match"), F.lit(" conflicts="), n("conflict"), F.lit(" unknowns="), n("unknown"), F.lit("; "),
                      F.array_join(F.transform(fields, lambda c: F.concat_ws("=", c["field"], c["result"])), ", "))
    missing = a.isNull() | b.isNull()
    if p.empty_escalates:
        missing = missing | (F.size(a) == 0) | (F.size(b) == 0)
    return (F.when(missing, _result(0.0, "escalate", "missing properties"))
            .when(hard_conflict(a, b, entity_type, p, values), _result(-1.0, "reject", "hard conflict"))
            .when(near_perfect(a, b, entity_type, p, values), _result(0.95, "merge", "near-perfect identifier match"))
            .when(F.size(fields) == 0, _result(0.0, "escalate", "no effective fields"))
            .otherwise(_result(score, route(score, merge, reject), detail)))


def name_bonus(name_a: Column, name_b: Column) -> Column:
    a, b = normal(name_a), normal(name_b)
    given = F.coalesce(name_a != "", F.lit(False)) & F.coalesce(name_b != "", F.lit(False))
    return (F.when(~given, F.lit(0.0)).when(a == b, F.lit(NAME_EXACT)).when(contained(a, b), F.lit(NAME_CONTAINED))
            .when(name_similarity(a, b) >= NAME_SIMILARITY, F.lit(NAME_ALIKE)).otherwise(F.lit(0.0)))


def with_name(base: Column, name_a: Column, name_b: Column, merge: float = MERGE, reject: float = REJECT) -> Column:
    """A score with the names' bonus, routed anew; a hard conflict stays as it is."""
    score = _clamped(base["score"] + name_bonus(name_a, name_b))
    settled = (base["decision"] == "reject") & (base["score"] <= -0.9)
    return F.when(settled, base).otherwise(_result(score, route(score, merge, reject), base["detail"]))


def features(a: Column, b: Column, entity_type: Column, name_a: Column, name_b: Column, p: Profile = PRODUCTION, compared: Column | None = None, values: tuple[Column, Column] | None = None) -> Column:
    """A map of a pair's features for the learned scorers."""
    va, vb = _both(a, b, p, values)
    fields = compare_fields(a, b, p, (va, vb)) if compared is None else compared
    strong = lambda c: c["field"].isin(*p.strong)
    count = lambda test: F.size(F.filter(fields, test)).cast("double")
    share = lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    is_ = lambda r: lambda c: c["result"] == r
    n, ns = F.size(fields).cast("double"), count(strong)
    nw = n - ns
    na = F.when(F.coalesce(name_a, F.lit("")) != "", name_a).otherwise(_at(va, "name"))
    nb = F.when(F.coalesce(name_b, F.lit("")) != "", name_b).otherwise(_at(vb, "name"))
    x, y = normal(na), normal(nb)
    one = {"property_overlap_rate": share(count(is_("match")), n), "property_conflict_rate": share(count(is_("conflict")), n), "n_effective_fields": n,
           "name_similarity": name_similarity(na, nb), "name_exact": ((x != "") & (x == y)).cast("double"), "name_containment": contained(na, nb).cast("double")}
    if p.extra_features:
        one |= {"n_strong_fields": ns, "n_weak_fields": nw,
                "strong_overlap_rate": share(count(lambda c: strong(c) & (c["result"] == "match")), ns), "weak_overlap_rate": share(count(lambda c: ~strong(c) & (c["result"] == "match")), nw),
                "strong_conflict_rate": share(count(lambda c: strong(c) & (c["result"] == "conflict")), ns), "weak_conflict_rate": share(count(lambda c: ~strong(c) & (c["result"] == "conflict")), nw),
                "hard_conflict": hard_conflict(a, b, entity_type, p, (va, vb)).cast("double"), "near_perfect_match": near_perfect(a, b, entity_type, p, (va, vb)).cast("double")}
    each = F.map_from_entries(F.flatten(F.transform(fields, lambda c: F.array(*(F.struct(F.concat(F.lit("fld_"), c["field"], F.lit(f"_{r}")), (c["result"] == r).cast("double")) for r in ("match", "conflict"))))))
    # Without any field nothing is known of the pair, not even its names.
    flat = F.create_map(*(z for k, v in one.items() for z in (F.lit(k), F.when(n > 0, v).otherwise(F.lit(0.0)))))
    return F.map_concat(flat, each)


def learned_score(feature_map: Column, model: Column) -> Column:
    """struct(score, decision) by a logistic model, null without one.

    model: struct(names, mean, scale, weights, intercept, theta_merge, theta_reject).
    """
    at = F.transform(model["names"], lambda k: F.coalesce(F.try_element_at(feature_map, k), F.lit(0.0)))
    z = F.zip_with(F.zip_with(at, model["mean"], lambda x, m: x - m), model["scale"], lambda x, s: F.when(s == 0, F.lit(0.0)).otherwise(x / s))
    logit = F.aggregate(F.zip_with(z, model["weights"], lambda x, w: x * w), model["intercept"], lambda s, x: s + x)
    prob = 1 / (1 + F.exp(-logit))
    decision = F.when(prob >= model["theta_merge"], "merge").when(prob <= model["theta_reject"], "reject").otherwise("escalate")
    return F.when(model.isNotNull(), F.struct(F.round(prob, 4).alias("score"), decision.alias("decision"), F.lit("learned").alias("detail")))


def adaptive_score(a: Column, b: Column, entity_type: Column, typed_model: Column, common_model: Column, p: Profile = PRODUCTION) -> Column:
    """Rules that settle a pair first, then the type's model, the common model, and the fixed scorer; names play no part."""
    fixed = l1_score(a, b, entity_type, p)
    rules = F.when(fixed["detail"].isin("missing properties", "hard conflict", "near-perfect identifier match"), fixed)
    values = features(a, b, entity_type, F.lit(""), F.lit(""), p)
    return F.coalesce(rules, learned_score(values, typed_model), learned_score(values, common_model), fixed)


def adaptive(pairs: DataFrame, typed_model: Column | None = None, common_model: Column | None = None, p: Profile = PRODUCTION) -> DataFrame:
    """The pairs with s, the adaptive_score of props_a and props_b, made in steps.

    Each step is a column of its own, so no value is made twice and plans stay small.
    pairs: entity_type, props_a, props_b and others; models: see learned_score, None for none.
    """
    kind, a, b = F.col("entity_type"), F.col("props_a"), F.col("props_b")
    x, y = F.col("_x"), F.col("_y")
    out = pairs.withColumn("_x", normalised(a, p)).withColumn("_y", normalised(b, p))
    out = out.withColumn("_fields", compare_fields(a, b, p, (x, y)))
    out = out.withColumn("_fixed", l1_score(a, b, kind, p, compared=F.col("_fields"), values=(x, y)))
    ruled = F.col("_fixed.detail").isin("missing properties", "hard conflict", "near-perfect identifier match")
    steps = [F.when(ruled, F.col("_fixed"))]
    if typed_model is not None or common_model is not None:
        out = out.withColumn("_features", features(a, b, kind, F.lit(""), F.lit(""), p, F.col("_fields"), (x, y)))
        steps += [learned_score(F.col("_features"), m) for m in (typed_model, common_model) if m is not None]
    return out.withColumn("s", F.coalesce(*steps, F.col("_fixed"))).select(*pairs.columns, "s")


#: The candidate's properties that a new entity is compared with, by type.
CANDIDATE_FIELDS = {
    "equipment": ("name", "equip_type", "category", "state", "aliases"),
    "person": ("name", "occupation", "org_name", "nationality", "gender", "aliases"),
    "location": ("name", "loc_type", "region", "coordinates", "aliases"),
    "organization": ("name", "org_type", "region", "industry", "aliases"),
    "activity": ("name", "event_type", "start_date", "end_date", "location_name", "aliases"),
}


def candidate_properties(props: Column, entity_type: Column) -> Column:
    fields = F.create_map(*(x for k, v in CANDIDATE_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = F.coalesce(F.try_element_at(fields, entity_type), F.array().cast("array<string>"))
    return F.map_filter(props, lambda k, v: F.array_contains(own, k))


__all__ = ["EXPERIMENT", "PRODUCTION", "adaptive", "adaptive_score", "candidate_properties", "compare_fields", "effective_fields", "features", "hard_conflict", "l1_score", "learned_score", "name_bonus", "near_perfect", "normalised", "route", "with_name"]
