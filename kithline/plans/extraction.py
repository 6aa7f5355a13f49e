"""What is saved of extraction results: entities, provenance, relations, positions, and pairs for people to decide."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.functions.text import coordinates, vid_number
from kithline.operators.graph import places_equipment, usable_relations
from kithline.operators.listing import next_ids
from kithline.operators.mutations import article_records, new_edges, trace_edges
from kithline.plans.fusion import resolve_names, resolve_new
from kithline.scratch import materialise

_ENTITY = "name:string,aliases:array<string>"
#: The schema of an extraction result, with the article it belongs to.
RESULT = f"""
article_id long,
equipment array<struct<{_ENTITY},designation:string,equipment_type:string,category:string,status:string>>,
persons array<struct<{_ENTITY},rank:string,position:string,service_branch:string>>,
locations array<struct<{_ENTITY},location_type:string,country:string,region:string,lat:double,lng:double>>,
organizations array<struct<{_ENTITY},org_type:string,country:string,description:string>>,
activities array<struct<{_ENTITY},activity_type:string,start_date:string,end_date:string,region:string,description:string>>,
relations array<struct<subject_type:string,subject_name:string,relation:string,sub_type:string,object_type:string,object_name:string>>
"""
#: Ids begin so.
PREFIXES = {"equipment": "equip", "person": "person", "location": "loc", "organization": "org", "activity": "event"}
#: Activities of these types are military events, others social ones.
MILITARY = ("operation", "deployment", "exercise", "port_visit", "transit", "incident", "surveillance", "patrol", "blockade", "strike", "escort")
#: For each array: the type of its entities, the fields that are compared with known entities, and the new vertex's
#: properties by the fields they come from.
_KINDS = {
    "equipment": ("equipment", ("designation", "equipment_type", "category", "status"), {"equip_type": ("equipment_type", "other"), "category": ("category", ""), "state": ("status", "active")}),
    "persons": ("person", ("rank", "position", "service_branch"), {"occupation": ("position", ""), "org_name": ("service_branch", "")}),
    "locations": ("location", ("region",), {"loc_type": ("location_type", "other"), "region": ("region", "")}),
    "organizations": ("organization", ("org_type", "country"), {"org_type": ("org_type", "other"), "region": ("country", ""), "description": ("description", "")}),
    "activities": ("activity", ("region", "start_date"), {"start_date": ("start_date", ""), "location_name": ("region", ""), "description": ("description", "")}),
}
#: Fields whose names differ where they are compared.
_COMPARED = {"country": "region"}


def extraction_counts(results: DataFrame) -> DataFrame:
    """(article_id, n_<array>): how many of each kind were found; a missing array counts 0."""
    arrays = [f.name for f in results.schema.fields if f.dataType.typeName() == "array"]
    return results.select("article_id", *(F.greatest(F.size(c), F.lit(0)).alias(f"n_{c}") for c in arrays))


def extracted_entities(results: DataFrame) -> DataFrame:
    """(article_id, entity_type, name, designation, aliases, props, attributes): a row for each named entity.

    props are compared with known entities, attributes are those of a new vertex.  Equipment
    without a name is named by its designation.
    """
    out = None
    text = "map<string,string>"
    for array, (kind, fields, made) in _KINDS.items():
        e = results.select("article_id", F.explode(array).alias("e"))
        value = lambda f: F.coalesce(F.col(f"e.{f}").cast("string"), F.lit(""))
        props = F.map_filter(F.create_map(*(x for f in fields for x in (F.lit(_COMPARED.get(f, f)), value(f)))), lambda k, v: v != "")
        pairs = [(k, F.coalesce(F.col(f"e.{f}"), F.lit(default))) for k, (f, default) in made.items()]
        if kind == "location":
            placed = (F.coalesce(F.col("e.lat"), F.lit(0.0)) != 0) & (F.coalesce(F.col("e.lng"), F.lit(0.0)) != 0)
            pairs.append(("coordinates", F.when(placed, F.concat_ws(",", "e.lat", "e.lng")).otherwise("")))
        if kind == "activity":
            pairs.append(("event_type", F.when(F.col("e.activity_type").isin(*MILITARY), "military").otherwise("social")))
        designation = value("designation") if kind == "equipment" else F.lit("")
        name = F.when(value("name") != "", value("name")).otherwise(designation)
        part = e.select("article_id", F.lit(kind).alias("entity_type"), name.alias("name"), designation.alias("designation"), F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"),
                        props.cast(text).alias("props"), F.create_map(*(x for k, v in pairs for x in (F.lit(k), v))).cast(text).alias("attributes"))
        out = part if out is None else out.unionByName(part)
    return out.filter("name <> ''")


@dataclass
class Saved:
    """The rows that an extraction adds to the tables."""

    #: vid, entity_type, name, aliases (joined by ||), props
    vertices: DataFrame
    #: vid, aliases: further aliases of known vertices, for mutations.with_aliases
    aliases: DataFrame
    #: provenance vertices, and trace edges from them
    records: DataFrame
    traces: DataFrame
    #: edges of relations
    edges: DataFrame
    #: vid, lat, lng, article_id, source_type, notes
    positions: DataFrame
    #: pairs for people: entity_type, vid_a, vid_b, name_a, name_b, similarity, context, source_article, status, llm_verdict
    uncertain: DataFrame


def save_extraction(results: DataFrame, articles: DataFrame, known: DataFrame, now, verdicts: DataFrame | None = None) -> Saved:
    """The rows to add for results (see RESULT) of articles (id, title, content).

    known: entity_type, vid, name, aliases (joined by ||), props.  Equal (entity_type, name) of
    all results are one entity.  A name in a relation stands for an entity of the results,
    else for a known one by its name or alias; relations with other names are left out.
    """
    found = materialise(extracted_entities(results), "extracted")
    routes = materialise(resolve_new(found, known, verdicts), "resolved")
    first = found.groupBy("entity_type", "name").agg(F.min_by(F.struct("designation", "aliases", "attributes"), "article_id").alias("f")).select("entity_type", "name", "f.*")
    fresh = None
    for kind, prefix in PREFIXES.items():
        wanted = routes.filter((F.col("entity_type") == kind) & F.col("vid").isNull()).select("entity_type", "name")
        part = next_ids(wanted, known, prefix, "name")
        fresh = part if fresh is None else fresh.unionByName(part)
    fresh = materialise(fresh, "fresh")
    ids = routes.filter("vid is not null").select("entity_type", "name", "vid").unionByName(fresh.select("entity_type", "name", "vid"))
    ids = materialise(ids, "ids")
    vertices = fresh.join(first, ["entity_type", "name"]).select("vid", "entity_type", "name", F.array_join("aliases", "||").alias("aliases"), F.col("attributes").alias("props"))
    aliases = found.join(routes.filter("vid is not null").select("entity_type", "name", "vid"), ["entity_type", "name"]).filter((F.size("aliases") > 0) & F.col("entity_type").isin("equipment", "person", "organization")).select("vid", "aliases")
    records = article_records(articles.join(results.select(F.col("article_id").alias("id")).distinct(), "id"), now)
    traced = found.join(ids, ["entity_type", "name"]).select(F.concat(F.lit("record_article_"), F.col("article_id").cast("string")).alias("record"), "vid").distinct()
    designated = found.filter("designation <> ''").join(ids, ["entity_type", "name"]).select("entity_type", F.col("designation").alias("name"), "vid")
    local = ids.unionByName(designated)

    relations = usable_relations(results.select("article_id", F.explode("relations").alias("r")).select("article_id", "r.*"))
    ends = relations.select(F.explode(F.array(*(F.struct(F.col(f"{e}_type").alias("entity_type"), F.col(f"{e}_name").alias("name")) for e in ("subject", "object")))).alias("x")).select("x.*").distinct()
    named = materialise(resolve_names(ends, local, known).filter("vid is not null"), "names")
    for end, vid in (("subject", "src"), ("object", "dst")):
        relations = relations.join(named.select(F.col("entity_type").alias(f"{end}_type"), F.col("name").alias(f"{end}_name"), F.col("vid").alias(vid)), [f"{end}_type", f"{end}_name"])
    relations = materialise(relations, "relations")
    edges = new_edges(relations.select("src", "dst", "relation", F.coalesce("sub_type", F.lit("other")).alias("sub_type"), F.col("article_id").alias("source")), now)

    at = vertices.select("vid", "props").unionByName(known.select("vid", "props")).select(F.col("vid").alias("dst"), coordinates(F.try_element_at("props", F.lit("coordinates"))).alias("p")).filter("p is not null")
    how = F.when(F.col("relation") != "locate", F.col("relation")).otherwise(F.coalesce("sub_type", F.lit("")))
    positions = relations.filter(places_equipment() & vid_number(F.col("src")).isNotNull()).join(at, "dst").select(
        F.col("src").alias("vid"), "p.lat", "p.lng", "article_id", F.lit("news_extract").alias("source_type"), F.concat(how, F.lit(" → "), F.col("object_name")).alias("notes"))

    unsure = routes.filter("route = 'uncertain'").select("entity_type", "name", F.explode("candidates").alias("c")).join(ids, ["entity_type", "name"])
    source = found.select("article_id", "entity_type", "name").distinct().join(articles.select(F.col("id").alias("article_id"), F.substring(F.coalesce("content", F.lit("")), 1, 500).alias("excerpt")), "article_id")
    sentence = F.get(F.filter(F.split(F.regexp_replace("excerpt", "\n", " "), r"\."), lambda s: F.contains(F.lower(s), F.lower("name"))), F.lit(0))
    context = F.coalesce(F.substring(F.trim(sentence), 1, 300), F.substring("excerpt", 1, 200))
    uncertain = unsure.join(source, ["entity_type", "name"]).select(
        "entity_type", F.col("vid").alias("vid_a"), F.col("c.vid").alias("vid_b"), F.col("name").alias("name_a"), F.col("c.name").alias("name_b"), F.lit(0.5).alias("similarity"),
        context.alias("context"), F.col("article_id").alias("source_article"), F.lit("pending").alias("status"), F.lit("l2_uncertain").alias("llm_verdict"))
    return Saved(vertices, aliases, records, trace_edges(traced, now), edges, positions, uncertain)
