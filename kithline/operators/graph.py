"""Traversals and counts on vertices (vid, tag, name, props) and edges (src, dst, type, sub_type, confidence, source, created_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithline.functions.text import mentions, normal, sentences, stripped, vid_number
from kithline.operators.components import components
from kithline.scratch import materialise

#: The type of an edge by the relation's name; others are social.
EDGE_TYPES = {"social": "social", "employ": "employ", "locate": "locate", "participate": "participate", "org_relation": "org_relation", "use": "use_edge", "use_edge": "use_edge", "spatial": "spatial", "trace": "trace"}
#: Relations that say too little to be stored.
VAGUE_RELATIONS = ("mentioned", "related_to", "involves", "associated_with", "trace")
#: The entity type that a relation's type of subject or object stands for.
RELATION_TYPES = {
    "equipment": "equipment", "ship": "equipment", "aircraft": "equipment",
    "person": "person", "personnel": "person",
    "location": "location", "base": "location",
    "activity": "activity", "operation": "activity",
    "organization": "organization", "org": "organization", "military_unit": "organization", "company": "organization", "agency": "organization", "government_agency": "organization",
}
#: Relations by which older extractions placed equipment.
PLACING_RELATIONS = ("located_at", "deployed_to", "deployed_from", "operated_in", "homeported_at", "based_at", "visited", "transited", "ported_at")


def edge_type(relation):
    kinds = F.create_map(*(F.lit(x) for kv in EDGE_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(kinds, normal(relation)), F.lit("social"))


def relation_type(kind: Column) -> Column:
    """The entity type of a subject or object; one that is not known stands for itself, null for none."""
    kinds = F.create_map(*(F.lit(x) for kv in RELATION_TYPES.items() for x in kv))
    own = F.coalesce(kind, F.lit(""))
    return F.coalesce(F.try_element_at(kinds, own), own)


def usable_relations(relations: DataFrame) -> DataFrame:
    """With types as relation_type gives them, without vague or empty relations, empty ends, and relations of an entity to itself.

    relations: subject_type, subject_name, relation, object_type, object_name and others.
    """
    typed = relations.withColumns({c: relation_type(F.col(c)) for c in ("subject_type", "object_type")})
    given = F.lit(True)
    for c in ("subject_name", "object_name", "relation"):
        given = given & (F.coalesce(F.col(c), F.lit("")) != "")
    itself = (F.col("subject_type") == F.col("object_type")) & (F.col("subject_name") == F.col("object_name"))
    return typed.filter(given & ~F.col("relation").isin(*VAGUE_RELATIONS) & ~itself)


def places_equipment() -> Column:
    """Whether a usable relation says where equipment is."""
    locates = (F.col("relation") == "locate") | F.col("relation").isin(*PLACING_RELATIONS)
    return (F.col("subject_type") == "equipment") & (F.col("object_type") == "location") & locates


def one_hop(vids: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(vid, direction, type, neighbour, neighbour_name) of both directions; a vertex that is absent is named by its id."""
    ends = edges.select("src", "dst", "type")
    out = vids.join(ends, vids["vid"] == ends["src"]).select("vid", F.lit("out").alias("direction"), "type", F.col("dst").alias("neighbour"))
    into = vids.join(ends, vids["vid"] == ends["dst"]).select("vid", F.lit("in").alias("direction"), "type", F.col("src").alias("neighbour"))
    names = vertices.select(F.col("vid").alias("neighbour"), "name")
    return out.unionByName(into).join(names, "neighbour", "left").select("vid", "direction", "type", "neighbour", F.coalesce("name", "neighbour").alias("neighbour_name"))


def two_hop_counts(edges: DataFrame) -> DataFrame:
    """(vid, n_paths): paths of two edges from each vertex, from degrees alone, so that no path is made."""
    degree = edges.groupBy("src").agg(F.count("*").alias("d")).select(F.col("src").alias("dst"), "d")
    return edges.select("src", "dst").join(degree, "dst").groupBy(F.col("src").alias("vid")).agg(F.sum("d").alias("n_paths"))


def degrees(edges: DataFrame, end: str = "src") -> DataFrame:
    return edges.groupBy(F.col(end).alias("vid")).agg(F.count("*").alias("degree"))


def related_context(vids: DataFrame, edges: DataFrame, vertices: DataFrame, types: tuple[str, ...] = ("employ", "locate", "social"), most: int = 5) -> DataFrame:
    """(vid, related): names of the first neighbours over some types."""
    near = one_hop(vids, edges.filter(F.col("type").isin(*types)), vertices)
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("vid").orderBy("type", "direction", "neighbour"))).filter(F.col("r") <= most)
    return first.groupBy("vid").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "neighbour_name"))), lambda x: x["neighbour_name"]).alias("related"))


def provenance(vids: DataFrame, edges: DataFrame, records: DataFrame, articles: DataFrame, newest: int = 20) -> DataFrame:
    """(vid, article_id, title, published_at, rank): the newest articles that an entity is traced to.

    records: vid, source_pk; articles: id, title, published_at.
    """
    traced = edges.filter("type = 'trace'").select(F.col("src").alias("record"), F.col("dst").alias("vid"))
    found = vids.join(traced, "vid").join(records.select(F.col("vid").alias("record"), F.col("source_pk").try_cast("long").alias("id")), "record").join(articles.select("id", "title", "published_at"), "id")
    found = found.select("vid", F.col("id").alias("article_id"), "title", "published_at").distinct()
    rank = F.row_number().over(Window.partitionBy("vid").orderBy(F.col("published_at").desc_nulls_last(), F.desc("article_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= newest)


def supported_only_by(edges: DataFrame, record) -> DataFrame:
    """(vid): traced by this record and by no other (record: a condition on src)."""
    trace = edges.filter("type = 'trace'").select("src", F.col("dst").alias("vid"))
    return trace.filter(record).select("vid").distinct().join(trace.filter(~record).select("vid"), "vid", "left_anti")


def shared_with_others(edges: DataFrame, record) -> DataFrame:
    """(vid): traced by this record and by another."""
    trace = edges.filter("type = 'trace'").select("src", F.col("dst").alias("vid"))
    return trace.filter(record).select("vid").distinct().join(trace.filter(~record).select("vid"), "vid", "left_semi")


def retract(vertices: DataFrame, edges: DataFrame, record: str, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What is left of the graph without a record: its edges, the edges that name it as source, and entities only it supports."""
    own = F.col("src") == record
    orphans = supported_only_by(edges, own)
    gone = orphans.unionByName(vertices.filter(F.col("vid") == record).select("vid"))
    kept = edges.filter(~own)
    if source is not None:
        kept = kept.filter(~F.coalesce(F.col("source") == source, F.lit(False)))
    for end in ("src", "dst"):
        kept = kept.join(gone.select(F.col("vid").alias(end)), end, "left_anti")
    return vertices.join(gone, "vid", "left_anti"), kept.select(edges.columns)


def delete_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the vertices in gone (vid) and without edges at them."""
    kept = edges
    for end in ("src", "dst"):
        kept = kept.join(gone.select(F.col("vid").alias(end)), end, "left_anti")
    return vertices.join(gone, "vid", "left_anti"), kept.select(edges.columns)


def merge_map(merges: DataFrame) -> DataFrame:
    """(vid, keep): the vertex that each vertex of a merge ends in, whatever the length of a chain.

    merges: vid_a, vid_b, and if there are any, keep_vid (the one of both that stays; vid_a where
    it is neither) and ordinal (the order of the decisions).  Of the vertices that decisions
    keep, one that no other decision removes is kept, of several the one of the last
    decision, then the one with the smallest number.
    """
    own = _decisions(merges)
    reached = materialise(components(own, "vid_a", "vid_b"), "components")
    removed = own.filter("wins <> loses").select(F.col("loses").alias("wins"), F.lit(True).alias("removed")).distinct()
    votes = own.groupBy("wins").agg(F.max("ordinal").alias("ordinal")).join(removed, "wins", "left").join(reached, F.col("wins") == F.col("node"), "left")
    votes = votes.select("wins", "ordinal", F.coalesce("removed", F.lit(False)).alias("removed"), F.coalesce("component", "wins").alias("component"))
    rank = F.struct("removed", -F.col("ordinal"), F.coalesce(vid_number(F.col("wins")), F.lit(2**63 - 1)), F.col("wins"))
    keep = votes.groupBy("component").agg(F.min_by("wins", rank).alias("keep"))
    vids = own.select(F.explode(F.array("vid_a", "vid_b")).alias("vid")).distinct()
    of = vids.join(reached, F.col("vid") == F.col("node"), "left").select("vid", F.coalesce("component", "vid").alias("component"))
    return materialise(of.join(keep, "component").select("vid", "keep"), "merges")


def merged_later(state: DataFrame | None, merges: DataFrame) -> DataFrame:
    """(vid, component, ordinal, removed, keep): stored merges with further decisions, as if all had come at once.

    state: what this function gave before (None at first); merges: see merge_map.  The earlier links are not needed.
    New pairs are carried over to the components of their ends, and those alone are connected anew, so the search
    for components costs what the new pairs cost; of the state only rows of components that are met change.
    ordinal is that of the last decision that keeps the vertex (null: none does), removed says whether one removes it.
    """
    own = _decisions(merges)
    if state is None:
        state = own.select(F.col("vid_a").alias("vid"), F.col("vid_a").alias("component"), "ordinal", F.lit(False).alias("removed"), F.col("vid_a").alias("keep")).filter(F.lit(False))
    own = materialise(own, "decisions")
    ends = own.select(F.explode(F.array("vid_a", "vid_b")).alias("vid")).distinct()
    at = materialise(ends.join(state.select("vid", "component"), "vid", "left").select("vid", F.coalesce("component", "vid").alias("at")), "ends")
    links = own.select("vid_a", "vid_b").join(at.toDF("vid_a", "a"), "vid_a").join(at.toDF("vid_b", "b"), "vid_b").select("a", "b")
    moved = materialise(at.select("at").distinct().join(components(links).toDF("at", "component"), "at", "left").select("at", F.coalesce("component", "at").alias("to")), "contracted")
    votes = own.groupBy(F.col("wins").alias("vid")).agg(F.max("ordinal").alias("ordinal"))
    removed = own.filter("wins <> loses").select(F.col("loses").alias("vid"), F.lit(True).alias("removed")).distinct()
    fresh = at.join(votes, "vid", "left").join(removed, "vid", "left").select("vid", F.col("at").alias("component"), "ordinal", F.coalesce("removed", F.lit(False)).alias("removed"))
    met = state.join(moved.select(F.col("at").alias("component")), "component", "left_semi").select("vid", "component", "ordinal", "removed").unionByName(fresh)
    met = met.groupBy("vid").agg(F.min("component").alias("at"), F.max("ordinal").alias("ordinal"), F.max("removed").alias("removed")).join(moved, "at").select("vid", F.col("to").alias("component"), "ordinal", "removed")
    rank = F.struct("removed", -F.col("ordinal"), F.coalesce(vid_number(F.col("vid")), F.lit(2**63 - 1)), F.col("vid"))
    keep = met.filter("ordinal is not null").groupBy("component").agg(F.min_by("vid", rank).alias("keep"))
    rest = state.join(moved.select(F.col("at").alias("component")), "component", "left_anti").select("vid", "component", "ordinal", "removed", "keep")
    return materialise(rest.unionByName(met.join(keep, "component").select("vid", "component", "ordinal", "removed", "keep")), "merge-state")


def _decisions(merges: DataFrame) -> DataFrame:
    """(vid_a, vid_b, ordinal, wins, loses); see merge_map for what is given."""
    given = F.col("keep_vid") if "keep_vid" in merges.columns else F.lit(None).cast("string")
    ordinal = F.col("ordinal") if "ordinal" in merges.columns else F.lit(0)
    own = merges.filter("vid_a is not null and vid_b is not null").select("vid_a", "vid_b", ordinal.cast("long").alias("ordinal"), F.when(given.isin(F.col("vid_a"), F.col("vid_b")), given).otherwise(F.col("vid_a")).alias("wins"))
    return own.withColumn("loses", F.when(F.col("wins") == F.col("vid_a"), F.col("vid_b")).otherwise(F.col("vid_a")))


def rewire(edges: DataFrame, mapping: DataFrame, merged_as: str = "fusion_merge") -> DataFrame:
    """The edges between the vertices that are kept.

    Edges between vertices that became one are dropped, other loops stay.  Of edges that
    became the same one stays, one that was moved before others.  A trace that led to a
    removed vertex is written anew, with the merge as its source.
    """
    out = edges
    for end in ("src", "dst"):
        own = mapping.select(F.col("vid").alias(end), F.col("keep").alias(f"_{end}"))
        out = out.join(own, end, "left").withColumn(f"_moved_{end}", F.coalesce(F.col(f"_{end}") != F.col(end), F.lit(False))).withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    anew = F.col("_moved_dst") & (F.col("type") == "trace")
    fresh = {"sub_type": F.lit("merge"), "confidence": F.lit(1.0), "source": F.lit(merged_as), "created_at": F.lit("")}
    out = out.withColumns({c: F.when(anew, v).otherwise(F.col(c)) for c, v in fresh.items() if c in edges.columns})
    moved = F.col("_moved_src") | F.col("_moved_dst")
    rest = [c for c in edges.columns if c not in ("src", "dst", "type")]
    first = F.min_by(F.struct(*rest), F.struct(~anew, ~moved, "created_at", "source", "sub_type")).alias("e")
    kept = out.filter((F.col("src") != F.col("dst")) | ~moved)
    return kept.groupBy("src", "dst", "type").agg(first).select("src", "dst", "type", "e.*").select(edges.columns)


def merge_vertices(vertices: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) after the merges: kept ones have the aliases and names of those merged into them.

    vertices: vid, name, aliases (an array) and other columns, which stay those of the kept
    vertex.  merges: see merge_map.
    """
    mapping = merge_map(merges)
    of = vertices.join(mapping, "vid", "left").withColumn("keep", F.coalesce("keep", "vid"))
    named = of.select("keep", F.explode(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.when(F.col("vid") != F.col("keep"), F.array("name")).otherwise(F.array().cast("array<string>")))).alias("a"))
    union = named.filter("a is not null and a <> ''").groupBy(F.col("keep").alias("vid")).agg(F.array_sort(F.collect_set("a")).alias("_aliases"))
    kept = of.filter("vid = keep").drop("keep").join(union, "vid", "left").withColumn("aliases", F.coalesce("_aliases", F.array().cast("array<string>"))).select(vertices.columns)
    return kept, rewire(edges, mapping)


def counts_by(df: DataFrame, kind: str, label: str) -> DataFrame:
    """(kind, value, n) with a row 'total'."""
    counted = df.groupBy(F.col(kind).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("n")).select(F.lit("total").alias("value"), "n")
    return counted.unionByName(total).select(F.lit(label).alias("kind"), "value", "n")


def graph_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return counts_by(vertices, "tag", "vertex").unionByName(counts_by(edges, "type", "edge"))


def article_entities(articles: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(article_id, vid, tag, name): what is traced to each article.  articles: id."""
    record = F.concat(F.lit("record_article_"), F.col("id").cast("string"))
    trace = edges.filter("type = 'trace'").select(F.col("src").alias("record"), F.col("dst").alias("vid")).distinct()
    return articles.select(F.col("id").alias("article_id"), record.alias("record")).join(trace, "record").join(vertices.select("vid", "tag", "name"), "vid").select("article_id", "vid", "tag", "name")


def home_base_links(equipment: DataFrame, locations: DataFrame, now: Column) -> DataFrame:
    """Locate edges from equipment (vid, home_base) to the location of that name; equipment without one has none."""
    by_name = locations.groupBy(F.col("name").alias("home_base")).agg(F.min("vid").alias("dst"))
    return equipment.filter("home_base <> ''").join(by_name, "home_base").select(
        F.col("vid").alias("src"), "dst", F.lit("locate").alias("type"), F.lit("home_base").alias("sub_type"), F.lit(1.0).alias("confidence"), F.lit("seed").alias("source"), now.cast("string").alias("created_at"))


def related_articles(vids: DataFrame, edges: DataFrame, records: DataFrame, articles: DataFrame, newest: int = 10, longest: int = 500) -> DataFrame:
    """(vid, article_id, title, content, published_at, rank): the newest articles behind each entity, contents cut."""
    ranked = provenance(vids, edges, records, articles, newest)
    contents = articles.select(F.col("id").alias("article_id"), F.substring(F.coalesce("content", F.lit("")), 1, longest).alias("content"))
    return ranked.join(contents, "article_id").select("vid", "article_id", "title", "content", "published_at", "rank")


def longest_sentences(entities: DataFrame, related: DataFrame, longest: int = 300) -> DataFrame:
    """(vid, sentence): the longest sentence with the entity's name in its articles, the first of equals, cut; '' if there is none.

    entities: vid, name; related: as related_articles gives them.
    """
    named = related.join(entities.select("vid", "name").filter("name <> ''"), "vid")
    each = named.select("vid", "name", "rank", F.posexplode(sentences(F.col("content"))).alias("i", "s")).filter(F.contains("s", "name"))
    best = each.groupBy("vid").agg(F.max_by("s", F.struct(F.char_length("s"), -F.col("rank"), -F.col("i"))).alias("s"))
    return entities.select("vid").join(best, "vid", "left").select("vid", F.substring(F.coalesce("s", F.lit("")), 1, longest).alias("sentence"))


def source_fragments(entities: DataFrame, edges: DataFrame, records: DataFrame, articles: DataFrame, own_text: DataFrame | None = None, most: int = 2, most_records: int = 5) -> DataFrame:
    """(vid, fragments): the longest windows of text around an entity's name, of its own text if that has any, else of its first records' articles.

    entities: vid, name; own_text: vid, content; records: vid, source_pk; articles: id, content.
    """
    cut = lambda rows: rows.select("vid", F.explode(mentions(stripped(F.col("name")), F.col("content"))).alias("f"))
    trace = edges.filter("type = 'trace'").select(F.col("src").alias("record"), F.col("dst").alias("vid")).distinct().join(entities.select("vid", "name"), "vid")
    nth = F.row_number().over(Window.partitionBy("vid").orderBy("record"))
    first = trace.withColumn("r", nth).filter(F.col("r") <= most_records)
    texts = first.join(records.select(F.col("vid").alias("record"), F.col("source_pk").try_cast("long").alias("id")), "record").join(articles.select("id", "content"), "id")
    found = cut(texts)
    if own_text is not None:
        own = cut(entities.join(own_text.select("vid", "content"), "vid"))
        found = own.unionByName(found.join(own.select("vid").distinct(), "vid", "left_anti"))
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("vid").orderBy(F.char_length("f").desc(), "f"))).filter(F.col("r") <= most)
    lists = top.groupBy("vid").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "f"))), lambda x: x["f"]).alias("fragments"))
    return entities.select("vid").join(lists, "vid", "left").select("vid", F.coalesce("fragments", F.array().cast("array<string>")).alias("fragments"))


#: The properties that a pair's comparison shows, by type.
SHOWN_FIELDS = {
    "equipment": ("name", "equip_type", "category", "state", "home_location", "latest_reported_at", "parent_unit", "aliases", "description", "confidence", "created_at", "updated_at"),
    "person": ("name", "occupation", "org_name", "aliases", "description", "confidence", "created_at", "updated_at"),
    "location": ("name", "loc_type", "region", "coordinates", "aliases", "description", "confidence", "created_at", "updated_at"),
    "activity": ("name", "event_type", "start_date", "end_date", "location_name", "aliases", "description", "confidence", "created_at", "updated_at"),
    "organization": ("name", "org_type", "aliases", "description", "confidence", "created_at", "updated_at"),
}


def shown_properties(props: Column, entity_type: Column) -> Column:
    fields = F.create_map(*(x for k, v in SHOWN_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    own = F.coalesce(F.try_element_at(fields, entity_type), F.array(*map(F.lit, ("name", "aliases", "description", "confidence"))))
    return F.map_filter(props, lambda k, v: F.array_contains(own, k))


def pair_details(queue: DataFrame, entities: DataFrame, edges: DataFrame, records: DataFrame, articles: DataFrame) -> DataFrame:
    """The queue's pairs with properties, related articles (an array) and the longest sentence of both sides.

    queue: vid_a, vid_b, entity_type and others; entities: vid, name, props.
    """
    vids = queue.select(F.explode(F.array("vid_a", "vid_b")).alias("vid")).distinct()
    own = entities.join(vids, "vid", "left_semi")
    related = materialise(related_articles(vids, edges, records, articles), "related")
    lists = related.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("rank", "article_id", "title", "content"))).alias("articles"))
    sides = own.select("vid", "props").join(lists, "vid", "left").join(longest_sentences(own, related), "vid", "left")
    out = queue
    for s in "ab":
        side = sides.select(F.col("vid").alias(f"vid_{s}"), F.col("props").alias(f"props_{s}"), F.col("articles").alias(f"articles_{s}"), F.coalesce("sentence", F.lit("")).alias(f"longest_sentence_{s}"))
        out = out.join(side, f"vid_{s}", "left").withColumn(f"props_{s}", shown_properties(F.col(f"props_{s}"), F.col("entity_type")))
    return out
