"""Changes of tables as new tables: inserts of what is absent, upserts, appended decisions.

Spark's tables are not changed in place; each function returns the rows to append or the
whole new table, and the caller writes them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.functions.text import article_text, plain_text
from kithline.operators.graph import edge_type
from kithline.operators.listing import next_ids, numbered

#: What a new vertex has where its source says nothing.
VERTEX_DEFAULTS = {"confidence": 1.0, "aliases": "", "description": "", "state": "", "category": ""}
EDGE_CONFIDENCE = 0.9


def absent(new: DataFrame, table: DataFrame, *key: str) -> DataFrame:
    """New rows whose key the table lacks, one for each key."""
    return new.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti")


def new_vertices(new: DataFrame, table: DataFrame) -> DataFrame:
    own = absent(new, table, "vid")
    for c, v in VERTEX_DEFAULTS.items():
        if c in table.columns:
            own = own.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in own.columns else F.lit(v))
    return own


def new_edges(relations: DataFrame, now) -> DataFrame:
    """Edges of relations (src, dst, relation, sub_type, source)."""
    return relations.select("src", "dst", edge_type(F.col("relation")).alias("type"), F.coalesce(F.when(F.col("sub_type") != "", F.col("sub_type")), "relation").alias("sub_type"), F.lit(EDGE_CONFIDENCE).alias("confidence"), F.col("source").cast("string").alias("source"), now.cast("string").alias("created_at"))


def article_records(articles: DataFrame, now, source_db: str = "articles") -> DataFrame:
    """Provenance vertices of articles; the summary is the title's begin."""
    return articles.select(F.concat(F.lit("record_article_"), F.col("id").cast("string")).alias("vid"), F.lit(source_db).alias("source_db"), F.lit("articles").alias("source_table"), F.col("id").cast("string").alias("source_pk"), F.substring("title", 1, 200).alias("summary"), now.cast("string").alias("imported_at"))


def trace_edges(found: DataFrame, now, confidence: float = EDGE_CONFIDENCE, sub_type: str = "generate", source: str = "article") -> DataFrame:
    """Edges from records to entities (record, vid)."""
    return found.select(F.col("record").alias("src"), F.col("vid").alias("dst"), F.lit("trace").alias("type"), F.lit(sub_type).alias("sub_type"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), now.cast("string").alias("created_at"))


def import_records(vids: DataFrame, now, label: str = "", source_db: str = "articles") -> tuple[DataFrame, DataFrame]:
    """A record and a trace edge of full confidence for each entity that was imported by hand."""
    own = vids.select(F.concat(F.lit("record_import_"), "vid").alias("record"), "vid")
    records = own.select(F.col("record").alias("vid"), F.lit(source_db).alias("source_db"), F.lit("manual_import").alias("source_table"), F.col("vid").alias("source_pk"), F.concat(F.lit("manual import: "), F.lit(label)).alias("summary"), now.cast("string").alias("imported_at"))
    return records, trace_edges(own, now, 1.0, source="manual_import")


def with_aliases(table: DataFrame, new: DataFrame) -> DataFrame:
    """The table with more aliases (vid, aliases as an array) at the end of its own, joined by '||'."""
    more = new.groupBy("vid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("_more"))
    old = F.array_remove(F.split(F.coalesce("aliases", F.lit("")), r"\|\|"), "")
    both = F.array_join(F.array_union(old, F.coalesce("_more", F.array().cast("array<string>"))), "||")
    return table.join(more, "vid", "left").withColumn("aliases", both).select(table.columns)


def find_equipment(items: DataFrame, equipment: DataFrame) -> DataFrame:
    """With vid: the equipment named by the item's designation, else by its name, null if neither is known."""
    by = equipment.groupBy("name").agg(F.min("vid").alias("v"))
    d = by.select(F.col("name").alias("designation"), F.col("v").alias("_d"))
    n = by.select("name", F.col("v").alias("_n"))
    return items.join(d, "designation", "left").join(n, "name", "left").withColumn("vid", F.coalesce("_d", "_n")).drop("_d", "_n")


def upsert_equipment(equipment: DataFrame, items: DataFrame) -> DataFrame:
    """Known equipment with the items' category and state where they are given, and what is new with ids of its own."""
    found = find_equipment(items, equipment)
    given = found.filter("vid is not null").groupBy("vid").agg(*(F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("ordinal"))).alias(f"_{c}") for c in ("category", "state")))
    old = equipment.join(given, "vid", "left")
    for c in ("category", "state"):
        old = old.withColumn(c, F.coalesce(F.when(F.col(f"_{c}") != "", F.col(f"_{c}")), c))
    fresh = found.filter("vid is null").withColumn("name", F.coalesce(F.when(F.col("designation") != "", F.col("designation")), "name")).dropDuplicates(["name"])
    fresh = next_ids(fresh.drop("vid"), equipment, "equip", "name")
    return old.select(equipment.columns).unionByName(fresh.select([c for c in equipment.columns if c in fresh.columns]), allowMissingColumns=True)


def import_positions(equipment: DataFrame, history: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history with the items, equipment with the last processed position): the last one by ordinal, whatever its time."""
    found = find_equipment(items, equipment).filter("vid is not null")
    rows = found.select("vid", "lat", "lng", "reported_at")
    last = found.groupBy("vid").agg(F.max_by(F.struct("lat", "lng", "reported_at"), "ordinal").alias("p"))
    own = equipment.join(last, "vid", "left").withColumn("coordinates", F.coalesce(F.when(F.col("p").isNotNull(), F.concat_ws(",", "p.lat", "p.lng")), "coordinates") if "coordinates" in equipment.columns else F.when(F.col("p").isNotNull(), F.concat_ws(",", "p.lat", "p.lng")))
    return history.select("vid", "lat", "lng", "reported_at").unionByName(rows), own.drop("p")


def import_by_name(table: DataFrame, items: DataFrame, prefix: str) -> DataFrame:
    """The items whose names the table lacks, with ids."""
    return next_ids(absent(items, table, "name"), table, prefix, "name")


def article_contents(items: DataFrame, longest: int = 10_000, markup: Column | None = None) -> DataFrame:
    """All items, HTML stripped, cut; markup: whether a content is HTML, by default if it has a '<'."""
    own = F.col("content")
    text = F.when(own.contains("<") if markup is None else markup, plain_text(own)).otherwise(own)
    return items.withColumn("content", F.substring(text, 1, longest))


def import_articles(table: DataFrame, items: DataFrame, longest: int = 10_000) -> DataFrame:
    """Items with new URLs, one of each, HTML stripped, cut."""
    return article_contents(absent(items.filter("url is not null"), table, "url"), longest)


def known_sources(sources: DataFrame, items: DataFrame) -> DataFrame:
    """The sources with those that items name and the table lacks, with ids that count on; sources: id, name."""
    top = sources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    wanted = items.select(F.col("source").alias("name")).filter("name <> ''")
    fresh = numbered(absent(wanted, sources, "name"), "name", name="_n").crossJoin(F.broadcast(top))
    return sources.select("id", "name").unionByName(fresh.select((F.col("_top") + F.col("_n") + 1).alias("id"), "name"))


def reset_articles(articles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The articles with those that are wanted (id) pending again, as before any extraction."""
    hit = articles.join(wanted.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    again = F.coalesce("_hit", F.lit(False))
    out = hit.withColumn("status", F.when(again, "pending").otherwise(F.col("status")))
    if "entities_extracted" in articles.columns:
        out = out.withColumn("entities_extracted", F.when(again, False).otherwise(F.col("entities_extracted")))
    return out.select(articles.columns)


def refetched(articles: DataFrame, pages: DataFrame, longest: int = 8_000, shortest: int = 50) -> DataFrame:
    """The articles with the text of newly fetched pages (id, html), and pending again; a page with less text changes nothing."""
    text = article_text(F.col("html"))
    new = pages.groupBy("id").agg(F.first("html").alias("html")).withColumn("_text", text).filter(F.char_length("_text") >= shortest)
    fresh = articles.join(new.select("id", "_text"), "id", "left").withColumn("content", F.coalesce(F.substring("_text", 1, longest), F.col("content"))).select(articles.columns)
    return reset_articles(fresh, new.select("id"))


def finished_articles(articles: DataFrame, done: DataFrame) -> DataFrame:
    """The articles with those whose extraction was saved (id) done; ids without an article are passed over."""
    hit = articles.join(done.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    out = hit.withColumn("status", F.when(F.coalesce("_hit", F.lit(False)), "done").otherwise(F.col("status")))
    if "entities_extracted" in articles.columns:
        out = out.withColumn("entities_extracted", F.coalesce("_hit", F.col("entities_extracted")))
    return out.select(articles.columns)


def append_decision(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with more decisions; each gets the next sequence number of its pair."""
    top = log.groupBy("id").agg(F.max("seq").alias("_top"))
    new = rows.join(top, "id", "left").withColumn("seq", F.coalesce(F.col("_top") + 1, F.lit(0))).drop("_top")
    return log.unionByName(new.select(log.columns))


def cleared(queue: DataFrame) -> DataFrame:
    """The queue without what is pending."""
    return queue.filter("status <> 'pending'")


def remaining(todo: DataFrame, done: DataFrame, key: str = "pair_id") -> DataFrame:
    """What a stopped run has still to do."""
    return todo.join(done.select(key), key, "left_anti")


def annotate(todo: DataFrame, judge, path: str, key: str = "pair_id") -> DataFrame:
    """Judge what the table at path lacks and append it there; a stopped run goes on where it ended.

    judge: a function of a DataFrame that returns rows with the key.
    """
    spark = todo.sparkSession
    try:
        done = spark.read.parquet(path)
    except AnalysisException:  # the first run
        done = None
    judge(todo if done is None else remaining(todo, done, key)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def legacy_mentions(mentions: DataFrame, table: str, key: str) -> DataFrame:
    """(src, dst): from the record of the article to the entity that it mentions; mentions: article_id and the entity's id."""
    return mentions.select(F.concat(F.lit("record_article_"), F.col("article_id").cast("string")).alias("src"), F.concat(F.lit(f"{table}_"), F.col(key).cast("string")).alias("dst")).distinct()


def legacy_vertices(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(vid, tag, name) of relational tables: name of the table -> (rows, id column, tag)."""
    out = None
    for table, (rows, key, tag) in tables.items():
        part = rows.select(F.concat(F.lit(f"{table}_"), F.col(key).cast("string")).alias("vid"), F.lit(tag).alias("tag"), "name")
        out = part if out is None else out.unionByName(part)
    return out
