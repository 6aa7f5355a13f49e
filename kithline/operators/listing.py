"""Lists, searches, details and pages over entities, articles and the decision queue.

Every page has a total order, so that pages neither overlap nor miss rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithline.functions.text import coordinates


def has_text(column: Column | str, q: str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q.lower()))


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(limit)


def filtered(df: DataFrame, equal: dict[str, object] | None = None, search: str | None = None, search_in: tuple[str, ...] = ("name", "aliases"), order: str = "vid", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows with equal values in some columns (None: not asked for) and a text in one of others, by vid."""
    for k, v in (equal or {}).items():
        if v is not None:
            df = df.filter(F.col(k) == v)
    if search:
        hit = F.lit(False)
        for c in search_in:
            hit = hit | has_text(c, search)
        df = df.filter(hit)
    df = df.orderBy(order)
    return df if limit is None else page(df, limit, offset)


def node_search(df: DataFrame, q: str) -> DataFrame:
    """Rows with the text in any column."""
    return df.filter(has_text(F.concat_ws(" ", *(F.col(c).cast("string") for c in df.columns)), q))


def global_search(tables: list[tuple[str, DataFrame]], q: str, limit: int = 30) -> DataFrame:
    """(type, vid, name) by a text in the name, in the order of the tables; nothing for less than two characters."""
    out = None
    for i, (kind, df) in enumerate(tables):
        part = df.filter(has_text("name", q)).select(F.lit(i).alias("ordinal"), F.lit(kind).alias("type"), "vid", "name")
        out = part if out is None else out.unionByName(part)
    if len(q) < 2:
        out = out.filter(F.lit(False))
    return out.orderBy("ordinal", "vid").limit(limit).drop("ordinal")


def article_page(articles: DataFrame, status: str | None = None, q: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Failed articles last, a null status first, then the newest; with the content's length."""
    if status is not None:
        articles = articles.filter(F.col("status") == status)
    if q:
        articles = articles.filter(has_text("title", q) | has_text("content", q))
    ordered = articles.orderBy((F.col("status") != "failed").desc_nulls_first(), F.col("published_at").desc_nulls_last(), F.desc("id"))
    return page(ordered, limit, offset).withColumn("content_length", F.length("content"))


def pending_articles(articles: DataFrame, n: int = 5) -> DataFrame:
    return articles.filter((F.col("status") == "pending") & F.col("content").isNotNull()).orderBy(F.col("published_at").desc_nulls_first(), "id").limit(n)


def queue_totals(queue: DataFrame) -> DataFrame:
    """(status, entity_type, total): what pages of the queue are numbered by."""
    return queue.groupBy("status", "entity_type").agg(F.count("*").alias("total"))


def queue_page(queue: DataFrame, status: str = "pending", entity_type: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    own = queue.filter(F.col("status") == status)
    if entity_type is not None:
        own = own.filter(F.col("entity_type") == entity_type)
    return page(own.orderBy(F.col("similarity").desc_nulls_last(), F.col("created_at").desc_nulls_first(), "id"), limit, offset)


def execution_order(queue: DataFrame) -> DataFrame:
    return queue.filter("status = 'pending'").orderBy(F.col("similarity").desc_nulls_first(), "id")


def latest_status(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The newest row of each key of an append-only log."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def track(positions: DataFrame, vid: Column, now: Column, days: int = 90) -> DataFrame:
    """An entity's positions since a number of days, oldest first."""
    return positions.filter((F.col("vid") == vid) & (F.col("reported_at") >= now - F.make_interval(days=F.lit(days)))).orderBy("reported_at")


def newest_positions(positions: DataFrame, n: int = 50) -> DataFrame:
    """The newest n positions of each entity."""
    r = F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("reported_at"), F.desc("id")))
    return positions.withColumn("rank", r).filter(F.col("rank") <= n)


def latest_position(positions: DataFrame, by: str = "reported_at") -> DataFrame:
    """The position with the largest value of by, per entity; by='seq' is the order of arrival."""
    keep = [c for c in positions.columns if c != "vid"]
    return positions.groupBy("vid").agg(F.max_by(F.struct(*keep), F.struct(by, "id")).alias("p")).select("vid", "p.*")


def active_ships(equipment: DataFrame, category: str | None = None) -> DataFrame:
    own = equipment.filter((F.col("equip_type") == "ship") & (F.coalesce("state", F.lit("")).isin("", "active")))
    return own if category is None else own.filter(F.col("category") == category)


def map_points(locations: DataFrame) -> DataFrame:
    """(vid, lat, lng, weight) of locations with valid coordinates."""
    return locations.withColumn("p", coordinates(F.col("coordinates"))).filter("p is not null").select("vid", "p.lat", "p.lng", F.lit(1).alias("weight"))


def heat_cells(points: DataFrame, size: float) -> DataFrame:
    return points.groupBy((F.floor(F.col("lat") / size) * size).alias("lat"), (F.floor(F.col("lng") / size) * size).alias("lng")).agg(F.sum("weight").alias("weight"))


def map_kpis(equipment: DataFrame, locations: DataFrame, articles: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """One row of counts."""
    e = equipment.agg(*(F.count_if(F.col("equip_type") == k).alias(f"n_{k}") for k in ("ship", "aircraft", "weapon")))
    at = map_points(locations).agg(F.count("*").alias("n_located"))
    week = articles.agg(F.count_if(F.col("published_at") >= now - F.make_interval(days=F.lit(7))).alias("n_week"))
    return e.crossJoin(at).crossJoin(week).crossJoin(events.agg(F.count("*").alias("n_events")))


def best_candidate(candidates: DataFrame, key: str = "entity") -> DataFrame:
    """The candidate with the highest score of each entity, the first of equals."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "ordinal"))
    return candidates.withColumn("r", r).filter("r = 1").drop("r")


def batches(df: DataFrame, order: str, size: int, within: str) -> DataFrame:
    """With batch: runs of size rows in order, numbered within each group."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(within).orderBy(order)) - 1) / size).cast("int"))


def numbered(df: DataFrame, key: str, *within: str, name: str = "n", seed: int = 42) -> DataFrame:
    """With name: 0, 1, 2, ... for the rows of each group, in the order of a seeded hash's buckets and of key.

    No group is gathered: each bucket numbers its own rows from where the buckets before it
    end.  There are four buckets for each shuffle partition.
    """
    buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.withColumn("_bucket", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets)))
    sizes = part.groupBy(*within, "_bucket").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    same = [F.col("x._bucket") == F.col("y._bucket")] + [F.col(f"x.{w}").eqNullSafe(F.col(f"y.{w}")) for w in within]
    own = part.withColumn("_r", F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(key)) - 1)
    return own.alias("x").join(before.alias("y"), same).select(*(F.col(f"x.{c}") for c in df.columns), (F.col("_before") + F.col("_r")).alias(name))


def next_ids(new: DataFrame, taken: DataFrame, prefix: str, order: str) -> DataFrame:
    """With vid: prefix_n, n counting on from the largest number taken; see numbered for the order."""
    from kithline.functions.text import vid_number

    base = taken.filter(F.col("vid").startswith(prefix + "_")).agg(F.coalesce(F.max(vid_number(F.col("vid"))), F.lit(0)).alias("_base"))
    out = numbered(new, order, name="_n").crossJoin(F.broadcast(base))
    return out.withColumn("vid", F.concat(F.lit(prefix + "_"), (F.col("_base") + F.col("_n") + 1).cast("string"))).select(*new.columns, "vid")


#: The type of event that a type of activity stands for; others stand for themselves.
EVENT_TYPES = {
    "offensive": "military", "defense": "military", "patrol": "military", "exercise": "military", "deployment": "military",
    "port_visit": "military", "operation": "military", "incident": "military", "other": "social",
}


def activity_list(events: DataFrame, activity_type: str | None = None, limit: int = 50) -> DataFrame:
    """Events of the type that the activity type stands for, by vid; at most 200."""
    kind = None if not activity_type else EVENT_TYPES.get(activity_type, activity_type)
    return filtered(events, {"event_type": kind}, limit=min(limit, 200)).withColumnRenamed("event_type", "activity_type")


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """(field, value): the distinct non-empty values of some columns, for filters."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*")
    return long.filter("value <> ''").distinct()


def counts_descending(df: DataFrame, kind: str) -> DataFrame:
    """(value, n), the most frequent first."""
    return df.groupBy(F.col(kind).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def location_detail(locations: DataFrame) -> DataFrame:
    """Locations with lat and lng, null where the coordinates are none."""
    return locations.withColumn("_p", coordinates(F.col("coordinates"))).withColumn("lat", F.col("_p.lat")).withColumn("lng", F.col("_p.lng")).drop("_p")


def top_rows(rows: DataFrame, key: str, order: list[str], most: int, parts: int = 64) -> DataFrame:
    """With rank and total: the first rows of each key in this order, and how many the key has.

    A key's rows are first ranked within parts, by a hash of the order's columns, so a key of any size leaves
    at most parts times most rows for the task that ranks them.
    """
    part = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    within = Window.partitionBy(key, "_part").orderBy(*order)
    first = part.withColumn("_rank", F.row_number().over(within)).filter(F.col("_rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= most)
    totals = rows.groupBy(key).agg(F.count("*").alias("total"))
    return ranked.drop("_part", "_rank").join(totals, key)


def entity_detail(entities: DataFrame, edges: DataFrame, vertices: DataFrame, records: DataFrame, articles: DataFrame, positions: DataFrame, most: int = 1000) -> DataFrame:
    """Each entity with coordinates, its first most relations and their number, newest articles and positions; source: where it is known from."""
    from kithline.operators.graph import one_hop, provenance

    vids = entities.select("vid")
    near = top_rows(one_hop(vids, edges, vertices), "vid", ["type", "direction", "neighbour", "neighbour_name"], most)
    near = near.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("type", "direction", "neighbour", "neighbour_name"))).alias("relations"), F.max("total").alias("n_relations"))
    seen = provenance(vids, edges, records, articles).groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("rank", "article_id", "title"))).alias("articles"))
    at = newest_positions(positions).groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("rank", "reported_at", "lat", "lng"))).alias("positions"))
    out = entities
    for part in (near, seen, at):
        out = out.join(part, "vid", "left")
    return out.withColumn("n_relations", F.coalesce("n_relations", F.lit(0).cast("long"))).withColumn("source", F.when(F.size(F.coalesce("articles", F.array())) > 0, "news_extract").otherwise("seed"))


def map_overview(equipment: DataFrame, locations: DataFrame, activities: DataFrame, articles: DataFrame, now: Column) -> DataFrame:
    """(layer, vid, name, lat, lng, n): the ships in service, the places with coordinates, the activities and the indicators of a map.

    Indicators have their name and n, the layers' rows no n; only places have coordinates.
    """
    kpis = map_kpis(equipment, locations, articles, activities, now)
    none = lambda t: F.lit(None).cast(t)
    row = lambda d, layer, lat=None, lng=None: d.select(F.lit(layer).alias("layer"), "vid", "name", (lat if lat is not None else none("double")).alias("lat"), (lng if lng is not None else none("double")).alias("lng"), none("long").alias("n"))
    counts = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in kpis.columns))).alias("x")
    placed = location_detail(locations).filter("lat is not null and lng is not null")
    indicators = kpis.select(counts).select(F.lit("kpi").alias("layer"), none("string").alias("vid"), "x.name", none("double").alias("lat"), none("double").alias("lng"), "x.n")
    return row(active_ships(equipment), "ship").unionByName(row(placed, "location", F.col("lat"), F.col("lng"))).unionByName(row(activities, "activity")).unionByName(indicators)
