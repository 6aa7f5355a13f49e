"""News feeds from staged files: RSS and JSON documents become articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithline.functions.text import EXCLUDED_TOPICS, KEYWORDS, any_word, article_text, feed_time, plain_text
from kithline.sources.staged import RSS_ENTRIES, raw_entries

ARTICLES = "source string, title string, url string, content string, published_at timestamp"
RSS_LENGTH, JSON_LENGTH = 10_000, 8_000


def rss(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Items of staged RSS files: the first 30 of each file, one for each URL, on topic unless the source is about ships alone."""
    schema = "title string, link string, description string, pubDate string"
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    first = items.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("at"))).filter(F.col("r") <= RSS_ENTRIES)
    rows = first.dropDuplicates(["link"]).select(F.lit(source).alias("source"), "title", F.col("link").alias("url"), F.substring(plain_text(F.coalesce("description", F.lit(""))), 1, RSS_LENGTH).alias("content"),
                                                 F.coalesce(feed_time(F.col("pubDate")), F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]+, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))).alias("published_at"))
    special = any(w in source.lower() for w in ("fleet", "tracker"))
    return rows if special else rows.filter(on_topic())


def json_feed(spark: SparkSession, path: str, source: str, bodies: DataFrame | None = None) -> DataFrame:
    """Articles of staged JSON responses {articles: [{url, title, seendate}]}; bodies (url, html) give the contents."""
    items = spark.read.option("multiLine", True).schema("articles array<struct<url:string,title:string,seendate:string>>").json(path).select(F.explode("articles").alias("a")).select("a.*").dropDuplicates(["url"])
    if bodies is None:
        items = items.withColumn("html", F.lit(""))
    else:
        items = items.join(bodies.select("url", "html"), "url", "left")
    rows = items.select(F.lit(source).alias("source"), "title", "url", F.substring(article_text(F.coalesce("html", F.lit(""))), 1, JSON_LENGTH).alias("content"), feed_time(F.col("seendate")).alias("published_at"))
    return rows.filter("url <> ''").filter(_titled())


def on_topic():
    return any_word(F.concat_ws(" ", "title", "content"), KEYWORDS)


def _titled():
    """A title that is on topic and not off it."""
    title = F.coalesce("title", F.lit(""))
    return any_word(title, KEYWORDS) & ~any_word(title, EXCLUDED_TOPICS)


def web(spark: SparkSession) -> DataFrame:
    """Plain web sources give nothing."""
    return spark.createDataFrame([], ARTICLES)


def new_sources(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sources whose names are not registered yet."""
    return wanted.dropDuplicates(["name"]).join(known.select("name"), "name", "left_anti")


def articles_of(raw: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """Articles in the entries that staged.raw_entries gives, a batch or a stream; rows with an error are none.

    RSS entries need a URL and stand by themselves: on topic by title or text, unless the source is about ships
    alone.  JSON entries need a URL and a title, which must be on topic and not off it; bodies (url, html) give
    their texts.  A URL may come twice (see first_of_url).
    """
    raw = raw.filter("error is null and url <> ''")
    is_json = F.col("type") == "json"
    if bodies is None:
        raw = raw.withColumn("html", F.lit(""))
    else:
        raw = raw.join(bodies.select("url", "html"), "url", "left")
    content = F.when(is_json, F.substring(article_text(F.coalesce("html", F.lit(""))), 1, JSON_LENGTH)).otherwise(F.substring(plain_text(F.coalesce("body", F.lit(""))), 1, RSS_LENGTH))
    written = F.regexp_replace("published", "^[A-Za-z]+, ", "")
    published = F.coalesce(feed_time(F.col("published")), F.try_to_timestamp(written, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(written, F.lit("d MMM yyyy HH:mm:ss z")))
    rows = raw.select("source", "type", "source_ordinal", "file", "entry", "title", "url", content.alias("content"), published.alias("published_at"))
    special = F.lower("source").rlike("fleet|tracker")
    return rows.filter(F.when(is_json, _titled()).otherwise(special | on_topic()))


def first_of_url(articles: DataFrame) -> DataFrame:
    """The article that comes first of those with a URL: by source, file and entry."""
    kept = ("source", "title", "content", "published_at")
    return articles.groupBy("url").agg(F.min_by(F.struct(*kept), F.struct("source_ordinal", "file", "entry")).alias("a")).select("a.source", "a.title", "url", "a.content", "a.published_at")


def read_all(spark: SparkSession, sources: list[dict], bodies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles of all sources, one for each URL; (source, file, error) of what could not be read); sources: name, type, path."""
    raw = raw_entries(spark, sources)
    return first_of_url(articles_of(raw, bodies)), raw.filter("error is not null").select("source", "file", "error")


def stream_articles(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """The articles of files that are staged while the stream runs; a URL may come again (see streams.new_articles)."""
    return articles_of(raw_entries(spark, sources, stream=True)).select("source", "title", "url", "content", "published_at")


def unseen(articles: DataFrame, table: DataFrame) -> DataFrame:
    return articles.join(table.select("url"), "url", "left_anti")
