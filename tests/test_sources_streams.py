import json

from pyspark.sql import functions as F

from kithline.sources import feeds, files
from kithline.streaming import streams

RSS = """<rss><channel>{}</channel></rss>"""
ITEM = "<item><title>{0}</title><link>{1}</link><description>{2}</description><pubDate>Mon, 01 Jan 2024 00:00:00 +0000</pubDate></item>"


def test_tab_separated(spark, tmp_path):
    p = tmp_path / "labels"
    p.write_text("u1\tone\nu2\tzwei\ttwo\nu1\tuno\tlast\nbad\n")
    assert {r.uri: (r.label, r.trans) for r in files.labels(spark, str(p)).collect()} == {"u1": ("uno", "last"), "u2": ("zwei", "two")}
    p.write_text("a\tb\na\tb\tc\nx/s\tp/P\to\n")
    assert files.alignment(spark, str(p)).count() == 1 and files.triples(spark, str(p)).count() == 2
    assert {r.uri: sorted(r.attributes) for r in files.attributes(spark, str(p), True).collect()}["x/s"] == ["o", "p"]


def test_json(spark, tmp_path):
    p = tmp_path / "pairs.json"
    p.write_text(json.dumps({"same_type_pairs": [{"pair_id": "1", "vid_a": "a", "type_a": "event", "props_a": {"k": "v"}}]}))
    r = files.pair_set(spark, str(p)).first()
    assert r.entity_type == "activity" and r.props_a == {"k": "v"} and r.props_b is None
    p.write_text(json.dumps({"records": [{"pair_id": "1", "final_label": "same"}, {"pair_id": "2", "final_label": "other"}]}))
    assert [tuple(r) for r in files.ground_truth(spark, str(p)).collect()] == [("1", 1)]
    p.write_text(json.dumps({"1": {"verdict": "same"}, "2": {"verdict": "different"}}))
    assert {r.key: r.verdict for r in files.keyed_json(spark, str(p), "struct<verdict:string>").collect()} == {"1": "same", "2": "different"}
    p.write_text(json.dumps({"equipment": [{"name": "x"}, {"name": "y"}]}))
    parts = files.import_file(spark, str(p))
    assert [(r.ordinal, r.name) for r in parts["equipment"].collect()] == [(0, "x"), (1, "y")] and parts["articles"].count() == 0
    v = spark.createDataFrame([("unified_v1",), ("unified_v3",), ("hybrid_v9",)], "version string")
    assert files.newest_version(v, "unified").first().version == "unified_v3"


def test_feeds(spark, tmp_path):
    p = tmp_path / "feed.xml"
    p.write_text(RSS.format("".join(ITEM.format(f"Navy {i}", f"u{i % 35}", "&lt;p&gt;text&lt;/p&gt;") for i in range(40)) + ITEM.format("cooking", "c", "x")))
    got = feeds.rss(spark, str(p), "daily").collect()
    assert len(got) == 30 and got[0].content == "text" and got[0].published_at is not None
    j = tmp_path / "g.json"
    j.write_text(json.dumps({"articles": [{"url": "a", "title": "Navy drill", "seendate": "20240131T120000Z"}, {"url": "b", "title": "Navy yoga day", "seendate": "x"}, {"url": "a", "title": "Navy drill", "seendate": ""}]}))
    bodies = spark.createDataFrame([("a", "<article>" + "word " * 60 + "</article>")], "url string, html string")
    rows = feeds.json_feed(spark, str(j), "g", bodies).collect()
    assert [r.url for r in rows] == ["a"] and rows[0].content.startswith("word word")
    known = spark.createDataFrame([("a",)], "name string")
    assert [r.name for r in feeds.new_sources(known, spark.createDataFrame([("a",), ("b",), ("b",)], "name string")).collect()] == ["b"]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([(f"u{i % 4}", i) for i in range(10)], "url string, n int")
    rows.repartition(3).write.json(str(src))
    stream = spark.readStream.schema("url string, n int").option("maxFilesPerTrigger", 1).json(str(src))
    spark.sql("drop table if exists kl_articles")
    streams.new_articles(spark, stream, "kl_articles", str(tmp_path / "c1")).awaitTermination()
    assert sorted(r.url for r in spark.table("kl_articles").collect()) == ["u0", "u1", "u2", "u3"]
    calls = []
    spark.sql("drop table if exists kl_counts")
    streams.retrain_every(stream, "kl_counts", 5, lambda: calls.append(1), str(tmp_path / "c2")).awaitTermination()
    assert spark.table("kl_counts").agg(F.sum("n")).first()[0] == 10 and calls
    for t in ("kl_articles", "kl_counts"):
        spark.sql(f"drop table {t}")


def test_stateful_streams_equal_batch(spark, tmp_path):
    src = tmp_path / "pos"
    rows = spark.range(60).select(F.concat(F.lit("v"), (F.col("id") % 5).cast("string")).alias("vid"), F.col("id").cast("double").alias("lat"), F.lit(0.0).alias("lng"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=(F.col("id") * 7 % 60).cast("int"))).alias("reported_at"))
    rows.repartition(4).write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).parquet(str(src))

    def ran(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return {tuple(r) for r in spark.table(name).collect()}

    assert ran(streams.latest_positions(stream), "complete", "kl_latest") == {tuple(r) for r in streams.latest_positions(spark.read.parquet(str(src))).collect()}
    sliding = ran(streams.sliding_counts(stream, "reported_at", "1 day", "12 hours"), "complete", "kl_sliding")
    assert sum(r[-1] for r in sliding) == 120
    assert sum(r[-1] for r in ran(streams.sessions(stream, "vid", "reported_at"), "complete", "kl_sessions")) == 60
    assert len(ran(streams.distinct_within(stream, "vid", "reported_at", "10 days"), "append", "kl_distinct")) == 5
