import json

from kithline.sources import feeds, staged
from kithline.streaming import streams

ITEM = "<item><title>{0}</title><link>{1}</link><description>{2}</description><pubDate>Mon, 01 Jan 2024 00:00:00 {3}</pubDate></item>"


def rss(*items):
    return "<rss xmlns:c='urn:c'><channel><title>x</title>" + "".join(items) + "</channel></rss>"


def sources(tmp_path):
    return [{"name": "daily", "type": "rss", "path": str(tmp_path / "daily")}, {"name": "fleet tracker", "type": "rss", "path": str(tmp_path / "tracker.xml")},
            {"name": "api", "type": "json", "path": f"file://{tmp_path}/api"}, {"name": "gone", "type": "json", "path": str(tmp_path / "no")}, {"name": "w", "type": "web", "path": ""}, {"name": "odd", "type": "ftp", "path": ""}]


def test_all_sources_at_once(spark, tmp_path):
    (tmp_path / "daily").mkdir(), (tmp_path / "api").mkdir()
    many = [ITEM.format(f"Navy {i}", f"u{i}" if i else "", "&lt;p&gt;text&lt;/p&gt;", "GMT") for i in range(40)]
    (tmp_path / "daily/a.xml").write_text(rss(*many))
    (tmp_path / "daily/b.xml").write_text(rss("<item><title>Navy</title><link>full</link><c:encoded>whole &lt;b&gt;text&lt;/b&gt;</c:encoded><description>short</description></item>", ITEM.format("cooking", "c", "x", "GMT"), ITEM.format("again Navy", "u5", "", "GMT")) + "<broken>")
    (tmp_path / "daily/_hidden.xml").write_text("no xml")
    (tmp_path / "tracker.xml").write_text("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>cooking</title><link href='t1'/><summary>x</summary><updated>2024-01-31T12:00:00Z</updated></entry></feed>")
    (tmp_path / "api/a.json").write_text(json.dumps({"articles": [{"url": "j1", "title": "Navy drill", "seendate": "20240131T120000Z"}, {"url": "j2", "title": "Navy yoga day"}, {"url": "j3", "title": None}, {"url": None, "title": "Navy"}, {"url": "u6", "title": "Navy again"}, {"url": "j4", "title": "Navy", "seendate": 5}]}))
    (tmp_path / "api/b.json").write_text("[not json")
    bodies = spark.createDataFrame([("j1", "<article>" + "word " * 60 + "</article>")], "url string, html string")
    found, errors = feeds.read_all(spark, sources(tmp_path), bodies)
    rows = {r.url: r for r in found.collect()}
    assert set(rows) == {f"u{i}" for i in range(1, 30)} | {"full", "t1", "j1", "j4"}
    assert rows["u5"].title == "Navy 5" and rows["u6"].source == "daily" and rows["u7"].content == "text" and rows["full"].content == "whole text"
    assert rows["j1"].content.startswith("word word") and rows["j4"].content == "" and rows["j4"].published_at is None
    assert str(rows["t1"].published_at) == str(rows["j1"].published_at) and rows["u7"].published_at is not None
    failed = {(r.source, (r.file or "").rpartition("/")[2]): r.error for r in errors.collect()}
    assert set(failed) == {("daily", "b.xml"), ("api", "b.json"), ("gone", ""), ("odd", "")} and failed["gone", ""].startswith("FileNotFoundError")


def test_no_sources(spark):
    found, errors = feeds.read_all(spark, [])
    assert found.count() == 0 and errors.count() == 0


def test_a_task_has_few_files_of_one_source(tmp_path):
    for i in range(staged.FILES_PER_TASK * 2 + 1):
        (tmp_path / f"{i:04}.xml").write_text(rss(ITEM.format("Navy", f"u{i}", "", "GMT")))
    parts = staged._Batch([{"name": "hot", "type": "rss", "path": str(tmp_path)}]).partitions()
    assert sorted(len(p.files) for p in parts) == [1, staged.FILES_PER_TASK, staged.FILES_PER_TASK]
    assert {r[6] for p in parts for r in staged.decoded(p)} == {f"u{i}" for i in range(staged.FILES_PER_TASK * 2 + 1)}


def test_stream_goes_on_behind_the_last_file(spark, tmp_path):
    (tmp_path / "daily").mkdir(), (tmp_path / "api").mkdir()
    own = sources(tmp_path)
    (tmp_path / "daily/1.xml").write_text(rss(ITEM.format("Navy 1", "u1", "", "GMT"), ITEM.format("Navy 2", "u2", "", "GMT")))
    spark.sql("drop table if exists kl_staged")
    run = lambda: streams.new_articles(spark, feeds.stream_articles(spark, own), "kl_staged", str(tmp_path / "check")).awaitTermination()
    seen = lambda: sorted((r.url, r.title) for r in spark.table("kl_staged").collect())
    run()
    assert seen() == [("u1", "Navy 1"), ("u2", "Navy 2")]
    (tmp_path / "daily/1.xml").write_text(rss(ITEM.format("Navy 9", "u9", "", "GMT")))  # read before, not read again
    (tmp_path / "daily/2.xml").write_text(rss(ITEM.format("Navy changed", "u2", "", "GMT"), ITEM.format("Navy 3", "u3", "", "GMT")))
    (tmp_path / "api/1.json").write_text(json.dumps({"articles": [{"url": "j1", "title": "Navy drill"}]}))
    run()
    run()
    assert seen() == [("j1", "Navy drill"), ("u1", "Navy 1"), ("u2", "Navy 2"), ("u3", "Navy 3")]
    spark.sql("drop table kl_staged")
