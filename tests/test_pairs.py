"""Queries on rows that the given tables lack: alike parts, whose pairs are compared once, ties, and pages of one URL."""

import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from kithline import catalogue, catalogue_plans  # noqa: F401  (the second adds its queries to the first)

from kithline.operators import blocking
from kithline.plans import fusion

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_features_of_a_pair_normalise_each_side_once(spark):
    shown = plan(catalogue.queries()["every_pair_feature"](spark, DATA))
    assert shown.count("transform_values(") == 2


@pytest.fixture(scope="module")
def alike(tmp_path_factory):
    """Every part of DATA five times, with keys that go on."""
    d = str(tmp_path_factory.mktemp("alike"))
    duckdb.connect().execute(f"copy (select * replace (p_partkey + i * 200 as p_partkey) from '{DATA}/part.parquet', range(5) r(i)) to '{d}/part.parquet' (format parquet)")
    return d


def same_as_sql(spark, d, name):
    db = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = catalogue.queries()[name](spark, d)
    cell = lambda v: round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    want = Counter(tuple(map(cell, r)) for r in db.execute(f"select {', '.join(df.columns)} from ({catalogue.oracle_sql()[name]})").fetchall())
    return Counter(tuple(map(cell, r)) for r in df.collect()) == want


def test_pairs_of_kinds_are_all_pairs(spark):
    rows = [(k * 7 % 101, "xyz"[k % 3], k % 2) for k in range(60)]
    e = spark.createDataFrame(rows, "key int, kind string, other int")
    want = Counter((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2])
    for block in (1000, 4):
        met = blocking.kind_pairs(blocking.kind_tiles(e, "key", ["kind", "other"], block), ["other"])
        assert Counter((r.x, r.y) for r in blocking.each_pair(met, "x", "y").collect()) == want
        assert met.agg(F.sum(blocking.pair_count())).first()[0] == sum(want.values())
        assert block > 10 or met.select(F.max(F.size("keys_a"))).first()[0] < 10


@pytest.mark.parametrize("name", ["field_results", "property_feature_long", "fusion_summary", "expert_bucket", "l1_accuracy_report", "l1_decision_distribution", "per_type_accuracy"])
def test_alike_parts_are_compared_once(spark, alike, monkeypatch, name):
    assert same_as_sql(spark, alike, name)
    seen, prepared = [], fusion.prepared
    monkeypatch.setattr(fusion, "prepared", lambda pairs, *a: seen.append(pairs.count()) or prepared(pairs, *a))
    for d in (DATA, alike):
        catalogue.queries()[name](spark, d)
    # Five times the parts are 25 times the pairs, but no more kinds; kinds meet both ways, and themselves.
    assert seen[1] <= 2 * seen[0] + spark.read.parquet(f"{DATA}/part.parquet").count()


@pytest.mark.parametrize("name", ["effective_fields", "l1_pair_scores", "property_diff"])
def test_pairs_come_after_comparisons(spark, alike, name):
    assert same_as_sql(spark, alike, name)
    lines = plan(catalogue.queries()[name](spark, alike)).splitlines()
    made = [i for i, x in enumerate(lines) if "Generate explode(keys_" in x]
    # Plans are read from below.
    assert len(made) == 2 and max(made) < min(i for i, x in enumerate(lines) if "transform(" in x or "map_keys(" in x)


def test_days_at_a_half(spark, tmp_path):
    """2825064 seconds are 32.6975 days, 1000 times which is below 32697.5 as a double."""
    duckdb.connect().execute(f"copy (select i + 1 as event_id, timestamp '2024-01-28 07:15:36.3' - i * interval 216 second as ts from range(500) r(i)) to '{tmp_path}/events.parquet' (format parquet)")
    assert same_as_sql(spark, str(tmp_path), "feed_times")


def test_pages_of_one_url(spark, tmp_path):
    html = ["<p>a  b</p><script>x</script>", "<p>a  b</p>", "no  tag ", None]
    rows = ", ".join(f"({i}, {u}, {'null' if h is None else repr(h)})" for i, (u, h) in enumerate((u, h) for u in ("'u1'", "'u1'", "'u2'", "null") for h in html))
    duckdb.connect().execute(f"copy (select * from (values {rows}) t(page_id, url, html)) to '{tmp_path}/pages.parquet' (format parquet)")
    assert same_as_sql(spark, str(tmp_path), "import_articles")
