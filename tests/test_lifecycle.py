import datetime as dt

from kithline import catalogue, catalogue_plans
from kithline.streaming import lifecycle

DATA = "/root/testdata/sf0.001"


def test_moves_of_one_article():
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    run = lambda events, until=None: [(w, n, y) for _, w, n, y in lifecycle.moved(None, None, events, dt.timedelta(hours=6), until)[0]]
    assert run([(t(0), "arrived", True), (t(1), "claimed", True), (t(2), "reset", True), (t(3), "claimed", True)]) == [(None, "failed", "arrived"), ("failed", "pending", "reset"), ("pending", "processing", "claimed")]
    assert run([(t(0), "claimed", False), (t(1), "arrived", False), (t(2), "claimed", False), (t(3), "extracted", False), (t(4), "claimed", False)])[-1] == ("processing", "done", "extracted")
    late = [(t(0), "arrived", False), (t(1), "claimed", False), (t(8), "extracted", False)]
    assert run(late)[-1] == ("processing", "pending", "timeout") and len(run(late)) == 3
    assert run(late[:2], t(7))[-1][2] == "timeout" and run(late[:2], t(6))[-1][2] == "claimed"
    assert run([(t(0), "arrived", False), (t(1), "claimed", False), (t(2), "no_result", False)])[-1][1] == "pending"
    assert run([(t(0), "arrived", False), (t(1), "claimed", False), (t(2), "error", False)])[-1][1] == "failed"


def test_stream_equals_batch(spark):
    rows = lambda d: sorted((r.article_id, str(r["at"]), str(r.was), r.now, r.why) for r in d.collect())
    want = rows(lifecycle.transitions_of(catalogue_plans._article_events(spark, DATA), dt.timedelta(hours=6)))
    got = rows(catalogue.queries()["stream_article_status"](spark, DATA))
    assert got == want and {"timeout", "claimed", "extracted", "error", "no_result", "reset"} <= {r[4] for r in got}


def test_a_stopped_stream_writes_each_row_once(spark):
    out = catalogue.queries()["stream_resumed"](spark, DATA).collect()
    ids = [r.event_id for r in out]
    assert sorted(ids) == sorted(r.event_id for r in spark.read.parquet(f"{DATA}/events.parquet").collect()) and len(set(ids)) == len(ids)
