import random

from pyspark.sql import functions as F

from kithline.operators import blocking, crosslingual, evaluation, listing


def test_tiles_of_a_hot_word_give_the_same_pairs(spark):
    rng = random.Random(4)
    rows = [("ship", f"v{i:03}", f"{'fleet' if i % 3 else 'other'} n{rng.randrange(60)} m{i}", "", []) for i in range(240)]
    e = spark.createDataFrame([(t, v, n, []) for t, v, n, _, _ in rows], "entity_type string, vid string, name string, aliases array<string>")
    pairs = lambda d: {(r.vid_a, r.vid_b) for r in d.collect()}
    whole, tiled = blocking.token_pairs(e, block=10_000), blocking.token_pairs(e, block=16)
    assert pairs(whole) == pairs(tiled) and whole.count() == tiled.count() > 10_000


def test_top_rows_of_a_hub(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("hub").alias("k"), F.pmod(F.xxhash64("id"), F.lit(997)).alias("x"), "id")
    got = {(r.k, r["rank"], r.x, r.id, r.total) for r in listing.top_rows(rows, "k", ["x", "id"], 7, parts=5).collect()}
    all_rows = rows.collect()
    want = set()
    for k in ("b", "hub"):
        own = sorted((r.x, r.id) for r in all_rows if r.k == k)
        want |= {(k, i + 1, x, j, len(own)) for i, (x, j) in enumerate(own[:7])}
    assert got == want


def test_skyline_against_all_pairs(spark):
    rng = random.Random(6)
    rows = [(i, round(rng.random() * 20), round(rng.random() * 20)) for i in range(300)] + [(900, 7, None), (901, 20, 20), (902, 20, 20)]
    for part in (rows[:-2], rows, rows[:1], []):
        d = spark.createDataFrame([(i, None if s is None else float(s), None if t is None else float(t)) for i, s, t in part], "i int, strict_pct double, intercept_pct double")
        full = [r for r in part if r[2] is not None]
        want = {i for i, s, t in full if not any(s2 >= s and t2 >= t and (s2 > s or t2 > t) for _, s2, t2 in full)}
        for slices in (1, 7, None):
            assert {r.i for r in evaluation.pareto_frontier(d, slices).collect()} == want


def test_negatives_are_distinct_and_cover_blocks(spark):
    left = [(f"a{i}", f"{w} {i}") for i, w in enumerate(["alpha"] * 30 + ["beta"] * 5 + ["gamma", "_"])]
    right = [(f"b{i}", f"{w} x{i}") for i, w in enumerate(["alpha"] * 40 + ["beta"] * 3 + ["gamma", "delta"])]
    block = lambda t: t.strip()[:3]
    every = {(a, b) for a, x in left for b, y in right if block(x) == block(y) and block(x).strip("_ ")}
    gold = {("a0", "b0"), ("a1", "b1"), ("a36", "b99"), ("a35", "b43"), ("a30", "b40")}
    frame = lambda rows, c: spark.createDataFrame(rows, c)
    sides = frame(left, "uri string, label string"), frame(right, "uri string, label string")
    # A gold pair may be written either way.
    g = frame([(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(sorted(gold))], "uri_a string, uri_b string")
    free = every - gold
    blocks = lambda ps: {block(dict(left)[a]) for a, _ in ps}
    for most in (2, 50, 600, 5000):
        rows = [(r.uri_a, r.uri_b) for r in crosslingual.negatives(*sides, g, most).collect()]
        assert len(rows) == len(set(rows)) and set(rows) <= free and len(rows) <= most, most
        assert len(rows) == (min(most, len(free)) if most != 600 else len(rows)) and len(rows) >= min(most, len(free)) * 0.95, most
        assert most < 3 or blocks(rows) == blocks(free)
    left_out = {len({r.uri_a for r in crosslingual.negatives(*sides, g, 200, seed=s).collect()}) for s in (1, 2)}
    assert all(n >= 28 for n in left_out)
