import random

import pytest

from kithline.llm import similar as module
from tests.llm.common import ROWS, documents


def brute(rows, t=0.8):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i: i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((i for (i, _), h in zip(rows, group, strict=True) if h == g and i is not None), default=None) for g in group}
    gone = {i for (i, _), g in zip(rows, group, strict=True) if i is not None and least[g] < i}
    return sorted((i for i, _ in rows if i not in gone), key=repr)


def _near_copies():
    rng, rows = random.Random(4), list(ROWS)
    for g in range(6):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randrange(40, 120))]
        for k in range(14):
            own = list(words)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10_000)}"
            rows.append((100 + 20 * g + k, " ".join(own)))
    return rows


@pytest.mark.parametrize("limit", [4, 64])
def test_equals_brute_force(spark, limit):
    rows = _near_copies()
    kept = module.drop_similar(documents(spark, rows), bucket_limit=limit)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == brute(rows)


def test_stage_drops_a_copy_with_one_changed_word(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    docs = documents(spark, [(1, " ".join(words)), (2, " ".join(words[:50] + ["other"] + words[51:]))])
    assert [r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()] == [1]


def _crowd(n=150):
    """Near copies of one text of which most are unlike each other, but that its words stand in."""
    rng = random.Random(9)
    words = [f"b{i}" for i in range(110)]
    rows = []
    for k in range(n):
        own = list(words)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 6, 7))):
            own[rng.randrange(len(own))] = f"n{rng.randrange(100_000)}"
        if k % 5 == 1:  # a copy of a far copy
            own = rows[rng.randrange(len(rows))][1].split()
            own[rng.randrange(len(own))] = f"c{k}"
        rows.append((1000 + k, " ".join(own)))
    return rows


@pytest.mark.parametrize("limit", [8, 64])
def test_crowd_equals_brute_force(spark, limit):
    rows = _crowd() + _near_copies()
    kept = module.drop_similar(documents(spark, rows), bucket_limit=limit)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == brute(rows)


def test_a_crowd_makes_no_pairs_of_all_unlike_sets(spark):
    """Unlike sets of one crowd meet only if they share enough of what differs from its leading set."""
    rng, base = random.Random(3), list(range(1, 141))
    sets, crowds = {}, []
    for node in range(400):
        gone = rng.sample(base, 25 if node else 0)
        own = sorted({*base, *(rng.randrange(10_000, 10**9) for _ in gone)} - set(gone))
        sets[node] = own
        crowds.append((0, node, len(own), node))
    sets[400] = sorted({*sets[399], 7} - {sets[399][-1]})
    crowds.append((0, 400, len(sets[400]), 400))
    found = module._differences(spark.createDataFrame(crowds, "crowd long, node long, size long, label long"), spark.createDataFrame([(k, v) for k, v in sets.items()], "node long, shingles array<long>"), 0.8)
    pairs = {(r.a, r.b) for r in module._crowd_pairs(found, 0.8).collect()}
    assert (399, 400) in pairs and len(pairs) < 400


def test_fingerprints_bring_pairs_to_the_comparison(spark):
    nodes = spark.createDataFrame([(1, 100, 5), (2, 100, 5), (3, 100, 7), (4, 100, 5 ^ 7 << 20), (5, 10, 5)], "node long, size long, fp long")
    assert {(r.a, r.b) for r in module.fingerprint_pairs(nodes, 0.8).collect()} == {(1, 2), (1, 3)}
    docs = documents(spark, [(1, "a b c d e f g"), (2, "A b  c d e f g")])
    got = module.signatures(docs).collect()
    assert got[0].fp == got[1].fp != 0
