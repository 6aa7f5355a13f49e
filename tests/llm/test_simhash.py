import random

import numpy as np
import pytest
import xxhash

from kithline.llm import simhash as module
from tests.llm.common import ROWS, documents, rows_of


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [words[i: i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, ids):
    n = len(prints)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least.get(root(i)) for i in range(n)]


def test_equals_brute_force(spark):
    prints = [brute_print(t) for _, t in ROWS]
    comps = brute_components(prints, [i for i, _ in ROWS])
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(ROWS, prints, comps, strict=True)), key=repr)
    assert rows_of(module.near_duplicates(documents(spark, ROWS)), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("limit", [0, 4, 1000])
def test_links_reach_what_all_pairs_reach(spark, limit):
    from kithline.llm.components import components

    rng = random.Random(5)
    prints = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    values = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {r.node: r.component for r in components(module.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), bucket_limit=limit)).collect()}
    got = {}
    for v in values:
        got.setdefault(found.get(v, v), set()).add(v)
    comps = brute_components([v & (1 << 64) - 1 for v in values], values)
    want = {}
    for v, c in zip(values, comps, strict=True):
        want.setdefault(c, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_bit_counts():
    h = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.int64).astype(np.uint64)
    assert module._bit_counts(h).tolist() == [int(((h >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]


def test_long_text_in_runs_equals_whole(monkeypatch):
    from kithline.llm import words

    text = " ".join(f"w{i % 53}" for i in range(5000))
    whole = module.fingerprint(text)
    monkeypatch.setattr(module, "word_runs", lambda t: words.word_runs(t, 100))
    assert module.fingerprint(text) == whole


def test_empty_table_and_drop(spark):
    assert module.near_duplicates(documents(spark, [])).collect() == []
    docs = documents(spark, [(2, "a b c d"), (1, "a b c d"), (None, "a b c d"), (3, "wholly other words here")])
    kept = module.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 3, None]
