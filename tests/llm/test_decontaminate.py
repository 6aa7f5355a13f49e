import random

import pytest

from kithline.llm import decontaminate as module
from tests.llm.common import ROWS, documents, rows_of

COLUMNS = ("doc_id", "item_id", "n_shared", "n_shingles")


def grams(words, n):
    return {tuple(words[i: i + n]) for i in range(len(words) - n + 1)}


def brute(rows, items):
    out = []
    for item, t in items:
        w = (t or "").encode().lower().split()
        if w:
            n = min(5, len(w))
            own = grams(w, n)
            for i, d in rows:
                shared = len(own & grams((d or "").encode().lower().split(), n))
                if shared >= 0.8 * len(own) - 1e-9:
                    out.append((i, item, shared, len(own)))
    return sorted(out, key=repr)


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_edge_rows(spark):
    items = [(1, "a b c"), (2, None), (3, ""), (4, "one"), (5, "Word0x0 word1x1 word2x2 word3x3 word4x4 word5x5"), (5, "two words"), (None, "other text here")]
    assert rows_of(module.contaminated(documents(spark, ROWS), _items(spark, items)), *COLUMNS) == brute(ROWS, items)
    assert module.contaminated(documents(spark, []), _items(spark, items)).collect() == []
    assert module.contaminated(documents(spark, ROWS), _items(spark, [])).collect() == []


@pytest.mark.parametrize("block", [20_000, 7])
def test_planted_items(spark, block, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_ITEMS", block)
    rng = random.Random(4)
    items = [(k, " ".join(f"i{k}w{rng.randrange(50)}" for _ in range(rng.choice((3, 5, 6, 9, 20, 40, 90))))) for k in range(40)]
    rows = []
    for i in range(150):
        words = [f"r{rng.randrange(100)}" for _ in range(rng.randrange(1500))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items)[1].upper().split()
            edit = rng.randrange(4)
            if edit == 1:
                w[rng.randrange(len(w))] = "x"
            if edit == 2:  # in two places of the document
                half = len(w) // 2
                words[:0] = w[: half + 4]
                w = w[half:]
            if edit == 3:
                w = w[: max(1, len(w) * 9 // 10)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = w
        rows.append((i, " ".join(words)))
    docs = documents(spark, rows)
    want = brute(rows, items)
    assert want and rows_of(module.contaminated(docs, _items(spark, items)), *COLUMNS) == want
    clean = module.drop_contaminated(docs, _items(spark, items))
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted({i for i, _ in rows} - {w[0] for w in want})
