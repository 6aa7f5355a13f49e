import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kithline.llm import exact_dedup as module
from tests.llm.common import ROWS, documents, rows_of


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        free = True
        for i in ids:
            out.append((i, keep, len(ids), free and i == keep, sha))
            free = free and i != keep
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_equals_brute_force(spark, block):
    rows = [(i, t if t is None or len(t) < 2000 else t[:900]) for i, t in ROWS] if block < 4096 else ROWS
    assert rows_of(module.exact_dedup(documents(spark, rows), block), *COLUMNS) == brute(rows)


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(module, "_hash", lambda b: F.pmod(F.xxhash64(b), F.lit(3)))
    rows = [(i, f"text {i % 7} {'tail ' * (i % 3)}") for i in range(30)]
    assert rows_of(module.exact_dedup(documents(spark, rows), 4), *COLUMNS) == brute(rows)


def test_empty_table(spark):
    assert module.exact_dedup(documents(spark, [])).collect() == []


def test_drop_keeps_columns_and_one_row_of_each(spark):
    docs = documents(spark, ROWS)
    kept = module.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    want = sorted((r[0] for r in brute(ROWS) if r[3]), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want
