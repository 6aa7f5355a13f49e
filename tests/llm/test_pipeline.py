import hashlib
import os
import random
import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kithline.llm.queries import oracle_sql, queries
from tests.llm import test_decontaminate, test_similar
from tests.llm.common import ROWS, documents

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and left, name
        ids = left
        if name != "bpe":
            assert docs.columns == columns
    assert ids == {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()}


def test_stages_take_no_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).collect() == []


def test_registry():
    names = set(queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(oracle_sql()) <= names
    assert os.path.exists(DATA)


def _fixture():
    """(rows, labels, items): toxic texts that any model tells, copies, near copies, leaks, and edge rows."""
    rng = random.Random(12)
    plain = [f"{a}{b}" for a in ("th", "an", "re", "on", "qu", "st") for b in ("e", "ing", "at", "ou", "er")]
    items = [(k, " ".join(f"{rng.choice(plain)}{k}" for _ in range(30))) for k in range(5)] + [(9, None)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) + rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(("grobnik", "zutfark", "vexlumpo")))
        elif i % 4 == 1 and i > 40:
            words = rows[i - rng.choice((4, 8, 12))][1].split()
            if i % 8 == 1:
                words[rng.randrange(len(words))] = "changed"
        elif i % 23 == 2:
            words[3:3] = rng.choice(items[:5])[1].split()
        rows.append((i, ("  " if i % 5 else " ").join(words)))
        labels.append((i, 0, int(toxic)))
    return rows + [(i if i is None else 1000 + i, t) for i, t in ROWS], labels, items


def _brute(rows, items):
    """The stages after toxicity, on (doc_id, text)."""
    first = {}
    for i, t in rows:
        k = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).digest()
        if k not in first or (first[k][0] is None and i is not None) or (i is not None and i < first[k][0]):
            first[k] = (i, t)
    rows = sorted(first.values(), key=repr)
    stay = test_similar.brute(rows)
    rows = [r for r in rows if r[0] in stay]
    leaks = {i for i, *_ in test_decontaminate.brute(rows, items)}
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, t in rows:
        if i not in leaks:
            ids = own.encode(t or "", add_special_tokens=False).ids
            out.append((i, len(ids), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_run_equals_brute_force(spark, tmp_path):
    rows, labels, items = _fixture()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [(i, t) for i, t in rows if i is None or i % 4 or i >= 400]
    assert sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got), key=repr) == _brute(kept, items)


def test_stages_on_edge_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns, in every stage."""
    _, labels, items = _fixture()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, ROWS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        n = out.agg(F.count("*")).first()[0]
        assert 0 < n <= len(ROWS), name
        assert out.columns == docs.columns or name == "bpe" and n == len(ROWS)
