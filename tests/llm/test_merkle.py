import hashlib
import zlib

from pyspark.sql import functions as F

from kithline.llm.merkle import audit, lower_ascii, merkle_manifest
from tests.llm.common import ROWS, documents

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(leaves, fanout):
    """(root, siblings before and after each leaf, level by level)"""
    paths, owners, level = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(level) > 1:
        up, own = [], []
        for k in range(0, len(level), fanout):
            run = level[k: k + fanout]
            for j in range(len(run)):
                for o in owners[k + j]:
                    paths[o].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(_h(*run))
            own.append([o for x in owners[k: k + fanout] for o in x])
        level, owners = up, own
    return level[0], paths


def brute(rows, fanout=8):
    """rows: (doc_id, source, lang, n_chars, text)"""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _h(*map(_field, r)), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: (sorted(by[g], key=lambda x: x[:3]), None) for g in langs}
    trees = {g: (own, _tree([x[2] for x in own], fanout)) for g, (own, _) in trees.items()}
    root, upper = _tree([trees[g][1][0] for g in langs], fanout) if langs else (None, [])
    out = []
    for g, high in zip(langs, upper, strict=True):
        own, (sub, paths) = trees[g]
        for (_, _, leaf, r), path in zip(own, paths, strict=True):
            path = path + high
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if bad else r[4]
            h = _h(*map(_field, (*r[:4], low)))
            for a, b in path:
                h = _h(a, h, b)
            out.append((r[0], leaf, sub, root, _h(*(a + b for a, b in path)), h, h == root))
    return out


def _audit(docs, fanout=8):
    return audit(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower_ascii(F.col("text")), fanout)


def _same(docs, fanout=8):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in _audit(docs, fanout).collect()), key=repr)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert got == sorted(brute(rows, fanout), key=repr)
    return got


def test_against_brute_force(spark):
    got = _same(documents(spark, ROWS + [(100 + i, f"Text {i}") for i in range(9)]))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_many_levels_and_a_hot_lang(spark):
    rows = [(i, f"s{i % 3}", "en" if i % 10 else (None if i % 20 else f"l{i % 7}"), i, f"Text {i}") for i in range(700)] + [(7, "s", "en", None, "Same")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    _same(docs)
    _same(docs, 2)


def test_lone_leaf_and_no_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = spark.createDataFrame([(1, None, None, None, None)], schema)
    got = _same(one)
    assert got[0][1] == got[0][2] == got[0][3] == _h("1:1----")
    assert _audit(spark.createDataFrame([], schema)).collect() == []


def test_a_path_leads_to_the_root_of_its_manifest_only(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    rows = [(i, None, "en", 1, "a") for i in range(20)]
    first = merkle_manifest(spark.createDataFrame(rows, schema)).select("root").distinct().collect()
    other = merkle_manifest(spark.createDataFrame(rows[:-1] + [(19, None, "en", 1, "b")], schema)).select("root").distinct().collect()
    assert len(first) == len(other) == 1 and first != other
