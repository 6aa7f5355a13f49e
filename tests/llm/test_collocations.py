import random
import re
from collections import Counter

from kithline.llm.collocations import collocations, phrase_counts
from tests.llm.common import ROWS, documents

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
SCHEMA = "doc_id long, text string, lang string"


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def _counts(rows):
    """Counts of the phrases of one to four words, and of all words, for each lang."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _lower(text or "")):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i: i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least=30, top=2000):
    f, n = _counts(rows)
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *w), a in found.items():
        if any(len(q) > len(w) + 1 and q[0] == lang and 100 * b >= 80 * a and any(q[1 + i: 1 + i + len(w)] == tuple(w) for i in range(len(q) - len(w))) for q, b in found.items()):
            continue
        cuts = [(2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score))
    return sorted((lang, i + 1, *x[3:]) for lang, own in out.items() for i, x in enumerate(sorted(own)[:top]))


def _rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def _corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["new", "york", "New", "city", "of", "the", "é", "ö x", "a", "b"]
    make = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; "]) for _ in range(rng.randrange(0, 40)))
    return [(i, rng.choice([make(), make() + " new york city of the", "a a a a a a", None, ""]), rng.choice(["en", "en", "de", None, "und"])) for i in range(n)]


def test_against_brute_force(spark):
    rows = _corpus(1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute([(lang, t) for _, t, lang in rows])
    assert want and _rows(collocations(docs)) == want
    # Shards of a few texts and a bitmap that nearly all phrases pass give the same rows.
    assert _rows(collocations(docs, shard_bytes=500, largest_bitmap=1)) == want
    assert _rows(collocations(docs, least=300, top=3)) == brute([(lang, t) for _, t, lang in rows], 300, 3)


def test_counts_are_exact(spark):
    rows = _corpus(2)
    f, n = _counts([(lang, t) for _, t, lang in rows])
    got = {(r.lang, r.phrase): r.f for r in phrase_counts(spark.createDataFrame(rows, SCHEMA), least=5).collect()}
    want = {(p[0], " ".join(p[1:])): a for p, a in f.items() if a >= 5} | {(lang, ""): a for lang, a in n.items() if a}
    assert got == want


def test_edge_rows(spark):
    docs = documents(spark, ROWS)
    want = brute([(r.lang, r.text) for r in docs.select("lang", "text").collect()], 3, 50)
    assert want and _rows(collocations(docs, least=3, top=50)) == want
    assert collocations(documents(spark, [])).collect() == []
    assert collocations(documents(spark, [(1, None), (2, " ., ")])).collect() == []


def test_counts_travel_in_a_row_for_each_bucket():
    import numpy as np

    from kithline.llm.collocations import _packed

    phrases = [f"w{i} é".encode() for i in range(2000)]
    packed = [_packed(lang, np.full(2000, 2, np.int32), phrases, np.arange(2000), 4).to_pylist() for lang in ("en", "de")]
    assert all(len(rows) <= 16 for rows in packed)
    assert sorted((p.encode(), f) for r in packed[0] for p, f in zip(r["phrases"], r["counts"], strict=True)) == sorted(zip(phrases, range(2000), strict=True))
    assert [(r["bucket"], r["phrases"]) for r in packed[0]] == [(r["bucket"], r["phrases"]) for r in packed[1]]
