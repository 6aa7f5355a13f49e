import random
import re

from pyspark.sql import functions as F

from kithline.llm.license_scan import scan_licenses, templates
from kithline.llm.secret_scan import scan_secrets
from tests.llm.common import ROWS, documents, rows_of

KEY = "AKIA" + "ABCD1234EFGH5678"
TEXTS = [
    "password=abcdefghijklmnop", "token: password: abcdefghijklmnop", 'API_KEY = "abcd1234abcd1234abcd"', "é😀 Secret : 'a.b/c=d-e_f+g0h1'", f"x {KEY} {KEY[:12]} AKIA", "0123456789abcdef0123456789abcdef0 abc",
    f"passwd={KEY}", "tokén=abcdefghijklmnop", "password=shared-example-value1", "aPi_KeY:  x" + "y" * 30, "deadbeefdeadbeef" * 3,
]


def brute_base(text):
    text = text or ""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end(), "assign"))
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_secrets(spark):
    rows = ROWS + [(100 + i, t) for i, t in enumerate(TEXTS)] + [(300, "password=shared-example-value1"), (301, "password=shared-example-value1")]
    got = scan_secrets(documents(spark, rows))
    assert rows_of(got, "doc_id", "base") == sorted(((i, brute_base(t)) for i, t in rows), key=repr)
    by = {r.doc_id: r for r in got.collect()}
    assert all(set(filter(None, r.base.split(","))) <= set(r.spans.split(",")) for r in by.values())
    # A value that several owners have gets no span of its own, one of a single owner does.
    assert by[108].n_live == 0 and by[108].n_assign == 1
    assert by[100].n_live == 1 and by[100].spans == "assign:0:25,live:9:25"
    assert scan_secrets(documents(spark, [])).collect() == []


def test_live_keys_are_told_from_examples(spark):
    """Keys of one repository, examples of many owners, one owner's own example, and long words that are no keys."""
    rng = random.Random(5)
    letters = "ABCDEFGHJKMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789"
    key = lambda n: "".join(rng.choice(letters) for _ in range(n))
    live, examples, own = [key(32) for _ in range(60)], [key(32) for _ in range(5)], key(32)
    rows, planted = [], set()
    for i in range(240):
        text = [f"{rng.choice('ghi')}{rng.choice('JKL')}1" * 9, "/usr/lib/python3/dist-packages", f"Chapter-heading-{chr(103 + i % 10)}-without-digits", "ALLCAPSANDDIGITS1234567890X"]
        if i % 4 == 0:
            text.insert(rng.randrange(4), live[i // 4])
            planted.add((i, live[i // 4]))
        if i % 5 == 0:
            text.insert(rng.randrange(4), "token=" + examples[i // 5 % 5])
        if i % 8 == 1:
            text.append(own)
        rows.append((i, " ".join(text), f"l{i % 4 if i % 8 != 1 else i // 8 % 4}", "owner0" if i % 8 == 1 else f"owner{i % 7}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = scan_secrets(docs, "source", F.concat_ws("/", "source", "lang")).collect()
    texts = {i: t for i, t, _, _ in rows}
    found = {(r.doc_id, texts[r.doc_id][int(a): int(b)]) for r in got for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "live"}
    # One key has no digit; nothing else is taken for a key.
    assert found <= planted and len(found) == len(planted) - 1
    assert all(r.n_copied >= (r.doc_id % 5 == 0) + (r.doc_id % 8 == 1) for r in got)
    assert {r.repositories for r in got if r.doc_id % 8 == 1 and r.doc_id % 5} == {4}


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 cc by nc CC-BY-NC", "the GNU General Public License, version 3",
    "apache license version 2 apache license version 2", "cc by", "under the mit, license", "é under the mit license", "Licensed under the really old Apache License Version 2.0", "GNU General Public License",
]


def brute_licenses(text):
    t = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i: i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    rows = ROWS + [(100 + i, t) for i, t in enumerate(NOTICES)]
    got = scan_licenses(documents(spark, rows))
    want = sorted(((i, *brute_licenses(t)) for i, t in rows), key=repr)
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    by = {r.doc_id: r for r in got.collect()}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in by.values())
    assert by[103].labels == "gpl-3" and by[103].score == 1
    assert by[109].labels == "" and 0 < by[109].score < 0.8
    # Two words in between move the rest to a neighbouring diagonal.
    assert "apache-2" in by[108].labels
    assert scan_licenses(documents(spark, [])).collect() == []


def test_whole_notices(spark):
    """Notices with words added, left out and in between are found; their words in another order are not."""
    rng = random.Random(7)
    rows, want = [], {}
    for i, (words, label) in enumerate(t for t in templates() if len(t[0]) > 25):
        own = list(words)
        for _ in range(len(own) // 30):
            at = rng.randrange(len(own))
            own[at: at + rng.randrange(2)] = [f"new{i}"] * rng.randrange(1, 3)
        rows.append((i, "Copyright 2020 somebody. " + " ".join(own).upper() + " and then the code"))
        want[i] = label
        rows.append((100 + i, " ".join(x for k in range(0, len(words) - 5, 6) for x in words[len(words) - k - 6: len(words) - k])))
        rows.append((200 + i, " ".join(words[: len(words) // 2])))
    got = {r.doc_id: r for r in scan_licenses(documents(spark, rows)).collect()}
    assert len(want) >= 11 and all(label in got[i].labels.split(",") for i, label in want.items())
    assert all(label not in got[100 + i].labels.split(",") for i, label in want.items() if label in ("bsd-2", "bsd-3", "isc", "zlib", "gpl-2"))
    assert all(want[i] not in got[200 + i].labels.split(",") for i in want if want[i] not in ("mit", "apache-2", "unlicense"))
