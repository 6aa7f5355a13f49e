import random
import re

import numpy as np
import pyarrow as pa
import pytest

from kithline.llm import passages
from kithline.llm.substring_dedup import COVER, PERIOD, substring_dedup
from kithline.llm.suffix_dedup import suffix_dedup
from kithline.llm.words import Words, pieces
from tests.llm.common import ROWS, documents, rows_of

COLUMNS = ("doc_id", "n_words", "n_removed", "kept")


def brute(rows, window=50):
    first, cut = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in cut:
        for p in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[p: p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in cut:
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p: p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("dedup", [substring_dedup, suffix_dedup])
def test_edge_rows(spark, dedup):
    assert rows_of(dedup(documents(spark, ROWS)), *COLUMNS) == brute(ROWS)
    assert dedup(documents(spark, [])).collect() == []


@pytest.mark.parametrize("dedup", [substring_dedup, suffix_dedup])
@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, dedup, seed):
    rng = random.Random(seed)
    passages = [[f"p{k}w{rng.randrange(200)}" for _ in range(n)] for k, n in enumerate((49, 50, 51, 70, 120, 60))]
    common = ["z"] * 80  # a run of one word, so that all its windows are equal
    rows = []
    for i in rng.sample(range(1000), 60):
        words = []
        for _ in range(rng.randrange(6)):
            words += [f"r{rng.randrange(30)}" for _ in range(rng.randrange(40))]
            p = rng.choice([*passages, common])
            at = rng.randrange(len(p))
            words += rng.choice([p, p, p[at:], p[:at]])
        rows.append((i, " ".join(words)))
    rows += [(i + 1000, t) for i, t in rows[:10]]
    assert rows_of(dedup(documents(spark, rows).repartition(3)), *COLUMNS) == brute(rows)


@pytest.mark.parametrize("dedup", [substring_dedup, suffix_dedup])
def test_other_windows(spark, dedup):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))) for i in range(40)]
    for window in (5, 33):
        assert rows_of(dedup(documents(spark, rows), window), *COLUMNS) == brute(rows, window)


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def _opposites(n):
    """A word of a and b in Thue-Morse order, and the same with the letters exchanged: equal under any polynomial modulo 2**64."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("dedup", [substring_dedup, suffix_dedup])
def test_words_and_windows_of_regular_form_are_told_apart(spark, dedup):
    one, other = _opposites(4096)
    tail = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, " ".join(one)), (4, " ".join(other))]
    assert rows_of(dedup(documents(spark, rows[:2])), *COLUMNS) == brute(rows[:2])
    assert rows_of(dedup(documents(spark, rows), 2048), *COLUMNS) == brute(rows, 2048)


@pytest.mark.parametrize("dedup", [substring_dedup, suffix_dedup])
def test_texts_longer_than_a_piece(spark, dedup, monkeypatch):
    rng = random.Random(8)
    shared = [f"s{rng.randrange(500)}" for _ in range(3000)]
    rows = [(1, " ".join(shared)), (2, " ".join(f"v{rng.randrange(900)}" for _ in range(500)) + " \n" + "  ".join(shared[700:2500])), (3, "q" * 3000 + " " + " ".join(shared)), (4, " ".join(shared)), (4, " ".join(shared[:100]))]
    rows += [(5, "z " * 4000), (6, "z " * 70)]
    monkeypatch.setattr(pieces, "__defaults__", (512, False))
    monkeypatch.setattr(passages, "HELD", 4096)
    # The tasks see neither change, so their functions are run here on the rows of a single task.
    columns = [pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "text"])
    for p in pieces(columns[1], 49):
        assert all(len(x) == len(p.rows) for x in (p.base, p.seen))
    sums = {i: passages._sequence(columns[1], i) for i in range(len(rows))}
    assert sums[0] == sums[3] and len(set(sums.values())) == len(rows) - 1
    whole = Words(np.frombuffer(rows[1][1].encode(), np.uint8), np.array([0, len(rows[1][1])]))
    assert whole.sequence_hashes(whole.hashes())[0] == sums[1]
    anchors = __import__(dedup.__module__, fromlist=["x"])
    anchors = anchors.cover_anchors() if dedup is substring_dedup else anchors.minimiser_anchors()
    found = pa.Table.from_batches(list(passages._anchor_rows(anchors, 50)(iter([batch])))).to_pandas()
    found = found[~found["copy"] | found.known]
    flags = [found[found.doc_id == i].pos.tolist() for i, _ in rows]
    windows = passages._window_rows(50, 30)(iter([pa.RecordBatch.from_arrays([*columns, pa.array(flags, pa.list_(pa.int64()))], ["doc_id", "text", "flags"])]))
    got = pa.Table.from_batches(list(windows)).to_pandas()
    got["least"] = got.groupby(["a", "b"]).doc_id.transform("min")
    got = got[got.sure | (got.doc_id > got.least)]
    marks = [[{"seq": r.seq, "pos": r.pos, "n": r.n, "more": None if r.more is None else r.more.tolist()} for r in got[got.doc_id == i].itertuples()] or None for i, _ in rows]
    kind = pa.list_(pa.struct([("seq", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("more", pa.list_(pa.int64()))]))
    kept = passages._kept_rows(50)(iter([pa.RecordBatch.from_arrays([*columns, pa.array(marks, kind)], ["doc_id", "text", "marks"])]))
    assert sorted(map(tuple, (r.values() for b in kept for r in b.to_pylist())), key=repr) == brute(rows)


def test_the_memory_of_a_very_long_text(spark):
    """A text of 50 MB, all of it repeated: what numpy holds at most, beside the text itself."""
    import tracemalloc

    rng = np.random.default_rng(1)
    text = " ".join(map(str, rng.integers(0, 1 << 40, 4_000_000)))
    assert len(text) > 50_000_000 and not re.search("  ", text)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text + " x"]), pa.array([[], []], pa.list_(pa.int64()))], ["doc_id", "text", "flags"])
    from kithline.llm.suffix_dedup import minimiser_anchors

    tracemalloc.start()
    for _ in passages._anchor_rows(minimiser_anchors(), 50)(iter([batch.select([0, 1]).slice(0, 1)])):
        pass
    flags = pa.array([list(range(0, 4_000_000, 31))] * 2, pa.list_(pa.int64()))
    for _ in passages._window_rows(50, 30)(iter([pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flags], ["doc_id", "text", "flags"])])):
        pass
    assert tracemalloc.get_traced_memory()[1] < 20 * len(text)
    tracemalloc.stop()


def test_doc_ids_that_are_no_numbers_are_refused(spark):
    with pytest.raises(TypeError):
        substring_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
