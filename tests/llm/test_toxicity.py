import math
import random
import zlib
from collections import Counter

from kithline.llm import toxicity as module
from tests.llm.common import ROWS, documents


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _corpus(n=900):
    rng = random.Random(6)
    plain = [f"{a}{b}{c}" for a in ("th", "an", "re", "on") for b in ("e", "ing", "at") for c in ("", "ed", "er", "ly")]
    bad = ["grobnik", "zutfark", "vexlumpo"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 300))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(("", "s", "ed")))
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = _corpus()
    out = module.score_toxicity(documents(spark, rows), _labels(spark, labels)).collect()
    truth = {i: t for i, _, t in labels}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = module.drop_toxic(documents(spark, rows), _labels(spark, labels))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if not r.predicted}


def test_held_out_labels_are_never_read(spark):
    rows, labels = _corpus(300)
    docs = documents(spark, rows)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (module.score_toxicity(docs, _labels(spark, x)).collect() for x in (labels, turned))
    assert sorted((r.doc_id, round(r.score, 9)) for r in a) == sorted((r.doc_id, round(r.score, 9)) for r in b)


def test_drop_toxic_on_edge_rows(spark):
    docs, labels = documents(spark, ROWS), _labels(spark, [(i, 0, i % 2) for i in range(14)])
    out = module.score_toxicity(docs, labels).collect()
    kept = module.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in out if not r.predicted)
    assert module.drop_toxic(documents(spark, []), labels).collect() == []


def test_edge_rows_and_single_classes(spark):
    docs = documents(spark, ROWS)
    for labels, score in (([], 0.0), ([(i, 0, 0) for i in range(14)], 0.0), ([(i, 0, 1) for i in range(14)], 1.0)):
        out = module.score_toxicity(docs, _labels(spark, labels)).collect()
        assert len(out) == len(ROWS) and {r.score for r in out} == {score}
    mixed = _labels(spark, [(i, 0, i % 2) for i in range(14)] + [(1, 0, None), (None, 0, 1), (2, 0, 1), (2, 0, 0)])
    out = module.score_toxicity(docs, mixed).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out) and not any(r.held_out for r in out if r.doc_id is None)
    assert module.score_toxicity(documents(spark, []), mixed).collect() == []


BEGIN, END, N, D = b"\2", b"\3", module.ORDER, module.DISCOUNT


def _sequences(texts):
    """Every byte of every word, and its end, with the five bytes before it."""
    for text in texts:
        for word in text.lower().encode().split():
            padded = BEGIN * (N - 1) + word + END
            yield from (padded[i: i + N] for i in range(len(padded) - N + 1))


class Shared:
    """Kneser-Ney by its definition: how many different bytes come before a sequence."""

    def __init__(self, grams):
        self.n, level = {}, set(grams)
        for k in range(N - 1, 0, -1):
            level = [g[1:] for g in level]
            self.n[k] = {g: level.count(g) for g in set(level)}
            level = set(level)

    def after(self, context):
        return {g[-1:]: n for g, n in self.n[len(context) + 1].items() if g[:-1] == context}

    def p(self, context, byte):
        own = self.after(context)
        total = sum(own.values())
        if context:
            base = self.p(context[1:], byte)
        else:
            base = 1 / (len(own) + 1)
        return (max(own.get(byte, 0) - D, 0) + D * len(own) * base) / total if total else base


def _brute_ratio(grams, one, zero):
    shared = Shared(grams)
    out = {}
    for g in grams:
        p, lik = shared.p(g[1:-1], g[-1:]), []
        for own in (one, zero):
            after = {x: n for x, n in own.items() if x[:-1] == g[:-1]}
            total = sum(after.values())
            lik.append((max(own.get(g, 0) - D, 0) + D * len(after) * p) / total if total else p)
        out[int.from_bytes(g, "big")] = math.log(lik[0] / lik[1])
    return out


def test_ratios_are_those_of_brute_force_models(spark):
    rng = random.Random(2)
    folds = {f: [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == f] for f in range(5)}
    rows = [(i, " ".join("".join(rng.choice("abC") for _ in range(rng.randrange(1, 5))) for _ in range(4)), rng.randrange(2)) for f in range(5) for i in folds[f][:4]]
    docs, labels = documents(spark, [r[:2] for r in rows]), _labels(spark, [(i, 0, y) for i, _, y in rows])
    got = {r.gram: r for r in module._ratios(module._gram_counts(module._labelled(docs, labels))).collect()}
    fold = {i: f for f, own in folds.items() for i in own}
    learned = [r for r in rows if fold[r[0]] != 0]
    grams = set(_sequences(t for _, t, _ in learned))
    assert set(got) == {int.from_bytes(g, "big") for g in grams}
    for model in (0, 1, 2, 3, 4):
        one, zero = (Counter(_sequences(t for i, t, y in learned if y == c and fold[i] != model)) for c in (1, 0))
        want = _brute_ratio(grams, one, zero)
        assert all(abs(got[g][f"r_{model}"] - w) < 1e-5 for g, w in want.items())


def test_estimates_sum_to_one(spark):
    grams = set(_sequences(["abba cab", "bab abc", "caba"]))
    own = spark.createDataFrame([(int.from_bytes(g, "big"),) for g in grams], "gram long")
    got, shared = {r.gram: r.p for r in module._shared_estimates(own).collect()}, Shared(grams)
    assert set(got) == {int.from_bytes(g, "big") for g in shared.n[N - 1]}
    assert all(abs(got[int.from_bytes(g, "big")] - shared.p(g[:-1], g[-1:])) < 1e-12 for g in shared.n[N - 1])
    # Over all bytes, and one that stands for those never seen, each context's estimates are a distribution.
    every = [*shared.after(b""), b"?"]
    for context in {g[:-1] for g in shared.n[N - 1]}:
        known = sum(got.get(int.from_bytes(context + b, "big"), 0) for b in every)
        rest = sum(shared.p(context, b) for b in every if context + b not in shared.n[N - 1])
        assert abs(known + rest - 1) < 1e-12


def test_scores_do_not_depend_on_the_size_of_blocks(spark):
    rows, labels = _corpus(300)
    docs, marks = documents(spark, rows), _labels(spark, labels)
    whole, small = ({r.doc_id: r.score for r in module.score_toxicity(docs, marks, *size).collect()} for size in ((), (40,)))
    assert len(module.fit(docs, marks, 40).blocks) > module.HELD_BLOCKS
    assert all(abs(whole[i] - small[i]) < 1e-6 for i in whole)


def test_words_of_every_training_fold_are_learned(spark):
    def of(fold):
        return [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5 == fold]

    rows, labels = _corpus()
    rows = dict(rows)
    for i in of(4)[:60]:
        rows[i] += " quizzimork" * 3
    tried = [i for i in of(0) if i in rows and not labels[i][2]][:30]
    for i in tried:
        rows[i] += " quizzimork" * 3
    labels = [(i, 0, int(t or i in of(4)[:60])) for i, _, t in labels]
    out = {r.doc_id: r for r in module.score_toxicity(documents(spark, list(rows.items())), _labels(spark, labels)).collect()}
    assert len(tried) == 30 and all(out[i].held_out and out[i].predicted for i in tried)
