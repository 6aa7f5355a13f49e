import random

import numpy as np
from pyspark.sql import functions as F

from kithline.operators import components, crosslingual, learning, logistic


def newton(x, y, balanced=True, c=1.0):
    """Half the squared weights plus c times the weighted losses, minimised by plain Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    ridge, b = np.append(np.full(x.shape[1] - 1, 1 / c), 0), np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b - np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (w * (p - y)) + ridge * b)
    return b[:-1], b[-1]


def prob(m, x):
    return 1 / (1 + np.exp(-(x @ m[0] + m[1])))


def _pairs(spark, n=260, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.random() < 0.4
        rows.append((f"p{i:03}", int(y), "person" if i % 3 else "location", {"x": rng.gauss(1.5 if y else 0.0, 1.0), "y": rng.gauss(0, 1), "const": 3.0}))
    return spark.createDataFrame(rows, "pair_id string, label int, entity_type string, features map<string,double>").repartition(3)


def _matrix(rows):
    x = np.array([[r.features.get(k, 0.0) for k in ("const", "x", "y")] for r in rows])
    sd = x.std(0)
    return np.where(sd > 0, (x - x.mean(0)) / np.where(sd > 0, sd, 1), 0)


def cascade(pred, y, judged):
    n, l1 = len(y), pred >= 0
    right = int((pred[l1] == y[l1]).sum())
    l2 = int((judged[~l1] == y[~l1]).sum())
    un = int((judged[~l1] == -1).sum())
    pct = lambda a, b: a * 100.0 / b if b else 0.0
    return {"total": n, "l1_decided": int(l1.sum()), "l1_correct": right, "l2_used": int((~l1).sum()), "l2_correct": l2, "unresolved": un,
            "l1_acc_pct": pct(right, l1.sum()), "strict_pct": pct(right + l2, n), "intercept_pct": pct(l1.sum(), n)}


def route(p, m, r):
    return np.where(p <= r, 0, np.where(p >= m, 1, -1))


def thresholds(p, y, judged, target):
    """The four ways to choose thresholds, by loops over the grids."""
    out, best = {"aligned": (0.8, 0.3), "legacy": (0.7, 0.3)}, None
    for m in [0.55 + 0.05 * i for i in range(8)]:
        for r in [0.05 + 0.05 * i for i in range(8)]:
            c = cascade(route(p, m, r), y, np.full(len(y), -1))
            if c["l1_decided"] >= 5 and c["l1_acc_pct"] >= 75 and (best is None or c["l1_acc_pct"] * c["intercept_pct"] > best):
                best, out["legacy"] = c["l1_acc_pct"] * c["intercept_pct"], (m, r)
    fine, cells = [round(0.05 + 0.05 * i, 2) for i in range(19)], []
    for o, (m, r) in enumerate((m, r) for m in fine for r in fine if r < m):
        c = cascade(route(p, m, r), y, judged)
        s, i, a = (round(c[k], 3) for k in ("strict_pct", "intercept_pct", "l1_acc_pct"))
        if c["l1_decided"] >= 5 and a >= 75:
            cells.append((s, i, a, -(abs(m - 0.8) + abs(r - 0.3)), -o, m, r))
    out["max_pipeline"] = max(cells, default=(0,) * 5 + (0.8, 0.3))[-2:]
    reached = [(i, s, a, near, o, m, r) for s, i, a, near, o, m, r in cells if s >= target]
    near = [(-abs(s - target), i, a, o, m, r) for s, i, a, _, o, m, r in cells]
    out["match_fixed"] = max(reached)[-2:] if reached else max(near)[-2:] if near else (0.8, 0.3)
    return out


def brute_cross_validation(rows, fold, verdicts, target, by_type, min_rows):
    x, y = _matrix(rows), np.array([r.label for r in rows])
    kind = np.array([r.entity_type for r in rows])
    judged = np.array([{"same": 1, "different": 0}.get(verdicts.get(r.pair_id), -1) for r in rows])
    pred = {m: np.full(len(y), -9) for m in learning.MODES}
    for f in range(5):
        train, test = fold != f, fold == f
        for t in sorted(set(kind)) if by_type else [None]:
            own = train & (kind == t) if by_type else train
            if by_type and own.sum() < min_rows:
                own = train
            mine = test & (kind == t) if by_type else test
            m = newton(x[own], y[own])
            for mode, (a, b) in thresholds(prob(m, x[own]), y[own], judged[own], target).items():
                pred[mode][mine] = route(prob(m, x[mine]), a, b)
    return {m: cascade(p, y, judged) for m, p in pred.items()}


def test_newton_steps_are_those_of_each_model(spark):
    pairs = _pairs(spark)
    scaled, _, _ = learning.standardise(learning.matrix(pairs, ["const", "x", "y"]), 3)
    rows = scaled.select("pair_id", "label", "entity_type", "z").withColumn("models", F.when(F.col("entity_type") == "person", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    got = logistic.fit(rows.cache(), 3)
    r = rows.collect()
    z, y, person = np.array([a.z for a in r]), np.array([a.label for a in r]), np.array([a.entity_type == "person" for a in r])
    for m, own in ((0, np.ones(len(y), bool)), (1, person)):
        w, b = newton(z[own], y[own])
        assert np.abs(np.array(got[m].weights) - w).max() < 1e-6 and abs(got[m].intercept - b) < 1e-6
    assert logistic.fit(rows.filter("label = 1"), 3) == {}
    p = logistic.scored(rows.withColumn("model", F.lit(1)), logistic.table(spark, got)).select("pair_id", "p").collect()
    want = dict(zip([a.pair_id for a in r], prob((np.array(got[1].weights), got[1].intercept), z), strict=True))
    assert all(abs(want[a.pair_id] - a.p) < 1e-9 for a in p)


def test_cross_validation_after_components(spark):
    """Components first: what they leave in the session must not break what is trained after them."""
    assert components.components(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")).count() == 3
    pairs = _pairs(spark)
    rng = random.Random(1)
    verdicts = {f"p{i:03}": rng.choice(["same", "different", "unknown"]) for i in range(0, 260, 2)}
    v = spark.createDataFrame(list(verdicts.items()), "pair_id string, verdict string")
    folds = {r.pair_id: r.fold for r in learning.folds(pairs).select("pair_id", "fold").collect()}
    rows = pairs.collect()
    fold = np.array([folds[r.pair_id] for r in rows])
    for by_type in (False, True):
        want = brute_cross_validation(rows, fold, verdicts, 70.0, by_type, 100)
        got = {r.mode: r.asDict() for r in learning.cross_validate(pairs, v, 70.0, by_type, min_rows=100).collect()}
        assert set(got) == set(want)
        for mode, w in want.items():
            for k, x in w.items():
                assert abs(got[mode][k] - x) < 1e-3, (by_type, mode, k, got[mode], w)


def test_feedback_rounds(spark):
    pairs = _pairs(spark).withColumn("decision", F.when(F.col("features")["x"] > 2, "merge").when(F.col("features")["x"] < -1, "reject").otherwise("escalate"))
    placed = {r.pair_id: r.round for r in learning.learning_curve(pairs).select("pair_id", "round").collect()}
    rows = pairs.collect()
    x, y, rnd = _matrix(rows), np.array([r.label for r in rows]), np.array([placed[r.pair_id] for r in rows])
    got = {r.round: (r.feedback, r.accuracy_pct, r.interception_pct, r.l2_pct) for r in learning.feedback_rounds(pairs).collect()}
    kept = [r for r in rows if r.decision != "escalate"]
    share = round(len(kept) * 100 / len(rows), 1)
    right = sum((r.decision == "merge") == (r.label == 1) for r in kept)
    want = {0: (0, round(right * 100 / len(kept), 1), share, round(100 - share, 1))}
    for k in range(1, 5):
        own = rnd < k
        m = newton(x[own], y[own])
        hit = (prob(m, x[~own]) > 0.5) == (y[~own] == 1)
        want[k] = (int(own.sum()), round(hit.mean() * 100, 1), 100.0, 0.0)
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], atol=0.051), (k, got[k], want[k])


def test_learners_on_the_same_folds(spark):
    pairs = _pairs(spark, 150)
    r = learning.compare_learners(pairs, k=3, trees=5).first()
    assert r.n == 150 == r.both_right + r.only_logistic + r.only_forest + r.none_right
    folds = {q.pair_id: q.fold for q in learning.folds(pairs, k=3).select("pair_id", "fold").collect()}
    rows = pairs.collect()
    x, y, fold = _matrix(rows), np.array([q.label for q in rows]), np.array([folds[q.pair_id] for q in rows])
    hit = sum(int(((prob(newton(x[fold != f], y[fold != f]), x[fold == f]) > 0.5) == (y[fold == f] == 1)).sum()) for f in range(3))
    assert r.both_right + r.only_logistic == hit and r.forest_pct > 60


def test_saved_scorer_scores_alike(spark, tmp_path):
    s = learning.train_scorer(_pairs(spark), floor=0.0)
    path = str(tmp_path / "models")
    s.save(spark, path, "unified_v1")
    s.theta_merge = 0.9
    s.save(spark, path, "unified_v2")
    again = learning.Scorer.load(spark, path, "unified")
    assert again == s and learning.Scorer.load(spark, path, "other") is None
    assert [n for n, _ in s.strongest(2)] == sorted(("x", "y"), key=lambda n: -abs(dict(zip(s.names, s.weights, strict=True))[n]))


def test_aligner_folds(spark):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        y = i % 2
        a = f"name{i} x{i % 5}"
        b = a if y and i % 3 else f"other{rng.randrange(9)}"
        rows.append((f"q{i}", y, f"u/{a}", f"v/{b}", a, b, ["k", f"t{i % 4}"], ["k"], float(rng.randrange(9)), float(rng.randrange(9))))
    pairs = spark.createDataFrame(rows, "pair_id string, label int, uri_a string, uri_b string, label_a string, label_b string, attributes_a array<string>, attributes_b array<string>, degree_a double, degree_b double")
    seen = learning.dealt(crosslingual.features(pairs), "fold", 5).collect()
    x = np.array([[float(r[c] or 0) for c in crosslingual.ALIGNER] for r in seen])
    y, fold = np.array([r.label for r in seen]), np.array([r.fold for r in seen])
    want = {}
    for f in range(5):
        p = prob(newton(x[fold != f], y[fold != f], balanced=False), x[fold == f])
        t = y[fold == f]
        want[f] = tuple(int(v.sum()) for v in ((p >= 0.5) & (t == 1), (p >= 0.5) & (t == 0), (p < 0.3) & (t == 0), (p < 0.3) & (t == 1), (p >= 0.3) & (p < 0.5)))
    got = {r.fold: (r.tp, r.fp, r.tn, r.fn, r.escalated) for r in crosslingual.cross_validated(pairs).collect()}
    assert got == want
