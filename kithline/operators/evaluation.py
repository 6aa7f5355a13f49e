"""Metrics of the cascade, sweeps over thresholds, and their choice.

predictions: pair_id, label (0/1), prediction (1 merge, 0 reject, -1 escalated).
probabilities: pair_id, label, p.  A grid is a small table of thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int | None = 1) -> Column:
    x = F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))
    return x if digits is None else F.round(x, digits)


def _count(test: Column, weight: str | None = None) -> Column:
    """Of the rows that pass; weight: the column that says how many each row stands for."""
    return F.count_if(test) if weight is None else F.coalesce(F.sum(F.when(test, F.col(weight)).otherwise(0)), F.lit(0))


def decision_distribution(decisions: DataFrame, weight: str | None = None) -> DataFrame:
    """(decision, n, pct, interception_pct); interception: what was not escalated; weight: see _count."""
    n = decisions.groupBy("decision").agg(_count(F.lit(True), weight).alias("n"))
    whole = Window.partitionBy()
    total, kept = F.sum("n").over(whole), F.sum(F.when(F.col("decision") != "escalate", F.col("n")).otherwise(0)).over(whole)
    return n.select("decision", "n", percent(F.col("n"), total).alias("pct"), percent(kept, total).alias("interception_pct"))


def as_prediction(decision: Column) -> Column:
    return F.when(decision == "merge", 1).when(decision == "reject", 0).otherwise(-1)


def accuracy_report(scored: DataFrame, *by: str, weight: str | None = None) -> DataFrame:
    """Accuracy of what was decided; scored: decision, label.  With by, for each group; weight: see _count."""
    p, y = as_prediction(F.col("decision")), F.col("label")
    of = lambda test: _count(test, weight)
    n = scored.groupBy(*by).agg(
        of(F.lit(True)).alias("total"), of(p >= 0).alias("decided"), of((p >= 0) & (p == y)).alias("correct"),
        of(p == 1).alias("merges"), of((p == 1) & (y == 0)).alias("false_merges"),
        of(p == 0).alias("rejects"), of((p == 0) & (y == 1)).alias("false_rejects"))
    c = F.col
    return n.select(*by, "total", "decided", "correct", "false_merges", "false_rejects", percent(c("correct"), c("decided")).alias("accuracy_pct"), percent(c("decided"), c("total")).alias("interception_pct"),
                    percent(c("merges") - c("false_merges"), c("merges")).alias("merge_precision_pct"), percent(c("rejects") - c("false_rejects"), c("rejects")).alias("reject_precision_pct"))


def label_buckets(scored: DataFrame, weight: str | None = None) -> DataFrame:
    """(decision, n, same, same_pct); weight: see _count."""
    n = scored.groupBy("decision").agg(_count(F.lit(True), weight).alias("n"), _count(F.col("label") == 1, weight).alias("same"))
    return n.withColumn("same_pct", percent(F.col("same"), F.col("n")))


def _cascade_counts(p: Column, y: Column, judged: Column) -> list[Column]:
    """judged: the judge's label of an escalated pair, -1 if unresolved."""
    return [F.count("*").alias("total"), F.count_if(p >= 0).alias("l1_decided"), F.count_if((p >= 0) & (p == y)).alias("l1_correct"),
            F.count_if(p < 0).alias("l2_used"), F.count_if((p < 0) & (judged == y)).alias("l2_correct"), F.count_if((p < 0) & (judged == -1)).alias("unresolved")]


def _cascade_rates(df: DataFrame, digits: int | None = 3) -> DataFrame:
    c = F.col
    right, resolved = c("l1_correct") + c("l2_correct"), c("total") - c("unresolved")
    return (df.withColumn("resolved", resolved).withColumn("l1_acc_pct", percent(c("l1_correct"), c("l1_decided"), digits)).withColumn("strict_pct", percent(right, c("total"), digits))
            .withColumn("resolved_pct", percent(right, resolved, digits)).withColumn("intercept_pct", percent(c("l1_decided"), c("total"), digits)))


def cascade_report(predictions: DataFrame, verdicts: DataFrame, digits: int | None = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each group; verdicts: pair_id, verdict (same, different, anything else is unresolved)."""
    judged = F.when(F.col("verdict") == "same", 1).when(F.col("verdict") == "different", 0).otherwise(-1)
    both = predictions.join(verdicts.select("pair_id", "verdict"), "pair_id", "left")
    return _cascade_rates(both.groupBy(*by).agg(*_cascade_counts(F.col("prediction"), F.col("label"), judged)), digits)


def grid(spark: SparkSession, merge: list[float], reject: list[float], below: bool = False) -> DataFrame:
    """(ordinal, merge_t, reject_t) in the order of two nested loops; below: reject_t < merge_t only."""
    rows = [(m, r) for m in merge for r in reject if not below or r < m]
    return spark.createDataFrame([(i, m, r) for i, (m, r) in enumerate(rows)], "ordinal int, merge_t double, reject_t double")


def steps(start: float, stop: float, step: float, digits: int | None = None) -> list[float]:
    """start + i * step below stop, as floating-point numbers."""
    n = 0
    while start + n * step < stop - 1e-12:
        n += 1
    return [round(start + i * step, digits) if digits is not None else start + i * step for i in range(n)]


def routed(p: Column, merge: Column, reject: Column) -> Column:
    """1, 0 or -1; where both thresholds hold the reject wins, as it is applied last."""
    return F.when(p <= reject, 0).when(p >= merge, 1).otherwise(-1)


def _below(p: Column, thresholds: list[float], strict: bool) -> Column:
    """How many of the sorted thresholds are below p, or equal to it unless strict."""
    own = F.array(*map(F.lit, thresholds))
    return F.size(F.filter(own, lambda t: (p > t) if strict else (p >= t)))


def sweep(probabilities: DataFrame, thresholds: DataFrame, verdicts: DataFrame | None = None, digits: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The cascade's counts and rates at each row of the grid, a table of a few hundred rows at most; for each group of by.

    Pairs are counted once, by how many of the grid's thresholds their probability reaches; only
    these counts, whose number the grid bounds, meet the grid.
    """
    rows = probabilities
    if verdicts is not None:
        rows = rows.join(verdicts.select("pair_id", "verdict"), "pair_id", "left")
        judged = F.when(F.col("verdict") == "same", 1).when(F.col("verdict") == "different", 0).otherwise(-1)
    else:
        judged = F.lit(-1)
    cells = thresholds.select("merge_t", "reject_t").distinct().collect()
    ms, rs = sorted({c.merge_t for c in cells}), sorted({c.reject_t for c in cells})
    # p >= the i-th merge threshold exactly if i < m, and p <= the i-th reject threshold exactly if i >= r.
    m, r = _below(F.col("p"), ms, False), F.when(F.col("p").isNull(), len(rs)).otherwise(_below(F.col("p"), rs, True))
    counted = rows.select(*by, m.alias("m"), r.alias("r"), "label", judged.alias("judged")).groupBy(*by, "m", "r", "label", "judged").agg(F.count("*").alias("w"))
    place = lambda own, c: F.array_position(F.array(*map(F.lit, own)), F.col(c)) - 1
    grid_rows = thresholds.select("ordinal", "merge_t", "reject_t", place(ms, "merge_t").alias("im"), place(rs, "reject_t").alias("ir"))
    p, y, j, w = F.when(F.col("ir") >= F.col("r"), 0).when(F.col("im") < F.col("m"), 1).otherwise(-1), F.col("label"), F.col("judged"), F.col("w")
    of = lambda test: F.sum(F.when(test, w).otherwise(0))
    at = counted.crossJoin(F.broadcast(grid_rows)).groupBy(*by, "ordinal", "merge_t", "reject_t").agg(
        F.sum(w).alias("total"), of(p >= 0).alias("l1_decided"), of((p >= 0) & (p == y)).alias("l1_correct"), of(p < 0).alias("l2_used"), of((p < 0) & (j == y)).alias("l2_correct"),
        of((p < 0) & (j == -1)).alias("unresolved"), of(p == 1).alias("merges"), of((p == 1) & (y == 1)).alias("true_merges"))
    return _cascade_rates(at, digits)


def _first(ok: Column, row: Column, *key: Column) -> Column:
    """row where ok holds and the key is largest; null if it holds nowhere."""
    return F.max_by(row, F.when(ok, F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key)))))


def best_legacy(swept: DataFrame, min_decided: int = 5, min_accuracy: float = 75.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, merge_t, reject_t) with the largest accuracy times interception; the first of equals; (0.7, 0.3) if none passes."""
    ok = (F.col("l1_decided") >= min_decided) & (F.col("l1_acc_pct") >= min_accuracy)
    found = swept.groupBy(*by).agg(_first(ok, F.struct("merge_t", "reject_t"), F.col("l1_acc_pct") * F.col("intercept_pct"), -F.col("ordinal")).alias("b"))
    return found.select(*by, F.coalesce("b.merge_t", F.lit(0.7)).alias("merge_t"), F.coalesce("b.reject_t", F.lit(0.3)).alias("reject_t"))


def best_production(swept: DataFrame, min_accuracy: float = 0.75, min_precision: float = 0.75, by: tuple[str, ...] = ()) -> DataFrame:
    """As best_legacy with a floor on the precision of merges too; (0.6, 0.4) if none passes."""
    acc, hit = F.col("l1_correct") / F.nullif(F.col("l1_decided"), F.lit(0)), F.col("l1_decided") / F.col("total")
    precision = F.when(F.col("merges") > 0, F.col("true_merges") / F.col("merges")).otherwise(F.lit(1.0))
    ok = (F.col("l1_decided") > 0) & (acc >= min_accuracy) & (precision >= min_precision)
    row = F.struct("merge_t", "reject_t", acc.alias("accuracy"), precision.alias("merge_precision"), hit.alias("intercept_rate"))
    found = swept.groupBy(*by).agg(_first(ok, row, acc * hit, -F.col("ordinal")).alias("b"))
    return found.select(*by, F.coalesce("b.merge_t", F.lit(0.6)).alias("merge_t"), F.coalesce("b.reject_t", F.lit(0.4)).alias("reject_t"), "b.accuracy", "b.merge_precision", "b.intercept_rate")


def best_pipeline(swept: DataFrame, target: float | None = None, fixed: tuple[float, float] = (0.8, 0.3), min_decided: int = 5, min_accuracy: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, merge_t, reject_t, feasible) for the best strict accuracy, or, with a target for it, the widest interception that reaches it.

    Ties go to the thresholds nearest to fixed, then to the first.  If nothing reaches the
    target, the nearest accuracy wins.
    """
    ok = F.col("l1_decided") >= min_decided
    if min_accuracy is not None:
        ok = ok & (F.col("l1_acc_pct") >= min_accuracy)
    r = lambda c: F.round(c, 6)
    near, first = -(F.abs(F.col("merge_t") - fixed[0]) + F.abs(F.col("reject_t") - fixed[1])), -F.col("ordinal")
    strict, wide, acc, row = r("strict_pct"), r("intercept_pct"), r("l1_acc_pct"), F.struct("merge_t", "reject_t")
    if target is None:
        return swept.groupBy(*by).agg(_first(ok, row, strict, wide, acc, near, first).alias("b")).select(*by, "b.merge_t", "b.reject_t", F.lit(True).alias("feasible"))
    best = _first(ok & (F.col("strict_pct") >= target), row, wide, strict, acc, near, first)
    nearest = _first(ok, row, -F.abs(F.col("strict_pct") - target), wide, acc, first)
    both = swept.groupBy(*by).agg(best.alias("b"), nearest.alias("c"))
    return both.select(*by, F.coalesce("b.merge_t", "c.merge_t").alias("merge_t"), F.coalesce("b.reject_t", "c.reject_t").alias("reject_t"), F.col("b").isNotNull().alias("feasible"))


def pareto_frontier(swept: DataFrame, slices: int | None = None) -> DataFrame:
    """Rows that no other row beats in strict accuracy and interception; rows of equal rates stay together, null rates go.

    A skyline without comparing pairs.  Rates are cut into slices of equal width by interception.  The
    best accuracy of each slice, a table of as many rows as slices, gives each slice the best of
    those after it; a row stays if it is the best of its own interception, better than what comes after
    it within its slice and better than the slices after.  There are four slices for each shuffle
    partition if slices is not given.
    """
    slices = slices or 4 * int(swept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s, i = F.col("strict_pct"), F.col("intercept_pct")
    points = swept.filter(s.isNotNull() & i.isNotNull()).groupBy("intercept_pct").agg(F.max("strict_pct").alias("strict_pct"))
    ends = points.agg(F.min("intercept_pct").alias("_lo"), F.max("intercept_pct").alias("_hi"))
    share = F.when(F.col("_hi") > F.col("_lo"), (i - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    cut = points.crossJoin(F.broadcast(ends)).select("strict_pct", "intercept_pct", F.least(F.floor(share * slices), F.lit(slices - 1)).alias("_slice"))
    best = cut.groupBy("_slice").agg(F.max("strict_pct").alias("_best"))
    later = Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    above = best.select("_slice", F.max("_best").over(later).alias("_above"))
    within = Window.partitionBy("_slice").orderBy(F.desc("intercept_pct")).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("_within", F.max("strict_pct").over(within)).join(F.broadcast(above), "_slice")
    beyond = F.greatest("_within", "_above")
    sky = own.filter(beyond.isNull() | (s > beyond)).select("strict_pct", "intercept_pct")
    return swept.join(sky, ["strict_pct", "intercept_pct"], "left_semi").select(*swept.columns)


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    """Counts, precision, recall and F1 of predictions that are 0 or 1."""
    p, y = F.col("prediction"), F.col("label")
    n = predictions.groupBy(*by).agg(*(F.count_if((p == a) & (y == b)).alias(k) for k, a, b in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))))
    one = F.lit(1)
    n = n.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one)).withColumn("recall", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one))
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return n.select(*by, "tp", "fp", "fn", "tn", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def agreement(pairs: DataFrame, *by: str) -> DataFrame:
    """Raw agreement and Cohen's kappa of columns a and b (0/1)."""
    a, b = F.col("a"), F.col("b")
    n = pairs.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if((a == x) & (b == y)).alias(f"n{x}{y}") for x in (0, 1) for y in (0, 1)))
    c = F.col
    po = (c("n00") + c("n11")) / c("n")
    pe = ((c("n00") + c("n01")) * (c("n00") + c("n10")) + (c("n10") + c("n11")) * (c("n01") + c("n11"))) / (c("n") * c("n"))
    return n.select(*by, "n", "n00", "n01", "n10", "n11", F.round(po * 100, 1).alias("agreement_pct"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.lit(1.0)), 4).alias("kappa"))


def three_way(votes: DataFrame, *by: str) -> DataFrame:
    """How often three annotators a, b, c agree, and who sides with c (the human) where a and b differ."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return votes.groupBy(*by).agg(F.count("*").alias("n"), F.count_if((a == b) & (b == c)).alias("all_agree"), F.count_if((a == b) & (b != c)).alias("only_c_differs"),
                                  F.count_if((a != b) & (a == c)).alias("a_right"), F.count_if((a != b) & (b == c)).alias("b_right"), F.count_if((a != b) & (a != c) & (b != c)).alias("none_right"))


def verdict_histogram(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("type").pivot("verdict", ["same", "different", "unknown"]).agg(F.count("verdict")).fillna(0)


def signal_gaps(scored: DataFrame, signals: list[str]) -> DataFrame:
    """(signal, mean_same, mean_different, gap)"""
    long = scored.select("label", F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("v")) for s in signals))).alias("x")).select("label", "x.*")
    m = long.groupBy("signal").agg(F.avg(F.when(F.col("label") == 1, F.col("v"))).alias("s"), F.avg(F.when(F.col("label") == 0, F.col("v"))).alias("d"))
    return m.select("signal", F.round("s", 4).alias("mean_same"), F.round("d", 4).alias("mean_different"), F.round(F.col("s") - F.col("d"), 4).alias("gap"))


def merge_threshold_sweep(scored: DataFrame, thresholds: list[float], l2_accuracy: float, reject: float = 0.3) -> DataFrame:
    """Accuracy, interception and estimated pipeline at each merge threshold; scored: label, score."""
    ths = scored.sparkSession.createDataFrame([(t, i) for i, t in enumerate(sorted(thresholds))], "threshold double, i int")
    counted = scored.groupBy(_below(F.col("score"), sorted(thresholds), False).alias("m"), (F.col("score") < reject).alias("low"), "label").agg(F.count("*").alias("w"))
    p = F.when(F.col("i") < F.col("m"), 1).when(F.col("low"), 0).otherwise(-1)
    y = F.col("label")
    n = counted.crossJoin(F.broadcast(ths)).groupBy("threshold").agg(
        F.sum("w").alias("total"), *(F.sum(F.when(t, F.col("w")).otherwise(0)).alias(k) for k, t in (("decided", p >= 0), ("correct", (p >= 0) & (p == y)), ("merges", p == 1), ("true_merges", (p == 1) & (y == 1)))))
    acc = F.when(F.col("decided") > 0, F.col("correct") / F.col("decided")).otherwise(F.lit(0.0))
    inter = F.col("decided") / F.col("total")
    return n.select("threshold", F.round(acc * 100, 2).alias("accuracy_pct"), F.round(inter * 100, 2).alias("interception_pct"), F.round((acc * inter + l2_accuracy * (1 - inter)) * 100, 2).alias("pipeline_pct"), percent(F.col("true_merges"), F.col("merges"), 2).alias("merge_precision_pct"))


def hardest(scored: DataFrame, per_label: int, low: float, high: float) -> DataFrame:
    """The undecided pairs with the highest scores, per label."""
    r = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "pair_id"))
    return scored.filter((F.col("score") >= low) & (F.col("score") < high)).withColumn("rank", r).filter(F.col("rank") <= per_label)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash: the same rows each time."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def adaptive_pipeline(swept: DataFrame, l1_accuracy: float, l2_accuracy: float) -> DataFrame:
    """With adaptive_pct: the pipeline's estimate with the accuracy of learned decisions in place of the fixed ones'."""
    inter = F.col("interception_pct") / 100
    return swept.withColumn("adaptive_pct", F.round((l1_accuracy * inter + l2_accuracy * (1 - inter)) * 100, 2))


def sweep_matrix(swept: DataFrame, value: str) -> DataFrame:
    """A row for each merge threshold and a column for each reject threshold of the grid, in order."""
    columns = [r[0] for r in swept.select("reject_t").distinct().orderBy("reject_t").collect()]
    wide = swept.groupBy("merge_t").pivot("reject_t", columns).agg(F.first(value))
    return wide.select("merge_t", *(F.col(f"`{c}`").alias(f"r_{c:g}".replace(".", "_").replace("-", "m")) for c in columns)).orderBy("merge_t")


def with_labels(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """The pairs that the ground truth (pair_id, label) knows, with their labels."""
    return pairs.drop("label").join(truth.select("pair_id", "label"), "pair_id")


def joined_votes(a: DataFrame, b: DataFrame, human: DataFrame | None = None) -> DataFrame:
    """(pair_id, a, b, c): labels of two annotators on common pairs, and of a person (pair_id, label), -1 where there is none."""
    both = a.select("pair_id", F.col("label").alias("a")).join(b.select("pair_id", F.col("label").alias("b")), "pair_id")
    if human is None:
        return both.withColumn("c", F.lit(-1))
    return both.join(human.select("pair_id", F.col("label").alias("c")), "pair_id", "left").withColumn("c", F.coalesce("c", F.lit(-1)))
