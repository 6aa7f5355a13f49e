"""Learned scorers: matrix, logistic regression with thresholds, few-shot choice, retraining policy."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithline.operators import logistic
from kithline.operators.evaluation import best_legacy, best_pipeline, best_production, cascade_report, grid, percent, routed, steps, sweep
from kithline.operators.listing import numbered
from kithline.scratch import materialise

MIN_ROWS, FLOOR, FOLDS = 50, 0.75, 5
MERGE_GRID, REJECT_GRID = (0.50, 0.96, 0.05), (0.05, 0.46, 0.05)


def feature_names(rows: DataFrame, column: str = "features") -> list[str]:
    """Sorted names of all features that occur: a short list, bounded by the entities' fields."""
    return [r[0] for r in rows.select(F.explode(F.map_keys(column)).alias("k")).distinct().orderBy("k").collect()]


def matrix(rows: DataFrame, names: list[str], column: str = "features") -> DataFrame:
    """With x: the features in the order of names, missing ones 0."""
    return rows.withColumn("x", F.array(*(F.coalesce(F.try_element_at(F.col(column), F.lit(n)), F.lit(0.0)) for n in names)))


def standardise(rows: DataFrame, width: int) -> tuple[DataFrame, list[float], list[float]]:
    """With z: x less its mean by its population deviation; a constant feature becomes 0."""
    stats = rows.agg(*(f for i in range(width) for f in (F.avg(F.col("x")[i]), F.stddev_pop(F.col("x")[i])))).first()
    mean, scale = [float(stats[2 * i] or 0) for i in range(width)], [float(stats[2 * i + 1] or 0) for i in range(width)]
    z = F.array(*(((F.col("x")[i] - mean[i]) / scale[i]) if scale[i] > 0 else F.lit(0.0) for i in range(width)))
    return rows.withColumn("z", z), mean, scale


def dealt(rows: DataFrame, name: str, k: int, key: str = "pair_id", within: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """With name: 0 to k - 1 in turn, in the order of a seeded hash, within groups."""
    return numbered(rows, key, *within, name=name, seed=seed).withColumn(name, (F.col(name) % k).cast("int"))


def folds(rows: DataFrame, key: str = "pair_id", k: int = FOLDS, seed: int = 42) -> DataFrame:
    """With fold: stratified by label, dealt in the order of a seeded hash."""
    return dealt(rows, "fold", k, key, ("label",), seed)


def other_folds(k: int) -> Column:
    """The numbers of the models a row trains if model i learns from all folds but i."""
    return F.array_except(F.sequence(F.lit(0), F.lit(k - 1)), F.array("fold"))


def out_of_fold(rows: DataFrame, width: int, k: int = FOLDS, balanced: bool = True) -> DataFrame:
    """(pair_id, label, fold, p): each row's probability by a model of the other folds; rows: pair_id, label, fold, z.

    Rows of a fold whose others have one class only are left out.
    """
    fitted = logistic.fit(rows.withColumn("models", other_folds(k)), width, balanced)
    return logistic.scored(rows.select("pair_id", "label", "fold", "z", F.col("fold").alias("model")), logistic.table(rows.sparkSession, fitted)).drop("model")


def random_forest(train: DataFrame, trees: int = 100, seed: int = 42):
    """A forest of balanced trees over z as a vector; train: label, v."""
    from pyspark.ml.classification import RandomForestClassifier

    n = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    total = sum(n.values())
    w = F.when(F.col("label") == 1, total / (2.0 * max(n.get(1, 0), 1))).otherwise(total / (2.0 * max(n.get(0, 0), 1)))
    return RandomForestClassifier(featuresCol="v", labelCol="label", weightCol="w", numTrees=trees, seed=seed).fit(train.withColumn("w", w))


def compare_learners(pairs: DataFrame, k: int = FOLDS, trees: int = 100) -> DataFrame:
    """One row: accuracy of a logistic model and of a forest on the same folds, and how often both, one or none is right.

    pairs: pair_id, label, features.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    names = feature_names(pairs)
    scaled, _, _ = standardise(matrix(pairs, names), len(names))
    rows = materialise(folds(scaled.select("pair_id", "label", "z"), k=k), "folds")
    forest, own = None, rows.withColumn("v", array_to_vector("z")).cache()
    for i in range(k):
        model = random_forest(own.filter(F.col("fold") != i), trees)
        part = model.transform(own.filter(F.col("fold") == i)).select("pair_id", (vector_to_array("probability")[1] > 0.5).cast("int").alias("forest"))
        forest = part if forest is None else forest.unionByName(part)
    forest = materialise(forest, "forest")
    own.unpersist()
    both = out_of_fold(rows, len(names), k).join(forest, "pair_id")
    lr, rf = F.col("p").__gt__(0.5).cast("int") == F.col("label"), F.col("forest") == F.col("label")
    n = both.agg(F.count("*").alias("n"), F.count_if(lr & rf).alias("both_right"), F.count_if(lr & ~rf).alias("only_logistic"), F.count_if(~lr & rf).alias("only_forest"), F.count_if(~lr & ~rf).alias("none_right"))
    return n.select("*", percent(F.col("both_right") + F.col("only_logistic"), F.col("n")).alias("logistic_pct"), percent(F.col("both_right") + F.col("only_forest"), F.col("n")).alias("forest_pct"))


@dataclass
class Scorer:
    """A trained scorer and what is known of it."""

    names: list[str]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    intercept: float
    theta_merge: float
    theta_reject: float
    metrics: dict = field(default_factory=dict)
    entity_type: str | None = None

    def column(self) -> Column:
        """As a struct for learned_score."""
        arrays = {"names": self.names, "mean": self.mean, "scale": self.scale, "weights": self.weights}
        return F.struct(*(F.array(*map(F.lit, v)).alias(k) for k, v in arrays.items()), *(F.lit(float(getattr(self, k))).alias(k) for k in ("intercept", "theta_merge", "theta_reject")))

    def save(self, spark: SparkSession, path: str, version: str) -> None:
        """Append the model and its metadata under a version's name to the table at path."""
        row = (version, self.entity_type, json.dumps(asdict(self)))
        spark.createDataFrame([row], "version string, entity_type string, model string").write.mode("append").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str, prefix: str) -> Scorer | None:
        """The model with the lexicographically last version of the prefix, if there is one."""
        from kithline.sources.files import newest_version

        found = newest_version(spark.read.schema("version string, entity_type string, model string").json(path), prefix).first()
        return None if found is None else Scorer(**json.loads(found.model))

    def strongest(self, n: int = 5) -> list[tuple[str, float]]:
        return sorted(zip(self.names, self.weights, strict=True), key=lambda x: (-abs(x[1]), x[0]))[:n]


def train_scorer(pairs: DataFrame, entity_type: str | None = None, min_rows: int = MIN_ROWS, floor: float = FLOOR, k: int = FOLDS) -> Scorer | None:
    """A balanced logistic scorer of pairs (pair_id, label, features), or None: too few rows, one class, or an accuracy below the floor.

    The model of all rows and those of each fold's others, which the thresholds are chosen by, are fitted together.
    """
    rows = pairs if entity_type is None else pairs.filter(F.col("entity_type") == entity_type)
    rows = materialise(rows.select("pair_id", "label", "features"), "pairs")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n < min_rows or not 0 < ones < n:
        return None
    names = feature_names(rows)
    scaled, mean, scale = standardise(matrix(rows, names), len(names))
    scaled = materialise(folds(scaled.select("pair_id", "label", "z"), k=k).withColumn("models", F.array_append(other_folds(k), F.lit(k))), "folds")
    fitted = logistic.fit(scaled, len(names))
    tested = logistic.scored(scaled.select("pair_id", "label", "z", F.col("fold").alias("model")), logistic.table(rows.sparkSession, fitted))
    chosen = best_production(sweep(tested, grid(rows.sparkSession, steps(*MERGE_GRID), steps(*REJECT_GRID)))).first()
    if chosen is None or (chosen.accuracy is not None and chosen.accuracy < floor):
        return None
    model = fitted[k]
    metrics = {"n_samples": n, "n_features": len(names), "accuracy": chosen.accuracy, "merge_precision": chosen.merge_precision, "intercept_rate": chosen.intercept_rate}
    return Scorer(names, mean, scale, model.weights, model.intercept, chosen.merge_t, chosen.reject_t, metrics, entity_type)


def train_by_type(pairs: DataFrame, types: tuple[str, ...] = ("equipment", "person", "location", "activity", "organization"), floor: float = FLOOR) -> dict[str, Scorer]:
    found = {t: train_scorer(pairs, t, floor=floor) for t in types}
    return {t: s for t, s in found.items() if s is not None}


def feedback_pairs(decisions: DataFrame, since: int = 0, most: int = 5000) -> DataFrame:
    """Decided pairs that a person made or confirmed, with labels; decisions: id, status, notes, resolved_by, ...

    The first most of them in the order of id: a call takes one instalment, and the next goes on from its last id.
    """
    from kithline.functions.replies import status_label

    by_hand = F.coalesce(F.col("notes"), F.lit("")).startswith("manual") | F.col("resolved_by").isNotNull()
    own = decisions.filter((F.col("id") > since) & F.col("status").isin("merged", "disambig", "discarded", "new_entity") & by_hand).withColumn("label", status_label(F.col("status")))
    return own.filter("label is not null").orderBy("id").limit(most)


def few_shot(decisions: DataFrame, limit: int = 5) -> DataFrame:
    """Recent human decisions, at most limit // 2 of each label."""
    recent = decisions.orderBy(F.desc_nulls_last("resolved_at"), F.desc("id")).limit(2 * limit)
    r = F.row_number().over(Window.partitionBy("label").orderBy(F.desc_nulls_last("resolved_at"), F.desc("id")))
    return recent.withColumn("r", r).filter(F.col("r") <= limit // 2).drop("r").orderBy(F.desc_nulls_last("resolved_at"), F.desc("id")).limit(limit)


def must_retrain(new: int, total: int, days: float, force: bool = False, every: int = 50, age: float = 7.0, least: int = MIN_ROWS) -> bool:
    return total >= least and (force or new >= every or days > age)


def learning_curve(rows: DataFrame, rounds: int = 5, key: str = "pair_id", seed: int = 42) -> DataFrame:
    """With round: rows of rounds below k are what a model of round k may learn from; the rounds have equally many rows."""
    total = rows.agg(F.count("*").alias("_total"))
    placed = numbered(rows, key, name="round", seed=seed).crossJoin(F.broadcast(total))
    return placed.withColumn("round", F.floor(F.col("round") * rounds / F.col("_total")).cast("int")).drop("_total")


def feedback_rounds(pairs: DataFrame, rounds: int = 5, seed: int = 42) -> DataFrame:
    """(round, feedback, accuracy_pct, interception_pct, l2_pct): what more decided pairs teach.

    pairs: pair_id, label, features and, if there is one, decision (merge, reject, escalate) of the fixed
    rules, which is round 0.  The model of round k learns from the pairs dealt to the rounds below k, in a
    seeded order, and is tested on all others.  All models are fitted together: a pair adds to the sums of each
    round after its own.  A round whose pairs have one class only has no row.
    """
    names = feature_names(pairs)
    scaled, _, _ = standardise(matrix(pairs, names), len(names))
    keep = [c for c in ("decision",) if c in pairs.columns]
    rows = materialise(learning_curve(scaled.select("pair_id", "label", "z", *keep), rounds, seed=seed), "rounds")
    models = F.filter(F.sequence(F.lit(1), F.lit(max(rounds - 1, 1))), lambda k: k > F.col("round"))
    fitted = {k: m for k, m in logistic.fit(rows.withColumn("models", models), len(names)).items() if k < rounds}
    tested = rows.select("label", "z", F.explode(F.filter(F.sequence(F.lit(1), F.lit(max(rounds - 1, 1))), lambda k: k <= F.col("round"))).alias("model"))
    p = logistic.scored(tested, logistic.table(rows.sparkSession, fitted))
    sizes = rows.select(F.explode(models).alias("round")).groupBy("round").agg(F.count("*").alias("feedback"))
    rate = lambda ok, n: percent(ok, n)
    learned = p.groupBy(F.col("model").alias("round")).agg(rate(F.count_if((F.col("p") > 0.5).cast("int") == F.col("label")), F.count("*")).alias("accuracy_pct"))
    out = learned.join(sizes, "round").select("round", "feedback", "accuracy_pct", F.lit(100.0).alias("interception_pct"), F.lit(0.0).alias("l2_pct"))
    if not keep:
        return out
    kept, right = F.col("decision") != "escalate", (F.col("decision") == "merge").cast("int") == F.col("label")
    share = rate(F.count_if(kept), F.count("*"))
    first = rows.agg(rate(F.count_if(kept & right), F.count_if(kept)).alias("accuracy_pct"), share.alias("interception_pct"), F.round(100 - share, 1).alias("l2_pct"))
    return first.select(F.lit(0).alias("round"), F.lit(0).cast("long").alias("feedback"), "accuracy_pct", "interception_pct", "l2_pct").unionByName(out)


def new_feedback(decisions: DataFrame, counted_before: int) -> DataFrame:
    """One row, n: decisions by people since the last training, which had counted so many."""
    by_hand = F.coalesce(F.col("notes"), F.lit("")).startswith("manual") | F.col("resolved_by").isNotNull()
    own = decisions.agg(F.count_if(F.col("status").isin("merged", "disambig", "new_entity") & by_hand).alias("n"))
    return own.select(F.greatest(F.col("n") - counted_before, F.lit(0)).alias("n"))


def feedback_source(verdict: Column) -> Column:
    return F.when(verdict == "l2_uncertain", "human_review").otherwise("l2_clear")


def few_shot_text(examples: DataFrame, by: str = "entity_type") -> DataFrame:
    """(by, text): the lines that show a judge past decisions; examples: by, name_a, name_b, label (1 the same), reason, ordinal."""
    reason = F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" ("), F.col("reason"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit('  "'), "name_a", F.lit('" vs "'), "name_b", F.lit('" '), F.when(F.col("label") == 1, "→ SAME").otherwise("→ DIFFERENT"), reason)
    lines = examples.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("x"))
    return lines.select(by, F.concat(F.lit("Reference examples (from expert human judgments):\n"), F.array_join("x.line", "\n"), F.lit("\n")).alias("text"))


#: Names of the ways to choose thresholds that cross_validate compares.
MODES = ("legacy", "aligned", "max_pipeline", "match_fixed")


def _thresholds(trained: DataFrame, verdicts: DataFrame, target: float) -> DataFrame:
    """(model, mode, merge_t, reject_t), chosen on the probabilities of each model's training rows (model, pair_id, label, p)."""
    spark, by, fixed = trained.sparkSession, ("model",), F.lit(0.8)
    fine = steps(0.05, 0.96, 0.05, 2)
    plain = sweep(trained, grid(spark, steps(0.55, 0.95, 0.05), steps(0.05, 0.45, 0.05)), by=by)
    swept = sweep(trained, grid(spark, fine, fine, below=True), verdicts, 3, by)
    found = {"legacy": best_legacy(plain, by=by), "max_pipeline": best_pipeline(swept, min_accuracy=75, by=by), "match_fixed": best_pipeline(swept, target, min_accuracy=75, by=by),
             "aligned": trained.select("model").distinct().select("model", fixed.alias("merge_t"), F.lit(0.3).alias("reject_t"))}
    out = None
    for mode in MODES:
        part = found[mode].select("model", F.lit(mode).alias("mode"), F.coalesce("merge_t", fixed).alias("merge_t"), F.coalesce("reject_t", F.lit(0.3)).alias("reject_t"))
        out = part if out is None else out.unionByName(part)
    return out


def cross_validate(pairs: DataFrame, verdicts: DataFrame, target: float, by_type: bool = False, k: int = FOLDS, min_rows: int = MIN_ROWS) -> DataFrame:
    """(mode, ...cascade's counts and rates): out-of-fold decisions under thresholds chosen on the training folds.

    pairs: pair_id, label, entity_type, features; verdicts: pair_id, verdict; target: the strict
    accuracy that mode match_fixed has to reach.  by_type: each type has a model of its own
    where its training rows are min_rows at least and of both classes, else that of all types.  All
    models are fitted together, and all thresholds chosen in one sweep.
    """
    spark, names = pairs.sparkSession, feature_names(pairs)
    scaled, _, _ = standardise(matrix(pairs, names), len(names))
    rows = materialise(folds(scaled.select("pair_id", "label", "entity_type", "z"), k=k), "folds")
    # Models 0 to k - 1 learn from all types; the next k from the first type, and so on.
    sizes: dict[tuple[int, str, int], int] = {(r.fold, r.entity_type, r.label): r.n for r in rows.groupBy("fold", "entity_type", "label").agg(F.count("*").alias("n")).collect()}
    own = {}
    for t in sorted({t for _, t, _ in sizes if t is not None}) if by_type else []:
        for i in range(k):
            ones, zeros = (sum(n for (f, u, y), n in sizes.items() if f != i and u == t and y == v) for v in (1, 0))
            if ones + zeros >= min_rows and ones and zeros:
                own[i, t] = k + len(own)
    placed = spark.createDataFrame([(i, t, m) for (i, t), m in own.items()], "fold int, entity_type string, own int")
    rows = rows.join(F.broadcast(placed), ["fold", "entity_type"], "left").withColumn("model", F.coalesce("own", "fold"))
    others = placed.groupBy("entity_type").agg(F.collect_list(F.struct("fold", "own")).alias("of_type"))
    typed = F.transform(F.filter(F.coalesce("of_type", F.array().cast("array<struct<fold:int,own:int>>")), lambda x: x["fold"] != F.col("fold")), lambda x: x["own"])
    rows = materialise(rows.join(F.broadcast(others), "entity_type", "left").withColumn("models", F.concat(other_folds(k), typed)).drop("own", "of_type"), "models")
    models = logistic.table(spark, logistic.fit(rows, len(names)))
    trained = materialise(logistic.scored(rows.select("pair_id", "label", "z", F.explode("models").alias("model")), models), "trained")
    chosen = materialise(_thresholds(trained, verdicts, target), "thresholds")
    tested = logistic.scored(rows.select("pair_id", "label", "z", "model"), models).join(F.broadcast(chosen), "model")
    decided = tested.select("mode", "pair_id", "label", routed(F.col("p"), F.col("merge_t"), F.col("reject_t")).alias("prediction"))
    return cascade_report(decided, verdicts, by=("mode",))
