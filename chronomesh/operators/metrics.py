"""Losses and evaluation metrics as aggregations over a prediction table.

``keys`` are the groups a metric is reported for (a batch, or nothing for the whole run).
Ranking metrics first count rows per distinct score; running totals over those are made
range by range, so one large group is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.functions.scalar import argmax, bce_with_logits, log_sum_exp, softmax
from chronomesh.operators.scaling import running_sums, stage


def is_positive(score: Column, threshold: float = 0.5) -> Column:
    """Strictly above the threshold."""
    return score > F.lit(threshold)


def _counts(positive: Column, label: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if(positive & (label == 1)),
        "fp": F.count_if(positive & (label == 0)),
        "tn": F.count_if(~positive & (label == 0)),
        "fn": F.count_if(~positive & (label == 1)),
    }


def _ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 when there is nothing to divide by."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def stat_scores(pred: DataFrame, keys: list[str], score: Column, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """True and false positives and negatives, and support."""
    counts = _counts(is_positive(score, threshold), F.col(label))
    out = pred.groupBy(*keys).agg(*[c.alias(n) for n, c in counts.items()])
    return out.withColumn("support", F.col("tp") + F.col("fn"))


def binary_metrics(pred: DataFrame, keys: list[str], score: Column, label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Accuracy and F1."""
    c = stat_scores(pred, keys, score, label, threshold)
    tp, fp, tn, fn = (F.col(n) for n in ("tp", "fp", "tn", "fn"))
    return c.select(
        *keys,
        _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def score_steps(pred: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Per distinct score, from the highest down: its positives and negatives and the totals so far."""
    per_score = pred.groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")
    )
    return running_sums(per_score, keys, [score], {"tp": "p", "fp": "n"}, descending=True)


def auroc_from_steps(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Exact area under the ROC curve; null when a group has one class only."""
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2))
    both = F.sum("p").cast("double") * F.sum("n").cast("double")
    return steps.groupBy(*keys).agg(F.when(both > 0, area / both).alias("auroc"))


def _null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which nulls meet."""
    names = [c for c in right.columns if c not in on]
    side = right.select(*[F.col(k).alias(f"_on_{k}") for k in on], *names)
    return left.join(side, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on] or F.lit(True), "left").drop(*[f"_on_{k}" for k in on])


def ranking_over_time(pred: DataFrame, keys: list[str], step: str, score: str = "score", label: str = "label") -> DataFrame:
    """(keys, step, positives, negatives, auroc) after every step, over all rows up to it: metrics that accumulate.

    Not one ranking a step. A step's area grows by what its rows add: each new row with all earlier rows of the other label,
    counted by score. Those counts are a dominance count in two orders, by step and by score, which is found level by level: at
    level j the steps fall into runs of 2 ** j, and every row of a right-hand run is compared with the run to its left, by
    running totals in score order inside the pair of runs. Each pair of an earlier and a later step meets at exactly
    one level, so the work is rows x log(steps); all levels are one table, and one pass of running totals, whose groups may be larger than a
    task. Null when only one label has been seen. Equal scores count half.
    """
    cells = pred.groupBy(*keys, F.col(step).alias("_step"), F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    order = stage(cells.select(*keys, "_step").distinct(), "ranking-steps")
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("_step")) - 1  # steps, not rows
    order = stage(order.withColumn("_at", at), "ranking-order")
    most = order.agg(F.max("_at")).first()[0] or 0
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_step").eqNullSafe(F.col("_k_step"))]
    placed = cells.join(order.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_step").alias("_k_step"), "_at"), same)
    placed = stage(placed.select(*keys, "_at", "_score", "_p", "_n"), "ranking-cells")
    levels = list(range(max(most, 1).bit_length()))
    # level -1: pairs inside one step, where the left-hand rows are the step's own
    every = placed.select(*keys, "_at", "_score", "_p", "_n", F.explode(F.lit([-1, *levels])).alias("_level"))
    left = (F.col("_level") < 0) | (F.expr("shiftright(_at, _level)").bitwiseAND(F.lit(1)) == 0)
    right = (F.col("_level") < 0) | ~left
    pair = F.when(F.col("_level") < 0, F.col("_at")).otherwise(F.expr("shiftright(_at, _level + 1)"))
    sides = every.select(
        *keys, "_level", pair.alias("_pair"), "_score", F.when(right, F.col("_at")).otherwise(F.lit(-1)).alias("_at"),
        F.when(left, F.col("_p")).otherwise(0).alias("_lp"), F.when(left, F.col("_n")).otherwise(0).alias("_ln"),
        F.when(right, F.col("_p")).otherwise(0).alias("_rp"), F.when(right, F.col("_n")).otherwise(0).alias("_rn"))
    group = [*keys, "_level", "_pair"]
    # the left-hand rows of one score are one row before the totals are made; so is each step's part of the right-hand ones
    totals = sides.groupBy(*group, "_score").agg(F.sum("_lp").alias("_lp"), F.sum("_ln").alias("_ln"))
    totals = running_sums(totals, group, ["_score"], {"_up": "_lp", "_un": "_ln"})
    whole_left = totals.groupBy(*group).agg(F.sum("_lp").alias("_all_p"))
    mine = sides.filter((F.col("_rp") > 0) | (F.col("_rn") > 0)).select(*group, "_score", "_at", "_rp", "_rn")
    met = _null_safe(_null_safe(mine, totals, [*group, "_score"]), whole_left, group)
    # a new positive beats the negatives below it; a new negative loses to the positives above it
    beats = F.col("_rp") * (F.col("_un") - F.col("_ln") / 2)
    loses = F.when(F.col("_level") < 0, F.lit(0.0)).otherwise(F.col("_rn") * (F.col("_all_p") - F.col("_up") + F.col("_lp") / 2))
    gained = met.groupBy(*keys, "_at").agg(F.sum(beats + loses).alias("_area"))
    counts = placed.groupBy(*keys, "_at").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_step = _null_safe(_null_safe(order, counts, [*keys, "_at"]), gained, [*keys, "_at"])
    positives, negatives = F.sum("_p").over(upto), F.sum("_n").over(upto)
    both = positives.cast("double") * negatives.cast("double")
    return per_step.select(
        *keys, F.col("_step").alias(step), positives.alias("positives"), negatives.alias("negatives"),
        F.when(both > 0, F.sum(F.coalesce("_area", F.lit(0.0))).over(upto) / both).alias("auroc"))


def average_precision_from_steps(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of precision times recall step; null when a group has no positive."""
    gain = F.sum(F.col("p") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    total = F.sum("p")
    return steps.groupBy(*keys).agg(F.when(total > 0, gain / total).alias("average_precision"))


def auroc(pred: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    return auroc_from_steps(score_steps(pred, keys, score, label), keys)


def average_precision(pred: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    return average_precision_from_steps(score_steps(pred, keys, score, label), keys)


def with_class(pred: DataFrame, logits: str = "logits") -> DataFrame:
    return pred.withColumn("pred", argmax(F.col(logits)))


def multiclass_metrics(pred: DataFrame, keys: list[str], label: str = "label", guess: str = "pred") -> DataFrame:
    """Micro accuracy and F1 (equal for one-label data), and the macro versions over classes that occur."""
    cells = pred.groupBy(*keys, F.col(label).alias("_y"), F.col(guess).alias("_p")).agg(F.count("*").alias("_n"))
    sides = F.array(
        F.struct(F.col("_y").alias("class"), F.col("_n").alias("actual"), F.lit(0).cast("bigint").alias("guessed"),
                 F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(F.lit(0)).alias("hit")),
        F.struct(F.col("_p").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("_n").alias("guessed"),
                 F.lit(0).cast("bigint").alias("hit")),
    )
    per_class = cells.select(*keys, F.inline(sides)).groupBy(*keys, "class").agg(
        *[F.sum(c).alias(c) for c in ("actual", "guessed", "hit")]
    )
    return per_class.groupBy(*keys).agg(
        (F.sum("hit") / F.sum("actual")).alias("accuracy_micro"),
        (F.sum("hit") / F.sum("actual")).alias("f1_micro"),
        F.avg(F.when(F.col("actual") > 0, F.col("hit") / F.col("actual"))).alias("accuracy_macro"),
        F.avg(_ratio(2 * F.col("hit"), F.col("actual") + F.col("guessed"))).alias("f1_macro"),
    )


def one_against_rest(pred: DataFrame, keys: list[str], logits: str = "logits", label: str = "label") -> DataFrame:
    """Rows (keys, class, score, is_class); scores are class probabilities."""
    return pred.select(*keys, F.col(label).alias("_y"), F.posexplode(softmax(F.col(logits))).alias("class", "score")).select(
        *keys, "class", "score", (F.col("_y") == F.col("class")).cast("int").alias("is_class")
    )


def multiclass_ranking(pred: DataFrame, keys: list[str], logits: str = "logits", label: str = "label") -> DataFrame:
    """AUROC and average precision per class against the rest; both read one ranking."""
    steps = score_steps(one_against_rest(pred, keys, logits, label), [*keys, "class"], "score", "is_class")
    p, n, tp, fp = (F.col(c) for c in ("p", "n", "tp", "fp"))
    both = F.sum("p").cast("double") * F.sum("n").cast("double")
    return steps.groupBy(*keys, "class").agg(
        F.when(both > 0, F.sum(n * (tp - p + p / 2)) / both).alias("auroc"),
        F.when(F.sum("p") > 0, F.sum(p * (tp / (tp + fp))) / F.sum("p")).alias("average_precision"),
    )


def macro(per_class: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over the classes that have a value."""
    return per_class.groupBy(*keys).agg(
        F.avg("auroc").alias("auroc"), F.avg("average_precision").alias("average_precision")
    )


def confusion_matrix(pred: DataFrame, classes: int, label: str = "label", guess: str = "pred") -> DataFrame:
    """Count for every (label, pred) cell, empty ones included; a null or a value outside 0..classes-1 raises."""
    spark = pred.sparkSession
    for side in (label, guess):
        inside = F.col(side).between(0, classes - 1)
        message = F.concat(F.lit(f"{side} is no class: "), F.coalesce(F.col(side).cast("string"), F.lit("null")))
        pred = pred.withColumn(side, F.when(inside, F.col(side)).otherwise(F.raise_error(message).cast("int")))
    every = F.sequence(F.lit(0), F.lit(classes - 1))
    grid = spark.range(1).select(F.explode(every).alias("label")).select("label", F.explode(every).alias("pred"))
    counts = pred.groupBy(F.col(label).alias("label"), F.col(guess).alias("pred")).agg(F.count("*").alias("events"))
    return grid.join(counts, ["label", "pred"], "left").na.fill(0, ["events"])


def malicious_view(pred: DataFrame, label: str = "label", guess: str = "pred") -> DataFrame:
    """Hard malicious-or-not scores: any class but 0 is malicious."""
    return pred.withColumns({
        "mal_score": (F.col(guess) > 0).cast("double"),
        "mal_label": (F.col(label) > 0).cast("int"),
    })


def malicious_only_metrics(pred: DataFrame, keys: list[str], label: str = "label", logits: str = "logits") -> DataFrame:
    """Class metrics over truly malicious rows; 0 for groups that have none."""
    bad = with_class(pred, logits).filter(F.col(label) > 0)
    hard = multiclass_metrics(bad, keys, label)
    soft = macro(multiclass_ranking(bad, keys, logits, label), keys)
    names = ["accuracy_micro", "f1_micro", "accuracy_macro", "f1_macro", "auroc", "average_precision"]
    groups = pred.select(*keys).distinct()
    return _null_safe(_null_safe(groups, hard, keys), soft, keys).na.fill(0.0, names)


def bce_loss(pred: DataFrame, keys: list[str], logit: str, label: str) -> DataFrame:
    return pred.groupBy(*keys).agg(F.avg(bce_with_logits(F.col(logit), F.col(label).cast("double"))).alias("pred_loss"))


def cross_entropy(logits: Column, label: Column) -> Column:
    return log_sum_exp(logits) - F.element_at(logits, label + 1)


def weighted_ce_loss(pred: DataFrame, keys: list[str], logits: str, label: str, other_weight: float = 5.0) -> DataFrame:
    """Cross-entropy with weight 1 for class 0 and ``other_weight`` for the rest, and the plain mean."""
    loss = cross_entropy(F.col(logits), F.col(label))
    weight = F.when(F.col(label) == 0, F.lit(1.0)).otherwise(F.lit(other_weight))
    return pred.groupBy(*keys).agg(
        (F.sum(weight * loss) / F.sum(weight)).alias("class_loss"), F.avg(loss).alias("plain_class_loss")
    )


def confidence_loss(pred: DataFrame, keys: list[str], logits: str, label: str, probability: Column) -> DataFrame:
    """Cross-entropy times the link probability."""
    loss = cross_entropy(F.col(logits), F.col(label)) * probability
    return pred.groupBy(*keys).agg(F.avg(loss).alias("confidence_loss"))


def combined_losses(
    pred: DataFrame, keys: list[str], logits: str, label: str, link_logit: str, link_label: str,
    alpha: float = 1.2, observed_alpha: float = 0.8, floor: float = 0.2, other_weight: float = 5.0,
) -> DataFrame:
    """Every loss variant from one aggregation pass."""
    ce = cross_entropy(F.col(logits), F.col(label))
    weight = F.when(F.col(label) == 0, F.lit(1.0)).otherwise(F.lit(other_weight))
    x = F.col(link_logit)
    probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    base = pred.groupBy(*keys).agg(
        F.avg(bce_with_logits(x, F.col(link_label).cast("double"))).alias("pred_loss"),
        (F.sum(weight * ce) / F.sum(weight)).alias("class_loss"),
        F.avg(ce).alias("_plain"),
        F.avg(ce * probability).alias("confidence_loss"),
        F.greatest(F.avg((F.col(label) > 0).cast("double")), F.lit(floor)).alias("share"),
    )
    p, c, q = F.col("pred_loss"), F.col("class_loss"), F.col("share")
    return base.select(
        *keys, "pred_loss", "class_loss", "confidence_loss", "share",
        p.alias("loss_pred_only"),
        (p * F.lit(alpha) + c).alias("loss_alpha"),
        (p * (1 - q) + c * q).alias("loss_v2"),
        (p + F.lit(observed_alpha) * F.col("_plain")).alias("loss_observed"),
    )
