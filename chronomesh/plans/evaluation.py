"""Losses and metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronomesh.functions.scalar import sigmoid
from chronomesh.operators import metrics, stats
from chronomesh.plans.inputs import whole
from chronomesh.plans.registry import part, query
from chronomesh.sources import views

K = ["batch"]
CLASSES = 10
_KEY = "CAST(batch AS BIGINT) AS batch"


def _round(df, *names, digits=6):
    return whole(df.withColumns({n: F.round(n, digits) for n in names}), *[c for c in df.columns if c in ("batch", "class", "label", "pred")])


_COUNTS = """
count(*) FILTER (score > 0.5 AND label = 1) AS tp, count(*) FILTER (score > 0.5 AND label = 0) AS fp,
count(*) FILTER (score <= 0.5 AND label = 0) AS tn, count(*) FILTER (score <= 0.5 AND label = 1) AS fn
"""
part("pred_counts", f"SELECT batch, {_COUNTS} FROM pred GROUP BY batch")
_BINARY = "round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(2 * tp / (2 * tp + fp + fn), 6) END AS f1"


@query("binary_metrics", f"SELECT {_KEY}, {_BINARY} FROM pred_counts")
def binary_metrics(spark, sf_dir):
    return _round(metrics.binary_metrics(views.pred(spark, sf_dir), K, F.col("score")), "accuracy", "f1")


part("logit_counts", f"SELECT batch, {_COUNTS} FROM (SELECT batch, 1 / (1 + exp(-logit)) AS score, label FROM pred) GROUP BY batch")


@query("stat_scores", f"SELECT {_KEY}, tp, fp, tn, fn, tp + fn AS support FROM logit_counts")
def stat_scores(spark, sf_dir):
    """From logits, which go through the sigmoid first."""
    return whole(metrics.stat_scores(views.pred(spark, sf_dir), K, sigmoid(F.col("logit"))), "batch")


def steps_sql(source: str, keys: str, score: str, label: str) -> str:
    return f"""
SELECT {keys}, score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM (
  SELECT {keys}, {score} AS score, count(*) FILTER ({label} = 1) AS p, count(*) FILTER ({label} = 0) AS n FROM {source} GROUP BY {keys}, {score})
WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)
"""


_AUROC = "CASE WHEN sum(p) * sum(n) > 0 THEN sum(n * (tp - p + p / 2)) / (sum(p) * sum(n)) END"
_AP = "CASE WHEN sum(p) > 0 THEN sum(p * (tp / (tp + fp))) / sum(p) END"
part("pred_steps", steps_sql("pred", "batch", "score", "label"))


@query("auroc", f"SELECT {_KEY}, round({_AUROC}, 6) AS auroc FROM pred_steps GROUP BY batch")
def auroc(spark, sf_dir):
    return _round(metrics.auroc(views.pred(spark, sf_dir), K), "auroc")


@query("auroc_total", f"SELECT round({_AUROC}, 6) AS auroc FROM ({steps_sql('(SELECT 1 AS g, * FROM pred)', 'g', 'score', 'label')})")
def auroc_total(spark, sf_dir):
    """Over the whole run, as when metrics accumulate."""
    return _round(metrics.auroc(views.pred(spark, sf_dir), []), "auroc")


@query("auroc_running", """
SELECT CAST(b.batch AS BIGINT) AS batch, sum(CASE WHEN p.label = 1 THEN 1 ELSE 0 END)::BIGINT AS positives, sum(CASE WHEN p.label = 0 THEN 1 ELSE 0 END)::BIGINT AS negatives,
       round((sum(r) FILTER (p.label = 1) - sum(CASE WHEN p.label = 1 THEN 1 ELSE 0 END) * (sum(CASE WHEN p.label = 1 THEN 1 ELSE 0 END) + 1) / 2)
             / nullif(sum(CASE WHEN p.label = 1 THEN 1 ELSE 0 END)::DOUBLE * sum(CASE WHEN p.label = 0 THEN 1 ELSE 0 END), 0), 6) AS auroc
FROM (SELECT b.batch, p.label, rank() OVER w + (count(*) OVER (PARTITION BY b.batch, p.score) - 1) / 2 AS r
      FROM (SELECT DISTINCT batch FROM pred) b JOIN pred p ON p.batch <= b.batch WINDOW w AS (PARTITION BY b.batch ORDER BY p.score)) p
JOIN (SELECT DISTINCT batch FROM pred) b USING (batch) GROUP BY b.batch
""")
def auroc_running(spark, sf_dir):
    """After each batch, over all batches so far."""
    return _round(whole(metrics.ranking_over_time(views.pred(spark, sf_dir), [], "batch"), "batch"), "auroc")


@query("average_precision", f"SELECT {_KEY}, round({_AP}, 6) AS average_precision FROM pred_steps GROUP BY batch")
def average_precision(spark, sf_dir):
    return _round(metrics.average_precision(views.pred(spark, sf_dir), K), "average_precision")


part("guessed", "SELECT *, CAST(list_position(logits, list_max(logits)) - 1 AS INT) AS guess FROM class_pred")


def per_class_sql(source: str) -> str:
    return f"""
SELECT batch, class, sum(actual) AS actual, sum(guessed) AS guessed, sum(hit) AS hit FROM (
  SELECT batch, label AS class, 1 AS actual, 0 AS guessed, CASE WHEN label = guess THEN 1 ELSE 0 END AS hit FROM {source}
  UNION ALL SELECT batch, guess, 0, 1, 0 FROM {source}) GROUP BY batch, class
"""


_MULTI = """
round(sum(hit) / sum(actual), 6) AS accuracy_micro, round(sum(hit) / sum(actual), 6) AS f1_micro,
round(avg(CASE WHEN actual > 0 THEN hit / actual END), 6) AS accuracy_macro,
round(avg(CASE WHEN actual + guessed = 0 THEN 0 ELSE 2 * hit / (actual + guessed) END), 6) AS f1_macro
"""
_MULTI_NAMES = ["accuracy_micro", "f1_micro", "accuracy_macro", "f1_macro"]


@query("multiclass_metrics", f"SELECT {_KEY}, {_MULTI} FROM ({per_class_sql('guessed')}) GROUP BY batch")
def multiclass_metrics(spark, sf_dir):
    return _round(metrics.multiclass_metrics(metrics.with_class(views.class_pred(spark, sf_dir)), K), *_MULTI_NAMES)


part("one_vs_rest", """
SELECT batch, label, class, e / total AS score, CASE WHEN label = class THEN 1 ELSE 0 END AS is_class FROM (
  SELECT batch, label, CAST(unnest(range(10)) AS INT) AS class, unnest(list_transform(logits, lambda z: exp(z - list_max(logits)))) AS e,
         list_sum(list_transform(logits, lambda z: exp(z - list_max(logits)))) AS total FROM class_pred)
""")
part("class_steps", steps_sql("one_vs_rest", "class", "score", "is_class"))


@query("multiclass_auroc", f"""
SELECT CAST(class AS BIGINT) AS class, round({_AUROC}, 5) AS auroc, round({_AP}, 5) AS average_precision FROM class_steps GROUP BY class
""")
def multiclass_auroc(spark, sf_dir):
    return _round(metrics.multiclass_ranking(views.class_pred(spark, sf_dir), []), "auroc", "average_precision", digits=5)


@query("multiclass_auroc_macro", f"""
SELECT round(avg(auroc), 5) AS auroc, round(avg(average_precision), 5) AS average_precision
FROM (SELECT class, {_AUROC} AS auroc, {_AP} AS average_precision FROM class_steps GROUP BY class)
""")
def multiclass_auroc_macro(spark, sf_dir):
    per_class = metrics.multiclass_ranking(views.class_pred(spark, sf_dir), [])
    return _round(metrics.macro(per_class, []), "auroc", "average_precision", digits=5)


@query("confusion_matrix", """
SELECT CAST(l AS BIGINT) AS label, CAST(p AS BIGINT) AS pred, count(edge_id) AS events
FROM (SELECT unnest(range(10)) AS l) CROSS JOIN (SELECT unnest(range(10)) AS p) LEFT JOIN guessed ON label = l AND guess = p GROUP BY l, p
""")
def confusion_matrix(spark, sf_dir):
    return whole(metrics.confusion_matrix(metrics.with_class(views.class_pred(spark, sf_dir)), CLASSES), "label", "pred")


part("mal", "SELECT batch, CASE WHEN guess > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS score, CASE WHEN label > 0 THEN 1 ELSE 0 END AS label FROM guessed")
part("mal_steps", steps_sql("mal", "batch", "score", "label"))


@query("malicious_metrics", f"""
SELECT {_KEY}, tp, fp, tn, fn, {_BINARY}, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision
FROM (SELECT batch, {_COUNTS} FROM mal GROUP BY batch)
JOIN (SELECT batch, {_AUROC} AS auroc, {_AP} AS average_precision FROM mal_steps GROUP BY batch) USING (batch)
""")
def malicious_metrics(spark, sf_dir):
    """Malicious or not from hard class decisions."""
    hard = metrics.malicious_view(metrics.with_class(views.class_pred(spark, sf_dir)))
    steps = metrics.score_steps(hard, K, "mal_score", "mal_label")
    counts = metrics.stat_scores(hard, K, F.col("mal_score"), "mal_label").drop("support")
    out = (
        counts.join(metrics.binary_metrics(hard, K, F.col("mal_score"), "mal_label"), K)
        .join(metrics.auroc_from_steps(steps, K), K).join(metrics.average_precision_from_steps(steps, K), K)
    )
    return _round(out, "accuracy", "f1", "auroc", "average_precision")


part("bad_only", "SELECT * FROM guessed WHERE label > 0 AND batch <> 3")
part("bad_steps", steps_sql("(SELECT * FROM one_vs_rest WHERE label > 0 AND batch <> 3)", "batch, class", "score", "is_class"))


@query("malicious_only_metrics", f"""
SELECT CAST(b.batch AS BIGINT) AS batch, {', '.join(f'coalesce({n}, 0.0) AS {n}' for n in _MULTI_NAMES)},
       coalesce(auroc, 0.0) AS auroc, coalesce(average_precision, 0.0) AS average_precision
FROM (SELECT DISTINCT batch FROM class_pred) b
LEFT JOIN (SELECT batch, {_MULTI} FROM ({per_class_sql('bad_only')}) GROUP BY batch) m USING (batch)
LEFT JOIN (SELECT batch, round(avg(auroc), 5) AS auroc, round(avg(average_precision), 5) AS average_precision
           FROM (SELECT batch, class, {_AUROC} AS auroc, {_AP} AS average_precision FROM bad_steps GROUP BY batch, class) GROUP BY batch) r USING (batch)
""")
def malicious_only_metrics(spark, sf_dir):
    """Batch 3 is given benign labels, so one batch has no malicious row."""
    pred = views.class_pred(spark, sf_dir).withColumn("label", F.when(F.col("batch") == 3, 0).otherwise(F.col("label")))
    out = metrics.malicious_only_metrics(pred, K)
    out = _round(out, *_MULTI_NAMES)
    return out.withColumns({n: F.round(n, 5) for n in ("auroc", "average_precision")})


_BCE = "greatest({x}, 0) - {x} * {y} + ln(1 + exp(-abs({x})))"


@query("bce_loss", f"SELECT {_KEY}, round(avg({_BCE.format(x='logit', y='label')}), 6) AS pred_loss FROM pred GROUP BY batch")
def bce_loss(spark, sf_dir):
    return _round(metrics.bce_loss(views.pred(spark, sf_dir), K, "logit", "label"), "pred_loss")


part("losses", f"""
SELECT batch, label, list_max(logits) + ln(list_sum(list_transform(logits, lambda z: exp(z - list_max(logits))))) - logits[label + 1] AS ce,
       CASE WHEN label = 0 THEN 1.0::DOUBLE ELSE 5.0 END AS w, 1 / (1 + exp(-link_logit)) AS prob, {_BCE.format(x='link_logit', y='link_label')} AS bce
FROM class_pred
""")
_CE = "sum(w * ce) / sum(w)"


@query("weighted_ce_loss", f"SELECT {_KEY}, round({_CE}, 6) AS class_loss, round(avg(ce), 6) AS plain_class_loss FROM losses GROUP BY batch")
def weighted_ce_loss(spark, sf_dir):
    out = metrics.weighted_ce_loss(views.class_pred(spark, sf_dir), K, "logits", "label")
    return _round(out, "class_loss", "plain_class_loss")


@query("confidence_loss", f"SELECT {_KEY}, round(avg(ce * prob), 6) AS confidence_loss FROM losses GROUP BY batch")
def confidence_loss(spark, sf_dir):
    out = metrics.confidence_loss(views.class_pred(spark, sf_dir), K, "logits", "label", sigmoid(F.col("link_logit")))
    return _round(out, "confidence_loss")


_LOSS_NAMES = ["pred_loss", "class_loss", "confidence_loss", "share", "loss_pred_only", "loss_alpha", "loss_v2", "loss_observed"]


@query("combined_losses", f"""
SELECT {_KEY}, round(p, 6) AS pred_loss, round(c, 6) AS class_loss, round(conf, 6) AS confidence_loss, round(q, 6) AS share, round(p, 6) AS loss_pred_only,
       round(p * 1.2::DOUBLE + c, 6) AS loss_alpha, round(p * (1 - q) + c * q, 6) AS loss_v2, round(p + 0.8::DOUBLE * plain, 6) AS loss_observed
FROM (SELECT batch, avg(bce) AS p, {_CE} AS c, avg(ce) AS plain, avg(ce * prob) AS conf,
             greatest(avg(CASE WHEN label > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 0.2::DOUBLE) AS q FROM losses GROUP BY batch)
""")
def combined_losses(spark, sf_dir):
    out = metrics.combined_losses(views.class_pred(spark, sf_dir), K, "logits", "label", "link_logit", "link_label")
    return _round(out, *_LOSS_NAMES)


part("window_losses", f"""
SELECT batch, step, avg(bce) + 0.8::DOUBLE * avg(ce) AS loss FROM (
  SELECT CAST(vec_id % 4 AS INT) AS batch, vec_id // 4 % 6 AS step, {_BCE.format(x='CAST(embedding[11] AS DOUBLE)', y='CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END')} AS bce,
         list_max(z) + ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) - z[label + 1] AS ce
  FROM (SELECT *, list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE)) AS z FROM embeddings)) GROUP BY batch, step
""")


@query("window_mean_loss", f"SELECT {_KEY}, count(*) AS windows, round(avg(loss), 6) AS mean_loss_observed FROM window_losses GROUP BY batch")
def window_mean_loss(spark, sf_dir):
    """Loss of every target window, averaged over the windows of a batch."""
    pred = views.class_pred(spark, sf_dir).withColumn("step", F.floor(F.col("edge_id") / 4) % 6)
    per_window = metrics.combined_losses(pred, ["batch", "step"], "logits", "label", "link_logit", "link_label")
    return _round(stats.mean_over_windows(per_window, K, ["loss_observed"]), "mean_loss_observed")
