"""Queries: prediction quality (E1, E2, E6, C8, C11, D10-D13, D16, E11, F9) and H3."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.operators import evaluate as V
from labelflow.operators.common import out, rank_value
from labelflow.plans.fixtures import best_with_truth, profile_preds, scored_preds
from labelflow.plans.registry import register
from labelflow.plans.sql_base import with_
from labelflow.sources.tables import table

KEYS = ["method", "label"]


def _scores(spark, sf_dir):
    return V.binarize(scored_preds(spark, sf_dir)).withColumn("score", rank_value("p"))


def _best(spark, sf_dir):
    return best_with_truth(spark, sf_dir)[1].drop("sequence_align")


@register("align_truth_scores", with_("scores") + """select method, header, label_true, label, round(p, 6) as p, y
    from scores""")
def q_align_truth_scores(spark, sf_dir):
    """C11 as a join of two tables on the header."""
    s, preds = profile_preds(spark, sf_dir)
    sc = V.binarize(V.align_truth_scores(preds, s.where(~F.col("is_train"))))
    return sc.select("method", "header", "label_true", "label", out("p", "p"), "y")


@register("roc_curve", with_("roc") + """select method, label, threshold, tp, fp,
    round(fpr, 6) as fpr, round(tpr, 6) as tpr from roc""")
def q_roc_curve(spark, sf_dir):
    r = V.roc_points(_scores(spark, sf_dir), KEYS, score="score")
    return r.select("method", "label", "threshold", "tp", "fp", out("fpr", "fpr"), out("tpr", "tpr"))


@register("auc_ovr", with_("auc_c") + "select method, label, round(auc, 6) as auc, P, N from auc_c")
def q_auc_ovr(spark, sf_dir):
    a = V.auc(_scores(spark, sf_dir), KEYS, score="score")
    return a.select("method", "label", out("auc", "auc"), "P", "N")


@register("auc_macro", with_("auc_c") + """select method, round(avg(auc), 6) as auc_macro, count(auc) as n_classes
    from auc_c group by method""")
def q_auc_macro(spark, sf_dir):
    m = V.macro_auc(V.auc(_scores(spark, sf_dir), KEYS, score="score"), ["method"])
    return m.select("method", out("auc_macro", "auc_macro"), "n_classes")


MACRO_ROC_SQL = with_("roc") + """,
pf as (select method, label, fpr, min(tpr) as tpr_lo, max(tpr) as tpr_hi from roc group by method, label, fpr),
grid as (select distinct method, fpr from roc),
cls as (select distinct method, label from roc),
u as (select method, label, fpr, tpr_lo, tpr_hi, false as g from pf
      union all select grid.method, cls.label, grid.fpr, null, null, true from grid join cls on grid.method = cls.method),
w as (select *,
  last_value(case when not g then fpr end ignore nulls) over (partition by method, label order by fpr, g
      rows between unbounded preceding and current row) as x0,
  last_value(tpr_hi ignore nulls) over (partition by method, label order by fpr, g
      rows between unbounded preceding and current row) as y0,
  first_value(case when not g then fpr end ignore nulls) over (partition by method, label order by fpr, g
      rows between 1 following and unbounded following) as x1,
  first_value(tpr_lo ignore nulls) over (partition by method, label order by fpr, g
      rows between 1 following and unbounded following) as y1
  from u)
select method, round(fpr, 6) as fpr, round(avg(case when fpr = x0 then y0 else y0 + (fpr - x0) * (y1 - y0) / (x1 - x0) end), 6)
  as mean_tpr from w where g group by method, fpr
"""


@register("macro_roc", MACRO_ROC_SQL)
def q_macro_roc(spark, sf_dir):
    pts = V.roc_points(_scores(spark, sf_dir), KEYS, score="score")
    m = V.macro_roc(pts, ["method"])
    return m.select("method", out("fpr", "fpr"), out("mean_tpr", "mean_tpr"))


@register("pool_thresholds", with_("roc") + "select distinct method, round(fpr, 6) as fpr from roc")
def q_pool_thresholds(spark, sf_dir):
    pts = V.roc_points(_scores(spark, sf_dir), KEYS, score="score")
    return pts.select("method", out("fpr", "fpr")).distinct()


@register("f1_by_method", with_("f1m") + """select method, round(f1_macro, 6) as f1_macro,
    round(f1_weighted, 6) as f1_weighted, round(accuracy, 6) as accuracy from f1m""")
def q_f1_by_method(spark, sf_dir):
    f = V.f1_scores(_best(spark, sf_dir), ["method"])
    return f.select("method", out("f1_macro", "f1_macro"), out("f1_weighted", "f1_weighted"), out("accuracy", "accuracy"))


AUC_BINARY_SQL = """with sc as (select cast(l.quality as integer) as y, cast(d.n_chars as double) as score
    from labels l join documents d on l.doc_id = d.doc_id),
tied as (select score, cast(sum(y) as bigint) as tp_d, cast(sum(1 - y) as bigint) as fp_d from sc group by score),
cum as (select *, sum(tp_d) over (order by score desc rows between unbounded preceding and current row) as tp from tied)
select round(sum(fp_d * (tp - tp_d / 2.0)) / (sum(tp_d) * sum(fp_d)), 6) as auc,
    cast(sum(tp_d) as bigint) as P, cast(sum(fp_d) as bigint) as N from cum
"""


@register("auc_binary", AUC_BINARY_SQL)
def q_auc_binary(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("y"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    sc = lab.join(docs, "doc_id").withColumn("g", F.lit(1))
    a = V.auc(sc, ["g"], score="score", y="y")
    return a.select(out("auc", "auc"), "P", "N")


@register("mean_metric_by", with_("bestt") + """select method, label_true, round(avg(p), 6) as mean_p, count(*) as n
    from bestt group by method, label_true""")
def q_mean_metric_by(spark, sf_dir):
    b = _best(spark, sf_dir)
    return b.groupBy("method", "label_true").agg(F.avg("p").alias("mean_p"), F.count(F.lit(1)).alias("n")) \
        .select("method", "label_true", out("mean_p", "mean_p"), "n")


METRICS_SQL = with_("f1m", "auc_c") + """select method, metric, round(value, 6) as value from (
    select method, 'f1_macro' as metric, f1_macro as value from f1m
    union all select method, 'f1_weighted', f1_weighted from f1m
    union all select method, 'accuracy', accuracy from f1m
    union all select method, 'auc_macro', avg(auc) from auc_c group by method) z"""


def _metrics(spark, sf_dir):
    f = V.f1_scores(_best(spark, sf_dir), ["method"])
    a = V.macro_auc(V.auc(_scores(spark, sf_dir), KEYS, score="score"), ["method"])
    long_f = f.unpivot(["method"], ["f1_macro", "f1_weighted", "accuracy"], "metric", "value")
    long_a = a.select("method", F.lit("auc_macro").alias("metric"), F.col("auc_macro").alias("value"))
    return long_f.unionByName(long_a).select("method", "metric", out("value", "value"))


@register("metrics_long", METRICS_SQL)
def q_metrics_long(spark, sf_dir):
    return _metrics(spark, sf_dir)


@register("evaluate_predictions", METRICS_SQL)
def q_evaluate_predictions(spark, sf_dir):
    """H3: per-method AUC and F1 summary (the ROC tables are roc_curve / macro_roc)."""
    return _metrics(spark, sf_dir)
