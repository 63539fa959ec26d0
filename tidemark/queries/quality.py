"""Checkpoints, running metrics and the baselines behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.baselines import baseline_classifiers, baseline_regressors, class_list
from tidemark.operators.metrics import (
    classification_checkpoints, long_predictions, regression_checkpoints, share_correct, trace,
)
from tidemark.plans.checkpoints import checkpoint_steps
from tidemark.queries import sql
from tidemark.queries.registry import query, snap
from tidemark.queries.sql import EV, LI, ORD, with_
from tidemark.sources.tables import stream

REG_OUT = "SELECT model, step, n_scored, snap(mae, 4) AS mae, snap(rmse, 4) AS rmse, snap(r2, 6) AS r2 FROM ck"
CLS_OUT = """SELECT model, step, CAST(n_scored AS BIGINT) AS n_scored, snap(accuracy, 6) AS accuracy, snap(prec, 6) AS prec,
  snap(recall, 6) AS recall, snap(f1, 6) AS f1, snap(macro, 6) AS macro FROM ck"""


def shown_regression(df):
    return df.select(
        "model", "step", "n_scored", snap("MAE", 4).alias("mae"), snap("RMSE", 4).alias("rmse"), snap("R2", 6).alias("r2")
    )


def shown_classification(df):
    return df.select(
        "model", "step", "n_scored", snap("Accuracy", 6).alias("accuracy"), snap("Precision", 6).alias("prec"),
        snap("Recall", 6).alias("recall"), snap("F1", 6).alias("f1"), snap("MacroF1", 6).alias("macro"),
    )


def _classified(spark, d, name):
    st = stream(spark, d, name)
    preds = baseline_classifiers(st, class_list(st))
    return st, long_predictions(preds, ["last_class", "majority"], st.target)


def _reg_sql(cte, src, y, rule):
    return with_(cte, sql.sized(src, rule), sql.regressors(src, y), sql.regression_checkpoints("preds", rule)) + REG_OUT


def _cls_sql(cte, src, y, rule, positive="1"):
    return (
        with_(cte, sql.sized(src, rule), sql.classifiers(src, y), sql.classification_checkpoints("preds", rule, positive)) + CLS_OUT
    )


def _steps_sql(rule):
    return with_(ORD, sql.sized("ord", rule)) + f"SELECT step, o_orderkey FROM ord, iv WHERE {sql.is_checkpoint(rule)}"


@query("w1_checkpoints_floor", _steps_sql("floor"))
def w1_checkpoints_floor(spark, d):
    st = stream(spark, d, "ord_reg")
    return checkpoint_steps(st.df, st.n, "floor").select("step", "o_orderkey")


@query("w1_checkpoints_ceil", _steps_sql("ceil"))
def w1_checkpoints_ceil(spark, d):
    st = stream(spark, d, "ord_reg")
    return checkpoint_steps(st.df, st.n, "ceil").select("step", "o_orderkey")


def _regression(name, y):
    def run(spark, d, rule="floor"):
        st = stream(spark, d, name)
        preds = baseline_regressors(st, ("mean", "no_change"))
        return shown_regression(regression_checkpoints(preds, st.n, ["mean", "no_change"], y, rule))

    return run


query("m7_m8_m9_orders", _reg_sql(ORD, "ord", "o_totalprice", "floor"))(_regression("ord_reg", "o_totalprice"))
query("m7_m8_m9_lineitem", _reg_sql(LI, "li", "l_extendedprice", "floor"))(_regression("li_reg", "l_extendedprice"))


@query("m7_m8_m9_events_ceil", _reg_sql(EV, "ev", "value", "ceil"))
def m7_m8_m9_events_ceil(spark, d):
    return _regression("ev_reg", "value")(spark, d, "ceil")


@query("m1_m6_events_multiclass", _cls_sql(EV, "ev", "event_type", "floor", "error"))
def m1_m6_events_multiclass(spark, d):
    st, preds = _classified(spark, d, "ev_multi")
    return shown_classification(classification_checkpoints(preds, st.n, "floor", positive="error"))


@query("m1_m6_events_binary", _cls_sql(EV, "ev", "is_error", "ceil"))
def m1_m6_events_binary(spark, d):
    st, preds = _classified(spark, d, "ev_bin")
    return shown_classification(classification_checkpoints(preds, st.n, "ceil"))


@query("m1_m6_orders_multiclass", _cls_sql(ORD, "ord", "o_orderstatus", "floor", "F"))
def m1_m6_orders_multiclass(spark, d):
    st, preds = _classified(spark, d, "ord_multi")
    return shown_classification(classification_checkpoints(preds, st.n, "floor", positive="F"))


@query(
    "f7_skip_first",
    with_(ORD, sql.sized("ord", "ceil"), sql.regressors("ord", "o_totalprice"), "later AS (SELECT * FROM preds WHERE step > 1)",
          sql.regression_checkpoints("later", "ceil")) + REG_OUT,
)
def f7_skip_first(spark, d):
    st = stream(spark, d, "ord_reg")
    preds = baseline_regressors(st, ("mean", "no_change"))
    return shown_regression(regression_checkpoints(preds, st.n, ["mean", "no_change"], "o_totalprice", "ceil", skip_first=True))


@query(
    "m10_share_correct",
    with_(EV, sql.classifiers("ev", "event_type"))
    + "SELECT model, count(*) AS n_rows, snap(avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END), 6) AS share_correct FROM preds GROUP BY model",
)
def m10_share_correct(spark, d):
    _, preds = _classified(spark, d, "ev_multi")
    return share_correct(preds).withColumn("share_correct", snap("share_correct", 6))


@query(
    "m10_share_correct_first_1000",
    with_(EV, sql.classifiers("ev", "event_type"))
    + "SELECT model, count(*) AS n_rows, snap(avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END), 6) AS share_correct FROM preds WHERE step <= 1000 GROUP BY model",
)
def m10_share_correct_first_1000(spark, d):
    """The first 1,000 rows are the feature (a smoke score)."""
    _, preds = _classified(spark, d, "ev_multi")
    return share_correct(preds, 1000).withColumn("share_correct", snap("share_correct", 6))


@query(
    "m11_trace",
    with_(
        EV,
        sql.classifiers("ev", "event_type"),
        """r AS (SELECT step, y, pred FROM preds WHERE model = 'last_class' AND step <= 50),
a AS (SELECT t.step, c.c, count(*) FILTER (WHERE r.y = c.c) AS sup, count(*) FILTER (WHERE r.pred = c.c) AS prd,
  count(*) FILTER (WHERE r.y = c.c AND r.pred = c.c) AS tp
  FROM r t JOIN r ON r.step <= t.step AND r.pred IS NOT NULL JOIN lbl c ON true GROUP BY ALL),
g AS (SELECT step, sum(tp) / sum(sup) AS acc, avg(2.0 * tp / nullif(sup + prd, 0)) AS macro FROM a GROUP BY step)""",
    )
    + """SELECT r.step, r.y, r.pred, coalesce(r.y = r.pred, false) AS correct, snap(coalesce(acc, 0), 6) AS accuracy,
  snap(coalesce(macro, 0), 6) AS macro FROM r LEFT JOIN g ON g.step = r.step""",
)
def m11_trace(spark, d):
    """The first 50 rows are the feature (a display)."""
    st = stream(spark, d, "ev_multi")
    classes = class_list(st)
    preds = baseline_classifiers(st, classes, ("last_class",)).select("step", F.col("event_type").alias("y"), F.col("last_class").alias("pred"))
    out = trace(st, preds, classes, 50)
    return out.select("step", "y", "pred", "correct", snap("Accuracy", 6).alias("accuracy"), snap("MacroF1", 6).alias("macro"))


@query("m12_state_and_time")
def m12_state_and_time(spark, d):
    from tidemark.operators.runs import timed_checkpoints

    return timed_checkpoints(stream(spark, d, "ord_reg"))


@query(
    "a10_valid_updates",
    with_(EV, sql.sized("ev", "floor"), sql.classifiers("ev", "event_type"))
    + """, v AS (SELECT model, least(((step - 1) // iv + 1) * iv, n) AS step, count(*) FILTER (WHERE pred IS NOT NULL) AS valid_updates FROM preds, iv GROUP BY ALL)
SELECT model, step, valid_updates, CAST(sum(valid_updates) OVER (PARTITION BY model ORDER BY step) AS BIGINT) AS total_valid FROM v""",
)
def a10_valid_updates(spark, d):
    st, preds = _classified(spark, d, "ev_multi")
    ck = classification_checkpoints(preds, st.n, "floor")
    return ck.select("model", "step", "valid_updates", F.col("n_scored").alias("total_valid"))


# ---------------------------------------------------------------- baselines


@query("k1_last_class", with_(ORD) + "SELECT step, o_orderstatus AS y, lag(o_orderstatus) OVER (ORDER BY step) AS pred FROM ord")
def k1_last_class(spark, d):
    st = stream(spark, d, "ord_multi")
    return baseline_classifiers(st, [], ("last_class",)).select("step", F.col("o_orderstatus").alias("y"), F.col("last_class").alias("pred"))


@query(
    "k2_majority_class",
    with_(ORD, sql.classifiers("ord", "o_orderstatus")) + "SELECT step, y, pred FROM preds WHERE model = 'majority'",
)
def k2_majority_class(spark, d):
    st = stream(spark, d, "ord_multi")
    out = baseline_classifiers(st, class_list(st), ("majority",))
    return out.select("step", F.col("o_orderstatus").alias("y"), F.col("majority").alias("pred"))


@query("r1_mean", with_(LI, sql.regressors("li", "l_extendedprice")) + "SELECT step, snap(pred, 4) AS pred FROM preds WHERE model = 'mean'")
def r1_mean(spark, d):
    return baseline_regressors(stream(spark, d, "li_reg"), ("mean",)).select("step", snap("mean", 4).alias("pred"))


@query("r2_fading_mean", with_(ORD, sql.fading("ord", "o_totalprice")) + "SELECT step, y, snap(pred, 4) AS pred FROM fade")
def r2_fading_mean(spark, d):
    st = stream(spark, d, "ord_reg")
    out = baseline_regressors(st, ("fading",))
    return out.select("step", F.col("o_totalprice").alias("y"), snap("fading", 4).alias("pred"))


@query("r3_no_change", with_(LI, sql.regressors("li", "l_extendedprice")) + "SELECT step, pred FROM preds WHERE model = 'no_change'")
def r3_no_change(spark, d):
    return baseline_regressors(stream(spark, d, "li_reg"), ("no_change",)).select("step", F.col("no_change").alias("pred"))
