"""Models: exact prefix models first, then block models, fleets, trees and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import anomaly, drift, experts
from tidemark.operators.baselines import baseline_classifiers, baseline_regressors, class_list
from tidemark.operators.bayes import gaussian_nb
from tidemark.operators.neighbours import knn_class, knn_mean, nearest, neighbour_pairs
from tidemark.queries import block_sql, sql
from tidemark.queries.quality import CLS_OUT, shown_classification
from tidemark.queries.registry import query, snap
from tidemark.queries.sql import BEFORE, EV, EMB, ORD, with_
from tidemark.sources.tables import stream

# ---------------------------------------------------------------- naive Bayes


def nb_sql(src, y, features, name="nb"):
    parts = " ".join(
        f"""- 0.5 * ln(2 * pi() * greatest(v_{f}, 1e-9)) - ({f} - m_{f}) * ({f} - m_{f}) / (2 * greatest(v_{f}, 1e-9))""" for f in features
    )
    stats = ", ".join(
        f"avg(s.{f}) FILTER (WHERE s.{y} = lb.c) OVER w AS m_{f}, var_pop(s.{f}) FILTER (WHERE s.{y} = lb.c) OVER w AS v_{f}" for f in features
    )
    cols = ", ".join(f"s.{f}" for f in features)
    return f"""lb AS (SELECT DISTINCT {y} AS c FROM {src}),
{name}_st AS (SELECT s.step, lb.c, {cols}, count(*) FILTER (WHERE s.{y} = lb.c) OVER w AS cn, {stats} FROM {src} s, lb
  WINDOW w AS (PARTITION BY lb.c ORDER BY s.step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_sc AS (SELECT step, c, ln(cn / (step - 1)) {parts} AS score FROM {name}_st WHERE cn > 0),
{name} AS (SELECT step, c AS pred FROM {name}_sc QUALIFY row_number() OVER (PARTITION BY step ORDER BY score DESC, c) = 1)"""


NB = nb_sql("ev", "event_type", ("value", "hour", "k"))


@query("k3_naive_bayes", with_(EV, NB) + "SELECT ev.step, ev.event_type AS y, nb.pred FROM ev LEFT JOIN nb ON nb.step = ev.step")
def k3_naive_bayes(spark, d):
    st = stream(spark, d, "ev_multi")
    out = gaussian_nb(st, class_list(st), ["value", "hour", "k"])
    return out.select("step", F.col("event_type").alias("y"), F.col("naive_bayes").alias("pred"))


@query(
    "k3_naive_bayes_checkpoints",
    with_(
        ORD, sql.sized("ord", "floor"), nb_sql("ord", "o_orderstatus", ("o_totalprice", "month", "priority")),
        "preds AS (SELECT ord.step, o_orderstatus AS y, 'naive_bayes' AS model, nb.pred FROM ord LEFT JOIN nb ON nb.step = ord.step)",
        sql.classification_checkpoints("preds", "floor", "F"),
    )
    + CLS_OUT,
)
def k3_naive_bayes_checkpoints(spark, d):
    from tidemark.operators.metrics import classification_checkpoints, long_predictions

    st = stream(spark, d, "ord_multi")
    out = gaussian_nb(st, class_list(st), ["o_totalprice", "month", "priority"])
    preds = long_predictions(out, ["naive_bayes"], st.target)
    return shown_classification(classification_checkpoints(preds, st.n, "floor", positive="F"))


# ---------------------------------------------------------------- neighbours

NEAR = """near AS (
  SELECT t.step, c.step AS neighbour, c.{y} AS y, sqrt({d}) AS distance,
         row_number() OVER (PARTITION BY t.step ORDER BY {d}, c.step DESC) AS position
  FROM {src} t JOIN {src} c ON c.step < t.step AND c.step >= t.step - {w} QUALIFY position <= {k})"""
EV_DIST = "(t.value - c.value) * (t.value - c.value) + (t.hour - c.hour) * (t.hour - c.hour) + (t.k - c.k) * (t.k - c.k)"
ORD_DIST = "(t.month - c.month) * (t.month - c.month) + (t.priority - c.priority) * (t.priority - c.priority) + (t.state - c.state) * (t.state - c.state)"
EV_NEAR = NEAR.format(src="ev", y="event_type", d=EV_DIST, w=200, k=5)
ORD_NEAR = NEAR.format(src="ord", y="o_totalprice", d=ORD_DIST, w=200, k=5)


def vote_sql(weight, src="ev", y="event_type"):
    return f"""v AS (SELECT step, y, sum({weight}) AS w FROM near GROUP BY step, y),
p AS (SELECT step, y AS pred FROM v QUALIFY row_number() OVER (PARTITION BY step ORDER BY w DESC, y) = 1)
SELECT s.step, s.{y} AS y, p.pred FROM {src} s LEFT JOIN p ON p.step = s.step"""


def _ev_near(spark, d):
    st = stream(spark, d, "ev_multi")
    return st, nearest(st, ["value", "hour", "k"], 5, 200)


def _voted(spark, d, weighted):
    st, found = _ev_near(spark, d)
    return knn_class(found, class_list(st), weighted).select("step", "y", F.col("knn").alias("pred"))


@query("k5_knn", with_(EV, EV_NEAR, vote_sql("1.0")))
def k5_knn(spark, d):
    return _voted(spark, d, False)


@query("k6_weighted_knn", with_(EV, EV_NEAR, vote_sql("1.0 / (distance + 1e-9)")))
def k6_weighted_knn(spark, d):
    return _voted(spark, d, True)


@query(
    "r6_knn_regressor",
    with_(ORD, ORD_NEAR) + "SELECT ord.step, snap(coalesce(avg(near.y), 0.0), 4) AS pred FROM ord LEFT JOIN near ON near.step = ord.step GROUP BY ord.step",
)
def r6_knn_regressor(spark, d):
    st = stream(spark, d, "ord_reg")
    found = nearest(st, ["month", "priority", "state"], 5, 200)
    return knn_mean(found).select("step", snap("knn", 4).alias("pred"))


EMB_NEAR = """pairs AS (
  SELECT t.step, c.step AS neighbour, c.label AS y,
         list_sum(list_transform(list_zip(t.embedding, c.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS dd
  FROM emb t JOIN emb c ON c.step < t.step AND c.step >= t.step - 1000),
near AS (SELECT step, neighbour, y, sqrt(dd) AS distance, CAST(row_number() OVER (PARTITION BY step ORDER BY dd, neighbour DESC) AS INTEGER) AS position FROM pairs QUALIFY position <= 5)"""


@query("j7_neighbour_pairs", with_(EMB, EMB_NEAR) + "SELECT step, position, neighbour, snap(distance, 6) AS distance, y FROM near")
def j7_neighbour_pairs(spark, d):
    out = neighbour_pairs(stream(spark, d, "emb_multi"), ["embedding"], 5, 1000)
    return out.select("step", "position", "neighbour", snap("distance", 6).alias("distance"), "y")


@query("t4_k_nearest", with_(ORD, ORD_NEAR) + "SELECT step, CAST(max(neighbour) AS BIGINT) AS latest, count(*) AS found, snap(max(distance), 6) AS farthest FROM near GROUP BY step")
def t4_k_nearest(spark, d):
    found = nearest(stream(spark, d, "ord_reg"), ["month", "priority", "state"], 5, 200).filter(F.size("neighbours") > 0)
    return found.select(
        "step", F.array_max("neighbours.step").alias("latest"), F.size("neighbours").cast("long").alias("found"),
        snap(F.array_max("neighbours.distance"), 6).alias("farthest"),
    )


# ---------------------------------------------------------------- experts and drift


@query(
    "e6_voting",
    with_(EV, NB, sql.classifiers("ev", "event_type"),
          "allp AS (SELECT step, pred FROM preds UNION ALL SELECT step, pred FROM nb)",
          "v AS (SELECT step, pred, count(*) AS n FROM allp WHERE pred IS NOT NULL GROUP BY ALL)",
          "p AS (SELECT step, pred FROM v QUALIFY row_number() OVER (PARTITION BY step ORDER BY n DESC, pred) = 1)")
    + "SELECT ev.step, ev.event_type AS y, p.pred FROM ev LEFT JOIN p ON p.step = ev.step",
)
def e6_voting(spark, d):
    st = stream(spark, d, "ev_multi")
    classes = class_list(st)
    rows = gaussian_nb(st, classes, ["value", "hour", "k"], rows=baseline_classifiers(st, classes))
    out = experts.voting(rows, ["last_class", "majority", "naive_bayes"], classes)
    return out.select("step", F.col("event_type").alias("y"), F.col("voting").alias("pred"))


@query(
    "e8_exponential_weights",
    with_(
        EV, sql.regressors("ev", "value"), sql.fading("ev", "value"),
        "m AS (SELECT b.step, b.y, b.mean, b.no_change, f.pred AS fading FROM base b JOIN fade f ON f.step = b.step)",
        "l AS (SELECT *, " + ", ".join(f"coalesce(sum((y - {c}) * (y - {c})) OVER ({BEFORE}), 0.0) AS l_{c}" for c in ("mean", "fading", "no_change")) + " FROM m)",
        "w AS (SELECT *, " + ", ".join(f"exp(-0.5 * (l_{c} - least(l_mean, l_fading, l_no_change))) AS w_{c}" for c in ("mean", "fading", "no_change")) + " FROM l)",
    )
    + "SELECT step, snap((w_mean * mean + w_fading * fading + w_no_change * no_change) / (w_mean + w_fading + w_no_change), 6) AS pred FROM w",
)
def e8_exponential_weights(spark, d):
    st = stream(spark, d, "ev_reg")
    out = experts.exponential_weights(st, baseline_regressors(st), ["mean", "fading", "no_change"])
    return out.select("step", snap("ewa", 6).alias("pred"))


@query(
    "d1_adwin_cuts",
    with_(
        EV, sql.regressors("ev", "value"),
        "b AS (SELECT model, CAST(ceil(step / 200.0) AS BIGINT) AS block, count(*) AS n, sum(abs(y - pred)) AS s, sum((y - pred) * (y - pred)) AS q FROM preds GROUP BY ALL)",
        """c AS (SELECT model, block, sum(n) OVER w AS n0, sum(s) OVER w AS s0, sum(n) OVER p AS nt, sum(s) OVER p AS st, sum(q) OVER p AS qt FROM b
  WINDOW w AS (PARTITION BY model ORDER BY block), p AS (PARTITION BY model))""",
        """g AS (SELECT model, block, abs(s0 / n0 - (st - s0) / (nt - n0)) AS gap, greatest(0.0, qt / nt - (st / nt) * (st / nt)) AS var,
  1.0::DOUBLE / (1.0::DOUBLE / n0 + 1.0::DOUBLE / (nt - n0)) AS m, ln(2.0 * ln(nt) / 0.002) AS e FROM c WHERE nt > n0)""",
    )
    + "SELECT model, block, snap(gap, 6) AS gap, snap(sqrt(2.0 / m * var * e) + 2.0 / (3.0 * m) * e, 6) AS bound, gap > sqrt(2.0 / m * var * e) + 2.0 / (3.0 * m) * e AS drift FROM g",
)
def d1_adwin_cuts(spark, d):
    st = stream(spark, d, "ev_reg")
    rows = baseline_regressors(st, ("mean", "no_change"))
    parts = [rows.select("step", F.lit(m).alias("model"), F.abs(F.col("value") - F.col(m)).alias("e")) for m in ("mean", "no_change")]
    err = parts[0].unionByName(parts[1])
    blocks = err.groupBy("model", F.ceil(F.col("step") / 200).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q")
    )
    out = drift.cut_tests(blocks, ["model"])
    return out.select("model", "block", snap("gap", 6).alias("gap"), snap("bound", 6).alias("bound"), "drift")


@query(
    "d1_adwin_regression",
    with_(
        EV, sql.regressors("ev", "value"),
        "b AS (SELECT model, CAST(ceil(step / 200.0) AS BIGINT) AS block, count(*) AS n, sum(power(y - pred, 2)) AS s, sum(power(y - pred, 4)) AS q, max(power(y - pred, 2)) AS top FROM preds GROUP BY ALL)",
        """c AS (SELECT model, block, sum(n) OVER w AS n0, sum(s) OVER w AS s0, sum(n) OVER p AS nt, sum(s) OVER p AS st, sum(q) OVER p AS qt, max(top) OVER p AS span FROM b
  WINDOW w AS (PARTITION BY model ORDER BY block), p AS (PARTITION BY model))""",
        """g AS (SELECT model, block, abs(s0 / n0 - (st - s0) / (nt - n0)) AS gap, greatest(0.0, qt / nt - (st / nt) * (st / nt)) AS var, span,
  1.0::DOUBLE / (1.0::DOUBLE / n0 + 1.0::DOUBLE / (nt - n0)) AS m, ln(2.0 * ln(nt) / 0.002) AS e FROM c WHERE nt > n0)""",
    )
    + "SELECT model, block, snap(gap / span, 8) AS gap, snap((sqrt(2.0 / m * var * e) + span * 2.0 / (3.0 * m) * e) / span, 8) AS bound, gap > sqrt(2.0 / m * var * e) + span * 2.0 / (3.0 * m) * e AS drift FROM g",
)
def d1_adwin_regression(spark, d):
    """The same test on squared errors, whose range is not 1; shown as shares of the range."""
    rows = baseline_regressors(stream(spark, d, "ev_reg"), ("mean", "no_change"))
    parts = [rows.select("step", F.lit(m).alias("model"), F.pow(F.col("value") - F.col(m), F.lit(2)).alias("e")) for m in ("mean", "no_change")]
    blocks = parts[0].unionByName(parts[1]).groupBy("model", F.ceil(F.col("step") / 200).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q"), F.max("e").alias("top")
    )
    out = drift.cut_tests(blocks, ["model"]).join(blocks.groupBy("model").agg(F.max("top").alias("span")), "model")
    return out.select("model", "block", snap(F.col("gap") / F.col("span"), 8).alias("gap"), snap(F.col("bound") / F.col("span"), 8).alias("bound"), "drift")


# ---------------------------------------------------------------- anomaly scores

MOMENTS = f"""mo AS (SELECT *, count(value) OVER ({BEFORE}) AS cn, avg(value) OVER ({BEFORE}) AS m, stddev_samp(value) OVER ({BEFORE}) AS sd FROM ev)"""
ERF = "(1.0 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x))"
GAUSS = f"""z AS (SELECT *, abs(value - m) / sd / sqrt(2.0) AS x FROM mo),
ga AS (SELECT step, is_high, CASE WHEN cn >= 100 AND sd > 0 THEN {ERF} ELSE 0.0 END AS score FROM (SELECT *, 1.0 / (1.0 + 0.3275911 * x) AS t FROM z))"""


@query("n1_gaussian_scorer", with_(EV, MOMENTS, GAUSS) + "SELECT step, snap(score, 6) AS score FROM ga")
def n1_gaussian_scorer(spark, d):
    return anomaly.gaussian_scorer(stream(spark, d, "ev_anom"), "value").select("step", snap("gaussian", 6).alias("score"))


@query("n2_absolute_deviation", with_(EV, MOMENTS) + "SELECT step, snap(coalesce(abs(value - m) / (sd + 1e-10), 0.0), 6) AS score FROM mo")
def n2_absolute_deviation(spark, d):
    return anomaly.absolute_deviation(stream(spark, d, "ev_anom"), "value").select("step", snap("deviation", 6).alias("score"))


PREDICTIVE = f"""er AS (SELECT step, abs(y - pred) AS e FROM preds WHERE model = 'mean'),
pm AS (SELECT step, e, count(*) OVER ({BEFORE}) AS cn, avg(e) OVER ({BEFORE}) AS m, stddev_pop(e) OVER ({BEFORE}) AS sd FROM er),
pr AS (SELECT step, CASE WHEN cn > 0 AND m + 3 * sd > 0 THEN least(1.0, e / (m + 3 * sd)) ELSE 0.0 END AS score FROM pm)"""


@query("n3_predictive_scorer", with_(EV, sql.regressors("ev", "value"), PREDICTIVE) + "SELECT step, snap(score, 6) AS score FROM pr")
def n3_predictive_scorer(spark, d):
    st = stream(spark, d, "ev_reg")
    out = anomaly.predictive_scorer(st, baseline_regressors(st, ("mean",)), "mean")
    return out.select("step", snap("predictive", 6).alias("score"))


def _forecast_sql(horizon):
    lags = [f"value_lag{h}" for h in (horizon, horizon + 1)]
    source = EV + ",\nevl AS (SELECT *, " + ", ".join(f"lag(value, {c[9:]}) OVER (ORDER BY step) AS {c}" for c in lags) + " FROM ev)"
    known = f"{lags[1]} IS NOT NULL"
    tail = f""", er AS (SELECT step, CASE WHEN block > 1 AND step > {horizon + 1} THEN abs(y - pred) END AS e FROM ls),
pm AS (SELECT step, e, count(e) OVER ({BEFORE}) AS cn, avg(e) OVER ({BEFORE}) AS m, stddev_pop(e) OVER ({BEFORE}) AS sd FROM er)
SELECT step, snap(CASE WHEN e IS NOT NULL AND cn > 0 AND m + 3 * sd > 0 THEN least(1.0, e / (m + 3 * sd)) ELSE 0.0 END, 6) AS score FROM pm"""
    return block_sql.least_squares(source, "evl", lags, "value", 6, where=known, tail=tail)


@query("n3_forecast_scorer", _forecast_sql(1))
def n3_forecast_scorer(spark, d):
    """Errors of a linear forecast of the next value."""
    return anomaly.forecast_scorer(blocks_of(spark, d, "ev_reg"), "value").select("step", snap("predictive", 6).alias("score"))


@query("n3_forecast_scorer_horizon_5", _forecast_sql(5))
def n3_forecast_scorer_horizon_5(spark, d):
    return anomaly.forecast_scorer(blocks_of(spark, d, "ev_reg"), "value", horizon=5).select("step", snap("predictive", 6).alias("score"))


HST_FEATURES = {"value": (0.0, 500.0), "k": (0.0, 100.0), "hour": (0.0, 24.0)}


def hst_sql(height=8, trees=10, window=250):
    feature, cut = anomaly.half_space_trees(trees, height, len(HST_FEATURES))
    scaled = ", ".join(f"({c} - {lo}) / ({hi} - {lo})" for c, (lo, hi) in HST_FEATURES.items())
    rows = ", ".join(f"({t}, {[int(v) for v in feature[t]]}, {[float(v) for v in cut[t]]}::DOUBLE[])" for t in range(trees))
    ctes = [f"x AS (SELECT step, CAST((step - 1) // {window} AS BIGINT) AS blk, [{scaled}] AS v FROM ev)",
            f"tr(t, fs, cs) AS (VALUES {rows})",
            "d0 AS (SELECT step, blk, v, t, fs, cs, 0 AS node FROM x, tr)"]
    for h in range(height):
        ctes.append(f"d{h + 1} AS (SELECT step, blk, v, t, fs, cs, 2 * node + CASE WHEN v[fs[node + 1] + 1] >= cs[node + 1] THEN 2 ELSE 1 END AS node FROM d{h})")
    ctes.append("nodes AS (" + " UNION ALL ".join(f"SELECT step, blk, t, {h} AS depth, node FROM d{h}" for h in range(height + 1)) + ")")
    ctes.append("mass AS (SELECT blk + 1 AS blk, t, node, count(*) AS m FROM nodes GROUP BY ALL)")
    ctes.append("seen AS (SELECT n.step, n.t, n.depth, coalesce(m.m, 0) AS m FROM nodes n LEFT JOIN mass m ON m.blk = n.blk AND m.t = n.t AND m.node = n.node)")
    ctes.append(f"open AS (SELECT step, m * power(2, depth) AS s, coalesce(min(m) OVER (PARTITION BY step, t ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {window}) >= {0.1 * window} AS o FROM seen)")
    return with_(EV, *ctes) + f"SELECT step, snap(1.0 - coalesce(sum(s) FILTER (WHERE o), 0) / {trees * window * (2.0 ** (height + 1) - 1)}, 9) AS score FROM open GROUP BY step"


@query("n4_half_space_trees", hst_sql())
def n4_half_space_trees(spark, d):
    out = anomaly.half_space_scores(stream(spark, d, "ev_multi"), HST_FEATURES)
    return out.select("step", snap("score", 9).alias("score"))


@query(
    "n10_anomaly_checkpoints",
    with_(EV, sql.sized("ev", "floor"), MOMENTS, GAUSS, "preds AS (SELECT step, is_high AS y, 'gaussian' AS model, CAST(score > 0.5 AS INTEGER) AS pred FROM ga)",
          sql.classification_checkpoints("preds", "floor")) + CLS_OUT,
)
def n10_anomaly_checkpoints(spark, d):
    st = stream(spark, d, "ev_anom")
    scores = anomaly.gaussian_scorer(st, "value")
    return shown_classification(anomaly.evaluate(scores, st.n, "gaussian", "is_high"))


# ---------------------------------------------------------------- block models (updates at block ends)

from pyspark.sql import DataFrame  # noqa: E402

from tidemark.operators import ensembles, isolation, linear, mondrian, replay, rules  # noqa: E402
from tidemark.operators.linear import LinearBlock, MlpBlock, SoftmaxBlock, block_scaled  # noqa: E402
from tidemark.operators.trees import Forest, TreeSpec  # noqa: E402
from tidemark.plans.blocks import Blocks, run_blocks  # noqa: E402

N_BLOCKS = 6
EVF = ["value", "hour", "k"]
REGF = ["hour", "u", "k"]


def blocks_of(spark, d, name, least=N_BLOCKS):
    return Blocks.of_rows(stream(spark, d, name), least=least)


def class_index(st):
    classes = class_list(st)
    pairs = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    return F.element_at(pairs, F.col(st.target)), classes


def _linear(names, kind):
    def run(spark, d) -> DataFrame:
        blocks = blocks_of(spark, d, "ev_bin" if kind == "class" else "ev_reg", 10)
        feats = EVF if kind == "class" else REGF
        y = F.col("is_error" if kind == "class" else "value")
        models = [LinearBlock(n, feats, y, **opts) for n, opts in names.items()]
        out = run_blocks(blocks, models, block_scaled(blocks, feats))
        return out.select("step", y.alias("y"), *[snap(n, 6).alias(n) for n in names])

    return run


LINEAR_BLOCKS = {
    "k4_logistic_block": ("class", {"logistic": {"loss": "log", "rate": 0.5}, "logistic_slow": {"loss": "log", "rate": 0.005}}),
    "k9_alma_block": ("class", {"alma": {"loss": "alma"}}),
    "k10_passive_aggressive_block": ("class", {"pa": {"loss": "pa_class"}}),
    "r4_linear_block": ("reg", {"plain": {}, "ridge": {"l2": 1.0}, "lasso": {"l1": 1.0}}),
    "r5_passive_aggressive_block": ("reg", {"pa1": {"loss": "pa1"}, "pa2": {"loss": "pa2"}}),
}
for _name, (_kind, _models) in LINEAR_BLOCKS.items():
    _sql = block_sql.linear(_models, EVF if _kind == "class" else REGF, "is_error" if _kind == "class" else "value", 10)
    query(_name, _sql)(_linear(_models, _kind))


@query("k8_softmax_block", block_sql.softmax(EVF, ["click", "error", "purchase", "signup", "view"], "event_type", N_BLOCKS))
def k8_softmax_block(spark, d):
    blocks = blocks_of(spark, d, "ev_multi")
    y, classes = class_index(blocks.stream)
    out = run_blocks(blocks, [SoftmaxBlock("softmax", EVF, y, len(classes))], block_scaled(blocks, EVF))
    return out.select("step", y.cast("int").alias("y"), F.col("softmax").cast("int").alias("pred"))


_MLP = {"rate": 0.05, "scale": 50.0}
_first = MlpBlock("mlp", REGF, None, **_MLP).empty()


@query("r16_mlp_block", block_sql.perceptron(REGF, "value", N_BLOCKS, _first["w1"].tolist(), _first["w2"].tolist(), **_MLP))
def r16_mlp_block(spark, d):
    blocks = blocks_of(spark, d, "ev_reg")
    out = run_blocks(blocks, [MlpBlock("mlp", REGF, F.col("value"), **_MLP)], block_scaled(blocks, REGF))
    return out.select("step", snap("mlp", 6).alias("pred"))


@query(
    "r4_normal_sums",
    with_(ORD, "b AS (SELECT CAST(ceil(step / ceil((SELECT count(*) FROM ord) / 10.0)) AS INTEGER) AS block, * FROM ord)")
    + "SELECT block, count(*) AS n, snap(sum(month), 2) AS sm, snap(sum(month * month), 2) AS smm, snap(sum(month * priority), 2) AS smp, snap(sum(priority * o_totalprice), 2) AS spy FROM b GROUP BY block",
)
def r4_normal_sums(spark, d):
    sums = linear.product_sums(blocks_of(spark, d, "ord_reg", 10), ["month", "priority", "o_totalprice"])
    return sums.select(
        "block", F.col("`1*1`").cast("long").alias("n"), snap(F.col("`1*month`"), 2).alias("sm"), snap(F.col("`month*month`"), 2).alias("smm"),
        snap(F.col("`month*priority`"), 2).alias("smp"), snap(F.col("`priority*o_totalprice`"), 2).alias("spy"),
    )


@query("r4_normal_equations", block_sql.least_squares(ORD, "ord", ["month", "priority", "state"], "o_totalprice", 10))
def r4_normal_equations(spark, d):
    out = linear.normal_equations(blocks_of(spark, d, "ord_reg", 10), ["month", "priority", "state"], "o_totalprice")
    return out.select("step", snap("least_squares", 4).alias("pred"))


# ---------------------------------------------------------------- fleets (row by row, one model per user)


def _fleet(names, target, feats):
    def run(spark, d) -> DataFrame:
        st = stream(spark, d, "ev_keyed")
        models = {n: (lambda k, o=o: replay.OnlineLinear(k, **o)) for n, o in names.items()}
        out = replay.replay(st, models, feats, target)
        return out.select("user_id", "step", F.col("_y").alias("y"), *[snap(n, 6).alias(n) for n in names])

    return run


FLEETS = {
    "r4_linear_fleet": ("value", {"plain": {}, "ridge": {"l2": 1.0}, "lasso": {"l1": 1.0}}),
    "r5_passive_aggressive_fleet": ("value", {"pa1": {"loss": "pa1"}, "pa2": {"loss": "pa2"}}),
    "k4_logistic_fleet": ("is_error", {"logistic": {"loss": "log", "rate": 0.005}}),
    "k9_k10_margin_fleet": ("is_error", {"alma": {"loss": "alma"}, "pa": {"loss": "pa_class"}}),
}
for _name, (_target, _models) in FLEETS.items():
    _feats = REGF if _target == "value" else EVF
    query(_name, block_sql.fleets(_models, _feats, _target))(_fleet(_models, _target, _feats))

RUN_PLAN = {"plain": {}, "ridge": {"l2": 1.0}, "pa1": {"loss": "pa1"}}


@query("l5_all_models_fleet", block_sql.fleet_errors(RUN_PLAN, REGF, "value"))
def l5_all_models_fleet(spark, d):
    """Every (model, stream) pair in one job: the run plan is the model list times the keys."""
    st = stream(spark, d, "ev_keyed")
    out = replay.replay(st, {n: (lambda k, o=o: replay.OnlineLinear(k, **o)) for n, o in RUN_PLAN.items()}, REGF, "value")
    aggs = [F.avg(F.abs(F.col("_y") - F.col(n))).alias(f"mae_{n}") for n in RUN_PLAN]
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), *aggs)


# ---------------------------------------------------------------- trees and ensembles

CLASS_TREES = {
    "k11_hoeffding_tree": TreeSpec("pred"),
    "k12_efdt": TreeSpec("pred", revisit=True),
    "k13_hoeffding_adaptive_tree": TreeSpec("pred", on_drift="alternate"),
    "k14_adaptive_random_forest": TreeSpec("pred", members=10, rate=6.0, leaf_subset=2, reset="member", vote="accuracy"),
    "k16_streaming_random_patches": TreeSpec("pred", members=10, rate=6.0, subset=2, reset="member", vote="accuracy"),
    "e1_online_bagging": TreeSpec("pred", members=10, rate=1.0),
    "e2_adwin_bagging": TreeSpec("pred", members=10, rate=1.0, reset="worst"),
    "e3_leveraging_bagging": TreeSpec("pred", members=10, rate=6.0, reset="worst"),
    "e4_oza_boost": TreeSpec("pred", members=5, rate=1.0, boost="oza", vote="log_odds"),
    "e4_smooth_boost": TreeSpec("pred", members=5, boost="smooth"),
    "e5_dynamic_weighted_majority": TreeSpec("pred", subset=2, vote="majority"),
}
REG_TREES = {
    "r7_hoeffding_tree_regressor": TreeSpec("pred", kind="reg"),
    "r7_option_tree_regressor": TreeSpec("pred", kind="reg", options=10),
    "r8_hoeffding_adaptive_tree_regressor": TreeSpec("pred", kind="reg", on_drift="alternate"),
    "r9_stochastic_gradient_tree": TreeSpec("pred", kind="gradient", shrink=1.0),
    "r10_adaptive_random_forest_regressor": TreeSpec("pred", kind="reg", members=10, rate=6.0, leaf_subset=2, reset="member", vote="accuracy"),
    "r13_streaming_random_patches_regressor": TreeSpec("pred", kind="reg", members=10, rate=6.0, subset=2, reset="member"),
    "e1_bagging_regressor": TreeSpec("pred", kind="reg", members=10, rate=1.0, on_drift="alternate"),
    "r15_gradient_boosted_regression": TreeSpec("pred", kind="gradient", members=5, shrink=0.5),
}


def _class_tree(spec):
    def run(spark, d) -> DataFrame:
        blocks = blocks_of(spark, d, "ev_multi")
        y, classes = class_index(blocks.stream)
        out = Forest(blocks, spec, EVF, y, len(classes)).run()
        return out.select("step", y.cast("int").alias("y"), F.col("pred").cast("int").alias("pred"))

    return run


def _reg_tree(spec):
    def run(spark, d) -> DataFrame:
        blocks = blocks_of(spark, d, "ev_reg")
        out = Forest(blocks, spec, REGF, F.col("value")).run()
        return out.select("step", F.col("value").alias("y"), snap("pred", 6).alias("pred"))

    return run


for _name, _spec in CLASS_TREES.items():
    query(_name)(_class_tree(_spec))
for _name, _spec in REG_TREES.items():
    query(_name)(_reg_tree(_spec))


@query("k18_gradient_boosted_trees")
def k18_gradient_boosted_trees(spark, d):
    blocks = blocks_of(spark, d, "ev_bin")
    out = Forest(blocks, TreeSpec("pred", kind="gradient", members=5, shrink=0.5, log_loss=True), EVF, F.col("is_error")).run()
    return out.select("step", F.col("is_error").alias("y"), F.col("pred").cast("int").alias("pred"))


@query("k15_mondrian_forest")
def k15_mondrian_forest(spark, d):
    blocks = blocks_of(spark, d, "ev_multi")
    y, classes = class_index(blocks.stream)
    out = mondrian.mondrian_forest(blocks, EVF, y, len(classes))
    return out.select("step", y.cast("int").alias("y"), F.col("mondrian").cast("int").alias("pred"))


@query("r11_mondrian_forest_regressor")
def r11_mondrian_forest_regressor(spark, d):
    out = mondrian.mondrian_forest(blocks_of(spark, d, "ev_reg"), REGF, F.col("value"))
    return out.select("step", F.col("value").alias("y"), snap("mondrian", 6).alias("pred"))


@query("r12_model_rules")
def r12_model_rules(spark, d):
    out = rules.model_rules(blocks_of(spark, d, "ev_reg"), REGF, F.col("value"))
    return out.select("step", F.col("value").alias("y"), snap("model_rules", 6).alias("pred"))


@query("r14_nearest_leaves")
def r14_nearest_leaves(spark, d):
    spec = TreeSpec("pred", kind="reg", members=5, rate=6.0, leaf_subset=2)
    out = ensembles.NearestLeaves(blocks_of(spark, d, "ev_reg"), spec, REGF, F.col("value")).run()
    return out.select("step", F.col("value").alias("y"), snap("pred", 6).alias("pred"))


@query("k17_oversampled_tree")
def k17_oversampled_tree(spark, d):
    blocks = blocks_of(spark, d, "ev_bin")
    learn = ensembles.oversampled(blocks.stream, EVF, 1, copies=3)
    out = Forest(blocks, TreeSpec("pred"), EVF, F.col("is_error"), 2).run(blocks.kept(learn, "oversampled"))
    return out.select("step", F.col("is_error").alias("y"), F.col("pred").cast("int").alias("pred"))


@query("k19_shrubs_classifier")
def k19_shrubs_classifier(spark, d):
    blocks = blocks_of(spark, d, "ev_multi")
    y, classes = class_index(blocks.stream)
    out = ensembles.Shrubs(blocks, TreeSpec("pred", members=4, depth=3), EVF, y, len(classes)).run()
    return out.select("step", y.cast("int").alias("y"), F.col("pred").cast("int").alias("pred"))


@query("k19_shrubs_regressor")
def k19_shrubs_regressor(spark, d):
    out = ensembles.Shrubs(blocks_of(spark, d, "ev_reg"), TreeSpec("pred", kind="reg", members=4, depth=3), REGF, F.col("value")).run()
    return out.select("step", F.col("value").alias("y"), snap("pred", 6).alias("pred"))


@query("e7_stacking")
def e7_stacking(spark, d):
    blocks = blocks_of(spark, d, "ev_multi")
    y, classes = class_index(blocks.stream)
    out = ensembles.stacking(blocks, EVF, classes, y)
    return out.select("step", y.cast("int").alias("y"), F.col("stacking").cast("int").alias("pred"))


@query("k7_two_memories")
def k7_two_memories(spark, d):
    out = ensembles.two_memories(blocks_of(spark, d, "ev_multi"), EVF)
    return out.select("step", "y", F.col("sam").alias("pred"))


# ---------------------------------------------------------------- block anomaly scorers


@query(
    "n5_one_class_svm_block",
    block_sql.linear({"svm": {"loss": "one_class"}}, EVF, "is_high", 10).replace("x.y, ", "x.y AS is_high, ").replace(" AS svm FROM", " AS score FROM"),
)
def n5_one_class_svm_block(spark, d):
    blocks = blocks_of(spark, d, "ev_anom", 10)
    model = LinearBlock("svm", ["value", "hour", "k"], F.col("is_high"), loss="one_class", rate=0.1, nu=0.1)
    out = run_blocks(blocks, [model], block_scaled(blocks, ["value", "hour", "k"]))
    return out.select("step", "is_high", snap("svm", 6).alias("score"))


def _isolation(kind):
    def run(spark, d) -> DataFrame:
        out = isolation.tree_scores(blocks_of(spark, d, "ev_anom"), EVF, kind)
        return out.select("step", snap("score", 6).alias("score"))

    return run


query("n6_isolation_forest")(_isolation("path"))
query("n7_random_histogram_forest")(_isolation("histogram"))
query("n8_random_cut_forest")(_isolation("displacement"))


@query("n9_linear_autoencoder", block_sql.autoencoder(EVF, 10))
def n9_linear_autoencoder(spark, d):
    out = linear.linear_autoencoder(blocks_of(spark, d, "ev_anom", 10), EVF)
    return out.select("step", snap("autoencoder", 6).alias("score"))


@query("j8_state_before_block", with_(ORD, "b AS (SELECT step, o_totalprice AS y, CAST(ceil(step / ceil((SELECT count(*) FROM ord) / 10.0)) AS INTEGER) AS block FROM ord)",
       "s AS (SELECT block, sum(sum(y)) OVER w AS sy, sum(count(*)) OVER w AS n FROM b GROUP BY block WINDOW w AS (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
       + "SELECT step, b.block, snap(coalesce(sy / n, 0.0), 4) AS pred FROM b JOIN s ON s.block = b.block")
def j8_state_before_block(spark, d):
    """Rows meet the state fitted on the blocks before theirs (mean target as the state)."""
    blocks = blocks_of(spark, d, "ord_reg", 10)
    sums = linear.product_sums(blocks, ["o_totalprice"]).orderBy("block").collect()
    states, n, s = [], 0.0, 0.0
    for r in sums:
        states.append({"mean": s / n if n else 0.0})
        n, s = n + r["1*1"], s + r["1*o_totalprice"]
    return blocks.with_state(states, "mean double").select("step", "block", snap("mean", 4).alias("pred"))


@query("l6_user_block_model", block_sql.midrange(10))
def l6_user_block_model(spark, d):
    """A model written against the BlockModel interface: midrange of the target so far."""

    class MidRange:
        name, schema = "midrange", "lo double; hi double"

        def empty(self):
            return (0.0, 0.0)

        def totals(self, state):
            return {"lo": F.min("value"), "hi": F.max("value")}

        def learn(self, state, sums):
            return (min(state[0], sums["lo"]), max(state[1], sums["hi"]))

        def columns(self, state):
            return {"lo": float(state[0]), "hi": float(state[1])}

        def predict(self):
            return (F.col("midrange__lo") + F.col("midrange__hi")) / 2

    out = run_blocks(blocks_of(spark, d, "ev_reg", 10), [MidRange()])
    return out.select("step", snap("midrange", 6).alias("pred"))
