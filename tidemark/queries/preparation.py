"""Sources, sinks, stream preparation, filters, joins and set operations on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as col
from tidemark.operators import prepare as prep
from tidemark.operators.baselines import baseline_regressors
from tidemark.queries.registry import query, snap
from tidemark.queries.sql import BEFORE, EV, KEYED, LI, ORD, regressors, with_
from tidemark.session import scratch_path
from tidemark.sources import files
from tidemark.sources.tables import events, lineitems, stream, table

# ---------------------------------------------------------------- sources and sinks


def _saved_orders(spark, d):
    path = scratch_path(spark, "regression-orders") + ".csv"
    rows = stream(spark, d, "ord_reg").df.select("step", "month", "priority", "state", F.col("o_totalprice").alias("target"))
    files.save_labelled(rows, path)
    return path


@query("s1_labelled_csv", with_(ORD) + "SELECT step, month, priority, state, o_totalprice AS target FROM ord")
def s1_labelled_csv(spark, d):
    schema = "step long, month double, priority double, state double, target double"
    return files.read_labelled_csv(spark, _saved_orders(spark, d), schema)


@query(
    "s2_discover_datasets",
    with_(EV, ORD)
    + """SELECT 'Regression' AS task, 'orders' AS dataset, count(*) AS n_rows, 3 AS n_features, snap(sum(o_totalprice), 2) AS total FROM ord
UNION ALL SELECT 'Multiclass classification', 'events', count(*), 2, NULL FROM ev
UNION ALL SELECT 'Anomaly detection', 'high', count(*), 1, snap(sum(is_high), 2) FROM ev""",
)
def s2_discover_datasets(spark, d):
    base = scratch_path(spark, "datasets")
    ev, od = stream(spark, d, "ev_reg").df, stream(spark, d, "ord_reg").df
    files.save_labelled(od.select("month", "priority", "state", F.col("o_totalprice").alias("target")), f"{base}/regression/orders.csv")
    files.save_labelled(ev.select("value", "k", F.col("event_type").alias("target")), f"{base}/multiclass_classification/events.csv")
    files.save_labelled(ev.select("value", F.col("is_high").alias("target")), f"{base}/anomaly/high.csv")
    return (
        files.discover(spark, base)
        .groupBy("task", "dataset")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.max(F.size("x")).alias("n_features"),
            snap(F.sum(col.number_or_null(F.col("target"))), 2).alias("total"),
        )
    )


@query(
    "s3_positional_rows",
    with_(EV)
    + """SELECT event_id, value AS x0, CASE WHEN event_id % 5 = 1 THEN 0.0 ELSE hour END AS x1,
       CASE WHEN event_id % 5 = 1 OR event_id % 5 = 2 THEN 0.0 ELSE k END AS x2, event_type AS target
FROM ev WHERE event_id % 5 <> 4""",
)
def s3_positional_rows(spark, d):
    # ragged text lines derived from the events: short, unparsable, long and blank ones
    kind = F.col("event_id") % 5
    line = (
        F.when(kind == 1, F.concat_ws(",", "value", "event_type"))
        .when(kind == 2, F.concat_ws(",", "value", "hour", F.lit("n/a"), "event_type"))
        .when(kind == 3, F.concat_ws(",", "value", "hour", "k", "u", "event_type"))
        .when(kind == 4, F.lit("  "))
        .otherwise(F.concat_ws(",", "value", "hour", "k", "event_type"))
    )
    return files.positional_rows(events(spark, d).select("event_id", line.alias("value")), 3)


@query("s4_save_stream", with_(EV) + "SELECT step, hour, u, k, value AS target FROM ev")
def s4_save_stream(spark, d):
    path = scratch_path(spark, "saved")
    rows = stream(spark, d, "ev_reg").df.select("step", F.col("value").alias("target"), "hour", "u", "k")
    files.save_labelled(rows, path, fmt="parquet")
    return spark.read.parquet(path)


@query(
    "s5_dataset_summary",
    """SELECT 'Binary classification' AS task, 'errors' AS dataset, 'saved' AS status, count(*) AS n_rows, 3 AS n_features FROM events
UNION ALL SELECT 'Multiclass classification', 'insects', 'not saved', NULL, NULL
UNION ALL SELECT 'Regression', 'orders', 'saved', count(*), 3 FROM orders""",
)
def s5_dataset_summary(spark, d):
    planned = spark.createDataFrame(
        [("Binary classification", "errors"), ("Multiclass classification", "insects"), ("Regression", "orders")],
        "task string, dataset string",
    )
    od, ev = stream(spark, d, "ord_reg"), stream(spark, d, "ev_bin")
    saved = od.df.select(F.lit("orders").alias("dataset"), F.lit(len(od.features)).alias("f")).unionAll(
        ev.df.select(F.lit("errors").alias("dataset"), F.lit(len(ev.features)).alias("f"))
    )
    sizes = saved.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.max("f").alias("n_features"))
    out = planned.join(sizes, "dataset", "left_outer")
    status = F.when(F.col("n_rows").isNull(), "not saved").otherwise("saved")
    return out.select("task", "dataset", status.alias("status"), "n_rows", "n_features")


@query("s11_example_text", with_(EV) + "SELECT event_id, (CASE WHEN is_error = 1 THEN '1' ELSE '-1' END) || ' | value:' || value || ' hour:' || hour || ' k:' || k AS example FROM ev")
def s11_example_text(spark, d):
    path = scratch_path(spark, "examples")
    ev = events(spark, d)
    text = files.example_text(F.col("is_error"), {"value": F.col("value"), "hour": F.col("hour"), "k": F.col("k")})
    ev.select(F.concat_ws("\t", "event_id", text).alias("value")).write.text(path)
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].cast("long").alias("event_id"), parts[1].alias("example"))


# ---------------------------------------------------------------- preparation


@query("p1_step", with_(LI) + "SELECT step, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM li")
def p1_step(spark, d):
    return stream(spark, d, "li_reg").df.select("step", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("p1_step_keyed", with_(KEYED) + "SELECT step, user_id, event_id FROM evk")
def p1_step_keyed(spark, d):
    return stream(spark, d, "ev_keyed").df.select("step", "user_id", "event_id")


@query(
    "p2_number_coercion",
    """SELECT p_partkey, coalesce(TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE), 0.0) AS brand_no,
       coalesce(TRY_CAST(p_type AS DOUBLE), 0.0) AS type_no, TRY_CAST(p_name AS DOUBLE) AS name_or_null FROM part""",
)
def p2_number_coercion(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        col.number_or_zero(F.substring_index("p_brand", "#", -1)).alias("brand_no"),
        col.number_or_zero(F.col("p_type")).alias("type_no"),
        col.number_or_null(F.col("p_name")).alias("name_or_null"),
    )


@query(
    "p3_label_coercion",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' True ' WHEN 1 THEN 'no' WHEN 2 THEN '7' WHEN 3 THEN 'YES'
  WHEN 4 THEN 'False' ELSE o_orderstatus END AS label FROM orders)
SELECT o_orderkey, CASE WHEN trim(label) = '7' THEN 'int' WHEN lower(trim(label)) IN ('true', 'no', 'yes', 'false') THEN 'bool' ELSE 'string' END AS kind,
  CASE WHEN trim(label) = '7' THEN '7' WHEN lower(trim(label)) IN ('true', 'yes') THEN 'true' WHEN lower(trim(label)) IN ('no', 'false') THEN 'false' ELSE label END AS label_value FROM t""",
)
def p3_label_coercion(spark, d):
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, " True ").when(k == 1, "no").when(k == 2, "7").when(k == 3, "YES").when(k == 4, "False")
    rows = table(spark, d, "orders").select("o_orderkey", F.coalesce(text, F.col("o_orderstatus")).alias("label"))
    return rows.select("o_orderkey", col.label_kind(F.col("label")).alias("kind"), col.label_value(F.col("label")).alias("label_value"))


@query(
    "p4_label_index",
    with_(EV) + ", idx AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS label_index FROM (SELECT DISTINCT event_type FROM ev)) SELECT step, event_type, label_index FROM ev JOIN idx USING (event_type)",
)
def p4_label_index(spark, d):
    return prep.label_index(stream(spark, d, "ev_multi").df.select("step", "event_type"), "event_type").select("step", "event_type", "label_index")


@query("p4_label_sniff", with_(EV) + "SELECT count(*) FILTER (WHERE TRY_CAST(event_type AS DOUBLE) IS NULL) > 0 AS needs_encoding FROM ev")
def p4_label_sniff(spark, d):
    return prep.needs_encoding(stream(spark, d, "ev_multi").df, "event_type")


@query(
    "p5_first_true",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 2 WHEN o_totalprice > 300000 THEN 0
       WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END AS label_index FROM orders""",
)
def p5_first_true(spark, d):
    def text(c):
        return F.when(c, "True").otherwise("False")

    o = table(spark, d, "orders")
    literal = F.concat(
        F.lit("{'urgent': "), text(F.col("o_orderpriority") == "1-URGENT"), F.lit(", 'big': "), text(F.col("o_totalprice") > 300000),
        F.lit(", 'late': "), text(F.month("o_orderdate") > 6), F.lit("}"),
    )
    literal = F.when(F.col("o_orderkey") % 11 == 0, F.lit("{'urgent': Tr")).otherwise(literal)
    rows = o.select("o_orderkey", literal.alias("label"))
    return prep.first_true_index(rows, "label").select("o_orderkey", "label_index")


@query(
    "p6_metric_labels",
    with_(EV) + "SELECT event_id, CAST((k - 50) / 10 <> 0 AS INTEGER) AS from_float, is_error AS from_int, CAST(trunc((k - 50) / 10) AS INTEGER) AS multi FROM ev",
)
def p6_metric_labels(spark, d):
    pred = (F.col("k") - 50) / 10
    return events(spark, d).select(
        "event_id",
        col.binary_class(pred, is_float=True).alias("from_float"),
        col.binary_class(F.col("is_error"), is_float=False).alias("from_int"),
        col.whole_class(pred).alias("multi"),
    )


@query(
    "p7_one_vs_rest",
    """SELECT l_orderkey, l_linenumber, l_quantity AS f0, l_discount AS f1, l_tax AS f2, 0.0 AS f3,
       CAST(l_returnflag <> 'N' AS INTEGER) AS target FROM lineitem""",
)
def p7_one_vs_rest(spark, d):
    rows = lineitems(spark, d).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax",
        "l_linestatus", "l_returnflag",
    )
    return prep.one_vs_rest(rows, "l_returnflag", "N", drop=(1, 2, 3), keep=("l_orderkey", "l_linenumber"))


WINDOWS_SQL = "w AS (SELECT ts AS s, ts + INTERVAL 1 HOUR AS e FROM events WHERE event_type = 'purchase' AND value > 200)"


def _windows(spark, d):
    high = events(spark, d).filter((F.col("event_type") == "purchase") & (F.col("value") > 200))
    return high.select(F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("end"))


@query(
    "p8_interval_label",
    with_(EV, WINDOWS_SQL) + "SELECT event_id, CAST(EXISTS (SELECT 1 FROM w WHERE ev.ts BETWEEN w.s AND w.e) AS INTEGER) AS target FROM ev",
)
def p8_interval_label(spark, d):
    points = events(spark, d).select("event_id", "ts")
    return prep.interval_label(points, "ts", _windows(spark, d), "start", "end", 3600).select("event_id", "target")


@query(
    "p8_interval_file",
    with_(EV, WINDOWS_SQL) + "SELECT event_id, CAST(EXISTS (SELECT 1 FROM w WHERE ev.ts BETWEEN w.s AND w.e) AS INTEGER) AS target FROM ev",
)
def p8_interval_file(spark, d):
    """As above, with the intervals written as a JSON list of pairs and read back (one text an hour)."""
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("start", "end")]
    texts = _windows(spark, d).groupBy(F.date_trunc("hour", "start")).agg(F.to_json(F.collect_list(F.array(*shown))).alias("text"))
    points = events(spark, d).select("event_id", "ts")
    return prep.interval_label(points, "ts", prep.json_intervals(texts, "text"), "start", "end", 3600).select("event_id", "target")


@query(
    "p9_sparse_columns",
    with_(EV) + "SELECT event_id, " + ", ".join(f"CASE WHEN event_type = '{c}' THEN value ELSE 0.0 END AS x_{c}" for c in ("click", "error")) + ", k AS x_k, "
    + ", ".join(f"CASE WHEN event_type = '{c}' THEN value ELSE 0.0 END AS x_{c}" for c in ("purchase", "signup", "view")) + " FROM ev",
)
def p9_sparse_columns(spark, d):
    ev = stream(spark, d, "ev_reg").df
    rows = ev.select("step", "event_id", F.create_map(F.lit("k"), F.col("k"), F.col("event_type"), F.col("value")).alias("x"))
    return prep.sparse_to_columns(rows, "x").drop("step")


@query(
    "p10_standardised",
    with_(ORD)
    + f""", m AS (SELECT *, avg(month) OVER ({BEFORE}) AS mm, var_pop(month) OVER ({BEFORE}) AS mv,
  avg(o_totalprice) OVER ({BEFORE}) AS pm, var_pop(o_totalprice) OVER ({BEFORE}) AS pv FROM ord)
SELECT step, snap(CASE WHEN mv > 0 THEN (month - mm) / sqrt(mv) ELSE 0.0 END, 6) AS z_month,
  snap(CASE WHEN pv > 0 THEN (o_totalprice - pm) / sqrt(pv) ELSE 0.0 END, 6) AS z_price FROM m""",
)
def p10_standardised(spark, d):
    st = stream(spark, d, "ord")
    out = prep.standardised(st, ["month", "o_totalprice"])
    return out.select("step", snap("z_month", 6).alias("z_month"), snap("z_o_totalprice", 6).alias("z_price"))


@query(
    "p15_score_clamp",
    with_(EV) + """, s AS (SELECT event_id, (value - 20) / 100 AS score FROM ev)
SELECT event_id, snap(greatest(0.0, least(1.0, score)), 6) AS p_true, snap(1 - greatest(0.0, least(1.0, score)), 6) AS p_false,
  CAST(score > 0.5 AS INTEGER) AS pred FROM s""",
)
def p15_score_clamp(spark, d):
    score = (F.col("value") - 20) / 100
    p = col.probability(score)
    return events(spark, d).select(
        "event_id", snap(p, 6).alias("p_true"), snap(1 - p, 6).alias("p_false"), (score > 0.5).cast("int").alias("pred")
    )


# ---------------------------------------------------------------- filters


@query("f3_finite_rows", """SELECT p_partkey, p_retailprice, TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) AS pred FROM part
WHERE p_retailprice IS NOT NULL AND TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE) > 5""")
def f3_finite_rows(spark, d):
    from tidemark.operators.metrics import finite

    raw = col.number_or_null(F.substring_index("p_brand", "#", -1))
    # some predictions are missing, NaN or infinite: none of them may be scored
    pred = F.when(raw > 5, raw).when(raw > 3, F.lit(float("nan"))).when(raw > 1, F.lit(float("inf")))
    rows = table(spark, d, "part").select("p_partkey", "p_retailprice", pred.alias("pred"))
    return rows.filter(finite(F.col("p_retailprice")) & finite(F.col("pred")))


@query("f5_row_cap", with_(ORD) + "SELECT step, o_orderkey, o_totalprice FROM ord WHERE step <= 2000")
def f5_row_cap(spark, d):
    """The row cap is the feature: by step, so it is the same rows on every run."""
    return stream(spark, d, "ord_reg").df.filter(F.col("step") <= 2000).select("step", "o_orderkey", "o_totalprice")


@query(
    "f9_fallback_prediction",
    with_(EV) + """SELECT step, coalesce(CASE WHEN k > 50 THEN CAST(k AS INTEGER) END, CASE WHEN step - 1 > 20 THEN 0 END) AS pred,
  coalesce(CASE WHEN value > 20 THEN value / 500 END, 0.0) AS score FROM ev""",
)
def f9_fallback_prediction(spark, d):
    ev = stream(spark, d, "ev_multi").df
    failed = F.when(F.col("k") > 50, F.col("k").cast("int"))
    score = F.when(F.col("value") > 20, F.col("value") / 500)
    return ev.select("step", prep.filled_prediction(failed).alias("pred"), F.coalesce(score, F.lit(0.0)).alias("score"))


# ---------------------------------------------------------------- joins and sets on rows


@query(
    "j2_interval_hits",
    with_(EV, WINDOWS_SQL) + "SELECT event_id, value FROM ev WHERE EXISTS (SELECT 1 FROM w WHERE ev.ts BETWEEN w.s AND w.e)",
)
def j2_interval_hits(spark, d):
    points = events(spark, d).select("event_id", "ts", "value")
    out = prep.interval_label(points, "ts", _windows(spark, d), "start", "end", 3600)
    return out.filter(F.col("target") == 1).select("event_id", "value")


@query(
    "j4_name_lookup",
    """SELECT event_id, coalesce(CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' END, event_type) AS name FROM events""",
)
def j4_name_lookup(spark, d):
    names = spark.createDataFrame([("click", "Click"), ("view", "View")], "event_type string, common string")
    out = events(spark, d).join(F.broadcast(names), "event_type", "left")
    return out.select("event_id", F.coalesce("common", "event_type").alias("name"))


@query(
    "w5_previous_label",
    with_(EV) + "SELECT step, event_type, lag(event_type) OVER (ORDER BY step) AS previous FROM ev",
)
def w5_previous_label(spark, d):
    from tidemark.plans.prefix import scan

    st = stream(spark, d, "ev_multi")
    return scan(st, lags={"previous": F.col("event_type")}).select("step", "event_type", "previous")


@query(
    "w6_running_mean",
    with_(ORD, regressors("ord", "o_totalprice")) + "SELECT step, y, snap(pred, 4) AS pred FROM preds WHERE model = 'mean'",
)
def w6_running_mean(spark, d):
    st = stream(spark, d, "ord_reg")
    return baseline_regressors(st, ("mean",)).select("step", F.col("o_totalprice").alias("y"), snap("mean", 4).alias("pred"))


@query(
    "w6_running_mean_keyed",
    with_(KEYED) + f"""SELECT user_id, step, snap(coalesce(avg(value) OVER (PARTITION BY user_id {BEFORE}), 0.0), 6) AS mean,
  coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY step), 0.0) AS no_change FROM evk""",
)
def w6_running_mean_keyed(spark, d):
    st = stream(spark, d, "ev_keyed")
    out = baseline_regressors(st, ("mean", "no_change"))
    return out.select("user_id", "step", snap("mean", 6).alias("mean"), "no_change")
