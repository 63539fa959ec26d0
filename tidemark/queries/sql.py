"""Building blocks of the check SQL: the streams and the checkpoint tables as plain SQL."""

EV = """ev AS (
  SELECT row_number() OVER (ORDER BY event_id) AS step, event_id, ts, user_id, event_type, value,
         CAST(hour(ts) AS DOUBLE) AS hour, CAST(user_id % 10 AS DOUBLE) AS u,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k,
         CAST(event_type = 'error' AS INTEGER) AS is_error, CAST(value > 200 AS INTEGER) AS is_high
  FROM events)"""
ORD = """ord AS (
  SELECT row_number() OVER (ORDER BY o_orderkey) AS step, o_orderkey, o_orderdate, o_totalprice, o_orderstatus,
         CAST(month(o_orderdate) AS DOUBLE) AS month, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority,
         CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 2.0 WHEN 'P' THEN 3.0 END AS state
  FROM orders)"""
LI = """li AS (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS step, * FROM lineitem)"""
EMB = """emb AS (SELECT row_number() OVER (ORDER BY vec_id) AS step, vec_id, label, embedding FROM embeddings)"""
KEYED = """evk AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, user_id, event_id, value
  FROM events)"""
BEFORE = "ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def sized(src: str, rule: str) -> str:
    """Interval and length of a stream as a one-row CTE ``iv``."""
    if rule == "floor":
        return f"iv AS (SELECT count(*) AS n, greatest(1, count(*) // 50) AS iv FROM {src})"
    return f"iv AS (SELECT count(*) AS n, greatest(1, (count(*) + 49) // 50) AS iv FROM {src})"


def is_checkpoint(rule: str) -> str:
    return "(step % iv = 0 OR step = n)" if rule == "floor" else "(step % iv = 0 OR (n < iv AND step = n))"


def regressors(src: str, y: str) -> str:
    """(step, y, model, pred) of the three baselines in a CTE ``preds``."""
    return f"""base AS (
  SELECT step, CAST({y} AS DOUBLE) AS y,
         coalesce(avg(CAST({y} AS DOUBLE)) OVER ({BEFORE}), 0.0) AS mean,
         coalesce(lag(CAST({y} AS DOUBLE)) OVER (ORDER BY step), 0.0) AS no_change
  FROM {src}),
preds AS (
  SELECT step, y, 'mean' AS model, mean AS pred FROM base
  UNION ALL SELECT step, y, 'no_change', no_change FROM base)"""


def fading(src: str, y: str, factor: float = 0.99) -> str:
    """Faded mean from all pairs of a row and its earlier rows, in a CTE ``fade`` (step, y, pred)."""
    return f"""fade AS (
  SELECT t.step, any_value(CAST(t.{y} AS DOUBLE)) AS y,
         coalesce(sum(p.{y} * power({factor}, t.step - 1 - p.step)) / sum(power({factor}, t.step - 1 - p.step)), 0.0) AS pred
  FROM {src} t LEFT JOIN {src} p ON p.step < t.step GROUP BY t.step)"""


def regression_checkpoints(preds: str, rule: str) -> str:
    """(model, step, n_scored, mae, rmse, r2) in a CTE ``ck``; needs ``iv``."""
    return f"""cum AS (
  SELECT model, step, count(*) OVER w AS cn, sum(abs(y - pred)) OVER w AS ca, sum((y - pred) * (y - pred)) OVER w AS cs,
         sum(y) OVER w AS cy, sum(y * y) OVER w AS cq
  FROM {preds} WINDOW w AS (PARTITION BY model ORDER BY step)),
ck AS (
  SELECT model, step, cn AS n_scored, ca / cn AS mae, sqrt(cs / cn) AS rmse,
         CASE WHEN cn > 1 AND cq - cy * cy / cn > 0 THEN 1 - cs / (cq - cy * cy / cn) END AS r2
  FROM cum, iv WHERE {is_checkpoint(rule)})"""


def classifiers(src: str, y: str) -> str:
    """(step, y, model, pred) of last class and majority class in a CTE ``preds``."""
    return f"""lbl AS (SELECT DISTINCT {y} AS c FROM {src}),
seen AS (
  SELECT s.step, lbl.c, count(*) FILTER (WHERE s.{y} = lbl.c) OVER (PARTITION BY lbl.c ORDER BY s.step
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cnt
  FROM {src} s, lbl),
best AS (
  SELECT step, c FROM seen WHERE cnt > 0 QUALIFY row_number() OVER (PARTITION BY step ORDER BY cnt DESC, c) = 1),
preds AS (
  SELECT step, {y} AS y, 'last_class' AS model, lag({y}) OVER (ORDER BY step) AS pred FROM {src}
  UNION ALL
  SELECT s.step, s.{y}, 'majority', best.c FROM {src} s LEFT JOIN best ON best.step = s.step)"""


def classification_checkpoints(preds: str, rule: str, positive: str = "1") -> str:
    """(model, step, n_scored, accuracy, prec, recall, f1, macro) in a CTE ``ck``; needs ``iv``."""
    return f"""ok AS (SELECT model, step, y, pred, least(((step - 1) // iv + 1) * iv, n) AS ckp,
         ((step - 1) // iv + 1) * iv <= n AS full_block
  FROM {preds}, iv WHERE y IS NOT NULL AND pred IS NOT NULL),
sides AS (
  SELECT model, ckp, y AS c, count(*) AS sup, 0 AS prd, count(*) FILTER (WHERE y = pred) AS tp FROM ok GROUP BY ALL
  UNION ALL
  SELECT model, ckp, pred AS c, 0, count(*), 0 FROM ok GROUP BY ALL),
ats AS (SELECT DISTINCT model, ckp FROM ok),
cls AS (
  SELECT a.model, a.ckp, s.c, sum(s.sup) AS sup, sum(s.prd) AS prd, sum(s.tp) AS tp
  FROM ats a JOIN sides s ON s.model = a.model AND s.ckp <= a.ckp GROUP BY ALL),
ck AS (
  SELECT model, ckp AS step, sum(sup) AS n_scored, sum(tp) / sum(sup) AS accuracy,
         coalesce(sum(tp) FILTER (WHERE c::VARCHAR = '{positive}') / nullif(sum(prd) FILTER (WHERE c::VARCHAR = '{positive}'), 0), 0.0) AS prec,
         coalesce(sum(tp) FILTER (WHERE c::VARCHAR = '{positive}') / nullif(sum(sup) FILTER (WHERE c::VARCHAR = '{positive}'), 0), 0.0) AS recall,
         coalesce(2.0 * sum(tp) FILTER (WHERE c::VARCHAR = '{positive}') / nullif(sum(sup + prd) FILTER (WHERE c::VARCHAR = '{positive}'), 0), 0.0) AS f1,
         avg(2.0 * tp / (sup + prd)) AS macro
  FROM cls, iv WHERE {"true" if rule == "floor" else "ckp % iv = 0 OR n < iv"} GROUP BY model, ckp)"""
