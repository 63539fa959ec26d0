"""Running quality metrics at checkpoints.

No window runs over raw rows: classification keeps a confusion count per block, regression a few sums per
block, and the cumulative step only sees the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.checkpoints import block, interval, n_blocks, reported
from tidemark.plans.prefix import scan
from tidemark.plans.stream import Stream


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def finite(c: Column) -> Column:
    """Neither missing nor NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def scored(df: DataFrame, kind: str, y: str = "y", pred: str = "pred", skip_first: bool = False) -> DataFrame:
    """Rows that count for a metric: both values present, and finite for regression."""
    if kind == "regression":
        keep = finite(F.col(y).cast("double")) & finite(F.col(pred).cast("double"))
    else:
        keep = F.col(y).isNotNull() & F.col(pred).isNotNull()
    return df.filter(keep & (F.col("step") > 1) if skip_first else keep)


def long_predictions(df: DataFrame, preds: list[str], y: str) -> DataFrame:
    """(step, y, model, pred) from a wide table with one prediction column per model."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("model"), F.col(f"`{p}`").alias("pred")) for p in preds]))
    return df.select("step", F.col(y).alias("y"), pairs.alias("p")).select("step", "y", "p.model", "p.pred")


def error_sums(preds: list[str], y: str) -> list[Column]:
    """Aggregates of the rows of a block that regression metrics are made of, for all prediction columns."""
    target = F.col(y).cast("double")
    aggs = []
    for i, p in enumerate(preds):
        pred = F.col(f"`{p}`").cast("double")
        ok = finite(target) & finite(pred)
        err = target - pred
        for name, value in {"n": F.lit(1.0), "a": F.abs(err), "s": err * err, "y": target, "q": target * target}.items():
            aggs.append(F.sum(F.when(ok, value)).alias(f"{name}_{i}"))
    return aggs


def regression_checkpoints(
    df: DataFrame, n: int, preds: list[str], y: str, rule: str = "floor", skip_first: bool = False
) -> DataFrame:
    """(model, step, n_scored, MAE, RMSE, R2) for all prediction columns in one pass over the rows."""
    if skip_first:
        df = df.filter(F.col("step") > 1)
    per_block = df.groupBy(block(F.col("step"), interval(n, rule)).alias("block")).agg(*error_sums(preds, y))
    return error_checkpoints(per_block, n, preds, rule)


def error_checkpoints(per_block: DataFrame, n: int, preds: list[str], rule: str = "floor") -> DataFrame:
    """Cumulative metrics from error sums per block."""
    every = interval(n, rule)
    rows = per_block.select(
        "block",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(p).alias("model"), *[F.coalesce(F.col(f"{k}_{i}"), F.lit(0.0)).alias(k) for k in "nasyq"])
                    for i, p in enumerate(preds)
                ]
            )
        ).alias("m"),
    ).select("block", "m.*")
    run = Window.partitionBy("model").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    cum = rows.select("model", "block", F.col("n").alias("valid"), *[F.sum(k).over(run).alias(f"c{k}") for k in "nasyq"])
    spread = F.col("cq") - F.col("cy") * F.col("cy") / F.col("cn")
    out = cum.select(
        "model",
        "block",
        F.col("cn").cast("long").alias("n_scored"),
        F.col("valid").cast("long").alias("valid_updates"),
        ratio(F.col("ca"), F.col("cn")).alias("MAE"),
        F.sqrt(ratio(F.col("cs"), F.col("cn"))).alias("RMSE"),
        F.when((F.col("cn") > 1) & (spread > 0), 1 - F.col("cs") / spread).alias("R2"),
    )
    return reported(out, n, every, rule)


def confusion(df: DataFrame, n: int, rule: str = "floor") -> DataFrame:
    """(model, block, y, pred, cnt) from long predictions: the only step that sees every row."""
    every = interval(n, rule)
    return df.groupBy("model", block(F.col("step"), every).alias("block"), "y", "pred").agg(
        F.count(F.lit(1)).alias("cnt")
    )


def classification_checkpoints(
    df: DataFrame, n: int, rule: str = "floor", positive: object = 1, skip_first: bool = False
) -> DataFrame:
    """(model, step, n_scored, Accuracy, Precision, Recall, F1, MicroF1, MacroF1) from (step, y, model, pred)."""
    counts = confusion(scored(df, "classification", skip_first=skip_first), n, rule)
    return confusion_checkpoints(counts, n, rule, positive)


def confusion_checkpoints(counts: DataFrame, n: int, rule: str = "floor", positive: object = 1) -> DataFrame:
    """Cumulative metrics from confusion counts per block."""
    every = interval(n, rule)
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y") == F.col("pred"), F.col("cnt")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("y").alias("cls"), F.col("cnt").alias("sup"), zero.alias("prd"), hit.alias("tp")),
        F.struct(F.col("pred").alias("cls"), zero.alias("sup"), F.col("cnt").alias("prd"), zero.alias("tp")),
    )
    per_class = (
        counts.select("model", "block", F.explode(sides).alias("s"))
        .groupBy("model", "block", "s.cls")
        .agg(F.sum("s.sup").alias("sup"), F.sum("s.prd").alias("prd"), F.sum("s.tp").alias("tp"))
    )
    # a class stays in the macro mean after its first block, so fill the blocks in between
    seen = per_class.groupBy("model", "cls").agg(F.min("block").alias("first"))
    filled = seen.select("model", "cls", F.explode(F.sequence(F.col("first"), F.lit(n_blocks(n, every)).cast("long"))).alias("block"))
    filled = filled.join(per_class, ["model", "cls", "block"], "left")
    run = Window.partitionBy("model", "cls").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    cum = filled.select(
        "model", "cls", "block", F.coalesce("sup", zero).alias("now"),
        *[F.sum(F.coalesce(c, zero)).over(run).alias(c) for c in ("sup", "prd", "tp")],
    )
    f1 = ratio(2.0 * F.col("tp"), F.col("sup") + F.col("prd"))
    pos = F.col("cls").cast("string") == F.lit(str(positive))

    def of(c):
        return F.coalesce(F.sum(F.when(pos, F.col(c))), zero)

    out = cum.groupBy("model", "block").agg(
        F.sum("sup").alias("n_scored"),
        F.sum("now").alias("valid_updates"),
        ratio(F.sum("tp"), F.sum("sup")).alias("Accuracy"),
        ratio(of("tp"), of("prd")).alias("Precision"),
        ratio(of("tp"), of("sup")).alias("Recall"),
        ratio(2.0 * of("tp"), of("sup") + of("prd")).alias("F1"),
        ratio(F.sum("tp"), F.sum("sup")).alias("MicroF1"),
        F.avg(f1).alias("MacroF1"),
    )
    return reported(out, n, every, rule)


def share_correct(df: DataFrame, first: int | None = None) -> DataFrame:
    """Share of rows predicted right; a missing prediction is wrong."""
    if first is not None:
        df = df.filter(F.col("step") <= first)
    right = F.coalesce(F.col("pred") == F.col("y"), F.lit(False))
    return df.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.when(right, 1.0).otherwise(0.0)).alias("share_correct")
    )


def trace(stream: Stream, preds: DataFrame, classes: list, rows: int = 50) -> DataFrame:
    """Row-by-row trace: label, prediction, correct, running Accuracy, MicroF1 and MacroF1.

    The running counts are prefix sums over the whole stream; only the display is cut to ``rows`` rows.
    """
    ok = F.col("pred").isNotNull() & F.col("y").isNotNull()
    right = F.when(ok & (F.col("pred") == F.col("y")), 1.0).otherwise(0.0)
    sums = {"p_n": F.when(ok, 1.0).otherwise(0.0), "p_hit": right}
    for i, c in enumerate(classes):
        sums[f"p_s{i}"] = F.when(ok & (F.col("y") == c), 1.0).otherwise(0.0)
        sums[f"p_p{i}"] = F.when(ok & (F.col("pred") == c), 1.0).otherwise(0.0)
        sums[f"p_t{i}"] = F.when(ok & (F.col("y") == c) & (F.col("pred") == c), 1.0).otherwise(0.0)
    now = {k: v for k, v in sums.items()}
    shown = preds.filter(F.col("step") <= rows)
    scanned = scan(stream, sums, rows=shown)
    tot = {k: F.col(k) + v for k, v in now.items()}
    f1s, seen = [], []
    for i in range(len(classes)):
        size = tot[f"p_s{i}"] + tot[f"p_p{i}"]
        f1s.append(ratio(2.0 * tot[f"p_t{i}"], size))
        seen.append(F.when(size > 0, 1.0).otherwise(0.0))
    macro = ratio(sum(f1s[1:], f1s[0]), sum(seen[1:], seen[0]))
    acc = ratio(tot["p_hit"], tot["p_n"])
    return scanned.select(
        "step", "y", "pred", (right > 0).alias("correct"), acc.alias("Accuracy"), acc.alias("MicroF1"), macro.alias("MacroF1")
    )
