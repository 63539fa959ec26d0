"""Prefix scans: the state before row t as an aggregate of the rows before t.

Totals per chunk are aggregated first (map side, chunks are short), the few totals are scanned, and one
window inside each chunk finishes the work. No task ever holds more than one chunk of a stream. All sums,
previous values and decayed sums of a query share one pass: one small shuffle for the totals, one shuffle
of the rows by chunk.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.stream import FILE_ROWS, MAX_BROADCAST_CHUNKS, Stream

# totals that one task may scan; above it the totals are scanned in two levels
GROUP = 4096
# tasks that the chunks of a long stream are dealt to
MAX_TASKS = 2048


def attach(rows: DataFrame, small: DataFrame, keys: list[str], n_small: int | None) -> DataFrame:
    """Join per-chunk values back; broadcast only when the number of chunks is known to be small."""
    if n_small is not None and n_small <= MAX_BROADCAST_CHUNKS:
        small = F.broadcast(small)
    return rows.join(small, keys, "left")


def _carry(past: Column, factor: float, size: int) -> Column:
    base, length = F.lit(float(factor)), F.lit(float(size))
    here = F.col("_chunk") - 1
    return F.aggregate(past, F.lit(0.0), lambda acc, p: acc + p["v"] * F.pow(base, (here - p["k"]) * length))


def _history(name: str, window) -> Column:
    return F.collect_list(F.struct(F.col("_chunk").alias("k"), F.col(name).alias("v"))).over(window)


def _before_one_level(totals, by, sums, lags, decays, size, reach):
    order = Window.partitionBy(*by).orderBy("_chunk")
    keys = f"PARTITION BY {', '.join(f'`{k}`' for k in by)} " if by else ""
    frame = f"({keys}ORDER BY _chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cols = [F.expr(f"coalesce(sum(`{c}`) OVER {frame}, 0D)").alias(f"_b_{c}") for c in sums]
    cols += [F.lag(c).over(order).alias(f"_b_{c}") for c in lags]
    cols += [
        _carry(_history(c, order.rowsBetween(-reach[c], -1)), factor, size).alias(f"_b_{c}")
        for c, (_, factor) in decays.items()
    ]
    return totals.select(*by, "_chunk", *cols)


def _before_two_levels(totals, by, sums, lags, decays, size, reach):
    """The same values when there are too many chunks for one task."""
    grouped = totals.withColumn("_group", F.floor(F.col("_chunk") / GROUP))
    outer = grouped.groupBy(*by, "_group").agg(F.count(F.lit(1)).alias("_size"), *[F.sum(c).alias(c) for c in sums])
    wide = Window.partitionBy(*by).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    outer = outer.select(*by, "_group", *[F.coalesce(F.sum(c).over(wide), F.lit(0.0)).alias(f"_o_{c}") for c in sums])
    near = Window.partitionBy(*by, "_group").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    inner = grouped.select(
        *by, "_group", "_chunk", *[F.coalesce(F.sum(c).over(near), F.lit(0.0)).alias(f"_i_{c}") for c in sums]
    )
    out = inner.join(outer, [*by, "_group"]).select(
        *by, "_chunk", *[(F.col(f"_i_{c}") + F.col(f"_o_{c}")).alias(f"_b_{c}") for c in sums]
    )
    if lags:
        # chunks are dense, so the row before a chunk's first row is the last row of the chunk before
        shifted = totals.select(*by, (F.col("_chunk") + 1).alias("_chunk"), *[F.col(c).alias(f"_b_{c}") for c in lags])
        out = out.join(shifted, [*by, "_chunk"], "left")
    for c, (_, factor) in decays.items():
        # overlapping spans of 2 * far chunks; a chunk is answered by the span in whose second half it lies
        far = reach[c]
        spans = F.array(F.lit(0), F.lit(far))
        spread = totals.select(*by, "_chunk", c, F.explode(spans).alias("_shift"))
        spread = spread.withColumn("_span", F.floor((F.col("_chunk") + F.col("_shift")) / (2 * far)))
        window = Window.partitionBy(*by, "_shift", "_span").orderBy("_chunk").rowsBetween(-far, -1)
        carried = spread.withColumn(f"_b_{c}", _carry(_history(c, window), factor, size))
        carried = carried.filter((F.col("_chunk") + F.col("_shift")) % (2 * far) >= far)
        out = out.join(carried.select(*by, "_chunk", f"_b_{c}"), [*by, "_chunk"], "left")
    return out


def scan(
    stream: Stream,
    sums: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    decays: dict[str, tuple[Column, float]] | None = None,
    rows: DataFrame | None = None,
    key: tuple[str, ...] = (),
) -> DataFrame:
    """Add one column per entry, each over the earlier rows of the stream only.

    ``sums``: sum of the expression (0.0 at the first row). ``lags``: its value in the row before (NULL at
    the first row). ``decays``: ``s = s * factor + value`` per row (0.0 at the first row); powers are taken
    relative to the chunk end, so nothing over- or underflows on long streams, and chunks so far back that
    their weight is 0.0 in double precision do not enter the carry. ``key`` adds columns that split the
    stream further; sums then run over the earlier rows with the same key (lags and decays need dense rows
    and are not available with a key).
    """
    sums, lags, decays = sums or {}, lags or {}, decays or {}
    if key and (lags or decays):
        raise ValueError("lags and decays need the whole stream, not a key of it")
    by = [*stream.by, *key]
    size = stream.chunk_rows
    for _, factor in decays.values():
        size = max(1, min(size, int(300 / -math.log(factor))))
    n_chunks = math.ceil(max(stream.n, 1) / size)
    reach = {c: max(1, math.ceil(750 / (-math.log(f) * size))) for c, (_, f) in decays.items()}

    rows = (stream.df if rows is None else rows).withColumn("_chunk", stream.chunk(size))
    held = {f"_v_{c}": e.cast("double") for c, e in sums.items()}
    held |= {f"_v_{c}": e for c, e in lags.items()}
    held |= {f"_v_{c}": e.cast("double") for c, (e, _) in decays.items()}
    if decays:
        held["_place"] = (F.col("step") - 1 - F.col("_chunk") * size).cast("double")  # 0 .. size - 1

    aggs = [F.sum(f"_v_{c}").alias(c) for c in sums]
    aggs += [
        F.sum(F.col(f"_v_{c}") * F.pow(F.lit(float(f)), F.lit(size - 1.0) - F.col("_place"))).alias(c)
        for c, (_, f) in decays.items()
    ]
    totals = rows.withColumns(held).groupBy(*by, "_chunk").agg(*(aggs or [F.count(F.lit(1)).alias("_rows")]))
    if lags:
        # last rows of full chunks, no chunk follows another; as aggregates, texts among them would have all rows sorted
        last = rows.where(F.col("step") % size == 0).select(*by, "_chunk", *[e.alias(c) for c, e in lags.items()])
        totals = attach(totals, last, [*by, "_chunk"], None if by else n_chunks)
    levels = _before_one_level if n_chunks <= GROUP else _before_two_levels
    before = levels(totals, by, sums, lags, decays, size, reach)

    # rows are shuffled as they came: what is summed is computed behind the shuffle, what was before a chunk is joined at the end
    # a long stream has tasks of about a chunk each, short ones are put together by size
    tasks = [] if by or size < FILE_ROWS else [min(2 * n_chunks, MAX_TASKS)]
    rows = rows.repartition(*tasks, *by, "_chunk").withColumns(held)
    order = Window.partitionBy(*by, "_chunk").orderBy("step")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    # as text: there may be many sums, and one parsed expression is cheaper than a tree of column calls
    keys = ", ".join(f"`{k}`" for k in (*by, "_chunk"))
    frame = f"(PARTITION BY {keys} ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    here = {f"_h_{c}": F.expr(f"coalesce(sum(`_v_{c}`) OVER {frame}, 0D)") for c in sums}
    here |= {f"_h_{c}": F.lag(f"_v_{c}").over(order) for c in lags}
    for c, (_, factor) in decays.items():
        base, place = F.lit(float(factor)), F.col("_place")
        here[f"_h_{c}"] = F.coalesce(F.sum(F.col(f"_v_{c}") * F.pow(base, -place)).over(past) * F.pow(base, place - 1), zero)
    if lags:
        here["_first"] = F.lag("step").over(order).isNull()  # one frame for this and the lags
    rows = attach(rows.withColumns(here), before, [*by, "_chunk"], None if by else n_chunks)

    out = {c: F.expr(f"coalesce(`_b_{c}`, 0D) + `_h_{c}`") for c in sums}
    for c in lags:
        out[c] = F.when(F.col("_first"), F.col(f"_b_{c}")).otherwise(F.col(f"_h_{c}"))
    for c, (_, factor) in decays.items():
        out[c] = F.col(f"_h_{c}") + F.coalesce(F.col(f"_b_{c}"), zero) * F.pow(F.lit(float(factor)), F.col("_place"))
    return rows.withColumns(out).drop("_chunk", *held, *here, *[f"_b_{c}" for c in (*sums, *lags, *decays)])


def lagged(stream: Stream, column: str, lags: list[int], rows: DataFrame | None = None) -> DataFrame:
    """Add ``<column>_lag<h>``, the value ``h`` rows before, for each of ``lags`` (NULL where there is none).

    The last rows of a chunk are handed to the next one, only by step and value: one shuffle for all lags.
    """
    rows = stream.df if rows is None else rows
    reach, names = max(lags), {f"{column}_lag{h}": h for h in lags}
    size = max(stream.chunk_rows, reach)
    mine, near = stream.chunk(size), F.col("step") - 1 + reach >= (stream.chunk(size) + 1) * size
    carried = rows.where(near).select(*stream.by, "step", F.col(column), (mine + 1).alias("_chunk"), F.lit(True).alias("_carried"))
    both = rows.withColumns({"_chunk": mine, "_carried": F.lit(False)}).unionByName(carried, allowMissingColumns=True)
    order = Window.partitionBy(*stream.by, "_chunk").orderBy("step")
    out = both.withColumns({name: F.lag(column, h).over(order) for name, h in names.items()})
    return out.where(~F.col("_carried")).drop("_chunk", "_carried")


def moments(stream: Stream, columns: list[str], rows: DataFrame | None = None, extra: dict | None = None) -> DataFrame:
    """Add ``<c>_n``, ``<c>_mean`` and ``<c>_var`` (population) over the earlier rows.

    Sums are taken around the overall mean of the column, which keeps the variance well conditioned and
    cancels out exactly.
    """
    sums = dict(extra or {})
    for c in columns:
        v = F.col(c).cast("double") - F.lit(float(stream.centre.get(c, 0.0)))
        sums |= {f"{c}_n": v.isNotNull().cast("double"), f"{c}_s1": v, f"{c}_s2": v * v}
    out = scan(stream, sums, rows=rows)
    for c in columns:
        n, s1, s2 = F.col(f"{c}_n"), F.col(f"{c}_s1"), F.col(f"{c}_s2")
        out = out.withColumns(
            {
                f"{c}_mean": F.when(n > 0, s1 / n + F.lit(float(stream.centre.get(c, 0.0)))),
                f"{c}_var": F.when(n > 0, F.greatest(F.lit(0.0), (s2 - s1 * s1 / n) / n)),
            }
        )
    return out.drop(*[f"{c}_{k}" for c in columns for k in ("s1", "s2")])
