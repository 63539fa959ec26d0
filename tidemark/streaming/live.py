"""Live streams: per-key state, block models over micro-batches, live metrics.

Each operator has the same result as its batch counterpart on the same rows (checked with ``availableNow``).
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.metrics import confusion_checkpoints
from tidemark.session import scratch_path

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Rows of a growing folder of parquet files."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def run_available(df: DataFrame, batch_fn=None, path: str | None = None, mode: str = "append", progress: str | None = None) -> None:
    """Process what is there and stop; checkpoints go to the shared folder. With the ``progress`` of an earlier run it goes on from there."""
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", progress or scratch_path(df.sparkSession, "progress"))
    if batch_fn is not None:
        writer = writer.foreachBatch(batch_fn)
    else:
        writer = writer.format("parquet").option("path", path)
    writer.start().awaitTermination()


# ---------------------------------------------------------------- per-key state

BASELINES_OUT = (
    "user_id long, step long, event_id long, value double, event_type string, mean double, fading double, no_change double, "
    "last_class string, late boolean"
)
#: By user of a group; ``last`` is NaN and ``last_class`` null before the first value and class.
BASELINES_STATE = (
    "version int, users array<long>, n array<long>, seen array<long>, total array<double>, fade_s array<double>, fade_n array<double>, "
    "last array<double>, last_class array<string>, last_id array<long>"
)
#: Groups of users that share a state. A call of Python serves all users of a group, so that many small users cost as much as a few large ones.
BUCKETS = 1024
#: Rows that go back to Spark as one, with an array for each column: Spark's own Python work for a returned row is several times that of learning it.
PACKED = 64
#: Packed rows of a frame that is given back; Spark sends what it was given once that is more than ``maxRecordsPerBatch``.
PIECE = 1000


def _last_where(mask: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the last row of the same user with ``mask``, before a row and up to it; -1 for none. ``start``: place of the user's first row."""
    upto = np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))
    before = np.append(-1, upto)[: len(mask)]
    return np.where(before >= start, before, -1), np.where(upto >= start, upto, -1)


def _nulls(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Whole numbers with None where ``mask``."""
    return np.where(mask, None, values) if mask.any() else values


def _baselines(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Test-then-train for a group of users: predictions come from the rows before of the user, in event order."""
    users, n, seen, total, fade_s, fade_n, last, last_class, last_id = state.get[1:] if state.exists else [[] for _ in range(9)]
    classes: dict = {}
    parts = []
    for part in batches:
        codes, names = pd.factorize(part["event_type"])
        names = np.array([classes.setdefault(c, len(classes)) for c in names] + [-1], np.int64)  # the last one is for rows without
        parts.append((*(part[c].to_numpy() for c in ("_user", "_id", "_no_id", "value")), names[codes]))
    user, ids, no_id, value, kind = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    at, names = pd.factorize(np.concatenate([np.array(users, np.int64), user]))
    at, new = at[len(users) :], len(names) - len(users)
    n, seen, last_id = (np.array([*c, *[v] * new], np.int64) for c, v in ((n, 0), (seen, 0), (last_id, -1)))
    total, fade_s, fade_n, last = (np.array([*c, *[v] * new], float) for c, v in ((total, 0.0), (fade_s, 0.0), (fade_n, 0.0), (last, np.nan)))
    last_class = np.array([-1 if c is None else classes.setdefault(c, len(classes)) for c in last_class] + [-1] * new, np.int64)
    classes_of = np.array([*classes, None], object)

    # rows of one trigger come unsorted; rows without id come last
    order = np.lexsort((ids, no_id, at))
    at, ids, no_id, value, kind = at[order], ids[order], no_id[order], value[order], kind[order]
    # an older row cannot be put back in order: it is reported, scored by nothing and not learned
    late = ids <= last_id[at]
    late[1:] |= (ids[1:] == ids[:-1]) & (at[1:] == at[:-1])
    late &= ~no_id
    size = len(at)
    step, mean, fading, no_change = np.zeros(size, np.int64), *(np.full(size, np.nan) for _ in range(3))
    said = np.full(size, -1)

    timely = np.flatnonzero(~late)
    if len(timely):
        a, v, k = at[timely], value[timely], kind[timely]
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        stops = np.append(starts[1:], len(a))
        ends, who, start = stops - 1, a[starts], np.repeat(starts, stops - starts)
        step[timely] = n[a] + np.arange(len(a)) - start + 1
        learned = ~np.isnan(v)  # a row without a value is predicted, not learned
        j, j_end = _last_where(learned, start)
        before = np.where(j >= 0, v[j], last[a])
        no_change[timely] = np.where(np.isnan(before), 0.0, before)
        c, c_end = _last_where(k >= 0, start)
        said[timely] = np.where(c >= 0, k[c], last_class[a])
        means, fades = array("d"), array("d")
        for u, lo, hi in zip(who.tolist(), starts.tolist(), stops.tolist(), strict=True):
            # sums of the rows one after another, so that they do not depend on the triggers
            s, m, f, g = float(total[u]), int(seen[u]), float(fade_s[u]), float(fade_n[u])
            for x in memoryview(v[lo:hi]):
                means.append(s / m if m else 0.0)
                fades.append(f / g if g else 0.0)
                if x == x:
                    s, m, f, g = s + x, m + 1, f * 0.99 + x, g * 0.99 + 1.0
            total[u], seen[u], fade_s[u], fade_n[u] = s, m, f, g
        mean[timely], fading[timely] = means, fades
        n[who] = step[timely[ends]]
        last[who] = np.where(j_end[ends] >= 0, v[j_end[ends]], last[who])
        last_class[who] = np.where(c_end[ends] >= 0, k[c_end[ends]], last_class[who])
        np.maximum.at(last_id, at[~late & ~no_id], ids[~late & ~no_id])

    user = np.full(size, None) if key[0] < 0 else names[at]
    columns = (user, _nulls(step, late), _nulls(ids, no_id), value, classes_of[kind], mean, fading, no_change, classes_of[said], late)
    out = dict(zip([c.split()[0] for c in BASELINES_OUT.split(", ")], columns, strict=True))
    for lo in range(0, size, PIECE * PACKED):
        places = range(lo, min(lo + PIECE * PACKED, size), PACKED)
        yield pd.DataFrame({c: [x[i : i + PACKED] for i in places] for c, x in out.items()})
    by_user = (c.tolist() for c in (names, n, seen, total, fade_s, fade_n, last, classes_of[last_class], last_id))
    state.update((3, *by_user))


def keyed_baselines(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Baseline predictions per user with constant state per key, in the order of ``event_id`` within a trigger.

    A row whose ``event_id`` is not beyond those that its user had in this trigger or an earlier one is late. Rows without id
    come last in their trigger. Users share a state by ``buckets``, which a restart must keep; users without id have one of their own.
    """
    user, event = F.col("user_id").cast("long"), F.col("event_id").cast("long")
    bucket = F.when(user.isNull(), -1).otherwise(F.pmod(F.xxhash64(user), F.lit(buckets)))
    rows = events.select(  # numbers without nulls, which pandas would turn into floats
        bucket.alias("_bucket"), F.coalesce(user, F.lit(0)).alias("_user"), F.coalesce(event, F.lit(0)).alias("_id"),
        event.isNull().alias("_no_id"), F.col("value").cast("double").alias("value"), "event_type",
    )
    names, types = zip(*(c.split() for c in BASELINES_OUT.split(", ")), strict=True)
    arrays = ", ".join(f"{c} array<{t}>" for c, t in zip(names, types, strict=True))
    packed = rows.groupBy("_bucket").applyInPandasWithState(_baselines, arrays, BASELINES_STATE, "append", GroupStateTimeout.NoTimeout)
    return packed.select(F.inline(F.arrays_zip(*names)))


ORDERED_OUT = "user_id long, step long, event_id long, value double, event_type string, mean double, no_change double, last_class string"
#: By user (``users``, counts and last values) and by row that waits (``at`` is the place of its user).
ORDERED_STATE = (
    "version int, users array<string>, n array<long>, seen array<long>, total array<double>, last array<double>, last_class array<string>, "
    "at array<int>, ids array<long>, times array<long>, held array<double>, types array<string>"
)


def _shifted(first: np.ndarray, start: np.ndarray, values: np.ndarray) -> pd.Series:
    """The value of the row before; ``start`` in the first row of a user."""
    out = np.empty(len(values), values.dtype)
    out[1:] = values[:-1]
    return pd.Series(np.where(first, start, out))


def _ordered(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Test-then-train in event time for a group of users: rows wait in the state until the watermark has passed them."""
    users, n, seen, total, last, last_class, *held = state.get[1:] if state.exists else [[] for _ in range(11)]
    waiting = [pd.DataFrame(dict(zip(("at", "id", "ms", "value", "kind"), held, strict=True)))] if held[0] else []
    users, place = list(users), {u: i for i, u in enumerate(users)}
    if not state.hasTimedOut:
        for part in batches:
            codes, names = pd.factorize(part["_user"], use_na_sentinel=False)
            names = [None if pd.isna(u) else u for u in names]
            for u in names:
                if place.setdefault(u, len(users)) == len(users):
                    users.append(u)
            at = np.array([place[u] for u in names], int)[codes] if len(part) else codes
            columns = {"at": at, "id": part["event_id"], "ms": part["_ms"], "value": part["value"], "kind": part["event_type"]}
            waiting.append(pd.DataFrame(columns))
    new = len(users) - len(n)
    n, seen = (np.array([*c, *[0] * new], np.int64) for c in (n, seen))
    total, last = np.array([*total, *[0.0] * new], float), np.array([*last, *[np.nan] * new], float)
    last_class = np.array([*last_class, *[None] * new], object)
    kinds = {"at": "int64", "id": "Int64", "ms": "int64", "value": "float64", "kind": "object"}
    rows = pd.concat([w.astype(kinds) for w in waiting], ignore_index=True) if waiting else pd.DataFrame(columns=list(kinds)).astype(kinds)
    no_id = rows["id"].isna()
    rows = rows.iloc[np.lexsort((rows["id"].fillna(0).to_numpy(np.int64), no_id, rows["ms"], rows["at"]))]  # rows without id come last
    ready = rows["ms"].to_numpy() < state.getCurrentWatermarkMs()
    rest, rows = rows[~ready], rows[ready].reset_index(drop=True)
    if len(rows):
        at, value, kind = rows["at"].to_numpy(), rows["value"].to_numpy(), rows["kind"].where(rows["kind"].notna(), None).to_numpy(object)
        first = np.append(True, at[1:] != at[:-1])
        ends = np.append(np.flatnonzero(first)[1:], len(at)) - 1
        learned = ~np.isnan(value)  # a row without a value is predicted, not learned
        amount = np.where(learned, value, 0.0)
        before_n = _shifted(first, seen[at], learned.astype(np.int64)).groupby(at).cumsum().to_numpy()
        before = _shifted(first, total[at], amount).groupby(at).cumsum().to_numpy()
        before_last = _shifted(first, last[at], value).groupby(at).ffill().to_numpy()
        before_class = _shifted(first, last_class[at], kind).groupby(at).ffill()
        before_class = before_class.where(before_class.notna(), None).to_numpy(object)
        step = n[at] + np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1] + 1
        names = pd.array([None if u is None else int(u) for u in users], dtype="Int64")
        out = (
            names.take(at), step, rows["id"], value, kind, np.divide(before, before_n, out=np.zeros(len(at)), where=before_n > 0),
            np.where(np.isnan(before_last), 0.0, before_last), before_class,
        )
        yield pd.DataFrame(dict(zip([c.split()[0] for c in ORDERED_OUT.split(", ")], out, strict=True)))
        who = at[ends]
        n[who], seen[who], total[who] = step[ends], before_n[ends] + learned[ends], before[ends] + amount[ends]
        last[who] = np.where(learned[ends], value[ends], before_last[ends])
        last_class[who] = [b if k is None else k for k, b in zip(kind[ends], before_class[ends], strict=True)]
    ids = [None if i is pd.NA else i for i in rest["id"].tolist()]
    types = [None if pd.isna(k) else k for k in rest["kind"]]
    by_user = (c.tolist() for c in (n, seen, total, last, last_class))
    state.update((2, users, *by_user, rest["at"].tolist(), ids, rest["ms"].tolist(), rest["value"].tolist(), types))
    if len(rest):
        state.setTimeoutTimestamp(max(int(rest["ms"].min()), 1))


def ordered_baselines(events: DataFrame, ts: str = "ts", delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Baseline predictions per user in the order of (``ts``, ``event_id``), whatever order the rows come in.

    A row is predicted and learned once the watermark (the largest time seen less ``delay``) is beyond its time; so rows
    that come up to ``delay`` late take their place. What is later still is dropped by Spark. A user keeps only the rows of the
    last ``delay``; users share a state by ``buckets``, which a restart must keep. Rows without a time are left out.
    """
    timed = events.where(F.col(ts).isNotNull()).withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    rows = timed.select(
        F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("_bucket"), F.col("user_id").cast("string").alias("_user"),
        "event_id", "value", "event_type", "_ts", F.unix_millis("_ts").alias("_ms"),
    )
    return rows.groupBy("_bucket").applyInPandasWithState(_ordered, ORDERED_OUT, ORDERED_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------- metrics and models over micro-batches


class LiveConfusion:
    """Confusion counts of a live stream, one folder per batch, so a repeated batch replaces itself."""

    def __init__(self, spark: SparkSession, n: int, rule: str = "floor", folder: str | None = None) -> None:
        self.spark, self.n, self.rule = spark, n, rule
        self.folder = folder or scratch_path(spark, "confusion")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        from tidemark.operators.metrics import confusion, scored

        confusion(scored(batch, "classification"), self.n, self.rule).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def checkpoints(self, positive: object = 1) -> DataFrame:
        """Cumulative metrics so far; counts of all batches add up."""
        counts = self.spark.read.parquet(self.folder).groupBy("model", "block", "y", "pred").agg(F.sum("cnt").alias("cnt"))
        return confusion_checkpoints(counts, self.n, self.rule, positive)


class LiveBlocks:
    """A block model on a live stream: a micro-batch is scored with the state before it, then learned.

    The sums of every batch are kept in a table by batch id. A state is their fold, so a batch that is run
    again after a failure, even by a new driver, finds the same state and writes the same output folder.
    """

    def __init__(self, spark: SparkSession, model, columns: list[str], folder: str | None = None) -> None:
        self.spark, self.model, self.columns = spark, model, columns
        folder = folder or scratch_path(spark, "live-model")
        self.folder, self.sums_folder = f"{folder}/scored", f"{folder}/sums"
        self.states = {0: model.empty()}

    def state_before(self, batch_id: int):
        if batch_id not in self.states:
            rows = self.spark.read.parquet(self.sums_folder).filter(F.col("batch") < batch_id).orderBy("batch").collect()
            state = self.model.empty()
            for r in rows:
                state = self.model.learn(state, {k: v for k, v in r.asDict().items() if k != "batch"})
            self.states[batch_id] = state
        return self.states[batch_id]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        state = self.state_before(batch_id)
        names = [part.strip().split(" ", 1) for part in self.model.schema.split(";")]
        values = F.from_json(F.lit(json.dumps(self.model.columns(state))), ", ".join(f"`{n}` {t}" for n, t in names))
        rows = batch.withColumn("_state", values)  # a constant
        rows = rows.withColumns({f"{self.model.name}__{n}": F.col("_state")[n] for n, _ in names})
        scored = rows.withColumn(self.model.name, self.model.predict())
        scored.select(*self.columns, self.model.name).write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")
        totals = batch.agg(*[c.alias(k) for k, c in self.model.totals(state).items()])
        path = f"{self.sums_folder}/batch={batch_id}"
        totals.write.mode("overwrite").parquet(path)
        sums = self.spark.read.parquet(path).collect()[0].asDict()
        self.states[batch_id + 1] = self.model.learn(state, sums)

    def scored(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)


def windowed_metrics(events: DataFrame, ts: str, y: str, pred: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Event-time windows of accuracy counts with a watermark, for streams whose length is unknown."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return timed.groupBy(F.window("_ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(y) == F.col(pred), 1).otherwise(0)).alias("hits")
    )
