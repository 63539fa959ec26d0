"""Live operators: late rows, restarts."""

from pyspark.sql import functions as F

from tidemark.operators.linear import LinearBlock
from tidemark.session import scratch_path
from tidemark.streaming import live


def test_late_rows_are_reported_not_learned(spark):
    folder, out, progress = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    schema = "event_id bigint, user_id bigint, event_type string, value double"

    def push(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        df = live.keyed_baselines(live.source(spark, folder, schema))
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
        q.awaitTermination()

    push([(5, 1, "a", 10.0), (3, 1, "b", 20.0)])
    push([(4, 1, "c", 1000.0), (7, 1, "a", 30.0)])
    got = {r["event_id"]: r for r in spark.read.parquet(out).collect()}
    assert (got[3]["mean"], got[3]["last_class"]) == (0.0, None)
    assert (got[5]["mean"], got[5]["no_change"], got[5]["last_class"]) == (20.0, 20.0, "b")
    assert got[4]["late"] and got[4]["mean"] is None
    assert (got[7]["mean"], got[7]["step"]) == (15.0, 3)


def test_block_model_survives_a_restart(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), (2.0 * F.col("id")).alias("y"))
    model = LinearBlock("m", ["x"], F.col("y"), rate=1e-4, scaled=False)
    folder = scratch_path(spark, "restart")
    first = live.LiveBlocks(spark, model, ["x"], folder)
    first(df.filter("x < 50"), 0)
    first(df.filter("x >= 50"), 1)
    want = sorted(r["m"] for r in first.scored().filter("x >= 50").collect())
    again = live.LiveBlocks(spark, model, ["x"], folder)  # a new driver repeats batch 1
    again(df.filter("x >= 50"), 1)
    assert sorted(r["m"] for r in again.scored().filter("x >= 50").collect()) == want
    assert again.scored().count() == 100 and any(v != 0 for v in want)


def test_late_rows_take_their_place(spark):
    """Files in any order within the delay give the answer of a plain loop in event order; rows beyond the watermark are out."""
    import datetime as dt
    import random

    folder, out, progress = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    start, rnd = dt.datetime(2024, 1, 1), random.Random(3)
    rows = [
        (i, start + dt.timedelta(minutes=i // 2), i % 3, None if i % 11 == 0 else f"t{i % 4}", None if i % 7 == 0 else float(i * i % 50)) for i in range(300)
    ]
    came = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rnd.randint(0, 25)))
    for part in (came[:100], came[100:180], [*came[180:], (999, start, 1, "late", 1.0), (1000, None, 1, "x", 1.0)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        live.run_available(live.ordered_baselines(live.source(spark, folder, schema), delay="30 minutes"), path=out, progress=progress)
    got = {r["event_id"]: r for r in spark.read.parquet(out).collect()}
    want, mark = {}, max(r[1] for r in rows) - dt.timedelta(minutes=30)
    for u in range(3):
        seen, last, kind, n = [], 0.0, None, 0
        for i, t, _, c, v in (r for r in sorted(rows, key=lambda r: (r[1], r[0])) if r[2] == u and r[1] < mark):
            n += 1
            want[i] = (n, sum(seen) / len(seen) if seen else 0.0, last, kind)
            if v is not None:
                seen, last = [*seen, v], v
            kind = c or kind
    assert got.keys() == want.keys()
    for i, (n, mean, last, kind) in want.items():
        r = got[i]
        assert (r["step"], r["no_change"], r["last_class"]) == (n, last, kind) and abs(r["mean"] - mean) < 1e-9


def test_users_share_a_state(spark):
    """Many small users cost few calls of Python; users and rows without id keep their place, also over batches."""
    import datetime as dt

    folder, out, progress = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    start, big = dt.datetime(2024, 1, 1), (1 << 60) + 1
    users = [None, big, big + 1, *range(40)]
    rows = [(None if i % 43 == 5 else i, start + dt.timedelta(seconds=i), users[i % 43], None if i % 4 == 1 else f"t{i % 3}", None if i % 5 == 2 else i / 7) for i in range(1290)]
    for part in (rows[400:900], rows[:400] + rows[900:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        df = live.ordered_baselines(live.source(spark, folder, schema), delay="30 minutes", buckets=2)
        live.run_available(df, path=out, progress=progress)
    end = [(10_000, start + dt.timedelta(days=1), 0, "end", 0.0)]
    spark.createDataFrame(end, schema).write.mode("append").parquet(folder)
    live.run_available(live.ordered_baselines(live.source(spark, folder, schema), delay="30 minutes", buckets=2), path=out, progress=progress)
    got = {(r["user_id"], r["step"]): r for r in spark.read.parquet(out).collect()}
    assert len(got) == len(rows)
    for u in users:
        seen, last, kind = [], 0.0, None
        for step, (i, _, _, c, v) in enumerate((r for r in rows if r[2] == u), 1):
            r = got[u, step]
            assert (r["event_id"], r["value"], r["event_type"], r["no_change"], r["last_class"]) == (i, v, c, last, kind)
            assert abs(r["mean"] - (sum(seen) / len(seen) if seen else 0.0)) < 1e-9
            if v is not None:
                seen, last = [*seen, v], v
            kind = c or kind


def _keyed_loop(triggers):
    """Rows of the live baselines, by a loop over the rows of each user and trigger."""
    out, users = [], {}
    for rows in triggers:
        for i, u, c, v in sorted(rows, key=lambda r: (r[0] is None, r[0])):
            s = users.setdefault(u, {"n": 0, "seen": 0, "total": 0.0, "fs": 0.0, "fn": 0.0, "last": 0.0, "class": None, "id": -1})
            if i is not None and i <= s["id"]:
                out.append((u, None, i, v, c, None, None, None, None, True))
                continue
            s["n"] += 1
            mean, fading = s["total"] / s["seen"] if s["seen"] else 0.0, s["fs"] / s["fn"] if s["fn"] else 0.0
            out.append((u, s["n"], i, v, c, mean, fading, s["last"], s["class"], False))
            s["id"] = s["id"] if i is None else i
            if v is not None:
                s |= {"seen": s["seen"] + 1, "total": s["total"] + v, "fs": s["fs"] * 0.99 + v, "fn": s["fn"] * 0.99 + 1.0, "last": v}
            s["class"] = s["class"] if c is None else c
    return out


def test_keyed_users_share_a_state(spark):
    """One call of Python for many users: late, repeated and incomplete rows, large ids and users without id, over triggers."""
    from collections import Counter

    folder, out, progress = (scratch_path(spark, n) for n in ("in", "out", "progress"))
    schema, big = "event_id bigint, user_id bigint, event_type string, value double", (1 << 60) + 1
    users = [None, big, big + 1, 0, *range(100, 140)]
    rows = [
        (big + i, users[i % 44 if i % 3 else 1], None if i % 4 == 1 else f"t{i % 3}", None if i % 5 == 2 else i / 7) for i in range(2200)
    ]
    blank = [(None, u, "x", 1.5) for u in users[:4]]
    # the second trigger has a repeated row, rows older than the first one's, and new users; the third has rows without id once more
    triggers = [rows[600:1400] + blank, rows[1390:1900] + rows[1700:1710] + rows[:50] + [(7, 999, None, None)], rows[1900:] + blank + [(5, 999, "a", 1.0), (8, 999, "b", 2.0)]]
    for part in triggers:
        spark.createDataFrame(part, schema).write.mode("append").parquet(folder)
        live.run_available(live.keyed_baselines(live.source(spark, folder, schema), buckets=2), path=out, progress=progress)
    got = spark.read.parquet(out)
    assert got.columns == [c.split()[0] for c in live.BASELINES_OUT.split(", ")]
    assert Counter(map(tuple, got.collect())) == Counter(_keyed_loop(triggers))


def test_a_write_of_many_files_is_learned_in_event_order(spark):
    """Files of one write hold rows of the same users in no order; none of them is late."""
    from tidemark.queries import QUERIES

    d = scratch_path(spark, "table")
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    rows = [(i, None, i % 7, f"t{i % 4}", float(i * i % 50), "{}") for i in range(400)]
    spark.createDataFrame(rows, schema).repartition(4, F.col("event_id") % 4).write.parquet(f"{d}/events.parquet")
    got = {r["event_id"]: (r["user_id"], r["step"], r["mean"], r["no_change"], r["last_class"]) for r in QUERIES["l2_keyed_state"](spark, d).collect()}
    want = _keyed_loop([[(i, u, c, v) for i, _, u, c, v, _ in rows]])
    assert len(got) == len(want)
    for u, step, i, _, _, mean, _, no_change, last_class, _ in want:
        assert got[i][:2] + got[i][3:] == (u, step, no_change, last_class) and abs(got[i][2] - mean) < 1e-5
