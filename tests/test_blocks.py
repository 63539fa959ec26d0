"""Blocks of long streams: what a block reads, neighbours of several windows, memories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ensembles, neighbours
from tidemark.operators.trees import Forest, TreeSpec
from tidemark.plans import blocks as blocks_module
from tidemark.plans import spans
from tidemark.plans import stream as stream_module
from tidemark.plans.blocks import Blocks
from tidemark.plans.stream import prepare

N, COUNT, FEATS = 2400, 4, ["a", "b"]


def table(spark, n=N):
    """Few different values, so that distances tie; some are missing."""
    rng = np.random.default_rng(8)
    a, b, c = rng.integers(0, 6, n).tolist(), rng.integers(0, 6, n).tolist(), rng.integers(0, 3, n).tolist()
    rows = [(i, None if i % 97 == 0 else float(a[i]), float(b[i]), None if i % 89 == 0 else "xyz"[c[i]]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, a double, b double, cls string")


def files(df):
    return df.select(F.input_file_name().alias("f")).distinct().count()


def test_a_block_lies_in_many_files_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(stream_module, "FILE_ROWS", 20)
    st = prepare(table(spark)[1], ("id",), "cls", tuple(FEATS))
    cut = Blocks(st, COUNT)
    assert sorted(r["step"] for r in st.df.collect()) == list(range(1, N + 1))
    assert [r["id"] for r in st.df.orderBy("step").select("id").collect()] == list(range(N))
    assert files(cut.rows(2)) >= 20  # 600 rows; with a fixed number of files, they lay in 8 of 32
    plan = cut.rows(2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan  # other folders are not opened


def test_kept_blocks_lie_in_many_files(spark, monkeypatch):
    monkeypatch.setattr(blocks_module, "FILE_ROWS", 20)
    st = prepare(table(spark)[1], ("id",), "cls", tuple(FEATS))
    cut = Blocks(st, COUNT)
    assert files(cut.rows(3, cut.kept(st.df.coalesce(1), "kept"))) >= 30


def test_stacking_reads_a_block_at_a_time(spark, monkeypatch):
    """Its second level, too, finds a block in folders of its own, and does not filter the whole table for it."""
    seen, rows = [], Blocks.rows

    def spy(self, b, df=None):
        seen.append(set((self.stream.df if df is None else df).columns) & {"_block", "_part"})
        return rows(self, b, df)

    monkeypatch.setattr(Blocks, "rows", spy)
    st = prepare(table(spark)[1], ("id",), "cls", tuple(FEATS))
    index = F.element_at(F.create_map(*[F.lit(v) for i, c in enumerate("xyz") for v in (c, float(i))]), F.col("cls"))
    assert ensembles.stacking(Blocks(st, COUNT), FEATS, ["x", "y", "z"], index).count() == N
    assert len(seen) > 2 * COUNT and all(seen)


@pytest.mark.parametrize("k", [3, 20])
def test_windows_share_a_pass(spark, monkeypatch, k):
    """Ties go to the most recent row, rows without a distance have no neighbours, and ``k`` may be above what is picked one by one."""
    monkeypatch.setattr(spans, "SPAN_ROWS", 100)
    rows, df = table(spark, 500)
    st = prepare(df, ("id",), "cls", tuple(FEATS))
    got = neighbours.nearest_of(st, FEATS, k, {"short": 7, "long": 90}, st.df.withColumn("twice", 2 * F.col("b")), keep=("twice",)).collect()
    x = np.array([[np.nan if v is None else v for v in r[1:3]] for r in rows])
    assert len(got) == 500
    for r in got:
        i = r["step"] - 1
        assert r["twice"] == 2 * rows[i][2] and r["y"] == rows[i][3]
        for name, window in (("short", 7), ("long", 90)):
            cand = [j for j in range(i - 1, max(i - window, 0) - 1, -1) if np.isfinite(((x[j] - x[i]) ** 2).sum())]
            want = sorted(cand, key=lambda j: ((x[j] - x[i]) ** 2).sum())[:k]
            assert [(n["step"] - 1, n["y"]) for n in r[name]] == [(j, rows[j][3]) for j in want]
            assert [n["distance"] for n in r[name]] == pytest.approx([np.sqrt(((x[j] - x[i]) ** 2).sum()) for j in want])


def test_long_memory_equals_a_plain_loop(spark):
    """Distances tie by label, votes by label; a row without a feature meets the smallest labels; an empty memory says nothing."""
    rng = np.random.default_rng(4)
    memory = [{"x": [float(v) for v in rng.integers(0, 4, 2)], "y": "xyz"[rng.integers(3)]} for _ in range(30)]
    rows = [(i, None if i % 5 == 4 else "x", [None if i % 11 == 0 else float(i % 4), float(i % 3)], 1 + i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "step int, y string, x array<double>, block int")
    got = {r["step"]: r["long_pred"] for r in ensembles.long_memory(df, [[], memory], ["x", "y", "z"], 5).collect()}
    for i, _, x, block in rows:
        far = [(0.0 if x[0] is None else sum((a - b) ** 2 for a, b in zip(x, m["x"])), m["y"]) for m in memory]
        top = [y for _, y in sorted(far)[:5]]
        assert got[i] == (None if block == 1 else max("xyz", key=lambda c: (top.count(c), -ord(c))))


def test_best_cuts_of_many_nodes_at_a_time(spark):
    rng = np.random.default_rng(0)
    for kind, k in (("class", 4), ("reg", 3), ("gradient", 3)):
        forest = Forest(None, TreeSpec("p", kind=kind), ["a", "b"], None, k, [list(range(31))] * 2)
        h = rng.uniform(1, 2, (6, 2, 32, k)) * (rng.uniform(size=(6, 2, 32, 1)) < 0.4)
        gain, cut = forest._best(h)
        for i in range(6):
            for f in range(2):
                each = [float(forest._gain(h[i, f, : c + 1].sum(0)[None], h[i, f, c + 1 :].sum(0)[None], h[i, f].sum(0))[0]) for c in range(31)]
                assert gain[i, f] == pytest.approx(max(each)) and each[cut[i, f]] == pytest.approx(max(each))
