"""Drift detection by adaptive windowing over block means (Bifet and Gavalda 2007)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DELTA = 0.002


def cut_bound(n0, n1, var, delta: float = DELTA, log=math.log, sqrt=math.sqrt, span=1.0):
    """Largest mean difference that chance explains between the two sides of a cut; ``span`` is the range of the values."""
    m = 1.0 / (1.0 / n0 + 1.0 / n1)
    evidence = log(2.0 * log(n0 + n1) / delta)
    return sqrt(2.0 / m * var * evidence) + span * 2.0 / (3.0 * m) * evidence


def cut_tests(blocks: DataFrame, keys: list[str], delta: float = DELTA) -> DataFrame:
    """Test every cut between blocks of (``block``, ``n``, ``s``, ``q``): size, sum and sum of squares of an error.

    With a column ``top`` (largest error of the block) errors of any range can be tested; without it the range is 1.
    Blocks are few, so the windows run over aggregates only.
    """
    everything = Window.partitionBy(*keys)
    upto = everything.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    cols = {f"{c}0": F.sum(c).over(upto) for c in "ns"} | {f"{c}t": F.sum(c).over(everything) for c in "nsq"}
    cols["span"] = F.max("top").over(everything) if "top" in blocks.columns else F.lit(1.0)
    out = blocks.withColumns(cols).filter(F.col("nt") > F.col("n0"))
    n0, n1 = F.col("n0").cast("double"), (F.col("nt") - F.col("n0")).cast("double")
    mean = F.col("st") / F.col("nt")
    var = F.greatest(F.lit(0.0), F.col("qt") / F.col("nt") - mean * mean)
    bound = cut_bound(n0, n1, var, delta, F.log, F.sqrt, F.col("span"))
    gap: Column = F.abs(F.col("s0") / n0 - (F.col("st") - F.col("s0")) / n1)
    return out.select(*keys, "block", gap.alias("gap"), bound.alias("bound"), (gap > bound).alias("drift"))


class BlockAdwin:
    """Window over blocks as an exponential histogram: buckets of 1, 2, 4 ... blocks, a bounded number of each, so that memory grows with the
    logarithm of the blocks. While a cut between two buckets shows a change, the oldest bucket goes."""

    #: Buckets of one size; the two oldest of more are merged.
    EACH = 5

    def __init__(self, delta: float = DELTA) -> None:
        self.delta, self.window, self.span = delta, [], 0.0
        self.size: list[int] = []  # blocks in each bucket

    def add(self, n: float, s: float, q: float, top: float = 1.0) -> bool:
        """Add one block (weight, sum and sum of squares of its errors, and the largest); True if the window shrank because the mean went up."""
        self.span = max(self.span, top)
        if n <= 0:
            return False
        self.window.append((n, s, q))
        self.size.append(1)
        before, shrank = self.mean, False
        while len(self.window) > 1 and self._changed():
            self.window.pop(0)
            self.size.pop(0)
            shrank = True
        rose = shrank and self.mean > before
        self._merge()
        return rose

    def _merge(self) -> None:
        size = 1
        while self.size.count(size) > self.EACH:
            at = self.size.index(size)  # oldest first, sizes never grow towards the newest
            self.window[at : at + 2] = [tuple(a + b for a, b in zip(*self.window[at : at + 2], strict=True))]
            self.size[at : at + 2] = [2 * size]
            size *= 2

    def _changed(self) -> bool:
        n, s, q = (sum(w[i] for w in self.window) for i in range(3))
        var = max(0.0, q / n - (s / n) ** 2)
        n0 = s0 = 0.0
        for bn, bs, _ in self.window[:-1]:
            n0, s0 = n0 + bn, s0 + bs
            if abs(s0 / n0 - (s - s0) / (n - n0)) > cut_bound(n0, n - n0, var, self.delta, span=self.span):
                return True
        return False

    @property
    def mean(self) -> float:
        n = sum(w[0] for w in self.window)
        return sum(w[1] for w in self.window) / n if n else 0.0
