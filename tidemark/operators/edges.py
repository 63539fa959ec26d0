"""Bin edges from all data: a quantile sketch of each feature grows with the stream, and histograms follow its edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 32
#: Size of a sketch: ranks are right within about half a hundredth, whatever the number of rows.
SKETCH = 800
#: Quantiles asked of a sketch, for each bin.
FINE = 8


def value(feature: str) -> Column:
    """A feature as a number; a missing value counts as 0, as in the readers."""
    return F.coalesce(F.col(f"`{feature}`").cast("double"), F.lit(0.0))


class Edges:
    """Quantile sketches (KLL) of the features over all blocks so far. One aggregation a block adds its rows; the driver holds the sketches only."""

    def __init__(self, features: list[str], bins: int = BINS, fixed: list[list[float]] | None = None) -> None:
        self.features, self.bins, self.fixed = features, bins, fixed is not None
        self.sketch: list[bytes | None] = [None] * len(features)
        self.points: list[np.ndarray] = [np.zeros(0)] * len(features)
        self.of = [np.array(e, float) for e in fixed] if fixed else [np.zeros(0)] * len(features)

    def add(self, rows: DataFrame) -> list[np.ndarray | None] | None:
        """Take in the rows of a block. Where edges move, give for each feature the matrix that carries a histogram over to the new bins
        (None for a feature whose edges stay), else None."""
        if self.fixed:
            return None
        sketches = []
        for i, (f, old) in enumerate(zip(self.features, self.sketch, strict=True)):
            new = F.kll_sketch_agg_double(value(f), F.lit(SKETCH))
            sketches.append((F.kll_sketch_merge_double(F.lit(bytearray(old)), new) if old else new).alias(f"s{i}"))
        shares = F.array(*[F.lit(i / (FINE * self.bins)) for i in range(FINE * self.bins + 1)])
        # an empty block has no quantiles to ask for
        full = rows.agg(F.count(F.lit(1)).alias("n"), *sketches).where("n > 0")
        row = full.select("*", *[F.kll_sketch_get_quantile_double(f"s{i}", shares).alias(f"q{i}") for i in range(len(self.features))]).first()
        if row is None:
            return None
        moved = []
        for i in range(len(self.features)):
            self.sketch[i], self.points[i] = bytes(row[f"s{i}"]), np.array(row[f"q{i}"], float)
            moved.append(self._follow(i))
        return moved if any(m is not None for m in moved) else None

    def _follow(self, i: int) -> np.ndarray | None:
        """New edges of a feature if a bin has come to hold over twice its share."""
        points, old = self.points[i], self.of[i]
        new = np.unique(points[FINE:-1:FINE])
        held = np.bincount(np.searchsorted(old, points, side="left"), minlength=len(old) + 1) / len(points)
        if len(old) and held.max() <= 2.0 / self.bins or np.array_equal(new, old):
            return None
        self.of[i] = new
        return carry(old, new, points[0], points[-1], self.bins) if len(old) else None

    def bins_of(self, x: np.ndarray) -> np.ndarray:
        """Bins of a matrix of values, column by column."""
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.of)], 1) if len(self.of) else np.zeros((len(x), 0), int)

    def cut(self, feature: int, bin_: int) -> float:
        """The largest value of a bin; infinite for the last."""
        e = self.of[feature]
        return float(e[bin_]) if bin_ < len(e) else float("inf")


def carry(old: np.ndarray, new: np.ndarray, low: float, high: float, bins: int) -> np.ndarray:
    """Shares of each old bin in each new one, as if values lay evenly in a bin (at its end, if it has no width)."""
    ends = np.concatenate([[min(low, old[0])], old, [max(high, old[-1])]])
    cuts = np.concatenate([[-np.inf], new, [np.inf]])
    out = np.zeros((bins, bins))
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if b <= a:
            out[i, np.searchsorted(new, b, side="left")] = 1.0
            continue
        for j in range(np.searchsorted(new, a, side="right"), len(new) + 1):
            part = min(b, cuts[j + 1]) - max(a, cuts[j])
            if part <= 0:
                break
            out[i, j] = part / (b - a)
    return out


def carried(hist: np.ndarray, moved: list[np.ndarray | None]) -> np.ndarray:
    """A histogram [feature, bin, ...] over the new bins."""
    out = hist.copy()
    for f, m in enumerate(moved):
        if m is not None:
            out[f] = np.tensordot(m.T, hist[f], axes=1)
    return out
