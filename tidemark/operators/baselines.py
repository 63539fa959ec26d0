"""Baselines that are exact prefix aggregates of the stream."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.prefix import scan
from tidemark.plans.stream import Stream

FADING_FACTOR = 0.99


def _mean(total: str, count: str) -> Column:
    return F.when(F.col(count) > 0, F.col(total) / F.col(count)).otherwise(0.0)


@dataclass
class _Terms:
    """What a scan adds up for the baselines of one target, and their columns made of it."""

    sums: dict[str, Column] = field(default_factory=dict)
    lags: dict[str, Column] = field(default_factory=dict)
    decays: dict[str, tuple[Column, float]] = field(default_factory=dict)
    made: dict[str, Column] = field(default_factory=dict)


def _regressors(target: str, names: tuple[str, ...], factor: float, tag: str = "") -> _Terms:
    y, out = F.col(target).cast("double"), _Terms()
    value, one = F.coalesce(y, F.lit(0.0)), y.isNotNull().cast("double")
    if "mean" in names:
        out.sums = {f"{tag}_s": value, f"{tag}_n": one}
        out.made[f"{tag}mean"] = _mean(f"{tag}_s", f"{tag}_n")
    if "fading" in names:
        out.decays = {f"{tag}_fs": (value, factor), f"{tag}_fn": (one, factor)}
        out.made[f"{tag}fading"] = _mean(f"{tag}_fs", f"{tag}_fn")
    if "no_change" in names:
        out.lags = {f"{tag}no_change": y}
        out.made[f"{tag}no_change"] = F.coalesce(f"{tag}no_change", F.lit(0.0))
    return out


def _classifiers(target: str, classes: list, names: tuple[str, ...], tag: str = "") -> _Terms:
    y, out = F.col(target), _Terms()
    if "last_class" in names:
        out.lags = {f"{tag}last_class": y}
    if "majority" in names and classes:
        out.sums = {f"{tag}_c{i}": F.when(y == c, 1.0).otherwise(0.0) for i, c in enumerate(classes)}
        best = F.greatest(*out.sums) if len(classes) > 1 else F.col(f"{tag}_c0")
        pick = [F.when((F.col(f"{tag}_c{i}") == best) & (best > 0), F.lit(c)) for i, c in enumerate(classes)]
        out.made[f"{tag}majority"] = F.coalesce(*pick)
    return out


def _scanned(stream: Stream, terms: list[_Terms]) -> DataFrame:
    sums, lags, decays, made = ({k: v for t in terms for k, v in getattr(t, part).items()} for part in ("sums", "lags", "decays", "made"))
    out = scan(stream, sums=sums, lags=lags, decays=decays)
    return (out.withColumns(made) if made else out).drop(*sums, *decays)


def baseline_regressors(stream: Stream, names: tuple[str, ...] = ("mean", "fading", "no_change"), factor: float = FADING_FACTOR) -> DataFrame:
    """``mean`` of the earlier targets, exponentially ``fading`` mean and previous target (``no_change``).

    All are 0.0 at the first row; one scan serves all of them.
    """
    return _scanned(stream, [_regressors(stream.target, names, factor)])


def baseline_classifiers(stream: Stream, classes: list, names: tuple[str, ...] = ("last_class", "majority")) -> DataFrame:
    """Previous class (``last_class``) and most frequent earlier class (``majority``, smallest label on ties).

    Both are NULL at the first row.
    """
    return _scanned(stream, [_classifiers(stream.target, classes, names)])


def shared_baselines(stream: Stream, targets: dict[str, tuple[str, list | None]]) -> DataFrame:
    """The baselines of several targets of the same rows, in one scan.

    ``targets`` names for each column prefix the target and its classes; without classes (None) it gets ``mean`` and ``no_change``,
    else ``last_class`` and ``majority``.
    """
    terms = [
        _regressors(y, ("mean", "no_change"), FADING_FACTOR, tag) if classes is None else _classifiers(y, classes, ("last_class", "majority"), tag)
        for tag, (y, classes) in targets.items()
    ]
    return _scanned(stream, terms)


def class_list(stream: Stream, limit: int = 1000) -> list:
    """Sorted distinct labels. Label sets are small by nature; more than ``limit`` is refused."""
    rows = stream.df.select(stream.target).where(F.col(stream.target).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} classes: use a regression track or encode the label first")
    return sorted(r[0] for r in rows)
