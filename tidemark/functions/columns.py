"""Column expressions: coercion, scores, hashing, tree walks. All of them stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.fixed_values import FALSE_TEXTS, TRUE_TEXTS

NUMBER = r"^\s*[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\s*$"


def number_or_null(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def number_or_zero(c: Column) -> Column:
    return F.coalesce(number_or_null(c), F.lit(0.0))


def label_kind(c: Column) -> Column:
    """How a label text is read: ``int``, ``bool`` or ``string``."""
    text = F.lower(F.trim(c))
    return (
        F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), "int").when(text.isin(TRUE_TEXTS + FALSE_TEXTS), "bool").otherwise("string")
    )


def label_value(c: Column) -> Column:
    """Label text after coercion: integers plain, booleans as true / false, anything else unchanged."""
    text = F.lower(F.trim(c))
    kind = label_kind(c)
    return (
        F.when(kind == "int", F.trim(c).try_cast("long").cast("string"))
        .when(kind == "bool", F.when(text.isin(TRUE_TEXTS), "true").otherwise("false"))
        .otherwise(c)
    )


def binary_class(pred: Column, is_float: bool) -> Column:
    """Prediction of a binary run as 0/1; integer predictions stay as they are."""
    return (pred != 0).cast("int") if is_float else pred.cast("int")


def whole_class(pred: Column) -> Column:
    """Prediction of a multiclass run as an integer (truncated)."""
    return pred.cast("double").cast("int")


def first_true(text: Column) -> Column:
    """First true key of a dict text such as ``{'a': False, 'b': True}``; keys keep their order.

    NULL if no key is true or the text is broken; its index is then 0 (see ``prepare.first_true_index``).
    """
    json = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "'", '"'), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    entries = F.map_entries(F.from_json(json, "map<string,boolean>"))
    return F.get(F.filter(entries, lambda e: e["value"]), 0)["key"]


def dict_keys(text: Column) -> Column:
    json = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "'", '"'), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.map_keys(F.from_json(json, "map<string,boolean>"))


def probability(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def two_sided(z: Column) -> Column:
    """``abs(2 * cdf(z) - 1)`` = erf(abs(z) / sqrt 2), by Abramowitz and Stegun 7.1.26."""
    # Coefficients of formula 7.1.26.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + p * x)
    poly = ((((a[4] * t + a[3]) * t + a[2]) * t + a[1]) * t + a[0]) * t
    return 1.0 - poly * F.exp(-x * x)


def uniform(*parts: Column) -> Column:
    """Repeatable number in [0, 1) from a hash of the parts; the same on every run and partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def poisson_weight(u: Column, rate: float, largest: int = 30) -> Column:
    """Poisson count for a uniform number, by the inverse distribution function."""
    cumulative, term, edges = 0.0, math.exp(-rate), []
    for k in range(largest):
        cumulative += term
        edges.append(cumulative)
        term *= rate / (k + 1)
    return interval_of(u, edges, closed_left=True).cast("double")


def interval_of(c: Column, edges: list[float], closed_left: bool = False) -> Column:
    """Number of edges below the value (or up to it if ``closed_left``), by nested comparisons."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        here = c < edges[mid] if closed_left else c <= edges[mid]
        return F.when(here, search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(edges)).cast("int")


def walk(bins: Column, feature: Column, cut: Column, depth: int) -> Column:
    """Leaf of a binary tree kept as two arrays in heap order (children of i: 2i+1 and 2i+2).

    ``feature[i]`` is -1 in a leaf; otherwise a row goes left if ``bins[feature[i]] <= cut[i]``.
    """
    step = lambda node, _: F.when(F.get(feature, node) < 0, node).otherwise(
        F.when(F.get(bins, F.get(feature, node)) <= F.get(cut, node), node * 2 + 1).otherwise(node * 2 + 2)
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) if depth > 0 else F.lit(0)


def shown(c: Column, digits: int) -> Column:
    """Number as text with a fixed number of digits, N/A if missing."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c)).otherwise("N/A")
