"""Arithmetic on array columns; everything stays in built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names a reduced-vector column may have, in the order they are looked for.
ALIASES = ("X_pca", "X_PCA", "PCA", "x_pca", "pca", "X_lsi")


def resolve_vector_column(df: DataFrame, key: str | None = None, aliases: Sequence[str] = ALIASES) -> str:
    """The first of ``key`` and the aliases that is a column."""
    for name in ([key] if key else []) + list(aliases):
        if name in df.columns:
            return name
    raise ValueError(f"no vector column: looked for {key or ''} {', '.join(aliases)}")


def literal(vector: Sequence[float]) -> Column:
    return F.lit([float(x) for x in vector])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    """Euclidean, rounded to 9 digits so that equal vectors tie in any engine."""
    return F.round(F.sqrt(squared_distance(a, b)), 9)


def truncate(a: Column, dims: int) -> Column:
    """The first ``dims`` components."""
    return F.slice(a, 1, dims)


def argmax(a: Column) -> Column:
    """Place (from 0) of the first largest component."""
    return F.array_position(a, F.array_max(a)) - 1


def argmin(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)) - 1


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def std_pop(a: Column) -> Column:
    m = mean(a)
    return F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a))


def entropy(a: Column, eps: float = 1e-8) -> Column:
    return -total(F.transform(a, lambda x: x * F.log(x + eps)))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    s = total(e)
    return F.transform(e, lambda x: x / s)


def barycentric(a: Column, eps: float = 1e-8) -> Column:
    """Negative parts dropped, the rest scaled to add up to one."""
    positive = F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))
    s = total(positive) + eps
    return F.transform(positive, lambda x: x / s)


def jensen_shannon(p: Column, q: Column, eps: float = 1e-12) -> Column:
    """Jensen-Shannon distance (natural logarithm) of two weight vectors, each scaled to one."""
    sp, sq = total(p) + eps, total(q) + eps
    pn, qn = F.transform(p, lambda x: x / sp), F.transform(q, lambda x: x / sq)
    m = F.zip_with(pn, qn, lambda x, y: (x + y) / 2)

    def kl(a: Column) -> Column:
        return total(F.zip_with(a, m, lambda x, y: F.when(x > 0, x * F.log((x + eps) / (y + eps))).otherwise(0.0)))

    return F.sqrt(F.greatest((kl(pn) + kl(qn)) / 2, F.lit(0.0)))


def affine(coords: Column, loadings: Sequence[Sequence[float]], centre: Sequence[float]) -> Column:
    """coords @ loadings.T + centre, loadings a row for each output."""
    rows = F.lit([[float(x) for x in row] for row in loadings])
    return F.zip_with(F.transform(rows, lambda row: dot(coords, row)), literal(centre), lambda x, c: x + c)
