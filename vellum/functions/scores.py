"""Vector and score functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or one vector is zero; null where one is null."""
    n = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def l2_normalise(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def recency(year: Column, reference: Column, horizon: int = 10) -> Column:
    """1 in the reference year or later, 0 after ``horizon`` years; null for an unknown year."""
    return F.when(year.isNotNull() & reference.isNotNull(), F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0), reference - year) / horizon))


def evidence_strength(relevance: Column, year: Column, reference: Column, source: Column) -> Column:
    """Relevance times 1 (newer), 0.8 (not newer) or 0.9 (unknown), times 1 in the corpus and 0.9 elsewhere."""
    when = F.when(year.isNull() | reference.isNull(), 0.9).when(year > reference, 1.0).otherwise(0.8)
    return F.round(clip(relevance) * when * F.when(source == "corpus", 1.0).otherwise(0.9), 4)


def weighted_mean(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean over the values that aren't null, with weights scaled to them; 0 without any."""
    total = sum((F.when(v.isNotNull(), weights[k]).otherwise(0.0) for k, v in values.items()), F.lit(0.0))
    part = sum((F.coalesce(v * weights[k], F.lit(0.0)) for k, v in values.items()), F.lit(0.0))
    return F.when(total > 0, part / total).otherwise(0.0)


def upper_median(values: Column) -> Column:
    """The greater of the two middle values of an array."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))
