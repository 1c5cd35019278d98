"""Column expressions over keypoint arrays. Missing values are NULL throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LIKELIHOOD = 0.1
AXES = "xyz"


def finite(c: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def joint(slot: int, axis: str, kp: str = "kp", floor: float = LIKELIHOOD) -> Column:
    """A coordinate, NULL where the likelihood is below the floor; an unknown likelihood does not mask."""
    k = F.col(kp)[slot]
    return F.when(F.coalesce(k["lik"] < floor, F.lit(False)), None).otherwise(k[axis])


def point(slot: int, dims: int, kp: str = "kp", floor: float = LIKELIHOOD) -> list[Column]:
    return [joint(slot, a, kp, floor) for a in AXES[:dims]]


def norm(v: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [x * x for x in v]))


def sub(a: list[Column], b: list[Column]) -> list[Column]:
    return [x - y for x, y in zip(a, b)]


def dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [x * y for x, y in zip(a, b)])


def distance(a: list[Column], b: list[Column]) -> Column:
    return norm(sub(a, b))


def mean_of(values: list[Column]) -> Column:
    """Mean of the values that are present; NULL if none is."""
    n = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), 1).otherwise(0) for v in values])
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    return F.when(n > 0, total / n)


def angle(a: list[Column], vertex: list[Column], b: list[Column]) -> Column:
    """Degrees at ``vertex``; NULL if a point is missing or a ray has no length."""
    u, v = sub(a, vertex), sub(b, vertex)
    cosine = F.try_divide(dot(u, v), norm(u) * norm(v))
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))
