"""Vector and numeric column functions; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Makes the median absolute deviation comparable with a standard deviation.
MAD_SCALE = 0.6744897501960817


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if lengths differ or an entry is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to [-1, 1]; null where a norm is 0."""
    value = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.when(value.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))


def logistic(x: Column) -> Column:
    """1 / (1 + e^-x) without overflow for large |x|."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (small + 1.0)).otherwise(small / (small + 1.0))


def evidence_margin(entailment: Column, contradiction: Column, neutral: Column) -> Column:
    """log(e^entailment + e^contradiction) - neutral."""
    top = F.greatest(entailment, contradiction)
    return top + F.log1p(F.exp(F.least(entailment, contradiction) - top)) - neutral


def polarity_margin(entailment: Column, contradiction: Column) -> Column:
    return entailment - contradiction


def predicted_label(entailment: Column, contradiction: Column, neutral: Column) -> Column:
    """The largest logit's label; ties go to entailment, then contradiction."""
    return (
        F.when((entailment >= contradiction) & (entailment >= neutral), F.lit("entailment"))
        .when(contradiction >= neutral, F.lit("contradiction"))
        .otherwise(F.lit("neutral"))
    )


def mapped_similarity(cos: Column) -> Column:
    """A cosine moved to [0, 1]."""
    return (cos + 1.0) / 2.0


def round_to(x: Column, digits: int = 6) -> Column:
    """Rounded, with -0.0 as 0.0, so that equal values look equal everywhere."""
    return F.round(x, digits) + F.lit(0.0)
