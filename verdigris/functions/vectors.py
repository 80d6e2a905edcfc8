"""Numeric functions over columns and arrays."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def squash(weight: Column) -> Column:
    """1 - exp(-max(weight, 0)): a weight's strength in [0, 1)."""
    return 1 - F.exp(-F.greatest(weight, F.lit(0.0)))


def softmax(score: Column, group: WindowSpec) -> Column:
    """Softmax of a score over the rows of a window without order."""
    e = F.exp(score - F.max(score).over(group))
    return e / F.sum(e).over(group)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two histograms: sqrt(max(0, 1 - sum sqrt(a b) / sqrt(sum a sum b)))."""
    overlap = array_sum(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))))
    whole = F.sqrt(array_sum(F.transform(a, lambda x: x.cast("double"))) * array_sum(F.transform(b, lambda x: x.cast("double"))))
    return F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(overlap, whole), F.lit(1.0))))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def fused_logit(p_scorer: Column, p_support: Column, draft: Column, w_scorer: float = 1.0, w_support: float = 0.5, w_draft: float = 1.0) -> Column:
    """Log-linear fusion of two probabilities and a match in [0, 1]."""
    tiny = F.lit(1e-9)
    return w_scorer * F.ln(p_scorer + tiny) + w_support * F.ln(p_support + tiny) + w_draft * draft


def fitted_size(width: Column, height: Column, target: int, upscale: bool = False) -> Column:
    """struct<width, height> of an image whose longer side becomes `target`."""
    scale = F.lit(float(target)) / F.greatest(width, height)
    scale = scale if upscale else F.least(F.lit(1.0), scale)
    side = lambda x: F.greatest(F.lit(1), F.rint(x * scale).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def normalised(values: Column, mean: float, std: float) -> Column:
    """8-bit samples as (x / 255 - mean) / std."""
    return F.transform(values, lambda x: (x / F.lit(255.0) - mean) / std)
