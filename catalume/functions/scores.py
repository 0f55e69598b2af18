"""Scores of items, faces and vectors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calibrated_sharpness(raw: Column, low: float = 40.0, high: float = 15000.0) -> Column:
    """Log scale between two raw values, clipped to [0, 1]."""
    bottom = F.log1p(F.lit(low))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log1p(raw) - bottom) / (F.log1p(F.lit(high)) - bottom)))


def aesthetic(para: Column, clip: Column) -> Column:
    return F.coalesce(para, clip)


def combined_score(sharp: Column, *aesthetics: Column, weights: tuple[float, float] = (0.4, 0.6), default: float = 0.5) -> Column:
    """Weighted sum of sharpness and the first aesthetic score there is, to 4 places."""
    return round_double(weights[0] * sharp + weights[1] * F.coalesce(*aesthetics, F.lit(default)), 4)


def rescale_heads(columns: list[str], denom: float = 5.0, default: float = 2.5) -> list[Column]:
    """Head scores of 0..denom to 0..1; a missing one counts as the default."""
    return [(F.coalesce(F.col(c), F.lit(default)) / denom).alias(c) for c in columns]


def keeper_score(combined: Column, portrait: Column) -> Column:
    """Combined, moved a little by the portrait score; combined alone if either is null."""
    return F.coalesce(round_double(combined + 0.05 * (portrait - 0.5), 6), combined)


def portrait_score(sharp: Column, expr: Column) -> Column:
    return F.when(sharp.isNull(), None).when(expr.isNull(), round_double(sharp, 4)).otherwise(round_double(0.6 * sharp + 0.4 * expr, 4))


def face_quality(sharp: Column, expr: Column, rel: Column) -> Column:
    half = lambda c: F.coalesce(c, F.lit(0.5))
    return round_double(0.55 * half(sharp) + 0.25 * F.least(F.lit(1.0), rel / 0.10) + 0.20 * half(expr), 4)


def round_double(x: Column, digits: int) -> Column:
    """Rounded as doubles are: the shifted value to the nearest whole number. Spark's own rounds the shortest decimal text, which differs at halves."""
    return F.round(x * 10.0**digits) / 10.0**digits


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in doubles; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column, eps: float | None = None) -> Column:
    """Unit vector; a zero vector gives null, or is divided by ``eps`` if that is given."""
    norm = F.sqrt(dot(v, v))
    by = F.greatest(norm, F.lit(eps)) if eps else F.when(norm > 0, norm)
    return F.transform(v, lambda x: x.cast("double") / by)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def halves(hex16: Column) -> tuple[Column, Column]:
    """The two 32-bit halves of a 64-bit hash in hex."""
    part = lambda i: F.conv(F.substring(hex16, i, 8), 16, 10).cast("long")
    return part(1), part(9)


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hex. Halves keep clear of signed overflow."""
    (a1, a2), (b1, b2) = halves(a), halves(b)
    return (F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))).cast("int")


def bipolar_score(v: Column, pairs: list[tuple[list[float], list[float]]]) -> Column:
    """Mean over prompt pairs of the softmax weight of the positive prompt."""
    arr = lambda x: F.array(*[F.lit(float(e)) for e in x])
    parts = [1 / (1 + F.exp(dot(v, arr(neg)) - dot(v, arr(pos)))) for pos, neg in pairs]
    return sum(parts[1:], parts[0]) / len(parts)


def iou(a: tuple[Column, ...], b: tuple[Column, ...], clamp: bool = True) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 if the union is empty."""
    zero = F.lit(0.0)
    side = lambda lo, hi: F.greatest(zero, hi - lo)
    inter = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    area = (lambda x: side(x[0], x[2]) * side(x[1], x[3])) if clamp else (lambda x: (x[2] - x[0]) * (x[3] - x[1]))
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def accept_direct(prob: Column, rel: Column, min_rel: float = 0.04, small_prob: float = 0.98, small_rel: float = 0.015) -> Column:
    """Wide enough, or nearly certain and not too small."""
    return (rel >= min_rel) | ((prob >= small_prob) & (rel >= small_rel))
