"""Column expressions: distances, models of spatial continuity, probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithospark.spec import Structure, VariogramModel


#: Decibels of a factor of ten (fixed value).
DECIBELS = 10.0


def decibel(v: Column, reference: float, epsilon: float = 1e-10) -> Column:
    """Of the modulus, which counts as epsilon at least."""
    return DECIBELS * F.log10(F.greatest(F.abs(v), F.lit(epsilon)) / reference)


def undecibel(d: Column, reference: float, negative: Column | None = None) -> Column:
    """The amplitude at d decibels, with a minus sign where negative holds."""
    out = F.pow(F.lit(10.0), d / DECIBELS) * reference
    return out if negative is None else F.when(negative, -out).otherwise(out)


def equalized(v: Column, decibels: float, reference: float, epsilon: float = 1e-5) -> Column:
    """v with its modulus raised by so many decibels; the sign stays."""
    return undecibel(decibel(v, reference, epsilon) + decibels, reference, v < 0)


def azimuth(x: Column, y: Column, cx: float, cy: float, half: bool = False) -> Column:
    """Degrees clockwise from north, 0 to 360, or of the half circle the line lies in; 0 at the center."""
    dx, dy = x - cx, y - cy
    turn = F.lit(0.0) if half else F.when(dx < 0, 180.0).otherwise(0.0)
    return F.when(dx == 0, F.when(dy < 0, 180.0).otherwise(0.0)).otherwise(90 - F.degrees(F.atan(F.try_divide(dy, dx))) + turn)


def to_polar(re: Column, im: Column) -> tuple[Column, Column]:
    return F.hypot(re, im), F.atan2(im, re)


def to_rectangular(magnitude: Column, phase: Column) -> tuple[Column, Column]:
    return magnitude * F.cos(phase), magnitude * F.sin(phase)


def linear_interpolate(x: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    return y0 + (x - x0) * (y1 - y0) / (x1 - x0)


def unitize(a: Column) -> Column:
    """Array over its sum; null if the sum is 0."""
    total = F.aggregate(a, F.lit(0.0), lambda s, e: s + e)
    return F.when(total != 0, F.transform(a, lambda e: e / total))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    return unitize(F.transform(a, lambda e: F.exp(e - top)))


def sums_to_one(a: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(F.aggregate(a, F.lit(0.0), lambda s, e: s + e) - 1) <= tolerance


def has_no_chance(a: Column) -> Column:
    """Whether a probability is zero or negative."""
    return F.exists(a, lambda e: e <= 0)


def draw_index(p: Column, u: Column) -> Column:
    """0-based place of the first cumulative probability >= u; null if there is none."""
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("hit"))
    step = lambda s, e: F.struct((s["sum"] + e).alias("sum"), (s["at"] + 1).alias("at"), F.when(s["hit"].isNull() & (s["sum"] + e >= u), s["at"]).otherwise(s["hit"]).alias("hit"))
    return F.aggregate(p, state, step, lambda s: s["hit"])


def chi2_pdf(x: Column, df: int) -> Column:
    return F.when(x > 0, F.exp((df / 2 - 1) * F.log(x) - x / 2 - (df / 2 * math.log(2) + math.lgamma(df / 2)))).otherwise(0.0)


def anisotropic_h(dx: Column, dy: Column, dz: Column, s: Structure) -> Column:
    """Distance in units of the ranges after turning by azimuth, dip and roll (degrees)."""
    a, b, c = (math.radians(v) for v in (90 - s.azimuth, -s.dip, s.roll))
    m = (
        (math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), -math.sin(b)),
        (-math.cos(c) * math.sin(a) + math.sin(c) * math.sin(b) * math.cos(a), math.cos(c) * math.cos(a) + math.sin(c) * math.sin(b) * math.sin(a), math.sin(c) * math.cos(b)),
        (math.sin(c) * math.sin(a) + math.cos(c) * math.sin(b) * math.cos(a), -math.sin(c) * math.cos(a) + math.cos(c) * math.sin(b) * math.sin(a), math.cos(c) * math.cos(b)),
    )
    total = F.lit(0.0)
    for row, r in zip(m, s.ranges):
        part = (dx * row[0] + dy * row[1] + dz * row[2]) / r
        total = total + part * part
    return F.sqrt(total)


def structure_gamma(h: Column, kind: str, range_: float = 1.0) -> Column:
    """Standard structure at distance h in ranges; the power model takes the distance itself."""
    if kind == "spherical":
        return F.when(h >= 1, 1.0).otherwise(1.5 * h - 0.5 * h * h * h)
    if kind == "exponential":
        return 1 - F.exp(-3 * h)
    if kind == "gaussian":
        return 1 - F.exp(-9 * h * h)
    if kind == "power":
        return F.pow(h * range_, F.lit(1.5))
    if kind == "hole":
        return 1 - F.cos(math.pi * h)
    raise ValueError(kind)


def gamma(dx: Column, dy: Column, dz: Column, model: VariogramModel) -> Column:
    """Semivariance of a lag vector; 0 at the zero vector."""
    total = F.lit(model.nugget)
    for s in model.structures:
        total = total + s.sill * structure_gamma(anisotropic_h(dx, dy, dz, s), s.kind, s.ranges[0])
    return F.when((dx == 0) & (dy == 0) & (dz == 0), 0.0).otherwise(total)


def transiogram_p(kind: str, h: Column, range_: float, sill: float, auto: bool) -> Column:
    """Probability of a transition at distance h by a model; 0 for kinds that are not known."""
    if kind not in ("spherical", "exponential", "gaussian", "power", "hole"):
        return F.lit(0.0)
    g = structure_gamma(h / range_, kind, range_)
    return 1 - g * (1 - sill) if auto else g * sill


def tau_combine(marginal: Column, probabilities: list[Column], taus: list[float]) -> Column:
    """Tau model; 0 below a marginal of 0.0001, odds of 1000 where a probability is 0."""
    odds = lambda p: F.when(p <= 0, 1000.0).otherwise((1 - p) / p)
    x0 = odds(marginal)
    x = x0
    for p, t in zip(probabilities, taus):
        x = x * F.pow(odds(p) / x0, F.lit(t))
    return F.when(marginal < 0.0001, 0.0).otherwise(1 / (1 + x))


def quadratic_trend(x: Column, y: Column, z: Column, c: tuple[float, ...]) -> Column:
    """a x2 + b y2 + c z2 + d xy + e xz + f yz + g x + h y + i z, without intercept."""
    terms = (x * x, y * y, z * z, x * y, x * z, y * z, x, y, z)
    out = F.lit(0.0)
    for k, t in zip(c, terms):
        out = out + k * t
    return out


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Bounding box first, then the parity of edges to the right."""
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        if ay != by:
            hit = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            crossings = crossings + hit.cast("int")
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossings % 2 == 1)
