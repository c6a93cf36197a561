"""Scalar expressions of the panel: cleaning, transforms, bins, gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed values the results depend on.
FLOAT32_EPS = 1.1920928955078125e-07
BLEND_POWER = 1.5
GATE_STEEPNESS = 8.0
GATE_CENTRE = 0.55
GATE_CONFIDENT = 0.65
GATE_MODERATE = 0.4
GAP_LIMIT = 3.0
TRUST_FLOOR = 0.70
SAFE_DAMPING = 0.5


def clean(c: Column) -> Column:
    """NaN and both infinities become NULL; every operator below skips NULL."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def id_number(c: Column) -> Column:
    """The integer inside an id such as ``TRAIN_000012``."""
    return F.regexp_extract(c.cast("string"), r"(\d+)", 1).cast("long")


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def clip(c: Column, lo, hi) -> Column:
    """Bound ``c``; NULL stays NULL (``least``/``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def ratio(a: Column, b: Column, eps: float) -> Column:
    return F.try_divide(a, b + F.lit(eps))


def relative_to(x: Column, mean: Column, eps: float = FLOAT32_EPS) -> Column:
    """(x - mean) / (mean + eps); 0 where the mean is within eps of zero or unknown."""
    return F.when(F.abs(mean) > eps, (x - mean) / (mean + F.lit(eps))).otherwise(F.lit(0.0))


def right_closed_bin(c: Column, edges: Sequence[float]) -> Column:
    """0-based bin of ``c`` in (e0,e1], (e1,e2], ...; e0 itself is in bin 0, anything outside or NULL gives 0."""
    edges = sorted(set(float(e) for e in edges))
    inner = edges[1:-1]
    if not inner:
        return F.lit(0)
    passed = F.lit(0)
    for edge in inner:
        passed = passed + F.when(c > edge, 1).otherwise(0)
    return F.when((c <= edges[-1]), passed).otherwise(F.lit(0))


def sigmoid_gate(p: Column, k: float = GATE_STEEPNESS, theta: float = GATE_CENTRE) -> Column:
    return 1.0 / (1.0 + F.exp(-F.lit(k) * (p - F.lit(theta))))


def blend_weight(p: Column, tail: Column, bulk: Column) -> Column:
    """Sigmoid where the classifier is sure, or fairly sure and the regressors diverge; p^1.5 elsewhere."""
    sure = (p > GATE_CONFIDENT) | ((tail > bulk * 2.0) & (p > GATE_MODERATE))
    return F.when(sure, sigmoid_gate(p)).otherwise(F.pow(p, F.lit(BLEND_POWER)))


def prediction_gap(tail: Column, bulk: Column) -> Column:
    return F.abs(tail - bulk) / (bulk + F.lit(1e-6))


def damping(p: Column, gap: Column, limit=GAP_LIMIT, floor=TRUST_FLOOR, safe=SAFE_DAMPING) -> Column:
    """Factor in [safe, 1] that shrinks a weight when the gap is wide and the classifier unsure."""
    danger = clip((gap - limit) / limit, 0.0, 2.0)
    distrust = clip((floor - p) / floor, 0.0, 1.0)
    return clip(1.0 - danger * distrust * (1.0 - safe), safe, 1.0)


def blend(weight: Column, tail: Column, bulk: Column) -> Column:
    return weight * tail + (1.0 - weight) * bulk


def logit(p: Column) -> Column:
    return F.ln(p / (1.0 - p))


def binary_entropy(p: Column) -> Column:
    return -(p * F.ln(p) + (1.0 - p) * F.ln(1.0 - p))


def layout_fallback(*levels: Column) -> Column:
    return F.coalesce(*levels, F.lit(0.0))


def stable_round(c: Column, digits: int) -> Column:
    """Round so that exact decimal ties do not hang on the last bit of a sum: they are shifted up first.

    Plain double arithmetic; ``round`` on doubles goes through BigDecimal for every row.
    """
    scale = F.lit(float(10**digits))
    return F.rint((c.cast("double") + F.lit(float(f"3.7e-{digits + 4:02d}"))) * scale) / scale + F.lit(0.0)


def corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over the rows where both are known; NULL (not an error) when either is constant."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
