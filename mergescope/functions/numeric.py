"""Numeric column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of W. J. Cody's rational approximations to the error function (Math. Comp. 23, 1969).
ERF_SMALL_P = (
    1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3,
)
ERF_SMALL_Q = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
ERFC_MID_P = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
    8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
)
ERFC_MID_Q = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
    3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
)
ERFC_TAIL_P = (
    1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
    1.60837851487422766e-2, 6.58749161529837803e-4,
)
ERFC_TAIL_Q = (
    1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2,
    2.33520497626869185e-3,
)
INV_SQRT_PI = 0.5641895835477563

# Significance thresholds and their labels.
STAR_LEVELS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))
NOT_SIGNIFICANT = "ns"

CELLS_PER_OCTAVE = 256
CELL_OFFSET = 1 << 20


def np_round(x: Column, digits: int = 0) -> Column:
    """Round half to even on the scaled double, the rule of numpy and pandas."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def ratio(numerator: Column, denominator: Column, empty: float | None = None) -> Column:
    """Quotient as double; a zero denominator gives NULL, or ``empty`` when stated."""
    quotient = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return quotient if empty is None else F.coalesce(quotient, F.lit(float(empty)))


def percent(part: Column, whole: Column, digits: int | None = None, empty: float | None = None) -> Column:
    value = ratio(part, whole, empty) * F.lit(100.0)
    return value if digits is None else np_round(value, digits)


def clip(x: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Bound a column from below and above; NULL stays NULL (``greatest``/``least`` would skip it)."""
    out = x
    if low is not None:
        low = low if isinstance(low, Column) else F.lit(low)
        out = F.when(out < low, low).otherwise(out)
    if high is not None:
        high = high if isinstance(high, Column) else F.lit(high)
        out = F.when(out > high, high).otherwise(out)
    return out


def log10_scale(x: Column) -> Column:
    """log10 with values below one drawn at zero."""
    return F.log10(clip(x.cast("double"), low=1.0))


def pct_modification(revised: Column, initial: Column) -> Column:
    """Revision lines as a percentage of the initial lines; NULL when nothing was submitted first."""
    return F.try_divide(revised.cast("double"), initial.cast("double")) * F.lit(100.0)


def order_cell(x: Column) -> Column:
    """An order-preserving integer bucket of a double, 256 per power of two.

    Monotone in ``x`` and a function of ``x`` alone, so a retried task rebuilds the same buckets. The number of
    buckets in use is bounded by the exponent range whatever the row count, which bounds any window over buckets.
    Infinities have the outermost buckets, and so have undefined values.
    """
    value = x.cast("double")
    finite = F.when(F.abs(value) < float("inf"), F.abs(value))
    inside = F.floor(F.log2(finite) * F.lit(float(CELLS_PER_OCTAVE))).cast("long") + F.lit(CELL_OFFSET)
    size = F.coalesce(inside, F.lit(2 * CELL_OFFSET).cast("long"))
    zero = F.lit(0).cast("long")
    # Never NULL, so a join on the cell adds no filter that would keep two branches from sharing one shuffle.
    return F.coalesce(F.when(value.isNull() | (value == 0.0), zero).when(value > 0.0, size).otherwise(-size), zero)


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def erfc(x: Column) -> Column:
    """Complementary error function of a double, to double precision, as one Catalyst expression."""
    y = F.abs(x)
    squared = y * y
    small = F.lit(1.0) - y * _polynomial(squared, ERF_SMALL_P) / _polynomial(squared, ERF_SMALL_Q)
    decay = F.exp(-squared)
    middle = decay * _polynomial(y, ERFC_MID_P) / _polynomial(y, ERFC_MID_Q)
    inverse = F.lit(1.0) / squared
    series = inverse * _polynomial(inverse, ERFC_TAIL_P) / _polynomial(inverse, ERFC_TAIL_Q)
    tail = decay * (F.lit(INV_SQRT_PI) - series) / y
    positive = F.when(y <= 0.46875, small).when(y <= 4.0, middle).otherwise(tail)
    return F.when(x < 0.0, F.lit(2.0) - positive).otherwise(positive)


def chi_square_p(statistic: Column) -> Column:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return erfc(F.sqrt(statistic / F.lit(2.0)))


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value of a statistic already taken in its extreme direction, at most one."""
    return F.when(z.isNotNull(), F.least(erfc(z / F.sqrt(F.lit(2.0))), F.lit(1.0)))


def stars(p: Column) -> Column:
    """Significance label of a p-value."""
    (first_level, first_label), *rest = STAR_LEVELS
    ladder = F.when(p < first_level, first_label)
    for level, label in rest:
        ladder = ladder.when(p < level, label)
    return F.when(p.isNotNull(), ladder.otherwise(NOT_SIGNIFICANT))
