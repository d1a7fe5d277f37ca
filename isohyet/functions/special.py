"""Special functions as Column expressions, so the fits and tests stay inside the JVM.

Arguments that appear many times (``a``, ``x``) should be plain columns or lambda variables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bernoulli-number coefficients of the asymptotic series of ln Gamma, digamma and trigamma.
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
DIGAMMA = [-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132, 691 / 32760]
TRIGAMMA = [1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730]
SHIFT = 10

# Wichura's AS 241 (PPND16) coefficients, lowest power first.
PPND_CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
)
PPND_MIDDLE = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
PPND_TAIL = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)


def _poly(coefficients: list[float], x: Column) -> Column:
    acc = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        acc = acc * x + F.lit(c)
    return acc


def _shifted_sum(term, a: Column) -> Column:
    acc = term(a)
    for i in range(1, SHIFT):
        acc = acc + term(a + float(i))
    return acc


def log_gamma(a: Column) -> Column:
    """ln Gamma(a), a > 0."""
    z = a + float(SHIFT)
    series = _poly(STIRLING, 1.0 / (z * z)) / z
    stirling = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series
    return stirling - _shifted_sum(F.log, a)


def digamma(a: Column) -> Column:
    z = a + float(SHIFT)
    w = 1.0 / (z * z)
    return F.log(z) - 0.5 / z + w * _poly(DIGAMMA, w) - _shifted_sum(lambda t: 1.0 / t, a)


def trigamma(a: Column) -> Column:
    z = a + float(SHIFT)
    w = 1.0 / (z * z)
    return 1.0 / z + 0.5 * w + w * _poly(TRIGAMMA, w) / z + _shifted_sum(lambda t: 1.0 / (t * t), a)


def gamma_shape(log_mean_minus_mean_log: Column) -> Column:
    """Maximum-likelihood gamma shape: the root of ln(a) - digamma(a) = A.

    Thom's estimate followed by the generalised Newton step of Minka (2002), which converges
    quadratically; eight steps are far past double precision for every A met in practice.
    Null where A <= 0, that is, where all values are equal.
    """
    s = log_mean_minus_mean_log
    thom = (1.0 + F.sqrt(1.0 + 4.0 * s / 3.0)) / (4.0 * s)

    def step(a, _):
        residual = F.log(a) - digamma(a) - s
        return 1.0 / (1.0 / a + residual / (a * a * (1.0 / a - trigamma(a))))

    return F.when(s > 1e-12, F.aggregate(F.sequence(F.lit(1), F.lit(8)), thom, step))


def gamma_cdf(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma P(a, x).

    The series x^a e^-x / Gamma(a+1) * (1 + x/(a+1) (1 + x/(a+2) (...))), nested so that one number is
    carried.  Its length follows the argument: the terms shrink once n > x - a, and then like a Gaussian
    of width sqrt(x), so the tail that is left out is below double precision.
    """
    terms = (30.0 + F.greatest(x - a, F.lit(0.0)) * 1.25 + 10.0 * F.sqrt(x)).cast("int")
    series = F.aggregate(
        F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), lambda acc, n: 1.0 + x / (a + n) * acc
    )
    value = F.exp(a * F.log(x) - x - log_gamma(a + 1.0)) * series
    # Not least(), which would turn an unknown probability into 1.
    return F.when(x <= 0, F.lit(0.0)).when(value > 1.0, F.lit(1.0)).otherwise(value)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|): 1 - P(1/2, z^2/2)."""
    return 1.0 - gamma_cdf(F.lit(0.5), z * z / 2.0)


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution; +-infinity at 0 and 1."""
    q = p - 0.5
    centre_r = 0.180625 - q * q
    centre = q * _poly(PPND_CENTRE[0], centre_r) / _poly(PPND_CENTRE[1], centre_r)
    r = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    middle = _poly(PPND_MIDDLE[0], r - 1.6) / _poly(PPND_MIDDLE[1], r - 1.6)
    tail = _poly(PPND_TAIL[0], r - 5.0) / _poly(PPND_TAIL[1], r - 5.0)
    outer = F.signum(q) * F.when(r <= 5.0, middle).otherwise(tail)
    infinite = F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf")))
    return F.coalesce(infinite, F.when(F.abs(q) <= 0.425, centre).otherwise(outer))
