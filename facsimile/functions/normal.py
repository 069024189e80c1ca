"""Standard normal distribution function and its inverse as SQL expressions.

Spark has no erf. Both functions below are published rational approximations
with double precision and stay inside whole-stage code generation.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart (1968), algorithm 5666, as printed in West (2005).
CDF_TOP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376]
CDF_BOTTOM = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
              296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
CDF_SPLIT = 7.07106781186547
SQRT_TWO_PI = 2.506628274631

# Wichura (1988), algorithm AS 241, PPND16.
QUANTILE_CENTRE = (
    [2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4,
     4.5921953931549871457e+4, 1.3731693765509461125e+4, 1.9715909503065514427e+3,
     1.3314166789178437745e+2, 3.3871328727963666080e+0],
    [5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4,
     2.1213794301586595867e+4, 5.3941960214247511077e+3, 6.8718700749205790830e+2,
     4.2313330701600911252e+1, 1.0],
)
QUANTILE_MIDDLE = (
    [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
     1.27045825245236838258e+0, 3.64784832476320460504e+0, 5.76949722146069140550e+0,
     4.63033784615654529590e+0, 1.42343711074968357734e+0],
    [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
     1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e+0,
     2.05319162663775882187e+0, 1.0],
)
QUANTILE_TAIL = (
    [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
     2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e+0,
     5.46378491116411436990e+0, 6.65790464350110377720e+0],
    [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
     7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
     5.99832206555887937690e-1, 1.0],
)


def _horner(coefficients: list[float], x: str) -> str:
    text = f"{coefficients[0]:.20e}"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c:.20e})"
    return text


def cdf_sql(x: str) -> str:
    """SQL text of the normal distribution function at ``x`` (a column name)."""
    size = f"abs({x})"
    weight = f"exp(-{size} * {size} / 2e0)"
    centre = f"{weight} * {_horner(CDF_TOP, size)} / {_horner(CDF_BOTTOM, size)}"
    fraction = f"({size} + 0.65e0)"
    for step in (4, 3, 2, 1):
        fraction = f"({size} + {step}e0 / {fraction})"
    lower = (
        f"CASE WHEN {size} > 37e0 THEN 0e0 "
        f"WHEN {size} < {CDF_SPLIT:.17e} THEN {centre} "
        f"ELSE {weight} / {fraction} / {SQRT_TWO_PI:.17e} END"
    )
    return f"(CASE WHEN {x} > 0e0 THEN 1e0 - ({lower}) ELSE ({lower}) END)"


def cdf_array(x: np.ndarray) -> np.ndarray:
    """The same for a numpy array (the centre formula; its tail is below 1e-12)."""
    size = np.minimum(np.abs(x), 37.0)
    lower = np.exp(-size * size / 2.0) * np.polyval(CDF_TOP, size) / np.polyval(CDF_BOTTOM, size)
    return np.where(x > 0, 1.0 - lower, lower)


def quantile_sql(u: str) -> str:
    """SQL text of the inverse distribution function at ``u``, 0 < u < 1."""
    q = f"({u} - 0.5e0)"
    r = f"(0.180625e0 - {q} * {q})"
    top, bottom = QUANTILE_CENTRE
    centre = f"{q} * {_horner(top, r)} / {_horner(bottom, r)}"
    edge = f"sqrt(-ln(least({u}, 1e0 - {u})))"
    top, bottom = QUANTILE_MIDDLE
    middle = f"{_horner(top, f'({edge} - 1.6e0)')} / {_horner(bottom, f'({edge} - 1.6e0)')}"
    top, bottom = QUANTILE_TAIL
    tail = f"{_horner(top, f'({edge} - 5e0)')} / {_horner(bottom, f'({edge} - 5e0)')}"
    return (
        f"(CASE WHEN abs({q}) <= 0.425e0 THEN {centre} "
        f"ELSE (CASE WHEN {q} < 0e0 THEN -1e0 ELSE 1e0 END) * "
        f"(CASE WHEN {edge} <= 5e0 THEN {middle} ELSE {tail} END) END)"
    )


def normal_cdf(column: str) -> Column:
    return F.expr(cdf_sql(f"`{column}`"))


def normal_quantile(column: str) -> Column:
    return F.expr(quantile_sql(f"`{column}`"))


def normal_draw_sql(first: str, second: str) -> str:
    """A standard normal number from two uniform ones (Box and Muller, 1958)."""
    return f"(sqrt(-2D * ln({first})) * cos({2.0 * math.pi!r}D * {second}))"
