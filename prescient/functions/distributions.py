"""Distribution tails for the significance tests.

* Student t, two-sided p for integer degrees of freedom: closed form
  (Abramowitz & Stegun 26.7.3 / 26.7.4), and a tail series where p is small,
  built from Spark expressions, so it runs JVM-side; ``sql_t_two_sided_p`` is
  the closed form in SQL (enough for values rounded to six places).
* The complement of the error function, the chi-square upper tail for any whole
  degrees of freedom and the Shapiro-Wilk test (Royston 1995, algorithm AS R94) of
  groups of up to SMALL_GROUP values are Spark expressions too: recurrences in
  ``aggregate``, no Python worker. ``chi2_sf`` and ``shapiro_wilk`` are the same on
  plain floats.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def _coef_even(j: Column) -> Column:
    """prod_{i=1..j} (2i-1)/(2i); 1 for j = 0."""
    seq = F.filter(F.sequence(F.lit(1), F.greatest(j, F.lit(1))), lambda i: i <= j)
    return F.aggregate(seq, F.lit(1.0), lambda a, i: a * (2 * i - 1) / (2 * i))


def _coef_odd(j: Column) -> Column:
    """prod_{i=1..j} (2i)/(2i+1); 1 for j = 0."""
    seq = F.filter(F.sequence(F.lit(1), F.greatest(j, F.lit(1))), lambda i: i <= j)
    return F.aggregate(seq, F.lit(1.0), lambda a, i: a * (2 * i) / (2 * i + 1))


#: Above this the closed form loses no digits that matter; below it the tail series is used.
_T_NEAR = 0.05


def t_two_sided_p(t, df) -> Column:
    """P(|T_df| >= |t|) for integer df >= 1 (null when t is null).

    The closed form is 1 - a, which cancels when p is small; there the tail
    series takes over.
    """
    tc = t if isinstance(t, Column) else F.col(t)
    dc = (df if isinstance(df, Column) else F.col(df)).cast("int")
    theta = F.atan(F.abs(tc) / F.sqrt(dc.cast("double")))
    s, c = F.sin(theta), F.cos(theta)

    def terms(m, coef, odd):
        seq = F.filter(F.sequence(F.lit(0), F.greatest(m, F.lit(0))), lambda j: j <= m)
        return F.aggregate(
            seq, F.lit(0.0),
            lambda acc, j: acc + coef(j) * F.pow(c, (2 * j + (1 if odd else 0)).cast("double")))

    even = s * terms(F.floor((dc - 2) / 2).cast("int"), _coef_even, False)
    odd_gt1 = (F.lit(2.0) / F.lit(math.pi)) * (
        theta + s * terms(F.floor((dc - 3) / 2).cast("int"), _coef_odd, True))
    one = F.lit(2.0) / F.lit(math.pi) * theta
    near = F.lit(1.0) - F.when(dc % 2 == 0, even).when(dc == 1, one).otherwise(odd_gt1)
    return F.when(near > _T_NEAR, near).otherwise(_t_tail(tc, dc))


def _t_tail(t: Column, df: Column) -> Column:
    """The same probability as its upper-tail series, exact to the last digits.

    The incomplete beta function I_x(df/2, 1/2) at x = df / (df + t^2), by its
    power series (A&S 26.5.4); every term is positive, so nothing cancels. The
    number of terms follows from x: what is left out is below e^-40 of the sum.
    """
    d, t2 = df.cast("double"), t * t
    x, a = d / (d + t2), d / 2
    half = F.floor(df / 2).cast("int")
    first = F.when(df % 2 == 0, _coef_even(half)) \
        .otherwise(F.lit(2.0) / F.lit(math.pi) * _coef_odd(half))
    n = F.when(t2 > 0, F.ceil(F.lit(40.0) / -F.log(x))).otherwise(F.lit(1))
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def step(acc, j):
        term = acc["term"] * x * (a + j - 0.5) / (a + j)
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), start, step,
                        lambda acc: acc["sum"])
    return first * F.pow(x, a) * F.sqrt(t2 / (d + t2)) * total


def sql_t_two_sided_p(t: str, df: str) -> str:
    """Same closed form in DuckDB SQL."""
    th = f"atan(abs({t}) / sqrt(CAST({df} AS DOUBLE)))"
    ce = ("coalesce(list_product(list_transform(range(1, j + 1), "
          "lambda i: (2 * i - 1) / (2 * i))), 1.0)")
    co = ("coalesce(list_product(list_transform(range(1, j + 1), "
          "lambda i: (2 * i) / (2 * i + 1))), 1.0)")
    even = (f"sin({th}) * coalesce(list_sum(list_transform(range(0, CAST(floor(({df} - 2) / 2) AS BIGINT) + 1), "
            f"lambda j: {ce} * pow(cos({th}), 2 * j))), 0.0)")
    odd = (f"(2.0 / pi()) * ({th} + sin({th}) * coalesce(list_sum(list_transform("
           f"range(0, CAST(floor(({df} - 3) / 2) AS BIGINT) + 1), "
           f"lambda j: {co} * pow(cos({th}), 2 * j + 1))), 0.0))")
    one = f"(2.0 / pi()) * {th}"
    return (f"(1.0 - CASE WHEN {df} % 2 = 0 THEN {even} WHEN {df} = 1 THEN {one} "
            f"ELSE {odd} END)")


def erfc(x) -> Column:
    """1 - erf(x): a series of positive terms up to 2.5, the continued fraction beyond."""
    z = F.abs(x)
    start = F.struct(z.alias("sum"), z.alias("term"))

    def step(acc, n):
        term = acc["term"] * 2 * z * z / (2 * n + 1)
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step, lambda acc: acc["sum"])
    near = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-z * z) * series
    below = F.aggregate(F.sequence(F.lit(60), F.lit(1)), z, lambda f, k: z + k / 2.0 / f)
    far = F.exp(-z * z) / (F.lit(math.sqrt(math.pi)) * below)
    upper = F.when(z < 2.5, near).otherwise(far)
    return F.when(x < 0, F.lit(2.0) - upper).otherwise(upper)


def chi2_upper(x, k) -> Column:
    """P(chi-square with k >= 1 degrees of freedom > x); 1 for x <= 0, null for null."""
    h, dof = F.greatest(x, F.lit(0.0)) / 2, k.cast("int")
    odd = dof % 2 == 1

    def total(first, half, terms):
        start = F.struct(F.lit(0.0).alias("sum"), first.alias("term"))

        def step(acc, i):
            return F.struct((acc["sum"] + acc["term"]).alias("sum"),
                            (acc["term"] * h / (i + half)).alias("term"))
        seq = F.filter(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), lambda i: i <= terms)
        return F.aggregate(seq, start, step, lambda acc: acc["sum"])
    # k odd: erfc(sqrt h) + e^-h (h^(1/2)/Gamma(3/2) + h^(3/2)/Gamma(5/2) + ...)
    tail_odd = erfc(F.sqrt(h)) + F.exp(-h) * total(
        2 * F.sqrt(h / F.lit(math.pi)), F.lit(0.5), ((dof - 1) / 2).cast("int"))
    tail_even = F.exp(-h) * total(F.lit(1.0), F.lit(0.0), (dof / 2).cast("int"))
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x <= 0, F.lit(1.0)) \
        .when(odd, tail_odd).otherwise(tail_even)


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of the chi-square distribution with integer k dof."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return float("nan")
    if x <= 0:
        return 1.0
    h = x / 2.0
    if k % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, k // 2):
            term *= h / i
            total += term
        return math.exp(-h) * total
    # odd: Q(x;1) = erfc(sqrt(x/2)); Q(x;k+2) = Q(x;k) + (x/2)^(k/2) e^(-x/2) / Gamma(k/2 + 1)
    q = math.erfc(math.sqrt(h))
    for j in range(1, k, 2):  # j = 1, 3, ..., k-2
        q += math.exp((j / 2.0) * math.log(h) - h - math.lgamma(j / 2.0 + 1.0))
    return q


def _poly(cc, x):
    r = 0.0
    for c in reversed(cc):
        r = r * x + c
    return r


# Coefficients of Royston's approximation (AS R94).
_C1 = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_C3 = [0.544, -0.39978, 0.025054, -6.714e-4]
_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
_C6 = [-0.4803, -0.082676, 0.0030302]
_G = [-2.273, 0.459]


#: Values of a group whose Shapiro-Wilk weights are literals of the plan, at most.
SMALL_GROUP = 50


def shapiro_weights(n: int) -> list[float]:
    """Weights of the differences largest - smallest, next - next, ... of n values."""
    if n < 3:
        return []
    if n == 3:
        return [math.sqrt(0.5)]
    nn2, nd = n // 2, NormalDist()
    m = [nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, nn2 + 1)]
    summ2 = 2.0 * sum(v * v for v in m)
    ssumm2 = math.sqrt(summ2)
    rsn = 1.0 / math.sqrt(n)
    a1 = _poly(_C1, rsn) - m[0] / ssumm2
    if n > 5:
        a2 = -m[1] / ssumm2 + _poly(_C2, rsn)
        fac = math.sqrt((summ2 - 2.0 * m[0] ** 2 - 2.0 * m[1] ** 2)
                        / (1.0 - 2.0 * a1 ** 2 - 2.0 * a2 ** 2))
        return [a1, a2] + [-m[i] / fac for i in range(2, nn2)]
    fac = math.sqrt((summ2 - 2.0 * m[0] ** 2) / (1.0 - 2.0 * a1 ** 2))
    return [a1] + [-m[i] / fac for i in range(1, nn2)]


def shapiro_w(x: Column, most: int = SMALL_GROUP) -> Column:
    """W of a sorted array of numbers without nulls, 3 to ``most`` of them; null for fewer
    or where all are equal, an error for more."""
    n = F.size(x)
    half = F.floor(n / 2).cast("int")
    weights = F.element_at(F.array(*[F.array(*[F.lit(a) for a in shapiro_weights(i) or [0.0]])
                                     for i in range(most + 1)]), F.least(n, F.lit(most)) + 1)
    num = F.aggregate(F.sequence(F.lit(1), F.greatest(half, F.lit(1))), F.lit(0.0), lambda s, i: s + (
        F.get(weights, i - 1) * (F.get(x, n - i) - F.get(x, i - 1))))
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    ss = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
    usable = (n >= 3) & (F.array_max(x) > F.array_min(x))
    return F.when(n > most, F.raise_error(F.lit(f"over {most} values in a group")).cast("double")) \
        .when(usable, F.least(F.lit(1.0), num * num / ss))


def shapiro_p(w: Column, n: Column) -> Column:
    """p of ``shapiro_w`` for ``n`` values; both should be columns, as they recur."""
    def poly(cc, v):
        out = F.lit(0.0)
        for c in reversed(cc):
            out = out * v + F.lit(c)
        return out
    y, size, ln = F.log(1 - w), n.cast("double"), F.log(n.cast("double"))
    small = n <= 11
    z = F.when(small, (-F.log(poly(_G, size) - y) - poly(_C3, size)) / F.exp(poly(_C4, size))) \
        .otherwise((y - poly(_C5, ln)) / F.exp(poly(_C6, ln)))
    three = F.lit(6.0 / math.pi) * (F.asin(F.sqrt(w)) - F.lit(math.pi / 3.0))
    return F.when(w.isNull(), F.lit(None).cast("double")) \
        .when(n == 3, F.greatest(F.lit(0.0), F.least(F.lit(1.0), three))) \
        .when(w >= 1, F.lit(1.0)).when(small & (y >= poly(_G, size)), F.lit(1e-99)) \
        .otherwise(erfc(z / F.lit(math.sqrt(2.0))) / 2)


def sql_normal_upper(z: str) -> str:
    """1 - Phi(z) in DuckDB: half of 1 -+ erf by its series of positive terms."""
    v = f"greatest(abs({z}) / sqrt(2.0), 1e-300)"
    erf = (f"2 / sqrt(pi()) * exp(-({v}) * ({v})) * list_sum(list_transform(range(0, 160), "
           f"lambda i: exp(2 * i * ln(2.0) + (2 * i + 1) * ln({v}) - lgamma(2 * i + 2.0) + lgamma(i + 1.0))))")
    return f"(0.5 - sign({z}) * 0.5 * ({erf}))"


def shapiro_wilk(values) -> tuple[float, float]:
    """(W, p) of the Shapiro-Wilk normality test, 3 <= n <= 5000."""
    x = sorted(float(v) for v in values)
    n = len(x)
    if n < 3:
        return float("nan"), float("nan")
    if x[-1] - x[0] == 0:
        return float("nan"), float("nan")
    nn2, a = n // 2, shapiro_weights(n)
    mean = sum(x) / n
    ss = sum((v - mean) ** 2 for v in x)
    num = sum(a[i] * (x[n - 1 - i] - x[i]) for i in range(nn2))
    w = min(1.0, num * num / ss)
    if n == 3:
        p = (6.0 / math.pi) * (math.asin(math.sqrt(w)) - math.pi / 3.0)
        return w, max(0.0, min(1.0, p))
    w1 = 1.0 - w
    if w1 <= 0:
        return w, 1.0
    y = math.log(w1)
    if n <= 11:
        gamma = _poly(_G, n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mu = _poly(_C3, n)
        sd = math.exp(_poly(_C4, n))
    else:
        xx = math.log(n)
        mu = _poly(_C5, xx)
        sd = math.exp(_poly(_C6, xx))
    return w, 1.0 - NormalDist(mu, sd).cdf(y)
