"""L1: distribution functions as SQL expressions (Spark, or DuckDB for the oracle).

Spark SQL has no gamma, beta, t or chi-square function, and Python UDFs
would leave whole-stage codegen, so these are built from plain SQL
arithmetic and higher-order functions (``aggregate`` over a fixed
``sequence``).  They are generated as SQL *text* and parsed once by
``F.expr`` -- building them Column by Column costs thousands of JVM
round trips.  They are meant for *aggregated* rows (one per group or per
test), never for raw rows.

Arguments are SQL expressions (column names or formulas) as strings.

Method
------
* ``lgamma``: Lanczos approximation (g = 7, 9 terms), |rel err| < 1e-14
  for x >= 0.5 (DuckDB has a native ``lgamma``).
* Student t, two-sided tail:  with theta = atan(|t| / sqrt(nu)),
  P(|T| < |t|) = 2 / B(nu/2, 1/2) * integral_0^theta cos(u)^(nu-1) du.
  The integrand is about 1/sqrt(nu) wide, so the grid ends at
  14/sqrt(nu) (what lies beyond is below 1e-40); composite Simpson is then
  accurate to ~1e-10 for every nu >= 1.  cos(u)^(nu-1) is taken through
  log1p(-sin(u)^2), and Gamma((nu+1)/2) / Gamma(nu/2) from its asymptotic
  series for large nu, so nothing cancels at nu = 1e9.
* Normal: P(|Z| < z) = sqrt(2/pi) * integral_0^z exp(-x^2/2) dx, same rule.
* Chi-square with integer k: the closed Poisson-sum forms.
* Quantiles (constant probability): exact forms for nu = 1, 2; otherwise
  a Cornish-Fisher start and Newton steps on the t CDF (monotone
  convergence: the CDF is concave on t > 0).
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients for g = 7, n = 9 (published constants).
LANCZOS_G = 7.0
LANCZOS_COEF = [
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
]

SIMPSON_N = 1000  # even number of Simpson intervals
TAIL_WIDTHS = 14.0  # the t integral ends that many 1/sqrt(nu) from the middle
NEWTON_STEPS = 6
SPARK, DUCK = "spark", "duck"


def _f(x: float) -> str:
    """A double literal valid in both dialects."""
    return f"CAST({x!r} AS DOUBLE)"


def lgamma(x: str, d: str = SPARK) -> str:
    """log Gamma(x) for x >= 0.5."""
    if d == DUCK:
        return f"lgamma({x})"
    z = f"(CAST({x} AS DOUBLE) - 1.0D)"
    a = " + ".join([repr(LANCZOS_COEF[0]) + "D"] + [f"{c!r}D / ({z} + {i}.0D)" for i, c in enumerate(LANCZOS_COEF[1:], 1)])
    t = f"({z} + {LANCZOS_G + 0.5!r}D)"
    return f"({0.5 * math.log(2 * math.pi)!r}D + ({z} + 0.5D) * ln({t}) - {t} + ln({a}))"


def log_gamma_half_step(a: str, d: str = SPARK) -> str:
    """log Gamma(a + 1/2) - log Gamma(a); the series is used from a = 20 on, where its error is below 1e-14."""
    a = f"CAST({a} AS DOUBLE)"
    series = f"(0.5 * ln({a}) - 1.0 / (8.0 * {a}) + 1.0 / (192.0 * pow({a}, 3)) - 1.0 / (640.0 * pow({a}, 5)) + 17.0 / (14336.0 * pow({a}, 7)))"
    return f"(CASE WHEN {a} >= 20.0 THEN {series} ELSE {lgamma(f'({a} + 0.5)', d)} - {lgamma(a, d)} END)"


def sum_over(lo: int, hi: int, var: str, body: str, d: str = SPARK) -> str:
    """sum_{var = lo..hi} body, as a higher-order function."""
    if d == DUCK:
        return f"list_sum(list_transform(range({lo}, {hi + 1}), lambda {var}: {body}))"
    return f"aggregate(sequence({lo}, {hi}), CAST(0 AS DOUBLE), (acc_{var}, {var}) -> acc_{var} + {body})"


def iterate(steps: int, var: str, start: str, update: str, d: str = SPARK) -> str:
    """x_{k+1} = update(x_k) ``steps`` times from ``start``; ``var`` names x."""
    if d == DUCK:
        return f"list_reduce(range(1, {steps + 1}), lambda {var}, k_{var}: {update}, {start})"
    return f"aggregate(sequence(1, {steps}), CAST({start} AS DOUBLE), ({var}, k_{var}) -> {update})"


def simpson(lo: str, hi: str, f, var: str = "i", n: int = SIMPSON_N, d: str = SPARK) -> str:
    h = f"((({hi}) - ({lo})) / {n}.0)"
    w = f"(CASE WHEN {var} = 0 OR {var} = {n} THEN 1.0 WHEN {var} % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    return f"({sum_over(0, n, var, f'{w} * {f(f'(({lo}) + {var} * {h})')}', d)} * {h} / 3.0)"


def _sign(d: str) -> str:
    return "sign" if d == DUCK else "signum"


def t_central(t: str, nu: str, d: str = SPARK, var: str = "i") -> str:
    """P(|T| < |t|) for Student t with nu >= 1."""
    nu = f"CAST({nu} AS DOUBLE)"
    theta = f"least(atan(abs({t}) / sqrt({nu})), {TAIL_WIDTHS} / sqrt({nu}))"
    inv_beta = f"exp({log_gamma_half_step(f'{nu} / 2.0', d)} - {_f(0.5 * math.log(math.pi))})"
    log1p = (lambda x: f"ln(1.0 + ({x}))") if d == DUCK else (lambda x: f"log1p({x})")
    at_end = f"(CASE WHEN {nu} = 1.0 THEN 1.0 ELSE 0.0 END)"  # cos = 0: log1p(-1) is NULL
    body = simpson("0.0", theta, lambda u: f"coalesce(exp(({nu} - 1.0) * 0.5 * {log1p(f'-sin({u}) * sin({u})')}), {at_end})", var, d=d)
    return f"(2.0 * {inv_beta} * {body})"


def t_sf2(t: str, nu: str, d: str = SPARK) -> str:
    """Two-sided p-value P(|T| >= |t|)."""
    return f"greatest(least(1.0 - {t_central(t, nu, d)}, 1.0), 0.0)"


def t_cdf(t: str, nu: str, d: str = SPARK, var: str = "i") -> str:
    return f"(0.5 + {_sign(d)}({t}) * {t_central(t, nu, d, var)} / 2.0)"


def t_pdf(t: str, nu: str, d: str = SPARK) -> str:
    nu = f"CAST({nu} AS DOUBLE)"
    logc = f"({log_gamma_half_step(f'{nu} / 2.0', d)} - 0.5 * ln({nu} * pi()))"
    return f"exp({logc} - ({nu} + 1.0) / 2.0 * ln(1.0 + ({t}) * ({t}) / {nu}))"


def t_ppf(p: float, nu: str, d: str = SPARK) -> str:
    """Quantile of Student t for a constant lower-tail probability p in (0.5, 1)."""
    z = NormalDist().inv_cdf(p)
    nu = f"CAST({nu} AS DOUBLE)"
    cf = (f"({_f(z)} + {_f(z ** 3 + z)} / (4.0 * {nu}) + {_f(5 * z ** 5 + 16 * z ** 3 + 3 * z)} / (96.0 * {nu} * {nu})"
          f" + {_f(3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z)} / (384.0 * pow({nu}, 3)))")
    upd = f"tq + ({_f(p)} - {t_cdf('tq', nu, d, 'j')}) / {t_pdf('tq', nu, d)}"
    newton = iterate(NEWTON_STEPS, "tq", cf, upd, d)
    e1 = math.tan(math.pi * (p - 0.5))
    e2 = (2.0 * p - 1.0) / math.sqrt(2.0 * p * (1.0 - p))
    return (f"(CASE WHEN {nu} IS NULL OR {nu} < 1.0 THEN CAST(NULL AS DOUBLE) WHEN {nu} = 1.0 THEN {_f(e1)} "
            f"WHEN {nu} = 2.0 THEN {_f(e2)} ELSE {newton} END)")


def norm_central(z: str, d: str = SPARK) -> str:
    zz = f"least(abs({z}), 9.0)"
    return f"({_f(math.sqrt(2.0 / math.pi))} * {simpson('0.0', zz, lambda x: f'exp(-({x}) * ({x}) / 2.0)', d=d)})"


def norm_sf2(z: str, d: str = SPARK) -> str:
    """Two-sided normal p-value P(|Z| >= |z|)."""
    return f"greatest(1.0 - {norm_central(z, d)}, 0.0)"


def chi2_sf(x: str, k: int, d: str = SPARK) -> str:
    """Upper tail of chi-square with integer k degrees of freedom."""
    s = f"(({x}) / 2.0)"
    if k % 2 == 0:
        terms = ["1.0"] + [f"exp({j} * ln({s}) - {_f(math.lgamma(j + 1))})" for j in range(1, k // 2)]
        tail = f"exp(-{s}) * ({' + '.join(terms)})"
    else:
        terms = [f"exp({j - 0.5} * ln({s}) - {_f(math.lgamma(j + 0.5))})" for j in range(1, (k - 1) // 2 + 1)]
        poisson = f"exp(-{s}) * ({' + '.join(terms)})" if terms else "0.0"
        tail = f"{norm_sf2(f'sqrt({x})', d)} + {poisson}"
    return f"(CASE WHEN ({x}) <= 0 THEN 1.0 ELSE least(greatest({tail}, 0.0), 1.0) END)"


# ---------------------------------------------------------------- Column wrappers

def _txt(x) -> str:
    if isinstance(x, Column):
        raise TypeError("pass a SQL expression string (column name or formula)")
    return str(x)


def col_t_sf2(t, nu) -> Column:
    return F.expr(t_sf2(_txt(t), _txt(nu)))


def col_t_ppf(p: float, nu) -> Column:
    return F.expr(t_ppf(p, _txt(nu)))


def col_t_cdf(t, nu) -> Column:
    return F.expr(t_cdf(_txt(t), _txt(nu)))


def col_norm_sf2(z) -> Column:
    return F.expr(norm_sf2(_txt(z)))


def col_chi2_sf(x, k: int) -> Column:
    return F.expr(chi2_sf(_txt(x), k))


def col_lgamma(x) -> Column:
    return F.expr(lgamma(_txt(x)))
