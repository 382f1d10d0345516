"""DuckDB twins of the Spark plans, used as the correctness oracle.

Each helper returns SQL text for DuckDB over the pre-registered tables
(``lineitem``, ``events``, ...).  The arithmetic mirrors the Spark
operators where the result defines it (same response equations, same
split hash); the distribution tails and the uncentred normal equations are
formulas of their own, so that a fault of the Spark side shows.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from vantage.functions import linalg as LA
from vantage.sources.testdata import EQUATIONS, EMB_MODELS, EMB_WIDTH


class CTE:
    """Ordered list of named sub-queries rendered as one WITH statement."""

    def __init__(self):
        self.parts: list[tuple[str, str]] = []

    def add(self, name: str, sql: str) -> str:
        self.parts.append((name, sql))
        return name

    def sql(self, final: str) -> str:
        if not self.parts:
            return final
        body = ",\n".join(f"{n} AS (\n{s}\n)" for n, s in self.parts)
        return f"WITH {body}\n{final}"


def r6(expr: str, digits: int = 6) -> str:
    """Round like the Spark side; ``+ 0.0`` turns -0.0 into 0.0."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ({a}) / ({b}) END)"


# ---------------------------------------------------------------- views

def equation_sql(key: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{eq}'" for i, eq in enumerate(EQUATIONS))
    return f"(CASE ({key}) % 4 {whens} END)"


def samples_sql() -> str:
    eq = equation_sql("l_suppkey")
    return f"""
SELECT dataset, equation, ok, ln, pk, row_key,
       x1r + CASE WHEN cat1 = 'B' THEN 50.0 ELSE 0.0 END AS x1,
       x2r + CASE WHEN cat2 = 'Y' THEN 50.0 ELSE 0.0 END AS x2,
       CASE WHEN equation = 'linear' THEN 3 * x1r + 2 * x2r + noise
            WHEN equation = 'quadratic' THEN x1r * x1r - 2 * x2r + noise
            WHEN equation = 'cubic' THEN x1r * x1r * x1r - x2r * x2r + noise
            ELSE exp(0.1 * x1r) - exp(0.1 * x2r) + noise END AS x3,
       cat1, cat2
FROM (
  SELECT 'data_' || CAST(l_suppkey AS VARCHAR) || '_' || {eq} AS dataset, {eq} AS equation,
         l_orderkey AS ok, l_linenumber AS ln, l_partkey AS pk,
         concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key,
         (l_quantity - 25.5::DOUBLE) / 2.45::DOUBLE AS x1r,
         (l_discount - 0.05::DOUBLE) * 200.0::DOUBLE AS x2r,
         (l_tax - 0.04::DOUBLE) * 250.0::DOUBLE AS noise,
         CASE WHEN l_linestatus = 'O' THEN 'B' ELSE 'A' END AS cat1,
         CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'X' END AS cat2
  FROM lineitem) s"""


def split_sql(key: str, test_share: float = 0.3, seed: int = 42) -> str:
    thr = format(int(test_share * 2 ** 32), "08x")
    return f"(substr(md5(concat_ws('|', CAST({key} AS VARCHAR), '{seed}')), 1, 8) < '{thr}')"


def scores_sql() -> str:
    eq = equation_sql("user_id")
    k = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
    return f"""
SELECT 'data_' || CAST(user_id AS VARCHAR) || '_' || {eq} AS dataset, event_type AS model,
       value / 500.0::DOUBLE AS distance_correlation, {k} / 100.0::DOUBLE AS cosine_similarity,
       0.5::DOUBLE + {k} / 200.0::DOUBLE AS auc, event_id
FROM events"""


def meta_sql() -> str:
    eq = equation_sql("l_suppkey")
    return f"""
SELECT dataset, n_rows, CAST(3 + ncat AS INTEGER) AS n_cols, CAST(ncat AS INTEGER) AS num_categorical_vars,
       n_rows / (3 + ncat) AS subject_variable_ratio
FROM (
  SELECT dataset, n_rows, 2 + CAST(floor(n_parts / 25) AS BIGINT) AS ncat FROM (
    SELECT 'data_' || CAST(l_suppkey AS VARCHAR) || '_' || {eq} AS dataset,
           count(*) AS n_rows, count(DISTINCT l_partkey) AS n_parts
    FROM lineitem GROUP BY 1) a) b"""


def emb_long_sql() -> str:
    parts = []
    for i, m in enumerate(EMB_MODELS):
        parts.append(
            f"SELECT 'emb_' || CAST(label AS VARCHAR) AS dataset, '{m}' AS model, vec_id AS row_id, "
            f"CAST(embedding[{i * EMB_WIDTH + 1}:{(i + 1) * EMB_WIDTH}] AS DOUBLE[]) AS embedding FROM embeddings")
    return "\nUNION ALL\n".join(parts)


def emb_raw_sql() -> str:
    return ("SELECT 'emb_' || CAST(label AS VARCHAR) AS dataset, vec_id AS row_id, "
            "CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS x2, "
            "CAST(embedding[3] AS DOUBLE) AS x3 FROM embeddings")


# ---------------------------------------------------------------- L1 (DuckDB dialect)

# Own formulas, not those of functions/dist.py: the t density integrated in x = sinh(s),
# the normal and chi-square distributions by their power series.

_T_STEPS, _SERIES = 2000, 400


def t_pdf(x: str, nu: str) -> str:
    nu = f"({nu})::DOUBLE"
    return (f"exp(lgamma(({nu} + 1.0) / 2.0) - lgamma({nu} / 2.0) - 0.5 * ln({nu} * pi()) "
            f"- ({nu} + 1.0) / 2.0 * ln(1.0 + ({x}) * ({x}) / {nu}))")


def t_central(t: str, nu: str, var: str = "i") -> str:
    h = f"(asinh(least(abs({t}), 1e9)) / {_T_STEPS}.0)"
    s = f"({var} * {h})"
    w = f"(CASE WHEN {var} = 0 OR {var} = {_T_STEPS} THEN 1.0 WHEN {var} % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    return (f"(2.0 * {h} / 3.0 * list_sum(list_transform(range(0, {_T_STEPS + 1}), "
            f"lambda {var}: {w} * cosh({s}) * {t_pdf(f'sinh({s})', nu)})))")


def t_sf2(t: str, nu: str) -> str:
    return f"greatest(1.0 - {t_central(t, nu)}, 0.0)"


def t_ppf(p: float, nu: str) -> str:
    """Newton steps from the normal quantile: the CDF is concave to the right, so they rise to the quantile."""
    z = NormalDist().inv_cdf(p)
    step = f"x + ({2 * p - 1!r} - {t_central('x', nu, 'j')}) / (2.0 * {t_pdf('x', nu)})"
    return f"(CASE WHEN ({nu}) >= 1 THEN list_reduce(range(0, 14), lambda x, k: {step}, {z!r}::DOUBLE) END)"


def norm_sf2(z: str) -> str:
    """1 - 2 phi(z) sum z^(2n+1) / (2n+1)!!; all terms are positive."""
    zz = f"greatest(least(abs({z}), 9.0), 1e-300)"
    term = f"exp((2 * term_no + 1) * ln({zz}) - lgamma(term_no + 1.5) - (term_no + 1) * ln(2.0) + 0.5 * ln(pi()) - {zz} * {zz} / 2.0)"
    return f"greatest(1.0 - sqrt(2.0 / pi()) * list_sum(list_transform(range(0, {_SERIES}), lambda term_no: {term})), 0.0)"


def chi2_sf(x: str, k: int) -> str:
    """1 - sum e^-s s^(a+n) / Gamma(a+n+1), s = x/2, a = k/2."""
    s, a = f"(({x}) / 2.0)", k / 2
    term = f"exp(-{s} + ({a} + term_no) * ln({s}) - lgamma({a} + term_no + 1.0))"
    body = f"list_sum(list_transform(range(0, {_SERIES} + CAST(least({s}, 1e5) AS BIGINT) * 2), lambda term_no: {term}))"
    return f"(CASE WHEN ({x}) <= 0 THEN 1.0 ELSE greatest(least(1.0 - {body}, 1.0), 0.0) END)"


# ---------------------------------------------------------------- OLS

def moments_sql(src: str, by: Sequence[str], y: str, xs: Sequence[str], where: str = "TRUE") -> str:
    cols = ["1.0"] + [f"({x})" for x in xs]
    p = len(cols)
    aggs = [f"count(CASE WHEN {where} THEN 1 END) AS n"]
    for i in range(p):
        for j in range(i, p):
            aggs.append(f"sum(CASE WHEN {where} THEN {cols[i]} * {cols[j]} END) AS s_{i}_{j}")
        aggs.append(f"sum(CASE WHEN {where} THEN {cols[i]} * ({y}) END) AS sy_{i}")
    aggs.append(f"sum(CASE WHEN {where} THEN ({y}) * ({y}) END) AS syy")
    return f"SELECT {', '.join(by)}, {', '.join(aggs)} FROM {src} GROUP BY {', '.join(by)}"


def solve_sql(q: CTE, mom: str, by: Sequence[str], idx: Sequence[int], names: Sequence[str],
              prefix: str, keep: Sequence[str] = (), tag: str = "g") -> str:
    """Gauss-Jordan steps as a CTE chain; returns the final CTE name."""
    p = len(idx)
    kb = ", ".join(list(by) + ["n"] + list(keep))
    cur = q.add(f"{tag}0", f"SELECT {kb}, {', '.join(LA.normal_equation_inputs(idx))} FROM {mom}")
    for k in range(p):
        cur = q.add(f"{tag}{k + 1}", f"SELECT {kb}, {', '.join(LA.gauss_jordan_step(k, p, 'duck'))} FROM {cur}")
    labels = ["intercept"] + list(names)
    outs = ", ".join(f"r_{i} AS {prefix}{labels[i]}" for i in range(p))
    return q.add(f"{tag}_coef", f"SELECT {kb}, {outs} FROM {cur}")


# ---------------------------------------------------------------- pairs (V4)

UNASSISTED = ["x1", "cat1_B"]
ASSISTED = ["x1", "cat1_B", "x2", "cat2_Y"]


def pairs_ctes(q: CTE) -> str:
    """V4 in DuckDB: per (dataset, model) test-set n, r2, rmse, mae."""
    q.add("samples", samples_sql())
    q.add("sx", f"""SELECT *, CASE WHEN cat1 = 'B' THEN 1.0 ELSE 0.0 END AS cat1_B,
       CASE WHEN cat2 = 'Y' THEN 1.0 ELSE 0.0 END AS cat2_Y, {split_sql('row_key')} AS is_test FROM samples""")
    q.add("mom", moments_sql("sx", ["dataset"], "x3", ASSISTED, "NOT is_test"))
    ca = solve_sql(q, "mom", ["dataset"], [0, 1, 2, 3, 4], ASSISTED, "a_", tag="ga")
    cu = solve_sql(q, "mom", ["dataset"], [0, 1, 2], UNASSISTED, "u_", tag="gu")
    q.add("pred", f"""
SELECT t.dataset, t.x3,
       u.u_intercept + u.u_x1 * t.x1 + u.u_cat1_B * t.cat1_B AS yhat_u,
       a.a_intercept + a.a_x1 * t.x1 + a.a_cat1_B * t.cat1_B + a.a_x2 * t.x2 + a.a_cat2_Y * t.cat2_Y AS yhat_a
FROM sx t JOIN {cu} u ON t.dataset = u.dataset JOIN {ca} a ON t.dataset = a.dataset
WHERE t.is_test""")
    q.add("met", """
SELECT dataset, count(*) AS n, var_pop(x3) * count(*) AS sst,
       sum((x3 - yhat_u) * (x3 - yhat_u)) AS sse_u, avg(abs(x3 - yhat_u)) AS mae_u,
       sum((x3 - yhat_a) * (x3 - yhat_a)) AS sse_a, avg(abs(x3 - yhat_a)) AS mae_a
FROM pred GROUP BY dataset""")
    return q.add("pairs", f"""
SELECT dataset, 'unassisted' AS model, n, 1.0 - {div('sse_u', 'sst')} AS r2, sqrt(sse_u / n) AS rmse, mae_u AS mae FROM met
UNION ALL
SELECT dataset, 'assisted' AS model, n, 1.0 - {div('sse_a', 'sst')} AS r2, sqrt(sse_a / n) AS rmse, mae_a AS mae FROM met""")


def ci_cols(n: str, mean: str, sd: str, conf: float, p: str) -> list[str]:
    sd_ = f"(CASE WHEN {n} > 1 THEN {sd} END)"
    sem = f"({sd_} / sqrt({n}))"
    half = f"(CASE WHEN {n} > 1 THEN {sem} * {t_ppf((1 + conf) / 2, f'{n} - 1')} END)"
    return [f"{mean} AS {p}mean", f"{sd_} AS {p}std", f"{sem} AS {p}sem", f"{half} AS {p}ci"]


def paired_ttest_cols(n: str, mean_d: str, sd_d: str) -> tuple[str, str]:
    t = f"(CASE WHEN {n} > 1 THEN {div(mean_d, f'{sd_d} / sqrt({n})')} END)"
    p = f"(CASE WHEN {t} IS NOT NULL THEN {t_sf2(t, f'{n} - 1')} END)"
    return t, p


# ---------------------------------------------------------------- tests (DuckDB twins)

def avg_rank_sql(by: str, v: str) -> str:
    """Average rank with ties (window text); ``by`` is a PARTITION list."""
    part = f"PARTITION BY {by} " if by else ""
    return (f"(rank() OVER ({part}ORDER BY {v}) + "
            f"(count(*) OVER (PARTITION BY {by + ', ' if by else ''}{v}) - 1) / 2.0)")


def exact_signed_rank_cdf(n: str, w: str) -> str:
    """P(W <= w) for the signed-rank statistic (DP over rank sums)."""
    size = f"CAST({n} * ({n} + 1) / 2 + 1 AS BIGINT)"
    init = f"list_transform(range(0, {size}), lambda s: CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    counts = (f"list_reduce(range(1, {n} + 1), lambda acc, k: list_transform(acc, lambda c, s: "
              f"c + CASE WHEN s - 1 >= k THEN acc[s - k] ELSE 0.0::DOUBLE END), {init})")
    return f"(list_sum(({counts})[1:CAST(floor({w}) AS BIGINT) + 1]) / pow(2.0, {n}))"


def welch_cols(n1: str, m1: str, v1: str, n2: str, m2: str, v2: str) -> tuple[str, str]:
    a, b = f"(({v1}) / ({n1}))", f"(({v2}) / ({n2}))"
    ok = f"({n1} > 1 AND {n2} > 1)"
    t = f"(CASE WHEN {ok} THEN {div(f'{m1} - {m2}', f'sqrt({a} + {b})')} END)"
    dof = f"(CASE WHEN {ok} THEN {div(f'({a} + {b}) * ({a} + {b})', f'{a} * {a} / ({n1} - 1) + {b} * {b} / ({n2} - 1)')} END)"
    return t, dof
