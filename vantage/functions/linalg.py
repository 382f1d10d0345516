"""Small dense linear algebra on one row per group, as SQL expression text.

A p x p system ``A x = r`` stored as columns ``a_i_j`` and ``r_i`` (plus
the original diagonal ``d_i``) is solved by Gauss-Jordan elimination,
one projection per pivot.  The text is valid Spark SQL and DuckDB SQL
(``d`` picks the dialect), so the oracle runs the same arithmetic.
"""

from __future__ import annotations

PIVOT_TOL = 1e-9


def _div(a: str, b: str, d: str) -> str:
    return f"try_divide({a}, {b})" if d == "spark" else f"({a}) / ({b})"


def gauss_jordan_step(k: int, p: int, d: str = "spark") -> list[str]:
    """Expressions (``... AS name``) for pivot ``k``.

    A pivot whose residual is at most ``PIVOT_TOL`` times its original
    diagonal marks a column collinear with earlier ones; its coefficient
    becomes 0, which gives the same fitted values as the minimum-norm
    least-squares solution.
    """
    ok = f"(abs(a_{k}_{k}) > {PIVOT_TOL!r} * abs(d_{k}))"
    out = []
    for i in range(p):
        for j in range(p):
            if i == k:
                v = f"CASE WHEN {ok} THEN {_div(f'a_{i}_{j}', f'a_{k}_{k}', d)} ELSE {1.0 if j == k else 0.0} END"
            else:
                other = "0.0" if j == k else f"a_{i}_{j}"
                v = (f"CASE WHEN {ok} THEN a_{i}_{j} - a_{i}_{k} * {_div(f'a_{k}_{j}', f'a_{k}_{k}', d)} "
                     f"ELSE {other} END")
            out.append(f"CAST({v} AS DOUBLE) AS a_{i}_{j}")
    for i in range(p):
        if i == k:
            v = f"CASE WHEN {ok} THEN {_div(f'r_{i}', f'a_{k}_{k}', d)} ELSE 0.0 END"
        else:
            v = f"CASE WHEN {ok} THEN r_{i} - a_{i}_{k} * {_div(f'r_{k}', f'a_{k}_{k}', d)} ELSE r_{i} END"
        out.append(f"CAST({v} AS DOUBLE) AS r_{i}")
    out += [f"d_{i}" for i in range(p)]
    return out


def normal_equation_inputs(idx, p_sy: str = "sy") -> list[str]:
    """Select list that loads sub-design ``idx`` of the moment columns
    ``s_i_j`` (i <= j) / ``sy_i`` into ``a_i_j, r_i, d_i``."""
    p = len(idx)

    def s(i, j):
        a, b = sorted((idx[i], idx[j]))
        return f"s_{a}_{b}"

    return ([f"CAST({s(i, j)} AS DOUBLE) AS a_{i}_{j}" for i in range(p) for j in range(p)]
            + [f"CAST({p_sy}_{idx[i]} AS DOUBLE) AS r_{i}" for i in range(p)]
            + [f"CAST({s(i, i)} AS DOUBLE) AS d_{i}" for i in range(p)])
