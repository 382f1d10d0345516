"""Registered queries (one per operator / report of the inventory).

Naming: ``<id>_<what>``, e.g. ``m14_segmented_mae``.  Each reads the
bundled tables through the views of ``vantage.sources.testdata`` (or
data Spark derives from them), so its work grows with the input.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.plans import duck as D
from vantage.plans import reports as R
from vantage.plans.catalog import register
from vantage.sources import testdata as V


# ---------------------------------------------------------------- flagship

def _m14_sql() -> str:
    q = D.CTE()
    D.pairs_ctes(q)
    q.add("j", """
SELECT u.dataset, u.mae AS mae_unassisted, a.mae AS mae_assisted, a.mae < u.mae AS llm_better
FROM pairs u JOIN pairs a ON u.dataset = a.dataset
WHERE u.model = 'unassisted' AND a.model = 'assisted' AND u.r2 > 0.2 AND a.r2 > 0.2""")
    q.add("g", """
SELECT llm_better, count(*) AS n,
       avg(mae_unassisted) AS ma, stddev_samp(mae_unassisted) AS sa,
       avg(mae_assisted) AS mb, stddev_samp(mae_assisted) AS sb,
       avg(mae_unassisted - mae_assisted) AS md, stddev_samp(mae_unassisted - mae_assisted) AS sd
FROM j GROUP BY llm_better""")
    qq = D.t_ppf(0.975, "n - 1")
    q.add("g2", f"SELECT *, CASE WHEN n > 1 THEN {qq} END AS q FROM g")
    t, _ = D.paired_ttest_cols("n", "md", "sd")
    q.add("g3", f"""
SELECT llm_better, n, ma, mb, (CASE WHEN n > 1 THEN sa END) / sqrt(n) * q AS ci_a,
       (CASE WHEN n > 1 THEN sb END) / sqrt(n) * q AS ci_b, {t} AS t_stat FROM g2""")
    p = f"(CASE WHEN t_stat IS NOT NULL THEN {D.t_sf2('t_stat', 'n - 1')} END)"
    return q.sql(f"""
SELECT llm_better, n, {D.r6('ma')} AS mean_unassisted, {D.r6('ci_a')} AS ci_unassisted,
       {D.r6('mb')} AS mean_assisted, {D.r6('ci_b')} AS ci_assisted,
       {D.r6('t_stat')} AS t_stat, {D.r6(p)} AS p_value
FROM g3""")


@register("m14_segmented_mae", _m14_sql)
def m14_segmented_mae(spark, sf_dir):
    """Paired MAE (R2 > 0.2 on both sides), better vs not-better segment."""
    return R.segmented_mae(R.regression_pairs_wide(spark, sf_dir))


def _v4_sql() -> str:
    q = D.CTE()
    D.pairs_ctes(q)
    return q.sql(f"""SELECT dataset, model, n, {D.r6('r2')} AS r2, {D.r6('rmse')} AS rmse, {D.r6('mae')} AS mae
FROM pairs""")


@register("v4_regression_pairs", _v4_sql)
def v4_regression_pairs(spark, sf_dir):
    """V4 / K1 + K10: test-set metrics of the two linear models per dataset."""
    return R.regression_pairs(spark, sf_dir)
