"""SQL text of bias-corrected accelerated intervals: the normal distribution by its series, its inverse by Newton steps."""

from __future__ import annotations

from statistics import NormalDist

from evalpanel.functions.hashing import poisson_steps
from evalpanel.plans.registry import D

TERMS, STEPS = 90, 14


def odd_products() -> str:
    """CTE text: 1, 1*3, 1*3*5, ... as a list named ``w`` in table ``odd``."""
    products, now = [], 1.0
    for k in range(TERMS):
        now *= 2 * k + 1
        products.append(repr(now))
    return f"odd AS (SELECT [{', '.join(f'CAST({p} AS DOUBLE)' for p in products)}] AS w)"


def normal_cdf(x: str) -> str:
    """0.5 + density(x) * (x + x^3 / 3 + x^5 / 15 + ...); needs ``odd`` in scope."""
    return f"(0.5 + exp(-0.5*({x})*({x}))/sqrt(2*pi()) * list_sum(list_transform(range({TERMS}), lambda k: power({x}, 2*k+1)/w[k+1])))"


def poisson_weights_sql(seed_u: str, reps: int) -> str:
    """CTE ``pw`` (rep, unit, w) from the units in ``un``; ``seed_u`` is the SQL of the uniform number of (unit, rep)."""
    steps = "+".join(f"CASE WHEN u>=CAST({s!r} AS DOUBLE) THEN 1 ELSE 0 END" for s in poisson_steps())
    return f"pw AS (SELECT rep, unit, {steps} AS w FROM (SELECT rep, unit, {seed_u} AS u FROM un, range(1,{reps + 1}) t(rep)))"


def acceleration(keys: str) -> str:
    """CTE ``ac`` (keys, accel) from leave-one-out values ``jk`` (keys, j)."""
    named = ", ".join(f"a.{k}" for k in keys.split(", "))
    on = " AND ".join(f"a.{k}=b.{k}" for k in keys.split(", "))
    return f"""jm AS (SELECT {keys}, avg(j) AS m FROM jk GROUP BY ALL),
 ac AS (SELECT {named}, CASE WHEN sum(power(m-j,2))>1e-30 THEN sum(power(m-j,3))/(6*power(sum(power(m-j,2)),1.5)) END AS accel FROM jk a JOIN jm b ON {on} GROUP BY ALL)"""


def bca_ctes(keys: str, alpha: float = 0.05, fallback: str = "false") -> str:
    """CTEs from ``th`` (keys, rep, theta, NULL where undefined), ``pt`` (keys, theta_hat) and ``ac`` (keys, accel) to ``bc`` (keys, ci_lo, ci_hi, is_bca)."""
    ks = keys.split(", ")
    on = lambda a, b: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in ks)
    named = lambda a: ", ".join(f"{a}.{k}" for k in ks)
    za = [repr(NormalDist().inv_cdf(p)) for p in (alpha / 2, 1 - alpha / 2)]
    newton = ["n0 AS (SELECT *, CAST(0 AS DOUBLE) AS z FROM sb, odd)"]
    for i in range(STEPS):
        newton.append(f"n{i + 1} AS (SELECT * EXCLUDE (z), CASE WHEN below>0 AND below<1 THEN z - ({normal_cdf('z')} - below)*sqrt(2*pi())*exp(0.5*z*z) END AS z FROM n{i})")
    shifted = lambda z: f"(z + (z+({z}))/(1-accel*(z+({z}))))"
    pick = lambda p: f"(v[CAST(floor((n-1)*({p})) AS INT)+1] + (v[least(CAST(floor((n-1)*({p})) AS INT)+2, n)] - v[CAST(floor((n-1)*({p})) AS INT)+1])*((n-1)*({p})-floor((n-1)*({p}))))"
    return f"""{odd_products()},
 sb AS (SELECT {named('t')}, any_value(p.theta_hat) AS theta_hat, any_value(c.accel) AS accel, count(*) AS reps, count(t.theta) AS n, count(DISTINCT t.theta) AS levels,
  avg(CASE WHEN t.theta<p.theta_hat THEN 1.0 ELSE 0.0 END) AS below, list_sort(list(t.theta) FILTER (t.theta IS NOT NULL)) AS v
  FROM th t JOIN pt p ON {on('t', 'p')} JOIN ac c ON {on('t', 'c')} GROUP BY ALL),
 {', '.join(newton)},
 qs AS (SELECT *, n=reps AND levels>=50 AND below>0 AND below<1 AND accel IS NOT NULL AND NOT ({fallback}) AS is_bca, {shifted(za[0])} AS x0, {shifted(za[1])} AS x1 FROM n{STEPS}),
 ps AS (SELECT *, CASE WHEN is_bca THEN {normal_cdf('x0')} ELSE {alpha / 2} END AS p0, CASE WHEN is_bca THEN {normal_cdf('x1')} ELSE {1 - alpha / 2} END AS p1 FROM qs),
 bc AS (SELECT {keys}, theta_hat, accel, reps, n, v, is_bca, {pick('p0')} AS ci_lo, {pick('p1')} AS ci_hi FROM ps WHERE n>0)"""


def bca_select(keys: str) -> str:
    """The columns of ``bca_interval`` (without the standard error) from ``bc``."""
    low = "list_avg(list_transform(v, lambda x: CASE WHEN x<=0 THEN 1.0 ELSE 0.0 END))"
    high = "list_avg(list_transform(v, lambda x: CASE WHEN x>=0 THEN 1.0 ELSE 0.0 END))"
    return f"""SELECT {keys}, {D('theta_hat', 'theta_hat')}, {D('ci_lo', 'ci_lo')}, {D('ci_hi', 'ci_hi')}, CASE WHEN is_bca THEN 'BCa' ELSE 'percentile (BCa fallback)' END AS ci_method,
 {D(f'greatest(2*least({low}, {high}), 1.0/(reps+1))', 'p_two_sided')}, {D('1-n/reps', 'undefined_share')} FROM bc"""
