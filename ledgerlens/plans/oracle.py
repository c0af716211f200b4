"""DuckDB oracle SQL for the registered queries.

Each entry is plain SQL over the driver's views, with the fixture views and
the shared building blocks below prepended as CTEs.  Column names equal the
Spark results; every computed column is cast explicitly on both sides.
"""

from __future__ import annotations

from ledgerlens.plans import rules as R
from ledgerlens.sources.fixtures import ORACLE_PRODUCT_IDS, duckdb_text

PIDS = ORACLE_PRODUCT_IDS
FEATURE_ORDER = R.BASE_FEATURES + [f"has_{p}" for p in PIDS]

# Shared CTE bodies (names -> SQL).  Dependencies are resolved by `sql()`.
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, deps: tuple[str, ...], body: str) -> None:
    BLOCKS[name] = (deps, body)


def d(x) -> str:
    """A DOUBLE literal in both engines."""
    return f"{float(x)!r}e0"


def _flags() -> str:
    return ",\n       ".join(
        f"cast(coalesce(max(case when o.prod_id = {p} then 1 else 0 end), 0) as int) as has_{p}" for p in PIDS)


block("fx_features", ("fx_customers", "fx_ownership"), f"""
select c.cust_id, c.age_bucket, c.revenue, c.credit_score,
       {_flags()}
from fx_customers c left join fx_ownership o on c.cust_id = o.cust_id
group by c.cust_id, c.age_bucket, c.revenue, c.credit_score""")

block("fx_moments", ("fx_features",), """
select cast(sr as double) / nr as rev_mean,
       case when cast(srr as double) / nr - (cast(sr as double) / nr) * (cast(sr as double) / nr) > 0
            then sqrt(cast(srr as double) / nr - (cast(sr as double) / nr) * (cast(sr as double) / nr)) else 1e0 end as rev_std,
       cast(sc as double) / nc as cs_mean,
       case when cast(scc as double) / nc - (cast(sc as double) / nc) * (cast(sc as double) / nc) > 0
            then sqrt(cast(scc as double) / nc - (cast(sc as double) / nc) * (cast(sc as double) / nc)) else 1e0 end as cs_std
from (select count(revenue) as nr, count(credit_score) as nc, sum(cast(revenue as hugeint)) as sr,
             sum(cast(revenue as hugeint) * cast(revenue as hugeint)) as srr,
             sum(cast(credit_score as hugeint)) as sc,
             sum(cast(credit_score as hugeint) * cast(credit_score as hugeint)) as scc
      from fx_features) t""")

block("fx_age_labels", ("fx_features",), """
select age_bucket, cast(dense_rank() over (order by age_bucket) - 1 as int) as age_bucket_encoded
from (select distinct age_bucket from fx_features where age_bucket is not null) t""")

_has_cols = ", ".join(f"f.has_{p}" for p in PIDS)
block("fx_encoded", ("fx_features", "fx_moments", "fx_age_labels"), f"""
select f.cust_id, {_has_cols}, l.age_bucket_encoded,
       (f.revenue - m.rev_mean) / m.rev_std as revenue,
       (f.credit_score - m.cs_mean) / m.cs_std as credit_score
from fx_features f cross join fx_moments m left join fx_age_labels l on f.age_bucket = l.age_bucket""")

_wcols = ",\n       ".join(
    f"max(case when c.feature = '{f}' then c.coefficient end) as w_{f}" for f in FEATURE_ORDER)
block("fx_model", ("fx_coefficients", "fx_intercepts"), f"""
select i.prod_id, i.intercept,
       {_wcols}
from fx_intercepts i left join fx_coefficients c on i.prod_id = c.prod_id
group by i.prod_id, i.intercept""")


def _logit() -> str:
    terms = " + ".join(f"coalesce(m.w_{f}, 0e0) * cast(e.{f} as double)" for f in FEATURE_ORDER)
    return f"m.intercept + {terms}"


_owned_case = "case p.prod_id " + " ".join(f"when {p} then e.has_{p}" for p in PIDS) + " end"
block("fx_scores_all", ("fx_encoded", "fx_model", "fx_products"), f"""
select e.cust_id, cast(p.prod_id as int) as prod_id, cast({_owned_case} as int) as owned,
       coalesce(round(1e0 / (1e0 + exp(-({_logit()}))), 6), {d(R.FALLBACK_SCORE)}) as score
from fx_encoded e cross join fx_products p left join fx_model m on p.prod_id = m.prod_id""")

block("fx_scores", ("fx_scores_all",), """
select cust_id, prod_id, score from fx_scores_all where owned = 0""")

block("fx_topk3", ("fx_scores", "fx_products"), """
select * from (
  select s.cust_id, s.prod_id, p.name, p.category, p.price, s.score,
         cast(row_number() over (partition by s.cust_id order by s.score desc, s.prod_id) as int) as rank
  from fx_scores s join fx_products p on s.prod_id = p.prod_id) t
where rank <= 3""")


def _scenario_roles_values() -> str:
    rows = []
    for s, (prim, cross) in R.SCENARIOS.items():
        for p in PIDS:
            role = "primary" if p in prim else "cross_sell" if p in cross else "other"
            rows.append(f"('{s}', {p}, '{role}')")
    return ", ".join(rows)


block("fx_roles", (), f"""
select * from (values {_scenario_roles_values()}) as t(scenario, prod_id, role)""")


def scenario_block(name: str, source: str, k: int, keys: str, need: str = "0e0", ltv: str = "8e1",
                   deps: tuple[str, ...] = ()) -> None:
    """Quota pick in SQL (W2) for ``source`` rows keyed by ``keys`` (+ scenario)."""
    b = R.MORTGAGE_BONUS
    mult = " ".join(f"when r.role = '{role}' then {d(m)}" for role, m in R.ROLE_MULTIPLIER.items())
    block(name, deps + ("fx_roles",), f"""
select * from (
  select *, cast(row_number() over (partition by {keys}, scenario
                 order by case when scenario = '{R.HOLISTIC}' then 0
                               when role = 'primary' then 0 when role = 'cross_sell' then 1 else 2 end,
                          score desc, prod_id) as int) as rank
  from (
    select *, cast(row_number() over (partition by {keys}, scenario, role order by score desc, prod_id) as int) as role_rank,
           least(sum(case when role = 'primary' then 1 else 0 end) over (partition by {keys}, scenario),
                 greatest(1, {k // 2})) as np_,
           sum(case when role = 'cross_sell' then 1 else 0 end) over (partition by {keys}, scenario) as ncross_
    from (
      select s.* exclude (score), r.scenario, r.role, s.score as base_score,
             least(1e0, greatest(0e0,
               case when r.scenario = '{R.HOLISTIC}' then s.score
                    else s.score * case {mult} else 1e0 end end
               * case when r.scenario = '{R.REAL_ESTATE}' and s.prod_id = {b['first_home_prod']} and {ltv} <= {d(b['first_home_max_ltv'])}
                      then {d(b['first_home_factor'])}
                      when r.scenario = '{R.REAL_ESTATE}' and s.prod_id = {b['investor_prod']} and {need} > {d(b['investor_min_need'])}
                      then {d(b['investor_factor'])}
                      else 1e0 end)) as score
      from {source} s join fx_roles r on s.prod_id = r.prod_id) a0
  ) a1
  where scenario = '{R.HOLISTIC}'
     or (role = 'primary' and role_rank <= np_)
     or (role = 'cross_sell' and role_rank <= least(ncross_, {k} - np_))
     or (role = 'other' and role_rank <= {k} - np_ - least(ncross_, {k} - np_))
) a2 where rank <= {k}""")


def resolve(*names: str) -> list[str]:
    """Topologically ordered list of fixture views and blocks needed by ``names``."""
    from ledgerlens.sources.fixtures import VIEW_SQL
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        if n in BLOCKS:
            for d in BLOCKS[n][0]:
                visit(d)
        elif n not in VIEW_SQL:
            raise KeyError(n)
        order.append(n)

    for n in names:
        visit(n)
    return order


def sql(body: str, *needs: str) -> str:
    """``WITH`` all needed views/blocks, then ``body``."""
    from ledgerlens.sources.fixtures import VIEW_SQL
    parts = []
    for n in resolve(*needs):
        text = duckdb_text(n) if n in VIEW_SQL else BLOCKS[n][1]
        parts.append(f"{n} as ({text}\n)")
    if not parts:
        return body
    return "with " + ",\n".join(parts) + "\n" + body
