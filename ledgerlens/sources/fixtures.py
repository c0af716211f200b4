"""Domain views over the driver's TPC-H-like tables.

The driver tables carry no banking domain, so every registered query reads the
views below.  One SQL text per view serves both engines: Spark gets the parquet
DataFrames bound to the ``{table}`` placeholders, the DuckDB oracle gets the
pre-registered view names.  Literals are written with ``e`` exponents so both
engines type them as DOUBLE.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.plans.session import broadcast_bounded

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")

VIEW_SQL: dict[str, str] = {
    "fx_customers": """
select c_custkey as cust_id,
       case when c_custkey % 29 <> 3 then concat('first', cast(c_custkey % 97 as string)) end as first_name,
       case when c_custkey % 29 <> 3 then concat('last', cast(c_custkey % 89 as string)) end as last_name,
       n_name as location,
       case when c_custkey % 43 <> 5 then cast(floor(2e4 + (c_acctbal + 1e3) * 2e1) as bigint) end as revenue,
       case when c_custkey % 53 <> 7 then cast(300 + (c_custkey * 7919) % 551 as int) end as credit_score,
       case when c_custkey % 47 = 6 then null else case c_mktsegment when 'AUTOMOBILE' then '18-24' when 'BUILDING' then '25-39'
            when 'FURNITURE' then '40-59' else '60+' end end as age_bucket,
       cast('1935-01-01' as date) + cast((c_custkey * 6247) % 27500 as int) as birth_date
from {customer} join {nation} on c_nationkey = n_nationkey""",
    "fx_products": """
select distinct 100 + cast(substr(p_brand, 7) as int) as prod_id,
       case p_brand when 'Brand#12' then 'Brand#11 Plus' else p_brand end as name,
       case cast(substr(p_brand, 7) as int) when 1 then 'account' when 2 then 'depot' when 3 then 'card'
            when 4 then 'insurance' when 5 then 'depot' when 6 then 'insurance' else 'mortgage' end as category,
       case cast(substr(p_brand, 7) as int) when 2 then 'medium' when 5 then 'high' when 7 then 'medium'
            when 8 then 'medium' when 9 then 'high' else 'low' end as risk_class,
       25e0 * cast(substr(p_brand, 7) as int) + 1e1 as price,
       case cast(substr(p_brand, 7) as int) when 7 then 385e-2 when 8 then 425e-2 when 9 then 495e-2
            when 10 then 345e-2 end as interest_rate,
       case when cast(substr(p_brand, 7) as int) % 7 <> 0 then concat('Short text, ', p_brand) end as short_desc,
       case when cast(substr(p_brand, 7) as int) % 3 <> 0 then concat('A longer text about "', p_brand, '".') end as long_desc
from {part}""",
    "fx_ownership": """
select cust_id, prod_id, since_date,
       case when prod_id >= 107 then 1e5 + 1e3 * ((cust_id * 131 + prod_id) % 700) end as deal_volume,
       case when prod_id >= 107 then case (cust_id + prod_id) % 2 when 0 then 'annuity loan' else 'bullet loan' end end as credit_type,
       case when prod_id >= 107 then (200 + (cust_id * 17 + prod_id) % 600) / 1e2 end as interest_rate,
       case when prod_id >= 107 then case (cust_id + prod_id) % 3 when 0 then 'low' when 1 then 'medium' else 'high' end end as risk_class,
       nullif(cust_id % 20, 0) as adviser_id
from (select o_custkey as cust_id, 100 + cast(substr(p_brand, 7) as int) as prod_id,
             cast(min(o_orderdate) as date) as since_date
      from {orders} join {lineitem} on o_orderkey = l_orderkey join {part} on l_partkey = p_partkey
      group by o_custkey, 100 + cast(substr(p_brand, 7) as int)) t""",
    "fx_sales": """
select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string)) as sale_id,
       o_custkey as cust_id, 100 + cast(substr(p_brand, 7) as int) as prod_id,
       l_extendedprice as amount, cast(o_orderdate as date) as sale_date,
       nullif(l_suppkey % 50, 0) as adviser_id,
       case o_orderstatus when 'F' then 'closed' when 'P' then 'rejected'
            else case when l_linenumber % 2 = 0 then 'postponed' else 'in_progress' end end as decision,
       case when l_linenumber % 3 = 0 then null else o_orderpriority end as reason
from {orders} join {lineitem} on o_orderkey = l_orderkey join {part} on l_partkey = p_partkey""",
    "fx_chat_messages": """
select conv_id % 20 as customer_id, cast(conv_id as string) as session_id, conv_id as seq,
       cast('2024-01-01' as date) + cast((conv_id * 37) % 400 as int) as session_date,
       turn, role, text as content
from {conversations}""",
    # Stored sessions; those of some customers have no message.
    "fx_chat_sessions": """
select conv_id % 20 as customer_id, cast(conv_id as string) as session_id, conv_id as seq,
       cast('2024-01-01' as date) + cast((conv_id * 37) % 400 as int) as session_date, count(*) as message_count
from {conversations} group by conv_id
union all
select distinct conv_id % 20, concat('empty', cast(conv_id as string)), 1000000000 + conv_id,
       cast('2024-01-01' as date) + cast((conv_id * 41) % 400 as int), 0
from {conversations} where conv_id % 13 = 0""",
    "fx_financing": """
select o_orderkey as request_id, o_custkey as cust_id,
       4e0 * o_totalprice as purchase_price, (o_orderkey % 5) * o_totalprice as equity
from {orders}""",
    "fx_coefficients": """
select prod_id, feature, (((prod_id * 7 + pos * 13) % 21) - 10) / 1e1 as coefficient
from (select distinct 100 + cast(substr(p_brand, 7) as int) as prod_id from {part}) p
cross join (select * from (values ('age_bucket_encoded', 0), ('revenue', 1), ('credit_score', 2)) as b(feature, pos)
      union all select distinct concat('has_', cast(100 + cast(substr(p_brand, 7) as int) as string)),
             2 + cast(substr(p_brand, 7) as int) from {part}) f
where feature <> concat('has_', cast(prod_id as string)) and prod_id <> 113""",
    "fx_intercepts": """
select distinct 100 + cast(substr(p_brand, 7) as int) as prod_id,
       (((100 + cast(substr(p_brand, 7) as int)) * 3) % 11 - 5) / 1e1 as intercept
from {part} where substr(p_brand, 7) <> '13'""",
    # Product look-up requests: ids, upper-cased names and unknown names mixed.
    "fx_product_requests": """
select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) as request_id,
       case l_linenumber % 3 when 0 then cast(100 + cast(substr(p_brand, 7) as int) as string)
            when 1 then upper(p_brand) else concat('unknown ', p_brand) end as identifier
from {lineitem} join {part} on l_partkey = p_partkey""",
    # Messages for entity extraction: the documents table is the only driver
    # text with digits; doc_id is the message id, the context customer is derived.
    "fx_messages": """
select doc_id as msg_id, doc_id % 20 as context_customer_id,
       case doc_id % 4 when 0 then text
            when 1 then concat(text, ' about bRaNd#', cast(11 + 10 * (doc_id % 5) + doc_id % 3 as string))
            when 2 then concat('Brand#1', cast(1 + doc_id % 3 as string), ' plus, ', text)
            else concat(text, ' Kunde ', cast(doc_id as string), ' anna meier') end as text
from {documents}""",
}

# Products of the driver's catalogue (its 25 brands): the columns that the
# oracle SQL spells out.  Spark takes them from fx_products.
ORACLE_PRODUCT_IDS = range(101, 126)

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def tables_used(sql: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(sql)))


def duckdb_text(view: str) -> str:
    """The view body with placeholders replaced by the DuckDB view names."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), VIEW_SQL[view])


def with_views(body: str, *views: str) -> str:
    """Prefix ``body`` with ``WITH`` definitions of the named fixture views."""
    ctes = ",\n".join(f"{v} as ({duckdb_text(v)}\n)" for v in views)
    return f"with {ctes}\n{body}"


# Driver tables whose size does not grow with the scale factor (row bound for
# the broadcast size check).
SMALL_DIMENSIONS = {"nation": 10_000, "region": 10_000}


@dataclass
class Domain:
    """Lazily-built domain DataFrames for one scale-factor directory."""

    spark: SparkSession
    sf_dir: str
    _raw: dict[str, DataFrame] = field(default_factory=dict)
    _views: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        return self._raw[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            sql = VIEW_SQL[name]
            self._views[name] = self.spark.sql(sql, **{t: self._input(t) for t in tables_used(sql)})
        return self._views[name]

    def _input(self, name: str) -> DataFrame:
        """A driver table for a view; the fixed-size dimensions are broadcast
        behind a size check, everything else is joined as Catalyst plans it."""
        if name in SMALL_DIMENSIONS:
            return broadcast_bounded(self.table(name), SMALL_DIMENSIONS[name])
        return self.table(name)

    # Convenience accessors -------------------------------------------------
    @property
    def customers(self) -> DataFrame:
        return self.view("fx_customers")

    @property
    def products(self) -> DataFrame:
        return self.view("fx_products")

    @property
    def ownership(self) -> DataFrame:
        return self.view("fx_ownership")

    @property
    def sales(self) -> DataFrame:
        return self.view("fx_sales")

    @property
    def chat_messages(self) -> DataFrame:
        return self.view("fx_chat_messages")

    @property
    def financing(self) -> DataFrame:
        return self.view("fx_financing")

    @property
    def coefficients(self) -> DataFrame:
        return self.view("fx_coefficients")

    @property
    def intercepts(self) -> DataFrame:
        return self.view("fx_intercepts")

    @property
    def messages(self) -> DataFrame:
        return self.view("fx_messages")
