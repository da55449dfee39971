"""Registered queries of the semantic engine, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import facade, graph, search
from .engine import Engine
from .security import ColumnFilterRule, JoinFilterRule, Policy
from .sources import dbt, osi

TODAY = datetime.date(1998, 7, 15)

MODELS = [
    {"name": "region", "sql_table": "region", "columns": [{"name": "r_regionkey", "primary_key": True}, {"name": "name", "sql": "r_name"}]},
    {
        "name": "nation", "sql_table": "nation",
        "columns": [{"name": "n_nationkey", "primary_key": True}, {"name": "name", "sql": "n_name"}, {"name": "n_regionkey"}],
        "joins": [{"target_model": "region", "join_pairs": [["n_regionkey", "r_regionkey"]]}],
    },
    {
        "name": "customer", "sql_table": "customer",
        "columns": [
            {"name": "c_custkey", "primary_key": True}, {"name": "c_nationkey"}, {"name": "segment", "sql": "c_mktsegment"}, {"name": "balance", "sql": "c_acctbal", "type": "double"},
            {"name": "in_debt", "sql": "c_acctbal < 0", "type": "boolean"}, {"name": "region_name", "sql": "nation__region.name"},
        ],
        "joins": [{"target_model": "nation", "join_pairs": [["c_nationkey", "n_nationkey"]]}],
    },
    {
        "name": "supplier", "sql_table": "supplier",
        "columns": [{"name": "s_suppkey", "primary_key": True}, {"name": "s_nationkey"}, {"name": "balance", "sql": "s_acctbal"}],
        "joins": [{"target_model": "nation", "join_pairs": [["s_nationkey", "n_nationkey"]]}],
    },
    {"name": "part", "sql_table": "part", "columns": [{"name": "p_partkey", "primary_key": True}, {"name": "brand", "sql": "p_brand"}, {"name": "size", "sql": "p_size"}, {"name": "price", "sql": "p_retailprice"}]},
    {
        "name": "orders", "sql_table": "orders", "default_time_dimension": "ordered_at", "query_variables": {"least": 100000},
        "columns": [
            {"name": "o_orderkey", "primary_key": True}, {"name": "o_custkey"}, {"name": "status", "sql": "o_orderstatus"}, {"name": "priority", "sql": "o_orderpriority"},
            {"name": "ordered_at", "sql": "o_orderdate", "type": "timestamp"}, {"name": "price", "sql": "o_totalprice", "type": "double"},
            {"name": "urgent_price", "sql": "o_totalprice", "filter": "priority LIKE '1-%'"},
            {"name": "urgent_at", "sql": "o_orderdate", "type": "timestamp", "filter": "priority LIKE '1-%'"},
            {"name": "debtor_price", "sql": "o_totalprice", "filter": "customer.balance < 0"},
            {"name": "big", "sql": "price > 200000", "type": "boolean"}, {"name": "kprice", "sql": "price / 1000", "type": "double"}, {"name": "mprice", "sql": "kprice / 1000", "type": "double"},
            {"name": "seq", "sql": "ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "type": "int"},
            {"name": "only_counted", "sql": "o_totalprice", "allowed_aggregations": ["count"]},
        ],
        "measures": [
            {"name": "revenue", "formula": "price:sum"}, {"name": "aov", "formula": "revenue / *:count"}, {"name": "growth", "formula": "change_pct(revenue)"},
            {"name": "rounded", "formula": "revenue / 1000", "type": "int"},
        ],
        "aggregations": [{"name": "above", "formula": "sum(CASE WHEN {value} > {limit} THEN 1 ELSE 0 END)", "params": {"limit": 100000}}],
        "joins": [{"target_model": "customer", "join_pairs": [["o_custkey", "c_custkey"]]}],
    },
    {
        "name": "lineitem", "sql_table": "lineitem", "default_time_dimension": "shipped_at",
        "columns": [
            {"name": "l_orderkey"}, {"name": "l_partkey"}, {"name": "l_suppkey"}, {"name": "l_linenumber"}, {"name": "quantity", "sql": "l_quantity"}, {"name": "price", "sql": "l_extendedprice"}, {"name": "discount", "sql": "l_discount"},
            {"name": "tax", "sql": "l_tax"}, {"name": "flag", "sql": "l_returnflag"}, {"name": "linestatus", "sql": "l_linestatus"}, {"name": "shipped_at", "sql": "l_shipdate", "type": "timestamp"},
            {"name": "net", "sql": "price * (1 - discount)", "type": "double"}, {"name": "charge", "sql": "net * (1 + l_tax)", "type": "double"},
        ],
        "joins": [
            {"target_model": "orders", "join_pairs": [["l_orderkey", "o_orderkey"]]}, {"target_model": "part", "join_pairs": [["l_partkey", "p_partkey"]]}, {"target_model": "supplier", "join_pairs": [["l_suppkey", "s_suppkey"]]},
        ],
    },
    {
        "name": "events", "sql_table": "events", "default_time_dimension": "ts",
        "columns": [{"name": "event_id", "primary_key": True}, {"name": "ts"}, {"name": "user_id"}, {"name": "event_type"}, {"name": "value"}, {"name": "key", "sql": "json_extract(props, '$.k')"}],
    },
    {"name": "big_orders", "sql": "WITH b AS (SELECT * FROM orders WHERE o_totalprice > 150000) SELECT o_orderpriority AS priority, o_totalprice AS price FROM b UNION ALL SELECT 'none', o_totalprice FROM orders WHERE o_totalprice < 1000"},
]


def engine(spark: SparkSession, folder: str, policy: Policy | None = None) -> Engine:
    return Engine(spark, folder, MODELS, policy, TODAY)


def _flat(df: DataFrame) -> DataFrame:
    """Public names with dots as names that need no quotes."""
    return df.toDF(*[c.replace(".", "__") for c in df.columns])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, sql: str | None, query=None, make: Callable | None = None, variables: dict | None = None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _flat(engine(spark, folder).execute(query, variables=variables).df) if make is None else make(spark, folder)

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        ORACLE[name] = sql


MONTH = "date_trunc('month', o_orderdate)::timestamp"
BY_MONTH = f"SELECT {MONTH} m, sum(o_totalprice) s, count(*) c FROM orders GROUP BY 1"
MONTHLY = {"dimension": "ordered_at", "granularity": "month"}


def _monthly(*measures, **more) -> dict:
    return {"source_model": "orders", "measures": list(measures), "time_dimensions": [MONTHLY], **more}


_add("simple_count", "SELECT count(*) orders___count FROM orders", {"source_model": "orders", "measures": ["*:count"]})
_add("count_by_category", "SELECT o_orderpriority orders__priority, count(*) orders___count FROM orders GROUP BY 1",
     {"source_model": "orders", "measures": ["*:count"], "dimensions": ["priority"]})
_add("monthly_revenue_by_status", f"SELECT o_orderstatus orders__status, {MONTH} orders__ordered_at, sum(o_totalprice) orders__revenue, count(*) orders___count FROM orders GROUP BY 1, 2",
     _monthly({"formula": "price:sum", "name": "revenue"}, "*:count", dimensions=["status"]))
_add("monthly_cumsum", f"SELECT m orders__ordered_at, sum(s) OVER (ORDER BY m) orders__total FROM ({BY_MONTH})", _monthly({"formula": "cumsum(price:sum)", "name": "total"}))
_add("monthly_change", f"SELECT m orders__ordered_at, s orders__price_sum, s - lag(s) OVER (ORDER BY m) orders__up FROM ({BY_MONTH})", _monthly("price:sum", {"formula": "change(price:sum)", "name": "up"}))
_add("monthly_change_pct", f"WITH b AS ({BY_MONTH}) SELECT b.m orders__ordered_at, (b.s - p.s) / nullif(p.s, 0) orders__growth FROM b LEFT JOIN b p ON p.m = b.m - INTERVAL 1 MONTH", _monthly({"formula": "growth", "name": "growth"}))
_add("year_over_year", f"WITH b AS ({BY_MONTH}) SELECT b.m orders__ordered_at, b.s orders__price_sum, p.s orders__before FROM b LEFT JOIN b p ON p.m = b.m - INTERVAL 1 YEAR",
     _monthly("price:sum", {"formula": "time_shift(price:sum, -1, 'year')", "name": "before"}))
_add("time_shift_date_range", f"WITH b AS ({BY_MONTH}), c AS (SELECT {MONTH} m, sum(o_totalprice) s FROM orders WHERE o_orderdate BETWEEN '1996-06-01' AND '1996-12-31' GROUP BY 1), p AS (SELECT date_trunc('month', o_orderdate + INTERVAL 1 MONTH)::timestamp m, sum(o_totalprice) s FROM orders WHERE o_orderdate + INTERVAL 1 MONTH BETWEEN '1996-06-01' AND '1996-12-31' GROUP BY 1) SELECT c.m orders__ordered_at, c.s orders__price_sum, p.s orders__before FROM c LEFT JOIN p USING (m)",
     {"source_model": "orders", "measures": ["price:sum", {"formula": "time_shift(price:sum, -1)", "name": "before"}], "time_dimensions": [{**MONTHLY, "date_range": ["1996-06-01", "1996-12-31"]}]})
_add("rank_by_category", "SELECT o_orderpriority orders__priority, sum(o_totalprice) orders__price_sum, rank() OVER (ORDER BY sum(o_totalprice) DESC) orders__place FROM orders GROUP BY 1",
     {"source_model": "orders", "measures": ["price:sum", {"formula": "rank(price:sum)", "name": "place"}], "dimensions": ["priority"]})
_add("last_function", f"SELECT m orders__ordered_at, first_value(s) OVER (ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) orders__latest, first_value(s) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) orders__earliest FROM ({BY_MONTH})",
     _monthly({"formula": "last(price:sum)", "name": "latest"}, {"formula": "first(price:sum)", "name": "earliest"}))
_add("last_aggregate", "SELECT o_custkey orders__o_custkey, max(o_orderdate) orders__ordered_at_max, max(CASE WHEN r = 1 THEN o_orderdate END) orders__ordered_at_last, min(CASE WHEN f = 1 THEN o_orderdate END) orders__ordered_at_first FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) f FROM orders) GROUP BY 1",
     {"source_model": "orders", "measures": ["ordered_at:max", "ordered_at:last", "ordered_at:first"], "dimensions": ["o_custkey"]})
_add("transform_filter", f"WITH b AS ({BY_MONTH}) SELECT m orders__ordered_at, s orders__price_sum FROM (SELECT *, s - lag(s) OVER (ORDER BY m) d FROM b) WHERE d < 0", _monthly("price:sum", filters=["change(price:sum) < 0"]))
_add("nested_cumsum_change", f"SELECT m orders__ordered_at, sum(d) OVER (ORDER BY m) orders__gain FROM (SELECT m, s - lag(s) OVER (ORDER BY m) d FROM ({BY_MONTH}))", _monthly({"formula": "cumsum(change(price:sum))", "name": "gain"}))
_add("nested_change_cumsum", f"SELECT m orders__ordered_at, t - lag(t) OVER (ORDER BY m) orders__gain FROM (SELECT m, sum(s) OVER (ORDER BY m) t FROM ({BY_MONTH}))", _monthly({"formula": "change(cumsum(price:sum))", "name": "gain"}))
_add("weekly_lag_lead", "SELECT w orders__ordered_at, c orders___count, lag(c) OVER (ORDER BY w) orders__before, lead(c, 2) OVER (ORDER BY w) orders__after FROM (SELECT date_trunc('week', o_orderdate)::timestamp w, count(*) c FROM orders GROUP BY 1)",
     {"source_model": "orders", "measures": ["*:count", {"formula": "lag(*:count)", "name": "before"}, {"formula": "lead(*:count, 2)", "name": "after"}], "time_dimensions": [{"dimension": "ordered_at", "granularity": "week"}]})
_add("having_filter", "SELECT o_custkey orders__o_custkey, sum(o_totalprice) orders__price_sum FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1000000 AND count(*) >= 5",
     {"source_model": "orders", "measures": ["price:sum"], "dimensions": ["o_custkey"], "filters": ["price:sum > 1000000", "*:count >= 5"]})

# Aggregations
_add("statistics", "SELECT l_returnflag lineitem__flag, avg(l_quantity) lineitem__quantity_avg, median(l_quantity) lineitem__quantity_median, quantile_cont(l_extendedprice, 0.95) lineitem__price_percentile_p_0_95, round(stddev_samp(l_discount), 9) lineitem__sd, round(var_pop(l_discount), 9) lineitem__vp, round(corr(l_quantity, l_extendedprice), 9) lineitem__corr, round(covar_samp(l_quantity, l_tax), 9) lineitem__cov, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) lineitem__wavg FROM lineitem GROUP BY 1",
     {"source_model": "lineitem", "dimensions": ["flag"], "measures": ["quantity:avg", "quantity:median", "price:percentile(p=0.95)", {"formula": "round(discount:stddev_samp, 9)", "name": "sd"}, {"formula": "round(discount:var_pop, 9)", "name": "vp"}, {"formula": "round(quantity:corr(other=price), 9)", "name": "corr"}, {"formula": "round(quantity:covar_samp(other=tax), 9)", "name": "cov"}, {"formula": "round(discount:weighted_avg(weight=quantity), 9)", "name": "wavg"}]})
_add("statistics_other", "SELECT o_orderpriority orders__priority, round(stddev_pop(o_totalprice), 4) orders__sp, round(var_samp(o_totalprice), 2) orders__vs, round(covar_pop(o_totalprice, o_custkey), 4) orders__cp, min(o_totalprice) orders__price_min, max(o_orderstatus) orders__status_max, sum((o_totalprice > 200000)::int) orders__big_sum FROM orders GROUP BY 1",
     {"source_model": "orders", "dimensions": ["priority"], "measures": [{"formula": "round(price:stddev_pop, 4)", "name": "sp"}, {"formula": "round(price:var_samp, 2)", "name": "vs"}, {"formula": "round(price:covar_pop(other=o_custkey), 4)", "name": "cp"}, "price:min", "status:max", "big:sum"]})
_add("counts", "SELECT count(*) orders___count, count(o_orderstatus) orders__status_count, count(DISTINCT o_custkey) orders__customers FROM orders",
     {"source_model": "orders", "measures": ["*:count", "status:count", {"formula": "o_custkey:countd", "name": "customers"}]})
_add("corr_of_constant", "SELECT o_orderkey orders__o_orderkey, NULL::double orders__c, NULL::double orders__s, 0.0::double orders__p FROM orders WHERE o_orderkey < 500",
     {"source_model": "orders", "dimensions": ["o_orderkey"], "filters": ["o_orderkey < 500"], "measures": [{"formula": "price:corr(other=o_custkey)", "name": "c"}, {"formula": "price:stddev_samp", "name": "s"}, {"formula": "price:var_pop", "name": "p"}]})
_add("custom_aggregation", "SELECT o_orderstatus orders__status, sum((o_totalprice > 100000)::int) orders__price_above, sum((o_totalprice > 250000)::int) orders__price_above_limit_250000 FROM orders GROUP BY 1",
     {"source_model": "orders", "dimensions": ["status"], "measures": ["price:above", "price:above(limit=250000)"]})
_add("filtered_column", "SELECT o_orderstatus orders__status, sum(o_totalprice) FILTER (WHERE o_orderpriority LIKE '1-%') orders__urgent_price_sum, count(o_totalprice) FILTER (WHERE o_orderpriority LIKE '1-%') orders__urgent_price_count FROM orders GROUP BY 1",
     {"source_model": "orders", "dimensions": ["status"], "measures": ["urgent_price:sum", "urgent_price:count"]})
_add("filtered_last", "SELECT o_custkey orders__o_custkey, max(o_orderdate) FILTER (WHERE o_orderpriority LIKE '1-%') orders__urgent_at_last, min(o_orderdate) FILTER (WHERE o_orderpriority LIKE '1-%') orders__urgent_at_first FROM orders GROUP BY 1",
     {"source_model": "orders", "dimensions": ["o_custkey"], "measures": ["urgent_at:last", "urgent_at:first"]})
_add("isolated_filter", "SELECT a.o_orderpriority orders__priority, a.s orders__price_sum, b.s orders__debtor_price_sum FROM (SELECT o_orderpriority, sum(o_totalprice) s FROM orders GROUP BY 1) a LEFT JOIN (SELECT o_orderpriority, sum(o_totalprice) s FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY 1) b USING (o_orderpriority)",
     {"source_model": "orders", "dimensions": ["priority"], "measures": ["price:sum", "debtor_price:sum"]})

# Joins
_FACT = "lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"
_add("four_hop_join", f"SELECT r_name lineitem__orders__customer__nation__region__name, sum(l_extendedprice * (1 - l_discount)) lineitem__net_sum FROM {_FACT.replace('lineitem JOIN', 'lineitem LEFT JOIN')} GROUP BY 1",
     {"source_model": "lineitem", "dimensions": ["orders.customer.nation.region.name"], "measures": ["net:sum"]})
_add("diamond_join", "SELECT a.n_name lineitem__orders__customer__nation__name, b.n_name lineitem__supplier__nation__name, count(*) lineitem___count FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation a ON c_nationkey = a.n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation b ON s_nationkey = b.n_nationkey GROUP BY 1, 2",
     {"source_model": "lineitem", "dimensions": ["orders.customer.nation.name", "supplier.nation.name"], "measures": ["*:count"]})
_add("filter_join", "SELECT sum(o_totalprice) orders__price_sum FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT c_acctbal < 0",
     {"source_model": "orders", "measures": ["price:sum"], "filters": ["customer.segment in ('BUILDING', 'MACHINERY') and not customer.balance < 0"]})
_add("derived_join_column", "SELECT r_name orders__customer__region_name, count(*) orders___count FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
     {"source_model": "orders", "dimensions": ["customer.region_name"], "measures": ["*:count"]})
_add("inner_join", "SELECT n_name customer__nation__name, count(*) customer___count FROM customer JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1 GROUP BY 1",
     {"source_model": {"source_name": "customer", "joins": [{"target_model": "nation", "join_pairs": [["c_nationkey", "n_nationkey"]], "join_type": "inner"}]}, "dimensions": ["nation.name"], "measures": ["*:count"], "filters": ["nation.n_regionkey = 1"]})
_add("cross_model_by_month", f"SELECT m orders__ordered_at, c orders___count, (SELECT avg(c_acctbal) FROM customer) orders__customer__balance_avg FROM ({BY_MONTH})", _monthly("*:count", "customer.balance:avg"))
_add("cross_model_by_segment", "SELECT o.c_mktsegment orders__customer__segment, s orders__price_sum, a orders__customer__balance_avg, n orders__customer___count FROM (SELECT c_mktsegment, sum(o_totalprice) s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o LEFT JOIN (SELECT c_mktsegment, avg(c_acctbal) a, count(*) n FROM customer GROUP BY 1) c USING (c_mktsegment)",
     {"source_model": "orders", "dimensions": ["customer.segment"], "measures": ["price:sum", "customer.balance:avg", "customer.*:count"]})
_add("cross_model_filter", "SELECT o.c_mktsegment orders__customer__segment, a orders__customer__balance_sum FROM (SELECT DISTINCT c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 1000) o LEFT JOIN (SELECT c_mktsegment, sum(c_acctbal) a FROM customer WHERE c_acctbal > 1000 GROUP BY 1) c USING (c_mktsegment) WHERE a > 0",
     {"source_model": "orders", "dimensions": ["customer.segment"], "measures": ["customer.balance:sum"], "filters": ["customer.balance > 1000", "customer.balance:sum > 0"]})

# Filters and expressions
_add("filter_forms", "SELECT count(*) orders___count FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority LIKE '%-H%' AND o_orderpriority NOT LIKE '2%' OR (o_totalprice / 2 + 1) % 7 < 3 AND o_orderstatus || o_orderpriority = 'O1-URGENT' AND o_orderdate IS NOT NULL AND o_totalprice NOT BETWEEN 5 AND 10",
     {"source_model": "orders", "measures": ["*:count"], "filters": ["status <> 'F' AND priority like '%-H%' and priority not like '2%' OR (price / 2 + 1) % 7 < 3 and status || priority == 'O1-URGENT' and ordered_at is not null and price not between 5 and 10"]})
_add("variables", "SELECT o_orderstatus orders__status, count(*) orders___count FROM orders WHERE o_totalprice > 100000 AND o_orderpriority = '5-LOW' GROUP BY 1",
     {"source_model": "orders", "dimensions": ["status"], "measures": ["*:count"], "filters": ["price > {least} and priority = '{p}'"]}, variables={"p": "5-LOW"})
_add("formulas", "SELECT o_orderstatus orders__status, sum(o_totalprice) / count(*) orders__aov, (sum(o_totalprice) / 1000)::bigint orders__rounded, round(power(avg(o_totalprice), 2) - coalesce(min(o_totalprice), 0) * -1, 2) orders__f, sum(o_totalprice) / nullif(sum(CASE WHEN o_orderpriority = 'x' THEN 1 ELSE 0 END), 0) orders__none FROM orders GROUP BY 1",
     {"source_model": "orders", "dimensions": ["status"], "measures": [{"formula": "aov", "name": "aov"}, {"formula": "round(price:avg ** 2 - coalesce(price:min, 0) * -1, 2)", "name": "f"}, {"formula": "price:sum / (*:count - *:count)", "name": "none"}, {"formula": "floor(rounded + 0.5)", "name": "rounded", "type": "int"}]})
_add("scalar_functions", "SELECT n_name customer__nation__name, trunc(sum(c_acctbal) / 7) customer__t, sign(sum(c_acctbal))::double customer__s, greatest(min(c_acctbal), 0) customer__g, abs(min(c_acctbal)) % 10 customer__m, log10(count(*)) customer__l, sqrt(count(*)) customer__q FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE lower(substr(c_mktsegment, 1, 4)) = 'buil' AND length(replace(c_mktsegment, 'I', '')) < 8 GROUP BY 1",
     {"source_model": "customer", "dimensions": ["nation.name"], "filters": ["lower(substr(segment, 1, 4)) = 'buil' and length(replace(segment, 'I', '')) < 8"], "measures": [{"formula": "trunc(balance:sum / 7)", "name": "t"}, {"formula": "sign(balance:sum)", "name": "s"}, {"formula": "greatest(balance:min, 0)", "name": "g"}, {"formula": "mod(abs(balance:min), 10)", "name": "m"}, {"formula": "log10(*:count)", "name": "l"}, {"formula": "sqrt(*:count)", "name": "q"}]})
_add("derived_columns", "SELECT l_linestatus lineitem__linestatus, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) lineitem__c FROM lineitem GROUP BY 1", {"source_model": "lineitem", "dimensions": ["linestatus"], "measures": [{"formula": "round(charge:sum, 4)", "name": "c"}]})
_add("window_column", "SELECT seq orders__seq, count(*) orders___count FROM (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) seq FROM orders) GROUP BY 1", {"source_model": "orders", "dimensions": ["seq"], "measures": ["*:count"]})
_add("distinct_dimensions", "SELECT DISTINCT o_orderstatus orders__status, o_orderpriority orders__priority FROM orders", {"source_model": "orders", "dimensions": ["status", "priority"]})
_add("raw_rows", "SELECT o_orderkey orders__o_orderkey, o_totalprice orders__price FROM orders WHERE o_totalprice > 300000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
     {"source_model": "orders", "dimensions": ["o_orderkey", "price"], "filters": ["price > 300000"], "distinct_dimension_values": False, "order": [{"column": "price", "direction": "desc"}, "o_orderkey"], "limit": 100})
_add("json_column", "SELECT json_extract_string(props, '$.k') events__key, count(*) events___count FROM events GROUP BY 1", {"source_model": "events", "dimensions": ["key"], "measures": ["*:count"]})
_add("sql_model", "SELECT priority big_orders__priority, n big_orders___count FROM (SELECT o_orderpriority priority, count(*) n FROM orders WHERE o_totalprice > 150000 GROUP BY 1 UNION ALL SELECT 'none', count(*) FROM orders WHERE o_totalprice < 1000 HAVING count(*) > 0)", {"source_model": "big_orders", "dimensions": ["priority"], "measures": ["*:count"]})
_add("auto_moved_dimension", "SELECT o_orderstatus orders__status, count(*) orders___count FROM orders GROUP BY 1", {"source_model": "orders", "measures": ["status", "*:count"]})

# Time
_add("granularities", "SELECT date_trunc('quarter', o_orderdate)::timestamp orders__ordered_at, count(*) orders___count FROM orders GROUP BY 1", {"source_model": "orders", "measures": ["*:count"], "time_dimensions": [{"dimension": "ordered_at", "granularity": "quarter"}]})
_add("week_sunday", "SELECT (date_trunc('week', o_orderdate + INTERVAL 1 DAY)::timestamp - INTERVAL 1 DAY)::timestamp orders__ordered_at, count(*) orders___count FROM orders GROUP BY 1", {"source_model": "orders", "measures": ["*:count"], "time_dimensions": [{"dimension": "ordered_at", "granularity": "week_sunday"}]})
_add("hourly", "SELECT date_trunc('hour', ts)::timestamp events__ts, count(*) events___count, sum(value) events__value_sum FROM events GROUP BY 1", {"source_model": "events", "measures": ["*:count", "value:sum"], "time_dimensions": [{"dimension": "ts", "granularity": "hour"}]})
_add("whole_periods", f"SELECT {MONTH} orders__ordered_at, count(*) orders___count FROM orders WHERE o_orderdate <= '1998-06-30' GROUP BY 1", _monthly("*:count", whole_periods_only=True))
_add("date_range", f"SELECT {MONTH} orders__ordered_at, count(*) orders___count FROM orders WHERE o_orderdate BETWEEN '1995-01-15' AND '1995-12-31' GROUP BY 1", {"source_model": "orders", "measures": ["*:count"], "time_dimensions": [{**MONTHLY, "date_range": ["1995-01-15", "1995-12-31"]}]})
_add("two_time_dimensions", "SELECT date_trunc('year', l_shipdate)::timestamp lineitem__shipped_at, date_trunc('year', o_orderdate)::timestamp lineitem__orders__ordered_at, c lineitem__t FROM (SELECT *, sum(n) OVER (PARTITION BY NULL ORDER BY l_shipdate RANGE UNBOUNDED PRECEDING) c FROM (SELECT date_trunc('year', l_shipdate) l_shipdate, date_trunc('year', o_orderdate) o_orderdate, count(*) n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2))",
     {"source_model": "lineitem", "measures": [{"formula": "cumsum(*:count)", "name": "t"}], "main_time_dimension": "shipped_at", "time_dimensions": [{"dimension": "shipped_at", "granularity": "year"}, {"dimension": "orders.ordered_at", "granularity": "year"}]})


def _trailing(gran: str, window: str, value: str, extra: str = "", where: str = "", having: str = "") -> str:
    step = "3 MONTH" if gran == "quarter" else f"1 {gran}"
    dims = f", {extra}" if extra else ""
    on = f" AND r.{extra} = g.{extra}" if extra else ""
    return f"WITH rows_ AS (SELECT * FROM orders), g AS (SELECT DISTINCT date_trunc('{gran}', o_orderdate)::timestamp b{dims} FROM rows_ {where}) SELECT b orders__ordered_at{', g.' + extra + ' orders__status' if extra else ''}, {value} orders__w FROM g LEFT JOIN rows_ r ON r.o_orderdate < b + INTERVAL {step} AND r.o_orderdate >= b + INTERVAL {step} - INTERVAL {window}{on} GROUP BY ALL"


_add("trailing_90d_by_status", _trailing("month", "90 DAY", "sum(o_totalprice)", "o_orderstatus"), _monthly({"formula": "price:sum(window='90d')", "name": "w"}, dimensions=["status"]))
_add("trailing_month_daily", _trailing("day", "1 MONTH", "avg(o_totalprice)"), {"source_model": "orders", "measures": [{"formula": "price:avg(window='1m')", "name": "w"}], "time_dimensions": [{"dimension": "ordered_at", "granularity": "day"}]})
_add("trailing_before_range", _trailing("month", "1 YEAR", "sum(o_totalprice)", where="WHERE o_orderdate BETWEEN '1996-01-01' AND '1996-06-30'"), {"source_model": "orders", "measures": [{"formula": "price:sum(window='1y')", "name": "w"}], "time_dimensions": [{**MONTHLY, "date_range": ["1996-01-01", "1996-06-30"]}]})
_add("trailing_filter", "SELECT * FROM (" + _trailing("month", "60 DAY", "sum(o_totalprice)") + ") WHERE orders__w > (SELECT avg(o_totalprice) FROM orders) * 10", None, lambda s, d: _flat(engine(s, d).execute(_monthly({"formula": "price:sum(window='60d')", "name": "w"}, filters=["w > {limit}"]), variables={"limit": s.read.parquet(f"{d}/orders.parquet").agg(F.avg("o_totalprice") * 10).first()[0]}).df))
_add("change_of_formula", f"WITH b AS ({BY_MONTH}) SELECT b.m orders__ordered_at, b.s / b.c - p.s / p.c orders__d FROM b LEFT JOIN b p ON p.m = b.m - INTERVAL 1 MONTH", _monthly({"formula": "change(aov)", "name": "d"}))
_add("shift_by_dimension", f"WITH b AS (SELECT o_orderstatus st, {MONTH} m, sum(o_totalprice) s FROM orders GROUP BY 1, 2) SELECT b.st orders__status, b.m orders__ordered_at, p.s orders__q FROM b LEFT JOIN b p ON p.m = b.m - INTERVAL 3 MONTH AND p.st = b.st", _monthly({"formula": "time_shift(price:sum, -1, 'quarter')", "name": "q"}, dimensions=["status"]))
_add("shift_days_by_month", "WITH b AS (SELECT date_trunc('day', o_orderdate)::timestamp d, count(*) c FROM orders GROUP BY 1), p AS (SELECT date_trunc('day', o_orderdate + INTERVAL 1 MONTH)::timestamp d, count(*) c FROM orders GROUP BY 1) SELECT b.d orders__ordered_at, p.c orders__before FROM b LEFT JOIN p USING (d)",
     {"source_model": "orders", "measures": [{"formula": "time_shift(*:count, -1, 'month')", "name": "before"}], "time_dimensions": [{"dimension": "ordered_at", "granularity": "day"}]})
_add("shift_of_trailing", f"WITH w AS ({_trailing('month', '90 DAY', 'sum(o_totalprice)')}), p AS (SELECT b + INTERVAL 1 MONTH m, sum(o_totalprice) s FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::timestamp b FROM orders) LEFT JOIN orders ON o_orderdate + INTERVAL 1 MONTH < b + INTERVAL 2 MONTH AND o_orderdate + INTERVAL 1 MONTH >= b + INTERVAL 2 MONTH - INTERVAL 90 DAY GROUP BY 1) SELECT w.orders__ordered_at, p.s orders__before FROM w LEFT JOIN p ON p.m = w.orders__ordered_at",
     _monthly({"formula": "time_shift(price:sum(window='90d'), -1)", "name": "before"}))
_add("streaks", f"WITH b AS (SELECT m, c, c > avg(c) OVER () f FROM ({BY_MONTH})), l AS (SELECT (SELECT avg(c) FROM b) a), r AS (SELECT m, f, sum((NOT f)::int) OVER (ORDER BY m) g FROM b) SELECT m orders__ordered_at, CASE WHEN f THEN sum(f::int) OVER (PARTITION BY g ORDER BY m) ELSE 0 END::bigint orders__run FROM r",
     None, lambda s, d: _flat(engine(s, d).execute(_monthly({"formula": "consecutive_periods(*:count > {a})".replace("{a}", str(_mean_month(s, d))), "name": "run"})).df))
_add("streaks_by_status", f"WITH b AS (SELECT o_orderstatus st, {MONTH} m, sum(o_totalprice) s FROM orders GROUP BY 1, 2), d AS (SELECT *, coalesce(s - lag_ > 0, false) f FROM (SELECT b.*, p.s lag_ FROM b LEFT JOIN b p ON p.st = b.st AND p.m = b.m - INTERVAL 1 MONTH)), r AS (SELECT *, sum((NOT f)::int) OVER (PARTITION BY st ORDER BY m) g FROM d) SELECT st orders__status, m orders__ordered_at, CASE WHEN f THEN sum(f::int) OVER (PARTITION BY st, g ORDER BY m) ELSE 0 END::bigint orders__run FROM r",
     _monthly({"formula": "consecutive_periods(change(price:sum) > 0)", "name": "run"}, dimensions=["status"]))


def _mean_month(spark: SparkSession, folder: str) -> float:
    months = engine(spark, folder).execute(_monthly("*:count")).df
    return months.agg(F.avg("`orders._count`")).first()[0]


# Ranks, order and limit
_add("rank_family", "SELECT o_custkey orders__o_custkey, o_orderstatus orders__status, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC) orders__d, percent_rank() OVER (ORDER BY count(*) DESC) orders__p, rank() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC) orders__r FROM orders GROUP BY 1, 2",
     {"source_model": "orders", "dimensions": ["o_custkey", "status"], "measures": [{"formula": "dense_rank(*:count, partition_by=status)", "name": "d"}, {"formula": "percent_rank(*:count)", "name": "p"}, {"formula": "rank(*:count, partition_by=[status])", "name": "r"}]})
_add("ntile", "SELECT o_custkey orders__o_custkey, ntile(4) OVER (ORDER BY sum(o_totalprice) DESC) orders__q FROM orders GROUP BY 1", {"source_model": "orders", "dimensions": ["o_custkey"], "measures": [{"formula": "ntile(price:sum, n=4)", "name": "q"}]})
_add("top_n_per_group", "SELECT o_orderstatus orders__status, o_custkey orders__o_custkey, s orders__price_sum FROM (SELECT o_orderstatus, o_custkey, sum(o_totalprice) s, rank() OVER (PARTITION BY o_orderstatus ORDER BY sum(o_totalprice) DESC) r FROM orders GROUP BY 1, 2) WHERE r <= 3",
     {"source_model": "orders", "dimensions": ["status", "o_custkey"], "measures": ["price:sum"], "filters": ["rank(price:sum, partition_by=status) <= 3"]})
_add("order_limit_offset", "SELECT o_custkey orders__o_custkey, count(*) orders___count FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC LIMIT 10 OFFSET 5", {"source_model": "orders", "dimensions": ["o_custkey"], "measures": ["*:count"], "order": [{"price:sum": "desc"}], "limit": 10, "offset": 5})
_add("renamed_measure_filter", "SELECT o_custkey orders__o_custkey, sum(o_totalprice) orders__total FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 2000000", {"source_model": "orders", "dimensions": ["o_custkey"], "measures": [{"formula": "price:sum", "name": "total"}], "filters": ["total > 2000000"], "order": ["total"]})

# Graphs of queries
_PER_CUSTOMER = {"name": "per_customer", "source_model": "orders", "dimensions": ["o_custkey", "customer.segment"], "measures": ["*:count", {"formula": "price:sum", "name": "spent"}]}
_add("two_stages", "SELECT n per_customer___count, count(*) per_customer__customers, avg(s) per_customer__spent_avg FROM (SELECT o_custkey, count(*) n, sum(o_totalprice) s FROM orders GROUP BY 1) GROUP BY 1",
     [_PER_CUSTOMER, {"source_model": "per_customer", "dimensions": ["_count"], "measures": [{"formula": "*:count", "name": "customers"}, "spent:avg"]}])
_add("stage_reaggregation", "SELECT c_mktsegment per_customer__customer__segment, sum(o_totalprice) per_customer__spent_sum, count(*) per_customer__n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1",
     [_PER_CUSTOMER, {"source_model": "per_customer", "dimensions": ["customer.segment"], "measures": ["spent:sum", {"formula": "_count:sum", "name": "n"}]}])
_add("stage_as_join", "SELECT c_mktsegment customer__segment, sum(s) customer__x FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) s FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1",
     None, lambda s, d: _flat(engine(s, d).execute([{"name": "spend", "source_model": "orders", "dimensions": ["o_custkey"], "measures": [{"formula": "price:sum", "name": "spent"}]}, {"source_model": {"source_name": "customer", "columns": [{"name": "x", "sql": "spend.spent"}], "joins": [{"target_model": "spend", "join_pairs": [["c_custkey", "o_custkey"]]}]}, "dimensions": ["segment"], "measures": [{"formula": "x:sum", "name": "x"}]}]).df))


def _query_model(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder)
    e.create_model_from_query("monthly", _monthly({"formula": "price:sum", "name": "revenue"}, filters=["price > {floor}"]), {"floor": 1000})
    return _flat(e.execute({"source_model": "monthly", "time_dimensions": [{"dimension": "ordered_at", "granularity": "year"}], "measures": ["revenue:max", {"formula": "change(revenue:sum)", "name": "up"}]}).df)


_add("query_backed_model", f"WITH b AS (SELECT date_trunc('year', m)::timestamp y, max(s) x, sum(s) t FROM (SELECT {MONTH} m, sum(o_totalprice) s FROM orders WHERE o_totalprice > 1000 GROUP BY 1) GROUP BY 1) SELECT y monthly__ordered_at, x monthly__revenue_max, t - lag(t) OVER (ORDER BY y) monthly__up FROM b", None, _query_model)


def _saved(spark: SparkSession, folder: str) -> DataFrame:
    e = engine(spark, folder)
    e.save_query("by_status", {"source_model": "orders", "dimensions": ["status"], "measures": ["price:max"], "filters": ["priority = '{p}'"]})
    return _flat(e.execute("by_status", variables={"p": "1-URGENT"}).df)


_add("saved_query", "SELECT o_orderstatus orders__status, max(o_totalprice) orders__price_max FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1", None, _saved)

# Row-level security
_POLICY = Policy((
    ColumnFilterRule("c_mktsegment", "BUILDING", "pass"), ColumnFilterRule("o_orderstatus", ["O", "F"], "block"),
    JoinFilterRule("orders", (("customer", (("o_custkey", "c_custkey"),)),), "c_mktsegment", "BUILDING"),
    JoinFilterRule("lineitem", (("orders", (("l_orderkey", "o_orderkey"),)), ("customer", (("o_custkey", "c_custkey"),))), "c_mktsegment", "BUILDING"),
))
_add("policy_join_rule", "SELECT o_orderpriority orders__priority, count(*) orders___count FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING') GROUP BY 1", None,
     lambda s, d: _flat(engine(s, d, _POLICY).execute({"source_model": "orders", "dimensions": ["priority"], "measures": ["*:count"]}).df))
_add("policy_two_hops", "SELECT l_returnflag lineitem__flag, sum(l_quantity) lineitem__quantity_sum FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') GROUP BY 1", None,
     lambda s, d: _flat(engine(s, d, _POLICY).execute({"source_model": "lineitem", "dimensions": ["flag"], "measures": ["quantity:sum"]}).df))
_add("policy_column_rule", "SELECT r_name region__name, count(*) region___count FROM region WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1", None,
     lambda s, d: _flat(engine(s, d, Policy((ColumnFilterRule("r_name", ("ASIA", "EUROPE")),))).execute({"source_model": "region", "dimensions": ["name"], "measures": ["*:count"]}).df))
_add("policy_sql_model", "SELECT priority big_orders__priority, count(*) big_orders___count FROM (SELECT CASE WHEN o_totalprice > 150000 THEN o_orderpriority ELSE 'none' END priority FROM orders WHERE (o_totalprice > 150000 OR o_totalprice < 1000) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) GROUP BY 1", None,
     lambda s, d: _flat(engine(s, d, _POLICY).execute({"source_model": "big_orders", "dimensions": ["priority"], "measures": ["*:count"]}).df))

# SQL facade, catalog, profile
_add("facade_sql", "SELECT o_orderstatus AS status, date_trunc('year', o_orderdate)::timestamp AS y, sum(o_totalprice) AS total, count(DISTINCT o_custkey) AS custs FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2 HAVING count(*) > 3", None,
     lambda s, d: facade.run(engine(s, d), "SELECT status, date_trunc('year', ordered_at) AS y, SUM(price) AS total, COUNT(DISTINCT o_custkey) AS custs FROM orders o WHERE o.priority IN ('1-URGENT', '2-HIGH') GROUP BY status, y HAVING COUNT(*) > 3 ORDER BY total DESC"))
_add("facade_time_bounds", "SELECT date_trunc('month', o_orderdate)::timestamp AS m, count(*) AS n FROM orders WHERE o_orderdate BETWEEN '1995-01-01' AND '1995-06-30' GROUP BY 1", None,
     lambda s, d: facade.run(engine(s, d), "SELECT date_trunc('month', ordered_at) AS m, row_count AS n FROM orders WHERE ordered_at >= '1995-01-01' AND ordered_at <= '1995-06-30' GROUP BY m"))


def _ingested(spark: SparkSession, folder: str) -> DataFrame:
    e = Engine(spark, folder, today=TODAY)
    e.ingest(include=["region", "nation", "customer", "orders", "lineitem", "supplier", "part"])
    return _flat(e.execute({"source_model": "orders", "dimensions": ["customer.nation.n_name"], "measures": ["o_totalprice:sum"]}).df)


_add("ingested_models", "SELECT n_name orders__customer__nation__n_name, sum(o_totalprice) orders__o_totalprice_sum FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", None, _ingested)
_add("column_profile", "SELECT 'status' AS \"column\", 'TEXT' AS type, count(DISTINCT o_orderstatus) AS n_distinct, NULL::varchar AS low, NULL::varchar AS high, (SELECT string_agg(s, ',' ORDER BY n DESC, s) FROM (SELECT o_orderstatus s, count(*) n FROM orders GROUP BY 1)) AS top FROM orders UNION ALL SELECT 'o_custkey', 'INT', NULL, min(o_custkey)::varchar, max(o_custkey)::varchar, NULL FROM orders", None,
     lambda s, d: engine(s, d).profile("orders", ["status", "o_custkey"]).select("column", "type", "n_distinct", "low", "high", F.array_join("values", ",").alias("top")))

# Retrieval
_add("embedding_cosine", "WITH q AS (SELECT embedding e FROM embeddings WHERE vec_id = 0) SELECT vec_id id, round(list_cosine_similarity(embedding::double[], e::double[]), 6) score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::double[], e::double[]) DESC, vec_id LIMIT 20", None,
     lambda s, d: search.cosine(s.read.parquet(f"{d}/embeddings.parquet"), s.read.parquet(f"{d}/embeddings.parquet").where("vec_id = 0").first().embedding, 20).select("id", F.round("score", 6).alias("score")))
_TAGS = "SELECT event_id, list_distinct([event_type, 'u' || (user_id % 7)::varchar]) t FROM events"
_add("bm25_tags", f"WITH d AS ({_TAGS}), n AS (SELECT count(*) n, avg(len(t)) a FROM d), h AS (SELECT event_id, len(t) l, unnest(t) w FROM d), f AS (SELECT w, count(*) df FROM h WHERE w IN ('u3', 'click') GROUP BY 1), fl AS (SELECT sum(ln((n + 1.0) / df)) x FROM f, n) SELECT event_id id, round(sum(ln((n + 1.0) / df) * 2.5 / (1.5 * (0.25 + 0.75 * l / a) + 1)) + max(x), 9) score FROM h JOIN f USING (w), n, fl GROUP BY 1", None,
     lambda s, d: search.tag_search(s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string"))).alias("entities")), ["u3", "click"]).select("id", F.round("score", 9).alias("score")))
_add("rank_fusion", "WITH a AS (SELECT o_orderkey id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) r FROM orders), b AS (SELECT o_orderkey id, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) r FROM orders) SELECT id, round(sum(1.0 / (60 + r)), 9) score FROM (SELECT * FROM a WHERE r <= 100 UNION ALL SELECT * FROM b WHERE r <= 100) GROUP BY 1", None,
     lambda s, d: search.fuse([s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col(c).alias("score")) for c in ("o_totalprice", "o_custkey")]).select("id", F.round("score", 9).alias("score")))

# Imported definitions, and the graph of models and notes
_DBT = {
    "semantic_models": [
        {
            "name": "sales", "model": "ref('orders')", "defaults": {"agg_time_dimension": "o_orderdate"},
            "entities": [{"name": "sale", "type": "primary", "expr": "o_orderkey"}, {"name": "buyer", "type": "foreign", "expr": "o_custkey"}],
            "dimensions": [{"name": "status", "type": "categorical", "expr": "o_orderstatus"}, {"name": "o_orderdate", "type": "time"}],
            "measures": [{"name": "revenue", "agg": "sum", "expr": "o_totalprice"}, {"name": "n", "agg": "count", "expr": 1}, {"name": "n_big", "agg": "sum_boolean", "expr": "o_totalprice > 200000"}],
        },
        {"name": "buyers", "model": "ref('customer')", "entities": [{"name": "buyer", "type": "primary", "expr": "c_custkey"}], "dimensions": [{"name": "segment", "type": "categorical", "expr": "c_mktsegment"}]},
    ],
    "metrics": [
        {"name": "aov", "type": "ratio", "type_params": {"numerator": "revenue", "denominator": "n"}},
        {"name": "built", "type": "simple", "type_params": {"measure": "revenue"}, "filter": "{{ Dimension('buyer__segment') }} = 'BUILDING'"},
    ],
}
_OSI = {
    "version": "1.0",
    "semantic_model": [{
        "name": "sales",
        "datasets": [
            {"name": "orders", "source": "orders", "primary_key": ["o_orderkey"], "fields": [{"name": n, "expression": n} for n in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")]},
            {"name": "customer", "source": "customer", "primary_key": ["c_custkey"], "fields": [{"name": n, "expression": n} for n in ("c_custkey", "c_nationkey", "c_acctbal")]},
        ],
        "relationships": [{"name": "buyer", "from": "orders", "to": "customer", "from_columns": ["o_custkey"], "to_columns": ["c_custkey"]}],
        "metrics": [
            {"name": "mean_price", "expression": "SUM(o_totalprice) / NULLIF(COUNT(*), 0)"}, {"name": "mid", "expression": "PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY o_totalprice)"},
            {"name": "thousands", "expression": "SUM(o_totalprice / 1000)"}, {"name": "owed", "expression": "SUM(CASE WHEN customer.c_acctbal < 0 THEN orders.o_totalprice END)"},
        ],
    }],
}


def _imported(made, model: str, dimension: str, *measures: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        e = Engine(spark, folder, today=TODAY)
        made.register(e)
        return _flat(e.execute({"source_model": model, "dimensions": [dimension], "measures": [{"formula": m, "name": m} for m in measures]}).df)

    return run


_add("dbt_import", "SELECT o_orderstatus sales__status, sum(o_totalprice) sales__revenue, sum(o_totalprice) / count(*) sales__aov, sum((o_totalprice > 200000)::int) sales__n_big, sum(o_totalprice) FILTER (WHERE c_mktsegment = 'BUILDING') sales__built FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1", None,
     _imported(dbt.convert([_DBT]), "sales", "status", "revenue", "aov", "n_big", "built"))
_add("osi_import", "SELECT o_orderstatus orders__o_orderstatus, sum(o_totalprice) / count(*) orders__mean_price, median(o_totalprice) orders__mid, sum(o_totalprice / 1000) orders__thousands, sum(o_totalprice) FILTER (WHERE c_acctbal < 0) orders__owed FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1", None,
     _imported(osi.convert([_OSI]), "orders", "o_orderstatus", "mean_price", "mid", "thousands", "owed"))
_add("graph_filter", "SELECT 'memory:' || event_id AS id FROM events WHERE event_type = 'click'", None,
     lambda s, d: graph.select(engine(s, d), "MATCH (m:Memory)-[:MENTIONS]->(a:Model)-[:JOINS*1..2]->(b:Model {id: 'nation'}) RETURN m.id AS id",
                               s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), F.array(F.when(F.col("event_type") == "click", "orders").otherwise("part")).alias("entities"))))
