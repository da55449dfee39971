"""More registered queries: the SQL facade, groups without a value, ties, ranks over all rows, and forms of filters and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import facade, search
from .engine import Engine
from .workload import MODELS, TODAY, _add, _flat, engine

# -- SQL facade ---------------------------------------------------------------


def _facade(name: str, select: str, oracle: str) -> None:
    _add(name, oracle, None, lambda s, d: facade.run(engine(s, d), select))


_facade(
    "facade_or_and",
    """SELECT o.status AS status, COUNT(*) AS n FROM orders o
       WHERE status = 'O' OR status = 'F' AND price > 400000 GROUP BY status
       HAVING COUNT(*) > 1000000 OR COUNT(*) > 0 AND SUM(price) > 10""",
    """SELECT o_orderstatus AS status, count(*) AS n FROM orders
       WHERE o_orderstatus = 'O' OR o_orderstatus = 'F' AND o_totalprice > 400000 GROUP BY 1
       HAVING count(*) > 1000000 OR count(*) > 0 AND sum(o_totalprice) > 10""",
)
_facade(
    "facade_between",
    """SELECT priority, SUM(price) AS total, COUNT(*) AS n FROM orders
       WHERE price BETWEEN 1000 AND 90000 AND NOT status = 'P' AND priority <> '1-URGENT  AND x' GROUP BY 1 ORDER BY 2 DESC""",
    """SELECT o_orderpriority AS priority, sum(o_totalprice) AS total, count(*) AS n FROM orders
       WHERE o_totalprice BETWEEN 1000 AND 90000 AND NOT o_orderstatus = 'P' GROUP BY 1""",
)
_facade(
    "facade_cast",
    """SELECT CAST(date_trunc('month', ordered_at) AS VARCHAR) AS m, COUNT(*)::varchar AS n, CAST(MIN(o_custkey) AS DOUBLE) AS low,
       SUM(price) / COUNT(*) AS mean FROM orders""",
    """SELECT date_trunc('month', o_orderdate)::timestamp::varchar AS m, count(*)::varchar AS n, min(o_custkey)::double AS low,
       sum(o_totalprice) / count(*) AS mean FROM orders GROUP BY 1""",
)
_facade(
    "facade_join",
    """SELECT c."segment" AS segment, status, COUNT(*) AS n, SUM(o.price) AS total FROM orders AS o
       LEFT JOIN (SELECT c_custkey AS k, segment, balance FROM customer) c ON o.o_custkey = c.k
       WHERE c.balance > 0 AND o.price IS NOT NULL GROUP BY c.segment, status""",
    """SELECT c_mktsegment AS segment, o_orderstatus AS status, count(*) AS n, sum(o_totalprice) AS total
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1, 2""",
)
_facade(
    "facade_dynamic_join",
    """SELECT c.segment AS segment, COUNT(*) AS n FROM events e
       LEFT JOIN (SELECT * FROM customer) AS c ON (c.c_custkey = e.user_id) WHERE event_type IN ('click', 'view') GROUP BY 1""",
    """SELECT c_mktsegment AS segment, count(*) AS n FROM events LEFT JOIN customer ON c_custkey = user_id
       WHERE event_type IN ('click', 'view') GROUP BY 1""",
)
_facade(
    "facade_sunday_week",
    """SELECT (date_trunc('week', (ordered_at + INTERVAL '1 day')) - INTERVAL '1 day') AS w, year(ordered_at) AS y, COUNT(*) AS n FROM orders GROUP BY 1, 2""",
    """SELECT date_trunc('week', o_orderdate + INTERVAL 1 DAY)::timestamp - INTERVAL 1 DAY AS w, date_trunc('year', o_orderdate)::timestamp AS y, count(*) AS n
       FROM orders GROUP BY 1, 2""",
)
_add(
    "catalog_metrics",
    """SELECT 'region' AS model, name || '_' || agg AS metric, name || ':' || agg AS formula
       FROM (VALUES ('r_regionkey'), ('name')) c(name), (VALUES ('count'), ('count_distinct'), ('count_distinct_approx'), ('first'), ('last'), ('min'), ('max')) a(agg)
       WHERE name = 'name' OR agg LIKE 'count%'
       UNION ALL VALUES ('region', 'row_count', '*:count')""",
    None,
    lambda s, d: facade.metrics(engine(s, d)).where("model = 'region'"),
)
_add(
    "catalog_dimensions",
    """SELECT 'nation' AS model, dimension, type
       FROM (VALUES ('n_nationkey', 'INT'), ('name', 'TEXT'), ('n_regionkey', 'INT'), ('region.r_regionkey', 'INT'), ('region.name', 'TEXT')) t(dimension, type)""",
    None,
    lambda s, d: facade.dimensions(engine(s, d)).where("model = 'nation'"),
)
_add(
    "information_schema",
    """SELECT 'cadenza' AS table_schema, 'part' AS table_name, column_name, ordinal_position::int AS ordinal_position, data_type
       FROM (VALUES ('p_partkey', 1, 'INT'), ('brand', 2, 'TEXT'), ('size', 3, 'INT'), ('price', 4, 'DOUBLE')) t(column_name, ordinal_position, data_type)""",
    None,
    lambda s, d: facade.information_schema(engine(s, d))["columns"].where("table_name = 'part'"),
)

# -- groups without a value ---------------------------------------------------

_SPARSE = {
    "source_name": "orders",
    "columns": [{"name": "kind", "sql": "nullif(o_orderpriority, '1-URGENT')", "type": "string"}, {"name": "seen_at", "sql": "CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END", "type": "timestamp"}],
}
_KIND = "nullif(o_orderpriority, '1-URGENT')"
_MONTHS = {"dimension": "ordered_at", "granularity": "month"}
_add(
    "shift_of_null_group",
    f"""WITH b AS (SELECT {_KIND} k, date_trunc('month', o_orderdate)::timestamp m, sum(o_totalprice) s FROM orders GROUP BY 1, 2)
        SELECT b.k orders__kind, b.m orders__ordered_at, b.s orders__price_sum, p.s orders__before
        FROM b LEFT JOIN b p ON p.k IS NOT DISTINCT FROM b.k AND p.m = b.m - INTERVAL 1 MONTH""",
    {"source_model": _SPARSE, "dimensions": ["kind"], "time_dimensions": [_MONTHS], "measures": ["price:sum", {"formula": "time_shift(price:sum, -1)", "name": "before"}]},
)
_add(
    "trailing_of_null_group",
    f"""WITH b AS (SELECT DISTINCT {_KIND} k, date_trunc('month', o_orderdate)::timestamp m FROM orders)
        SELECT b.k orders__kind, b.m orders__ordered_at, (SELECT sum(o_totalprice) FROM orders
            WHERE {_KIND} IS NOT DISTINCT FROM b.k AND o_orderdate < b.m + INTERVAL 1 MONTH AND o_orderdate >= b.m + INTERVAL 1 MONTH - INTERVAL 60 DAY) orders__price_sum_window_60d
        FROM b""",
    {"source_model": _SPARSE, "dimensions": ["kind"], "time_dimensions": [_MONTHS], "measures": ["price:sum(window='60d')"]},
)
_add(
    "trailing_in_a_range",
    """WITH b AS (SELECT DISTINCT date_trunc('month', o_orderdate)::timestamp m FROM orders WHERE o_orderdate BETWEEN '1996-06-15' AND '1996-12-31')
       SELECT b.m orders__ordered_at, (SELECT sum(o_totalprice) FROM orders
           WHERE o_orderdate < b.m + INTERVAL 1 MONTH AND o_orderdate >= b.m + INTERVAL 1 MONTH - INTERVAL 5 MONTH) orders__price_sum_window_5m
       FROM b""",
    {"source_model": "orders", "time_dimensions": [{**_MONTHS, "date_range": ["1996-06-15", "1996-12-31"]}], "measures": ["price:sum(window='5m')"]},
)
_add(
    "shift_in_a_range_at_month_ends",
    """WITH b AS (SELECT o_orderdate::timestamp d, sum(o_totalprice) s FROM orders WHERE o_orderdate BETWEEN '1996-02-25' AND '1996-03-31' GROUP BY 1),
       p AS (SELECT o_orderdate + INTERVAL 1 MONTH d, sum(o_totalprice) s FROM orders WHERE o_orderdate + INTERVAL 1 MONTH BETWEEN '1996-02-25' AND '1996-03-31' GROUP BY 1)
       SELECT b.d orders__ordered_at, b.s orders__price_sum, p.s orders__before FROM b LEFT JOIN p ON p.d = b.d""",
    {
        "source_model": "orders", "time_dimensions": [{"dimension": "ordered_at", "granularity": "day", "date_range": ["1996-02-25", "1996-03-31"]}],
        "measures": ["price:sum", {"formula": "time_shift(price:sum, -1, 'month')", "name": "before"}],
    },
)
_add(
    "cross_model_of_null_group",
    """SELECT nullif(c_mktsegment, 'BUILDING') orders__customer__kind, count(*) orders___count, max(b.s) orders__customer__balance_sum
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey
       LEFT JOIN (SELECT nullif(c_mktsegment, 'BUILDING') k, sum(c_acctbal) s FROM customer GROUP BY 1) b ON b.k IS NOT DISTINCT FROM nullif(c_mktsegment, 'BUILDING')
       GROUP BY 1""",
    None,
    lambda s, d: _flat(_with_kind(s, d).execute({"source_model": "orders", "dimensions": ["customer.kind"], "measures": ["*:count", "customer.balance:sum"]}).df),
)


def _with_kind(spark, folder: str) -> Engine:
    models = [{**m, "columns": [*m["columns"], {"name": "kind", "sql": "nullif(c_mktsegment, 'BUILDING')", "type": "string"}]} if m["name"] == "customer" else m for m in MODELS]
    return Engine(spark, folder, models, None, TODAY)


_add(
    "null_order_and_is_null",
    f"""SELECT {_KIND} orders__kind, count(*) orders___count FROM orders
        WHERE ({_KIND} IS NULL OR o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM')) AND o_totalprice > 200000 IS TRUE GROUP BY 1 ORDER BY 1 NULLS LAST LIMIT 4""",
    {"source_model": _SPARSE, "dimensions": ["kind"], "measures": ["*:count"], "filters": ["kind is null or priority not in ('2-HIGH', '3-MEDIUM')", "big is true"], "order": ["kind"], "limit": 4},
)

# -- ties, ranks over all rows -------------------------------------------------

_add(
    "first_and_last_with_ties",
    """SELECT o_orderpriority orders__priority, (list(o_totalprice ORDER BY o_orderdate, o_totalprice))[1] orders__price_first,
       (list(o_totalprice ORDER BY o_orderdate DESC, o_totalprice DESC))[1] orders__price_last FROM orders GROUP BY 1""",
    {"source_model": "orders", "dimensions": ["priority"], "measures": ["price:first", "price:last"]},
)
_add(
    "ranks_over_all_rows",
    """SELECT o_custkey orders__o_custkey, count(*) orders___count, rank() OVER w orders__place, dense_rank() OVER w orders__dense, percent_rank() OVER w orders__share,
       ntile(7) OVER (ORDER BY count(*) DESC, o_custkey) orders__tile, rank() OVER (ORDER BY sum(o_totalprice) - 1000000 DESC) orders__by_rest
       FROM orders GROUP BY 1 WINDOW w AS (ORDER BY count(*) DESC)""",
    {
        "source_model": "orders", "dimensions": ["o_custkey"],
        "measures": [
            "*:count", {"formula": "rank(*:count)", "name": "place"}, {"formula": "dense_rank(*:count)", "name": "dense"}, {"formula": "percent_rank(*:count)", "name": "share"},
            {"formula": "ntile(*:count, n=7)", "name": "tile"}, {"formula": "rank(price:sum - 1000000)", "name": "by_rest"},
        ],
    },
)
_add(
    "count_distinct_approx",
    "SELECT o_orderstatus orders__status, true orders__close FROM orders GROUP BY 1",
    None,
    lambda s, d: _flat(
        engine(s, d).execute({"source_model": "orders", "dimensions": ["status"], "measures": ["o_custkey:count_distinct_approx", "o_custkey:count_distinct"]}).df
    ).select("orders__status", F.expr("abs(orders__o_custkey_count_distinct_approx - orders__o_custkey_count_distinct) <= 0.1 * orders__o_custkey_count_distinct").alias("orders__close")),
)

# -- sources, filters of models, functions -------------------------------------

_add(
    "model_filters",
    "SELECT o_orderstatus late__status, sum(o_totalprice) late__price_sum FROM orders WHERE o_orderdate >= '1996-01-01' AND o_totalprice > 1000 GROUP BY 1",
    {
        "source_model": {
            "name": "late", "sql_table": "orders", "filters": ["o_orderdate >= '1996-01-01'", "price > 1000"],
            "columns": [{"name": "status", "sql": "o_orderstatus"}, {"name": "price", "sql": "o_totalprice"}],
        },
        "dimensions": ["status"], "measures": ["price:sum"],
    },
)
_add(
    "stages_in_any_order",
    """WITH a AS (SELECT o_custkey k, sum(o_totalprice) s FROM orders GROUP BY 1) SELECT count(*) spent___count, avg(s) spent__price_sum_avg FROM a WHERE s > 500000""",
    [
        {"name": "spent", "source_model": "orders", "dimensions": ["o_custkey"], "measures": ["price:sum"]},
        {"source_model": "spent", "measures": ["*:count", "price_sum:avg"], "filters": ["price_sum > 500000"]},
    ],
)
_add(
    "functions_of_text",
    """SELECT n_name nation__name, upper(trim(n_name)) nation__u, ltrim(n_name) nation__l, rtrim(n_name) nation__r, instr(n_name, 'A') nation__i,
       concat(n_name, '-', n_name) nation__c, substring(n_name, 2) nation__s, coalesce(nullif(n_name, 'FRANCE'), 'none') nation__n, ifnull(n_name, 'x') nation__f
       FROM nation""",
    {
        "source_model": {
            "source_name": "nation",
            "columns": [
                {"name": "u", "sql": "upper(trim(n_name))", "type": "string"}, {"name": "l", "sql": "ltrim(n_name)", "type": "string"}, {"name": "r", "sql": "rtrim(n_name)", "type": "string"},
                {"name": "i", "sql": "instr(n_name, 'A')", "type": "int"}, {"name": "c", "sql": "concat(n_name, '-', n_name)", "type": "string"}, {"name": "s", "sql": "substring(n_name, 2)", "type": "string"},
                {"name": "n", "sql": "coalesce(nullif(n_name, 'FRANCE'), 'none')", "type": "string"}, {"name": "f", "sql": "ifnull(n_name, 'x')", "type": "string"},
            ],
        },
        "dimensions": ["name", "u", "l", "r", "i", "c", "s", "n", "f"], "distinct_dimension_values": False,
    },
)
_add(
    "functions_of_numbers",
    """SELECT n_name customer__nation__name, ceil(sum(c_acctbal) / 7)::double customer__up, floor(sum(c_acctbal) / 7)::double customer__down, round(exp(count(*) / 1000), 6) customer__e,
       round(ln(count(*)), 9) customer__n, round(log2(count(*)), 9) customer__two, least(count(*), 20) customer__least, nullif(count(*), 40) customer__nil, count(*) ** 2 customer__sq,
       mod(count(*), 7) customer__rest, ifnull(nullif(count(*), 40), 0) customer__if
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
    {
        "source_model": "customer", "dimensions": ["nation.name"],
        "measures": [
            {"formula": "ceil(balance:sum / 7)", "name": "up"}, {"formula": "floor(balance:sum / 7)", "name": "down"}, {"formula": "round(exp(*:count / 1000), 6)", "name": "e"},
            {"formula": "round(ln(*:count), 9)", "name": "n"}, {"formula": "round(log2(*:count), 9)", "name": "two"}, {"formula": "least(*:count, 20)", "name": "least"},
            {"formula": "nullif(*:count, 40)", "name": "nil"}, {"formula": "*:count ** 2", "name": "sq"}, {"formula": "mod(*:count, 7)", "name": "rest"}, {"formula": "ifnull(nullif(*:count, 40), 0)", "name": "if"},
        ],
    },
)
for _unit in ("second", "minute"):
    _add(
        f"by_{_unit}",
        f"SELECT date_trunc('{_unit}', ts)::timestamp events__ts, count(*) events___count FROM events GROUP BY 1",
        {"source_model": "events", "measures": ["*:count"], "time_dimensions": [{"dimension": "ts", "granularity": _unit}]},
    )

# -- retrieval -----------------------------------------------------------------

_add(
    "bm25_text",
    r"""WITH d AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: length(w) > 0),
                   lambda w: CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN w[:-4] WHEN length(w) > 4 AND w LIKE '%es' THEN w[:-3] WHEN length(w) > 3 AND w LIKE '%s' THEN w[:-2] ELSE w END) t FROM documents),
        n AS (SELECT count(*) n, avg(len(t)) a FROM d),
        h AS (SELECT doc_id, len(t) l, w, count(*) tf FROM (SELECT doc_id, t, unnest(t) w FROM d) WHERE w IN ('think', 'heat', 'and', 'station') GROUP BY ALL),
        f AS (SELECT w, count(*) df FROM h GROUP BY 1)
        SELECT doc_id id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (1.5 * (0.25 + 0.75 * l / a) + tf)), 9) score FROM h JOIN f USING (w), n GROUP BY 1""",
    None,
    lambda s, d: search.text_search(s.read.parquet(f"{d}/documents.parquet"), "thinking heat and stations", "doc_id").select("id", F.round("score", 9).alias("score")),
)
