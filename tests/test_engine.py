"""Hand-computed results on tiny tables, rules of definitions, and errors."""

import datetime

import pytest
from pyspark.sql import functions as F

from cadenza import dsl
from cadenza.cache import CacheConfig
from cadenza.engine import Engine
from cadenza.errors import CadenzaError, JoinPathError, NotAllowed, PolicyError, SchemaDrift, UnknownName
from cadenza.facade import run as sql
from cadenza.facade import translate
from cadenza.functions.calendar import aligned, duration, period_end, period_start
from cadenza.security import ColumnFilterRule, JoinFilterRule, Policy
from cadenza.semantics import Model, Query
from cadenza.sources import store

D = lambda y, m, d: datetime.datetime(y, m, d)


@pytest.fixture(scope="module")
def tables(spark):
    """A co-operative of beekeepers: loads of honey (none in June), hives (one without loads), and small tables for single cases."""
    loads = [
        (1, "light", 12.0, 10, D(2031, 4, 3)), (2, "dark", 30.0, 11, D(2031, 4, 28)), (3, "light", 8.0, 10, D(2031, 5, 9)), (4, "comb", 5.0, 12, D(2031, 5, 9)),
        (5, "dark", 40.0, 13, D(2031, 5, 30)), (6, "light", 20.0, 11, D(2031, 7, 1)), (7, "comb", 9.0, 13, D(2031, 7, 12)),
    ]
    hives = [(10, "Ines", "north", 7.0), (11, "Odo", "south", 4.0), (12, "Ines", "north", 9.0), (13, "Uma", "south", 2.0), (14, "Pia", "east", 1.0)]
    points = [(1, 2.0, 7.0, "line"), (2, 4.0, 13.0, "line"), (3, 9.0, 28.0, "line"), (4, 6.0, 1.0, "single"), (5, 1.0, 5.0, "level"), (6, 8.0, 5.0, "level")]
    gaps = [(1, None, 4.0, True, D(2030, 11, 30)), (2, "p", 6.0, False, D(2030, 12, 5)), (3, "p", None, None, D(2031, 2, 11)), (4, None, 1.0, True, None), (5, None, 3.0, False, D(2030, 11, 2))]
    return {
        "loads": spark.createDataFrame(loads, "id long, grade string, kilos double, hive_id long, taken_at timestamp_ntz"),
        "hives": spark.createDataFrame(hives, "id long, keeper string, valley string, vigor double"),
        "points": spark.createDataFrame(points, "id long, x double, y double, shape string"),
        "towns": spark.createDataFrame([(1, "Aro"), (2, "Bel"), (3, "Cor")], "id long, name string"),
        "riders": spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "id long, town_id long"),
        "depots": spark.createDataFrame([(1, 3), (2, 1)], "id long, town_id long"),
        "rides": spark.createDataFrame([(1, 7.0, 1, 1), (2, 11.0, 1, 2), (3, 2.0, 2, 1), (4, 4.0, 3, 1)], "id long, fare double, rider_id long, depot_id long"),
        "gaps": spark.createDataFrame(gaps, "id long, part string, v double, ok boolean, t timestamp_ntz"),
    }


MODELS = [
    {"name": "hives", "sql_table": "hives", "columns": [{"name": "id", "primary_key": True}, {"name": "keeper"}, {"name": "valley"}, {"name": "vigor"}]},
    {
        "name": "loads", "sql_table": "loads", "default_time_dimension": "taken_at",
        "columns": [{"name": "id", "primary_key": True}, {"name": "grade"}, {"name": "kilos"}, {"name": "hive_id"}, {"name": "taken_at"}, {"name": "north_kilos", "sql": "kilos", "filter": "hives.valley = 'north'"}],
        "measures": [{"name": "weight", "formula": "kilos:sum"}, {"name": "mean", "formula": "weight / *:count"}],
        "joins": [{"target_model": "hives", "join_pairs": [["hive_id", "id"]]}],
    },
    {"name": "points", "sql_table": "points", "columns": [{"name": "x"}, {"name": "y"}, {"name": "shape"}]},
    {"name": "towns", "sql_table": "towns", "columns": [{"name": "id"}, {"name": "name"}]},
    {"name": "riders", "sql_table": "riders", "columns": [{"name": "id"}], "joins": [{"target_model": "towns", "join_pairs": [["town_id", "id"]]}]},
    {"name": "depots", "sql_table": "depots", "columns": [{"name": "id"}], "joins": [{"target_model": "towns", "join_pairs": [["town_id", "id"]]}]},
    {"name": "rides", "sql_table": "rides", "columns": [{"name": "fare"}], "joins": [{"target_model": "riders", "join_pairs": [["rider_id", "id"]]}, {"target_model": "depots", "join_pairs": [["depot_id", "id"]]}]},
    {"name": "gaps", "sql_table": "gaps", "default_time_dimension": "t", "columns": [{"name": "part"}, {"name": "v"}, {"name": "ok"}, {"name": "t"}]},
]
MONTH = {"time_dimensions": [{"dimension": "taken_at", "granularity": "month"}]}


@pytest.fixture
def engine(spark, tables):
    return Engine(spark, tables, MODELS, today=datetime.date(2031, 7, 5))


def ask(engine, model, *measures, **more):
    out = engine.execute({"source_model": model, "measures": list(measures), **more}, variables=more.pop("values", None))
    return [tuple(r) for r in out.df.collect()]


def by_month(engine, formula, **more):
    rows = ask(engine, "loads", {"formula": formula, "name": "m"}, **MONTH, **more)
    return [r[1] for r in sorted(rows, key=lambda r: r[0])]


def test_known_values(engine):
    """April 42 kilos in 2 loads, May 53 in 3, July 29 in 2."""
    assert by_month(engine, "kilos:sum") == [42, 53, 29]
    assert by_month(engine, "last(kilos:sum)") == [29, 29, 29]
    assert by_month(engine, "consecutive_periods(kilos:sum > 40)") == [1, 2, 0]
    assert by_month(engine, "change(kilos:sum)") == [None, 11, None]
    assert by_month(engine, "cumsum(change(kilos:sum))") == [None, 11, 11]
    assert by_month(engine, "change_pct(mean)")[1] == pytest.approx((53 / 3 - 21) / 21)
    assert by_month(engine, "time_shift(kilos:sum)") == [53, None, None]
    assert by_month(engine, "kilos:sum(window='2m')") == [42, 95, 29]
    assert by_month(engine, "kilos:avg(window='35d')") == [21, 20.75, 14.5]


def test_cross_model_measures(engine):
    assert by_month(engine, "hives.vigor:avg") == [pytest.approx(4.6)] * 3
    rows = ask(engine, "loads", "kilos:sum", "hives.vigor:avg", "hives.*:count", dimensions=["hives.valley"])
    assert sorted(rows) == [("north", 25, 8, 2), ("south", 99, 3, 2)]
    assert sorted(ask(engine, "loads", "north_kilos:sum", "*:count", dimensions=["grade"])) == [("comb", 5, 2), ("dark", None, 2), ("light", 20, 3)]


def test_diamond_keeps_paths_apart(engine):
    rows = ask(engine, "rides", "fare:sum", dimensions=["riders.towns.name", "depots.towns.name"])
    assert sorted(rows) == [("Bel", "Aro", 11), ("Bel", "Cor", 11), ("Cor", "Cor", 2)]


def test_statistics_of_single_and_level_groups(engine):
    rows = {r[0]: r[1:] for r in ask(engine, "points", "x:stddev_samp", "x:var_pop", "x:corr(other=y)", "x:covar_pop(other=y)", dimensions=["shape"])}
    assert rows["line"][2] == pytest.approx(1) and rows["single"] == (None, 0, None, 0) and rows["level"][2] is None
    assert rows["line"][1] == pytest.approx(26 / 3) and rows["line"][3] == pytest.approx(26)


def test_nulls_gaps_and_booleans(engine):
    rows = {r[0]: r[1:] for r in ask(engine, "gaps", "ok:sum", "v:last", "v:first", "v:count", dimensions=["part"])}
    assert rows == {None: (2, 4, 3, 3), "p": (0, None, 6, 1)}  # last keeps the NULL of the latest row
    month = {"time_dimensions": [{"dimension": "t", "granularity": "month"}]}
    lagged = dict(ask(engine, "gaps", {"formula": "lag(*:count)", "name": "l"}, **month))
    shifted = dict(ask(engine, "gaps", {"formula": "time_shift(*:count, -1)", "name": "s"}, **month))
    assert lagged[D(2031, 2, 1)] == 1 and shifted[D(2031, 2, 1)] is None and shifted[D(2030, 12, 1)] == 2 and shifted[None] is None
    assert ask(engine, "gaps", {"formula": "v:sum / (*:count - *:count)", "name": "z"}) == [(None,)]


def test_groups_without_a_value_are_groups(engine):
    month = {"time_dimensions": [{"dimension": "t", "granularity": "month"}], "dimensions": ["part"]}
    rows = {r[:2]: r[2:] for r in ask(engine, "gaps", "v:sum(window='2m')", {"formula": "time_shift(v:sum, 1)", "name": "s"}, **month)}
    assert rows[None, D(2030, 11, 1)] == (7, None) and rows["p", D(2030, 12, 1)] == (6, None) and rows[None, None] == (None, None)


def test_ranks_over_all_rows(engine):
    ranks = [{"formula": f"{f}(v:sum{more})", "name": f"by_{f}"} for f, more in (("rank", ""), ("dense_rank", ""), ("percent_rank", ""), ("ntile", ", n=2"))]
    rows = ask(engine, {"name": "g", "sql": "SELECT * FROM VALUES (1, 5.0D), (2, -3.5D), (3, 5.0D), (4, CAST('NaN' AS DOUBLE)), (5, NULL), (6, 0.25D), (7, -1e300D), (8, 1e300D) AS t(id, v)", "columns": [{"name": "id"}, {"name": "v"}]}, *ranks, dimensions=["id"])
    assert sorted(rows) == [
        (1, 3, 3, 2 / 7, 1), (2, 6, 5, 5 / 7, 2), (3, 3, 3, 2 / 7, 1), (4, 1, 1, 0, 1), (5, 8, 7, 1, 2), (6, 5, 4, 4 / 7, 2), (7, 7, 6, 6 / 7, 2), (8, 2, 2, 1 / 7, 1),
    ]
    assert ask(engine, "loads", {"formula": "percent_rank(kilos:sum)", "name": "p"}, {"formula": "ntile(kilos:sum, n=5)", "name": "t"}) == [(0, 1)]


def test_ranks_of_sums_do_not_depend_on_the_order_of_rows(engine):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ as doubles; so do sums that meet 1e15 first or last."""
    rows = "(1, 0.1D), (1, 0.2D), (1, 0.3D), (2, 0.3D), (2, 0.2D), (2, 0.1D), (3, 9e14D), (3, 0.06D), (3, 0.06D), (4, 0.06D), (4, 0.06D), (4, 9e14D), (5, 1e300D), (5, 1D), (6, NULL)"
    model = {"name": "g", "sql": f"SELECT * FROM VALUES {rows} AS t(id, v)", "columns": [{"name": "id"}, {"name": "v"}]}
    ranks = [{"formula": f, "name": n} for f, n in (("rank(v:sum)", "a"), ("dense_rank(v:sum - 1)", "b"), ("rank(v:avg)", "c"))]
    assert sorted(ask(engine, model, *ranks, dimensions=["id"])) == [(1, 4, 3, 4), (2, 4, 3, 4), (3, 2, 2, 2), (4, 2, 2, 2), (5, 1, 1, 1), (6, 6, 4, 6)]


def test_names(engine):
    names = lambda *m, **q: engine.execute({"source_model": "loads", "measures": list(m), **q}).df.columns
    assert names("kilos:sum", "*:count", dimensions=["hives.keeper"]) == ["loads.hives.keeper", "loads.kilos_sum", "loads._count"]
    assert names("kilos:percentile(p=0.5)", "hives.vigor:avg", "kilos:sum / *:count") == ["loads.kilos_percentile_p_0_5", "loads.hives.vigor_avg", "loads.kilos_sum_div_count".replace("_div_count", "__div___count")]
    assert names({"formula": "hives.vigor:max", "name": "top"}) == ["loads.hives.top"]


@pytest.mark.parametrize(
    ("query", "error"),
    [
        ({"measures": ["id:sum"]}, NotAllowed), ({"measures": ["grade:avg"]}, NotAllowed), ({"measures": ["kilos:nonsense"]}, UnknownName), ({"measures": ["nothing:sum"]}, UnknownName),
        ({"measures": ["*:sum"]}, NotAllowed), ({"measures": ["cumsum(kilos:sum)"]}, CadenzaError), ({"measures": ["*:count"], "filters": ["1 < kilos < 3"]}, CadenzaError),
        ({"measures": ["*:count"], "filters": ["kilos:sum > 1 and grade = 'x'"]}, NotAllowed), ({"measures": ["*:count"], "filters": ["nope(kilos) = 1"]}, CadenzaError),
        ({"measures": ["*:count"], "dimensions": ["depots.id"]}, JoinPathError), ({"measures": ["*:count"], "order": ["grade"]}, NotAllowed), ({"measures": ["kilos:sum"], "distinct_dimension_values": False}, NotAllowed),
        ({"measures": ["*:count"], "filters": ["grade = '{who}'"]}, UnknownName), ({"measures": ["ntile(kilos:sum)"], "dimensions": ["grade"]}, CadenzaError), ({"measures": [{"formula": "kilos:sum", "name": "grade"}], "dimensions": ["grade"]}, CadenzaError),
        ({"measures": ["kilos:percentile(p=2)"]}, CadenzaError), ({"measures": ["rank(kilos:sum, partition_by=valley)"], "dimensions": ["grade"]}, CadenzaError),
    ],
)
def test_errors(engine, query, error):
    with pytest.raises(error):
        engine.execute({"source_model": "loads", **query})


def test_definitions_are_checked():
    for bad in (
        {"name": "a__b", "sql_table": "t"}, {"name": "a"}, {"name": "a", "sql_table": "t", "sql": "select 1"}, {"name": "a", "sql_table": "t", "columns": [{"name": "x.y"}]}, {"name": "a", "sql_table": "t", "columns": [{"name": "x", "type": "blob"}]},
        {"name": "a", "sql_table": "t", "columns": [{"name": "x"}], "measures": [{"name": "x", "formula": "*:count"}]}, {"name": "a", "sql_table": "t", "measures": [{"name": "rank", "formula": "*:count"}]}, {"name": "a", "sql_table": "t", "joins": [{"target_model": "b", "join_pairs": [["x", "y"]], "join_type": "full"}]},
    ):
        with pytest.raises(CadenzaError):
            Model.of(bad)
    with pytest.raises(CadenzaError):
        Query.of({"source_model": "a", "order": [{"column": "x", "direction": "up"}]})


def test_derived_columns_may_not_go_in_circles(engine):
    with pytest.raises(CadenzaError, match="circle"):
        engine.add({"name": "loop", "sql_table": "loads", "columns": [{"name": "a", "sql": "b + 1"}, {"name": "b", "sql": "a + 1"}]})


def test_inner_joins_hold_both_ways(spark, tables):
    e = Engine(spark, tables, [{"name": "loads", "sql_table": "loads", "joins": [{"target_model": "hives", "join_pairs": [["hive_id", "id"]], "join_type": "inner"}]}, {"name": "hives", "sql_table": "hives"}])
    assert e.model("hives").join("loads").join_pairs == (("id", "hive_id"),)


def test_grammar():
    assert dsl.parse("sum(revenue)") == dsl.parse("revenue:sum") == dsl.Agg("revenue", "sum")
    assert dsl.parse("a:COUNTD") == dsl.Agg("a", "count_distinct")
    assert dsl.parse("not a in (1, 'b') and c is not null or d like 'x%'") == dsl.Op(
        "or", (dsl.Op("and", (dsl.Op("not", (dsl.In(dsl.Ref("a"), (1, "b"), False),)), dsl.Is(dsl.Ref("c"), None, True))), dsl.Like(dsl.Ref("d"), "x%", False))
    )
    assert dsl.parse("-2 ** 2") == dsl.Op("neg", (dsl.Op("**", (dsl.Lit(2), dsl.Lit(2))),))
    assert dsl.parse("x = 'it''s'") == dsl.Op("=", (dsl.Ref("x"), dsl.Lit("it's")))
    for bad in ("", "a +", "a:sum b", "f(x", "a in (b)", "unknown(1)", "'x"):
        with pytest.raises(CadenzaError):
            dsl.parse(bad)


def test_calendar():
    assert duration("1y2m3w5d6h7min8s") == [(1, "YEAR"), (2, "MONTH"), (3, "WEEK"), (5, "DAY"), (6, "HOUR"), (7, "MINUTE"), (8, "SECOND")]
    assert aligned("month", "year") and not aligned("day", "month") and not aligned("week", "day")
    day = datetime.date(2024, 2, 29)
    assert period_end(day, "quarter") == datetime.date(2024, 3, 31) and period_start(day, "week_sunday") == datetime.date(2024, 2, 25)
    with pytest.raises(CadenzaError):
        duration("0d")


def test_whole_periods(engine):
    assert by_month(engine, "kilos:sum", whole_periods_only=True) == [42, 53]


def test_graphs_of_queries(engine):
    stage = {"name": "per", "source_model": "loads", "dimensions": ["hives.valley"], "measures": [{"formula": "kilos:sum", "name": "held"}, "*:count"]}
    last = {"source_model": "per", "measures": ["held:max", {"formula": "_count:sum", "name": "n"}]}
    assert [tuple(r) for r in engine.execute([stage, last]).df.collect()] == [(99, 7)]
    with pytest.raises(CadenzaError):
        engine.execute([{**stage, "source_model": "per"}, last])
    with pytest.raises(CadenzaError):
        engine.execute([stage, stage, last])


def test_policies(spark, tables):
    rule = ColumnFilterRule("valley", "north", "pass")
    seen = Engine(spark, tables, MODELS, Policy((rule,)))
    assert ask(seen, "hives", "*:count") == [(2,)]
    with pytest.raises(PolicyError):
        ask(Engine(spark, tables, MODELS, Policy((ColumnFilterRule("valley", "north"),))), "loads", "*:count")
    hop = JoinFilterRule("loads", (("hives", (("hive_id", "id"),)),), "valley", "north")
    with pytest.raises(PolicyError):
        Policy((hop,))
    both = Engine(spark, tables, MODELS, Policy((ColumnFilterRule("valley", "north"), hop)))
    assert ask(both, "loads", "kilos:sum") == [(25,)]
    both.add({"name": "raw", "sql": "SELECT * FROM loads"})
    assert ask(both, "raw", "*:count") == [(3,)]
    both.add({"name": "bad", "sql": "DROP TABLE loads"})
    with pytest.raises(PolicyError):
        ask(both, "bad", "*:count")


def test_cache(engine):
    clock = [0.0]
    engine.cache.clock = lambda: clock[0]
    query = {"source_model": "loads", "measures": ["kilos:sum"]}
    config = CacheConfig(ttl_seconds=10, refresh_keys=(("loads", "max(id)"),))
    engine.execute(query, cache=config).rows()
    engine.execute(query, cache=config).rows()
    assert engine.cache.hits == 1
    assert engine.refresh() == 0
    clock[0] = 11
    engine.execute(query, cache=config)
    assert engine.cache.hits == 1 and engine.evict() == 1


def test_ingest_drift_and_store(spark, tables, tmp_path):
    e = Engine(spark, {k: tables[k] for k in ("loads", "hives")})
    report = e.ingest(joins={})
    assert sorted(report.added_models) == ["hives", "loads"] and e.model("loads").column("id").primary_key
    assert e.ingest(joins={}).added_models == []
    e.add({"name": "late", "sql_table": "loads", "columns": [{"name": "kilos"}, {"name": "gone"}, {"name": "twice", "sql": "gone * 2"}], "measures": [{"name": "g", "formula": "gone:sum"}]})
    with pytest.raises(SchemaDrift) as failed:
        e.execute({"source_model": "late", "measures": ["gone:sum"]})
    assert {(d.kind, d.name) for d in failed.value.found} == {("column", "gone"), ("column", "twice"), ("measure", "g")}
    e.apply_drift_deletes(failed.value.found)
    assert [c.name for c in e.model("late").columns] == ["kilos"] and e.validate_models() == []
    e.save_query("all", {"source_model": "loads", "measures": ["*:count"]})
    store.save(e, str(tmp_path))
    again = Engine(spark, e.tables)
    store.load(again, str(tmp_path))
    assert again.models == e.models and again.execute("all").rows() == [{"loads._count": 7}]


def test_profile_and_recommendation(engine):
    rows = {r["column"]: r for r in engine.profile("loads").collect()}
    assert rows["grade"]["values"] == ["light", "comb", "dark"] and rows["grade"].n_distinct == 3
    assert (rows["kilos"].low, rows["kilos"].high) == ("5.0", "40.0")
    assert engine.recommend_root(["loads.kilos:sum", "hives.keeper"]).paths == {"loads.kilos:sum": "kilos:sum", "hives.keeper": "hives.keeper"}
    apart = engine.recommend_root(["loads.kilos", "points.x"])
    assert apart.root is None and {m for m, _ in apart.partial} == {"loads", "points"}


def test_facade(engine):
    got = sql(engine, "SELECT grade, SUM(kilos) AS total FROM loads WHERE hives.valley = 'south' GROUP BY grade ORDER BY total DESC LIMIT 2")
    assert [tuple(r) for r in got.collect()] == [("dark", 70), ("light", 20)]
    made = translate(engine, "SELECT month(taken_at) AS m, row_count FROM loads WHERE taken_at >= '2031-04-01' AND taken_at <= '2031-05-31' GROUP BY 1")
    assert made.query.time_dimensions[0].date_range == ("2031-04-01", "2031-05-31") and made.query.filters == ()
    either = sql(engine, "SELECT COUNT(*) AS n FROM loads AS l WHERE l.grade = 'comb' OR l.grade = 'dark' AND kilos > 35 AND NOT kilos BETWEEN 100 AND 200")
    assert [tuple(r) for r in either.collect()] == [(3,)]
    kept = translate(engine, "SELECT COUNT(*) AS n FROM loads l WHERE grade = 'l.x  AND y' AND kilos BETWEEN 1 AND 2 AND id > 3").query.filters
    assert kept == ("grade = 'l.x  AND y'", "kilos BETWEEN 1 AND 2", "id > 3")
    joined = sql(engine, 'SELECT h.v AS valley, COUNT(*) AS n FROM loads l LEFT JOIN (SELECT id, valley AS v FROM hives) h ON h.id = l.hive_id GROUP BY h."v" ORDER BY n DESC')
    assert [tuple(r) for r in joined.collect()] == [("south", 4), ("north", 3)]
    cast = sql(engine, "SELECT grade, COUNT(*)::text AS n, CAST(MIN(hive_id) AS DOUBLE) AS least FROM loads GROUP BY grade")
    assert [t for _, t in cast.dtypes] == ["string", "string", "double"] and ("comb", "2", 12.0) in [tuple(r) for r in cast.collect()]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM loads", "DELETE FROM loads", "SELECT grade FROM loads GROUP BY valley", "SELECT CAST(grade AS blob) FROM loads", "SELECT CAST(SUM(kilos) AS BIGINT) AS x FROM loads",
        "SELECT CAST(taken_at AS DATE) AS d, COUNT(*) AS n FROM loads GROUP BY d", "SELECT CAST(hive_id AS TEXT) AS h FROM loads ORDER BY h", "SELECT grade FROM loads, hives", "SELECT grade FROM loads JOIN hives ON loads.hive_id = hives.id",
        "SELECT h.keeper FROM loads l LEFT JOIN (SELECT id FROM hives) h ON l.hive_id = h.id", "SELECT grade FROM loads l LEFT JOIN (SELECT id FROM hives WHERE id > 1) h ON l.hive_id = h.id",
        "SELECT grade FROM loads LIMIT x", "SELECT grade FROM loads WHERE grade = 'a' WHERE grade = 'b'", "SELECT grade FROM loads ORDER BY 3", "SELECT grade FROM loads HAVING grade ~ 'x'", "SELECT weight / mean::bigint FROM loads",
    ],
)
def test_facade_refuses(engine, text):
    with pytest.raises(CadenzaError):
        translate(engine, text)


def test_markdown_and_plan(engine):
    out = engine.execute({"source_model": "loads", "measures": ["kilos:sum", "*:count"], "dimensions": ["grade"], "order": ["grade"]}, explain=True)
    assert "| comb | 14.00 | 2 |" in out.markdown() and "Aggregate" in out.plan
    assert "measure weight" in engine.describe("loads")


def test_filters_reach_the_scan(spark, tmp_path, tables):
    tables["loads"].write.parquet(f"{tmp_path}/loads.parquet")
    e = Engine(spark, str(tmp_path), [m for m in MODELS if m["name"] == "loads"])
    plan = e.execute({"source_model": "loads", "measures": ["kilos:sum"], "filters": ["grade = 'dark'"]}, explain=True).plan
    assert "EqualTo(grade,dark)" in plan and "struct<grade:string,kilos:double>" in plan


def test_ranges_reach_every_scan(spark, tmp_path, tables):
    """Trailing windows and shifts read the range they need and no more."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    tables["loads"].write.parquet(f"{tmp_path}/loads.parquet")
    e = Engine(spark, str(tmp_path), [{**m, "joins": [], "columns": m["columns"][:5]} for m in MODELS if m["name"] == "loads"])
    span = {"time_dimensions": [{"dimension": "taken_at", "granularity": "month", "date_range": ["2031-05-01", "2031-05-31"]}]}
    for formula, low, high in (("kilos:sum(window='2m')", "2031-01", "2031-07"), ("time_shift(kilos:sum, -1)", "2031-03", "2031-05"), ("time_shift(kilos:sum, 1, 'year')", "2032-04", "2032-06"), ("time_shift(kilos:sum(window='10d'), -1)", "2031-02", "2031-06")):
        made = e.execute({"source_model": "loads", "measures": [{"formula": formula, "name": "m"}], **span}, explain=True)
        scans = [line for line in made.plan.split("== Physical Plan ==")[1].splitlines() if "FileScan" in line]
        assert len(scans) >= 2 and all("GreaterThanOrEqual(taken_at," in x and "LessThanOrEqual(taken_at," in x for x in scans), formula
        wide = scans[-1]
        assert f"GreaterThanOrEqual(taken_at,{low}" in wide and f"LessThanOrEqual(taken_at,{high}" in wide, wide


@pytest.mark.parametrize("unit", ["DAY", "WEEK", "MONTH", "YEAR", "HOUR", "quarter", "week_sunday"])
def test_widened_ranges_hold_what_they_should(spark, unit):
    from cadenza.functions.calendar import moved_sql, widened

    days = [datetime.date(2023, 12, 31), datetime.date(2024, 1, 31), datetime.date(2024, 2, 29), datetime.date(2024, 3, 30), datetime.date(2025, 8, 31)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for n in (1, -1, 5, -13):
        for r in df.selectExpr("d", f"{moved_sql('d', n, unit.lower())} AS m").collect():
            # A row at r.d, moved to r.m, has to be within the range around r.m moved back.
            low, high = widened(r.m.date(), [(n, unit)], -1), widened(r.m.date(), [(-n, unit)], 1)
            assert low <= r.d <= high


def test_circles_are_found(spark, tables):
    e = Engine(spark, tables, [m for m in MODELS if m["name"] == "hives"])
    e.add({"name": "loads", "sql_table": "loads", "columns": [{"name": "kilos"}], "measures": [{"name": "a", "formula": "b + 1"}, {"name": "b", "formula": "a + 1"}], "joins": [{"target_model": "hives", "join_pairs": [["hive_id", "id"]]}]})
    with pytest.raises(CadenzaError):
        e.execute({"source_model": "loads", "measures": ["a"]})
    e.add({"name": "hives", "sql_table": "hives", "columns": [{"name": "id"}], "joins": [{"target_model": "loads", "join_pairs": [["id", "hive_id"]]}]})
    with pytest.raises(JoinPathError):
        e.execute({"source_model": "loads", "measures": ["*:count"], "dimensions": ["hives.loads.kilos"]})


@pytest.mark.parametrize("p", [0, 0.1, 0.5, 0.9, 1])
def test_percentiles_are_sparks_own(spark, p):
    from cadenza.operators.quantile import quantile

    values = [(k % 3 if k % 3 else None, [(k * 37 % 101) / 7 - 5, 1000.0 + k % 2, -1e12 * (k % 4), 3.0][k % 4] if k % 11 else None) for k in range(400)] + [(9, None), (8, 2.5)]
    df = spark.createDataFrame(values, "k0 long, _value double")

    want = {r.k0: r.v for r in df.where("_value IS NOT NULL").selectExpr("k0", "_value").groupBy("k0").agg(F.expr(f"percentile(_value, {float(p)}D)").alias("v")).collect()}
    got = {r.k0: r.m for r in quantile(df, ["k0"], p, "m").collect()}
    assert got == pytest.approx(want) and len(got) == 4
    assert quantile(df, [], p, "m").first()[0] == pytest.approx(df.selectExpr(f"percentile(_value, {float(p)}D)").first()[0])
