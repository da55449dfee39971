"""Graph filters: patterns, and their results on a small catalog."""

import pytest

from cadenza import graph, search
from cadenza.engine import Engine
from cadenza.errors import NotAllowed


@pytest.fixture(scope="module")
def catalog(spark):
    tables = {"orders": spark.createDataFrame([(1, 1, 5.0)], "id long, who long, amount double"), "people": spark.createDataFrame([(1, 1)], "id long, region long"), "regions": spark.createDataFrame([(1,)], "id long")}
    models = [
        {"name": "regions", "sql_table": "regions", "columns": [{"name": "id"}]},
        {"name": "people", "sql_table": "people", "columns": [{"name": "id"}], "joins": [{"target_model": "regions", "join_pairs": [["region", "id"]]}]},
        {"name": "orders", "sql_table": "orders", "columns": [{"name": "amount"}], "measures": [{"name": "total", "formula": "amount:sum"}], "joins": [{"target_model": "people", "join_pairs": [["who", "id"]]}]},
    ]
    notes = spark.createDataFrame([(1, ["orders", "orders.amount", "orders"]), (2, ["people"]), (3, None), (4, []), (None, ["orders"]), (1, ["orders"])], "id long, entities array<string>")
    return Engine(spark, tables, models), notes


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("MATCH (n:Measure:Model) RETURN n.id AS id", ["orders", "orders.total", "people", "regions"]),
        ("match (n:column {name: 'id'}) return n.id as id", ["people.id", "regions.id"]),
        ("MATCH (m:Memory)-[:MENTIONS]->(n:Model {id: 'orders'}) RETURN m.id AS id", ["memory:1"]),
        ("MATCH (m:Memory) RETURN m.id AS id", ["memory:1", "memory:2", "memory:3", "memory:4"]),
        ("MATCH (a:Model {id: 'orders'})-[:JOINS*1..3]->(b) RETURN b.id AS id", ["people", "regions"]),
        ("MATCH (a:Model {id: 'orders'})-[:JOINS*2]->(b) RETURN b.id AS id", ["regions"]),
        ("MATCH (a:Model {id: 'people'})<-[:JOINS|CONTAINS]-(b) RETURN b.id AS id", ["orders"]),
        ("MATCH (m:Memory)-[:MENTIONS]->(a:Model)-[:CONTAINS]->(c:Measure) RETURN a.id AS id", ["orders"]),
        ("MATCH (m:Memory)-[:MENTIONS]->(a)-[:JOINS]->(b {id: 'regions'}) RETURN m.id AS id", ["memory:2"]),
        ("MATCH (d:Datasource) RETURN d.id AS id", []),
    ],
)
def test_patterns(catalog, text, ids):
    assert sorted(r.id for r in graph.select(catalog[0], text, catalog[1]).collect()) == ids


@pytest.mark.parametrize(
    "text",
    [
        "MATCH (n) RETURN n", "MATCH (n) RETURN m.id AS id", "MATCH (n:Nothing) RETURN n.id AS id", "MATCH (n) RETURN n.id AS id; DROP x", "CREATE (n) RETURN n.id AS id",
        "MATCH (a)-[:LIKES]->(b) RETURN a.id AS id", "MATCH (a)-[:JOINS*1..9]->(b) RETURN a.id AS id", "MATCH (a)-[:JOINS]-(b) RETURN a.id AS id",
        "MATCH (a)-[:JOINS]->(a) RETURN a.id AS id", "MATCH (a {size: 3}) RETURN a.id AS id", "MATCH (a) WHERE a.id = 'x' RETURN a.id AS id",
    ],
)
def test_other_patterns_are_refused(text):
    with pytest.raises(NotAllowed):
        graph.parse(text)


def test_ranked_notes_within_a_pattern(catalog):
    engine, notes = catalog
    ranked = search.tag_search(notes.where("id IS NOT NULL").selectExpr("concat('memory:', id) AS id", "entities"), ["orders", "people"])
    some = graph.select(engine, "MATCH (m:Memory)-[:MENTIONS]->(n:Model {id: 'people'}) RETURN m.id AS id", notes)
    assert [r.id for r in graph.within(ranked, some).collect()] == ["memory:2"]


def test_without_notes_or_models(spark):
    assert graph.select(Engine(spark), "MATCH (a)-[:JOINS]->(b) RETURN b.id AS id").collect() == []


def test_hops_without_an_end(spark):
    names = [f"m{k}" for k in range(9)]
    links = {n: names[(k + 1) % 9] for k, n in enumerate(names)}  # a ring
    models = [{"name": n, "sql_table": "t", "columns": [{"name": "id"}], "joins": [{"target_model": links[n], "join_pairs": [["id", "id"]]}]} for n in names]
    e = Engine(spark, {"t": spark.range(1)}, models)
    ask = lambda many: sorted(r.id for r in graph.select(e, f"MATCH (a:Model {{id: 'm0'}})-[:JOINS*{many}]->(b) RETURN b.id AS id").collect())
    assert ask("") == ask("1..") == ask("3..") == names
    assert ask("2..3") == ["m2", "m3"]


def test_hops_without_an_end_reach_notes(catalog):
    e, notes = catalog
    ask = lambda text: sorted(r.id for r in graph.select(e, text, notes).collect())
    assert ask("MATCH (m:Memory {id: 'memory:1'})-[*]->(b:Model) RETURN b.id AS id") == ["orders", "people", "regions"]
    assert ask("MATCH (m:Memory)<-[]-(b) RETURN b.id AS id") == []
    assert ask("MATCH (r:Model {id: 'regions'})<-[*]-(m:Memory) RETURN m.id AS id") == ["memory:1", "memory:2"]
    assert ask("MATCH (r:Model {id: 'regions'})<-[*3..]-(m:Memory) RETURN m.id AS id") == ["memory:1"]
