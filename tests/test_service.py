"""Notes, search over entities, inspection, dry runs, the catalog by SQL, and drift of models over SQL."""

import pytest

from cadenza.cache import CacheConfig
from cadenza.engine import Engine
from cadenza.errors import CadenzaError, NotAllowed, UnknownName
from cadenza.facade import run as sql
from cadenza.notes import Notes, resolve


@pytest.fixture
def engine(spark):
    tables = {
        "boats": spark.createDataFrame([(1, "cutter", 9.5), (2, "ketch", 12.0), (3, "cutter", 8.0), (4, None, 3.0)], "id long, rig string, length double"),
        "trips": spark.createDataFrame([(1, 1, 4), (2, 1, 7), (3, 2, 2)], "id long, boat_id long, miles int"),
    }
    models = [
        {"name": "boats", "sql_table": "boats", "description": "Sailing vessels of the club", "columns": [{"name": "id", "primary_key": True}, {"name": "rig", "description": "Arrangement of masts"}, {"name": "length", "meta": {"unit": "m"}}]},
        {
            "name": "trips", "sql_table": "trips", "columns": [{"name": "miles", "label": "Distance sailed"}], "measures": [{"name": "sailed", "formula": "miles:sum", "description": "Distance of all voyages"}],
            "joins": [{"target_model": "boats", "join_pairs": [["boat_id", "id"]]}],
        },
        {"name": "long_trips", "sql": "SELECT boat_id, miles FROM trips WHERE miles > 3", "columns": [{"name": "miles"}]},
    ]
    return Engine(spark, tables, models)


def test_notes_are_kept_replaced_and_forgotten(engine, tmp_path):
    notes = Notes(engine, f"{tmp_path}/notes")
    assert notes.all().count() == 0
    one = notes.save("Voyages before 1950 lack miles", ["trips.miles", "BOATS"])
    notes.save("Rigs were surveyed twice", ["rig"], id="survey")
    assert {r.id: r.entities for r in notes.all().collect()} == {one: ["trips.miles", "boats"], "survey": ["boats.rig"]}
    notes.save("Rigs were surveyed three times", ["rig"], id="survey")
    assert [r.text for r in notes.all().where("id = 'survey'").collect()] == ["Rigs were surveyed three times"]
    notes.forget(one)
    assert [r.id for r in notes.all().collect()] == ["survey"]
    for bad in (lambda: notes.forget(one), lambda: notes.save("x", ["nowhere"]), lambda: notes.save(" ", [])):
        with pytest.raises(CadenzaError):
            bad()
    del engine.models["boats"]
    assert [r.entities for r in notes.all().collect()] == [[]]


def test_names_are_resolved(engine):
    assert resolve(engine, "Trips:Sailed") == "trips.sailed" and resolve(engine, "boats") == "boats" and resolve(engine, "length") == "boats.length"
    for bad in ("miles", "mast"):  # two models have miles
        with pytest.raises(UnknownName):
            resolve(engine, bad)


def test_search_joins_its_channels(spark, engine, tmp_path):
    notes = Notes(engine, f"{tmp_path}/notes")
    key = notes.save("Logbooks of voyages are incomplete", ["trips.miles"])
    found = [r.id for r in engine.search("distance of voyages", notes=notes, about=["trips.miles"]).collect()]
    assert found[0] == f"memory:{key}" and {"trips.sailed", "trips.miles"} <= set(found)
    assert [r.kind for r in engine.search("distance", kinds=["Measure"]).collect()] == ["Measure"]
    inside = engine.search("distance of voyages", notes=notes, pattern="MATCH (m:Model {id: 'trips'})-[:CONTAINS]->(c:Measure) RETURN c.id AS id")
    assert [r.id for r in inside.collect()] == ["trips.sailed"]
    vectors = spark.createDataFrame([("boats", [1.0, 0.0]), ("trips", [0.6, 0.8])], "id string, embedding array<double>")
    assert [r.id for r in engine.search("nothing like it", vector=[1.0, 0.1], embeddings=vectors).collect()] == ["boats", "trips"]


def test_inspection(engine):
    model = engine.inspect("trips")
    assert model["joins"] == {"boats": ["boats"]} and model["measures"] == {"sailed": "miles:sum"} and model["columns"] == {"miles": "INT"}
    rig = engine.inspect("boats.rig")
    assert rig["values"][0] == "cutter" and len(rig["values"]) == 3 and rig["description"] == "Arrangement of masts" and "sum" not in rig["aggregations"]
    assert engine.inspect("boats.id")["aggregations"] == ["count", "count_distinct", "count_distinct_approx"]
    assert engine.inspect("trips.sailed")["uses"] == ["miles"] and engine.inspect("boats.length")["meta"] == {"unit": "m"}
    with pytest.raises(UnknownName):
        engine.inspect("boats.sail")


def test_a_dry_run_tells_columns_and_plan(engine):
    out = engine.dry_run({"source_model": "trips", "measures": ["sailed", "*:count"], "dimensions": ["boats.rig"]})
    assert [(c["name"], c["type"]) for c in out["columns"]] == [("trips.boats.rig", "string"), ("trips.miles_sum", "bigint"), ("trips._count", "bigint")]
    assert "Aggregate" in out["plan"]


def test_the_catalog_by_sql(engine):
    got = sql(engine, "SELECT c.column_name, t.table_type FROM information_schema.columns c JOIN INFORMATION_SCHEMA.TABLES t USING (table_name) WHERE table_name = 'boats' AND c.data_type <> '{x}' ORDER BY ordinal_position")
    assert [tuple(r) for r in got.collect()] == [("id", "SEMANTIC MODEL"), ("rig", "SEMANTIC MODEL"), ("length", "SEMANTIC MODEL")]
    assert sql(engine, "SELECT formula FROM information_schema.metrics WHERE metric = 'sailed'").first()[0] == "miles:sum"
    for bad in ("SELECT * FROM information_schema.secrets", "DROP TABLE information_schema.tables"):
        with pytest.raises(NotAllowed):
            sql(engine, bad)


def test_drift_of_models_over_sql(spark, engine):
    assert engine.validate_models() == []
    engine.tables = type(engine.tables)(spark, {"boats": spark.createDataFrame([(1, "x", 1.0)], "id long, rig string, length double"), "trips": spark.createDataFrame([(1, 1)], "id long, boat_id long")})
    found = {(d.model, d.kind) for d in engine.validate_models()}
    assert ("long_trips", "sql") in found and ("trips", "column") in found and ("trips", "measure") in found


def test_the_cache_is_bounded(engine):
    engine.cache.most = 2
    for k in range(4):
        engine.execute({"source_model": "trips", "measures": ["*:count"], "filters": [f"miles > {k}"]}, cache=CacheConfig())
    assert len(engine.cache.entries) == 2
    engine.evict()
