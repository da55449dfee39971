"""Imports of foreign definitions: what they become, that it runs, and what is refused."""

import pytest
import yaml

from cadenza.engine import Engine
from cadenza.sources import dbt, osi

#: A lending library: loans of some days, and readers.
DBT = yaml.safe_load("""
semantic_models:
  - name: loans
    model: ref('library', 'fct_loans')
    defaults: {agg_time_dimension: lent_on}
    entities:
      - {name: loan, type: primary, expr: id}
      - {name: reader, type: foreign, expr: reader_id}
    dimensions:
      - {name: shelf, type: categorical}
      - {name: lent_on, type: time, type_params: {time_granularity: day}}
    measures:
      - {name: days_out, agg: sum, expr: days, label: Days out, description: All days, config: {meta: {owner: desk}}}
      - {name: usual, agg: average, expr: days}
      - {name: hours, agg: sum, expr: days * 24}
      - {name: n_loans, agg: count, expr: 1}
      - {name: long_day, agg: percentile, expr: days, agg_params: {percentile: 0.75}}
      - {name: n_long, agg: sum_boolean, expr: days > 20}
      - {name: on_loan, agg: sum, expr: days, non_additive_dimension: {name: lent_on}}
      - {name: lead, agg: sum, expr: days}
  - name: readers
    model: ref('dim_readers')
    entities: [{name: reader, type: primary, expr: id}]
    dimensions: [{name: town, type: categorical}]
    measures: [{name: eldest_age, agg: max, expr: age}]
models:
  - name: fct_loans
  - name: shelves
    description: Where books stand
    columns: [{name: code, data_type: varchar(8), description: Its sign, constraints: [{type: primary_key}]}, {name: metres, data_type: "numeric(8,2)"}]
metrics:
  - {name: days_out, type: simple, type_params: {measure: days_out}}
  - {name: all_days, type: simple, type_params: {measure: {name: days_out}}}
  - {name: hill_days, type: simple, type_params: {measure: days_out}, filter: "{{ Dimension('reader__town') }} = 'Hill'"}
  - {name: late_poems, type: simple, type_params: {measure: n_loans}, filter: ["{{ Dimension('loan__shelf') }} = 'poems'", "{{ TimeDimension('metric_time', 'day') }} >= '2033-02-10'"]}
  - {name: rate, type: ratio, type_params: {numerator: days_out, denominator: n_loans}}
  - {name: hill_part, type: ratio, type_params: {numerator: hill_days, denominator: days_out}}
  - {name: running, type: cumulative, type_params: {measure: days_out}}
  - {name: gain, type: derived, type_params: {expr: days_out - earlier, metrics: [{name: days_out}, {name: days_out, alias: earlier, offset_window: 1 months}]}}
  - {name: mix, type: derived, type_params: {expr: days_out + eldest, metrics: [{name: days_out}, {name: eldest}]}}
  - {name: eldest, type: simple, type_params: {measure: eldest_age}}
  - {name: fortnight, type: cumulative, type_params: {measure: days_out, window: 14 days}}
  - {name: of_fortnight, type: derived, type_params: {expr: fortnight + 1, metrics: [fortnight]}}
  - {name: rate_before, type: derived, type_params: {expr: rate, metrics: [{name: rate, offset_window: 1 month}]}}
  - {name: joined_up, type: conversion, type_params: {}}
  - {name: knot, type: derived, type_params: {expr: 2 * knot, metrics: [knot]}}
""")


def _ansi(expression):
    return {"dialects": [{"dialect": "ANSI_SQL", "expression": expression}]}


OSI = {
    "version": "0.2.0.dev0",
    "semantic_model": [{
        "name": "library",
        "datasets": [
            {
                "name": "loans", "source": "loans", "primary_key": ["id"],
                "fields": [
                    *[{"name": n, "expression": _ansi(n)} for n in ("id", "reader_id", "days")],
                    {"name": "sign", "expression": {"dialects": [{"dialect": "SNOWFLAKE", "expression": "UPPER(shelf)"}]}},
                    {"name": "slice", "expression": {"dialects": [{"dialect": "MDX", "expression": "[s]"}]}},
                    {"name": "lent_on", "expression": _ansi("lent_on"), "dimension": {"is_time": True}},
                ],
            },
            {"name": "readers", "source": "readers", "primary_key": ["id"], "fields": [{"name": n, "expression": _ansi(n)} for n in ("id", "town", "age")]},
        ],
        "relationships": [
            {"name": "taken_by", "from": "loans", "to": "readers", "from_columns": ["reader_id"], "to_columns": ["id"]},
            {"name": "lost", "from": "loans", "to": "shelves", "from_columns": ["x"], "to_columns": ["y"]},
        ],
        "metrics": [
            {"name": name, "expression": _ansi(expression)}
            for name, expression in {
                "whole": "SUM(days)", "n": "COUNT(*)", "rate": "(SUM(days)) / NULLIF(COUNT(*), 0)", "double": "SUM(days * 2)", "n_long": "SUM(CASE WHEN days > 20 THEN 1 ELSE 0 END)",
                "each": "SUM(days) / COUNT(DISTINCT readers.id)", "p80": "PERCENTILE_CONT(0.8) WITHIN GROUP (ORDER BY days)", "mid": "PERCENTILE_CONT(0.5) WITHIN GROUP (ORDER BY days)",
                "reader_days": "SUM(loans.days * readers.age)", "branch": "CASE WHEN SUM(days) > 1 THEN 1 END", "over": "SUM(days) OVER ()", "whose": "COUNT(DISTINCT id)",
            }.items()
        ],
    }],
}


@pytest.fixture(scope="module")
def tables(spark):
    loans = spark.sql("""SELECT * FROM VALUES (1, 'poems', 14D, 1, TIMESTAMP_NTZ'2033-02-04'), (2, 'maps', 21D, 2, TIMESTAMP_NTZ'2033-02-18'), (3, 'poems', 7D, 3, TIMESTAMP_NTZ'2033-03-02'),
        (4, 'tales', 30D, 1, TIMESTAMP_NTZ'2033-03-20'), (5, 'maps', 10D, 2, TIMESTAMP_NTZ'2033-03-25') AS t(id, shelf, days, reader_id, lent_on)""")
    readers = spark.sql("SELECT * FROM VALUES (1, 'Hill', 40D), (2, 'Dale', 65D), (3, 'Hill', 22D) AS t(id, town, age)")
    return {"loans": loans, "fct_loans": loans, "readers": readers, "dim_readers": readers}


def values(spark, tables, made, *measures, **more):
    engine = Engine(spark, tables)
    made.register(engine)
    named = [{"formula": m, "name": m} for m in measures]
    rows = engine.execute({"source_model": "loans", "measures": named, **more}).df.collect()
    return [tuple(r) for r in rows]


def test_dbt_measures_and_metrics(spark, tables):
    made = dbt.convert([DBT])
    formulas = {m.name: m.formula for m in made.models[0].measures}
    assert formulas["days_out"] == "days:sum" and formulas["n_loans"] == "*:count" and formulas["rate"] == "days_out / nullif(n_loans, 0)"
    assert formulas["gain"] == "days_out - time_shift(days_out, -1, 'month')" and formulas["running"] == "cumsum(days_out)"
    assert values(spark, tables, made, "days_out", "all_days", "usual", "hours", "n_loans", "n_long") == [(82, 82, 16.4, 1968, 5, 2)]
    assert values(spark, tables, made, "hill_days", "late_poems", "rate", "mix") == [(51, 1, 16.4, 147)]
    assert values(spark, tables, made, "hill_part", "long_day") == [(pytest.approx(51 / 82), pytest.approx(21))]
    month = {"time_dimensions": [{"dimension": "lent_on", "granularity": "month"}]}
    assert [r[1:] for r in sorted(values(spark, tables, made, "running", "gain", **month))] == [(35, None), (82, 12)]


def test_dbt_models_without_a_semantic_model():
    made = dbt.convert([DBT])
    shelves = next(m for m in made.models if m.name == "shelves")
    assert (shelves.sql_table, shelves.description) == ("shelves", "Where books stand")
    assert [(c.name, c.type, c.primary_key, c.description) for c in shelves.columns] == [("code", "TEXT", True, "Its sign"), ("metres", "DOUBLE", False, None)]
    days = made.models[0].measure("days_out")
    assert (days.label, days.description, days.meta) == ("Days out", "All days", {"owner": "desk"})


def test_dbt_refuses_what_it_cannot_say():
    made = dbt.convert([DBT])
    assert {i.entity: i.category for i in made.issues} == {
        "loans.on_loan": "semi-additive measure", "loans.lead": "name of a transform", "fortnight": "rolling window", "of_fortnight": "input",
        "rate_before": "offset of a composed metric", "joined_up": "metric", "knot": "metric",
    }
    assert made.report().endswith("3 models, 7 unconverted, 0 dropped")


def test_osi_metrics(spark, tables):
    made = osi.convert([OSI])
    loans = next(m for m in made.models if m.name == "loans")
    formulas = {m.name: m.formula for m in loans.measures}
    assert formulas["rate"] == "(days:sum) / nullif(*:count, 0)" and formulas["each"] == "days:sum / readers.id:count_distinct"
    assert formulas["p80"] == "days:percentile(p=0.8)" and formulas["mid"] == "days:median" and loans.default_time_dimension == "lent_on"
    assert values(spark, tables, made, "whole", "n", "rate", "double", "n_long") == [(82, 5, 16.4, 164, 2)]
    assert values(spark, tables, made, "each", "mid", "reader_days") == [(pytest.approx(82 / 3), 14, 14 * 40 + 21 * 65 + 7 * 22 + 30 * 40 + 10 * 65)]


def test_osi_refuses_what_it_cannot_say():
    made = osi.convert([OSI])
    assert {i.entity: i.category for i in made.issues} == {"loans.slice": "dialect", "lost": "join", "branch": "expression", "over": "expression", "whose": "column"}


def test_folders_are_read(tmp_path):
    (tmp_path / "first.yml").write_text(yaml.safe_dump(DBT))
    (tmp_path / "second.json").write_text('{"version": "9", "semantic_model": []}')
    assert [m.name for m in dbt.read(str(tmp_path)).models] == ["loans", "readers", "shelves"]
    assert [i.severity for i in osi.read(str(tmp_path)).issues] == ["info"]
