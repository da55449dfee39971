"""The pipeline and the queries over a small folder of tables."""

import pytest
from test_operators import brute_classes, brute_contamination, brute_lines, brute_lm, classified, near_corpus, prose, water_fill

import corpus_pipeline
from cadenza.llm import pii, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of which some are toxic, share lines, are near copies or hold a benchmark passage."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs, labels = classified(spark, "toxic")
    docs = docs.where("doc_id < 900")
    line = "a line of more than twenty letters"
    more = [(10000 + i, t, s) for i, t, s in near_corpus() if i is not None and t and i > 9]
    more += [(20000 + k, f"{prose(500 + k, 40, 5000)}\n{line}", "b") for k in range(5)]
    more += [(30000 + k, f"{prose(600 + k, 30, 5000)} {prose(2, 30)}", "b") for k in range(3)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, s, 0, "x", "y", 1, 2) for i, t, s in more], docs.schema))
    docs.write.parquet(f"{out}/documents.parquet")
    labels.write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, prose(2, 30))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def rows(spark, folder):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_pipeline_rejects_what_op10_predicts_toxic(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r.doc_id for r in queries.op10_toxicity(spark, folder).collect() if r.predicted}
    kept = {r.doc_id for r in corpus_pipeline.toxicity_stage(spark, docs, folder).collect()}
    assert toxic and not kept & toxic and kept | toxic == {i for i, _, _ in rows(spark, folder)}
    assert corpus_pipeline.TOXIC == queries.THRESHOLD


def test_run_against_a_brute_chain(spark, folder):
    score = {r.doc_id: r.score for r in queries.op10_toxicity(spark, folder).collect()}
    docs = [d for d in rows(spark, folder) if score[d[0]] < 0.3]
    kept = {i: text for i, _, _, text in brute_lines(docs)}
    lined = [(i, kept[i], s) for i, _, s in docs]
    assert {20000, 20001, 20002, 20003} <= {a[0] for a, b in zip(docs, lined, strict=True) if a != b}
    near = brute_classes(lined)
    alone = [d for d in lined if near[d[0]][1] == d[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {i for i, _, n, _ in brute_contamination(alone, items) if n}
    clean = [d for d in alone if d[0] not in hit]
    assert len(docs) > len(alone) > len(clean) and {30000, 30001, 30002} <= hit
    got = queries.queries()["pipeline"](spark, folder).collect()
    assert sorted((r.doc_id, r.source, r["size"]) for r in got) == sorted((i, s, len(t.split())) for i, t, s in clean)
    total = {}
    for _, t, s in clean:
        total[s] = total.get(s, 0) + len(t.split())
    goal = water_fill(total, (3, 1, 2))
    for s, want in goal.items():
        own = [r for r in got if r.source == s]
        assert all(r.source_size == total[s] and r.target == pytest.approx(want) and r.taken == r.copies * r["size"] for r in own)
        assert abs(sum(r.taken for r in own) - want) <= max(r["size"] for r in own)


def test_queries_without_oracle(spark, folder):
    docs = rows(spark, folder)
    made = {n: {r.doc_id: r for r in f(spark, folder).collect()} for n, f in queries.queries().items() if n[:4] in ("op2_", "op4_", "op7_")}
    assert all(len(x) == len(docs) for x in made.values())
    for i, n, total in brute_lm(docs):
        r = made["op7_lm_scores"][i]
        assert r.n_words == n and r.log10_sum == pytest.approx(total, abs=6e-4) and r.score == pytest.approx(total / n, abs=6e-7)
    for i, text, _ in docs:
        out, found = pii.pseudonymise(text, queries.PII_KEY)
        r = made["op4_pii"][i]
        assert (r.text, r.n_found) == (out, len(found))
        assert made["op2_mixing"][i]["size"] == len(text.split())


@pytest.mark.parametrize("docs", [[], [(None, None, "x", None, 0), (1, "", "x", "a", 0), (1, "some words here", "x", "a", 15), (2, None, "x", "b", None), (None, "a b c d e f", "x", None, 11)]])
def test_run_on_empty_tables_and_odd_rows(spark, tmp_path, docs):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.source), r["size"]) for r in got) == sorted((str(i), str(s), len((t or "").split())) for i, t, _, s, _ in docs)
