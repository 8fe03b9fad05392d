"""Query trees: parsing, evaluation against a direct model, results."""

import math

import pytest
from pyspark.sql import functions as F

from thicket.plans import querytree as Q

DOCS = [(1, "The cat sat. The cat, the mat!"), (2, "a dog sat on the cat"), (3, "birds only"), (4, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def ql(terms, smoothing, **more):
    return {"type": "scoring_model", "field": "text", "terms": terms, "retrieval_model": {"type": "ql", "smoothing": smoothing}} | more


def run(docs, tree, params=None, n=10, **kw):
    node = Q.parse_node(tree)
    prepared = Q.prepared(docs)
    vocabulary = Q.field_terms(node, "text")
    bg = Q.background(*Q.corpus_statistics(prepared, vocabulary), vocabulary)
    found = Q.score(prepared, {"q": node}, {"p": params or {}}, n, bg, **kw).orderBy("rank").collect()
    return {r.doc_id: r for r in found}


def test_documents_are_normalised(docs):
    got = {r.doc_id: (r.doc_len, r.terms) for r in Q.prepared(docs).collect()}
    assert got[1] == (7, ["the", "cat", "sat", "the", "cat", "the", "mat"])
    assert got[2] == (6, ["dog", "sat", "the", "cat"]) and got[4] == (0, [])


def test_likelihood_with_phrases_and_weights(docs):
    got = run(docs, ql(["the", {"term": "the cat", "weight": 2}], {"type": "dirichlet", "mu": 10}))
    t, the, phrase = 15, 4, 3
    want = {d: math.log((tf + 10 * the / t) / (n + 10)) + 2 * math.log((ph + 10 * phrase / t) / (n + 10)) for d, tf, ph, n in ((1, 3, 2, 7), (2, 1, 1, 6))}
    assert {d: r.ln_score for d, r in got.items()} == pytest.approx(want)
    assert got[1].score == pytest.approx(math.exp(want[1]))


def test_no_smoothing_keeps_documents_with_probability_zero(docs):
    got = run(docs, ql(["mat", "dog"], {"type": "none"}))
    assert {d: r.ln_score for d, r in got.items()} == {1: -math.inf, 2: -math.inf}


def test_sum_scale_if_and_drop(docs):
    base = ql(["cat"], {"type": "jm", "alpha_foreground": 1, "alpha_background": 1}, name="base", record=True)
    tree = {"type": "aggregator", "op": "sum", "children": [{"type": "constant", "value": 1}, {"type": "scale", "scalar": "{{w}}", "child": base}]}
    p = {1: 0.5 * 2 / 7 + 0.5 * 3 / 15, 2: 0.5 / 6 + 0.5 * 3 / 15}
    got = run(docs, tree, {"w": -20})
    assert {d: r.score for d, r in got.items()} == pytest.approx({d: 1 - 20 * x for d, x in p.items()})
    assert list(got) == [2, 1]  # negative scores: the nearer to zero is better
    assert got[1].recorded_values == {"base": pytest.approx(p[1])}
    only_mat = {"type": "if", "terms": ["mat"], "true_child": tree, "false_child": {"type": "drop"}}
    assert list(run(docs, only_mat, {"w": 1})) == [1]
    assert list(run(docs, only_mat | {"negated": True}, {"w": 1})) == [2]
    with pytest.raises(KeyError, match="missing parameter value: w"):
        run(docs, tree)


def test_products_of_tiny_probabilities_keep_their_order(docs):
    many = {"type": "aggregator", "op": "product", "children": [ql([{"term": "cat", "weight": 400}], {"type": "dirichlet", "mu": 10})] * 3}
    both = {"type": "aggregator", "op": "sum", "children": [many, many]}
    got = run(docs, both)
    assert got[1].ln_score > got[2].ln_score and got[1].score == 0
    single = run(docs, many)
    assert got[1].ln_score == pytest.approx(single[1].ln_score + math.log(2))


def test_features_are_recorded_before_their_weight(docs):
    tree = {"type": "feature", "name": "f", "isLog": True, "child": ql(["cat"], {"type": "dirichlet", "mu": 10})}
    got = run(docs, tree, {"f": 3})
    x = math.log((2 + 10 * 3 / 15) / 17)
    assert got[1].recorded_values == {"f": pytest.approx(x)} and got[1].score == pytest.approx(3 * x)


def test_entities(spark, docs):
    tree = {"type": "scoring_model", "field": "freebase_id", "terms": ["/m/1"], "retrieval_model": {"type": "ql", "smoothing": {"type": "none"}}}
    with_entities = docs.withColumn("entities", F.when(F.col("doc_id") == 3, F.create_map(F.lit("/m/1"), F.lit(1).cast("long"))))
    got = Q.score(Q.prepared(with_entities), {"q": Q.parse_node(tree)}, {"p": {}}, 5, Q.Background(0.0), Q.Background(10.0, {"/m/1": 1.0}, 0.05)).collect()
    assert [(r.doc_id, r.score, r.entities) for r in got] == [(3, pytest.approx(0.5), {"/m/1": 1})]


def test_parsing(spark):
    node = Q.parse_node(ql(["Straße!", "of it", {"term": "New York", "weight": 2}], {"type": "none"}))
    assert node.terms == ((("strasse",), 1.0), (("new", "york"), 2.0))
    raw = Q.parse_node(ql(["Straße!", "of it"], {"type": "none"}), raw=True)
    assert raw.terms == ((("Straße",), 1.0), (("of", "it"), 1.0))
    for bad in ({"type": "x"}, {"type": "constant", "value": "w"}, {"type": "aggregator", "op": "max", "children": []}, ql([], {"type": "x"})):
        with pytest.raises(ValueError):
            Q.parse_node(bad)
    tree = {"type": "if", "terms": ["mat"], "true_child": {"type": "scale", "scalar": "{{w}}", "child": ql(["cat"], {"type": "dirichlet", "mu": 3}, name="a", record=True), "name": "s"}, "false_child": {"type": "drop"}}
    assert Q.parse_node(Q.to_json(Q.parse_node(tree))) == Q.parse_node(tree)
    assert Q.parameter_names(Q.parse_node(tree)) == {"w"}
    assert Q.parse_parameters('[{"name": "p", "params": [{"name": "w", "value": 2}]}]') == {"p": {"w": 2.0}}


def test_results_are_written_and_read(spark, docs, tmp_path):
    queries = {"q": Q.parse_node(ql(["the cat", "sat"], {"type": "dirichlet", "mu": 10})), 'say "x"': Q.parse_node(ql(["birds"], {"type": "dirichlet", "mu": 10}))}
    prepared = Q.prepared(docs)
    best = Q.score(prepared, queries, {"p": {}}, 5, Q.Background(15.0))
    results = Q.with_postings(best, docs, queries)
    Q.write_results(results, str(tmp_path / "out"))
    back = {(r.query_id, r.param_set, r["rank"]): r for r in Q.read_results(spark, str(tmp_path / "out")).collect()}
    first = back["q", "p", 1]
    assert set(k[0] for k in back) == set(queries)
    places = {x.term: [(p.token_pos, p.char_pos.begin, p.char_pos.end) for p in x.positions] for x in first.postings}
    assert places == {"sat": [(2, 8, 11)], "the cat": [(0, 0, 6), (3, 13, 19)]} or places["sat"][0][0] == 2
    text = DOCS[0][1]
    assert [text[b : e + 1] for _, b, e in places["the cat"]] == ["The cat", "The cat"]
