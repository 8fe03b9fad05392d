"""What the queries ask for is found once and stored; the texts of winners stay where they are."""

from thicket.plans import querytree as Q

TREE = """[{"name": "q", "child": {"type": "aggregator", "op": "sum", "children": [
  {"type": "scoring_model", "field": "text", "terms": ["the", "and the"], "retrieval_model": {"type": "ql", "smoothing": {"type": "dirichlet", "mu": 5}}},
  {"type": "if", "terms": ["dog"], "true_child": {"type": "constant", "value": 1}, "false_child": {"type": "drop"}}]}}]"""


def test_matched_documents_score_as_prepared_ones(spark):
    docs = spark.createDataFrame([(1, "the dog and the cat"), (2, "the cat"), (3, "dog, the and the dog"), (4, None)], "doc_id long, text string")
    queries = Q.parse_queries(TREE)
    words = Q.field_terms(queries["q"], "text")
    got = []
    for made in (Q.prepared(docs), Q.matched(Q.prepared(docs), queries)):
        stats, corpus = Q.corpus_statistics(made, words)
        assert {r.term: (r.df, r.cf) for r in stats.collect()} == {"the": (3, 5), "and the": (2, 2)}
        best = Q.score(made, queries, {"p": {}}, 5, Q.background(stats, corpus, words))
        got.append([(r.doc_id, r.rank, r.score) for r in best.orderBy("rank").collect()])
    assert got[0] == got[1] and len(got[0]) == 2
    assert "text" not in made.columns and "terms" not in made.columns
    plan = Q.with_postings(best, docs, queries)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
