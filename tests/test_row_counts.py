"""Counts of a row's terms are made where the row is read; what is shuffled doesn't grow with terms x documents."""

import pytest
from pyspark.sql import functions as F

from thicket.operators import index as I
from thicket.operators import models as M
from thicket.operators import ranking as R
from thicket.operators import vectors as V

TEXTS = [(1, "the cat sat on the mat"), (2, "the dog"), (3, None), (4, ""), (5, "dog dog ẞ Straße naïve"), (6, "the dog")]
SCHEMA = "doc_id long, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(params=[False, True], ids=["each once", "repeated"])
def docs(request, spark):
    return spark.createDataFrame(TEXTS + ([(1, "the end"), (2, "dog"), (None, "a cat and a dog")] if request.param else []), SCHEMA)


def test_frequencies_are_those_of_the_exploded_terms(docs):
    assert rows(I.frequencies(docs)) == rows(I.term_frequencies(I.term_rows(docs)))
    exploded = R.rank(I.term_frequencies(I.term_rows(docs)), 2, by=("doc_id",), score="tf", tie=("term",))
    assert rows(I.top_terms(docs, 2)) == rows(exploded)


def test_frequencies_and_top_terms_shuffle_nothing(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    assert "Exchange" not in plan(I.frequencies(docs)) and "Exchange" not in plan(I.top_terms(docs, 3))


def test_index_of_some_terms(docs):
    whole, some = I.build(docs), I.build_for(docs, ["the", "dog", "none"])
    asked = F.col("term").isin("the", "dog")
    assert rows(some.postings.select("term", "doc_id", "tf")) == rows(whole.postings.where(asked).select("term", "doc_id", "tf"))
    assert rows(some.term_stats) == rows(whole.term_stats.where(asked)) and rows(some.corpus) == rows(whole.corpus)


def test_best_of_many_queries_are_those_of_all_scores(spark, docs):
    texts = docs.union(spark.createDataFrame([(100 + i, "the cat " * (i % 3 + 1) + "dog " * (i % 2)) for i in range(60)], SCHEMA))
    queries = M.query_rows(spark, {"a": ["the", "cat"], "b": ["dog", "none"], "c": ["none"], "d": ["dog", "the", "cat"]})
    built = I.build_for(texts, ["the", "cat", "dog", "none"])
    first = lambda scores: R.rank(scores.withColumn("score", F.round("score", 9)), 4)
    assert rows(first(M.bm25_best(built, queries, 4))) == rows(first(M.bm25(I.build(texts), queries)))
    if built.rows is not None:
        assert M.bm25_best(built, queries, 4).count() < M.bm25(built, queries).count() / 2


def test_vectors_are_added_up_in_the_row(spark, monkeypatch):
    embedding = spark.createDataFrame([("the", [1.0, 2.0]), ("dog", [0.5, None]), ("dog", [1.0, 1.0]), (None, [9.0, 9.0])], "term string, vec array<float>")
    docs = spark.createDataFrame([(1, ["the", "dog", "the", None]), (2, []), (3, None), (4, ["dog"] * 50)], "doc_id long, terms array<string>")
    want = {1: [3.5, 5.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [75.0, 50.0]}
    made = V.embed_terms(docs, embedding)
    assert {r.doc_id: r.vec for r in made.collect()} == want and "Exchange" not in plan(made)
    monkeypatch.setattr(V, "BLOCK_VALUES", 8)  # the long row in several blocks
    assert {r.doc_id: r.vec for r in V.embed_terms(docs, embedding).collect()} == want
    assert {r.doc_id: r.vec for r in V.embed_terms(docs.union(docs), embedding).collect()} == {k: [2 * x for x in v] for k, v in want.items()}
