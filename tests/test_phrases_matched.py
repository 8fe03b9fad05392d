"""Matches alone, without rows of the tokens outside; batches in parts of bounded size."""

import pyarrow as pa
import pytest

from thicket.functions.batches import parts
from thicket.operators import phrases as P


def test_parts_are_bounded_and_whole():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([["a"] * 3, None, [], ["b"] * 50, ["c"], ["d"] * 9])], ["doc_id", "tokens"])
    made = list(parts(batch, 1, 10))
    assert pa.Table.from_batches(made).to_pylist() == batch.to_pylist()
    assert len(made) > 2 and all(p.num_rows == 1 or sum(len(t or []) for t in p.column(1).to_pylist()) <= 10 for p in made)


@pytest.mark.parametrize("find", [P.longest_matches, P.longest_joined])
def test_matched_rows_are_those_with_a_phrase(spark, monkeypatch, find):
    monkeypatch.setattr(P, "PART_TOKENS", 4)
    docs = spark.createDataFrame([(1, "the of the of the x and the".split()), (2, ["x"]), (3, None), (1, ["and", "the"]), (4, ["the", "of"])], "doc_id long, tokens array<string>")
    table = P.phrase_table(spark, {"a": ("of", "the"), "b": ("the", "of", "the"), "c": ("and", "the"), "d": ("the",)})
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(find(docs, table, matched=True)) == rows(find(docs, table).where("phrase_id is not null"))
