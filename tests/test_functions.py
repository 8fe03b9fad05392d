"""Column expressions one by one, and small folds."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from thicket.functions import text as X
from thicket.operators import aggregates as A
from thicket.plans import querytree as Q


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_strings(spark):
    assert one(spark, X.blank_out(F.lit("a-b.c"), "-.")) == "a b c"
    assert one(spark, X.strip_punctuation(F.lit("it's 1.5%!"))) == "it's 1.5  "
    assert one(spark, X.letters_only(F.lit("Äb1-ß"))) == "äbss"
    assert one(spark, X.strip_stream_time(F.lit("123-abc-d"))) == "abc-d" and one(spark, X.strip_stream_time(F.lit("abc"))) == ""
    assert one(spark, X.looks_like_html(F.lit("  <!DOCTYPE html>"))) and not one(spark, X.looks_like_html(F.lit("x" * 200 + "<html")))
    assert one(spark, X.latin1_fallback(F.lit(bytearray("ä".encode())))) == "ä"
    assert one(spark, X.latin1_fallback(F.lit(bytearray(b"\xe4")))) == "ä"
    assert one(spark, X.index_words(F.lit("The House, of it " + "x" * 100))) == ["house"]


def test_logarithms(spark):
    assert one(spark, X.ln(F.lit(0.0))) == -math.inf and one(spark, X.ln(F.lit(-1.0))) is None
    assert one(spark, X.scientific(F.lit(math.log(1234.5)))) == "1.2345000000000e3"
    assert one(spark, X.scientific(F.lit(-5000.0), 5)) == "3.3697e-2172"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(2.0))
    assert one(spark, X.vector_dot(a, b)) == 11 and one(spark, X.vector_norm(a)) == 5
    assert one(spark, X.vector_unit(a)) == [0.6, 0.8] and one(spark, X.vector_scale(a, 2)) == [6, 8]
    assert [one(spark, X.vector_zip(a, b, op)) for op in "+-*/"] == [[4, 6], [2, 2], [3, 8], [3, 2]]
    assert one(spark, X.vector_unit(F.array(F.lit(0.0)))) == [0]


def test_positions_join(spark):
    at = "struct<token_pos:int,char_pos:struct<begin:int,end:int>>"
    merged = one(spark, X.merge_positions(F.from_json(F.lit('[{"token_pos":4,"char_pos":{"begin":9,"end":12}},{"token_pos":3,"char_pos":{"begin":2,"end":7}}]'), f"array<{at}>")))
    assert (merged.token_pos, merged.char_pos.begin, merged.char_pos.end) == (3, 2, 12)


def test_python_folds(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 3), ("b", 5)], "k string, v long")
    got = A.python_fold(rows, ("k",), lambda p: pd.DataFrame({"k": [p.k.iloc[0]], "product": [p.v.prod()]}), "k string, product long")
    assert {tuple(r) for r in got.collect()} == {("a", 6), ("b", 5)}
    assert {r.k: r.s for r in A.keyed_fold(rows, ("k",), s=F.sum("v")).collect()} == {"a": 5, "b": 5}


@pytest.mark.parametrize("a,b", [(3.0, -5.0), (0.0, 2.0), (-1.0, 1.0), (0.0, 0.0)])
def test_signed_logarithms(spark, a, b):
    x, y = Q._literal(a), Q._literal(b)
    assert one(spark, Q.linear(Q._sum([x, y]))) == pytest.approx(a + b)
    assert one(spark, Q.linear(Q._product([x, y]))) == pytest.approx(a * b)
