"""The forest's rows are chosen by hash over all labelled rows, not by the smallest ids."""

from pyspark.sql import functions as F

from thicket.llm import quality as Q


def test_fit_rows_are_spread_over_the_ids(spark, monkeypatch):
    seen = []
    whole = Q.features
    monkeypatch.setattr(Q, "FIT_ROWS", 50)
    monkeypatch.setattr(Q, "features", lambda rows: seen.append(rows["doc_id"].tolist()) or whole(rows))
    ids = spark.range(400).withColumnRenamed("id", "doc_id")
    stats = ids.select("doc_id", *(F.lit(100 if c == "n_words" else 1).cast("long").alias(c) for c in Q.COUNTS + Q.EXTRA))
    Q.fit(stats, ids.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1).alias("quality")))
    good = [d for d in seen[0] if d % 10][:50]
    assert max(good) > 300 and good != sorted(good)
