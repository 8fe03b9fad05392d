"""Incremental indexes and statistics equal those of one batch."""

from thicket.operators import index as I
from thicket.streaming import incremental as S

ROWS = [(1, "the cat sat"), (2, "the dog sat sat"), (3, "a bird"), (4, None)]


def feed(spark, tmp_path, rows):
    src = tmp_path / "in"
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(src))
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 2).parquet(str(src))


def test_an_index_grows_and_is_compacted(spark, tmp_path):
    docs = feed(spark, tmp_path, ROWS)
    q = S.index_stream(docs, str(tmp_path / "index"), str(tmp_path / "check"))
    q.awaitTermination()
    assert len(S.segments(spark, str(tmp_path / "index"))) == 2
    whole = I.build(spark.createDataFrame(ROWS, "doc_id long, text string"))
    for made in (S.open_segments(spark, str(tmp_path / "index")), S.compact(spark, str(tmp_path / "index"), str(tmp_path / "one"), files=1)):
        assert sorted(map(tuple, made.postings.select("term", "doc_id", "tf").collect())) == sorted(map(tuple, whole.postings.collect()))
        assert sorted(map(tuple, made.term_stats.collect())) == sorted(map(tuple, whole.term_stats.collect()))
        assert tuple(made.corpus.first()) == tuple(whole.corpus.first())
    assert len(S.segments(spark, str(tmp_path / "one"))) == 1
    # a batch that runs again replaces its segment
    S.write_batch(spark.createDataFrame(ROWS[:2], "doc_id long, text string"), str(tmp_path / "index"), 0)
    assert len(S.segments(spark, str(tmp_path / "index"))) == 2


def test_statistics_of_a_stream(spark, tmp_path):
    stats = S.term_statistics_stream(feed(spark, tmp_path, ROWS))
    q = stats.writeStream.format("memory").queryName("term_stats_so_far").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    whole = I.build(spark.createDataFrame(ROWS, "doc_id long, text string"))
    assert sorted(map(tuple, spark.table("term_stats_so_far").collect())) == sorted(map(tuple, whole.term_stats.collect()))


def test_top_k_of_a_stream(spark, tmp_path):
    rows = [("q", i, float(i * 7 % 5)) for i in range(6)]
    src = tmp_path / "in"
    for r in rows:
        spark.createDataFrame([r], "query_id string, doc_id long, score double").coalesce(1).write.mode("append").parquet(str(src))
    scored = spark.readStream.schema("query_id string, doc_id long, score double").option("maxFilesPerTrigger", 2).parquet(str(src))
    S.top_k_stream(scored, str(tmp_path / "top"), str(tmp_path / "check"), 2).awaitTermination()
    best = S.latest(spark, str(tmp_path / "top")).orderBy("rank").collect()
    assert [(r.doc_id, r["rank"]) for r in best] == [(2, 1), (5, 2)] or [r.score for r in best] == [4.0, 3.0]


def test_top_k_in_state(spark, tmp_path):
    rows = [("q", i, float(i * 7 % 5)) for i in range(9)] + [("r", 1, 1.0), ("q", 4, None), ("q", None, 9.0), ("q", 2, 4.0), (None, 5, 2.0)]
    src = tmp_path / "in"
    for i in range(0, len(rows), 4):
        spark.createDataFrame(rows[i : i + 4], "query_id string, doc_id long, score double").coalesce(1).write.mode("append").parquet(str(src))
    scored = spark.readStream.schema("query_id string, doc_id long, score double").option("maxFilesPerTrigger", 1).parquet(str(src))
    last = {}

    def note(df, batch):
        fresh = {}
        for r in df.collect():
            fresh.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
        last.update({q: sorted(v) for q, v in fresh.items()})

    S.top_k_state(scored, 3).writeStream.foreachBatch(note).outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert last == {"q": sorted_top(rows, "q", 3), "r": [(1, 1, 1.0)], None: [(1, 5, 2.0)]}


def sorted_top(rows, query, k):
    good = {(d, s) for q, d, s in rows if q == query and d is not None and s is not None}
    return [(i + 1, d, s) for i, (d, s) in enumerate(sorted(good, key=lambda x: (-x[1], x[0]))[:k])]
