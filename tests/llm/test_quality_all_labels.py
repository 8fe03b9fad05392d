"""The cut-off is set on all labelled rows, not on a sample of them."""

import numpy as np
from pyspark.sql import functions as F

from thicket.llm import quality as Q


def test_cut_off_is_the_best_over_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(Q, "LABEL_ROWS", 150, raising=False)
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    noise = {c: (F.pmod(F.xxhash64(F.lit(c), "doc_id"), F.lit(40)) + 1).cast("long") for c in Q.COUNTS + Q.EXTRA}
    noise |= {"n_words": F.lit(100).cast("long"), "word_chars": F.lit(500).cast("long")}
    noise["n_symbols"] = noise["n_symbols"] + F.when(F.col("doc_id") % 10 == 0, 60).otherwise(0)
    stats = ids.select("doc_id", *(v.alias(c) for c, v in noise.items()))
    labels = ids.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1).alias("quality"))
    forest, cut = Q.fit(stats, labels)
    table = Q.as_arrays(stats.where(~Q.base_failed()))
    score, good = forest.score(Q.features(table)), table["doc_id"] % 10 > 0

    def gain(at):
        rejected = (score[good] > at).mean()
        return (score[~good] > at).mean() - rejected if rejected <= Q.FALSE_REJECTS else -1

    assert gain(cut) >= max(gain(at) for at in np.unique(np.ceil(score * 1e6) / 1e6)) - 1e-9
