"""Every query on nulls in all columns, repeated rows, a very long text, clashing extra columns and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from thicket.llm import registry

CLASH = "size source_size target taken copies fp key node n keys w0 a b table norm words score label detections toxic bin capacity offset start piece tag data part id image n_links rank root at line".split()
PAGES = ("op3_media", "op4_lines", "op8_warc")


def tables(spark, path, extra):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["river", "stone", "license", "MIT", "grub#"]) + str(rng.randrange(40)) for _ in range(n))
    shared = text(80)
    docs = [(i, text(rng.randrange(1, 120)), "en", rng.choice(["s", "t", None]), 5) for i in range(40)]
    docs += [(100, shared, "en", "s", 1), (101, shared, "en", "s", 1), (101, shared, "en", "s", 1), (102, shared + " more", None, None, None)]
    docs += [(None, None, None, None, None), (None, shared, None, None, None), (103, "", "", "", 0), (104, text(60_000), "en", "t", None), (105, " \n\t", None, "s", 3)]
    pages = [(i, f"http://h/{i}", f"<p>{text(60)}</p>") for i in range(12)] + [(20, None, None), (None, None, None), (21, "u", ""), (22, "u", "<p>" + text(300)), (22, "u", "<p>x"), (None, "u", "<p>" + text(250))]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(30)] + [(None, None, None), (31, None, 1), (100, 1, None), (101, 0, 0), (101, 1, 1)]
    made = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "pages": spark.createDataFrame(pages, "page_id long, url string, html string"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    }
    for name, df in made.items():
        if extra:
            for i, c in enumerate(c for c in CLASH if c not in df.columns):
                df = df.withColumn(c, [F.lit("own"), F.lit(None).cast("long"), F.array(F.lit(1))][i % 3])
        df.coalesce(2).write.parquet(f"{path}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{path}/empty/{name}.parquet")
    return {name: df.count() for name, df in made.items()}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    plain, extra = (str(tmp_path_factory.mktemp(n)) for n in ("plain", "extra"))
    counts = tables(spark, plain, False)
    tables(spark, extra, True)
    return plain, extra, counts


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_defined_results(spark, folders, name):
    plain, extra, counts = folders
    query = registry.queries()[name]
    first = query(spark, f"{plain}/full")
    rows = sorted(map(str, first.collect()))
    if name != "op5_packing":
        assert len(rows) == counts["pages" if name in PAGES else "documents"]
    assert rows == sorted(map(str, query(spark, f"{extra}/full").collect()))
    assert query(spark, f"{plain}/empty").count() == 0 and query(spark, f"{plain}/empty").columns == first.columns


def test_defined_values(spark, folders):
    """What the docstrings say of nulls, empty texts and repeated rows."""
    run = lambda name: registry.queries()[name](spark, f"{folders[0]}/full").collect()
    sizes = {(r.doc_id, r.size) for r in run("op1_mixing")}
    assert {(103, 0), (105, 0), (None, 0), (104, 60_000)} <= sizes
    empty = [r for r in run("op2_simhash") if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in empty} == {103, 105, None} and {r.component_id for r in empty} == {103}
    page = [r for r in run("op4_lines") if r.page_id in (20, 21)]
    assert {(r.page_id, r.host, r.n_lines, r.kept_chars) for r in page} == {(20, None, 0, 0), (21, "", 1, 0)}
    assert {(r.bin, r.capacity) for r in run("op5_packing") if r["size"] == 0} == {(None, None)}
    licence = {r.doc_id: r for r in run("op6_licenses")}
    assert (licence[103].n_words, licence[103].first_word, licence[103].labels, licence[103].score) == (0, None, "", 0.0)
    scores = {r.doc_id: r for r in run("op7_toxicity")}
    assert scores[103].score == scores[105].score and not scores[None].held_out
    assert {(r.payload_bytes, r.record_type, r.refers_to) for r in run("op8_warc") if r.page_id in (20, 21)} == {(0, "response", None)}
    cut = [r for r in run("op9_repeats") if r.doc_id in (100, 101, 103)]
    assert {(r.doc_id, r.n_removed == r.n_bytes) for r in cut} == {(100, False), (101, True), (103, True)}
    judged = {r.doc_id: r for r in run("op10_quality")}
    assert judged[103].base_failed and not judged[103].kept and judged[104].n_words == 60_000
