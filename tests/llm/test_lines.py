"""Line dedup against a plain count."""

import random

import pytest
from pyspark.sql import functions as F

from thicket.llm import lines as L

WHITE = " \t\n\r\x0b\x0c"


def brute(rows, ratio=L.RATIO, least=L.MIN_PAGES):
    pages: dict = {}
    for _, site, text in rows:
        if text is not None:
            pages.setdefault(site, set()).add(text)
    common: dict = {}
    for site, texts in pages.items():
        count: dict = {}
        for t in texts:
            for line in {x.strip(WHITE) for x in t.split("\n")} - {""}:
                count[line] = count.get(line, 0) + 1
        common[site] = {x for x, n in count.items() if n >= least and n > ratio * len(texts)}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x.strip(WHITE) not in common[s] or not x.strip(WHITE)) for _, s, t in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_boilerplate_goes_from_its_site_alone(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        site = rng.choice(["a", "a", "b", None])
        own = [f"line {rng.randrange(10_000)} of {i}" for _ in range(4)]
        if rng.random() < 0.5:
            own.insert(rng.randrange(5), rng.choice(["  Menu \r", "Menu", "\tHome | About", ""]))
        rows.append((i, site, "\n".join(own)))
    rows += [(150 + i, "c", "copy\nof a page") for i in range(20)]  # one page
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in L.drop_boilerplate(docs).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows)
    assert any("Menu" not in (got[i] or "") and "Menu" in t for i, _, t in rows) and got[150] == "copy\nof a page"


def test_odd_rows_and_columns(spark):
    rows = [(1, "a", None), (2, "a", ""), (None, None, "x\n\n"), (4, "a", "x" * 1_000_000 + "\nfoot"), (4, "a", "y\nfoot"), (5, "a", "z\nfoot"), (6, "a", "w\r\nfoot")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("line", F.lit("mine")).withColumn("n_chars", F.length("text").cast("long"))
    got = L.drop_boilerplate(docs)
    assert got.columns == docs.columns and got.count() == 7
    texts = {r.text for r in got.collect()}
    assert texts == {None, "", "x\n\n", "x" * 1_000_000, "y", "z", "w\r"}
    assert all(r.text is None or r.n_chars == len(r.text) for r in got.collect())
    assert L.drop_boilerplate(docs.limit(0)).count() == 0


def test_pages_by_host(spark):
    nav = "<nav><ul><li>Home<li class=x>About <b>us</b></ul></nav>"
    rows = [(i, f"https://{'WWW.a.com:80' if i % 2 else 'www.A.com'}/x{i}?q=http://b.com/", f"<html><script>var a='</p>';</script>{nav}<p>Own {i}</p><!-- <p>never\n-->Foot</html>") for i in range(6)]
    rows += [(10, "https://user@b.com/", f"{nav}<p>other host"), (11, None, nav), (12, "no url", "a\nb"), (13, "http://www.a.com", None), (None, "http://www.a.com/y", "")]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, line string")
    got = {r.page_id: r for r in L.drop_page_boilerplate(pages).collect()}
    assert got[1].asDict().keys() == {"page_id", "url", "html", "line", "text"}
    assert [[x for x in got[i].text.split("\n") if x] for i in range(6)] == [[f"Own {i}"] for i in range(6)]
    assert [x for x in got[10].text.split("\n") if x] == ["Home", "About us", "other host"]
    assert [x for x in got[11].text.split("\n") if x] == ["Home", "About us"]
    assert got[12].text == "a\nb" and got[13].text is None and got[None].text == ""
    hosts = pages.select("page_id", L.host(F.col("url")).alias("h")).collect()
    assert {r.page_id: r.h for r in hosts} == {**{i: "www.a.com" for i in range(6)}, 10: "b.com", 11: None, 12: "", 13: "www.a.com", None: "www.a.com"}
