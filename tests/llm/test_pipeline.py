"""The pipeline, each stage against a plain version of itself on what its predecessor kept."""

import random
import re

import pytest

import corpus_pipeline
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_mixing import brute_targets
from thicket.llm.packing import CAPACITIES

CALM = [f"{a}{b}" for a in "mead riv lant harv wind gard silv morn bread lett".split() for b in "ow er ern est ens ly ing".split()]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    """Rows and labels: civil and toxic texts, boilerplate lines, exact and near copies, long and empty texts."""
    rng = random.Random(12)
    rows, labels = [], []

    def add(text, toxic=False):
        rows.append((len(rows), text, "en", rng.choice(["a", "a", "a", "b", "c", None]), len(text or "")))
        labels.append((len(rows) - 1, 1, int(toxic)))

    for i in range(260):
        words = [rng.choice(CALM) + str(rng.randrange(9)) for _ in range(rng.randrange(60, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(8):
                words.insert(rng.randrange(len(words)), rng.choice(["grubling", "snarfoul", "vexhag"]))
        text = " ".join(words[:30]) + "\n" + " ".join(words[30:])
        if rng.random() < 0.4:
            text += "\n  Home | About  "
        add(text, toxic)
        if not toxic and i % 10 == 1:
            add(text)
            copy = text.split(" ")
            copy[20] = "changed"
            add(" ".join(copy))
    add(None)
    add("")
    add(" ".join(rng.choice(CALM) for _ in range(9000)))
    return rows, labels


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_keep_one(rows):
    """Of each group of texts with a resemblance of 0.8 the smallest id."""
    sets = [None if t is None else shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = rows[i][1] == rows[j][1] or (a and b and len(a & b) >= 0.8 * len(a | b))
            if same:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, written and read again as the next one's input."""
    work = tmp_path_factory.mktemp("pipeline")
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(work / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(work / "labels.parquet"))
    out, current = [docs.collect()], docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, current, str(work))
        made.write.parquet(str(work / f"stage{i}"))
        current = spark.read.parquet(str(work / f"stage{i}"))
        if i < 4:
            assert current.columns == COLUMNS, name
        out.append(current.collect())
    whole = corpus_pipeline.run(spark, str(work)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, out[-1]))
    return out, {i for i, _, t in labels if t}


def test_toxic_documents_go(stages):
    out, toxic = stages
    kept = {r.doc_id for r in out[1]}
    assert kept == {r.doc_id for r in out[0]} - toxic


def test_boilerplate_lines_go(stages):
    out, _ = stages
    before = sorted(out[1], key=lambda r: r.doc_id)
    after = sorted(out[2], key=lambda r: r.doc_id)
    assert [r.text for r in after] == brute_lines([(r.doc_id, r.source, r.text) for r in before])
    assert any("Home" in (r.text or "") for r in before) and all(r.n_chars == len(r.text or "") for r in after)


def test_one_of_each_group_stays(stages):
    out, _ = stages
    before = sorted((r.doc_id, r.text) for r in out[2] if r.text is not None) + [(r.doc_id, None) for r in out[2] if r.text is None]
    assert {r.doc_id for r in out[3]} == brute_keep_one(before) and len(out[3]) < len(out[2]) - 30


def test_sources_are_mixed(stages):
    out, _ = stages
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = {}, {}
    for r in out[3]:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    for r in out[4]:
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    whole = {r.doc_id: r for r in out[3]}
    assert all(whole[r.doc_id] == r for r in out[4])
    for s, target in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= max(400, 0.1 * target)


def test_every_word_is_packed(stages):
    out, _ = stages
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sum(r["size"] for r in out[5]) == sum(words(r.text) for r in out[4])
    bins: dict = {}
    for r in out[5]:
        if r.bin is not None:
            bins.setdefault((r.bin, r.capacity), []).append((r.offset, r["size"]))
    for (_, capacity), items in bins.items():
        at = 0
        for offset, size in sorted(items):
            assert offset == at
            at += size
        assert at <= capacity in CAPACITIES
