import pytest

from recordloom.llm import licences
from recordloom.llm.licence_texts import TEMPLATES


@pytest.fixture(scope="module")
def made():
    return licences.Templates(TEMPLATES, licences.THRESHOLD)


def brute(part):
    """Best template over all of them, no size bounds."""
    best = min((-licences.dice(part, licences.bigrams(t)), n) for n, t in TEMPLATES)
    return (best[1], -best[0]) if part and -best[0] >= licences.THRESHOLD else None


def test_size_bounds_lose_nothing(spark, made):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [t for _, t in TEMPLATES] + [t.replace("the", "a") for _, t in TEMPLATES] + [t[: len(t) * 4 // 5] for _, t in TEMPLATES]
    lines = {x for t in texts for x in (t, *t.split("\n"))}
    found = 0
    for line in lines:
        part = licences.bigrams(line)
        assert made.best(part) == brute(part)
        found += made.best(part) is not None
    assert found > 25


@pytest.mark.parametrize("name,text", TEMPLATES)
def test_templates_inside_prose(made, name, text):
    prose = "Some prose goes here and has nothing to do with it.\n"
    doc = prose + text + "\n\n" + prose
    assert (name, 1.0, len(prose), len(prose) + len(text)) in licences.scan(doc, made)


def test_noise(made):
    assert licences.scan("nothing of the kind\nright here", made) == []
    assert [x[0] for x in licences.scan("x\n  RELEASED under the  mit licence -- the MIT license. ", made)] == []
    assert [x[0] for x in licences.scan("x\n* released UNDER the `MIT` license", made)] == ["MIT"]


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "All rights reserved.", "c"), (None, "all RIGHTS reserved", "d"),
            (4, "word " * 200_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = sorted((r.doc_id or 0, [x.licence for x in r.found]) for r in licences.find(docs).collect())
    assert got == [(0, ["Proprietary"]), (1, []), (2, []), (2, []), (3, ["Proprietary"]), (4, [])]
    assert licences.find(docs.where("false")).count() == 0


@pytest.mark.parametrize("name,text", TEMPLATES)
def test_templates_inside_a_line(made, name, text):
    prose = "Some prose goes here and has nothing to do with it. "
    one_line = " ".join(text.split())
    assert [x for x in licences.scan(prose * 9 + one_line + " " + prose * 9, made) if x[0] == name and x[1] == 1.0
            and x[2] == len(prose * 9) and x[3] >= len(prose * 9) + len(one_line) - 3]


def test_only_the_most_similar_licence_of_a_window(made):
    notice = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"
    line = f"Text of the page. {notice}. More text of the page, twice: {notice}. End."
    assert [x[0] for x in licences.scan(line, made)] == ["CC-BY-SA-4.0"] * 2
    assert licences.scan("all the rights of a licence are licensed under a common text " * 50, made) == []
