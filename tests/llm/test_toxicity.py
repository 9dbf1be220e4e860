import random
import zlib

import pytest
from pyspark.sql import functions as F

from recordloom.llm import toxicity

BAD = "grobian lumpen schuft".split()
CALM = [f"wort{i}" for i in range(40)]


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(700):
        words = [rng.choice(CALM) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(30)] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "du grobian schuft"), (1003, "wort1 " * 20000 + "grobian"), (0, rows[0][1]),
             (1004, "wort1 wort2 gr0bian wort3 l.u.m.p.e.n wort4"), (1005, "wort1 wort2 wort3")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def judged(tables):
    docs, labels = tables
    return toxicity.judge(docs, labels).toPandas()


def test_held_out_rows_are_told_apart(tables, judged):
    labels = tables[1].toPandas()
    held = judged[judged.held_out].merge(labels, on="doc_id")
    assert len(held) > 100 and (held.doc_id.astype(int).map(fold) == 0).all()
    assert ((held.predicted == held.toxic).mean()) > 0.95


def test_every_row_has_a_score(tables, judged):
    assert len(judged) == tables[0].count()
    assert judged.score.between(0, 1).all()
    assert ((judged.score >= 0.5).astype(int) == judged.predicted).all()
    assert judged[judged.doc_id == 0].score.nunique() == 1
    assert judged[judged.doc_id.isna()].held_out.all()


def test_labels_of_fold_0_teach_nothing(tables, judged):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.judge(docs, turned).toPandas()
    assert again.sort_values(["doc_id", "score"]).score.tolist() == judged.sort_values(["doc_id", "score"]).score.tolist()


@pytest.mark.parametrize("marks,score", [([], 0.0), ([(1, 1), (2, 1), (3, 1), (4, 1)], 1.0), ([(1, 0), (2, 0), (3, 0), (4, None)], 0.0)])
def test_one_kind_of_label_or_none(spark, tables, marks, score):
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    assert {r.score for r in toxicity.judge(tables[0], labels).collect()} == {score}


def test_an_empty_table(spark, tables):
    assert toxicity.judge(tables[0].limit(0), tables[1]).count() == 0


def test_clashing_columns(spark, tables):
    docs = tables[0].withColumns({c: F.lit("x") for c in ("_features", "_t", "_fold", "score", "id", "toxic", "rawPrediction")})
    model = toxicity.train(docs, tables[1])
    assert model.score(docs, ["doc_id", "_features", "_t", "rawPrediction"]).count() == docs.count()


def test_features():
    reader = toxicity.Reader({"idiot": 5.0, "stupi-": 2.0})
    one = dict(zip(toxicity.FEATURES, reader.features("You are an IDIOT!! so what is that to me and us")))
    assert one["strong_density"] == 1 / 12 and one["best"] == 5.0 and one["near_second"] == 1.0
    assert one["shouted"] == 1 / 12 and one["exclaimed"] == 2 / 12 and one["hidden_density"] == 0
    for text in ("some 1d1ot here", "some i.d.i.o.t here", "some idiooooot here", "some i d i o t here"):
        found = dict(zip(toxicity.FEATURES, reader.features(text)))
        assert found["hidden_density"] > 0 and found["best"] == 5.0, text
    assert dict(zip(toxicity.FEATURES, reader.features("stupidly")))["best_stem"] == 2.0
    assert reader.features("") == [0.0] * len(toxicity.FEATURES) == reader.features("   ")
    far = dict(zip(toxicity.FEATURES, reader.features("you " + "x " * 9 + "idiot")))
    assert far["near_second"] == 0


def test_a_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(toxicity, "FLUSH", 5)
    reader = toxicity.Reader({"bad": 3.0})
    texts = [f"a{i} b{i} bad c{i}" for i in range(20)]
    fresh = [toxicity.Reader({"bad": 3.0}).features(t) for t in texts]
    assert [reader.features(t) for t in texts] == fresh
