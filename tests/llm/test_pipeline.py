import corpus_pipeline as pipeline
from recordloom.llm import sharding
from tests.llm import test_decontaminate as contamination, test_line_quality as quality, test_mixing as mixing
from tests.llm import test_shingle_join as join

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(pipeline.STAGES) == 5
    columns = docs.columns
    outs = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, SF).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        if k < 4:
            assert docs.columns == columns
        outs.append((before.collect(), docs.collect()))

    rows, kept = outs[0]
    verdict = quality.brute_kept([(r.source, r.text) for r in rows], 20, 0.5)
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in rows if verdict[r.source, r.text or ""][1])

    rows, kept = outs[1]
    assert sorted(r.doc_id for r in kept) == sorted({c for _, _, c in join.brute([(r.doc_id, r.text) for r in rows])})
    assert {r.doc_id: r for r in rows}.items() >= {r.doc_id: r for r in kept}.items()

    rows, kept = outs[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[k:k + 4]) for _, t in items for w in [contamination.words(t)] for k in range(len(w) - 3)}
    near = [(r.doc_id, r.text) for r in rows for w in [contamination.words(r.text)]
            if any(tuple(w[k:k + 4]) in grams for k in range(len(w) - 3))]
    flagged = {x[0] for x in contamination.brute(near, items)}
    assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in rows if r.doc_id not in flagged)

    rows, kept = outs[3]
    times = {}
    for r in kept:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    for i, n, _, _, taken in mixing.brute([(r.doc_id, r.source, r.text) for r in rows]):
        assert times.get(i, 0) == (-(-taken // n) if n else 0)

    rows, placed = outs[4]
    table = sharding.lookup_table(sharding.shard_names(64))
    assert len(placed) == len(rows) and all(table[r.slot] == r.shard for r in placed)


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_nulls_and_extra_columns(spark):
    rows = [(None, None, None, None, None, 1, "x"), (1, None, "en", "s", 0, 2, "y"), (2, "", None, None, None, 3, "z"),
            (3, "word " * 100_000, "en", "s", 1, 4, "q"), (4, "some words of a plain text " * 1 + " ".join(map(str, range(60))), "en", "s", 1, 4, "q"),
            (4, "some words of a plain text " * 1 + " ".join(map(str, range(60))), "en", "s", 1, 4, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, label string")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert set(docs.columns) <= set(out.columns)
        assert len(out.collect()) >= (1 if k else 2)
