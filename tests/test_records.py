"""Cards, claims, audit, provenance, sinks and neighbours on small tables."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.operators import audit, cards, claims, relate, similar
from recordloom.plans import provenance
from recordloom.schema import CLAIM, TABLES
from recordloom.sources import readers, sinks


def table(spark, name, *rows):
    fields = TABLES[name].fields()
    return spark.createDataFrame([tuple(r.get(c) for c, _ in fields) for r in rows],
                                 TABLES[name].schema)


def test_senate_card(spark):
    t = {
        "senate_filings": table(spark, "senate_filings", {
            "filing_uuid": "u/1", "registrant_name": "Firm", "registrant_id": 7, "income": 10000000.0,
            "client_name": "Client", "expenses_method": ""}),
        "senate_lobbying_activities": table(
            spark, "senate_lobbying_activities",
            *[{"filing_uuid": "u/1", "activity_index": i, "general_issue_code": f"C{i:02}",
               "description": "" if i == 0 else "text"} for i in (10, 2, 0)]),
        "senate_activity_lobbyists": table(
            spark, "senate_activity_lobbyists",
            {"filing_uuid": "u/1", "first_name": "B", "last_name": "Z"},
            {"filing_uuid": "u/1", "first_name": "A", "last_name": "Y", "covered_position": "Aide"}),
        "senate_foreign_entities": table(spark, "senate_foreign_entities"),
        "senate_activity_govt_entities": table(
            spark, "senate_activity_govt_entities", *[{"filing_uuid": "u/1", "govt_entity_name": n}
                                                      for n in ("SENATE", "HOUSE", "SENATE", None)]),
    }
    ids = spark.createDataFrame([("u/1",), ("nope",)], "id string")
    got = cards.cards("senate_filing", ids, t).collect()
    assert len(got) == 1
    md = got[0].card_md
    assert md.startswith("# Evidence card :: Senate LDA filing `u/1`\n\n- **Source kind:** senate_filing\n")
    assert "- Income reported: 10000000.0\n- Expenses reported: None (no method)\n" in md
    # activities by number, the rest by text; the empty section is left out
    assert md.index("**C00** (None) — _no description_") < md.index("**C02**") < md.index("**C10**")
    assert "\n\n## Lobbyists\n- A Y  \n    _covered position:_ Aide\n- B Z\n" in md
    assert "Foreign entities" not in md
    assert md.endswith("\n\n## Government entities lobbied\n- HOUSE\n- SENATE\n")
    again = cards.cards("senate_filing", ids, {k: v.repartition(5) for k, v in t.items()}).first()
    assert again.card_md == md
    missing = cards.missing_ids(ids, t["senate_filings"], "filing_uuid")
    assert [r.id for r in missing.collect()] == ["nope"]
    name = spark.createDataFrame([("senate_filing", "u/1")], "s string, i string").select(
        sinks.card_file_name(F.col("s"), F.col("i"))).first()[0]
    assert name == "senate_filing_u_1.md"


def test_house_and_press_cards(spark, tmp_path):
    t = {
        "house_filings": table(spark, "house_filings", {"house_xml_filename": "1.xml", "doc_type": "LD2"}),
        "house_lobbying_activities": table(
            spark, "house_lobbying_activities",
            {"house_xml_filename": "1.xml", "activity_index": 0, "issue_area_code": "TAX",
             "specific_issues": "a\nb", "federal_agencies": "IRS"},
            {"house_xml_filename": "1.xml", "activity_index": 1, "issue_area_code": "BUD"}),
        "house_activity_lobbyists": table(spark, "house_activity_lobbyists"),
        "house_foreign_entities": table(spark, "house_foreign_entities", {
            "house_xml_filename": "1.xml", "foreign_entity_name": "F", "country": "DE"}),
        "press_releases": table(spark, "press_releases", *[
            {"press_id": p, "text": "x" * n, "text_length": n} for p, n in (("short", 5), ("long", 5001))]),
    }
    md = cards.cards("house_filing", spark.createDataFrame([("1.xml",)], "id string"), t).first().card_md
    assert "- **TAX**\n  - Specific issues: a  \n    b\n  - Federal agencies: IRS\n- **BUD**\n\n## Foreign" in md
    press = cards.cards("press_release", t["press_releases"].select(F.col("press_id").alias("id")), t)
    got = {r.id: r.card_md for r in press.collect()}
    assert got["short"].endswith("```\nxxxxx\n```\n")
    assert got["long"].endswith("x\n```\n\n_(truncated; full text 5001 chars)_\n")
    sinks.write_cards(press, str(tmp_path / "cards"))
    assert spark.read.parquet(str(tmp_path / "cards")).where("source = 'press_release'").count() == 2


def claim_table(spark, *rows):
    return spark.createDataFrame(
        [(k, json.dumps(v)) for k, v in rows], "claim_id string, j string").select(
        "claim_id", F.from_json("j", CLAIM).alias("c")).select("claim_id", "c.*")


def test_claims(spark, tmp_path):
    first = {"statement": "Acme Corp paid The Senate and Acme Corp again. It", "confidence": "high",
             "fact_check_status": "verified", "supporting_cards": ["senate_filing_u.md"],
             "supporting_query_hashes": ["h1", "h1"], "external_sources": [{"url": "http://u"}]}
    second = {"statement": "x" * 201, "supporting_cards": []}
    (tmp_path / "map.json").write_text(json.dumps({"claims": {"C-001": first, "C-002": second}}))
    df = readers.read_claims(spark, str(tmp_path / "map.json"))
    assert df.count() == 2
    found = claims.entity_mentions(df.where("claim_id = 'C-001'")).orderBy("first_pos").collect()
    assert [(r.entity, r.first_pos) for r in found][0] == ("Acme Corp", 0)
    assert "It" not in [r.entity for r in found]
    edges = {(r.kind, r.dst) for r in claims.claim_edges(df).where("src = 'C-001'").collect()}
    assert {("card", "senate_filing_u.md"), ("query", "h1"), ("url", "http://u")} <= edges
    hidden = {r.claim_id: r for r in claims.redact(df).collect()}
    assert hidden["C-002"].statement == "[REDACTED]"
    assert hidden["C-001"].statement == first["statement"]
    assert hidden["C-001"].external_sources[0].url == "[REDACTED]"
    refs = spark.createDataFrame([("senate_filing_a_b.md",), ("press_release_p.md",), ("x.md",)], "c string")
    assert [tuple(r) for r in refs.select(claims.card_kind("c"), claims.card_record("c")).collect()] == [
        ("senate_filing", "a_b"), ("press_release", "p"), (None, None)]
    assert {tuple(r) for r in claims.summary_counts(df).collect()} == {
        ("high", "verified", 1), ("?", "?", 1)}


def test_integrity_rules(spark):
    good = {"confidence": "high", "fact_check_status": "verified", "supporting_cards": ["a.md"],
            "supporting_query_hashes": ["h1"],
            "external_sources": [{"url": "u", "archive_path": "p"}]}
    evidence = claim_table(
        spark, ("C-1", good), ("C-1", good),
        ("bad-id", {**good, "supporting_cards": [], "supporting_query_hashes": ["h2"],
                    "external_sources": [{"url": "u2"}]}))
    findings = claim_table(spark, ("C-1", good), ("C-9", good), ("C-8", {**good, "confidence": "low"}))
    got = {tuple(r) for r in audit.ledger_integrity(
        findings, evidence, spark.createDataFrame([("a.md",)], "card string"),
        spark.createDataFrame([("h1",)], "sql_hash string")).collect()}
    assert got == {
        ("not in map", "C-9", None), ("no cards", "bad-id", None),
        ("provenance missing", "bad-id", "h2"), ("external source not archived", "bad-id", "u2"),
        ("claim id not unique", "C-1", "2"), ("claim id malformed", "bad-id", None)}


def test_citations(spark, tmp_path):
    uuid = "0123abcd-0000-1111-2222-0123456789ab"
    (tmp_path / "out.md").write_text(f"see {uuid} and (http://a.b/c) and http://x.y/z\n")
    (tmp_path / "truth.md").write_text(f"http://a.b/c\n{uuid}")
    orphans = audit.citation_closure(readers.read_text_corpus(spark, str(tmp_path / "out.md")),
                                     readers.read_text_corpus(spark, str(tmp_path / "truth.md")))
    assert [r.token for r in orphans.collect()] == ["http://x.y/z"]


def test_provenance_and_replay(spark, tmp_path):
    out = str(tmp_path / "case")
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    text = "SELECT id, id * 2 AS v FROM t WHERE id >= :low"
    got = provenance.ad_hoc_sql(spark, text, {"t": spark.range(10)}, out, "one", {"low": 3})
    assert got.count() == 7
    rec = provenance.provenance_table(spark, out).first()
    assert (rec.name, rec.row_count, rec.sql) == ("one", 7, text)
    assert rec.sql_hash == hashlib.sha256(text.encode()).hexdigest()[:16]
    assert [(s.column, s.type) for s in rec.schema] == [("id", "bigint"), ("v", "bigint")]
    again = audit.fingerprint(df.where("id >= 3").repartition(3)).first()
    assert (again.row_count, again.digest) == (rec.row_count, rec.digest)
    assert audit.fingerprint(df.where("id = 99")).first().digest == "0"
    replayed = audit.fingerprint(df.where("id >= 3")).withColumn("sql_hash", F.lit(rec.sql_hash))
    cited = spark.createDataFrame([(rec.sql_hash,), ("gone",)], "sql_hash string")
    status = {r.sql_hash: r.status for r in audit.replay_check(
        cited, provenance.provenance_table(spark, out), replayed).collect()}
    assert status == {rec.sql_hash: "match", "gone": "provenance missing"}
    assert provenance.canonical_text("D1", {"b": 1, "a": 2}) == provenance.canonical_text(
        "D1", {"a": 2, "b": 1})


def test_history_and_vintages(spark):
    v = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "claim string, at int")
    got = {tuple(r) for r in audit.supersession_history(v, "claim", "at").collect()}
    assert got == {("a", 1, 5, False), ("a", 5, None, True), ("b", 2, None, True)}
    old = spark.createDataFrame([("x", 0), ("y", 3)], "k string, v int")
    new = spark.createDataFrame([("x", 7), ("z", 1)], "k string, v int")
    assert {(r.k, r.change) for r in audit.vintage_diff(old, new, "k", "v").collect()} == {
        ("x", "changed"), ("y", "removed"), ("z", "added")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(20)], "id int, name string, v double")
    sinks.write_ranked_csv(df, str(tmp_path / "top"), [F.desc("v")], 3)
    back = spark.read.option("header", True).csv(str(tmp_path / "top"))
    assert [r.id for r in back.collect()] == ["19", "18", "17"]
    sinks.write_queue(df, str(tmp_path / "queue"))
    assert spark.read.option("header", True).csv(str(tmp_path / "queue")).count() == 20
    sinks.full_refresh(df, str(tmp_path / "t"))
    sinks.full_refresh(df.limit(2), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.log_vintage(df, "reg", "http://r", "2024-05-01", str(tmp_path / "vintages"))
    assert spark.read.parquet(str(tmp_path / "vintages")).first().row_count == 20
    assert str(sinks.vintage(df, "2024-05-01").first()._as_of) == "2024-05-01"
    # parent and child stored by the same key join without a shuffle
    spark.sql("CREATE DATABASE IF NOT EXISTS lay LOCATION '" + str(tmp_path / "lay") + "'")
    for name in ("parent", "child"):
        spark.sql(f"DROP TABLE IF EXISTS lay.{name}")
        sinks.laid_out(df, f"lay.{name}", bucket_by="id", buckets=4, bloom=["name"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("lay.parent").join(spark.table("lay.child"), "id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_award_order(spark):
    e = spark.createDataFrame([("k", 10), ("k", 12)], "key string, start int")
    a = spark.createDataFrame([("k", 5, 1), ("k", 11, 2), ("k", 30, 3)], "key string, awarded int, award int")
    got = relate.first_award_after(e, a, key="key", start="start", awarded="awarded", tie="award")
    assert [tuple(r) for r in got.collect()] == [("k", 10, 11, 2)]


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(60, 8)).astype("float32")
    vecs[7] = vecs[3]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)],
                                 "id int, embedding array<float>").repartition(5)
    x = vecs.astype("float64")
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = {q: [int(i) for i in np.lexsort((np.arange(60), dist[q]))[:4]] for q in range(60)}
    one = similar.knn_by_id(base, 3, 4).collect()
    assert [r.id for r in one] == want[3] and one[0].distance == 0.0
    assert 3 not in [r.id for r in similar.knn_by_id(base, 3, 4, exclude_self=True).collect()]
    with pytest.raises(KeyError):
        similar.knn_by_id(base, 999, 4)
    for kw in ({}, {"block_bytes": 4096}):
        got = {}
        for r in similar.knn_batch(base, base, 4, **kw).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.neighbor_id)
        assert got == want
    near = similar.approx_knn(base, vecs[3].tolist(), 4, bucket_length=4.0).collect()
    assert {r.id for r in near} >= {3, 7}


def test_embedding_and_clusters(spark):
    docs = spark.createDataFrame(
        [(1, "tax credit bill"), (2, "tax credit law"), (3, "whale ocean fish"), (4, None)],
        "doc int, text string")
    model = similar.TextEmbedder(64).fit(docs, "text")
    base = model.transform(docs, "doc", "text")
    assert base.count() == 3
    assert [r.id for r in similar.knn_by_text(base, model, "whale fish", 1).collect()] == ["3"]
    groups = {r.id: r.cluster for r in similar.cluster_text(base, 2).collect()}
    assert groups["1"] == groups["2"] != groups["3"]

    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    own = {r.id: r.embedding for r in similar.embed_column(docs, "doc", "text", load).collect()}
    assert own["3"] == [16.0, 1.0] and len(own) == 3


def test_card_tables_are_dealt_once(spark):
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    tables = {
        "senate_filings": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "filing_uuid long, url string"),
        "senate_lobbying_activities": spark.createDataFrame(
            [(1, 0, "T")], "filing_uuid long, activity_index int, general_issue_code string"),
        "senate_activity_lobbyists": spark.createDataFrame(
            [(1, "A", "B", None), (1, "C", "D", "x")],
            "filing_uuid long, first_name string, last_name string, covered_position string"),
        "senate_foreign_entities": spark.createDataFrame([(2, "F")], "filing_uuid long, foreign_entity_name string"),
        "senate_activity_govt_entities": spark.createDataFrame(
            [(2, "G"), (2, "G")], "filing_uuid long, govt_entity_name string")}
    made = cards.cards("senate_filing", ids, tables)
    text = {r.id: r.card_md for r in made.collect()}
    assert sorted(text) == ["1", "2"] and text["1"].count("## Lobbyists") == 1 and text["2"].count("- G\n") == 1
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" not in plan and "Broadcast" not in plan
