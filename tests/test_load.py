"""Readers, flattening, keyed append, file ledger and incremental ingest on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from recordloom import schema
from recordloom.operators import flatten
from recordloom.plans import profile
from recordloom.sources import external, readers, sinks
from recordloom.streaming import incremental


def filing(uuid, income="123.00", **more):
    return {"filing_uuid": uuid, "filing_type": "Q1", "filing_year": 2024,
            "filing_period": "first_quarter", "income": income, "expenses": None,
            "registrant": {"id": 7, "name": " Acme LLC ", "house_registrant_id": "12"},
            "client": {"id": 5, "name": "Client", "client_self_select": False},
            "lobbying_activities": [], "foreign_entities": [], **more}


ACTIVITIES = [
    {"general_issue_code": "TAX", "description": "d0",
     "lobbyists": [
         {"lobbyist": {"id": 1, "first_name": " Ann ", "last_name": "Lee"},
          "covered_position": "", "new": True},
         {"id": "2", "first_name": "Bo", "last_name": "", "covered_position": " Aide ",
          "new": None}],
     "government_entities": [{"id": 3, "name": " SENATE "}]},
    {"general_issue_code": "BUD", "description": None},
]


@pytest.fixture()
def corpus(tmp_path):
    root = tmp_path / "root"
    d24 = root / "senate/2024/filings"
    d25 = root / "senate/2025/filings"
    d24.mkdir(parents=True)
    d25.mkdir(parents=True)
    (d24 / "filings_2024.json").write_text(json.dumps([
        filing("u1", "$1,200", lobbying_activities=ACTIVITIES,
               foreign_entities=[{"name": "F", "country": "DE", "ownership_percentage": "51.5"}]),
        filing("u2", "abc"), filing("u3", " "), filing("", "5"), filing(None, "5"),
        {"filing_uuid": "u4", "unknown_key": 1},
    ]))
    (d25 / "filings_2025.json").write_text(json.dumps([filing("u1", "999"), filing("u5", "7")]))
    press = root / "congress_press/2024"
    press.mkdir(parents=True)
    (press / "2024-01.jsonl").write_text(
        json.dumps({"url": "http://x/1", "text": "abc",
                    "member": {"bioguide_id": "B1", "name": "M"}}) + "\n\n"
        + json.dumps({"url": "", "text": "skipped"}) + "\n"
        + json.dumps({"url": "http://x/2", "text": None,
                      "member": {"bioguide_id": "B1", "name": "Later"}}) + "\n")
    xml = root / "house/2024_1_XML"
    xml.mkdir(parents=True)
    (xml / "a.xml").write_text(
        "<LOBBYINGDISCLOSURE2><senateID>40012-123</senateID><reportYear>2024</reportYear>"
        "<organizationName> Org </organizationName><income>$2,500.50</income>"
        "<alis><ali_info><issueAreaCode>TAX</issueAreaCode><specific_issues>"
        "<description> one </description><description></description>"
        "<description>two</description></specific_issues>"
        "<federal_agencies>IRS</federal_agencies><lobbyists><lobbyist>"
        "<lobbyistFirstName>Al</lobbyistFirstName><lobbyistLastName>Po</lobbyistLastName>"
        "<coveredPosition>x</coveredPosition></lobbyist></lobbyists></ali_info></alis>"
        "<foreignEntities><foreignEntity></foreignEntity><foreignEntity><name>Fo</name>"
        "<contribution>1</contribution></foreignEntity></foreignEntities></LOBBYINGDISCLOSURE2>")
    (xml / "b.xml").write_text(
        "<LOBBYINGDISCLOSURE1><senateID>abc</senateID>"
        "<RegistrationDate>01/02/2024</RegistrationDate><alis_specific><ali_specific>"
        "<issueAreaCode>DEF</issueAreaCode><specific_issue>planes</specific_issue>"
        "</ali_specific></alis_specific></LOBBYINGDISCLOSURE1>")
    (xml / "bad.xml").write_text("<LOBBYINGDISCLOSURE2><senateID>1</LOBBYINGDISCLOSURE2>")
    return root


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_load_flattens_dedupes_and_resumes(spark, corpus, tmp_path):
    wh = str(tmp_path / "wh")
    profile.load(spark, profile.LOBBYING, str(corpus), wh)
    t = profile.open_tables(spark, profile.LOBBYING, wh)
    assert rows(t["senate_filings"].select("filing_uuid", "income", "source_file"), "filing_uuid") == [
        ("u1", 1200.0, "filings_2024.json"), ("u2", None, "filings_2024.json"),
        ("u3", None, "filings_2024.json"), ("u4", None, "filings_2024.json"),
        ("u5", 7.0, "filings_2025.json")]
    one = t["senate_filings"].where("filing_uuid = 'u1'").first()
    assert (one.registrant_id, one.registrant_name, one.registrant_house_id) == (7, "Acme LLC", 12)
    assert one.client_id == 5 and one.client_self_select is False
    assert rows(t["senate_lobbying_activities"].select(
        "activity_id", "activity_index", "description"), "activity_id") == [
        ("u1::a0", 0, "d0"), ("u1::a1", 1, None)]
    assert rows(t["senate_activity_lobbyists"].select(
        "lobbyist_id", "first_name", "last_name", "covered_position", "new_lobbyist"),
        "lobbyist_id") == [(1, "Ann", "Lee", None, True), (2, "Bo", None, "Aide", None)]
    assert rows(t["senate_foreign_entities"].select("country", "ownership_percentage"), "country") \
        == [("DE", 51.5)]
    pid = hashlib.sha1(b"http://x/1").hexdigest()[:16]
    assert t["press_releases"].where(F.col("press_id") == pid).first().text_length == 3
    assert rows(t["members"].select("bioguide_id", "name"), "name") == [("B1", "M")]
    assert rows(t["house_filings"].select(
        "house_xml_filename", "doc_type", "senate_id_registrant", "report_type", "income",
        "organization_name"), "house_xml_filename") == [
        ("a.xml", "LD2", 40012, None, 2500.5, "Org"),
        ("b.xml", "LD1", None, "01/02/2024", None, None)]
    assert rows(t["house_lobbying_activities"].select(
        "activity_id", "issue_area_code", "specific_issues", "federal_agencies"), "activity_id") == [
        ("a.xml::a0", "TAX", "one\ntwo", "IRS"), ("b.xml::a0", "DEF", "planes", None)]
    assert t["house_activity_lobbyists"].count() == 1
    assert rows(t["house_foreign_entities"].select("foreign_entity_name", "contribution"),
                "foreign_entity_name") == [("Fo", 1.0)]
    broken = spark.read.parquet(f"{wh}/_quarantine/house_filings")
    assert [r.source_file for r in broken.collect()] == ["bad.xml"]

    ledger = spark.read.parquet(f"{wh}/_ledger")
    counts = {(r.source_id, r.file_path.rsplit("/", 1)[1]): r.row_count for r in ledger.collect()}
    # 4 filings + 2 activities + 2 people + 1 body + 1 foreign entity, before keys are unique
    assert counts["senate_filings", "filings_2024.json"] == 10
    assert counts["senate_filings", "filings_2025.json"] == 2
    assert counts["house_filings", "bad.xml"] == 0
    m = sinks.manifest({"senate_filings": t["senate_filings"]}, ledger)
    got = {(r.kind, r["name"]): (r.n_files, r.n_rows) for r in m.collect()}
    assert got["table", "senate_filings"] == (None, 5)
    assert got["source", "senate_filings"] == (2, 12)

    # nothing new: nothing is added; a changed file is read again
    profile.load(spark, profile.LOBBYING, str(corpus), wh)
    t = profile.open_tables(spark, profile.LOBBYING, wh)
    assert t["senate_filings"].count() == 5 and t["senate_activity_lobbyists"].count() == 2
    (corpus / "senate/2025/filings/filings_2025.json").write_text(
        json.dumps([filing("u5", "7"), filing("u6", "8")]))
    profile.load(spark, profile.LOBBYING, str(corpus), wh, only="senate_filings")
    t = profile.open_tables(spark, profile.LOBBYING, wh)
    assert sorted(r[0] for r in t["senate_filings"].select("filing_uuid").collect()) == [
        "u1", "u2", "u3", "u4", "u5", "u6"]


def test_failed_load_adds_nothing_twice(spark, corpus, tmp_path, monkeypatch):
    wh = str(tmp_path / "wh")

    def fail(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks, "ledger_rows", fail)
        with pytest.raises(RuntimeError):
            profile.load(spark, profile.LOBBYING, str(corpus), wh, only="senate_filings")
    profile.load(spark, profile.LOBBYING, str(corpus), wh, only="senate_filings")
    t = profile.open_tables(spark, profile.LOBBYING, wh)
    assert t["senate_filings"].count() == 5
    assert t["senate_activity_lobbyists"].count() == 2
    assert spark.read.parquet(f"{wh}/_ledger").count() == 2


def test_limited_run_leaves_no_ledger(spark, corpus, tmp_path):
    wh = str(tmp_path / "wh")
    profile.load(spark, profile.LOBBYING, str(corpus), wh, only="senate_filings", limit=2,
                 years=(2024,))
    assert spark.read.parquet(f"{wh}/senate_filings").count() == 2
    assert sinks.read_if_there(spark, f"{wh}/_ledger") is None


def test_globs(spark, corpus):
    found = readers.expand_globs(spark, str(corpus), "senate/{year}/filings/filings_{year}.json")
    assert [p.rsplit("/", 1)[1] for p in found] == ["filings_2024.json", "filings_2025.json"]
    assert readers.expand_globs(spark, str(corpus), "none/{year}/*.json") == []
    assert readers.read_jsonl(spark, [], schema.PRESS_RELEASE).count() == 0


def test_json_array_layouts(spark, tmp_path):
    (tmp_path / "lines.json").write_text('[\n{"value": "A", "name": "x"},\n{"value": "B"}\n]\n')
    path = str(tmp_path / "lines.json")
    for layout in ("ranges", "lines"):
        got = readers.read_json_array(spark, path, schema.LOOKUP, layout)
        assert rows(got.select("value", "name"), "value") == [("A", "x"), ("B", None)]
    (tmp_path / "object.json").write_text('\n {"value": "A"}')
    with pytest.raises(Exception, match="list at top level"):
        readers.read_json_array(spark, str(tmp_path / "object.json"), schema.LOOKUP).collect()


def test_jsonl_bad_line(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"url": "a"}\nnot json\n')
    df = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema.PRESS_RELEASE)
    good, bad = readers.split_corrupt(df)
    assert [r.url for r in good.collect()] == ["a"]
    assert [r[0] for r in bad.collect()] == ["not json"]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema.PRESS_RELEASE,
                           strict=True).collect()


def test_contribution_shapes(spark):
    rec = {"filing_uuid": "c", "registrant": {"id": "9"}, "no_contributions": False,
           "contribution_items": [{"type": "feca", "amount": "1,000.5", "payee": "P", "payee_name": "",
                                   "honoree_name": "H", "date": "2024-01-01"}],
           "pacs": ["One", {"name": " Two "}, "", {"name": ""}]}
    raw = spark.createDataFrame([(json.dumps(rec),)], "j string").select(
        F.from_json("j", schema.SENATE_CONTRIBUTION).alias("r")).select(
        "r.*", F.lit("f").alias("source_file"))
    out = flatten.senate_contribution(raw)
    item = out["senate_contribution_items"].first()
    assert (item.item_id, item.contribution_type, item.amount, item.payee_name, item.honoree_name,
            item.contribution_date) == ("c::ci0", "feca", 1000.5, "P", "H", "2024-01-01")
    assert rows(out["senate_contribution_pacs"].select("pac_name"), "pac_name") == [
        ("One",), ("Two",)]
    assert out["senate_contributions"].first().no_contributions is False


def test_streaming_resumes(spark, tmp_path):
    src, wh = tmp_path / "in", str(tmp_path / "wh")
    src.mkdir()

    def put(name, *urls):
        (src / name).write_text("\n".join(json.dumps({"url": u, "text": name}) for u in urls))

    def run():
        stream = incremental.stream_jsonl(spark, str(src), schema.PRESS_RELEASE)
        incremental.ingest_available(stream, flatten.press_release, schema.TABLES, wh,
                                     "press", str(tmp_path / "offsets"))
        return spark.read.parquet(f"{wh}/press_releases")

    put("a.jsonl", "u1", "u2", "u1")
    assert run().count() == 2
    put("b.jsonl", "u2", "u3")
    out = run()
    assert sorted((r.url, r.text) for r in out.collect()) == [
        ("u1", "a.jsonl"), ("u2", "a.jsonl"), ("u3", "b.jsonl")]
    assert run().count() == 3


def test_external_readers(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        "<ROWSET><ROW><REGISTRATION_NUMBER>1</REGISTRATION_NUMBER><NAME> Firm </NAME>"
        "<CITY></CITY><TYPE>Primary</TYPE></ROW><ROW><NAME>Two</NAME></ROW></ROWSET>")
    (tmp_path / "p.xml").write_text(
        "<ROWSET><ROW><FOREIGN_PRINCIPAL>Gov</FOREIGN_PRINCIPAL>"
        "<COUNTRY_LOCATION_REPRESENTED>FR</COUNTRY_LOCATION_REPRESENTED></ROW></ROWSET>")
    reg = external.read_fara_registrants(spark, str(tmp_path / "r.xml"))
    assert rows(reg.select("registrant_name", "city", "registration_type"), "registrant_name") == [
        ("Firm", None, "Primary"), ("Two", None, None)]
    pri = external.read_fara_principals(spark, str(tmp_path / "p.xml"))
    assert pri.select("foreign_principal_name", "foreign_principal_country").first() == ("Gov", "FR")

    (tmp_path / "l.json").write_text(json.dumps([
        {"id": {"bioguide": "A1"}, "name": {"first": "F", "last": "L"},
         "terms": [{"type": "rep", "state": "TX", "district": 3}, {"type": "sen", "state": "TX"}]},
        {"id": {}, "name": {"official_full": "No Id"}, "terms": []},
        {"id": {"bioguide": "A2"}, "name": {"official_full": "Full Name"}, "terms": []}]))
    members = external.read_legislators(spark, str(tmp_path / "l.json"))
    assert rows(members.select("bioguide_id", "name", "chamber", "district"), "bioguide_id") == [
        ("A1", "F L", "sen", None), ("A2", "Full Name", None, None)]
    (tmp_path / "c.json").write_text(json.dumps([
        {"thomas_id": "SSFI", "name": "Finance", "type": "senate",
         "subcommittees": [{"thomas_id": "02", "name": "Tax"}]},
        {"thomas_id": "HSAS", "name": "Arms", "type": "house"}]))
    committees = external.read_committees(spark, str(tmp_path / "c.json"))
    assert rows(committees.select("committee_code", "parent_committee_code"), "committee_code") == [
        ("HSAS", None), ("SSFI", None), ("SSFI02", "SSFI")]
    (tmp_path / "m.json").write_text(json.dumps({
        "SSFI": [{"bioguide": "A1", "title": "Chair"}, {"bioguide": None}],
        "ZZZZ": [{"bioguide": "A2", "party": "majority"}]}))
    seats = external.read_membership(spark, str(tmp_path / "m.json"), committees)
    assert rows(seats.select("bioguide_id", "committee_code", "committee_name", "role"),
                "bioguide_id") == [
        ("A1", "SSFI", "Finance", "Chair"), ("A2", "ZZZZ", "ZZZZ", "majority")]
    (tmp_path / "a.json").write_text(json.dumps({
        "NONE": {"n_awards_top_25_by_amount": 0, "sum_amount_top_25": 0, "top_5_awards": []},
        "ACME": {"n_awards_top_25_by_amount": 2, "sum_amount_top_25": 5.5, "top_5_awards": [
            {"Award ID": "X", "Award Amount": 4.0}, {"Award ID": "Y", "Award Amount": 1.5}]}}))
    summary, awards = external.read_awards(spark, str(tmp_path / "a.json"))
    assert rows(summary, "recipient") == [("ACME", 2, 5.5), ("NONE", 0, 0.0)]
    assert rows(awards.select("award_id", "amount"), "award_id") == [("X", 4.0), ("Y", 1.5)]


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("id,other\na,1\n,2\nb,3\nc,4\n")
    path = str(tmp_path / "ids.csv")
    assert rows(readers.read_id_list(spark, path), "id") == [("a",), ("b",), ("c",)]
    assert rows(readers.read_id_list(spark, path, "other", limit=3), "id") == [
        ("1",), ("2",), ("3",)]


def people(spark, wh):
    t = profile.open_tables(spark, profile.LOBBYING, wh)
    return sorted(r.activity_id for r in t["senate_activity_lobbyists"].collect())


def test_forced_and_changed_loads_replace_the_rows_of_a_file(spark, corpus, tmp_path):
    wh = str(tmp_path / "wh")
    load = lambda **kw: profile.load(spark, profile.LOBBYING, str(corpus), wh, only="senate_filings", **kw)
    load()
    want = people(spark, wh)
    assert len(want) == 2
    load(force=True, years=(2024,))
    assert people(spark, wh) == want
    load(force=True)
    assert people(spark, wh) == want
    # the file that held all people changes and names none any more
    (corpus / "senate/2024/filings/filings_2024.json").write_text(json.dumps([filing("u9", "7")]))
    load()
    left = people(spark, wh)
    assert not set(left) & {x for x in want if x.startswith(("u1", "u2"))} and len(left) < 2


def test_failure_then_another_file(spark, corpus, tmp_path, monkeypatch):
    wh = str(tmp_path / "wh")

    def fail(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks, "ledger_rows", fail)
        with pytest.raises(RuntimeError):
            profile.load(spark, profile.LOBBYING, str(corpus), wh, only="senate_filings", years=(2024,))
    profile.load(spark, profile.LOBBYING, str(corpus), wh, only="senate_filings")
    assert len(people(spark, wh)) == 2


def test_limited_run_is_seen_and_replaced(spark, corpus, tmp_path):
    wh = str(tmp_path / "wh")
    profile.load(spark, profile.LOBBYING, str(corpus), wh, limit=1)
    assert len(people(spark, wh)) <= 2
    profile.load(spark, profile.LOBBYING, str(corpus), wh)
    assert len(people(spark, wh)) == 2


def test_digest_of_the_content(spark, tmp_path):
    import hashlib
    data = {"a.bin": b"x" * (9 << 20), "b.bin": b"y"}
    (tmp_path / "c.bin").touch()  # a file without content has no records and is passed over
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    got = {r.file_path.rsplit("/", 1)[1]: r.file_sha256 for r in sinks.fingerprints(spark, [str(tmp_path)]).collect()}
    assert got == {name: hashlib.sha256(content).hexdigest() for name, content in data.items()}


def test_any_year_is_found(spark, tmp_path):
    (tmp_path / "d/2031").mkdir(parents=True)
    (tmp_path / "d/2031/x_2031.json").write_text("[]")
    assert len(readers.expand_globs(spark, str(tmp_path), "d/{year}/x_{year}.json")) == 1
    assert readers.expand_globs(spark, str(tmp_path), "d/{year}/x_{year}.json", years=(2024,)) == []


def test_whole_run(spark, corpus, tmp_path):
    from recordloom.plans import case, catalogue

    out = str(tmp_path / "out")
    ran = case.run_case(spark, str(corpus), str(tmp_path / "wh"), out, detectors=["D1", "D5", "D8v", "DV", "TX"])
    names = {r.name for r in ran.collect()}
    assert {"resolution_canonical", "resolution_report", "D1_spending_spikes", "TX_name_totals"} <= names
    files = spark.read.json(f"{out}/manifest/files")
    assert {len(r.file_sha256) for r in files.collect()} == {64}
    assert spark.read.json(f"{out}/manifest/summary").where("kind = 'table'").count() >= 16
    assert {"D8v", "DV", "TX"} <= set(catalogue.idents())


def test_keyed_load(spark, corpus, tmp_path):
    plain, by_key = str(tmp_path / "plain"), str(tmp_path / "keyed")
    for only in ("senate_filings",):
        profile.load(spark, profile.LOBBYING, str(corpus), plain, only=only)
        for force in (False, True):  # the second load brings nothing new
            profile.load(spark, profile.LOBBYING, str(corpus), by_key, only=only, keyed=True, force=force)
    a, b = (profile.open_tables(spark, profile.LOBBYING, wh) for wh in (plain, by_key))
    for name in ("senate_filings", "senate_lobbying_activities"):
        assert sorted(map(str, a[name].collect())) == sorted(map(str, b[name].collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = b["senate_filings"].join(b["senate_lobbying_activities"], "filing_uuid")
        assert joined.count() > 0
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_house_records_are_parsed_once(spark):
    from checks import load, registry
    from recordloom.plans.testdata import TestTables

    folder = "/root/testdata/sf0.001"
    records = load.house_records(TestTables(spark, folder))
    assert records.count() == spark.read.parquet(f"{folder}/part.parquet").count()
    plan = registry.QUERIES["flatten_house_lobbyists"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "from_xml" not in plan and "LOBBYINGDISCLOSURE2" not in plan
