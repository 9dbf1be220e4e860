"""Detectors on small tables: archived values and both readings of every doubtful rule."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import detect, relate
from recordloom.operators.shape import pct_change, row_index, top_k_per_key
from recordloom.plans import catalogue, lobbying  # noqa: F401  (fills the catalogue)

PERIODS = ("first_quarter", "second_quarter", "third_quarter", "fourth_quarter")
FILING = ("filing_uuid string, filing_type string, filing_year int, filing_period string, "
          "income double, registrant_id int, registrant_name string, client_id int, "
          "client_name string, client_country string, client_ppb_country string, "
          "client_general_description string, posted_by_name string, url string")


def filing(uuid, year=2024, quarter=1, income=1.0, registrant=1, name="R", client=1, **kw):
    row = dict(filing_uuid=uuid, filing_type=f"Q{quarter}", filing_year=year,
               filing_period=PERIODS[quarter - 1], income=income, registrant_id=registrant,
               registrant_name=name, client_id=client, client_name=f"C{client}",
               client_country="US", client_ppb_country=None, client_general_description=None,
               posted_by_name=None, url=None)
    row.update(kw)
    return tuple(row.values())


def filings(spark, *rows):
    return spark.createDataFrame(list(rows), FILING)


def test_archived_z_score(spark):
    # four totals with the archived mean and deviation, then the archived spike
    mean, sd = 235638.0, 180.13328398716322
    base = [mean - sd, mean + sd, mean - sd, mean + sd]
    rows = [filing(f"f{i}", 2023, i + 1, v) for i, v in enumerate(base)]
    rows.append(filing("f5", 2024, 1, 121750.0))
    got = detect.spending_spikes(filings(spark, *rows)).collect()
    assert len(got) == 1
    assert got[0].z_score == pytest.approx(-632.2429563218087, rel=1e-9)
    assert got[0].prior_n == 4


def test_archived_pct_change(spark):
    df = spark.createDataFrame([(45339597.0, 18671639.06), (452.0, 418.0), (1.0, 0.0)], "n double, o double")
    assert [r[0] for r in df.select(pct_change("n", "o")).collect()] == [142.8, 8.1, None]


def test_period_order_calendar_and_text(spark):
    # by calendar the fourth quarter is last; as text "fourth" sorts after "first"
    rows = [filing(f"a{q}", 2024, q, v) for q, v in ((1, 100e3), (2, 101e3), (3, 99e3), (4, 900e3))]
    by_calendar = detect.spending_spikes(filings(spark, *rows)).collect()
    assert [r.filing_period for r in by_calendar] == ["fourth_quarter"]
    as_text = detect.spending_spikes(filings(spark, *rows), compat=True).collect()
    assert "fourth_quarter" not in [r.filing_period for r in as_text]


def test_renamed_entity_is_one(spark):
    rows = [filing(f"b{q}", 2024, q, 100e3 + q, name="Old" if q < 3 else "New") for q in (1, 2, 3)]
    rows += [filing("b4", 2024, 4, 500e3, name="New"), filing("b5", 2024, 4, 1.0, name="Old")]
    got = detect.spending_spikes(filings(spark, *rows)).collect()
    assert len(got) == 1 and got[0].total_income == 500001.0
    # split by name, the fourth quarter gives two rows, and as text it comes second
    split = detect.spending_spikes(filings(spark, *rows), compat=True, min_income=0, min_z_abs=0)
    assert [(r.filing_period, r.prior_n) for r in split.orderBy("prior_n").collect()] == [
        ("second_quarter", 3), ("third_quarter", 4)]


def test_missing_clusters_first_last(spark):
    rows = [filing(f"m{q}", 2024, q, None) for q in (1, 2, 3, 4)]
    r = detect.missing_value_clusters(filings(spark, *rows)).first()
    assert (r.first_seen, r.last_seen) == ("2024-first_quarter", "2024-fourth_quarter")
    r = detect.missing_value_clusters(filings(spark, *rows), compat=True).first()
    assert (r.first_seen, r.last_seen) == ("2024-first_quarter", "2024-third_quarter")


def test_amendments_left_out_or_kept(spark):
    f = filings(spark, filing("q", 2024, 2, 60e6),
                filing("a", 2024, 2, 60e6, filing_type="2A"), filing("b", 2024, 2, 60e6, filing_type="2A"))
    assert detect.concentrated_entities(f).first().total_income == 60e6
    assert detect.concentrated_entities(f, types=None).first().total_income == 180e6
    got = relate.amendment_collapsed_sum(
        f.withColumn("q", F.regexp_extract("filing_type", r"\d", 0)), entity="registrant_id",
        period=["filing_year", "q"], posted="filing_uuid", value="income", tie="filing_uuid").first()
    assert (got.as_filed_total, got.collapsed_total, got.n_filings, got.n_periods) == (180e6, 60e6, 3, 1)


def test_category_counts_filing_once(spark):
    f = filings(spark, filing("p", 2024, 1, 100.0), filing("n", 2024, 2, 200.0))
    acts = spark.createDataFrame([("p", "TAX"), ("p", "TAX"), ("n", "TAX"), ("n", None)],
                                 "filing_uuid string, general_issue_code string")
    once = detect.category_shift(acts, f).collect()
    assert [(r.total_income, r.prior_income, r.income_delta_pct) for r in once] == [(200.0, 100.0, 100.0)]
    assert detect.category_shift(acts, f, compat=True).count() == 0  # 200 against 2 * 100


def test_new_entrant_window(spark):
    f = filings(spark, filing("x", 2025, 4, 5.0, registrant=1), filing("y", 2026, 1, 6.0, registrant=2),
                filing("z", 2025, 3, 7.0, registrant=3))
    assert sorted(r.registrant_id for r in detect.new_entrants(f).collect()) == [1, 2]
    # year * 10 + quarter puts 2025-Q4 out of reach of 2026-Q1
    assert sorted(r.registrant_id for r in detect.new_entrants(f, compat=True).collect()) == [2]


def tables(spark):
    f = filings(
        spark,
        filing("s1", client_general_description="A Sovereign established government",
               posted_by_name="a/b/c", client_name="Global Public Benefit X"),
        filing("s2", client_general_description="sovereign, established government"),
        filing("s3"))
    acts = spark.createDataFrame(
        [("s1::a0", "s1", 0, "TAX", None, "sui generis"), ("s2::a0", "s2", 0, "TAX", None, "plain")],
        "activity_id string, filing_uuid string, activity_index int, general_issue_code string, "
        "general_issue_code_display string, description string")
    people = spark.createDataFrame(
        [("s1::a0", "s1", 1, "Q", "Z", "Queen of all things")],
        "activity_id string, filing_uuid string, lobbyist_id int, first_name string, "
        "last_name string, covered_position string")
    return {"senate_filings": f, "senate_lobbying_activities": acts,
            "senate_activity_lobbyists": people}


def test_signal_score_and_null_signal(spark):
    t = tables(spark)
    got = {r.filing_uuid: r.shell_score for r in catalogue.run_detector("D9", t).collect()}
    assert got == {"s1": 6, "s2": 2}
    # a null signal voids the score
    got = {r.filing_uuid for r in catalogue.run_detector("D9", t, compat=True).collect()}
    assert got == {"s1"}


def test_registry_gap_keys(spark):
    f = filings(spark, filing("g1", name="Akin Gump LLP", client_country="DE"),
                filing("g2", name="Other Firm", client_country="DE"),
                filing("g3", name="Third", client_country="US", client_name="Ministry of X"),
                filing("g4", name="Fourth", client_country="US"))
    foreign = spark.createDataFrame([(f"g{i}", c, None) for i in (1, 2, 3, 4) for c in ("FR", "DE")],
                                    "filing_uuid string, country string, ppb_country string")
    listed = spark.createDataFrame([("AKIN GUMP, LLP",)], "registrant_name string")
    acts = spark.createDataFrame([("g2", "the embassy"), ("g2", None)], "filing_uuid string, description string")
    t = {"senate_filings": f, "senate_foreign_entities": foreign, "fara_registrants": listed,
         "senate_lobbying_activities": acts}
    got = {r.filing_uuid: r for r in catalogue.run_detector("D10", t).collect()}
    assert set(got) == {"g2", "g3"}
    assert got["g2"].sig_foreign_gov_topic == 1 and got["g2"].fe_countries == "DE,FR"
    assert got["g3"].sig_soe_pattern == 1
    # the compatible key does not recognise the listed firm
    assert set(r.filing_uuid for r in catalogue.run_detector("D10", t, compat=True).collect()) \
        == {"g1", "g2", "g3"}


def test_role_topic_links(spark):
    f = filings(spark, filing("r1", income=10.0), filing("r2", income=5.0, filing_type="RR"))
    acts = spark.createDataFrame(
        [("r1::a0", "r1", "TAX", "d0"), ("r1::a1", "r1", "BUD", "d1"), ("r1::a2", "r1", "AGR", "d2"),
         ("r2::a0", "r2", "TAX", "d")],
        "activity_id string, filing_uuid string, general_issue_code string, description string")
    people = spark.createDataFrame(
        [("r1::a0", "r1", 1, "A", "B", "Senate Finance staff"), ("r2::a0", "r2", 1, "A", "B", None),
         ("r1::a0", "r1", 2, "V", "W", "Veterans counsel"), ("r1::a1", "r1", 3, "S", "T", "finance")],
        "activity_id string, filing_uuid string, lobbyist_id int, first_name string, "
        "last_name string, covered_position string")
    t = {"senate_filings": f, "senate_lobbying_activities": acts, "senate_activity_lobbyists": people}
    got = [(r.lobbyist_id, r.general_issue_code, r.former_committee)
           for r in catalogue.run_detector("D11", t).collect()]
    assert got == [(1, "TAX", "finance")]
    wide = sorted((r.lobbyist_id, r.general_issue_code)
                  for r in catalogue.run_detector("D11", t, link="filing_uuid").collect())
    assert wide == [(1, "BUD"), (1, "TAX")]


def test_say_vs_pay_counts_members_once(spark):
    f = filings(spark, filing("p1", client_name="Apollo Fund", income=9.0))
    people = spark.createDataFrame([("p1", 1, "A", "B", "Finance Committee")] * 2,
                                   "filing_uuid string, lobbyist_id int, first_name string, "
                                   "last_name string, covered_position string")
    seats = spark.createDataFrame([("m1", "Finance", "Chair"), ("m1", "Finance Sub", "Member"),
                                   ("m2", "Other", "x")],
                                  "bioguide_id string, committee_name string, role string")
    members = spark.createDataFrame([("m1", "One", "D", "CA"), ("m2", "Two", "R", "TX")],
                                    "bioguide_id string, name string, party string, state string")
    press = spark.createDataFrame([("m1", "One", "Apollo and private equity"), ("m2", "Two", "apollo"),
                                   ("m2", "Two", "APOLLO Private Equity")],
                                  "bioguide_id string, member_name string, text string")
    t = {"senate_filings": f, "senate_activity_lobbyists": people,
         "congress_committee_assignments": seats, "congress_members": members, "press_releases": press}
    r = catalogue.run_detector("D12", t).collect()
    assert len(r) == 1
    assert (r[0].current_committee_members, r[0].attack_press_releases,
            r[0].committee_members_attacking, r[0].lobbyist) == (1, 2, 1, "A B")
    assert catalogue.run_detector("D12", t, compat=True).first().current_committee_members == 2


def test_catalogue(spark):
    assert catalogue.list_detectors(spark).count() >= 12
    with pytest.raises(KeyError):
        catalogue.run_detector("D99", {})
    with pytest.raises(TypeError):
        catalogue.run_detector("D1", {}, nonsense=1)

    @catalogue.register_detector("X1", "custom", "own detector", n=2)
    def custom(tables, n):
        return tables["senate_filings"].limit(n)

    assert catalogue.run_detector("X1", tables(spark), n=1).count() == 1
    catalogue._DETECTORS.pop("X1")


def test_null_contribution_keys(spark):
    items = spark.createDataFrame([("a", None, 1.0, "f1", "c"), (None, "h", None, "f2", "c"),
                                   (None, None, 9.0, "f3", "c"), ("a", None, 2.0, "f1", "d")],
                                  "payee_name string, honoree_name string, amount double, "
                                  "filing_uuid string, contributor_name string")
    got = [tuple(r) for r in detect.contribution_flow(items).collect()]
    assert got == [("a", None, 2, 3.0, 1, 2), (None, "h", 1, 0.0, 1, 1)]


def test_order_and_partitions_do_not_matter(spark):
    rng = random.Random(3)
    rows = [filing(f"f{i}", 2020 + i % 5, 1 + i % 4, float(rng.randint(1, 900)) * 1000,
                   registrant=rng.choice([1, 1, 1, 2, 3]), client=i % 3) for i in range(300)]
    want = None
    for parts in (1, 7):
        rng.shuffle(rows)
        df = filings(spark, *rows).repartition(parts)
        got = (sorted(map(str, detect.spending_spikes(df, min_z_abs=0.5).collect())),
               [str(r) for r in detect.concentrated_entities(df, max_members=3).collect()])
        got = (got[0], got[1])
        want = want or got
        assert got == want


def test_row_index_matches_plain_numbering(spark):
    rng = random.Random(1)
    rows = list({(rng.choice([1, 1, 2, 3]), rng.randint(0, 5), rng.randint(0, 10 ** 6)) for _ in range(500)})
    df = spark.createDataFrame(rows, "p int, a int, b int")
    got = {(r.p, r.a, r.b): r.i for r in row_index(df, "p", ["a", "b"], "i").collect()}
    for p in {r[0] for r in rows}:
        for i, row in enumerate(sorted(r for r in rows if r[0] == p)):
            assert got[row] == i


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    out = top_k_per_key(df, "k", [F.desc("v")], 2)
    assert sorted(tuple(r) for r in out.collect()) == [
        (0, 996), (0, 999), (1, 994), (1, 997), (2, 995), (2, 998)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
