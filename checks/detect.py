"""Detectors."""

from pyspark.sql import functions as F

from recordloom.functions.text import any_keyword, contains_folded
from recordloom.operators import detect

from .registry import query, rounded

Q = ("(CASE filing_period WHEN 'first_quarter' THEN 1 WHEN 'second_quarter' THEN 2 "
     "WHEN 'third_quarter' THEN 3 ELSE 4 END)")
QUARTERLY = "filing_type IN ('Q1','Q2','Q3','Q4')"


def _d1_sql(entity, label, group, order, limit):
    return f"""
, per AS (SELECT {entity}, {label} AS registrant_name, filing_year, filing_period,
                 sum(income) AS total_income
          FROM filings WHERE {QUARTERLY} AND income IS NOT NULL GROUP BY {group}),
w AS (SELECT *, avg(total_income) OVER h AS prior_mean, stddev_pop(total_income) OVER h AS prior_sd,
             count(*) OVER h AS prior_n
      FROM per WINDOW h AS (PARTITION BY {entity} ORDER BY {order}
                            ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, (total_income - prior_mean) / prior_sd AS z_score FROM w
      WHERE prior_n >= 3 AND prior_sd > 0)
SELECT {entity}, registrant_name, filing_year, filing_period,
       round(total_income, 2) AS total_income, round(prior_mean, 6) AS prior_mean,
       round(prior_sd, 4) AS prior_sd, prior_n, round(z_score, 4) AS z_score
FROM z WHERE total_income >= 50000 AND abs(z_score) >= 2
ORDER BY abs(z_score) DESC, {entity}, registrant_name, filing_year, filing_period {limit}"""


@query("d1_spending_spikes", _d1_sql(
    "registrant_id", "min(registrant_name)", "registrant_id, filing_year, filing_period",
    f"filing_year * 4 + {Q}", ""))
def d1(t):
    return rounded(detect.spending_spikes(t.filings(), limit=None), z_score=4, prior_mean=6, prior_sd=4)


@query("d1_top_spikes", _d1_sql(
    "registrant_id", "min(registrant_name)", "registrant_id, filing_year, filing_period",
    f"filing_year * 4 + {Q}", "LIMIT 200"))
def d1_top(t):
    return rounded(detect.spending_spikes(t.filings(), limit=200), z_score=4, prior_mean=6, prior_sd=4)


@query("d1_compat", _d1_sql(
    "registrant_id", "registrant_name",
    "registrant_id, registrant_name, filing_year, filing_period",
    "filing_year, filing_period", "LIMIT 200"))
def d1_compat(t):
    return rounded(detect.spending_spikes(t.filings(), compat=True), z_score=4, prior_mean=6, prior_sd=4)


@query("d1_by_client", _d1_sql(
    "registrant_id, client_id", "min(registrant_name)",
    "registrant_id, client_id, filing_year, filing_period", f"filing_year * 4 + {Q}", ""))
def d1_by_client(t):
    return rounded(detect.spending_spikes(
        t.filings(), entity=["registrant_id", "client_id"], limit=None), z_score=4, prior_mean=6, prior_sd=4)


@query("d2_missing_income", f"""
SELECT registrant_id, min(registrant_name) AS registrant_name,
       count(*) AS quarterly_filings_with_null_income,
       count(DISTINCT client_id) AS distinct_clients,
       arg_min(filing_year || '-' || filing_period, filing_year * 4 + {Q}) AS first_seen,
       arg_max(filing_year || '-' || filing_period, filing_year * 4 + {Q}) AS last_seen
FROM filings WHERE {QUARTERLY} AND income IS NULL GROUP BY registrant_id HAVING count(*) >= 4
ORDER BY quarterly_filings_with_null_income DESC, distinct_clients DESC, registrant_id LIMIT 200""")
def d2(t):
    return detect.missing_value_clusters(t.filings())


@query("d2_compat", f"""
SELECT registrant_id, registrant_name, count(*) AS quarterly_filings_with_null_income,
       count(DISTINCT client_id) AS distinct_clients,
       min(filing_year || '-' || filing_period) AS first_seen,
       max(filing_year || '-' || filing_period) AS last_seen
FROM filings WHERE {QUARTERLY} AND income IS NULL GROUP BY 1, 2 HAVING count(*) >= 4""")
def d2_compat(t):
    return detect.missing_value_clusters(t.filings(), limit=None, compat=True)


@query("d2_income_and_expenses", f"""
SELECT registrant_id, min(registrant_name) AS registrant_name,
       count(*) AS quarterly_filings_with_null_income,
       count(DISTINCT client_id) AS distinct_clients,
       arg_min(filing_year || '-' || filing_period, filing_year * 4 + {Q}) AS first_seen,
       arg_max(filing_year || '-' || filing_period, filing_year * 4 + {Q}) AS last_seen
FROM filings WHERE {QUARTERLY} AND income IS NULL AND posted_by_name IS NULL
GROUP BY registrant_id HAVING count(*) >= 2""")
def d2_both(t):
    return detect.missing_value_clusters(
        t.filings(), values=("income", "posted_by_name"), min_filings=2, limit=None)


@query("d3_revolving_door", """
, p AS (SELECT lobbyist_id, first_name, last_name, min(covered_position) AS sample_position,
               count(DISTINCT filing_uuid) AS filings_with_lobbyist,
               count(DISTINCT covered_position) AS distinct_positions
        FROM lobbyists WHERE covered_position IS NOT NULL AND length(covered_position) >= 12
        GROUP BY 1, 2, 3),
c AS (SELECT lobbyist_id, string_agg(DISTINCT client_name, ' | ' ORDER BY client_name)
        AS clients_lobbied_for FROM lobbyists JOIN filings USING (filing_uuid) GROUP BY 1)
SELECT p.*, clients_lobbied_for FROM p LEFT JOIN c USING (lobbyist_id)
ORDER BY filings_with_lobbyist DESC, lobbyist_id, first_name, last_name LIMIT 500""")
def d3(t):
    return detect.role_holders(t.lobbyists(), t.filings())


@query("d4_foreign_filings", """
SELECT f.filing_uuid, filing_year, filing_period, registrant_name, client_name, client_country,
       client_ppb_country, foreign_entity_name, fe.country AS foreign_entity_country,
       fe.ppb_country AS foreign_entity_ppb, income, url
FROM foreign_entities fe JOIN filings f ON fe.filing_uuid = f.filing_uuid
ORDER BY income DESC NULLS LAST, f.filing_uuid, foreign_entity_name LIMIT 500""")
def d4(t):
    return detect.foreign_filings(t.foreign_entities(), t.filings())


@query("d5_concentrated", f"""
SELECT registrant_id, min(registrant_name) AS registrant_name,
       count(DISTINCT client_id) AS distinct_clients, count(DISTINCT filing_uuid) AS filings,
       round(sum(coalesce(income, 0)), 2) AS total_income, min(filing_year) AS earliest_year,
       max(filing_year) AS latest_year,
       string_agg(DISTINCT client_name, ' | ' ORDER BY client_name) AS clients
FROM filings WHERE {QUARTERLY} GROUP BY registrant_id
HAVING count(DISTINCT client_id) BETWEEN 1 AND 2 AND sum(coalesce(income, 0)) >= 250000
ORDER BY sum(coalesce(income, 0)) DESC, registrant_id LIMIT 200""")
def d5(t):
    return rounded(detect.concentrated_entities(t.filings()))


@query("d5_as_filed", """
SELECT registrant_id, min(registrant_name) AS registrant_name,
       count(DISTINCT client_id) AS distinct_clients, count(DISTINCT filing_uuid) AS filings,
       round(sum(coalesce(income, 0)), 2) AS total_income, min(filing_year) AS earliest_year,
       max(filing_year) AS latest_year,
       string_agg(DISTINCT client_name, ' | ' ORDER BY client_name) AS clients
FROM filings GROUP BY registrant_id
HAVING count(DISTINCT client_id) BETWEEN 1 AND 2 AND sum(coalesce(income, 0)) >= 250000""")
def d5_as_filed(t):
    return rounded(detect.concentrated_entities(t.filings(), types=None, limit=None))


@query("d6_contribution_flow", """
SELECT payee_name, honoree_name, count(*) AS n_contributions,
       round(sum(coalesce(amount, 0)), 2) AS total_amount,
       count(DISTINCT filing_uuid) AS distinct_filings,
       count(DISTINCT contributor_name) AS distinct_contributors
FROM contribution_items WHERE payee_name IS NOT NULL OR honoree_name IS NOT NULL
GROUP BY 1, 2 ORDER BY sum(coalesce(amount, 0)) DESC, payee_name, honoree_name LIMIT 500""")
def d6(t):
    return rounded(detect.contribution_flow(t.contribution_items()))


@query("d6_by_contributor", """
SELECT contributor_name, honoree_name, count(*) AS n_contributions,
       round(sum(coalesce(amount, 0)), 2) AS total_amount,
       count(DISTINCT filing_uuid) AS distinct_filings,
       count(DISTINCT payee_name) AS distinct_contributors
FROM contribution_items GROUP BY 1, 2""")
def d6_by_contributor(t):
    return rounded(detect.contribution_flow(
        t.contribution_items(), keys=("contributor_name", "honoree_name"),
        source="payee_name", limit=None))


def _d7_sql(source, order, limit):
    return f"""
, per AS (SELECT general_issue_code, filing_year, filing_period,
                 count(DISTINCT registrant_id) AS registrants,
                 sum(coalesce(income, 0)) AS total_income
          FROM {source} a JOIN filings USING (filing_uuid)
          WHERE {QUARTERLY} AND general_issue_code IS NOT NULL GROUP BY 1, 2, 3),
o AS (SELECT *, lag(total_income) OVER h AS prior_income, lag(registrants) OVER h AS prior_registrants
      FROM per WINDOW h AS (PARTITION BY general_issue_code ORDER BY {order}))
SELECT general_issue_code, filing_year, filing_period, registrants,
       round(total_income, 2) AS total_income, round(prior_income, 2) AS prior_income,
       prior_registrants,
       round(100.0::DOUBLE * (total_income - prior_income) / prior_income, 1) AS income_delta_pct,
       CASE WHEN prior_registrants > 0 THEN
         round(100.0::DOUBLE * (registrants - prior_registrants) / prior_registrants, 1) END
         AS registrants_delta_pct
FROM o WHERE prior_income > 0
  AND abs((total_income - prior_income) / prior_income) * 100 >= 25
ORDER BY abs(total_income - prior_income) DESC, 1, 2, 3 {limit}"""


@query("d7_category_shift", _d7_sql("(SELECT DISTINCT filing_uuid, general_issue_code FROM activities)",
                                    f"filing_year * 4 + {Q}", "LIMIT 500"))
def d7(t):
    return rounded(detect.category_shift(t.activities(), t.filings()))


@query("d7_compat", _d7_sql("activities", "filing_year, filing_period", ""))
def d7_compat(t):
    return rounded(detect.category_shift(t.activities(), t.filings(), compat=True, limit=None))


@query("d8_new_entrants", f"""
, r AS (SELECT *, filing_year * 4 + {Q} AS o FROM filings WHERE {QUARTERLY}),
n AS (SELECT registrant_id FROM r GROUP BY 1 HAVING min(o) > (SELECT max(o) FROM r) - 12)
SELECT registrant_id, min(registrant_name) AS registrant_name,
       count(DISTINCT filing_uuid) AS filings_in_window,
       count(DISTINCT client_id) AS distinct_clients,
       round(sum(coalesce(income, 0)), 2) AS total_income,
       string_agg(DISTINCT client_name, ' | ' ORDER BY client_name) AS clients
FROM r JOIN n USING (registrant_id) GROUP BY 1 HAVING sum(coalesce(income, 0)) > 0
ORDER BY sum(coalesce(income, 0)) DESC, registrant_id LIMIT 200""")
def d8(t):
    return rounded(detect.new_entrants(t.filings(), lookback_quarters=12))


@query("d8_compat", f"""
, r AS (SELECT *, filing_year * 10 + CAST(substr(filing_type, 2, 1) AS INTEGER) AS o
        FROM filings WHERE {QUARTERLY}),
n AS (SELECT registrant_id FROM r GROUP BY 1 HAVING min(o) >= (SELECT max(o) FROM r) - 30)
SELECT registrant_id, min(registrant_name) AS registrant_name,
       count(DISTINCT filing_uuid) AS filings_in_window,
       count(DISTINCT client_id) AS distinct_clients,
       round(sum(coalesce(income, 0)), 2) AS total_income,
       string_agg(DISTINCT client_name, ' | ' ORDER BY client_name) AS clients
FROM r JOIN n USING (registrant_id) GROUP BY 1 HAVING sum(coalesce(income, 0)) > 0""")
def d8_compat(t):
    return rounded(detect.new_entrants(t.filings(), lookback_quarters=30, limit=None, compat=True))


@query("d8_top_decile", f"""
, r AS (SELECT *, filing_year * 4 + {Q} AS o FROM filings WHERE {QUARTERLY}),
n AS (SELECT registrant_id, min(o) AS f FROM r GROUP BY 1
      HAVING min(o) > (SELECT max(o) FROM r) - 24),
ft AS (SELECT registrant_id, sum(coalesce(income, 0)) AS first_total
       FROM r JOIN n USING (registrant_id) WHERE o = f GROUP BY 1),
k AS (SELECT registrant_id FROM ft
      WHERE first_total >= (SELECT quantile_disc(first_total, 0.9) FROM ft))
SELECT registrant_id, min(registrant_name) AS registrant_name,
       count(DISTINCT filing_uuid) AS filings_in_window,
       count(DISTINCT client_id) AS distinct_clients,
       round(sum(coalesce(income, 0)), 2) AS total_income,
       string_agg(DISTINCT client_name, ' | ' ORDER BY client_name) AS clients
FROM r JOIN k USING (registrant_id) GROUP BY 1 HAVING sum(coalesce(income, 0)) > 0""")
def d8_top_decile(t):
    return rounded(detect.new_entrants(
        t.filings(), lookback_quarters=24, top_share=0.1, limit=None))


def _d9(t, **params):
    own = {"sig_segment": contains_folded("client_general_description", "building"),
           "sig_posted": F.col("posted_by_name").like("%/%/%")
           | F.col("posted_by_name").like("%LLC%")}
    return detect.multi_signal_score(
        t.filings(), own,
        [(t.activities(), {"sig_ring": any_keyword("description", ("ring", "gizmo")),
                           "sig_widget": any_keyword("description", ("widget",))}),
         (t.lobbyists(), {"sig_role": any_keyword("covered_position", ("anvil", "bolt"))})],
        keep=("filing_year", "filing_period", "registrant_name", "client_name", "income", "url"),
        **params)


def _d9_sql(posted, tail):
    return f"""
, a AS (SELECT filing_uuid, string_agg(coalesce(description, ''), ' ' ORDER BY activity_index) AS txt
        FROM activities GROUP BY 1),
l AS (SELECT filing_uuid, string_agg(coalesce(covered_position, ''), ' | ') AS txt
      FROM lobbyists GROUP BY 1),
s AS (SELECT f.filing_uuid, filing_year, filing_period, registrant_name, client_name, income, url,
        CAST(lower(client_general_description) LIKE '%building%' AS INTEGER) AS sig_segment,
        {posted} AS sig_posted,
        CAST(lower(coalesce(a.txt, '')) LIKE '%ring%' OR lower(coalesce(a.txt, '')) LIKE '%gizmo%'
             AS INTEGER) AS sig_ring,
        CAST(lower(coalesce(a.txt, '')) LIKE '%widget%' AS INTEGER) AS sig_widget,
        CAST(lower(coalesce(l.txt, '')) LIKE '%anvil%' OR lower(coalesce(l.txt, '')) LIKE '%bolt%'
             AS INTEGER) AS sig_role
      FROM filings f LEFT JOIN a USING (filing_uuid) LEFT JOIN l USING (filing_uuid)),
r AS (SELECT *, sig_segment + sig_posted + sig_ring + sig_widget + sig_role AS score FROM s)
SELECT * FROM r WHERE score >= 3 ORDER BY score DESC, income DESC NULLS LAST, filing_uuid {tail}"""


_POSTED = "CAST(posted_by_name LIKE '%/%/%' OR posted_by_name LIKE '%LLC%' AS INTEGER)"


@query("d9_multi_signal", _d9_sql(f"coalesce({_POSTED}, 0)", ""))
def d9(t):
    return _d9(t, limit=None, min_score=3)


@query("d9_top_signals", _d9_sql(f"coalesce({_POSTED}, 0)", "LIMIT 100"))
def d9_top(t):
    return _d9(t, limit=100, min_score=3)


@query("d9_compat", _d9_sql(_POSTED, ""))
def d9_compat(t):
    return _d9(t, limit=None, min_score=3, null_drops=True)


def _d10_sql(key, tail):
    return f"""
, reg AS (SELECT DISTINCT {key.format("'Customer#' || lpad(CAST(s_nationkey * 60 AS VARCHAR), 9, '0')")}
            AS k FROM supplier),
a AS (SELECT filing_uuid, string_agg(description, ' ') AS txt FROM activities GROUP BY 1),
fe AS (SELECT filing_uuid, string_agg(DISTINCT country, ',' ORDER BY country) AS fe_countries
       FROM foreign_entities GROUP BY 1),
s AS (SELECT f.filing_uuid, filing_year, registrant_name, client_name, client_country,
        client_ppb_country, fe_countries, income,
        CAST(client_country IS NOT NULL AND client_country NOT IN ('NATION_1', 'NATION_2')
             AS INTEGER) AS sig_non_us_client,
        CAST(client_ppb_country IS NOT NULL AND client_ppb_country NOT IN ('NATION_1', 'NATION_2')
             AS INTEGER) AS sig_non_us_ppb,
        CAST(lower(coalesce(txt, '')) LIKE '%ring%' OR lower(coalesce(txt, '')) LIKE '%anvil%'
             AS INTEGER) AS sig_foreign_gov_topic,
        CAST(lower(client_name) LIKE '%urgent%' OR lower(client_name) LIKE '%not specified%'
             AS INTEGER) AS sig_soe_pattern, url
      FROM filings f JOIN fe USING (filing_uuid) LEFT JOIN a USING (filing_uuid)
      WHERE filing_year IN (1999, 2000, 2001)
        AND {key.format("registrant_name")} NOT IN (SELECT k FROM reg))
SELECT * FROM s
WHERE sig_non_us_client + sig_non_us_ppb + sig_foreign_gov_topic + sig_soe_pattern > 0
ORDER BY income DESC NULLS LAST, filing_uuid {tail}"""


def _d10(t, **params):
    registry = t.raw("supplier").select(
        F.concat(F.lit("Customer#"), F.lpad((F.col("s_nationkey") * 60).cast("string"), 9, "0"))
        .alias("registrant_name"))
    return detect.registry_gap_candidates(
        t.filings(), t.foreign_entities(), registry, t.activities(), years=(1999, 2000, 2001),
        topic_keywords=("ring", "anvil"), owner_keywords=("urgent", "not specified"),
        home=("NATION_1", "NATION_2"), **params)


@query("d10_registry_gap", _d10_sql("upper({})", "LIMIT 200"))
def d10(t):
    return _d10(t)


@query("d10_all_gaps", _d10_sql("upper({})", ""))
def d10_all(t):
    return _d10(t, limit=None)


@query("d10_compat", _d10_sql("upper(regexp_replace({}, '[^A-Z0-9 ]', ' ', 'g'))", ""))
def d10_compat(t):
    return _d10(t, limit=None, compat=True)


_LABELS = (("red", ("red",)), ("blue", ("blue",)), ("none", ("large",)))
_TOPICS = {"red": ("PROMO",), "blue": ("SMALL", "LARGE"), "none": ()}


def _d11_sql(link, tail):
    return f"""
, lp AS (SELECT DISTINCT lobbyist_id, first_name, last_name, covered_position,
           CASE WHEN lower(covered_position) LIKE '%red%' THEN 'red'
                WHEN lower(covered_position) LIKE '%blue%' THEN 'blue'
                WHEN lower(covered_position) LIKE '%large%' THEN 'none' END AS former_committee
         FROM lobbyists WHERE length(covered_position) >= 12),
who AS (SELECT DISTINCT filing_uuid, {link} lobbyist_id FROM lobbyists),
ca AS (SELECT who.lobbyist_id, f.filing_uuid, filing_year, filing_period, registrant_name,
              client_name, income, general_issue_code, description, url
       FROM who JOIN activities a USING ({link} filing_uuid) JOIN filings f USING (filing_uuid)
       WHERE filing_year = 2001 AND {QUARTERLY} AND income > 0)
SELECT lp.lobbyist_id, first_name, last_name, former_committee, covered_position, filing_uuid,
       filing_year, filing_period, registrant_name, client_name, general_issue_code, description,
       income, url
FROM lp JOIN ca ON lp.lobbyist_id = ca.lobbyist_id
WHERE (former_committee = 'red' AND general_issue_code = 'PROMO')
   OR (former_committee = 'blue' AND general_issue_code IN ('SMALL', 'LARGE'))
ORDER BY income DESC, filing_uuid, lp.lobbyist_id, general_issue_code, description, first_name,
         last_name, covered_position {tail}"""


@query("d11_role_topic_match", _d11_sql("activity_index,", "LIMIT 200"))
def d11(t):
    return detect.role_topic_match(t.lobbyists(), t.activities(), t.filings(), labels=_LABELS,
                                   topics=_TOPICS, years=(2001,))


@query("d11_by_filing", _d11_sql("", "LIMIT 200"))
def d11_by_filing(t):
    return detect.role_topic_match(t.lobbyists(), t.activities(), t.filings(), labels=_LABELS,
                                   topics=_TOPICS, years=(2001,), link="filing_uuid")


def _d12_sql(member_key, press, tail):
    return f"""
, lp AS (SELECT DISTINCT lobbyist_id, first_name, last_name, covered_position FROM lobbyists
         WHERE lower(covered_position) LIKE '%red%'),
cm AS (SELECT DISTINCT {member_key} FROM committee_assignments a JOIN members m USING (bioguide_id)
       WHERE lower(committee_name) LIKE '%red%'),
pa AS (SELECT * FROM press_releases WHERE lower(text) LIKE '%license%' {press}),
x AS (SELECT DISTINCT f.filing_uuid, registrant_name, client_name, income, lp.first_name,
             lp.last_name, lp.covered_position
      FROM filings f JOIN lobbyists al USING (filing_uuid)
      JOIN lp ON lp.lobbyist_id = al.lobbyist_id
      WHERE lower(client_name) LIKE '%urgent%' AND filing_year = 2001)
SELECT registrant_name AS lobbying_firm, client_name AS lobbied_client,
       first_name || ' ' || last_name AS lobbyist, covered_position AS former_role,
       (SELECT count(*) FROM cm) AS current_committee_members,
       (SELECT count(*) FROM pa) AS attack_press_releases,
       (SELECT count(DISTINCT member_name) FROM pa WHERE bioguide_id IN (SELECT bioguide_id FROM cm))
         AS committee_members_attacking, income
FROM x ORDER BY income DESC NULLS LAST, filing_uuid, first_name, last_name, covered_position {tail}"""


def _d12(t, **params):
    return detect.say_vs_pay(
        t.filings(), t.lobbyists(), t.committee_assignments(), t.members(), t.press_releases(),
        target_committee="red", client_pattern="%urgent%", press_pattern="%license%",
        years=(2001,), **params)


@query("d12_say_vs_pay", _d12_sql("bioguide_id", "AND lower(text) LIKE '%the%'", ""))
def d12(t):
    return _d12(t, press_term="the", limit=None)


@query("d12_top", _d12_sql("bioguide_id", "", "LIMIT 200"))
def d12_top(t):
    return _d12(t, press_term=None)


@query("d12_compat", _d12_sql("bioguide_id, name, party, state, role", "", ""))
def d12_compat(t):
    return _d12(t, press_term=None, limit=None, compat=True)
