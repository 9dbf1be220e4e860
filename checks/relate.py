"""Registry gaps, awards, amendments, further catalogue entries and load checks."""

from pyspark.sql import functions as F

from recordloom.operators import detect, postings, relate, sanity, sketches
from recordloom.session import stage_path

from .registry import query, rounded


@query("registry_gap", """
, a AS (SELECT DISTINCT upper(registrant_name) AS k FROM filings
        JOIN foreign_entities USING (filing_uuid) WHERE filing_year BETWEEN 1999 AND 2001),
b AS (SELECT DISTINCT 'CUSTOMER#' || lpad(CAST(s_nationkey * 60 AS VARCHAR), 9, '0') AS k FROM supplier)
SELECT coalesce(a.k, b.k) AS name_key,
       CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both'
            WHEN a.k IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side
FROM a FULL JOIN b ON a.k = b.k""")
def registry_gap(t):
    filers = t.filings().where(F.col("filing_year").between(1999, 2001)).join(
        t.foreign_entities(), "filing_uuid", "left_semi")
    return relate.registry_gap(filers, _listed(t), "registrant_name", "listed_name")


def _listed(t):
    return t.raw("supplier").select(
        F.concat(F.lit("Customer#"), F.lpad((F.col("s_nationkey") * 60).cast("string"), 9, "0"))
        .alias("listed_name"), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string"))
        .alias("listed_country"))


@query("registry_gap_counts", """
, a AS (SELECT DISTINCT upper(registrant_name) AS k FROM filings
        JOIN foreign_entities USING (filing_uuid)),
b AS (SELECT DISTINCT 'CUSTOMER#' || lpad(CAST(s_nationkey * 60 AS VARCHAR), 9, '0') AS k FROM supplier),
j AS (SELECT a.k AS ak, b.k AS bk FROM a FULL JOIN b ON a.k = b.k)
SELECT count(ak) AS n_left, count(bk) AS n_right,
       count(*) FILTER (WHERE ak IS NOT NULL AND bk IS NOT NULL) AS n_both,
       count(*) FILTER (WHERE bk IS NULL) AS n_left_only,
       count(*) FILTER (WHERE ak IS NULL) AS n_right_only FROM j""")
def registry_gap_counts(t):
    filers = t.filings().join(t.foreign_entities(), "filing_uuid", "left_semi")
    return relate.registry_gap_counts(
        relate.registry_gap(filers, _listed(t), "registrant_name", "listed_name"))


@query("country_mismatch", """
, a AS (SELECT DISTINCT upper(registrant_name) AS k, client_country AS c FROM filings),
b AS (SELECT DISTINCT 'CUSTOMER#' || lpad(CAST(s_nationkey * 60 AS VARCHAR), 9, '0') AS k,
             'NATION_' || CAST(s_nationkey AS VARCHAR) AS c FROM supplier),
na AS (SELECT k, count(*) AS n_left_countries FROM a GROUP BY k),
nb AS (SELECT k, count(*) AS n_right_countries FROM b GROUP BY k)
SELECT na.k AS name_key, n_left_countries, n_right_countries FROM na JOIN nb ON na.k = nb.k
WHERE NOT EXISTS (SELECT 1 FROM a JOIN b ON a.k = b.k AND a.c = b.c WHERE a.k = na.k)""")
def country_mismatch(t):
    return relate.country_mismatch(
        t.filings(), _listed(t), left_name="registrant_name", right_name="listed_name",
        left_country="client_country", right_country="listed_country")


@query("amendment_collapse", r"""
, v AS (SELECT registrant_id, filing_year, regexp_extract(filing_type, '(\d)', 1) AS q,
               coalesce(income, 0) AS income,
               row_number() OVER (PARTITION BY registrant_id, filing_year,
                 regexp_extract(filing_type, '(\d)', 1) ORDER BY dt_posted DESC, filing_uuid DESC) AS rn
        FROM filings)
SELECT registrant_id, round(sum(income), 2) AS as_filed_total,
       round(sum(CASE WHEN rn = 1 THEN income ELSE 0 END), 2) AS collapsed_total,
       count(*) AS n_filings, count(*) FILTER (WHERE rn = 1) AS n_periods
FROM v GROUP BY 1""")
def amendment_collapse(t):
    filings = t.filings().withColumn("q", F.regexp_extract("filing_type", r"(\d)", 1))
    return rounded(relate.amendment_collapsed_sum(
        filings, entity="registrant_id", period=["filing_year", "q"], posted="dt_posted",
        value="income", tie="filing_uuid"))


@query("award_pairing", """
WITH s AS (SELECT user_id, min(ts) AS started FROM events WHERE event_type = 'signup' GROUP BY 1),
p AS (SELECT e.user_id, started, ts AS awarded, event_id, value,
             row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS rn
      FROM events e JOIN s ON e.user_id = s.user_id
      WHERE event_type = 'purchase' AND ts >= started)
SELECT user_id, CAST(started AS VARCHAR) AS started, CAST(awarded AS VARCHAR) AS awarded, event_id, value
FROM p WHERE rn = 1""", prelude=False)
def award_pairing(t):
    events = t.raw("events")
    out = relate.first_award_after(
        events.where(F.col("event_type") == "signup").select("user_id", F.col("ts").alias("started")),
        events.where(F.col("event_type") == "purchase").select(
            "user_id", F.col("ts").alias("awarded"), "event_id", "value"),
        key="user_id", start="started", awarded="awarded", tie="event_id", keep=["value"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("started", "awarded")})


@query("award_pairing_each", """
WITH e AS (SELECT event_id AS engagement, user_id, ts FROM events WHERE event_type <> 'purchase'),
a AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
p AS (SELECT engagement, e.user_id, e.ts AS started, a.ts AS awarded, a.event_id, a.value,
        row_number() OVER (PARTITION BY engagement ORDER BY a.ts NULLS LAST, a.event_id) AS rn
      FROM e LEFT JOIN a ON a.user_id = e.user_id AND a.ts >= e.ts)
SELECT engagement, user_id, CAST(started AS VARCHAR) AS started, CAST(awarded AS VARCHAR) AS awarded, event_id, value
FROM p WHERE rn = 1""", prelude=False)
def award_pairing_each(t):
    events = t.raw("events")
    bought = F.col("event_type") == "purchase"
    out = relate.next_awards(
        events.where(~bought).select(F.col("event_id").alias("engagement"), "user_id", F.col("ts").alias("started")),
        events.where(bought).select("user_id", F.col("ts").alias("awarded"), "event_id", "value"),
        key="user_id", start="started", awarded="awarded", tie="event_id", keep=["value"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("started", "awarded")})


@query("award_totals", """
WITH ranked AS (SELECT c_name, o_orderkey, o_totalprice,
    row_number() OVER (PARTITION BY c_name ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT c_name, count(*) AS n, sum(o_totalprice) AS s,
        string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 5) AS top_awards
      FROM ranked GROUP BY 1)
SELECT c.c_name || ', Inc.' AS client, coalesce(n, 0) AS n_awards,
       round(coalesce(s, 0), 2) AS total_amount, top_awards
FROM customer c LEFT JOIN a USING (c_name)""", prelude=False)
def award_totals(t):
    clients = t.raw("customer").select(F.concat("c_name", F.lit(", Inc.")).alias("client_name"))
    awards = t.raw("orders").join(
        t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.upper("c_name").alias("recipient"), "o_orderkey", "o_totalprice")
    return rounded(relate.engagement_award_totals(
        clients, awards, client="client_name", recipient="recipient", amount="o_totalprice",
        award="o_orderkey"))


@query("top_countries", """
SELECT country, count(*) AS n FROM foreign_entities WHERE country IS NOT NULL
GROUP BY 1 ORDER BY n DESC, country LIMIT 15""")
def top_countries(t):
    return relate.top_countries(t.foreign_entities(), "country")


@query("exact_copies", """
SELECT min(doc_id) AS doc_id, sha256(text) AS text_sha FROM documents GROUP BY text""", prelude=False)
def exact_copies(t):
    return relate.exact_copies(t.raw("documents"), "text", "doc_id")


@query("bill_mentions", r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+ \d{1,5}')) AS m FROM documents)
SELECT upper(regexp_replace(m, '[.\s]', '', 'g')) AS mention, count(*) AS n_mentions,
       count(DISTINCT doc_id) AS n_records FROM m GROUP BY 1""", prelude=False)
def bill_mentions(t):
    return detect.pattern_mentions(t.raw("documents"), "text", pattern=r"[A-Za-z]+ \d{1,5}",
                                   record="doc_id")


@query("undisclosed_foreign_name", """
SELECT client_id, client_name, count(*) AS n_filings,
       round(sum(coalesce(income, 0)), 2) AS total_income
FROM filings WHERE regexp_matches(client_name, '(?i)(?:^|\\W)(?:LOW|HIGH)(?:\\W|$)')
  AND filing_uuid NOT IN (SELECT filing_uuid FROM foreign_entities)
GROUP BY 1, 2""".replace("\\\\", "\\"))
def undisclosed_foreign_name(t):
    return rounded(detect.undisclosed_foreign_name(
        t.filings(), t.foreign_entities(), suffixes=("low", "high")))


@query("donor_topic_divergence", """
, top AS (SELECT 'src' || honoree_name AS honoree_name, sum(amount) AS total_amount
          FROM contribution_items GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
g AS (SELECT 'src' || honoree_name AS honoree_name, contributor_name, sum(amount) AS given
      FROM contribution_items GROUP BY 1, 2),
l AS (SELECT DISTINCT CAST(lobbyist_id AS VARCHAR) AS contributor_name, general_issue_code
      FROM lobbyists),
w AS (SELECT honoree_name, total_amount, general_issue_code, count(*) AS n_donors,
             sum(given) AS donor_amount
      FROM g JOIN top USING (honoree_name) JOIN l USING (contributor_name) GROUP BY 1, 2, 3),
s AS (SELECT member_name, 'PROMO' AS code FROM press_releases WHERE lower(text) LIKE '%license%'
      UNION ALL SELECT member_name, 'SMALL' FROM press_releases WHERE lower(text) LIKE '%password%'
                                                                OR lower(text) LIKE '%secret%'),
n AS (SELECT member_name AS honoree_name, code AS general_issue_code, count(*) AS n_statements
      FROM s GROUP BY 1, 2)
SELECT honoree_name, round(total_amount, 2) AS total_amount, general_issue_code, n_donors,
       round(donor_amount, 2) AS donor_amount, coalesce(n_statements, 0) AS n_statements,
       CAST(n_statements IS NULL AS INTEGER) AS divergent
FROM w LEFT JOIN n USING (honoree_name, general_issue_code)""")
def donor_topic_divergence(t):
    items = t.contribution_items().withColumn(
        "honoree_name", F.concat(F.lit("src"), "honoree_name"))
    links = t.lobbyists().select(
        F.col("lobbyist_id").cast("string").alias("contributor_name"), "general_issue_code")
    return rounded(detect.donor_topic_divergence(
        items, links, t.press_releases(),
        topic_words={"PROMO": ("license",), "SMALL": ("password", "secret")}))


@query("role_text_parse", r"""
, p AS (SELECT DISTINCT lobbyist_id, covered_position FROM lobbyists
        WHERE length(covered_position) >= 12),
c AS (SELECT lobbyist_id, count(DISTINCT client_name) AS n_clients
      FROM lobbyists JOIN filings USING (filing_uuid) GROUP BY 1)
SELECT p.lobbyist_id, covered_position,
       nullif(regexp_extract(covered_position, '^(red|blue|small)', 1), '') AS committee,
       nullif(regexp_extract(covered_position, '(Brand#\d+)', 1), '') AS member,
       nullif(regexp_extract(covered_position, '^\w+ (\w+)', 1), '') AS job,
       coalesce(n_clients, 0) AS n_clients
FROM p LEFT JOIN c USING (lobbyist_id)""")
def role_text_parse(t):
    return detect.role_text_parse(
        t.lobbyists(), t.filings(), committee=r"^(red|blue|small)", member=r"(Brand#\d+)",
        job=r"^\w+ (\w+)")


@query("corpus_name_search", """
SELECT 'part' AS table_name, CAST(p_partkey AS VARCHAR) AS record_id, 'p_name' AS column_name
FROM part WHERE upper(p_name) LIKE '%RING%'
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'c_mktsegment' FROM customer
WHERE upper(c_mktsegment) LIKE '%RING%'
UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), 'text' FROM documents
WHERE upper(text) LIKE '%RING%'
UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR), 'text' FROM conversations
WHERE upper(text) LIKE '%RING%'
UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR), 'role' FROM conversations
WHERE upper(role) LIKE '%RING%'""", prelude=False)
def corpus_name_search(t):
    return detect.corpus_name_search({
        "part": (t.raw("part"), "p_partkey", ["p_name", "p_brand"]),
        "customer": (t.raw("customer"), "c_custkey", ["c_name", "c_mktsegment"]),
        "documents": (t.raw("documents"), "doc_id", ["text", "source"]),
        "conversations": (t.raw("conversations"), "conv_id", ["text", "role"]),
    }, "ring")


INDEXED = {
    "part": ("p_partkey", ["p_name", "p_brand"]),
    "customer": ("c_custkey", ["c_name", "c_mktsegment"]),
    "documents": ("doc_id", ["text", "source"]),
    "conversations": ("conv_id", ["text", "role"]),
}
CELLS = " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, CAST({ident} AS VARCHAR) AS record_id, '{c}' AS column_name, "
    rf"regexp_replace(lower({c}), '[\x20\x09-\x0D]+', ' ', 'g') AS cell FROM {name}"
    for name, (ident, columns) in INDEXED.items() for c in columns)


def _indexed(t):
    index = postings.TokenIndex(t.spark, stage_path(t.spark, "postings"))
    for name, (ident, columns) in INDEXED.items():  # a batch per table
        postings.add(index, {name: (t.raw(name), ident, columns)}, batch=name)
    return index


@query("token_index_search", f"""
SELECT DISTINCT needle, table_name, record_id, column_name
FROM ({CELLS}), (VALUES ('ring'), ('ue ring'), ('il'), ('ed wid')) AS n(needle)
WHERE contains(cell, needle)""", prelude=False)
def token_index_search(t):
    """Names, parts of names and parts of two words, all from stored postings."""
    index = _indexed(t)
    out = None
    for needle in ("ring", "ue ring", "il", "ed wid"):
        hits = postings.search(index, needle).select(F.lit(needle).alias("needle"), "*")
        out = hits if out is None else out.unionByName(hits)
    return out


@query("token_index_unknown", rf"""
SELECT DISTINCT w AS token FROM (
  SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM benchmark)
WHERE w NOT IN (SELECT unnest(string_split(cell, ' ')) FROM ({CELLS}) WHERE cell IS NOT NULL)""", prelude=False)
def token_index_unknown(t):
    """Words of the benchmark that no indexed table holds, as a look-up by key."""
    return postings.unknown(_indexed(t), t.raw("benchmark").select(
        F.explode(postings.words(F.col("text"))).alias("token")))


@query("distinct_rolling", """
, there AS (SELECT DISTINCT client_country, filing_year FROM filings)
SELECT t.client_country, t.filing_year, count(DISTINCT registrant_id) AS registrant_id,
       count(DISTINCT filing_uuid) AS filing_uuid, true AS registrant_id_within, true AS filing_uuid_within
FROM there t JOIN filings f ON f.client_country IS NOT DISTINCT FROM t.client_country
                           AND f.filing_year BETWEEN t.filing_year - 2 AND t.filing_year
GROUP BY 1, 2""")
def distinct_rolling(t):
    """Exact distinct counts over three years, and whether the estimate from stored sketches (a load per year's
    parity) is within four standard errors of each."""
    rows, keys, counted = t.filings(), ["client_country"], ["registrant_id", "filing_uuid"]
    store = sketches.DistinctStore(t.spark, stage_path(t.spark, "sketches"), keys, "filing_year", counted)
    for batch, half in (("even", 0), ("odd", 1)):
        sketches.add(store, rows.where(F.col("filing_year") % 2 == half), batch)
    exact = sketches.exact_rolling(rows, keys, "filing_year", counted, 3)
    return sketches.compared(exact, sketches.rolling(store, 3), [*keys, "filing_year"], counted).drop(
        "registrant_id_estimate", "filing_uuid_estimate")


@query("name_totals", """
SELECT registrant_id, min(registrant_name) AS registrant_name, count(*) AS n_records,
       round(sum(coalesce(income, 0)), 2) AS total_income
FROM filings WHERE upper(client_name) LIKE '%ER%' OR upper(client_general_description) LIKE '%ER%'
GROUP BY 1""")
def name_totals(t):
    return rounded(detect.name_totals(
        t.filings(), "er", columns=["client_name", "client_general_description"]))


@query("sanity_checks", """
SELECT 'rows' AS check_name, 'filings' AS detail, CAST(count(*) AS DOUBLE) AS value FROM filings
UNION ALL SELECT 'rows', 'foreign_entities', count(*) FROM foreign_entities
UNION ALL SELECT 'rows', 'press_releases', count(*) FROM press_releases
UNION ALL SELECT 'null_keys', 'filings.filing_uuid', count(*) FILTER (WHERE filing_uuid IS NULL) FROM filings
UNION ALL SELECT 'rows_per_filing_year', CAST(filing_year AS VARCHAR), count(*) FROM filings GROUP BY filing_year
UNION ALL SELECT 'coverage_pct', 'senate_id', round(100.0::DOUBLE * count(senate_id) / count(*), 1) FROM registry_b
UNION ALL SELECT 'distinct', 'registrant_id', count(DISTINCT registrant_id) FROM filings
UNION ALL SELECT 'distinct_with', 'registrant_id+posted_by_name',
  count(DISTINCT registrant_id) FILTER (WHERE posted_by_name IS NOT NULL) FROM filings
UNION ALL SELECT * FROM (SELECT 'top_country', country, count(*) AS n FROM foreign_entities
  GROUP BY country ORDER BY n DESC, country LIMIT 20)""")
def sanity_checks(t):
    filings = t.filings()
    parts = [
        sanity.table_checks(filings, "filings", "filing_uuid"),
        sanity.table_checks(t.foreign_entities(), "foreign_entities"),
        sanity.table_checks(t.press_releases(), "press_releases"),
        sanity.rows_per(filings, "filing_year"),
        sanity.table_checks(t.registry_b(), "registry_b", covered=["senate_id"]).where("check_name <> 'rows'"),
        sanity.distinct_with(filings, "registrant_id", "posted_by_name"),
        sanity.frequent_values(t.foreign_entities(), "country"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
