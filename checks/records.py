"""Evidence cards, claim graph and audit."""

from pyspark.sql import functions as F

from recordloom.functions.coerce import strip_null
from recordloom.functions.names import slugify
from recordloom.operators import audit, cards, claims

from .registry import query, rounded

CARD_SQL = r"""
, lines AS (
  SELECT CAST(filing_uuid AS VARCHAR) AS id, 0 AS s, 0 AS p,
    '# Evidence card :: Senate LDA filing `' || filing_uuid || '`' || chr(10) || chr(10)
    || '- **Source kind:** senate_filing' || chr(10)
    || '- **Filing UUID:** `' || filing_uuid || '`' || chr(10)
    || '- **Public document:** https://lda.senate.gov/filings/public/filing/' || filing_uuid || '/print/' || chr(10)
    || '- **API record:** ' || url || chr(10)
    || '- **Filing type / period:** None (' || filing_year || ' ' || filing_period || ')' || chr(10)
    || '- **Posted:** ' || strftime(dt_posted, '%Y-%m-%d') || chr(10) || chr(10)
    || '## Registrant' || chr(10)
    || '- ' || registrant_name || ' (id ' || registrant_id || ')' || chr(10)
    || '- State: None; country: None; PPB country: None' || chr(10)
    || '- House registrant id (bridge): None' || chr(10) || chr(10)
    || '## Client' || chr(10)
    || '- ' || client_name || ' (id ' || client_id || ')' || chr(10)
    || '- State: None; country: ' || client_country || '; PPB country: None' || chr(10)
    || '- Description: ' || client_general_description || chr(10) || chr(10)
    || '## Financials' || chr(10)
    || '- Income reported: ' || coalesce(regexp_replace(printf('%.6f', income), '(\.\d)(\d*?)0+$', '\1\2'), 'None') || chr(10)
    || '- Expenses reported: None (no method)' || chr(10) || chr(10)
    || '## Lobbying activities' AS line
  FROM filings
  UNION ALL SELECT CAST(filing_uuid AS VARCHAR), 1, activity_index,
    '- **' || general_issue_code || '** (None) — ' || description FROM activities
  UNION ALL SELECT DISTINCT CAST(filing_uuid AS VARCHAR), 2, -1, chr(10) || '## Lobbyists' FROM lobbyists
  UNION ALL SELECT CAST(filing_uuid AS VARCHAR), 2, 0, '- ' || first_name || ' ' || last_name
    || coalesce('  ' || chr(10) || '    _covered position:_ ' || covered_position, '') FROM lobbyists
  UNION ALL SELECT DISTINCT CAST(filing_uuid AS VARCHAR), 3, -1, chr(10) || '## Foreign entities'
    FROM foreign_entities
  UNION ALL SELECT CAST(filing_uuid AS VARCHAR), 3, 0, '- ' || foreign_entity_name || ' — country: '
    || country || ', ppb: None, ownership: None, contribution: None' FROM foreign_entities
  UNION ALL SELECT DISTINCT CAST(filing_uuid AS VARCHAR), 4, -1, chr(10) || '## Government entities lobbied'
    FROM govt_entities
  UNION ALL SELECT DISTINCT CAST(filing_uuid AS VARCHAR), 4, 0, '- ' || govt_entity_name
    FROM govt_entities)"""


def card_tables(t):
    return {
        "senate_filings": t.filings().withColumn("dt_posted", F.date_format("dt_posted", "yyyy-MM-dd")),
        "senate_lobbying_activities": t.indexed_activities(),
        "senate_activity_lobbyists": t.lobbyists(),
        "senate_foreign_entities": t.foreign_entities(),
        "senate_activity_govt_entities": t.govt_entities(),
    }


def filing_ids(t):
    return t.raw("orders").select(F.col("o_orderkey").alias("id"))


@query("card_lines", CARD_SQL + """
SELECT id, s AS section, p AS position, line FROM lines WHERE id IN
  (SELECT CAST(o_orderkey AS VARCHAR) FROM orders)""")
def card_lines(t):
    return cards.card_lines("senate_filing", filing_ids(t), card_tables(t))


@query("cards_senate", CARD_SQL + """
SELECT 'senate_filing' AS source, id, string_agg(line, chr(10) ORDER BY s, p, line) || chr(10) AS card_md
FROM lines WHERE id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders) GROUP BY id""")
def cards_senate(t):
    return cards.cards("senate_filing", filing_ids(t), card_tables(t))


@query("cards_press", r"""
SELECT 'press_release' AS source, press_id AS id,
  '# Evidence card :: press release `' || press_id || '`' || chr(10) || chr(10)
  || '- **Source kind:** press_release' || chr(10)
  || '- **Member:** ' || member_name || ' (None-None, None, bioguide `' || bioguide_id || '`)' || chr(10)
  || '- **Title:** None' || chr(10) || '- **Date:** None (None)' || chr(10) || '- **URL:** None' || chr(10)
  || '- **Collected at:** None' || chr(10) || chr(10) || '## Body' || chr(10) || chr(10)
  || '```' || chr(10) || substr(text, 1, 5000) || chr(10) || '```'
  || CASE WHEN length(text) > 5000 THEN chr(10) || chr(10) || '_(truncated; full text '
       || length(text) || ' chars)_' ELSE '' END || chr(10) AS card_md
FROM press_releases""")
def cards_press(t):
    press = t.press_releases()
    return cards.cards("press_release", press.select(F.col("press_id").alias("id")),
                       {"press_releases": press})


@query("card_missing_ids", """
SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id FROM lineitem
WHERE l_partkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""", prelude=False)
def card_missing_ids(t):
    asked = t.raw("lineitem").select(F.col("l_partkey").alias("id"))
    return cards.missing_ids(asked, t.raw("orders").where("o_orderstatus = 'F'"), "o_orderkey")


PHRASE = "[A-Z][a-z]+ [A-Z][a-z]+"
MENTION_SQL = f"""
, m AS (SELECT claim_id, unnest(regexp_extract_all(statement, '{PHRASE}')) AS entity,
               generate_subscripts(regexp_extract_all(statement, '{PHRASE}'), 1) - 1 AS pos FROM claims),
mentions AS (SELECT claim_id, entity, CAST(min(pos) AS INTEGER) AS first_pos FROM m
             WHERE length(entity) BETWEEN 4 AND 80 GROUP BY 1, 2),
edges AS (
  SELECT claim_id AS src, entity AS dst, 'entity' AS kind FROM mentions
  UNION SELECT claim_id, card, 'card' FROM claims WHERE card IS NOT NULL
  UNION SELECT claim_id, query_hash, 'query' FROM claims
  UNION SELECT claim_id, url, 'url' FROM claims)"""
MENTIONS = {"pattern": PHRASE, "group": 0}


@query("entity_mentions", MENTION_SQL + "\nSELECT * FROM mentions")
def entity_mentions(t):
    return claims.entity_mentions(t.claims(), **MENTIONS)


@query("claim_edges", MENTION_SQL + "\nSELECT * FROM edges")
def claim_edges(t):
    return claims.claim_edges(t.claims(), **MENTIONS)


@query("node_degrees", MENTION_SQL + """
SELECT kind, dst, count(*) AS n_claims FROM edges GROUP BY 1, 2""")
def node_degrees(t):
    return claims.node_degrees(claims.claim_edges(t.claims(), **MENTIONS))


@query("redact", """
SELECT claim_id, CASE WHEN length(statement) > 200 THEN '[REDACTED]' ELSE statement END AS statement,
       '[REDACTED]' AS url, archive_path FROM claims""")
def redact(t):
    return claims.redact(t.claims()).select(
        "claim_id", "statement", F.col("external_sources")[0]["url"].alias("url"),
        F.col("external_sources")[0]["archive_path"].alias("archive_path"))


@query("card_refs", r"""
SELECT claim_id, card, nullif(regexp_extract(card, '^(senate_filing|house_filing|press_release)_(.+)\.md$', 1), '') AS kind,
       nullif(regexp_extract(card, '^(senate_filing|house_filing|press_release)_(.+)\.md$', 2), '') AS record_id
FROM claims WHERE card IS NOT NULL""")
def card_refs(t):
    cited = t.claims().select("claim_id", F.explode("supporting_cards").alias("card"))
    return cited.select("claim_id", "card", claims.card_kind("card").alias("kind"),
                        claims.card_record("card").alias("record_id"))


@query("summary_counts", """
SELECT confidence, fact_check_status AS verdict, count(*) AS n_claims FROM claims GROUP BY 1, 2""")
def summary_counts(t):
    return claims.summary_counts(t.claims())


@query("slugify", r"""
SELECT page_id, substr(trim(regexp_replace(regexp_replace(url, '[^A-Za-z0-9\- ]+', '', 'g'), '\s+', ' ', 'g')), 1, 64) AS slug
FROM pages""", prelude=False)
def slugs(t):
    return t.raw("pages").select("page_id", slugify("url").alias("slug"))


@query("citation_closure", r"""
WITH o AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="(/[A-Za-z]+)"', 1)) AS token FROM pages),
g AS (SELECT DISTINCT unnest(regexp_extract_all('/' || replace(text, ' ', '/'), '/[A-Za-z]+')) AS token FROM benchmark)
SELECT token FROM o WHERE token NOT IN (SELECT token FROM g)""", prelude=False)
def citation_closure(t):
    out = audit.citation_tokens(t.raw("pages"), "html", 'href="(/[A-Za-z]+)"', 1)
    truth = t.raw("benchmark").select(
        F.concat(F.lit("/"), F.replace("text", F.lit(" "), F.lit("/"))).alias("text"))
    return audit.citation_closure(out.select(F.col("token").alias("text")), truth,
                                  pattern="/[A-Za-z]+")


@query("citation_orphans_urls", r"""
WITH o AS (SELECT DISTINCT unnest(regexp_extract_all(url, 'https?://[^\s)"]+')) AS token FROM pages),
g AS (SELECT DISTINCT unnest(regexp_extract_all(text, 'https?://[^\s)"]+')) AS token FROM documents)
SELECT token FROM o WHERE token NOT IN (SELECT token FROM g)""", prelude=False)
def citation_orphans_urls(t):
    return audit.citation_closure(t.raw("pages").select(F.col("url").alias("text")),
                                  t.raw("documents").select("text"))


@query("citation_closure_text", r"""
WITH ids AS (SELECT page_id, url, regexp_replace(md5(CAST(page_id AS VARCHAR)),
    '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS id FROM pages),
truth AS (SELECT 'see https://h.example/' || id || '/print, ' || url || ', and (' || url || ') x' AS t FROM ids WHERE page_id % 3 = 0
  UNION ALL SELECT 'https://archive.example/web/' || url FROM ids WHERE page_id % 3 = 1),
cited AS (SELECT DISTINCT id AS token FROM ids
  UNION SELECT DISTINCT regexp_extract(url, '^https?://[^\s)"?]+') FROM ids)
SELECT token FROM cited WHERE NOT EXISTS (SELECT 1 FROM truth WHERE contains(t, token))""", prelude=False)
def citation_closure_text(t):
    ident = F.regexp_replace(F.md5(F.col("page_id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    rows = t.raw("pages").select("page_id", "url", ident.alias("id"))
    truth = rows.where("page_id % 3 = 0").select(F.concat(
        F.lit("see https://h.example/"), "id", F.lit("/print, "), "url", F.lit(", and ("), "url", F.lit(") x")).alias("text"))
    truth = truth.unionByName(rows.where("page_id % 3 = 1").select(
        F.concat(F.lit("https://archive.example/web/"), "url").alias("text")))
    cited = rows.select(F.concat_ws(" ", F.col("id"), F.regexp_extract("url", r"^https?://[^\s)\"?]+", 0)).alias("text"))
    return audit.citation_closure_text(cited, truth)


@query("vintage_diff", """
WITH a AS (SELECT user_id, event_type, sum(value) AS v FROM events
           WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1, 2),
b AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type,
       round(a.v, 2) AS old_value, round(b.v, 2) AS new_value,
       CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed'
            WHEN round(a.v, 2) = round(b.v, 2) THEN 'same' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type""", prelude=False)
def vintage_diff(t):
    def pull(df):
        return df.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("v"))

    events = t.raw("events")
    return audit.vintage_diff(pull(events.where(F.col("ts") < F.lit("2024-01-10").cast("timestamp"))),
                              pull(events), ["user_id", "event_type"], "v")


@query("supersession", """
SELECT conv_id, turn, role, lead(turn) OVER w AS valid_to, lead(turn) OVER w IS NULL AS is_current
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""", prelude=False)
def supersession(t):
    return audit.supersession_history(
        t.raw("conversations").select("conv_id", "turn", "role"), "conv_id", "turn")


@query("ledger_integrity", """
, known AS (SELECT 'senate_filing_' || CAST(o_orderkey AS VARCHAR) || '.md' AS card FROM orders
            WHERE o_orderstatus = 'F'),
prov AS (SELECT DISTINCT substr(sha256(source), 1, 16) AS h FROM documents
         WHERE source IN (SELECT bioguide_id FROM committee_assignments
                          WHERE committee_name = 'red committee')),
ev AS (SELECT * FROM claims WHERE confidence <> 'high')
SELECT 'not in map' AS rule, claim_id, CAST(NULL AS VARCHAR) AS detail FROM claims
WHERE confidence IN ('high', 'medium') AND fact_check_status IN ('verified', 'partially_verified')
  AND claim_id NOT IN (SELECT claim_id FROM ev)
UNION ALL SELECT 'no cards', claim_id, NULL FROM ev WHERE card IS NULL
UNION ALL SELECT 'card missing', claim_id, card FROM ev
  WHERE card IS NOT NULL AND card NOT IN (SELECT card FROM known)
UNION ALL SELECT 'provenance missing', claim_id, query_hash FROM ev WHERE query_hash NOT IN (SELECT h FROM prov)
UNION ALL SELECT 'external source not archived', claim_id, url FROM ev WHERE archive_path IS NULL""")
def ledger_integrity(t):
    found = t.claims()
    known = t.raw("orders").where("o_orderstatus = 'F'").select(F.concat(
        F.lit("senate_filing_"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("card"))
    red = t.committee_assignments().where("committee_name = 'red committee'").select(
        F.col("bioguide_id").alias("source"))
    prov = t.raw("documents").join(red, "source", "left_semi").select(
        F.substring(F.sha2("source", 256), 1, 16).alias("sql_hash")).distinct()
    return audit.ledger_integrity(found, found.where("confidence <> 'high'"), known, prov)


@query("replay_check", """
WITH old AS (SELECT substr(sha256(source), 1, 16) AS sql_hash, count(*) AS n, sum(n_chars) AS d
             FROM documents WHERE lang <> 'fr' GROUP BY 1),
new AS (SELECT substr(sha256(source), 1, 16) AS sql_hash, count(*) AS n, sum(n_chars) AS d
        FROM documents WHERE lang <> 'de' GROUP BY 1),
cited AS (SELECT DISTINCT substr(sha256(source), 1, 16) AS sql_hash FROM documents
          UNION SELECT DISTINCT substr(sha256(url), 1, 16) FROM pages)
SELECT c.sql_hash, old.n AS recorded_rows, new.n AS replayed_rows,
  CASE WHEN old.n IS NULL THEN 'provenance missing' WHEN new.n IS NULL THEN 'not replayed'
       WHEN old.n <> new.n THEN 'row count differs' WHEN old.d <> new.d THEN 'values differ'
       ELSE 'match' END AS status
FROM cited c LEFT JOIN old USING (sql_hash) LEFT JOIN new USING (sql_hash)""", prelude=False)
def replay_check(t):
    docs = t.raw("documents")
    key = F.substring(F.sha2("source", 256), 1, 16).alias("sql_hash")

    def runs(df):
        return df.groupBy(key).agg(F.count("*").alias("row_count"),
                                   F.sum("n_chars").cast("string").alias("digest"))

    cited = docs.select(key).union(t.raw("pages").select(F.substring(F.sha2("url", 256), 1, 16)))
    return audit.replay_check(cited, runs(docs.where("lang <> 'fr'")), runs(docs.where("lang <> 'de'")))


@query("table_fingerprint", """
SELECT count(*) AS row_count, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31),
    coalesce(CAST(doc_id AS VARCHAR), chr(30)), coalesce(lang, chr(30)), coalesce(CAST(n_chars AS VARCHAR), chr(30)),
    coalesce(source, chr(30)), coalesce(text, chr(30)))), 1, 15) AS BIGINT)) AS VARCHAR) AS digest
FROM documents""", prelude=False)
def table_fingerprint(t):
    return audit.fingerprint(t.raw("documents"))
