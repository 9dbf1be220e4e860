"""Loading: records are written as JSON or XML text by Spark and read back by the load plans."""

import pyarrow as pa
from pyspark.sql import functions as F

from recordloom import schema
from recordloom.functions import coerce
from recordloom.operators import flatten
from recordloom.operators.shape import keep_first
from recordloom.session import cut_lineage, shared_dir
from recordloom.sources import external, keyed, readers, sinks, vintages
from recordloom.sources.files import open_path

from .registry import query, rounded


# --- coercions ------------------------------------------------------------------

@query("coerce_matrix", r"""
WITH v AS (
  SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '$' || format('{:,.2f}', o_totalprice)
      WHEN 1 THEN '  ' || CAST(o_orderkey AS VARCHAR) || chr(10) WHEN 2 THEN '' WHEN 3 THEN ' '
      WHEN 4 THEN o_orderpriority ELSE '1.0' END AS raw FROM orders)
SELECT o_orderkey, nullif(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '') AS stripped,
  TRY_CAST(nullif(regexp_replace(regexp_replace(raw, '[$,]', '', 'g'), '^\s+|\s+$', '', 'g'), '') AS DOUBLE) AS as_double,
  CASE WHEN regexp_matches(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '^[+-]?\d+$')
       THEN CAST(trim(raw, ' ' || chr(10)) AS INTEGER) END AS as_int,
  TRY_CAST(nullif(regexp_extract(raw, '^(\d+)', 1), '') AS INTEGER) AS leading,
  CAST(o_orderkey AS VARCHAR) || '::a' || CAST(o_orderkey % 6 AS VARCHAR) AS child,
  substr(sha1(raw), 1, 16) AS hashed FROM v""", prelude=False)
def coerce_matrix(t):
    key = F.col("o_orderkey")
    raw = (
        F.when(key % 6 == 0, F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
        .when(key % 6 == 1, F.concat(F.lit("  "), key.cast("string"), F.lit("\n")))
        .when(key % 6 == 2, F.lit("")).when(key % 6 == 3, F.lit(" "))
        .when(key % 6 == 4, F.col("o_orderpriority")).otherwise(F.lit("1.0")))
    return t.raw("orders").withColumn("raw", raw).select(
        "o_orderkey", coerce.strip_null("raw").alias("stripped"),
        coerce.to_double("raw").alias("as_double"), coerce.to_int("raw").alias("as_int"),
        coerce.leading_int("raw").alias("leading"),
        coerce.child_id("o_orderkey", key % 6).alias("child"),
        coerce.hash_id("raw").alias("hashed"))


@query("child_ids", """
SELECT CAST(filing_uuid AS VARCHAR) || '::a' || activity_index AS activity_id, filing_uuid,
       activity_index, description FROM activities""")
def child_ids(t):
    return t.indexed_activities().select(
        coerce.child_id("filing_uuid", "activity_index").alias("activity_id"), "filing_uuid",
        "activity_index", "description")


@query("dedup_keep_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""", prelude=False)
def dedup_keep_first(t):
    return keep_first(
        t.raw("lineitem"), ["l_orderkey", "l_linenumber"],
        [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice")]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("append_new_keys", """
WITH stored AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'),
batch AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
            ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderkey FROM batch
WHERE rn = 1 AND o_custkey NOT IN (SELECT o_custkey FROM stored)""", prelude=False)
def append_new_keys(t):
    orders = t.raw("orders")
    stored = orders.where("o_orderstatus = 'F'")
    return sinks.only_new(orders, stored, "o_custkey",
                          [F.col("o_orderdate"), F.col("o_orderkey")]).select(
        "o_custkey", "o_orderkey")


# --- flattening of nested records -------------------------------------------------

def _parsed(df, text, record_schema):
    return df.select(F.from_json(text, record_schema).alias("r"), F.lit("derived").alias(
        "source_file")).select("r.*", "source_file")


def senate_records(t):
    """One JSON record per order, with two activities, people nested and flat."""
    orders = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    person = F.struct(
        F.struct(F.col("o_custkey").alias("id"), F.concat(F.lit(" "), "c_name").alias("last_name"))
        .alias("lobbyist"), F.lit("").alias("covered_position"), (key % 2 == 0).alias("new"),
        F.lit(None).cast("string").alias("last_name"))
    flat = F.struct(
        F.lit(None).cast("struct<id:bigint,last_name:string>").alias("lobbyist"),
        F.col("c_mktsegment").alias("covered_position"), F.lit(None).cast("boolean").alias("new"),
        F.col("o_orderpriority").alias("last_name"))
    first = F.struct(
        F.col("o_orderpriority").alias("general_issue_code"),
        F.col("o_orderstatus").alias("description"), F.array(person, flat).alias("lobbyists"),
        F.array(F.struct((key % 7).alias("id"), F.lit(" SENATE ").alias("name")))
        .alias("government_entities"))
    second = F.struct(
        F.col("c_mktsegment").alias("general_issue_code"),
        F.lit(None).cast("string").alias("description"),
        F.array_compact(F.array(F.when(key % 3 == 0, flat))).alias("lobbyists"),
        F.array().cast("array<struct<id:bigint,name:string>>").alias("government_entities"))
    abroad = F.when(F.col("o_orderstatus") == "F", F.array(F.struct(
        F.concat(F.lit(" "), "c_name").alias("name"), F.col("c_mktsegment").alias("country"),
        F.lit("12.5").alias("ownership_percentage"))))
    record = F.struct(
        F.when(F.col("c_mktsegment") != "BUILDING", key.cast("string")).otherwise("")
        .alias("filing_uuid"),
        F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("filing_type"),
        F.year("o_orderdate").alias("filing_year"),
        F.when(key % 5 != 0, F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
        .otherwise("n/a").alias("income"),
        F.struct(F.col("o_custkey").cast("string").alias("id"),
                 F.concat(F.lit("  "), "c_name", F.lit("\t")).alias("name")).alias("registrant"),
        F.struct(F.when(key % 4 == 0, F.lit(0)).otherwise(key).alias("client_id"),
                 F.lit(77).alias("id"), F.col("o_orderpriority").alias("name"),
                 F.when(key % 3 != 0, key % 2 == 0).alias("client_self_select")).alias("client"),
        F.array(first, second).alias("lobbying_activities"), abroad.alias("foreign_entities"))
    return _parsed(orders.select(F.to_json(record).alias("j")), "j", schema.SENATE_FILING)


SENATE_SQL = """
WITH r AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS uuid FROM orders
           JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING')
"""


@query("flatten_senate_filings", SENATE_SQL + """
SELECT uuid AS filing_uuid, 'Q' || quarter(o_orderdate) AS filing_type,
  CAST(year(o_orderdate) AS INTEGER) AS filing_year,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS income,
  CAST(o_custkey AS INTEGER) AS registrant_id, c_name AS registrant_name,
  CAST(CASE WHEN o_orderkey % 4 = 0 OR o_orderkey = 0 THEN 77 ELSE o_orderkey END AS INTEGER) AS client_id,
  o_orderpriority AS client_name,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 2 = 0 END AS client_self_select FROM r""", prelude=False)
def flatten_senate_filings(t):
    return flatten.senate_filing(senate_records(t))["senate_filings"].select(
        "filing_uuid", "filing_type", "filing_year", "income", "registrant_id", "registrant_name",
        "client_id", "client_name", "client_self_select")


@query("flatten_senate_activities", SENATE_SQL + """
SELECT uuid || '::a0' AS activity_id, uuid AS filing_uuid, 0 AS activity_index,
       o_orderpriority AS general_issue_code, o_orderstatus AS description FROM r
UNION ALL SELECT uuid || '::a1', uuid, 1, c_mktsegment, NULL FROM r""", prelude=False)
def flatten_senate_activities(t):
    return flatten.senate_filing(senate_records(t))["senate_lobbying_activities"].drop(
        "general_issue_code_display")


@query("flatten_senate_lobbyists", SENATE_SQL + """
SELECT uuid || '::a0' AS activity_id, CAST(o_custkey AS INTEGER) AS lobbyist_id, c_name AS last_name,
       NULL AS covered_position, o_orderkey % 2 = 0 AS new_lobbyist FROM r
UNION ALL SELECT uuid || '::a0', NULL, o_orderpriority, c_mktsegment, NULL FROM r
UNION ALL SELECT uuid || '::a1', NULL, o_orderpriority, c_mktsegment, NULL FROM r
WHERE o_orderkey % 3 = 0""", prelude=False)
def flatten_senate_lobbyists(t):
    return flatten.senate_filing(senate_records(t))["senate_activity_lobbyists"].select(
        "activity_id", "lobbyist_id", "last_name", "covered_position", "new_lobbyist")


@query("flatten_senate_govt_entities", SENATE_SQL + """
SELECT uuid || '::a0' AS activity_id, uuid AS filing_uuid,
       CAST(o_orderkey % 7 AS INTEGER) AS govt_entity_id, 'SENATE' AS govt_entity_name FROM r""", prelude=False)
def flatten_senate_govt_entities(t):
    return flatten.senate_filing(senate_records(t))["senate_activity_govt_entities"]


@query("flatten_senate_foreign", SENATE_SQL + """
SELECT uuid AS filing_uuid, c_name AS foreign_entity_name, c_mktsegment AS country,
       12.5::DOUBLE AS ownership_percentage FROM r WHERE o_orderstatus = 'F'""", prelude=False)
def flatten_senate_foreign(t):
    return flatten.senate_filing(senate_records(t))["senate_foreign_entities"].select(
        "filing_uuid", "foreign_entity_name", "country", "ownership_percentage")


def contribution_records(t):
    events = t.raw("events")
    key = F.col("event_id")
    item = F.struct(
        F.when(key % 2 == 0, F.col("event_type")).alias("contribution_type"),
        F.lit("feca").alias("type"), F.col("value").alias("amount"),
        F.when(key % 3 == 0, "").otherwise(F.col("event_type")).alias("payee_name"),
        F.lit("fallback").alias("payee"), F.col("user_id").cast("string").alias("honoree"))
    pacs = F.array(F.concat(F.lit(" PAC "), F.col("user_id").cast("string")),
                   F.when(key % 2 == 0, F.to_json(F.struct(F.col("event_type").alias("name"))))
                   .otherwise(""))
    record = F.struct(key.cast("string").alias("filing_uuid"), (key % 2 == 0).alias("no_contributions"),
                      F.array(item, item).alias("contribution_items"), pacs.alias("pacs"))
    return _parsed(events.select(F.to_json(record).alias("j")), "j", schema.SENATE_CONTRIBUTION)


@query("flatten_contribution_items", """
WITH p AS (SELECT 0 AS i UNION ALL SELECT 1)
SELECT event_id || '::ci' || i AS item_id, CAST(event_id AS VARCHAR) AS filing_uuid, i AS item_index,
  CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'feca' END AS contribution_type, value AS amount,
  CASE WHEN event_id % 3 = 0 THEN 'fallback' ELSE event_type END AS payee_name,
  CAST(user_id AS VARCHAR) AS honoree_name FROM events, p""", prelude=False)
def flatten_contribution_items(t):
    return flatten.senate_contribution(contribution_records(t))["senate_contribution_items"].select(
        "item_id", "filing_uuid", "item_index", "contribution_type", "amount", "payee_name",
        "honoree_name")


@query("flatten_contribution_pacs", """
SELECT CAST(event_id AS VARCHAR) AS filing_uuid, 'PAC ' || user_id AS pac_name FROM events
UNION ALL SELECT CAST(event_id AS VARCHAR), event_type FROM events WHERE event_id % 2 = 0""", prelude=False)
def flatten_contribution_pacs(t):
    return flatten.senate_contribution(contribution_records(t))["senate_contribution_pacs"]


def house_records(t):
    """One XML document per part; some registrations list issues only in the second place."""
    def tag(name, value):
        return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))

    key = F.col("p_partkey")
    ali = tag("ali_info", F.concat(
        tag("issueAreaCode", F.col("p_type")),
        tag("specific_issues", F.concat(tag("description", F.col("p_name")),
                                        F.lit("<description> </description>"),
                                        tag("description", F.col("p_brand")))),
        tag("lobbyists", tag("lobbyist", tag("lobbyistLastName", F.col("p_brand"))))))
    listed = tag("ali_specific", F.concat(tag("issueAreaCode", F.col("p_type")),
                                          tag("specific_issue", F.col("p_name"))))
    xml = tag("LOBBYINGDISCLOSURE2", F.concat(
        tag("senateID", F.concat_ws("-", key.cast("string"), F.col("p_size").cast("string"))),
        tag("organizationName", F.concat(F.lit(" "), "p_name", F.lit(" "))),
        tag("income", F.concat(F.lit("$"), F.format_number("p_retailprice", 2))),
        F.when(key % 4 != 0, tag("alis", F.concat(ali, ali))).otherwise(""),
        tag("alis_specific", F.concat(listed, listed)),
        F.lit("<foreignEntities><foreignEntity><city>x</city></foreignEntity>"),
        tag("foreignEntity", tag("name", F.col("p_brand"))), F.lit("</foreignEntities>")))
    # the table is small next to the work of parsing it, a row group or two: dealt to all cores and parsed once,
    # as filters on the record would be evaluated before the rows are dealt
    rows = t.raw("part")
    rows = rows.repartition(max(rows.rdd.getNumPartitions(), 4 * t.spark.sparkContext.defaultParallelism))
    return cut_lineage(
        rows.select(
            F.from_xml(xml, schema.HOUSE_FILING, {"rowTag": "LOBBYINGDISCLOSURE2"}).alias("r"),
            F.concat(key.cast("string"), F.lit(".xml")).alias("house_xml_filename"))
        .select("r.*", "house_xml_filename", F.lit("LD2").alias("doc_type"),
                F.lit("derived").alias("source_file"))
    )


@query("flatten_house_filings", """
SELECT p_partkey || '.xml' AS house_xml_filename, p_partkey || '-' || p_size AS senate_id,
       CAST(p_partkey AS INTEGER) AS senate_id_registrant, p_name AS organization_name,
       round(p_retailprice, 2) AS income, 'LD2' AS doc_type FROM part""", prelude=False)
def flatten_house_filings(t):
    return rounded(flatten.house_filing(house_records(t))["house_filings"].select(
        "house_xml_filename", "senate_id", "senate_id_registrant", "organization_name", "income",
        "doc_type"))


@query("flatten_house_activities", """
WITH p AS (SELECT 0 AS i UNION ALL SELECT 1)
SELECT p_partkey || '.xml::a' || i AS activity_id, i AS activity_index, p_type AS issue_area_code,
       CASE WHEN p_partkey % 4 <> 0 THEN p_name || chr(10) || p_brand ELSE p_name END AS specific_issues
FROM part, p""", prelude=False)
def flatten_house_activities(t):
    return flatten.house_filing(house_records(t))["house_lobbying_activities"].select(
        "activity_id", "activity_index", "issue_area_code", "specific_issues")


@query("flatten_house_lobbyists", """
WITH p AS (SELECT 0 AS i UNION ALL SELECT 1)
SELECT p_partkey || '.xml::a' || i AS activity_id, p_brand AS last_name FROM part, p
WHERE p_partkey % 4 <> 0""", prelude=False)
def flatten_house_lobbyists(t):
    return flatten.house_filing(house_records(t))["house_activity_lobbyists"].select(
        "activity_id", "last_name")


@query("flatten_house_foreign", """
SELECT p_partkey || '.xml' AS house_xml_filename, p_brand AS foreign_entity_name FROM part""", prelude=False)
def flatten_house_foreign(t):
    return flatten.house_filing(house_records(t))["house_foreign_entities"].select(
        "house_xml_filename", "foreign_entity_name")


def press_records(t):
    record = F.struct(
        F.when(F.col("lang") != "fr", F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")))
        .alias("url"), F.col("text"),
        F.struct(F.col("source").alias("bioguide_id"), F.col("lang").alias("state")).alias("member"))
    return _parsed(t.raw("documents").select(F.to_json(record).alias("j")), "j", schema.PRESS_RELEASE)


@query("flatten_press", """
SELECT substr(sha1('http://x/' || doc_id), 1, 16) AS press_id, source AS bioguide_id,
       lang AS member_state, text, CAST(length(text) AS INTEGER) AS text_length
FROM documents WHERE lang <> 'fr'""", prelude=False)
def flatten_press(t):
    return flatten.press_release(press_records(t))["press_releases"].select(
        "press_id", "bioguide_id", "member_state", "text", "text_length")


@query("press_members", """
SELECT source AS bioguide_id, min(lang) AS state FROM documents WHERE lang <> 'fr' GROUP BY 1""",
       prelude=False)
def press_members(t):
    members = flatten.press_release(press_records(t))["members"]
    return keep_first(members, "bioguide_id", [F.col("state")]).select("bioguide_id", "state")


@query("flatten_lookup", """
SELECT coalesce(nullif(CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END, ''), p_brand)
         AS entity_id, p_name AS name FROM part""", prelude=False)
def flatten_lookup(t):
    raw = t.raw("part").select(
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_brand").alias("value"), F.col("p_name").alias("name"))
    return flatten.government_entity(raw)["government_entities_lookup"]


# --- external registries ------------------------------------------------------------

@query("legislators", """
SELECT 'B' || s_suppkey AS bioguide_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name
         ELSE 'Ann ' || s_name END AS name, 'sen' AS chamber, CAST(s_nationkey AS VARCHAR) AS state
FROM supplier WHERE s_nationkey <> 0""", prelude=False)
def legislators(t):
    key = F.col("s_suppkey")
    term = [F.struct(F.lit(kind).alias("type"), F.col("s_nationkey").alias("state"))
            for kind in ("rep", "sen")]
    record = F.struct(
        F.struct(F.when(F.col("s_nationkey") != 0, F.concat(F.lit("B"), key.cast("string"))).alias("bioguide"))
        .alias("id"),
        F.struct(F.lit("Ann").alias("first"), F.col("s_name").alias("last"),
                 F.when(key % 2 == 0, F.col("s_name")).alias("official_full")).alias("name"),
        F.array(*term).alias("terms"))
    text = t.raw("supplier").select(F.to_json(record).alias("j"))
    return external.flatten_legislators(
        text.select(F.from_json("j", schema.LEGISLATOR).alias("r")).select("r.*")).select(
        "bioguide_id", "name", "chamber", "state")


def _committees(t):
    record = F.struct(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("thomas_id"),
        F.col("n_name").alias("name"), F.lit("house").alias("type"),
        F.array(F.struct(F.lit("01").alias("thomas_id"), F.lit("sub").alias("name")))
        .alias("subcommittees"))
    text = t.raw("nation").select(F.to_json(record).alias("j"))
    return external.flatten_committees(
        text.select(F.from_json("j", schema.COMMITTEE).alias("r")).select("r.*"))


@query("committees", """
SELECT 'N' || n_nationkey AS committee_code, n_name AS name, 'house' AS chamber,
       CAST(NULL AS VARCHAR) AS parent_committee_code FROM nation
UNION ALL SELECT 'N' || n_nationkey || '01', 'sub', 'house', 'N' || n_nationkey FROM nation""",
       prelude=False)
def committees(t):
    return _committees(t)


@query("committee_seats", """
SELECT 'B' || s_suppkey AS bioguide_id, 'N' || s_nationkey AS committee_code, n_name AS committee_name,
       CASE WHEN s_suppkey % 2 = 0 THEN 'Chair' ELSE 'majority' END AS role
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey <> 0""", prelude=False)
def committee_seats(t):
    key = F.col("s_suppkey")
    member = F.struct(
        F.when(F.col("s_nationkey") != 0, F.concat(F.lit("B"), key.cast("string"))).alias("bioguide"),
        F.when(key % 2 == 0, "Chair").alias("title"), F.lit("majority").alias("party"))
    text = t.raw("supplier").select(F.to_json(F.create_map(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")), F.array(member))).alias("j"))
    return external.flatten_membership(text, "j", _committees(t))


def _award_texts(t):
    v = F.struct(
        F.lit(2).alias("n_awards_top_25_by_amount"), (F.col("o_totalprice") * 2).alias("sum_amount_top_25"),
        F.array(*[F.struct(F.concat(F.lit(p), F.col("o_orderkey").cast("string")).alias("Award ID"),
                           F.col("o_totalprice").alias("Award Amount")) for p in ("X", "Y")])
        .alias("top_5_awards"))
    return t.raw("orders").select(F.to_json(F.create_map(
        F.concat(F.lit("R"), F.col("o_orderkey").cast("string")), v)).alias("j"))


@query("awards_summary", """
SELECT 'R' || o_orderkey AS recipient, CAST(2 AS BIGINT) AS n_awards,
       round(o_totalprice * 2, 2) AS sum_amount FROM orders""", prelude=False)
def awards_summary(t):
    return rounded(external.flatten_awards(_award_texts(t), "j")[0])


@query("awards_single", """
SELECT 'R' || o_orderkey AS recipient, p || o_orderkey AS award_id, o_totalprice AS amount
FROM orders, (SELECT 'X' AS p UNION ALL SELECT 'Y')""", prelude=False)
def awards_single(t):
    return external.flatten_awards(_award_texts(t), "j")[1].select("recipient", "award_id", "amount")


@query("claims_from_json", """
SELECT 'C-' || doc_id AS claim_id, text AS statement, lang AS category, source AS first_hash
FROM documents""", prelude=False)
def claims_from_json(t):
    claim = F.struct(F.col("text").alias("statement"), F.col("lang").alias("category"),
                     F.array("source").alias("supporting_query_hashes"))
    text = t.raw("documents").select(F.to_json(F.struct(F.create_map(
        F.concat(F.lit("C-"), F.col("doc_id").cast("string")), claim).alias("claims"))).alias("j"))
    return readers.explode_claims(text, "j").select(
        "claim_id", "statement", "category",
        F.col("supporting_query_hashes")[0].alias("first_hash"))


# --- files ------------------------------------------------------------------------------

def _fresh(t, name):
    import uuid
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("jsonl_round_trip", """
SELECT 'http://x/' || doc_id AS url, text, source AS bioguide_id FROM documents""", prelude=False)
def jsonl_round_trip(t):
    path = _fresh(t, "jsonl")
    t.raw("documents").select(
        F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("url"), "text",
        F.struct(F.col("source").alias("bioguide_id")).alias("member")).write.json(path)
    return readers.read_jsonl(t.spark, path, schema.PRESS_RELEASE).select(
        "url", "text", F.col("member.bioguide_id").alias("bioguide_id"))


def _write_lists(df, folder):
    """One JSON list in one line per partition, in the shared folder."""
    def run(batches):
        from pyspark import TaskContext

        system, place = open_path(f"{folder}/list-{TaskContext.get().partitionId()}.json")
        system.create_dir(place.rsplit("/", 1)[0])
        with system.open_output_stream(place) as out:
            first = True
            for batch in batches:
                for row in batch.column(0).to_pylist():
                    out.write(("[" if first else ",").encode() + row.encode())
                    first = False
            out.write(b"[]" if first else b"]")
        yield pa.RecordBatch.from_arrays([pa.array([place])], ["file"])

    df.mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()


def _write_files(df, folder):
    """Each row's ``content`` as a file ``name`` of the shared folder."""
    def run(batches):
        system, place = open_path(folder)
        system.create_dir(place)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                with system.open_output_stream(f"{place}/{name}") as out:
                    out.write(content.encode())
            yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])

    df.select("name", "content").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


@query("json_lists_by_range", """
SELECT 'http://x/' || doc_id AS url, text, '[' || source || '"\\' AS bioguide_id FROM documents""", prelude=False)
def json_lists_by_range(t):
    # lists in one line, read in ranges of a quarter of a megabyte
    folder = _fresh(t, "lists")
    _write_lists(t.raw("documents").select(F.to_json(F.struct(
        F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("url"), "text",
        F.struct(F.concat(F.lit("["), F.col("source"), F.lit('"\\')).alias("bioguide_id")).alias("member")))), folder)
    return readers.read_json_array(t.spark, f"{folder}/*.json", schema.PRESS_RELEASE, size=1 << 18).select(
        "url", "text", F.col("member.bioguide_id").alias("bioguide_id"))


@query("xml_dir_records", """
SELECT 's' || s_suppkey || '.xml' AS house_xml_filename, CASE WHEN s_suppkey % 2 = 0 THEN 'LD1' ELSE 'LD2' END AS doc_type,
  s_name AS organization, CAST(s_nationkey AS VARCHAR) || '-' || s_suppkey AS senate_id, false AS broken
FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL SELECT 's' || s_suppkey || '.xml', NULL, NULL, NULL, true FROM supplier WHERE s_suppkey % 7 = 0""", prelude=False)
def xml_dir_records(t):
    # one file per supplier, of two roots; every seventh breaks off
    folder, key = _fresh(t, "xml-dir"), F.col("s_suppkey")
    root = F.when(key % 2 == 0, F.lit("LOBBYINGDISCLOSURE1")).otherwise(F.lit("LOBBYINGDISCLOSURE2"))
    whole = F.concat(
        F.lit('<?xml version="1.0"?>\n<!-- <LOBBYINGDISCLOSURE3> -->\n<'), root, F.lit("><organizationName>"), "s_name",
        F.lit("</organizationName><senateID>"), F.col("s_nationkey").cast("string"), F.lit("-"), key.cast("string"),
        F.lit("</senateID></"), root, F.lit(">"))
    _write_files(t.raw("supplier").withColumn("w", whole).select(
        F.concat(F.lit("s"), key.cast("string"), F.lit(".xml")).alias("name"),
        F.when(key % 7 == 0, F.expr("left(w, length(w) - 10)")).otherwise(F.col("w")).alias("content")), folder)
    good, broken = readers.read_xml_dir(t.spark, [folder], schema.HOUSE_FILING)
    none = F.lit(None).cast("string")
    return good.select("house_xml_filename", "doc_type", F.col("organizationName").alias("organization"),
                       F.col("senateID").alias("senate_id"), F.lit(False).alias("broken")).unionByName(
        broken.select(F.col("source_file").alias("house_xml_filename"), none.alias("doc_type"), none.alias("organization"),
                      none.alias("senate_id"), F.lit(True).alias("broken")))


@query("glob_years", """
SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1993, 1995) GROUP BY ALL""", prelude=False)
def glob_years(t):
    # a folder per year; only the named years are read
    folder = _fresh(t, "years")
    t.raw("orders").select(F.col("o_orderkey").cast("string").alias("value"), F.year("o_orderdate").alias("y")).write.partitionBy(
        "y").json(folder)
    paths = readers.expand_globs(t.spark, folder, "y={year}/*.json", (1993, 1995))
    return readers.read_jsonl(t.spark, paths, schema.LOOKUP, strict=True).groupBy(
        F.regexp_extract("source_path", r"y=(\d+)/", 1).cast("bigint").alias("year")).agg(F.count("*").alias("n"))


@query("xml_round_trip", """
SELECT CAST(s_suppkey AS VARCHAR) AS registration_number, s_name AS registrant_name,
       CAST(s_nationkey AS VARCHAR) AS city FROM supplier""", prelude=False)
def xml_round_trip(t):
    path = _fresh(t, "xml")
    t.raw("supplier").select(
        F.col("s_suppkey").alias("REGISTRATION_NUMBER"),
        F.concat(F.lit(" "), "s_name").alias("NAME"), F.col("s_nationkey").alias("CITY")).write.format(
        "xml").option("rowTag", "ROW").option("rootTag", "ROWSET").save(path)
    return external.read_fara_registrants(t.spark, path).select(
        "registration_number", "registrant_name", "city")


@query("incremental_files", """
SELECT count(DISTINCT url) AS n_urls, count(*) AS n_rows FROM (
  SELECT 'http://x/' || doc_id AS url FROM documents)""", prelude=False)
def incremental_files(t):
    # two arrivals that overlap: keys are taken once
    from recordloom.streaming import incremental

    source, warehouse = _fresh(t, "arrivals"), _fresh(t, "warehouse")
    docs = t.raw("documents").select(
        F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("url"), "text", "lang")
    for arrival in (docs.where(F.col("lang") != "fr"), docs):
        arrival.drop("lang").write.mode("append").json(source)
        stream = incremental.stream_jsonl(t.spark, source, schema.PRESS_RELEASE)
        incremental.ingest_available(stream, flatten.press_release, schema.TABLES, warehouse,
                                     "press", f"{warehouse}/_offsets")
    return t.spark.read.parquet(f"{warehouse}/press_releases").agg(
        F.count_distinct("url").alias("n_urls"), F.count("*").alias("n_rows"))


@query("manifest", """
SELECT 'table' AS kind, 'orders' AS name, CAST(NULL AS BIGINT) AS n_files, count(*) AS n_rows FROM orders
UNION ALL SELECT 'source', source, count(DISTINCT text), CAST(sum(n) AS BIGINT) FROM (
  SELECT source, text, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY source""", prelude=False)
def manifest(t):
    ledger = t.raw("documents").groupBy(
        F.col("source").alias("source_id"), F.col("text").alias("file_path")).agg(
        F.count("*").alias("row_count")).withColumn(
        "file_sha256", F.sha2("file_path", 256)).withColumn("ingested_at", F.current_timestamp())
    return sinks.manifest({"orders": t.raw("orders")}, ledger).drop("digest")


@query("files_to_do", """
WITH seen AS (SELECT DISTINCT source, text FROM documents WHERE lang <> 'en')
SELECT source || '/' || doc_id AS file_path FROM documents WHERE lang = 'en'""", prelude=False)
def files_to_do(t):
    files = t.raw("documents").select(
        F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string")).alias("file_path"),
        F.sha2("text", 256).alias("file_sha256"), "lang")
    ledger = files.select(
        F.lit("s").alias("source_id"), "file_path",
        F.when(F.col("lang") == "en", "old").otherwise(F.col("file_sha256")).alias("file_sha256"),
        F.current_timestamp().alias("ingested_at"))
    return sinks.files_to_do(files.drop("lang"), ledger, "s").select("file_path")


# --- tables by key, external pulls ------------------------------------------------------

@query("keyed_append", """
SELECT CAST(count(DISTINCT o_orderkey) AS BIGINT) AS n_keys, CAST(count(*) AS BIGINT) AS n_rows, sum(o_custkey)::BIGINT AS custkeys
FROM orders""", prelude=False)
def keyed_append(t):
    # a third of the orders, then all of them, then a few known ones
    path, orders = _fresh(t, "keyed"), t.raw("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    for batch in (orders.where("o_custkey % 3 = 0"), orders, orders.where("o_orderkey % 100 = 1")):
        keyed.append(batch, path, "o_orderkey", [F.col("o_custkey")], zone="year")
    return keyed.open_keyed(t.spark, path).agg(
        F.count_distinct("o_orderkey").alias("n_keys"), F.count("*").alias("n_rows"), F.sum("o_custkey").alias("custkeys"))


@query("keyed_parent_child", """
SELECT o_orderkey, o_custkey, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS price
FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders) JOIN (
  SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_extendedprice FROM lineitem
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) ON l_orderkey = o_orderkey
GROUP BY ALL""", prelude=False)
def keyed_parent_child(t):
    # both sides are stored by the order; the join and the sums need no shuffle
    parents, children = _fresh(t, "parents"), _fresh(t, "children")
    keyed.append(t.raw("orders").select("o_orderkey", "o_custkey"), parents, "o_orderkey", [F.col("o_custkey")])
    line = t.raw("lineitem").withColumn("id", F.concat_ws("::a", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    keyed.append(line.select("id", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"), children, "id",
                 [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")], bucket_by="l_orderkey")
    o, c = keyed.open_keyed(t.spark, parents), keyed.open_keyed(t.spark, children)
    return rounded(o.join(c, o["o_orderkey"] == c["l_orderkey"]).groupBy("o_orderkey", "o_custkey").agg(
        F.count("*").alias("n_lines"), F.sum("l_extendedprice").alias("price")))


def _three_pulls(t):
    """Customers as pulled on three days: some leave and come back, some change."""
    warehouse, key = _fresh(t, "pulls"), F.col("c_custkey")
    rows = t.raw("customer").select("c_custkey", "c_name", "c_mktsegment")
    changed = rows.withColumn("c_mktsegment", F.when(key % 3 == 0, F.lit("NEW")).otherwise(F.col("c_mktsegment")))
    for day, pull in (("2024-01-01", rows.where(key % 5 != 0)), ("2024-02-01", changed.where(key % 7 != 0)),
                      ("2024-03-01", rows.where(key % 5 != 0))):
        vintages.store(pull, "customers", warehouse, url="http://customers", as_of=day)
    return vintages.pulls(t.spark, "customers", warehouse)


PULLS = """
WITH p AS (SELECT 1 AS d, c_custkey, c_name, c_mktsegment AS seg FROM customer WHERE c_custkey % 5 <> 0
  UNION ALL SELECT 2, c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END FROM customer WHERE c_custkey % 7 <> 0
  UNION ALL SELECT 3, c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0)
"""


@query("asof_intervals", PULLS + """, g AS (
  SELECT *, d - row_number() OVER (PARTITION BY c_custkey, c_name, seg ORDER BY d) AS run FROM p)
SELECT c_custkey, c_name, seg AS c_mktsegment, CAST(make_date(2024, min(d)::INTEGER, 1) AS VARCHAR) AS valid_from,
  CASE WHEN max(d) < 3 THEN CAST(make_date(2024, max(d)::INTEGER + 1, 1) AS VARCHAR) END AS valid_to
FROM g GROUP BY c_custkey, c_name, seg, run""", prelude=False)
def asof_intervals(t):
    history = vintages.intervals(_three_pulls(t), ["c_custkey"])
    return history.withColumns({c: F.col(c).cast("string") for c in ("valid_from", "valid_to")})


@query("asof_known_on", PULLS + "SELECT c_custkey, c_name, seg AS c_mktsegment FROM p WHERE d = 2", prelude=False)
def asof_known_on(t):
    return vintages.known_on(_three_pulls(t), "2024-02-20")


@query("asof_difference", PULLS + """
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed'
    ELSE 'changed' END AS change, CASE WHEN a.c_custkey IS NULL OR b.c_custkey IS NULL THEN 2 ELSE 1 END::BIGINT AS n_columns
FROM (SELECT * FROM p WHERE d = 1) a FULL JOIN (SELECT * FROM p WHERE d = 2) b ON a.c_custkey = b.c_custkey
WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.seg <> b.seg""", prelude=False)
def asof_difference(t):
    return vintages.difference(_three_pulls(t), ["c_custkey"], "2024-01-01", "2024-02-01")
