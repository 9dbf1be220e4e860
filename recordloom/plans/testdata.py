"""Disclosure-shaped tables derived from the star-schema test tables.

The same mapping is written as SQL in ``PRELUDE`` for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.shape import keep_first, row_index

ACTIVITY_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

_SCHEMAS: dict = {}


class TestTables:
    """Lazy views over one folder of test tables; nothing is read until it is used."""

    __test__ = False

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def raw(self, name: str) -> DataFrame:
        """A table; its schema is looked up once per folder."""
        file = f"{self.path}/{name}.parquet"
        if file not in _SCHEMAS:
            _SCHEMAS[file] = self.spark.read.parquet(file).schema
        return self.spark.read.schema(_SCHEMAS[file]).parquet(file)

    def filings(self) -> DataFrame:
        quarter = F.quarter("o_orderdate")
        words = F.array(*[F.lit(f"{w}_quarter") for w in ("first", "second", "third", "fourth")])
        return (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("o_orderkey").alias("filing_uuid"),
                F.when(F.col("o_orderkey") % 10 == 0, F.concat(quarter.cast("string"), F.lit("A")))
                .otherwise(F.concat(F.lit("Q"), quarter.cast("string"))).alias("filing_type"),
                F.year("o_orderdate").alias("filing_year"),
                F.element_at(words, quarter).alias("filing_period"),
                F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("income"),
                F.col("o_custkey").alias("registrant_id"),
                F.col("c_name").alias("registrant_name"),
                F.substring("o_orderpriority", 1, 1).cast("int").alias("client_id"),
                F.col("o_orderpriority").alias("client_name"),
                F.col("n_name").alias("client_country"),
                F.lit(None).cast("string").alias("client_ppb_country"),
                F.col("c_mktsegment").alias("client_general_description"),
                F.when(F.col("o_orderkey") % 5 != 0,
                       F.concat_ws("/", "c_mktsegment", "o_orderstatus", "o_orderpriority"))
                .alias("posted_by_name"),
                F.concat(F.lit("filing/"), F.col("o_orderkey").cast("string")).alias("url"),
                F.col("o_orderdate").alias("dt_posted"),
            )
        )

    def _lines(self) -> DataFrame:
        return self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))

    @staticmethod
    def _activity_columns():
        return [
            F.col("l_orderkey").alias("filing_uuid"),
            F.concat_ws("-", *[F.col(c).cast("string") for c in (
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
            .alias("activity_id"),
            F.col("p_type").alias("general_issue_code"),
            F.concat_ws(" ", "p_name", "p_brand").alias("description"),
        ]

    def activities(self) -> DataFrame:
        """Activities without their position."""
        return self._lines().select(*self._activity_columns())

    def indexed_activities(self) -> DataFrame:
        """Activities with their 0-based position in the filing."""
        lines = row_index(self.raw("lineitem"), "l_orderkey", ACTIVITY_ORDER, "activity_index")
        return (
            lines.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(*self._activity_columns(), "activity_index", "l_suppkey")
        )

    def lobbyists(self) -> DataFrame:
        """One person per activity; carries the activity's topic, i.e. the activity-level link."""
        return (
            self._lines()
            .join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                *self._activity_columns(),
                F.col("l_suppkey").alias("lobbyist_id"),
                F.lit("Agent").alias("first_name"),
                F.col("s_name").alias("last_name"),
                F.when(F.col("l_suppkey") % 3 != 0, F.concat_ws(" ", "p_name", "p_brand"))
                .alias("covered_position"),
            )
        )

    def foreign_entities(self) -> DataFrame:
        first = keep_first(
            self.raw("lineitem"), "l_orderkey",
            [F.col(c) for c in ACTIVITY_ORDER])
        return (
            first.where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"))
            .join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("l_orderkey").alias("filing_uuid"),
                F.col("s_name").alias("foreign_entity_name"),
                F.col("n_name").alias("country"),
                F.lit(None).cast("string").alias("ppb_country"),
            )
        )

    def contribution_items(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("filing_uuid"),
            F.col("event_type").alias("payee_name"),
            (F.col("user_id") % 20).cast("string").alias("honoree_name"),
            F.col("user_id").cast("string").alias("contributor_name"),
            F.col("value").alias("amount"),
        )

    def press_releases(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").cast("string").alias("press_id"),
            F.col("source").alias("bioguide_id"),
            F.col("source").alias("member_name"),
            "text",
        )

    def committee_assignments(self) -> DataFrame:
        return self.raw("supplier").select(
            F.concat(F.lit("src"), (F.col("s_suppkey") % 20).cast("string")).alias("bioguide_id"),
            F.when(F.col("s_suppkey") % 2 == 0, "red committee").otherwise("blue committee")
            .alias("committee_name"),
            (F.col("s_nationkey") % 3).cast("string").alias("role"),
        )

    def members(self) -> DataFrame:
        return self.committee_assignments().select(
            "bioguide_id", F.concat(F.lit("Member "), "bioguide_id").alias("name"),
            F.lit("X").alias("party"), F.lit("ZZ").alias("state")).distinct()

    def govt_entities(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("l_orderkey").alias("filing_uuid"),
                    F.col("n_name").alias("govt_entity_name"))
        )

    def claims(self) -> DataFrame:
        quality, toxic = F.col("quality"), F.col("toxic")
        return (
            self.raw("documents").join(self.raw("labels"), "doc_id", "left")
            .select(
                F.concat(F.lit("C-"), F.col("doc_id").cast("string")).alias("claim_id"),
                F.col("text").alias("statement"),
                F.when(quality == 1, "high").when(quality == 0, "medium").otherwise("low")
                .alias("confidence"),
                F.when(toxic == 0, "verified").when(toxic == 1, "disputed").otherwise("pending")
                .alias("fact_check_status"),
                F.array(F.substring(F.sha2("source", 256), 1, 16)).alias("supporting_query_hashes"),
                F.when(F.col("lang") == "en", F.array(F.concat(
                    F.lit("senate_filing_"), F.col("doc_id").cast("string"), F.lit(".md"))))
                .otherwise(F.array().cast("array<string>")).alias("supporting_cards"),
                F.array(F.struct(
                    F.concat(F.lit("https://example.org/"), "source").alias("url"),
                    F.when(F.col("lang") != "fr", F.concat(F.lit("archive/"), "source"))
                    .alias("archive_path"))).alias("external_sources"),
            )
        )

    def registry_a(self) -> DataFrame:
        return (
            self.raw("part")
            .select(
                F.col("p_partkey").cast("int").alias("registrant_id"),
                F.concat(F.concat_ws(" ", "p_name", "p_brand", "p_type"), F.lit(", LLC"))
                .alias("registrant_name"),
                F.lit(None).cast("int").alias("registrant_house_id"),
                F.lit("ZZ").alias("registrant_state"),
            )
        )

    def registry_b(self) -> DataFrame:
        reordered = F.concat_ws(" ", "p_brand", "p_name", "p_type")
        plain = F.concat_ws(" ", "p_name", "p_brand", "p_type")
        misspelt = F.concat_ws(" ", F.concat("p_name", F.lit("xq")), "p_brand", "p_type")
        return (
            self.raw("part")
            .select(
                F.when(F.col("p_partkey") % 4 == 0,
                       F.concat_ws("-", F.col("p_partkey").cast("string"),
                                   F.col("p_size").cast("string"))).alias("senate_id"),
                F.concat(F.upper(F.when(F.col("p_partkey") % 8 == 6, reordered)
                                 .when(F.col("p_partkey") % 8 == 5, misspelt)
                                 .otherwise(plain)),
                         F.lit(" INC.")).alias("organization_name"),
                F.lit("ZZ").alias("state"),
            )
        )


PRELUDE = """
filings AS (
  SELECT o_orderkey AS filing_uuid,
         CASE WHEN o_orderkey % 10 = 0 THEN CAST(quarter(o_orderdate) AS VARCHAR) || 'A'
              ELSE 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) END AS filing_type,
         CAST(year(o_orderdate) AS INTEGER) AS filing_year,
         CASE quarter(o_orderdate) WHEN 1 THEN 'first_quarter' WHEN 2 THEN 'second_quarter'
              WHEN 3 THEN 'third_quarter' ELSE 'fourth_quarter' END AS filing_period,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS income,
         o_custkey AS registrant_id, c_name AS registrant_name,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS client_id,
         o_orderpriority AS client_name, n_name AS client_country,
         CAST(NULL AS VARCHAR) AS client_ppb_country,
         c_mktsegment AS client_general_description,
         CASE WHEN o_orderkey % 5 <> 0
              THEN c_mktsegment || '/' || o_orderstatus || '/' || o_orderpriority END
           AS posted_by_name,
         'filing/' || CAST(o_orderkey AS VARCHAR) AS url,
         o_orderdate AS dt_posted
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
activities AS (
  SELECT l_orderkey AS filing_uuid,
         CAST(row_number() OVER (PARTITION BY l_orderkey
              ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER)
           AS activity_index,
         p_type AS general_issue_code, p_name || ' ' || p_brand AS description,
         l_suppkey, l_returnflag, l_linestatus
  FROM lineitem JOIN part ON l_partkey = p_partkey),
lobbyists AS (
  SELECT filing_uuid, activity_index, general_issue_code, description, l_suppkey AS lobbyist_id,
         'Agent' AS first_name, s_name AS last_name,
         CASE WHEN l_suppkey % 3 <> 0 THEN description END AS covered_position
  FROM activities JOIN supplier ON l_suppkey = s_suppkey),
foreign_entities AS (
  SELECT filing_uuid, s_name AS foreign_entity_name, n_name AS country,
         CAST(NULL AS VARCHAR) AS ppb_country
  FROM activities JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND activity_index = 0),
contribution_items AS (
  SELECT event_id AS filing_uuid, event_type AS payee_name,
         CAST(user_id % 20 AS VARCHAR) AS honoree_name, CAST(user_id AS VARCHAR) AS contributor_name,
         value AS amount FROM events),
press_releases AS (
  SELECT CAST(doc_id AS VARCHAR) AS press_id, source AS bioguide_id, source AS member_name, text
  FROM documents),
committee_assignments AS (
  SELECT 'src' || CAST(s_suppkey % 20 AS VARCHAR) AS bioguide_id,
         CASE WHEN s_suppkey % 2 = 0 THEN 'red committee' ELSE 'blue committee' END
           AS committee_name,
         CAST(s_nationkey % 3 AS VARCHAR) AS role FROM supplier),
members AS (
  SELECT DISTINCT bioguide_id, 'Member ' || bioguide_id AS name, 'X' AS party, 'ZZ' AS state
  FROM committee_assignments),
govt_entities AS (
  SELECT l_orderkey AS filing_uuid, n_name AS govt_entity_name
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
claims AS (
  SELECT 'C-' || CAST(d.doc_id AS VARCHAR) AS claim_id, text AS statement,
         CASE WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'medium' ELSE 'low' END
           AS confidence,
         CASE WHEN toxic = 0 THEN 'verified' WHEN toxic = 1 THEN 'disputed' ELSE 'pending' END
           AS fact_check_status,
         substr(sha256(source), 1, 16) AS query_hash,
         CASE WHEN lang = 'en' THEN 'senate_filing_' || CAST(d.doc_id AS VARCHAR) || '.md' END
           AS card,
         'https://example.org/' || source AS url,
         CASE WHEN lang <> 'fr' THEN 'archive/' || source END AS archive_path
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
registry_a AS (
  SELECT CAST(p_partkey AS INTEGER) AS registrant_id,
         p_name || ' ' || p_brand || ' ' || p_type || ', LLC' AS registrant_name,
         CAST(NULL AS INTEGER) AS registrant_house_id, 'ZZ' AS registrant_state
  FROM part),
registry_b AS (
  SELECT CASE WHEN p_partkey % 4 = 0
              THEN CAST(p_partkey AS VARCHAR) || '-' || CAST(p_size AS VARCHAR) END AS senate_id,
         upper(CASE WHEN p_partkey % 8 = 6 THEN p_brand || ' ' || p_name || ' ' || p_type
                    WHEN p_partkey % 8 = 5 THEN p_name || 'xq ' || p_brand || ' ' || p_type
                    ELSE p_name || ' ' || p_brand || ' ' || p_type END) || ' INC.'
           AS organization_name,
         'ZZ' AS state
  FROM part)
"""


def with_prelude(sql: str) -> str:
    """A check query on top of the derived tables. ``sql`` may start with more CTEs, after a comma."""
    sql = sql.strip()
    return f"WITH {PRELUDE.strip()}{sql if sql.startswith(',') else chr(10) + sql}"
