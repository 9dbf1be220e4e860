"""Readers for external registries: foreign agents, legislators, committees, awards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import (AWARDS, COMMITTEE, FARA_PRINCIPAL, FARA_REGISTRANT, LEGISLATOR, MEMBERSHIP)
from .readers import CORRUPT, read_xml, trimmed

# Target columns and the elements they come from.
REGISTRANT_COLUMNS = {
    "registration_number": "REGISTRATION_NUMBER", "registrant_name": "NAME",
    "address_1": "ADDRESS_1", "address_2": "ADDRESS_2", "city": "CITY", "state": "STATE",
    "zip": "ZIP", "registration_date": "REGISTRATION_DATE",
    "termination_date": "TERMINATION_DATE", "registration_type": "TYPE"}
PRINCIPAL_COLUMNS = {
    "registration_number": "REGISTRATION_NUMBER", "registrant_name": "REGISTRANT_NAME",
    "foreign_principal_name": "FOREIGN_PRINCIPAL", "foreign_principal_address": "ADDRESS_1",
    "foreign_principal_city": "CITY", "foreign_principal_state": "STATE",
    "foreign_principal_country": "COUNTRY_LOCATION_REPRESENTED",
    "fp_registration_date": "FP_REGISTRATION_DATE",
    "registrant_registration_date": "REGISTRATION_DATE"}


def _rows(spark, path, schema):
    df = read_xml(spark, path, "ROW", schema)
    return df.where(F.col(CORRUPT).isNull())


def read_fara_registrants(spark: SparkSession, path: str) -> DataFrame:
    return trimmed(_rows(spark, path, FARA_REGISTRANT), REGISTRANT_COLUMNS)


def read_fara_principals(spark: SparkSession, path: str) -> DataFrame:
    return trimmed(_rows(spark, path, FARA_PRINCIPAL), PRINCIPAL_COLUMNS)


def flatten_legislators(raw: DataFrame) -> DataFrame:
    """Members by their latest term; those without an id are dropped."""
    spelled = F.trim(F.concat_ws(" ", "name.first", "name.last"))
    named = F.coalesce(F.nullif("name.official_full", F.lit("")), spelled)
    term = F.when(F.size("terms") > 0, F.element_at("terms", -1))
    return (
        raw.where(F.nullif("id.bioguide", F.lit("")).isNotNull())
        .select(F.col("id.bioguide").alias("bioguide_id"), named.alias("name"), term.alias("t"))
        .select("bioguide_id", "name", F.col("t.type").alias("chamber"), "t.state", "t.district",
                "t.party", "t.url")
    )


def flatten_committees(raw: DataFrame) -> DataFrame:
    """Committees, and their subcommittees with the parent's code in front."""
    top = raw.select(F.col("thomas_id").alias("committee_code"), "name",
                     F.col("type").alias("chamber"),
                     F.lit(None).cast("string").alias("parent_committee_code"))
    sub = raw.select("thomas_id", "type", F.explode("subcommittees").alias("s")).select(
        F.concat("thomas_id", F.coalesce("s.thomas_id", F.lit(""))).alias("committee_code"),
        "s.name", F.col("type").alias("chamber"),
        F.col("thomas_id").alias("parent_committee_code"))
    return top.unionByName(sub)


def flatten_membership(raw: DataFrame, text: str, committees: DataFrame) -> DataFrame:
    """One row per member and committee of a JSON map from committee code to members."""
    seats = (
        raw.select(F.explode(F.from_json(text, MEMBERSHIP)).alias("committee_code", "members"))
        .select("committee_code", F.explode("members").alias("m"))
        .where(F.nullif("m.bioguide", F.lit("")).isNotNull()))
    names = committees.groupBy("committee_code").agg(F.min("name").alias("_name"))
    return seats.join(names, "committee_code", "left").select(
        F.col("m.bioguide").alias("bioguide_id"), "committee_code",
        F.coalesce(F.nullif("_name", F.lit("")), "committee_code").alias("committee_name"),
        F.coalesce(F.nullif("m.title", F.lit("")), F.nullif("m.party", F.lit(""))).alias("role"))


def flatten_awards(raw: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """A JSON map from recipient to award totals: (summary, single awards)."""
    rows = raw.select(F.explode(F.from_json(text, AWARDS)).alias("recipient", "v"))
    summary = rows.select(
        "recipient", F.col("v.n_awards_top_25_by_amount").alias("n_awards"),
        F.col("v.sum_amount_top_25").alias("sum_amount"))
    awards = rows.select("recipient", F.explode("v.top_5_awards").alias("a")).select(
        "recipient", F.col("a.`Award ID`").alias("award_id"),
        F.col("a.`Recipient Name`").alias("recipient_name"),
        F.col("a.`Award Amount`").alias("amount"),
        F.col("a.`Awarding Agency`").alias("agency"),
        F.col("a.Description").alias("description"), F.col("a.`Action Date`").alias("action_date"))
    return summary, awards


def read_legislators(spark: SparkSession, path: str) -> DataFrame:
    return flatten_legislators(spark.read.schema(LEGISLATOR).option("multiLine", True).json(path))


def read_committees(spark: SparkSession, path: str) -> DataFrame:
    return flatten_committees(spark.read.schema(COMMITTEE).option("multiLine", True).json(path))


def read_membership(spark: SparkSession, path: str, committees: DataFrame) -> DataFrame:
    return flatten_membership(spark.read.text(path, wholetext=True), "value", committees)


def read_awards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return flatten_awards(spark.read.text(path, wholetext=True), "value")
