"""Nested disclosure records to parent and child tables, as column plans.

Every function takes a frame with the raw record's columns plus ``source_file``
and returns one lazy frame per table. Children are unfolded from the arrays of
their own record, so nothing is shuffled and a child's position is its position
in the record. Columns that say where a record was read (``ORIGIN``) are passed
on to all tables if the raw frame has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.coerce import (child_id, first_non_empty, hash_id, leading_int, strip_null,
                                to_double, to_int, tri_bool)
from ..schema import TABLES

ORIGIN = ("source_path", "source_start", "source_row")


def _origin(df: DataFrame) -> list[str]:
    return [c for c in ORIGIN if c in df.columns]


def _typed(df: DataFrame, table: str, **columns: Column) -> DataFrame:
    """Columns of a table in order; a missing expression means the column of that name."""
    return df.select(*[
        columns.get(name, F.col(name) if name in df.columns else F.lit(None))
        .cast(kind).alias(name)
        for name, kind in TABLES[table].fields()], *_origin(df))


def drop_placeholders(df: DataFrame, columns) -> DataFrame:
    """Rows with at least one of the columns set."""
    return df.dropna(how="all", subset=list(columns))


def senate_filing(raw: DataFrame) -> dict[str, DataFrame]:
    raw = raw.where(F.nullif("filing_uuid", F.lit("")).isNotNull())
    reg, cli = (lambda f: F.col(f"registrant.{f}")), (lambda f: F.col(f"client.{f}"))
    filings = _typed(
        raw, "senate_filings",
        filing_year=to_int("filing_year"), income=to_double("income"),
        expenses=to_double("expenses"), expenses_method=F.col("expenses_method_display"),
        registrant_id=to_int(reg("id")), registrant_name=strip_null(reg("name")),
        registrant_state=reg("state"), registrant_country=reg("country"),
        registrant_ppb_country=reg("ppb_country"),
        registrant_house_id=to_int(reg("house_registrant_id")),
        registrant_description=reg("description"),
        client_id=to_int(first_non_empty(cli("client_id"), cli("id"), skip_zero=True)),
        client_name=strip_null(cli("name")), client_state=cli("state"),
        client_country=cli("country"), client_ppb_country=cli("ppb_country"),
        client_general_description=cli("general_description"),
        client_self_select=tri_bool(cli("client_self_select")))
    here = _origin(raw)
    acts = raw.select("filing_uuid", *here, F.posexplode("lobbying_activities").alias(
        "activity_index", "act")).withColumn(
        "activity_id", child_id("filing_uuid", "activity_index"))
    activities = _typed(acts, "senate_lobbying_activities", **{
        f: F.col(f"act.{f}")
        for f in ("general_issue_code", "general_issue_code_display", "description")})
    people = acts.select("activity_id", "filing_uuid", *here, F.explode("act.lobbyists").alias("p"))
    # the person is nested, or spread over the row itself
    nested = F.col("p.lobbyist").isNotNull()

    def person(field):
        return F.when(nested, F.col(f"p.lobbyist.{field}")).otherwise(F.col(f"p.{field}"))

    lobbyists = _typed(
        people, "senate_activity_lobbyists", lobbyist_id=to_int(person("id")),
        covered_position=strip_null(first_non_empty(
            "p.covered_position", "p.lobbyist.covered_position")),
        new_lobbyist=tri_bool("p.new"),
        **{f: strip_null(person(f)) for f in ("first_name", "last_name", "middle_name", "suffix")})
    bodies = acts.select("activity_id", "filing_uuid", *here,
                         F.explode("act.government_entities").alias("g"))
    entities = _typed(bodies, "senate_activity_govt_entities",
                      govt_entity_id=to_int("g.id"), govt_entity_name=strip_null("g.name"))
    abroad = raw.select("filing_uuid", *here, F.explode("foreign_entities").alias("fe"))
    foreign = _typed(
        abroad, "senate_foreign_entities", foreign_entity_name=strip_null("fe.name"),
        country=F.col("fe.country"), ppb_country=F.col("fe.ppb_country"),
        ownership_percentage=to_double("fe.ownership_percentage"),
        contribution=to_double("fe.contribution"), city=strip_null("fe.city"),
        state=strip_null("fe.state"))
    return {"senate_filings": filings, "senate_lobbying_activities": activities,
            "senate_activity_lobbyists": lobbyists, "senate_activity_govt_entities": entities,
            "senate_foreign_entities": foreign}


def senate_contribution(raw: DataFrame) -> dict[str, DataFrame]:
    raw = raw.where(F.nullif("filing_uuid", F.lit("")).isNotNull())
    reports = _typed(
        raw, "senate_contributions", filing_year=to_int("filing_year"),
        registrant_id=to_int("registrant.id"), registrant_name=strip_null("registrant.name"),
        lobbyist_id=to_int("lobbyist.id"),
        lobbyist_first_name=strip_null("lobbyist.first_name"),
        lobbyist_last_name=strip_null("lobbyist.last_name"),
        no_contributions=tri_bool("no_contributions"))
    here = _origin(raw)
    rows = raw.select("filing_uuid", *here,
                      F.posexplode("contribution_items").alias("item_index", "it"))
    items = _typed(
        rows, "senate_contribution_items", item_id=child_id("filing_uuid", "item_index", "ci"),
        contribution_type=first_non_empty("it.contribution_type", "it.type"),
        amount=to_double("it.amount"), contributor_name=strip_null("it.contributor_name"),
        payee_name=strip_null(first_non_empty("it.payee_name", "it.payee")),
        honoree_name=strip_null(first_non_empty("it.honoree_name", "it.honoree")),
        contribution_date=first_non_empty("it.contribution_date", "it.date"))
    # a committee is a plain name or an object that holds one
    pac = F.explode("pacs").alias("pac")
    name = strip_null(F.when(F.startswith("pac", F.lit("{")), F.get_json_object("pac", "$.name"))
                      .otherwise(F.col("pac")))
    pacs = drop_placeholders(_typed(
        raw.select("filing_uuid", *here, pac), "senate_contribution_pacs", pac_name=name), ["pac_name"])
    return {"senate_contributions": reports, "senate_contribution_items": items,
            "senate_contribution_pacs": pacs}


def house_filing(raw: DataFrame) -> dict[str, DataFrame]:
    """``raw`` also carries ``house_xml_filename`` and ``doc_type`` (from the root tag)."""
    renamed = {
        "organization_name": "organizationName", "client_name": "clientName",
        "senate_id": "senateID", "house_id": "houseID", "expenses_method": "expensesMethod",
        "signed_date": "signedDate", "printed_name": "printedName", "address_1": "address1",
        "address_2": "address2", "city": "city", "state": "state", "zip": "zip",
        "country": "country", "termination_date": "terminationDate",
        "no_lobbying": "noLobbying", "self_select": "selfSelect",
        "client_govt_entity": "clientGovtEntity"}
    filings = _typed(
        raw, "house_filings", report_year=to_int("reportYear"),
        report_type=F.coalesce(strip_null("reportType"), strip_null("RegistrationDate")),
        senate_id_registrant=leading_int(strip_null("senateID")), income=to_double("income"),
        expenses=to_double("expenses"),
        **{new: strip_null(old) for new, old in renamed.items()})
    key, here = "house_xml_filename", _origin(raw)
    nothing = F.lit(None).cast("string")

    def issue(code, text, agencies):
        return F.struct(code.alias("code"), text.alias("text"), agencies.alias("agencies"))

    described = F.transform("alis.ali_info", lambda a: issue(
        a["issueAreaCode"],
        F.array_join(F.filter(F.transform(a["specific_issues"]["description"], strip_null),
                              lambda d: d.isNotNull()), "\n"),
        a["federal_agencies"]))
    # registrations list their issues elsewhere; used only if there is nothing above
    listed = F.transform("alis_specific.ali_specific", lambda a: issue(
        a["issueAreaCode"], F.coalesce(strip_null(a["specific_issue"]),
                                       strip_null(a["description"])), nothing))
    issues = F.when(F.size(F.coalesce("alis.ali_info", F.array())) > 0, described).otherwise(listed)
    acts = raw.select(key, *here, F.posexplode(issues).alias("activity_index", "a"))
    activities = _typed(
        acts, "house_lobbying_activities", activity_id=child_id(key, "activity_index"),
        issue_area_code=strip_null("a.code"), specific_issues=F.nullif("a.text", F.lit("")),
        federal_agencies=strip_null("a.agencies"))
    people = raw.select(key, *here, F.posexplode("alis.ali_info").alias("pos", "a")).select(
        key, *here, child_id(key, "pos").alias("activity_id"),
        F.explode("a.lobbyists.lobbyist").alias("p"))
    lobbyists = _typed(people, "house_activity_lobbyists", **{
        new: strip_null(f"p.{old}") for new, old in {
            "first_name": "lobbyistFirstName", "middle_name": "lobbyistMiddleName",
            "last_name": "lobbyistLastName", "suffix": "lobbyistSuffix",
            "covered_position": "coveredPosition", "lobbyist_new": "lobbyistNew"}.items()})
    abroad = raw.select(key, *here, F.explode("foreignEntities.foreignEntity").alias("fe"))
    foreign = drop_placeholders(_typed(
        abroad, "house_foreign_entities", foreign_entity_name=strip_null("fe.name"),
        country=strip_null("fe.country"), contribution=to_double("fe.contribution"),
        ownership_percentage=to_double("fe.ownershipPercentage"),
        address=strip_null("fe.address")), ["foreign_entity_name", "country"])
    return {"house_filings": filings, "house_lobbying_activities": activities,
            "house_activity_lobbyists": lobbyists, "house_foreign_entities": foreign}


def press_release(raw: DataFrame) -> dict[str, DataFrame]:
    raw = raw.where(F.nullif("url", F.lit("")).isNotNull())
    text = F.coalesce("text", F.lit(""))
    releases = _typed(
        raw, "press_releases", press_id=hash_id("url"), source_index_page=F.col("source"),
        bioguide_id=F.col("member.bioguide_id"), text=text, text_length=F.length(text),
        **{f"member_{f}": F.col(f"member.{f}") for f in ("name", "party", "state", "chamber")})
    members = _typed(
        raw.where(F.nullif("member.bioguide_id", F.lit("")).isNotNull()), "members",
        **{f: F.col(f"member.{f}") for f in ("bioguide_id", "name", "party", "state", "chamber")})
    return {"press_releases": releases, "members": members}


def issue_code(raw: DataFrame) -> dict[str, DataFrame]:
    return {"issue_codes": _typed(raw, "issue_codes", code=F.col("value"))}


def government_entity(raw: DataFrame) -> dict[str, DataFrame]:
    return {"government_entities_lookup": _typed(
        raw, "government_entities_lookup", entity_id=first_non_empty("id", "value"))}
