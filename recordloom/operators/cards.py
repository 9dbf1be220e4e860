"""Evidence cards: one page per record, assembled for a whole set of ids at once.

A card is first a table of lines ``(id, section, position, line)``. Every parent
and child row gives its own lines, so this table is made without grouping and is
as parallel as its inputs. Only the last step joins the lines of the chosen ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values: page layouts and public addresses --------------------------

SENATE_URL = "https://lda.senate.gov/filings/public/filing/{id}/print/"
HOUSE_URL = "https://disclosurespreview.house.gov/"
SENATE_PAGE = (
    "# Evidence card :: Senate LDA filing `{filing_uuid}`",
    "",
    "- **Source kind:** senate_filing",
    "- **Filing UUID:** `{filing_uuid}`",
    "- **Public document:** {public_url}",
    "- **API record:** {url}",
    "- **Filing type / period:** {filing_type_display} ({filing_year} {filing_period})",
    "- **Posted:** {dt_posted}",
    "",
    "## Registrant",
    "- {registrant_name} (id {registrant_id})",
    "- State: {registrant_state}; country: {registrant_country}; "
    "PPB country: {registrant_ppb_country}",
    "- House registrant id (bridge): {registrant_house_id}",
    "",
    "## Client",
    "- {client_name} (id {client_id})",
    "- State: {client_state}; country: {client_country}; PPB country: {client_ppb_country}",
    "- Description: {client_general_description}",
    "",
    "## Financials",
    "- Income reported: {income}",
    "- Expenses reported: {expenses} ({expenses_method|no method})",
    "",
    "## Lobbying activities",
)
SENATE_ACTIVITY = ("- **{general_issue_code}** ({general_issue_code_display}) — "
                   "{description|_no description_}")
LOBBYISTS = "## Lobbyists"
LOBBYIST = "- {first_name} {last_name}"
COVERED_POSITION = "  \n    _covered position:_ {covered_position}"
FOREIGN_ENTITIES = "## Foreign entities"
SENATE_FOREIGN = ("- {foreign_entity_name} — country: {country}, ppb: {ppb_country}, "
                  "ownership: {ownership_percentage}, contribution: {contribution}")
GOVERNMENT_ENTITIES = "## Government entities lobbied"
GOVERNMENT_ENTITY = "- {govt_entity_name}"
HOUSE_PAGE = (
    "# Evidence card :: House LDA filing `{house_xml_filename}`",
    "",
    "- **Source kind:** house_filing",
    "- **Filename:** `{house_xml_filename}`",
    "- **Doc type:** {doc_type} ({report_year} {report_type})",
    "- **Senate ID (bridge):** {senate_id} "
    "(parses to Senate registrant id: {senate_id_registrant})",
    "- **House ID:** {house_id}",
    "- **Public lookup:** {public_url}",
    "- **Signed:** {signed_date} by {printed_name}",
    "",
    "## Registrant",
    "- {organization_name}",
    "- Address: {address_1}, {city}, {state} {zip} {country}",
    "",
    "## Client",
    "- {client_name} (client_govt_entity={client_govt_entity}, self_select={self_select})",
    "",
    "## Financials",
    "- Income: {income}",
    "- Expenses: {expenses} ({expenses_method})",
    "- No lobbying flag: {no_lobbying}",
    "",
    "## Activities (ALIs)",
)
HOUSE_ACTIVITY = "- **{issue_area_code}**"
HOUSE_ISSUES = "\n  - Specific issues: {specific_issues}"
HOUSE_AGENCIES = "\n  - Federal agencies: {federal_agencies}"
HOUSE_FOREIGN = ("- {foreign_entity_name} — country: {country}, "
                 "ownership: {ownership_percentage}, contribution: {contribution}")
PRESS_PAGE = (
    "# Evidence card :: press release `{press_id}`",
    "",
    "- **Source kind:** press_release",
    "- **Member:** {member_name} ({member_party}-{member_state}, {member_chamber}, "
    "bioguide `{bioguide_id}`)",
    "- **Title:** {title}",
    "- **Date:** {date} ({date_source})",
    "- **URL:** {url}",
    "- **Collected at:** {collected_at}",
    "",
    "## Body",
    "",
    "```",
    "{body}",
    "```",
)
PRESS_CUT = "\n\n_(truncated; full text {text_length} chars)_"
PRESS_LENGTH = 5000


def amount_text(amount: Column) -> Column:
    """A number in plain digits without trailing zeros, but with one decimal at least."""
    plain = F.regexp_replace(F.format_string("%.6f", amount), r"(\.\d)(\d*?)0+$", "$1$2")
    return F.when(amount.isNotNull(), plain)


def template(text: str, columns, **values: Column) -> Column:
    """A line with ``{column}`` or ``{column|text if empty}`` filled in; null shows as None.

    Amounts show the decimals they have, one at least. A column the table does not have counts as null.
    """
    kinds = dict(columns)
    parts = []
    for literal, name in re.findall(r"([^{]*)(?:\{([^}]+)\})?", text):
        if literal:
            parts.append(F.lit(literal))
        if not name:
            continue
        name, _, fallback = name.partition("|")
        if name in values:
            c = values[name]
        elif name not in kinds:
            c = F.lit(None).cast("string")
        elif kinds[name] == "double":
            c = amount_text(F.col(name))
        else:
            c = F.col(name).cast("string")
        if fallback:
            c = F.nullif(c, F.lit(""))
        parts.append(F.coalesce(c, F.lit(fallback or "None")))
    return F.concat(*parts) if parts else F.lit("")


def _lines(df: DataFrame, key: str, section: int, line: Column, position=None) -> DataFrame:
    return df.select(
        F.col(key).cast("string").alias("id"), F.lit(section).alias("section"),
        (F.lit(0) if position is None else F.col(position)).cast("int").alias("position"),
        line.alias("line"))


def _heading(children: DataFrame, key: str, section: int, text: str) -> DataFrame:
    """A section title for every id that has rows in the section."""
    # the rows already lie by their id as text, so neither this nor a later grouping by id moves them
    found = children.select(F.col(key).cast("string").alias("id")).distinct()
    return _lines(found, "id", section, F.lit("\n" + text)).withColumn("position", F.lit(-1))


def _section(children: DataFrame, key: str, section: int, heading: str, line: Column) -> DataFrame:
    return _heading(children, key, section, heading).unionByName(
        _lines(children, key, section, line))


def _chosen(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of the chosen ids, each table dealt once and alike by its id as text. The ids may be all there are,
    so they are merged and not broadcast."""
    wanted = ids.select(F.col("id").cast("string").alias("_id")).hint("merge")
    return df.join(wanted, F.col(key).cast("string") == F.col("_id"), "left_semi")


def _page(lines, df: DataFrame, **values) -> Column:
    return F.concat_ws("\n", *[template(t, df.dtypes, **values) for t in lines])


def _person(df: DataFrame) -> Column:
    position = F.nullif("covered_position", F.lit(""))
    return F.concat(template(LOBBYIST, df.dtypes), F.coalesce(
        F.when(position.isNotNull(), template(COVERED_POSITION, df.dtypes)), F.lit("")))


def senate_lines(ids: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    key = "filing_uuid"
    part = {name: _chosen(tables[name], key, ids) for name in (
        "senate_filings", "senate_lobbying_activities", "senate_activity_lobbyists",
        "senate_foreign_entities", "senate_activity_govt_entities")}
    filings, acts = part["senate_filings"], part["senate_lobbying_activities"]
    people, abroad = part["senate_activity_lobbyists"], part["senate_foreign_entities"]
    before, after = SENATE_URL.split("{id}")
    url = F.concat(F.lit(before), F.col(key).cast("string"), F.lit(after))
    bodies = part["senate_activity_govt_entities"].where(
        F.nullif("govt_entity_name", F.lit("")).isNotNull()).select(
        F.col(key).cast("string").alias(key), "govt_entity_name").distinct()
    return (
        _lines(filings, key, 0, _page(SENATE_PAGE, filings, public_url=url))
        .unionByName(_lines(acts, key, 1, template(SENATE_ACTIVITY, acts.dtypes),
                            "activity_index"))
        .unionByName(_section(people, key, 2, LOBBYISTS, _person(people)))
        .unionByName(_section(abroad, key, 3, FOREIGN_ENTITIES,
                              template(SENATE_FOREIGN, abroad.dtypes)))
        .unionByName(_section(bodies, key, 4, GOVERNMENT_ENTITIES,
                              template(GOVERNMENT_ENTITY, bodies.dtypes)))
    )


def house_lines(ids: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    key = "house_xml_filename"
    filings = _chosen(tables["house_filings"], key, ids)
    acts = _chosen(tables["house_lobbying_activities"], key, ids)
    people = _chosen(tables["house_activity_lobbyists"], key, ids)
    abroad = _chosen(tables["house_foreign_entities"], key, ids)
    issues = F.regexp_replace("specific_issues", "\n", "  \n    ")

    def optional(column, text, **values):
        filled = F.nullif(column, F.lit("")).isNotNull()
        return F.coalesce(F.when(filled, template(text, acts.dtypes, **values)), F.lit(""))

    activity = F.concat(template(HOUSE_ACTIVITY, acts.dtypes),
                        optional("specific_issues", HOUSE_ISSUES, specific_issues=issues),
                        optional("federal_agencies", HOUSE_AGENCIES))
    return (
        _lines(filings, key, 0, _page(HOUSE_PAGE, filings, public_url=F.lit(HOUSE_URL)))
        .unionByName(_lines(acts, key, 1, activity, "activity_index"))
        .unionByName(_section(people, key, 2, LOBBYISTS, _person(people)))
        .unionByName(_section(abroad, key, 3, FOREIGN_ENTITIES,
                              template(HOUSE_FOREIGN, abroad.dtypes)))
    )


def press_lines(ids: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    df = _chosen(tables["press_releases"], "press_id", ids)
    page = _page(PRESS_PAGE, df, body=F.substring(F.coalesce("text", F.lit("")), 1, PRESS_LENGTH))
    note = F.when(F.length("text") > PRESS_LENGTH,
                  template(PRESS_CUT, df.dtypes, text_length=F.length("text").cast("string")))
    return _lines(df, "press_id", 0, F.concat(page, F.coalesce(note, F.lit(""))))


_KINDS: dict[str, Callable[[DataFrame, Mapping[str, DataFrame]], DataFrame]] = {
    "senate_filing": senate_lines,
    "house_filing": house_lines,
    "press_release": press_lines,
}


def register_card(kind: str, lines: Callable[[DataFrame, Mapping[str, DataFrame]], DataFrame]):
    """Add a kind of card: a function from ids and tables to card lines."""
    _KINDS[kind] = lines


def card_lines(kind: str, ids: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    return _KINDS[kind](ids, tables)


def cards(kind: str, ids: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(source, id, card_md)`` for all ids in one job; lines in a fixed order."""
    lines = card_lines(kind, ids, tables)
    return (
        lines.groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("section", "position", "line"))).alias("l"))
        .select(F.lit(kind).alias("source"), "id",
                F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"))
                .alias("card_md"))
    )


def missing_ids(ids: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Asked-for ids without a record."""
    known = records.select(F.col(key).cast("string").alias("id"))
    return ids.select(F.col("id").cast("string").alias("id")).distinct().join(
        known, "id", "left_anti")
