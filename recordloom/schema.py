"""Column lists of the disclosure tables and the shapes of the raw records."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Table:
    """Schema (as DDL), primary key (if any) and storage layout of one table."""

    schema: str
    key: str | None = None
    partition_by: tuple[str, ...] = ()
    bucket_by: str | None = None

    def fields(self) -> list[tuple[str, str]]:
        """Column names and types."""
        return [tuple(f.split(" ", 1)) for f in self.schema.split(", ")]


# --- fixed values: column names and types of the normalised tables ------------

TABLES = {
    "senate_filings": Table((
        "filing_uuid string, filing_type string, filing_type_display string, filing_year int, "
        "filing_period string, filing_document_url string, url string, income double, "
        "expenses double, expenses_method string, dt_posted string, termination_date string, "
        "registrant_id int, registrant_name string, registrant_state string, "
        "registrant_country string, registrant_ppb_country string, registrant_house_id int, "
        "registrant_description string, client_id int, client_name string, client_state string, "
        "client_country string, client_ppb_country string, client_general_description string, "
        "client_self_select boolean, posted_by_name string, source_file string"),
        "filing_uuid", ("filing_year",), "filing_uuid"),
    "senate_lobbying_activities": Table((
        "activity_id string, filing_uuid string, activity_index int, general_issue_code string, "
        "general_issue_code_display string, description string"),
        "activity_id", (), "filing_uuid"),
    "senate_activity_lobbyists": Table((
        "activity_id string, filing_uuid string, lobbyist_id int, first_name string, "
        "last_name string, middle_name string, suffix string, covered_position string, "
        "new_lobbyist boolean"), None, (), "filing_uuid"),
    "senate_activity_govt_entities": Table((
        "activity_id string, filing_uuid string, govt_entity_id int, govt_entity_name string"),
        None, (), "filing_uuid"),
    "senate_foreign_entities": Table((
        "filing_uuid string, foreign_entity_name string, country string, ppb_country string, "
        "ownership_percentage double, contribution double, city string, state string"),
        None, (), "filing_uuid"),
    "senate_contributions": Table((
        "filing_uuid string, filing_type string, filing_period string, filing_year int, "
        "filer_type string, dt_posted string, registrant_id int, registrant_name string, "
        "lobbyist_id int, lobbyist_first_name string, lobbyist_last_name string, "
        "no_contributions boolean, url string, source_file string"),
        "filing_uuid", ("filing_year",), "filing_uuid"),
    "senate_contribution_items": Table((
        "item_id string, filing_uuid string, item_index int, contribution_type string, "
        "amount double, contributor_name string, payee_name string, honoree_name string, "
        "contribution_date string"), "item_id", (), "filing_uuid"),
    "senate_contribution_pacs": Table(("filing_uuid string, pac_name string")),
    "house_filings": Table((
        "house_xml_filename string, doc_type string, report_year int, report_type string, "
        "organization_name string, client_name string, senate_id string, "
        "senate_id_registrant int, house_id string, income double, expenses double, "
        "expenses_method string, signed_date string, printed_name string, address_1 string, "
        "address_2 string, city string, state string, zip string, country string, "
        "termination_date string, no_lobbying string, self_select string, "
        "client_govt_entity string, source_file string"),
        "house_xml_filename", ("report_year",), "house_xml_filename"),
    "house_lobbying_activities": Table((
        "activity_id string, house_xml_filename string, activity_index int, "
        "issue_area_code string, specific_issues string, federal_agencies string"),
        "activity_id", (), "house_xml_filename"),
    "house_activity_lobbyists": Table((
        "activity_id string, house_xml_filename string, first_name string, middle_name string, "
        "last_name string, suffix string, covered_position string, lobbyist_new string"),
        None, (), "house_xml_filename"),
    "house_foreign_entities": Table((
        "house_xml_filename string, foreign_entity_name string, country string, "
        "contribution double, ownership_percentage double, address string")),
    "press_releases": Table((
        "press_id string, url string, title string, date string, date_source string, "
        "source_index_page string, domain string, scraper string, bioguide_id string, "
        "member_name string, member_party string, member_state string, member_chamber string, "
        "text string, text_length int, collected_at string, updated_at string, "
        "source_file string"), "press_id"),
    "members": Table((
        "bioguide_id string, name string, party string, state string, chamber string"),
        "bioguide_id"),
    "issue_codes": Table(("code string, name string"), "code"),
    "government_entities_lookup": Table(("entity_id string, name string"), "entity_id"),
}

_PLACE = "state:string,country:string,ppb_country:string"
_PERSON = "id:string,first_name:string,last_name:string,middle_name:string,suffix:string"

# --- fixed values: raw record shapes; numbers and flags are read as text ------

SENATE_FILING = (
    "filing_uuid string, filing_type string, filing_type_display string, filing_year string, "
    "filing_period string, filing_document_url string, url string, income string, "
    "expenses string, expenses_method_display string, dt_posted string, "
    "termination_date string, posted_by_name string, "
    f"registrant struct<id:string,name:string,{_PLACE},house_registrant_id:string,"
    "description:string>, "
    f"client struct<client_id:string,id:string,name:string,{_PLACE},"
    "general_description:string,client_self_select:string>, "
    "lobbying_activities array<struct<general_issue_code:string,"
    "general_issue_code_display:string,description:string,"
    f"lobbyists:array<struct<lobbyist:struct<{_PERSON},covered_position:string>,{_PERSON},"
    "covered_position:string,new:string>>,"
    "government_entities:array<struct<id:string,name:string>>>>, "
    "foreign_entities array<struct<name:string,country:string,ppb_country:string,"
    "ownership_percentage:string,contribution:string,city:string,state:string>>")
SENATE_CONTRIBUTION = (
    "filing_uuid string, filing_type string, filing_period string, filing_year string, "
    "filer_type string, dt_posted string, registrant struct<id:string,name:string>, "
    "lobbyist struct<id:string,first_name:string,last_name:string>, no_contributions string, "
    "url string, contribution_items array<struct<contribution_type:string,type:string,"
    "amount:string,contributor_name:string,payee_name:string,payee:string,honoree_name:string,"
    "honoree:string,contribution_date:string,date:string>>, pacs array<string>")
HOUSE_FILING = (
    "senateID string, houseID string, reportYear string, reportType string, "
    "RegistrationDate string, organizationName string, clientName string, income string, "
    "expenses string, expensesMethod string, signedDate string, printedName string, "
    "address1 string, address2 string, city string, state string, zip string, country string, "
    "terminationDate string, noLobbying string, selfSelect string, clientGovtEntity string, "
    "alis struct<ali_info:array<struct<issueAreaCode:string,"
    "specific_issues:struct<description:array<string>>,federal_agencies:string,"
    "lobbyists:struct<lobbyist:array<struct<lobbyistFirstName:string,lobbyistMiddleName:string,"
    "lobbyistLastName:string,lobbyistSuffix:string,coveredPosition:string,"
    "lobbyistNew:string>>>>>>, "
    "alis_specific struct<ali_specific:array<struct<issueAreaCode:string,"
    "specific_issue:string,description:string>>>, "
    "foreignEntities struct<foreignEntity:array<struct<name:string,country:string,"
    "contribution:string,ownershipPercentage:string,address:string>>>")
HOUSE_ROOTS = {"LD1": "LOBBYINGDISCLOSURE1", "LD2": "LOBBYINGDISCLOSURE2"}
PRESS_RELEASE = (
    "url string, title string, date string, date_source string, source string, domain string, "
    "scraper string, text string, collected_at string, updated_at string, "
    "member struct<bioguide_id:string,name:string,party:string,state:string,chamber:string>")
LOOKUP = ("id string, value string, name string")
FARA_REGISTRANT = (
    "REGISTRATION_NUMBER string, NAME string, ADDRESS_1 string, ADDRESS_2 string, CITY string, "
    "STATE string, ZIP string, REGISTRATION_DATE string, TERMINATION_DATE string, TYPE string")
FARA_PRINCIPAL = (
    "REGISTRATION_NUMBER string, REGISTRANT_NAME string, FOREIGN_PRINCIPAL string, "
    "ADDRESS_1 string, CITY string, STATE string, COUNTRY_LOCATION_REPRESENTED string, "
    "FP_REGISTRATION_DATE string, REGISTRATION_DATE string")
LEGISLATOR = (
    "id struct<bioguide:string>, name struct<first:string,last:string,official_full:string>, "
    "terms array<struct<type:string,state:string,district:string,party:string,url:string>>")
COMMITTEE = (
    "thomas_id string, name string, type string, "
    "subcommittees array<struct<thomas_id:string,name:string>>")
MEMBERSHIP = "map<string,array<struct<bioguide:string,title:string,party:string>>>"
AWARDS = ("map<string,struct<n_awards_top_25_by_amount:bigint,sum_amount_top_25:double,"
          "top_5_awards:array<struct<`Award ID`:string,`Recipient Name`:string,"
          "`Award Amount`:double,`Awarding Agency`:string,Description:string,"
          "`Action Date`:string>>>>")
CLAIM = ("struct<statement:string,confidence:string,category:string,"
         "supporting_query_hashes:array<string>,supporting_cards:array<string>,"
         "external_sources:array<struct<url:string,fetched_at:string,archive_path:string,"
         "wayback_url:string,purpose:string>>,fact_check_status:string,fact_check_notes:string,"
         "limitations:array<string>>")
PROVENANCE = (
    "name string, db_path string, sql string, sql_hash string, params string, "
    "schema array<struct<column:string,type:string>>, row_count bigint, "
    "elapsed_seconds double, executed_at string")
