"""Preset for lobbying disclosures: word lists and the twelve catalogued detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import BILL_PATTERN, any_keyword, contains_folded
from ..operators import detect, resolve
from ..session import cut_lineage
from .catalogue import register_detector

# --- fixed values: word lists and code sets the results depend on -------------

ESOTERIC_TERMS = ("empress", "annuit coeptis", "king solomon", "sui generis")
SELF_STYLED_TITLES = ("empress", "head of state", "assumed the presiden", "queen")
FOREIGN_GOVERNMENT_TOPICS = ("foreign government", "embassy", "fara", "sanctions", "ambassador")
STATE_OWNED_NAMING = ("national oil", "state-owned", "national bank", "republic of",
                      "kingdom of", "ministry of", "embassy of")
COMMITTEE_LABELS = (
    ("armed_services", ("armed services",)),
    ("ways_means", ("ways and means",)),
    ("appropriations", ("appropriation",)),
    ("finance", ("finance",)),
    ("judiciary", ("judiciary",)),
    ("intelligence", ("intelligence",)),
    ("foreign_relations", ("foreign relations",)),
    ("foreign_affairs", ("foreign affairs",)),
    ("energy_commerce", ("energy and commerce", "energy & commerce")),
    ("homeland_security", ("homeland security",)),
    ("veterans_affairs", ("veterans",)),
    ("health", ("health",)),
    ("agriculture", ("agriculture",)),
)
COMMITTEE_TOPICS = {
    "armed_services": ("DEF", "HOM", "INT"),
    "ways_means": ("TAX", "BUD", "TRD", "HCR"),
    "appropriations": ("BUD", "DEF", "HCR", "EDU"),
    "finance": ("TAX", "BUD", "BAN", "FIN"),
    "judiciary": ("LAW", "IMM", "BNK", "CON", "CIV"),
    "intelligence": ("INT", "DEF", "HOM", "CSP"),
    "foreign_relations": ("FOR", "TRD", "DEF"),
    "foreign_affairs": ("FOR", "TRD", "DEF"),
    "energy_commerce": ("ENG", "HCR", "TEC", "TRA", "CPT"),
    "homeland_security": ("HOM", "IMM", "CSP"),
    "veterans_affairs": (),
    "health": ("HCR", "MED", "HPI"),
    "agriculture": ("AGR", "FOO", "TRD"),
}
CURRENT_YEARS = (2024, 2025, 2026)
# how a past position names its committee or chamber, the member, and the role
ROLE_COMMITTEE = r"(?i)((?:house|senate)\s+(?:select\s+)?(?:committee|cmte)?\s*(?:on\s+)?[a-z &]*?)(?:,|;|$)"
ROLE_MEMBER = r"(?:Sen(?:ator|\.)?|Rep(?:resentative|\.)?|Congress(?:man|woman))\s+((?:[A-Z][A-Za-z.'\-]+\s?){1,3})"
ROLE_JOB = r"(?i)\b(chief of staff|counsel|legislative (?:director|assistant|counsel)|staff director|(?:press|communications) (?:secretary|director)|(?:professional )?staff member|intern|adviser|advisor|fellow)\b"

# --- catalogue ----------------------------------------------------------------


@register_detector("D1", "spending_spikes",
                   "Entity-quarter totals far from the mean of the four quarters before.",
                   limit=200, min_z_abs=2.0, min_income=50000, compat=False)
def d1(tables, **params):
    return detect.spending_spikes(tables["senate_filings"], **params)


@register_detector("D2", "missing_income_filings",
                   "Quarterly filings without income, clustered by registrant.",
                   limit=200, min_filings=4, compat=False)
def d2(tables, **params):
    return detect.missing_value_clusters(tables["senate_filings"], **params)


@register_detector("D3", "revolving_door_candidates",
                   "Lobbyists with a described past position and all their clients.", limit=500)
def d3(tables, **params):
    return detect.role_holders(tables["senate_activity_lobbyists"], tables["senate_filings"],
                               **params)


@register_detector("D4", "foreign_filings", "Filings that declare foreign entities.", limit=500)
def d4(tables, **params):
    return detect.foreign_filings(tables["senate_foreign_entities"], tables["senate_filings"],
                                  **params)


@register_detector("D5", "single_client_juggernauts",
                   "Registrants with one or two clients and a high total.",
                   limit=200, min_total_income=250000)
def d5(tables, **params):
    return detect.concentrated_entities(tables["senate_filings"], **params)


@register_detector("D6", "pac_contribution_flow", "Contributions by payee and honoree.", limit=500)
def d6(tables, **params):
    return detect.contribution_flow(tables["senate_contribution_items"], **params)


@register_detector("D7", "issue_concentration_shifts",
                   "Issue codes whose quarterly total moved strongly.",
                   limit=500, min_qoq_delta_pct=25, compat=False)
def d7(tables, **params):
    return detect.category_shift(tables["senate_lobbying_activities"], tables["senate_filings"],
                                 **params)


@register_detector("D8", "new_registrant_surge",
                   "Registrants first seen in the latest quarters, by total.",
                   limit=200, lookback_quarters=2, compat=False)
def d8(tables, **params):
    return detect.new_entrants(tables["senate_filings"], **params)


@register_detector("D9", "shell_pattern_filings",
                   "Filings that show several oddities of naming, wording and contacts.",
                   limit=100, min_score=2, compat=False)
def d9(tables, limit, min_score, compat):
    described = "client_general_description"
    posted = F.col("posted_by_name")
    own = {
        "sig_sovereign_client": contains_folded(described, "sovereign"),
        "sig_established_govt": contains_folded(described, "established government"),
        "sig_posted_by_llc_slashes": posted.like("%/%/%") | posted.like("%LLC%"),
        "sig_global_pbc_naming": contains_folded("client_name", "global public benefit"),
    }
    children = [
        (tables["senate_lobbying_activities"],
         {"sig_esoteric_terms": any_keyword("description", ESOTERIC_TERMS)}),
        (tables["senate_activity_lobbyists"],
         {"sig_self_styled_title": any_keyword("covered_position", SELF_STYLED_TITLES)}),
    ]
    out = detect.multi_signal_score(
        tables["senate_filings"], own, children,
        keep=("filing_year", "filing_period", "filing_type", "registrant_name", "client_name",
              F.col(described).alias("client_desc"), "income", "url"),
        score="shell_score", limit=limit, min_score=min_score, null_drops=compat)
    return out.select(
        "filing_uuid", "filing_year", "filing_period", "filing_type", "registrant_name",
        "client_name", "client_desc", "income", "shell_score", "sig_sovereign_client",
        "sig_established_govt", "sig_esoteric_terms", "sig_self_styled_title",
        "sig_posted_by_llc_slashes", "sig_global_pbc_naming", "url")


@register_detector("D10", "fara_gap_narrowed",
                   "Foreign-linked filings whose registrant is not in the foreign-agent registry.",
                   limit=200, years=CURRENT_YEARS, compat=False)
def d10(tables, **params):
    return detect.registry_gap_candidates(
        tables["senate_filings"], tables["senate_foreign_entities"], tables["fara_registrants"],
        tables["senate_lobbying_activities"],
        topic_keywords=FOREIGN_GOVERNMENT_TOPICS, owner_keywords=STATE_OWNED_NAMING, **params)


@register_detector("D11", "revolving_door_committee_match",
                   "Former committee staff now working on that committee's topics.",
                   limit=200, years=CURRENT_YEARS, link="activity_id")
def d11(tables, **params):
    return detect.role_topic_match(
        tables["senate_activity_lobbyists"], tables["senate_lobbying_activities"],
        tables["senate_filings"], labels=COMMITTEE_LABELS, topics=COMMITTEE_TOPICS,
        **params)


@register_detector("D12", "committee_say_vs_pay",
                   "Filings for a client by former committee staff, next to members' statements.",
                   limit=200, target_committee="finance", client_pattern="%apollo%",
                   press_term="private equity", years=CURRENT_YEARS, compat=False)
def d12(tables, **params):
    return detect.say_vs_pay(
        tables["senate_filings"], tables["senate_activity_lobbyists"],
        tables["congress_committee_assignments"], tables["congress_members"],
        tables["press_releases"], **params)


@register_detector("DX", "bill_mentions", "Bills cited in the activities of both chambers.",
                   min_count=1, limit=None)
def dx(tables, **params):
    texts = tables["senate_lobbying_activities"].select(
        "activity_id", F.col("description").alias("text")).unionByName(
        tables["house_lobbying_activities"].select(
            "activity_id", F.col("specific_issues").alias("text")))
    return detect.pattern_mentions(texts, "text", pattern=BILL_PATTERN, record="activity_id",
                                   alias="bill", **params)


@register_detector("DZ", "undisclosed_foreign_name",
                   "Clients named like a company abroad without a foreign entity on the filing.",
                   limit=200)
def dz(tables, **params):
    return detect.undisclosed_foreign_name(
        tables["senate_filings"], tables["senate_foreign_entities"], **params)


@register_detector("D8v", "new_registrant_surge_top",
                   "New registrants whose first-quarter total is in the top tenth of all new ones.",
                   limit=200, lookback_quarters=2, top_share=0.1, compat=False)
def d8v(tables, **params):
    return detect.new_entrants(tables["senate_filings"], **params)


@register_detector("DV", "role_text_parse",
                   "Past positions taken apart into committee or chamber, member and role.",
                   committee=ROLE_COMMITTEE, member=ROLE_MEMBER, job=ROLE_JOB, min_length=12)
def dv(tables, **params):
    return detect.role_text_parse(tables["senate_activity_lobbyists"], tables["senate_filings"], **params)


@register_detector("TX", "name_totals", "Filings that mention a name, counted and summed per registrant.",
                   needle="apollo", columns=("registrant_name", "client_name", "client_general_description"), limit=None)
def tx(tables, needle, columns, limit):
    return detect.name_totals(tables["senate_filings"], needle, columns=list(columns), limit=limit)


# --- entity resolution --------------------------------------------------------


def resolve_registrants(tables, *, threshold: float = 92, same_state: bool = False,
                        bridges=(("registrant_id", "senate_id_registrant", "bridge_senate_id"),),
                        review_floor: float | None = None):
    """Senate registrants matched to House organisations: (canonical, queue, report)."""
    left = resolve.entity_pool(
        tables["senate_filings"], ident="registrant_id", name="registrant_name",
        extra=["registrant_house_id", "registrant_state"])
    right = resolve.entity_pool(
        tables["house_filings"], ident="senate_id_registrant", name="organization_name",
        extra=["house_id", "state"], need="organization_name")
    names = {"ident": "registrant_id", "name": "registrant_name",
             "right_name": "organization_name"}
    p1 = resolve.bridge_pass(left, right, bridges, **names)
    p2 = resolve.exact_pass(left, right, p1, **names,
                            same=[("registrant_state", "state")] if same_state else [])
    rest = resolve.residual(left, [p1, p2], ident="registrant_id", name="registrant_name")
    p3, queue = resolve.fuzzy_pass(rest, right, right_name="organization_name",
                                   threshold=threshold, review_floor=review_floor)
    canonical = cut_lineage(resolve.consolidate([p1, p2, p3]))  # matched once for all readers
    report = resolve.resolution_report(canonical, left, right, queue, ident="registrant_id",
                                       right_name="organization_name")
    return canonical, queue, report
