"""Ranked anomaly detectors.

Most follow one shape: aggregate the cheap measure that decides the ranking,
cut to the top rows, and only then fetch the expensive columns (distinct counts,
joined lists) for the survivors. Column names default to the disclosure preset
and can be replaced to run a detector on other tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import FOREIGN_SUFFIXES, name_key_simple, normalize_name
from ..functions.text import any_keyword, bill_key, contains_folded, find_all, first_label
from ..session import cut_lineage
from .shape import (as_list, asc, decorate, desc, exact_quantile, joined_set, pct_change, quarter_number,
                    quarter_ordinal, ranked, safe_ratio)

QUARTERLY = ("Q1", "Q2", "Q3", "Q4")


def of_types(df: DataFrame, types, type_col: str = "filing_type") -> DataFrame:
    """Rows of the given filing types; ``None`` keeps all."""
    return df if types is None else df.where(F.col(type_col).isin(*types))


# --- D1 -----------------------------------------------------------------

def trailing_zscore(totals: DataFrame, entity, order, value: str, *, window: int = 4,
                    min_prior: int = 3) -> DataFrame:
    """Mean, deviation and z-score of each period against the preceding ones.

    ``totals`` holds one row per entity and period, so a window partition is as
    long as the history of one entity, not as its number of records.
    """
    w = (Window.partitionBy(*as_list(entity)).orderBy(*as_list(order))
         .rowsBetween(-window, -1))
    v = F.col(value)
    return (
        totals
        .withColumn("prior_mean", F.avg(v).over(w))
        .withColumn("prior_sd", F.stddev_pop(v).over(w))
        .withColumn("prior_n", F.count("*").over(w))
        .where((F.col("prior_n") >= min_prior) & (F.col("prior_sd") > 0))
        .withColumn("z_score", safe_ratio(v - F.col("prior_mean"), F.col("prior_sd")))
    )


def spending_spikes(filings: DataFrame, *, entity="registrant_id", label: str = "registrant_name",
                    year: str = "filing_year", period: str = "filing_period",
                    value: str = "income", types=QUARTERLY, type_col: str = "filing_type",
                    limit: int | None = 200, min_z_abs: float = 2.0, min_income: float = 50000,
                    compat: bool = False) -> DataFrame:
    """Entity-quarters whose total is far from the mean of the four quarters before.

    ``compat`` orders periods as text and splits an entity by its label.
    """
    entity = as_list(entity)
    rows = of_types(filings, types, type_col).where(F.col(value).isNotNull())
    total = F.sum(value).alias("total_income")
    if compat:
        totals = rows.groupBy(*entity, label, year, period).agg(total)
        order = [F.col(year), F.col(period)]
    else:
        totals = rows.groupBy(*entity, year, period).agg(F.min(label).alias(label), total)
        order = [quarter_ordinal(year, quarter_number(period))]
    scored = (
        trailing_zscore(totals, entity, order, "total_income")
        .where((F.col("total_income") >= min_income) & (F.abs("z_score") >= min_z_abs))
        .select(*entity, label, year, period, "total_income", "prior_mean", "prior_sd",
                "prior_n", "z_score")
    )
    return ranked(scored, [F.abs("z_score").desc(), *asc(*entity, label, year, period)], limit)


# --- D2 -----------------------------------------------------------------

def missing_value_clusters(filings: DataFrame, *, entity="registrant_id",
                           label: str = "registrant_name", values=("income",),
                           member: str = "client_id", year: str = "filing_year",
                           period: str = "filing_period", types=QUARTERLY,
                           type_col: str = "filing_type", limit: int | None = 200,
                           min_filings: int = 4, compat: bool = False) -> DataFrame:
    """Entities with many periodic rows in which every one of ``values`` is missing."""
    entity = as_list(entity)
    rows = of_types(filings, types, type_col)
    for v in values:
        rows = rows.where(F.col(v).isNull())
    text = F.concat_ws("-", F.col(year).cast("string"), F.col(period))
    # periods compare by (year, quarter) unless text order is asked for
    when = F.struct(text.alias("t")) if compat else F.struct(
        F.col(year).alias("y"), quarter_number(period).alias("q"), text.alias("t"))
    keys = [*entity, label] if compat else entity
    named = [] if compat else [F.min(label).alias(label)]
    out = (
        rows.groupBy(*keys)
        .agg(*named, F.count("*").alias("n_missing"),
             F.count_distinct(member).alias("distinct_clients"),
             F.min(when).alias("_first"), F.max(when).alias("_last"))
        .where(F.col("n_missing") >= min_filings)
        .select(*entity, label,
                F.col("n_missing").alias("quarterly_filings_with_null_income"),
                "distinct_clients",
                F.col("_first.t").alias("first_seen"), F.col("_last.t").alias("last_seen"))
    )
    order = [*desc("quarterly_filings_with_null_income", "distinct_clients"), *asc(*entity, label)]
    return ranked(out, order, limit)


# --- D3 -----------------------------------------------------------------

def role_holders(people: DataFrame, filings: DataFrame, *, person: str = "lobbyist_id",
                 names=("first_name", "last_name"), role: str = "covered_position",
                 record: str = "filing_uuid", client: str = "client_name", min_length: int = 12,
                 limit: int | None = 500) -> DataFrame:
    """Persons with a described past role, with all clients they appear for."""
    keys = [person, *names]
    fits = F.col(role).isNotNull() & (F.length(role) >= min_length)
    order = [*desc("filings_with_lobbyist"), *asc(*keys)]
    top = ranked(people.where(fits).groupBy(*keys)
                 .agg(F.count_distinct(record).alias("filings_with_lobbyist")), order, limit)
    # clients are looked up by person alone, roles by person and name
    wanted = top.withColumnsRenamed({c: f"_top_{c}" for c in top.columns})
    same_name = None
    for n in names:
        hit = F.col(n).eqNullSafe(F.col(f"_top_{n}"))
        same_name = hit if same_name is None else same_name & hit
    rows = (
        people.join(wanted, F.col(person).eqNullSafe(F.col(f"_top_{person}")))
        .select(*wanted.columns, record, F.when(fits & same_name, F.col(role)).alias("_role"))
        .distinct()
        .join(filings.select(record, client), record, "left")
    )
    out = (
        rows.groupBy(*wanted.columns)
        .agg(F.min("_role").alias("sample_position"),
             F.count_distinct("_role").alias("distinct_positions"),
             joined_set(client).alias("clients_lobbied_for"))
        .withColumnsRenamed({f"_top_{c}": c for c in top.columns})
        .select(*keys, "sample_position", "filings_with_lobbyist", "distinct_positions",
                "clients_lobbied_for")
    )
    return out if limit is None else out.orderBy(*order)


# --- D4 -----------------------------------------------------------------

def foreign_filings(foreign: DataFrame, filings: DataFrame, *, record: str = "filing_uuid",
                    value: str = "income", limit: int | None = 500) -> DataFrame:
    """Filings that declare a foreign entity, largest first."""
    out = foreign.join(filings, record).select(
        record, "filing_year", "filing_period", "registrant_name", "client_name",
        "client_country", "client_ppb_country", "foreign_entity_name",
        foreign["country"].alias("foreign_entity_country"),
        foreign["ppb_country"].alias("foreign_entity_ppb"), value, "url")
    return ranked(out, [*desc(value), *asc(record, "foreign_entity_name")], limit)


# --- D5 -----------------------------------------------------------------

def concentrated_entities(filings: DataFrame, *, entity: str = "registrant_id",
                          label: str = "registrant_name", member: str = "client_id",
                          member_label: str = "client_name", record: str = "filing_uuid",
                          year: str = "filing_year", value: str = "income", types=QUARTERLY,
                          type_col: str = "filing_type", max_members: int = 2,
                          limit: int | None = 200, min_total_income: float = 250000) -> DataFrame:
    """Entities that earn a lot from very few clients."""
    rows = of_types(filings, types, type_col)
    per_member = rows.groupBy(entity, member).agg(
        F.min(label).alias(label), F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("_total"),
        F.min(year).alias("_first"), F.max(year).alias("_last"))
    order = [*desc("total_income"), *asc(entity)]
    top = ranked(
        per_member.groupBy(entity).agg(
            F.min(label).alias(label), F.count(member).alias("distinct_clients"),
            F.sum("_total").alias("total_income"), F.min("_first").alias("earliest_year"),
            F.max("_last").alias("latest_year"))
        .where(F.col("distinct_clients").between(1, max_members)
               & (F.col("total_income") >= min_total_income)),
        order, limit)
    out = decorate(
        top, rows.select(entity, record, member_label), entity,
        F.count_distinct(record).alias("filings"), joined_set(member_label).alias("clients")
    ).select(entity, label, "distinct_clients", "filings", "total_income", "earliest_year",
             "latest_year", "clients")
    return out if limit is None else out.orderBy(*order)


# --- D6 -----------------------------------------------------------------

def contribution_flow(items: DataFrame, *, keys=("payee_name", "honoree_name"),
                      value: str = "amount", record: str = "filing_uuid",
                      source: str = "contributor_name", limit: int | None = 500) -> DataFrame:
    """Money by recipient pair; a pair counts if any of its names is present."""
    keys = as_list(keys)
    present = None
    for k in keys:
        hit = F.col(k).isNotNull()
        present = hit if present is None else present | hit
    rows = items.where(present)
    order = [*desc("total_amount"), *asc(*keys)]
    top = ranked(
        rows.groupBy(*keys).agg(
            F.count("*").alias("n_contributions"),
            F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("total_amount")),
        order, limit)
    out = decorate(top, rows.select(*keys, record, source), keys,
                   F.count_distinct(record).alias("distinct_filings"),
                   F.count_distinct(source).alias("distinct_contributors"))
    return out if limit is None else out.orderBy(*order)


# --- D7 -----------------------------------------------------------------

def category_shift(activities: DataFrame, filings: DataFrame, *,
                   category: str = "general_issue_code", record: str = "filing_uuid",
                   entity: str = "registrant_id", year: str = "filing_year",
                   period: str = "filing_period", value: str = "income", types=QUARTERLY,
                   type_col: str = "filing_type", limit: int | None = 500,
                   min_qoq_delta_pct: float = 25, compat: bool = False) -> DataFrame:
    """Categories whose total moved strongly against the period before.

    A filing counts once per category; ``compat`` counts it once per activity
    row and orders periods as text.
    """
    tagged = activities.where(F.col(category).isNotNull()).select(record, category)
    if not compat:
        tagged = tagged.distinct()
    joined = tagged.join(
        of_types(filings, types, type_col).select(record, entity, year, period, value), record)
    per_period = joined.groupBy(category, year, period).agg(
        F.count_distinct(entity).alias("registrants"),
        F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("total_income"))
    order = [F.col(year), F.col(period)] if compat else [
        quarter_ordinal(year, quarter_number(period))]
    w = Window.partitionBy(category).orderBy(*order)
    out = (
        per_period
        .withColumn("prior_income", F.lag("total_income").over(w))
        .withColumn("prior_registrants", F.lag("registrants").over(w))
        .where(F.col("prior_income") > 0)
        .withColumn("_delta", F.col("total_income") - F.col("prior_income"))
        .where(F.abs(safe_ratio(F.col("_delta"), F.col("prior_income"))) * 100
               >= min_qoq_delta_pct)
        .withColumn("income_delta_pct", pct_change("total_income", "prior_income"))
        .withColumn("registrants_delta_pct", pct_change("registrants", "prior_registrants"))
    )
    out = ranked(out, [F.abs("_delta").desc(), *asc(category, year, period)], limit)
    return out.drop("_delta")


# --- D8 -----------------------------------------------------------------

def new_entrants(filings: DataFrame, *, entity: str = "registrant_id",
                 label: str = "registrant_name", record: str = "filing_uuid",
                 member: str = "client_id", member_label: str = "client_name",
                 year: str = "filing_year", period: str = "filing_period", value: str = "income",
                 types=QUARTERLY, type_col: str = "filing_type", limit: int | None = 200,
                 lookback_quarters: int = 2, top_share: float | None = None,
                 compat: bool = False) -> DataFrame:
    """Entities first seen within the last periods, by total.

    ``top_share`` keeps only entrants whose first-period total is in that upper
    share of all new entrants. ``compat`` computes periods as ``year * 10 + q``
    with an inclusive lookback.
    """
    rows = of_types(filings, types, type_col)
    quarter = F.substring(type_col, 2, 1).try_cast("int") if compat else quarter_number(period)
    ordinal = F.col(year) * 10 + quarter if compat else quarter_ordinal(year, quarter)
    rows = rows.withColumn("_ord", ordinal)
    latest = rows.agg(F.max("_ord").alias("latest")).scalar()
    edge = latest - lookback_quarters - (1 if compat else 0)
    fresh = (rows.groupBy(entity).agg(F.min("_ord").alias("first_ord"))
             .where(F.col("first_ord") > edge))
    if top_share is not None:
        first_totals = (
            rows.join(fresh.select(F.col(entity).alias("_e"), F.col("first_ord").alias("_f")),
                      (F.col(entity) == F.col("_e")) & (F.col("_ord") == F.col("_f")))
            .groupBy(entity)
            .agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("first_total")))
        first_totals = cut_lineage(first_totals)
        floor = exact_quantile(first_totals, "first_total", 1 - top_share).scalar()
        fresh = first_totals.where(F.col("first_total") >= floor)
    own = rows.join(fresh.select(entity), entity, "left_semi")
    total = F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("total_income")
    rest = [F.min(label).alias(label), F.count_distinct(record).alias("filings_in_window"),
            F.count_distinct(member).alias("distinct_clients"), joined_set(member_label).alias("clients")]
    order = [*desc("total_income"), *asc(entity)]
    columns = [entity, label, "filings_in_window", "distinct_clients", "total_income", "clients"]
    if limit is None:
        return own.groupBy(entity).agg(total, *rest).where(F.col("total_income") > 0).select(*columns)
    top = ranked(own.groupBy(entity).agg(total).where(F.col("total_income") > 0), order, limit)
    # counts and lists for the ranked entrants only
    return decorate(top, rows, entity, *rest).select(*columns).orderBy(*order)


# --- D9 -----------------------------------------------------------------

def flag_parents(children: DataFrame, parent: str, signals: dict[str, Column]) -> DataFrame:
    """0/1 signals per parent, set if any child row shows them.

    Rows without any signal are dropped before the shuffle, and the rest is
    combined map-side; text is never gathered per parent.
    """
    hit = None
    for cond in signals.values():
        hit = cond if hit is None else hit | cond
    return children.where(hit).groupBy(parent).agg(
        *[F.max(cond.cast("int")).alias(name) for name, cond in signals.items()])


def multi_signal_score(records: DataFrame, own: dict[str, Column],
                       child_signals: list[tuple[DataFrame, dict[str, Column]]], *,
                       record: str = "filing_uuid", keep=(), score: str = "score",
                       order_by: str = "income", limit: int | None = 100, min_score: int = 2,
                       null_drops: bool = False) -> DataFrame:
    """Sum of boolean signals of a record and of its child rows.

    A signal that is null counts 0; with ``null_drops`` it voids the score, and
    the record drops out.
    """
    scored = records.select(
        record, *keep, *[cond.cast("int").alias(name) for name, cond in own.items()])
    names = list(own)
    for children, signals in child_signals:
        scored = scored.join(flag_parents(children, record, signals), record, "left")
        scored = scored.fillna(0, subset=list(signals))
        names += list(signals)
    if not null_drops:
        scored = scored.fillna(0, subset=list(own))
    total = None
    for n in names:
        total = F.col(n) if total is None else total + F.col(n)
    scored = scored.withColumn(score, total).where(F.col(score) >= min_score)
    return ranked(scored, [*desc(score, order_by), *asc(record)], limit)


# --- D10 ----------------------------------------------------------------

def registry_gap_candidates(filings: DataFrame, foreign: DataFrame, registry: DataFrame,
                            activities: DataFrame, *, years, topic_keywords, owner_keywords,
                            home=("US", "United States of America"), record: str = "filing_uuid",
                            name: str = "registrant_name", registry_name: str = "registrant_name",
                            client: str = "client_name", country: str = "client_country",
                            ppb: str = "client_ppb_country", year: str = "filing_year",
                            value: str = "income", description: str = "description",
                            word: bool = False, limit: int | None = 200,
                            compat: bool = False) -> DataFrame:
    """Filings with a foreign child row whose filer is missing from another registry.

    At least one of four signals must show: client abroad, place of business
    abroad, topic keywords in the activities, state-owned naming of the client.
    """
    def key(c):
        return name_key_simple(c, compat=True) if compat else F.coalesce(
            normalize_name(c), F.lit(""))

    topic = "sig_foreign_gov_topic"
    topics = flag_parents(activities, record,
                          {topic: any_keyword(description, topic_keywords, word)})
    listed = registry.select(key(registry_name).alias("_key")).distinct()

    def abroad(c):
        return (F.col(c).isNotNull() & ~F.col(c).isin(*home)).cast("int")

    out = (
        filings.where(F.col(year).isin(*years))
        .select(record, year, name, client, country, ppb, value, "url",
                key(name).alias("_key"))
        .join(foreign.select(record), record, "left_semi")
        .join(listed, "_key", "left_anti").drop("_key")
        .join(topics, record, "left").fillna(0, subset=[topic])
        .withColumn("sig_non_us_client", abroad(country))
        .withColumn("sig_non_us_ppb", abroad(ppb))
        .withColumn("sig_soe_pattern", any_keyword(client, owner_keywords, word).cast("int"))
        .where(F.col("sig_non_us_client") + F.col("sig_non_us_ppb") + F.col(topic)
               + F.col("sig_soe_pattern") > 0)
    )
    order = [*desc(value), *asc(record)]
    top = ranked(out, order, limit)
    out = decorate(top, foreign.select(record, F.col("country").alias("_c")), record,
                   joined_set("_c", ",").alias("fe_countries")).select(
        record, year, name, client, country, ppb, "fe_countries", value, "sig_non_us_client",
        "sig_non_us_ppb", topic, "sig_soe_pattern", "url")
    return out if limit is None else out.orderBy(*order)


# --- D11 ----------------------------------------------------------------

def role_topic_match(people: DataFrame, activities: DataFrame, filings: DataFrame, *, labels,
                     topics: dict[str, tuple], years, link: str = "activity_id",
                     person: str = "lobbyist_id", names=("first_name", "last_name"),
                     role: str = "covered_position", record: str = "filing_uuid",
                     category: str = "general_issue_code", value: str = "income",
                     year: str = "filing_year", types=QUARTERLY, type_col: str = "filing_type",
                     min_length: int = 12, limit: int | None = 200) -> DataFrame:
    """Persons whose past role points to a body that oversees what they work on now.

    ``labels`` maps role text to a body (first match wins) and ``topics`` maps a
    body to its categories. The categories are unfolded next to the person, so the
    match is an equi-join that includes the category and not a filter over all
    pairs. ``link`` is the key that ties a person row to an activity row; the
    filing key links a person to every activity of the filing. With a limit the
    matches are ranked before they are multiplied by the person's role texts.
    """
    codes = [(label, code) for label, cs in topics.items() for code in cs]
    body_codes = None
    for label, cs in topics.items():
        arr = F.array(*[F.lit(c) for c in cs]) if cs else F.array().cast("array<string>")
        hit = F.col("former_committee") == label
        body_codes = F.when(hit, arr) if body_codes is None else body_codes.when(hit, arr)
    roles = (
        people.where(F.col(role).isNotNull() & (F.length(role) >= min_length))
        .select(person, *names, role).distinct()
        .withColumn("former_committee", first_label(role, labels))
        .where(F.col("former_committee").isNotNull())
        .withColumn(category, F.explode(body_codes))
    )
    current = of_types(filings, types, type_col).where(
        F.col(year).isin(*years) & (F.col(value) > 0)).select(
        record, year, "filing_period", "registrant_name", "client_name", value, "url")
    relevant = activities.where(F.col(category).isin(*{c for _, c in codes})).select(
        *{record, link}, category, "description")
    who = (people.select(link, person).distinct()
           .join(roles.select(person, category).distinct(), person))
    order = [*desc(value), *asc(record, person, category, "description")]
    # the period filter goes first, it leaves the fewest rows
    matches = ranked(relevant.join(current, record).join(who, [link, category]), order, limit)
    found = matches.join(roles, [person, category]).select(
        person, *names, "former_committee", role, record, year, "filing_period",
        "registrant_name", "client_name", category, "description", value, "url")
    return ranked(found, [*order, *asc(*names, role)], limit)


# --- D12 ----------------------------------------------------------------

def say_vs_pay(filings: DataFrame, people: DataFrame, assignments: DataFrame, members: DataFrame,
               press: DataFrame, *, target_committee: str = "finance",
               client_pattern: str = "%apollo%", press_pattern: str | None = None,
               press_term: str | None = "private equity",
               years=(2024, 2025, 2026), record: str = "filing_uuid",
               person: str = "lobbyist_id", role: str = "covered_position",
               member: str = "bioguide_id", value: str = "income", limit: int | None = 200,
               compat: bool = False) -> DataFrame:
    """Filings for a client by people from a committee, next to what its members say.

    Statements match ``press_pattern``, by default the client pattern, and hold
    ``press_term``. With a limit the filings are ranked before they are multiplied
    by people and role texts. ``compat`` counts a member once per role held.
    """
    former = (people.where(contains_folded(role, target_committee))
              .select(person, "first_name", "last_name", role).distinct())
    seats = assignments.where(contains_folded("committee_name", target_committee))
    seated = seats.join(members, member).select(
        member, *(["name", "party", "state", "role"] if compat else [])).distinct()
    said = press.where(F.lower("text").like(press_pattern or client_pattern))
    if press_term:
        said = said.where(contains_folded("text", press_term))
    n_members = seated.agg(F.count("*").alias("n")).scalar()
    n_press = said.agg(F.count("*").alias("n")).scalar()
    n_speaking = (said.join(seated.select(member), member, "left_semi")
                  .agg(F.count_distinct("member_name").alias("n")).scalar())
    staffed = people.select(record, person).join(former.select(person), person, "left_semi")
    order = [*desc(value), *asc(record)]
    chosen = ranked(
        filings.where(F.lower("client_name").like(client_pattern)
                      & F.col("filing_year").isin(*years))
        .select(record, "registrant_name", "client_name", value)
        .join(staffed, record, "left_semi"), order, limit)
    paid = (
        chosen.join(staffed.distinct(), record).join(former, person)
        .select(record, "registrant_name", "client_name", value, "first_name", "last_name", role)
        .distinct()
    )
    order += asc("first_name", "last_name", role)
    return ranked(paid, order, limit).select(
        F.col("registrant_name").alias("lobbying_firm"),
        F.col("client_name").alias("lobbied_client"),
        F.concat("first_name", F.lit(" "), "last_name").alias("lobbyist"),
        F.col(role).alias("former_role"),
        n_members.alias("current_committee_members"),
        n_press.alias("attack_press_releases"),
        n_speaking.alias("committee_members_attacking"),
        value)


# --- further catalogue entries --------------------------------------------

def pattern_mentions(texts: DataFrame, text: str, *, pattern: str, record: str | None = None,
                     key=bill_key, alias: str = "mention", min_count: int = 1,
                     limit: int | None = None) -> DataFrame:
    """How often each matched token occurs over all texts, and in how many records."""
    found = texts.select(
        *([record] if record else []), F.explode(find_all(text, pattern)).alias("_m"))
    found = found.withColumn(alias, key(F.col("_m")))
    aggs = [F.count("*").alias("n_mentions")]
    if record:
        aggs.append(F.count_distinct(record).alias("n_records"))
    out = found.groupBy(alias).agg(*aggs).where(F.col("n_mentions") >= min_count)
    return ranked(out, [*desc("n_mentions"), *asc(alias)], limit)


def undisclosed_foreign_name(filings: DataFrame, foreign: DataFrame, *,
                             suffixes=FOREIGN_SUFFIXES, record: str = "filing_uuid",
                             client: str = "client_name", member: str = "client_id",
                             value: str = "income", limit: int | None = None) -> DataFrame:
    """Clients named like a company abroad on filings without a foreign child row."""
    pattern = r"(?i)(?:^|\W)(?:" + "|".join(suffixes) + r")(?:\W|$)"
    out = (
        filings.where(F.col(client).rlike(pattern))
        .join(foreign.select(record), record, "left_anti")
        .groupBy(member, client)
        .agg(F.count("*").alias("n_filings"),
             F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("total_income"))
    )
    return ranked(out, [*desc("total_income"), *asc(member, client)], limit)


def donor_topic_divergence(items: DataFrame, links: DataFrame, press: DataFrame, *,
                           topic_words: dict[str, tuple], honoree: str = "honoree_name",
                           donor: str = "contributor_name", value: str = "amount",
                           topic: str = "general_issue_code", speaker: str = "member_name",
                           text: str = "text", n: int = 10) -> DataFrame:
    """Top recipients: what their donors work on against what they speak about.

    ``links`` ties a donor to the topics it works on; ``topic_words`` says which
    words reveal a topic in a speaker's texts.
    """
    totals = items.where(F.col(honoree).isNotNull()).groupBy(honoree).agg(
        F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("total_amount"))
    top = ranked(totals, [*desc("total_amount"), *asc(honoree)], n)
    given = (
        items.join(top, honoree).groupBy(honoree, "total_amount", donor)
        .agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("_given")))
    worked = given.join(links.select(donor, topic).distinct(), donor).groupBy(
        honoree, "total_amount", topic).agg(F.count("*").alias("n_donors"),
                                            F.sum("_given").alias("donor_amount"))
    flags = F.array_compact(F.array(*[
        F.when(any_keyword(text, words), F.lit(name)) for name, words in topic_words.items()]))
    spoken = (
        press.select(F.col(speaker).alias(honoree), F.explode(flags).alias(topic))
        .groupBy(honoree, topic).agg(F.count("*").alias("n_statements")))
    return (
        worked.join(spoken, [honoree, topic], "left")
        .fillna(0, subset=["n_statements"])
        .withColumn("divergent", (F.col("n_statements") == 0).cast("int"))
        .select(honoree, "total_amount", topic, "n_donors", "donor_amount", "n_statements",
                "divergent")
    )


def role_text_parse(people: DataFrame, filings: DataFrame, *, committee: str, member: str,
                    job: str, person: str = "lobbyist_id", role: str = "covered_position",
                    record: str = "filing_uuid", client: str = "client_name",
                    min_length: int = 12) -> DataFrame:
    """Role text taken apart by three patterns, with the person's number of clients."""
    def part(pattern):
        return F.nullif(F.regexp_extract(role, pattern, 1), F.lit(""))

    parsed = (
        people.where(F.length(role) >= min_length).select(person, role).distinct()
        .withColumn("committee", part(committee))
        .withColumn("member", part(member))
        .withColumn("job", part(job)))
    clients = (
        people.select(person, record).distinct().join(filings.select(record, client), record)
        .groupBy(person).agg(F.count_distinct(client).alias("n_clients")))
    return parsed.join(clients, person, "left").fillna(0, subset=["n_clients"])


def corpus_name_search(tables: dict[str, tuple[DataFrame, str, list[str]]], needle: str) -> DataFrame:
    """Where a name occurs: one row per table, record and column that holds it.

    ``tables`` maps a table name to (frame, id column, text columns). Each table
    is scanned once, whatever the number of its columns.
    """
    out = None
    wanted = needle.upper()
    for name, (df, ident, columns) in tables.items():
        cells = F.array(*[
            F.when(F.contains(F.upper(F.col(c).cast("string")), F.lit(wanted)), F.lit(c))
            for c in columns])
        hits = df.select(
            F.lit(name).alias("table_name"), F.col(ident).cast("string").alias("record_id"),
            F.explode(F.array_compact(cells)).alias("column_name"))
        out = hits if out is None else out.unionByName(hits)
    return out


def name_totals(records: DataFrame, needle: str, *, columns, entity: str = "registrant_id",
                label: str = "registrant_name", value: str = "income",
                limit: int | None = None) -> DataFrame:
    """Records that mention a name in any of the columns, counted and summed per entity."""
    wanted = needle.upper()
    hit = None
    for c in columns:
        here = F.contains(F.upper(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(wanted))
        hit = here if hit is None else hit | here
    out = records.where(hit).groupBy(entity).agg(
        F.min(label).alias(label), F.count("*").alias("n_records"),
        F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias("total_income"))
    return ranked(out, [*desc("total_income"), *asc(entity)], limit)
