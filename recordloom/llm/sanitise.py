"""Personal data: patterns for the entities, information theory for what gives them away.

Base spans (email, IP, card, phone) are found by patterns in the whole text. Around
them, terms are judged by what the corpus knows: with document frequencies over all
documents, the pointwise mutual information of entity ``c`` and term ``t``,
``PMI(c; t) = ln(p(c, t) / (p(c) p(t)))``, is compared with the entity's information
``IC(c) = -ln p(c)``. A term that carries ``disclose`` of it or more (``PMI >= disclose * IC``)
reveals the entity in every text that names both: it is removed if it occurs with the
entity only (``PMI = IC``), else generalised to its class. ``support`` is the least number
of distinct texts (``by="documents"``: of documents, copies included) that must hold both, since fewer
are no estimate. With ``everywhere`` a disclosing term is generalised in texts that do not name the
entity too, as it gives the entity away there just as well.

All of it is DataFrame code. Positions come from pairs of ``split`` and
``regexp_extract_all`` with the same pattern, in code points. The patterns are possessive and
anchored at the start of a run, so that long runs cost linear time and no stack.

A text with copies weighs as many as it has, and one of them is read for its terms. Only entities with that ``support`` are paired with
terms, and counts have map-side partial sums. Texts are joined in place with what is known about them by a key of two longs, as long as that
is small enough to be broadcast (``MOST_TERMS``, ``MOST_TEXTS``); beyond that the joins are shuffles, with equal results.

Edge cases: a null text counts as empty and has no spans; repeated rows get equal results;
an empty table gives an empty result; all input columns stay unless they have
the name of a result column, which then replaces it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.llm.common import let, shipped_if_small, text_of
from recordloom.session import cut_lineage

# The kinds in their order, and what each looks like.
KINDS = ("email", "ip", "card", "phone")
EMAIL = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
CARD_DIGITS = (14, 19)
PHONE_DIGITS = (10, 15)

TERM = r"[\p{L}\p{N}]{3,}"
#: Broadcast bound for the terms whose frequency is asked for, about 100 MB in memory.
MOST_TERMS = 1_000_000
#: The same for the texts with such terms, which come with a list of them.
MOST_TEXTS = 500_000
_SPANS = "array<struct<s:int,k:int,e:int>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid_card(match: Column) -> Column:
    return F.length(_digits(match)).between(*CARD_DIGITS) & F.call_function("luhn_check", _digits(match))


def _valid_phone(match: Column) -> Column:
    return F.length(_digits(match)).between(*PHONE_DIGITS)


def matches(text: Column, pattern: str | Column, kind: int | Callable[[Column], Column],
            valid: Callable[[Column], Column] | None = None) -> Column:
    """Spans ``(s, k, e)`` of the matches that are valid, in code points."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    kind_of = kind if callable(kind) else (lambda _: F.lit(kind))
    pieces = F.filter(
        F.zip_with(F.split(text, p, -1), F.regexp_extract_all(text, p, F.lit(0)),
                   lambda gap, hit: F.struct(F.length(gap).alias("g"), hit.alias("m"))),
        lambda x: x["m"].isNotNull())

    def step(acc, x):
        start = acc["at"] + x["g"]
        end = start + F.length(x["m"])
        ok = valid(x["m"]) if valid else F.lit(True)
        span = F.array(F.struct(start.alias("s"), kind_of(x["m"]).cast("int").alias("k"), end.alias("e")))
        return F.struct(end.alias("at"),
                        F.when(ok, F.concat(acc["found"], span)).otherwise(acc["found"]).cast(_SPANS).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))
    return F.aggregate(pieces, zero, step, lambda acc: acc["found"])


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    none = F.array().cast(_SPANS)

    def found(t):
        digit = t.rlike("[0-9]")
        return F.sort_array(F.concat(
            F.when(F.contains(t, F.lit("@")), matches(t, EMAIL, 0)).otherwise(none),
            F.when(digit & F.contains(t, F.lit(".")), matches(t, IP, 1, lambda m: m.rlike(IP_PART))).otherwise(none),
            F.when(digit, matches(t, CARD, 2, _valid_card)).otherwise(none),
            F.when(digit & F.contains(t, F.lit("+")), matches(t, PHONE, 3, _valid_phone)).otherwise(none)))

    return let(text, found)


def _cut(text: Column, spans: Column, label: Callable[[Column, Column], Column]) -> Column:
    """The text with each span (overlapping ones as one) replaced by its label."""
    def step(acc, x):
        fresh = x["s"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]),
                                   label(x, x["e"] - x["s"])))
            .when(x["e"] > acc["at"], F.concat(acc["out"], label(F.struct(
                F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("k")), x["e"] - acc["at"])))
            .otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, zero, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _masked(text: Column, spans: Column) -> Column:
    """Base spans blanked out, all positions as before."""
    return _cut(text, spans, lambda x, n: F.repeat(F.lit(" "), n))


def _entities(text: Column, spans: Column) -> Column:
    """Distinct entities as kind and normalised value."""
    def value(x):
        raw = F.substring(text, x["s"] + 1, x["e"] - x["s"])
        plain = F.when(x["k"].isin(0, 1), F.lower(raw)).otherwise(_digits(raw))
        return F.concat(F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"]), F.lit(":"), plain)
    return F.array_distinct(F.transform(spans, value))


def disclosing_terms(docs: DataFrame, text: str = "text", disclose: float = 0.9, support: int = 3,
                     by: str = "texts", everywhere: bool = False) -> DataFrame:
    """Per distinct text with such terms: ``_k1, _k2``, the terms ``_gone`` that are to be removed, and ``_all`` of them."""
    if by not in ("texts", "documents"):
        raise ValueError(f"support is by texts or documents, not {by}")
    t = text_of(text)
    words = lambda column: F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(TERM), F.lit(0)))
    # a generator instead of a filter on the spans, which the planner would compute twice
    found = docs.select(
        F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit(1), t).alias("_k2"),
        F.inline(F.filter(F.array(F.struct(t.alias("_t"), base_spans(t).alias("_s"))),
                          lambda x: F.size(x["_s"]) > 0)))
    named = cut_lineage(found.select(
        F.monotonically_increasing_id().alias("_row"), "_k1", "_k2", _masked(F.col("_t"), F.col("_s")).alias("_masked"),
        _entities(F.col("_t"), F.col("_s")).alias("_entities")))
    key = ("_k1", "_k2")

    # a row for each text and entity, with one of the text's copies and their number
    holds = cut_lineage(named.select("_row", *key, F.explode("_entities").alias("_c")).groupBy(*key, "_c").agg(
        F.min("_row").alias("_row"), F.count("*").alias("_copies")))
    known = holds.groupBy("_c").agg(F.count("*").alias("_texts"), F.sum("_copies").alias("_nc")) \
        .where(F.col("_texts" if by == "texts" else "_nc") >= support).drop("_texts")
    held = cut_lineage(holds.join(known, "_c"))
    # words of one copy of each text that names a known entity
    chosen = shipped_if_small(held.select("_row").distinct(), MOST_TERMS)
    terms = cut_lineage(named.join(chosen, "_row", "left_semi").select(*key, F.explode(words("_masked")).alias("_w")))
    pairs = cut_lineage(
        held.join(terms, [*key]).groupBy("_c", "_w")
        .agg(F.count("*").alias("_texts"), F.sum("_copies").alias("_nct"), F.max("_nc").alias("_nc"))
        .where(F.col("_texts" if by == "texts" else "_nct") >= support).drop("_texts"))
    # every word of the corpus meets this table, so a shuffle of it is avoided where possible
    wanted = shipped_if_small(pairs.select("_w").distinct(), MOST_TERMS)
    seen = docs.select(F.explode(words(t)).alias("_w")).join(wanted, "_w", "left_semi").groupBy("_w").agg(F.count("*").alias("_nt"))
    n_docs = docs.agg(F.count("*").alias("_n"))

    n = n_docs.scalar().cast("double")
    nt = F.greatest("_nt", "_nct")
    pmi = F.log(n * F.col("_nct") / (F.col("_nc") * nt))
    ic = F.log(n / F.col("_nc"))
    judged = cut_lineage(
        pairs.join(seen, "_w")
        .where((ic > 0) & (pmi >= disclose * ic))
        .select("_c", "_w", (F.col("_nct") >= nt).alias("_only"))
    )
    per_text = (
        held.join(judged, "_c").join(terms, [*key, "_w"])
        .groupBy(*key).agg(F.collect_set(F.when(F.col("_only"), F.col("_w"))).alias("_gone"),
                           F.collect_set("_w").alias("_all"))
    )
    if everywhere:
        judged_terms = shipped_if_small(judged.select("_w").distinct(), MOST_TERMS)
        hits = docs.select(F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit(1), t).alias("_k2"), F.explode(words(t)).alias("_w")) \
            .join(judged_terms, "_w", "left_semi").groupBy(*key).agg(F.collect_set("_w").alias("_every"))
        per_text = hits.join(per_text.select(*key, "_gone"), [*key], "left").select(
            *key, F.coalesce("_gone", F.array().cast("array<string>")).alias("_gone"), F.col("_every").alias("_all"))
    return per_text


def _term_spans(text: Column, base: Column, gone: Column, every: Column) -> Column:
    """The spans of a text's terms outside of its base spans: kind 4 those to remove, 5 those to generalise."""
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(every, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return matches(_masked(text, base), pattern, lambda m: F.when(F.array_contains(gone, F.lower(m)), 4).otherwise(5))


def find(docs: DataFrame, text: str = "text", disclose: float = 0.9, support: int = 3,
         columns: list[str] | None = None, by: str = "texts", everywhere: bool = False) -> DataFrame:
    """The documents with ``n_email, n_ip, n_card, n_phone, n_terms, base_sha256, spans`` and the arrays
    ``_base`` and ``_terms`` of spans (start, kind, end)."""
    t = text_of(text)
    names = KINDS + ("term", "broad")
    written = lambda a: F.array_join(F.transform(a, lambda x: F.concat(
        F.get(F.array(*[F.lit(k) for k in names]), x["k"]), F.lit(":"), x["s"].cast("string"),
        F.lit(":"), x["e"].cast("string"))), ",")
    result = ["n_email", "n_ip", "n_card", "n_phone", "n_terms", "base_sha256", "spans", "_base", "_terms"]
    carried = [c for c in (docs.columns if columns is None else columns) if c not in result]
    # carried columns may have any name, so they travel as one
    base = docs.select(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(carried)], F.lit(0).alias("none")).alias("_carried"),
                       t.alias("_t"), F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit(1), t).alias("_k2"))
    # the texts stay where they are while the terms fit into a broadcast
    terms = shipped_if_small(disclosing_terms(docs, text, disclose, support, by, everywhere), MOST_TEXTS) \
        .withColumnsRenamed({"_k1": "_t1", "_k2": "_t2"})
    joined = base.join(terms, (base["_k1"] == terms["_t1"]) & (base["_k2"] == terms["_t2"]), "left")
    spans = let(base_spans(F.col("_t")), lambda b: F.struct(b.alias("_base"), F.when(
        F.col("_all").isNotNull(), _term_spans(F.col("_t"), b, F.col("_gone"), F.col("_all"))).alias("_terms")))
    # a generator, so that the spans are computed once
    joined = joined.select("_carried", F.inline(F.array(spans)))
    of = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long")
    return joined.withColumn("_terms", F.coalesce("_terms", F.array().cast(_SPANS))).select(
        *[F.col(f"_carried.c{k}").alias(c) for k, c in enumerate(carried)], *[of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.size("_terms").cast("long").alias("n_terms"),
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"),
        written(F.sort_array(F.concat("_base", "_terms"))).alias("spans"), "_base", "_terms")


def sanitise(docs: DataFrame, text: str = "text", disclose: float = 0.9, support: int = 3, by: str = "texts",
             everywhere: bool = False) -> DataFrame:
    """``find`` with the text itself cleaned: base spans as ``[KIND]``, disclosing terms removed, or as
    ``[NUMBER]`` or ``[WORD]`` where they are generalised."""
    found = find(docs, text, disclose, support, by=by, everywhere=everywhere)
    t = text_of(text)
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""))

    def label(x, n):
        word = F.substring(t, x["s"] + 1, n)
        broad = F.when(word.rlike("^[0-9]+$"), F.lit("[NUMBER]")).otherwise(F.lit("[WORD]"))
        return F.coalesce(F.when(x["k"] == 5, broad).otherwise(F.get(labels, x["k"])), F.lit(""))

    spans = F.sort_array(F.concat("_base", "_terms"))
    return found.withColumn(text, F.when(F.col(text).isNull(), F.col(text)).otherwise(_cut(t, spans, label))) \
        .drop("_base", "_terms")
