"""Quality rules from the frequency of lines across documents.

Lines are normalised (lower case, runs of blanks as one) and hashed, and the
distinct documents that hold a line are counted per host. Lines held by more than
``max_docs`` documents of their host are removed; a document that loses more
than it may is rejected, and so is one that fails the base rules.

*Distinct* documents: copies of a text count once, and a group of near copies
counts little, however large it is, so that it stays and is left to near-duplicate
removal. A text is taken for a near copy if its widespread lines are more than half of its
words and hold all but a seventh of its shingles of ``SHINGLE`` words, the other lines counted
by their shingles too (two texts that share six sevenths have a Jaccard similarity of 0.75).
Texts without new words of their own are told apart by the most widespread *other* line of
each of their lines (its companion). Every other text counts as itself, whatever lines it shares.

Nothing is gathered per key: lines are counted with map-side partial sums, joins are on
keys that the planner can split, and windows are over the widespread lines of one
distinct text.

Edge cases: a null or empty text has no words and fails the base rules; a null host is
a host of its own; repeated rows get the same verdict each; an empty table gives an
empty result. Input columns may have any name; ``judge`` replaces those named like a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from recordloom.llm.common import (
    SPACE_CHARS, let, md5_number, numbered, private, renamed, text_of, total, words_of,
)
from recordloom.session import cut_lineage

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
LEAST_WORDS = 20
REPEATED_PERCENT = 30
SHINGLE = 5
#: A near copy has one new shingle in so many at most.
NEW_IN = 7
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
RESULT = (*COUNTS, "n_removed_words", "kept", "_removed_lines")


def _repeated(words: Column) -> Column:
    """Words inside windows that occur twice or more."""
    size = F.size(words)

    def hashed(w):
        starts = F.sequence(F.lit(1), F.size(w) - (WINDOW_WORDS - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, WINDOW_WORDS)))

    def covered(starts):
        step = F.transform(starts, lambda x, k: F.least(
            F.lit(WINDOW_WORDS), F.coalesce(F.get(starts, k + 1) - x, F.lit(WINDOW_WORDS))).cast("long"))
        return total(step)

    def twice(sorted_):
        same = F.filter(sorted_, lambda e, k: (e["h"] == F.get(sorted_, k - 1)["h"])
                        | (e["h"] == F.get(sorted_, k + 1)["h"]))
        return let(F.sort_array(F.transform(same, lambda e: e["i"])), covered)

    def found(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, twice))

    return F.when(size <= WINDOW_WORDS, F.lit(0).cast("long")).otherwise(let(hashed(words), found))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``n_words``, the four base counts and ``base_failed``."""
    t = text_of(text)
    per_words = let(words_of(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), _repeated(w).alias("r")))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    chars = F.length(t)
    own, = private(docs.columns, "_w")
    return (
        docs.withColumn(own, per_words)
        .withColumns({
            "n_words": F.col(f"{own}.n"),
            "word_chars": F.length(F.translate(t, SPACE_CHARS, "")).cast("long"),
            "n_symbols": (chars - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": F.col(f"{own}.r"),
        })
        .drop(own)
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS)
                    | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")))
    )


def _normal_lines(t: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(t), r"[\x20\x09\x0B-\x0D]+", " "), " ?\n ?")


def _line_rows(docs: DataFrame, host: str, text: str) -> DataFrame:
    """One row per distinct text and distinct line: host, text key, line hash, words of all its occurrences and
    of the text."""
    t = text_of(text)

    def unique(sorted_):
        heads = F.filter(
            F.transform(sorted_, lambda e, k: F.struct(e["h"].alias("h"), e["n"].alias("n"), k.alias("k"))),
            lambda e, k: (k == 0) | (e["h"] != F.get(sorted_, k - 1)["h"]))
        words = total(F.transform(sorted_, lambda e: e["n"]))
        return let(F.struct(heads.alias("u"), words.alias("w")), lambda x: F.transform(x["u"], lambda e, j: F.struct(
            e["h"].alias("line"),
            (e["n"] * (F.coalesce(F.get(x["u"], j + 1)["k"], F.size(sorted_)) - e["k"])).alias("words"),
            x["w"].alias("total"))))

    hashed = F.transform(
        F.filter(_normal_lines(t), lambda x: F.length(F.trim(x)) > 0),
        lambda x: F.struct(md5_number(F.trim(x)).alias("h"),
                           F.size(F.split(F.trim(x), " ")).alias("n")))
    rows = docs.select(
        F.col(host).alias("_host"), F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit(1), t).alias("_k2"),
        F.explode(let(F.sort_array(hashed), unique)).alias("_line"))
    return rows.select("_host", "_k1", "_k2", F.col("_line.line").alias("_line"),
                       F.col("_line.words").cast("long").alias("_words"), F.col("_line.total").alias("_total")).distinct()


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def _near_copies(docs: DataFrame, wide: DataFrame, host: str, text: str) -> DataFrame:
    """Keys ``_nh, _n1, _n2`` of the texts with next to nothing but widespread lines or what such lines hold."""
    key = ("_host", "_k1", "_k2")
    t = text_of(text)
    mostly = cut_lineage(
        wide.groupBy(*key).agg(F.sum("_words").alias("_w"), F.max("_total").alias("_t"))
        .where(2 * F.col("_w") > F.col("_t")).select(*key))

    def shingled(line):
        return let(F.split(line, " "), lambda w: F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))),
            lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))))

    keyed = docs.select(F.col(host).alias("_host"), F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit(1), t).alias("_k2"),
                        t.alias("_t"))
    lines = keyed.join(mostly, _same(keyed, mostly, *key), "left_semi").select(
        *key, F.explode(_normal_lines(F.col("_t"))).alias("_l")).where(F.length(F.trim("_l")) > 0)
    lines = lines.select(*key, md5_number(F.trim("_l")).alias("_line"), shingled(F.trim("_l")).alias("_s")) \
        .dropDuplicates([*key, "_line"])
    w = wide.select(F.col("_host").alias("_wh"), F.col("_k1").alias("_w1"), F.col("_k2").alias("_w2"),
                    F.col("_line").alias("_wl"))
    lines = cut_lineage(lines.join(
        w, lines["_host"].eqNullSafe(w["_wh"]) & (lines["_k1"] == w["_w1"]) & (lines["_k2"] == w["_w2"])
        & (lines["_line"] == w["_wl"]), "left").select(*key, "_line", "_s", F.col("_wl").isNotNull().alias("_wide")))
    known = lines.where("_wide").select("_host", "_line", "_s").dropDuplicates(["_host", "_line"]) \
        .select(F.col("_host").alias("_sh"), F.explode("_s").alias("_ss")).distinct()
    own = lines.where("NOT _wide").select(*key, F.explode("_s").alias("_s"))
    new = own.join(known, own["_host"].eqNullSafe(known["_sh"]) & (own["_s"] == known["_ss"]), "left_anti") \
        .groupBy(*key).agg(F.count("*").alias("_new")).withColumnsRenamed({"_host": "_nh", "_k1": "_n1", "_k2": "_n2"})
    sizes = lines.groupBy(*key).agg(F.sum(F.size("_s")).alias("_all"))
    return sizes.join(new, sizes["_host"].eqNullSafe(new["_nh"]) & (sizes["_k1"] == new["_n1"])
                      & (sizes["_k2"] == new["_n2"]), "left") \
        .where(NEW_IN * F.coalesce("_new", F.lit(0)) <= F.col("_all")) \
        .select(F.col("_host").alias("_nh"), F.col("_k1").alias("_n1"), F.col("_k2").alias("_n2"))


def removals(docs: DataFrame, host: str = "source", text: str = "text", max_docs: int = 20) -> DataFrame:
    """Per host and text that loses lines: ``_host, _k1, _k2, _removed_words, _removed_lines`` (hashes)."""
    lines = cut_lineage(_line_rows(docs, host, text))
    often = (lines.groupBy("_host", "_line").agg(F.count("*").alias("_docs"))
             .where(F.col("_docs") > max_docs))
    o = often.select(F.col("_host").alias("_oh"), F.col("_line").alias("_ol"), "_docs")
    wide = cut_lineage(
        lines.join(o, lines["_host"].eqNullSafe(o["_oh"]) & (lines["_line"] == o["_ol"])).drop("_oh", "_ol"))
    text_key = ("_host", "_k1", "_k2")
    ranked = wide.withColumn("_rank", F.row_number().over(
        Window.partitionBy(*text_key).orderBy(F.desc("_docs"), "_line")))
    per_text = Window.partitionBy(*text_key)
    second = F.max(F.when(F.col("_rank") == 2, F.col("_line"))).over(per_text)
    first = F.max(F.when(F.col("_rank") == 1, F.col("_line"))).over(per_text)
    # no other widespread line: the text itself is the companion
    companion = F.when(F.col("_rank") == 1, F.coalesce(second, F.col("_k1"))).otherwise(first)
    ranked = ranked.select(*text_key, "_line", companion.alias("_with"))
    near = cut_lineage(_near_copies(docs, wide, host, text))
    counted = ranked.join(near, ranked["_host"].eqNullSafe(near["_nh"]) & (ranked["_k1"] == near["_n1"])
                          & (ranked["_k2"] == near["_n2"]), "left")
    spread = (
        counted.select("_host", "_line", F.when(F.col("_n1").isNotNull(), F.col("_with"))
                       .otherwise(F.col("_k1")).alias("_with")).distinct()
        .groupBy("_host", "_line").agg(F.count("*").alias("_n")).where(F.col("_n") > max_docs)
        .select(F.col("_host").alias("_sh"), F.col("_line").alias("_sl"))
    )
    gone = wide.join(spread, wide["_host"].eqNullSafe(spread["_sh"]) & (wide["_line"] == spread["_sl"]))
    return gone.groupBy(*text_key).agg(
        F.sum("_words").alias("_removed_words"), F.collect_set("_line").alias("_removed_lines"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", max_docs: int = 20,
          least_left_share: float = 0.5, columns: list[str] | None = None, with_lines: bool = False) -> DataFrame:
    """All documents with the base counts, ``n_removed_words`` and ``kept``.

    A document is depleted when fewer than 20 words, or less than
    ``least_left_share`` of its words, are left without the lines held by more than
    ``max_docs`` distinct documents of its host. ``columns``: the input columns to carry (all).
    ``with_lines`` adds ``_removed_lines``, the hashes for ``without_lines``.
    """
    judged, carried = _judged(docs, host, text, max_docs, least_left_share, columns)
    return judged.select(*renamed(carried), *COUNTS, "n_removed_words", "kept", *(["_removed_lines"] if with_lines else []))


def _judged(docs, host, text, max_docs, least_left_share, columns):
    """The verdicts next to the carried columns, which are numbered, and the names of these."""
    carried = [c for c in (docs.columns if columns is None else columns) if c not in RESULT]
    gone = removals(docs, host, text, max_docs).withColumnsRenamed({"_host": "_gh", "_k1": "_g1", "_k2": "_g2"})
    rows = docs.select(*numbered(carried), F.col(host).alias("_host"), F.col(text).alias("_text"))
    t = text_of("_text")
    base = base_rules(rows, "_text").select(
        *[f"c{k}" for k in range(len(carried))], *COUNTS, "_host",
        F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit(1), t).alias("_k2"))
    joined = base.join(gone, base["_host"].eqNullSafe(gone["_gh"]) & (base["_k1"] == gone["_g1"])
                       & (base["_k2"] == gone["_g2"]), "left")
    removed = F.coalesce("_removed_words", F.lit(0))
    left = F.col("n_words") - removed
    return joined.withColumns({
        "n_removed_words": removed,
        "kept": ~F.col("base_failed") & ((removed == 0) | (
            (left >= LEAST_WORDS) & (left >= least_left_share * F.col("n_words")))),
    }), carried


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines whose normal form has one of the hashes."""
    normal = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[\x20\x09\x0B-\x0D]+", " "))
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(hashes, md5_number(normal(x))))
    return F.when(hashes.isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n"))


def clean(docs: DataFrame, host: str = "source", text: str = "text", max_docs: int = 20,
          least_left_share: float = 0.5) -> DataFrame:
    """The documents that stay, without their removed lines; the columns of ``docs``."""
    columns = docs.columns
    at = {name: f"c{k}" for k, name in enumerate(columns)}
    # under other names, so that input columns named like a result come through as they are
    judged, _ = _judged(docs.select(*numbered(columns)), at[host], at[text], max_docs, least_left_share, None)
    return judged.where("kept").withColumn(at[text], without_lines(F.col(at[text]), F.col("_removed_lines"))) \
        .select(*renamed(columns))
