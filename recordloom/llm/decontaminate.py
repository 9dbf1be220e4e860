"""Find benchmark passages in training texts by spaced seeds, word substitutions allowed.

A seed is the hash of six words at the positions that a fixed mask names; the masks leave
different positions out, so a substituted word spoils some seeds and not others. The masks
are chosen such that every window of 13 words with at most two substitutions (of 8 to 12
words with one) holds a seed of at least one mask; ``tests/llm`` goes through all
cases. Equal seeds of a text and a benchmark item fix an alignment; along it the words are
compared, and the pair is reported if some window of 13 words (or the whole item, if
it has 8 to 12) agrees but for those substitutions. Items under 8 words have to occur word for word
as a whole: a text is also looked through for runs of as many words as such items have, if there are any.
``least_words`` leaves out items with fewer words, for benchmarks with one-word answers among their items.

A word is a run of letters and digits; of scripts that write without blanks each letter is a word.

Benchmarks are small, training texts are not: the text side streams its seeds against the
benchmark's, which are broadcast if their counted number is within ``MOST_SEEDS`` and
joined by a shuffle beyond it, with equal results. Alignments of copies of a text are
found once (a text is named by two longs), and only texts with hits are read again. All alignments of
a text and an item are checked in one row, so a long text that repeats a passage is read once for it.

Edge cases: a null or empty text has no words and matches nothing, as does a benchmark item
without words or null; an item whose text occurs twice is reported under each of its ids; rows with
equal ids are reported once; an empty side gives an empty result. Only the named columns are used,
so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from recordloom.llm.common import let, text_of
from recordloom.session import cut_lineage

# Which of the following words a seed looks at.
MASKS = ("111111", "11101011", "11010111")
WINDOW = 13
LEAST_WORDS = 8
# Scripts that write without blanks.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")
#: Broadcast bound, about 64 MB in memory.
MOST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case; single letters of scripts without blanks."""
    letter = "([" + "".join(rf"\p{{Is{script}}}" for script in UNSPACED) + "])"
    # all of those scripts lie above U+0E00, and one range is looked for much faster than their names
    spaced = F.when(F.rlike(text, F.lit(r"[\x{0E00}-\x{10FFFF}]")), F.regexp_replace(F.lower(text), letter, " $1 ")) \
        .otherwise(F.lower(text))
    return F.array_remove(F.split(spaced, r"[^\p{L}\p{N}]+"), "")


def allowed(window: int) -> int:
    """Substitutions allowed in a window of so many words."""
    return 2 if window >= WINDOW else 1 if window >= LEAST_WORDS else 0


def _parts(mask: str) -> list[tuple[int, int]]:
    """The mask as ``(position, length)`` of runs of three and single words."""
    parts, p = [], 0
    while p < len(mask):
        n = 3 if mask[p:p + 3] == "111" else 1
        if mask[p] == "1":
            parts.append((p, n))
        p += n
    return parts


def _seeds(words: Column, masks: tuple[str, ...] = MASKS, least: int = LEAST_WORDS) -> Column:
    """Seeds of all masks at each word in turn: number ``k`` belongs to word ``k // len(masks)``.

    Runs of three words are hashed once for all masks. A mask that reaches past the end gives null, and
    fewer than ``least`` words give none.
    """
    none = F.array().cast("array<long>")

    def of(words_, threes):
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(words_) - 1), lambda i: F.array(*[
            F.when(i + len(mask) <= F.size(words_),
                   F.xxhash64(*[F.get(threes if n == 3 else words_, i + p) for p, n in _parts(mask)]))
            for mask in masks])))

    def hashed(h):
        threes = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
        return F.when(F.size(h) < least, none).otherwise(let(threes, lambda t: of(h, t)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), hashed)


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
             item_id: str = "item_id", item_text: str = "text", least_words: int = 1) -> DataFrame:
    """One row per distinct text and item that overlap: ``_k1, _k2``, the item's id, ``n_item_words``,
    ``n_matched`` (equal words along the best alignment), ``n_window`` (in its best window) and
    ``start`` (the text's word under the item's first, may be negative)."""
    items = cut_lineage(
        benchmark.select(F.col(item_id).alias("_item"), tokens(text_of(item_text)).alias("_iw"))
        .where(F.size("_iw") >= max(least_words, 1)).distinct())
    # equal item texts share their seeds and alignments
    distinct_items = cut_lineage(items.select("_iw").distinct().select(
        F.xxhash64("_iw").alias("_ik"), "_iw"))
    # at most LEAST_WORDS - 1 lengths
    short = sorted(r["n"] for r in distinct_items.select(F.size("_iw").alias("n"))
                   .where(F.col("n") < LEAST_WORDS).distinct().collect())

    def seeded(rows, masks, least):
        return rows.select("_ik", F.posexplode(_seeds(F.col("_iw"), masks, least)).alias("_k", "_seed")).select(
            "_ik", "_seed", F.floor(F.col("_k") / len(masks)).alias("_ipos")).where("_seed IS NOT NULL")

    seeds = seeded(distinct_items, MASKS, LEAST_WORDS)
    for n in short:
        seeds = seeds.union(seeded(distinct_items.where(F.size("_iw") == n), ("1" * n,), n))
    seeds = cut_lineage(seeds)
    if seeds.count() <= MOST_SEEDS:
        seeds = F.broadcast(seeds)
    masks = MASKS + tuple("1" * n for n in short if "1" * n not in MASKS)
    t = text_of(text)
    key = [F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit(1), t).alias("_k2")]
    found = docs.select(*key, F.posexplode(
        _seeds(tokens(t), masks, min(short + [LEAST_WORDS]))).alias("_k", "_seed"))
    shift = (F.floor(F.col("_k") / len(masks)) - F.col("_ipos")).cast("int")
    hits = cut_lineage(found.join(seeds, "_seed").groupBy("_k1", "_k2", "_ik").agg(
        F.collect_set(shift).alias("_shifts")))
    keys = hits.select("_k1", "_k2").distinct()
    texts = docs.select(*key, t.alias("_t")).join(keys, ["_k1", "_k2"], "left_semi") \
        .dropDuplicates(["_k1", "_k2"]).select("_k1", "_k2", tokens(F.col("_t")).alias("_w"))
    aligned = hits.join(distinct_items, "_ik").join(texts, ["_k1", "_k2"])
    n = F.size("_iw")
    width = F.least(n, F.lit(WINDOW))

    def judged(w, at):
        same = F.transform(F.col("_iw"), lambda word, j: F.coalesce(
            F.when(at + j >= 0, (F.get(w, at + j) == word).cast("int")), F.lit(0)))
        return let(same, lambda m: F.struct(
            F.array_max(F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.aggregate(
                F.slice(m, i, width), F.lit(0), lambda a, x: a + x))).alias("window"),
            F.aggregate(m, F.lit(0), lambda a, x: a + x).alias("all"), (-at).alias("back")))

    # the best window decides, then the most equal words, then the first place
    best = let(F.col("_w"), lambda w: F.array_max(F.transform("_shifts", lambda at: judged(w, at))))
    spared = F.when(width >= WINDOW, allowed(WINDOW)).when(width >= LEAST_WORDS, allowed(LEAST_WORDS)).otherwise(0)
    one = aligned.select("_k1", "_k2", "_iw", n.alias("_n"), (width - spared).alias("_due"), best.alias("_b")) \
        .where(F.col("_b.window") >= F.col("_due"))
    return one.join(items, "_iw").select(
        "_k1", "_k2", F.col("_item").alias(item_id), F.col("_n").cast("long").alias("n_item_words"),
        F.col("_b.all").cast("long").alias("n_matched"), F.col("_b.window").cast("long").alias("n_window"),
        (-F.col("_b.back")).cast("long").alias("start"))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", least_words: int = 1) -> DataFrame:
    """One row per document and benchmark item that overlap."""
    found = cut_lineage(overlaps(docs, benchmark, doc_id, text, item_id, item_text, least_words))
    t = text_of(text)
    ids = docs.select(F.col(doc_id), F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit(1), t).alias("_k2"))
    return ids.join(found, ["_k1", "_k2"]).drop("_k1", "_k2").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents without any overlap; the columns of ``docs``."""
    text = names.get("text", "text")
    found = cut_lineage(overlaps(docs, benchmark, **names).select(F.col("_k1").alias("_f1"), F.col("_k2").alias("_f2")).distinct())
    t = text_of(docs[text])
    # no column is added, so input columns may have any name
    return docs.join(found, (F.xxhash64(t) == found["_f1"]) & (F.xxhash64(F.lit(1), t) == found["_f2"]), "left_anti")
