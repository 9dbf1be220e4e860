"""Join of texts by the Jaccard similarity of their word shingles, with several global orders.

Two sets of sizes ``x`` and ``y`` reach the similarity only if they miss few of each
other's members, so in *any* order of all shingles their first common one comes early: within
the first ``n - ceil(t n) + 1`` of each (the prefix), and with no more than ``(x + y)(1 - t)/(1 + t)``
others before it in both together. Candidates must pass this in three orders:

1. rare first: shingles by document frequency, then hash. Frequencies are counted exactly
   over all texts (by 32 bits of the hash); the ``ORDER_SIZE`` most frequent shingles are broadcast
   with their counts and come last, all others count as rare. This order makes the pairs.
2. and 3. ascending and descending hash. They look at other members of the sets, and
   what they do not confirm is dropped before verification.

All are lossless, as is a bound from 512 parity bits per set. Pairs are cut down by the first order, then by the bits, then by
the prefixes of the other two orders; full sets are fetched and verified only for what is left.
Shingles that one text alone holds link nothing: a broadcast map of fixed size, filled by the same counts, keeps most of
them out of the prefixes that are dealt out, and never one that is shared.

Copies, and near copies in one component, do not meet in pairs. Texts with equal sets are one
*name*. Each prefix shingle first links its names to one centre only; components of those links are
found, and only shingles that join different components are looked at again, where every name outside
the main component meets every name of another component. No link between components is lost, and a
group of copies of any size costs its size.

Shuffles carry hashes, not texts. Shingles outside the broadcast table have few texts
each, those in it are counted with partial sums and joined on keys that the planner can split.
The broadcast table has at most ``ORDER_SIZE`` rows of 8 bytes.

Edge cases: a null or empty text has no shingles, links with nothing and is its own component; a text
of fewer words than a shingle is one shingle; repeated rows are copies; the id of a component is its
least document id (null if all are null); an empty table gives an empty result. Only the id and text columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from recordloom.llm import shingles
from recordloom.llm.common import keyed_by_text, private, text_of
from recordloom.session import cut_lineage, discard

#: Most shingles in the broadcast order; 8 MB.
ORDER_SIZE = 1 << 20
#: A shingle in fewer texts than this is rare, whatever its count.
FREQUENT = 8
#: Texts with candidates whose ids are broadcast to fetch them, at most; 32 MB.
MOST_IDS = 1_000_000
#: Shingles that a task gathers before it counts them.
FLUSH = 1 << 21
#: Leading bits of the hashes in the broadcast map of those that several texts hold; 16 MB.
SHARED_BITS = 27


def _counted(width: int, parts: int):
    """Arrow batches of texts -> per range of the 32-bit hash the hashes seen once and more often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            part = (values.astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            ids, once, more, times = [], [], [], []
            for p in np.flatnonzero(np.diff(cuts)):
                v, c = values[cuts[p]:cuts[p + 1]], counts[cuts[p]:cuts[p + 1]]
                ids.append(int(p))
                once.append(v[c == 1].tobytes())
                more.append(v[c > 1].tobytes())
                times.append(c[c > 1].astype(np.uint32).tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int32()), *(pa.array(x, pa.binary()) for x in (once, more, times))],
                ["part", "once", "more", "times"])

        for batch in batches:
            for grams in shingles.of_texts(batch.column(0), width):
                held.append((grams >> np.uint64(32)).astype(np.uint32))
                n += len(grams)
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()
    return run


def _summed(least: int, parts: int):
    """All blocks of one range -> the hashes with a count of at least ``least``, and in a row of its own (without hash) where the range
    begins in the map of shared hashes and its bits."""
    def run(table: pa.Table) -> pa.Table:
        values, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for once, more, times in zip(*(table.column(c).to_pylist() for c in ("once", "more", "times"))):
            values += [np.frombuffer(once, np.uint32), np.frombuffer(more, np.uint32)]
            counts += [np.ones(len(once) // 4, np.int64), np.frombuffer(times, np.uint32).astype(np.int64)]
        value, count = np.concatenate(values), np.concatenate(counts)
        order = np.argsort(value, kind="stable")
        value, count = value[order], count[order]
        heads = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
        sums = np.add.reduceat(count, heads) if len(heads) else np.zeros(0, np.int64)
        keep = sums >= least
        frequent = value[heads][keep].astype(np.int64)
        shared = (value[heads][sums > 1] >> np.uint32(32 - SHARED_BITS)).astype(np.int64)
        part = table.column("part")[0].as_py()
        # from the first byte of the map that the range touches; neighbours may share one
        low, high = (-(-k * (1 << 32) // parts) >> (32 - SHARED_BITS + 3) for k in (part, part + 1))
        bits = np.zeros(8 * (high - low + 1), np.uint8)
        bits[shared - 8 * low] = 1
        return pa.table({
            "hash": pa.array([*frequent.tolist(), None], pa.int64()), "texts": pa.array([*sums[keep].tolist(), low], pa.int64()),
            "shared": pa.array([None] * len(frequent) + [np.packbits(bits).tobytes()], pa.binary())})
    return run


def frequent_shingles(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent shingles: 32-bit hashes in order, and their counts; and a map of the leading bits of all hashes that several
    texts hold."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = cut_lineage(
        docs.select(text_of(text).alias("t"))
        .mapInArrow(_counted(width, parts), "part int, once binary, more binary, times binary")
        .groupBy("part").applyInArrow(_summed(FREQUENT, parts), "hash long, texts long, shared binary"))
    shared = np.zeros((1 << SHARED_BITS - 3) + 1, np.uint8)
    for row in counts.where("hash IS NULL").select("texts", "shared").toLocalIterator():
        piece = np.frombuffer(row.shared, np.uint8)[:len(shared) - row.texts]
        shared[row.texts:row.texts + len(piece)] |= piece
    counts = counts.where("hash IS NOT NULL")
    # counts in classes of an eighth of a power of two: a table of a few hundred rows
    kind = F.floor(F.log2("texts") * 8)
    classes = counts.groupBy(kind.alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect()
    total, least = 0, None
    for row in classes:
        total += row.n
        if total > ORDER_SIZE:
            break
        least = row.k
    if least is None:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), shared
    top = counts.where(kind >= least).toPandas().sort_values("hash")
    return top["hash"].to_numpy().astype(np.uint32), top["texts"].to_numpy().astype(np.int64), shared


def _is_shared(top: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Whether the map has these 32-bit hashes; it has all that several texts hold."""
    at = top >> np.uint32(32 - SHARED_BITS)
    return (shared[at >> np.uint32(3)] >> (np.uint32(7) - (at & np.uint32(7))).astype(np.uint8)) & np.uint8(1) == 1


def _prefix_size(n: int, t: Fraction) -> int:
    return n - -(-t.numerator * n // t.denominator) + 1 if n else 0


def _described(width: int, t: Fraction, order):
    """Arrow batches (id, text, text key) -> per text its set's name, size, parity bits and prefix in the first order.

    Of the rare part of the prefix only shingles stay that another text may hold, with their places.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, shared = order.value
        for batch in batches:
            names, sizes, bits, rare, places, often, n_rare = [], [], [], [], [], [], []
            for grams in shingles.of_texts(batch.column(1), width):
                n = len(grams)
                sizes.append(n)
                names.append(shingles.name_of(grams) if n else None)
                bits.append(shingles.parity_bits(grams) if n else None)
                p = _prefix_size(n, t)
                top = (grams >> np.uint64(32)).astype(np.uint32)
                where = np.searchsorted(hashes, top) if len(hashes) else np.zeros(n, np.int64)
                known = hashes[np.minimum(where, len(hashes) - 1)] == top if len(hashes) else np.zeros(n, bool)
                few = grams[~known]
                n_rare.append(len(few))
                place = np.flatnonzero(_is_shared(top[~known][:p], shared))
                rare.append(few[place].view(np.int64))
                places.append(place.astype(np.int32))
                if p > len(few):
                    many = grams[known]
                    many = many[np.lexsort((many, counts[where[known]]))]
                    often.append(many[:p - len(few)].view(np.int64))
                else:
                    often.append(few[:0].view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(names, pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(bits, longs), pa.array(rare, longs),
                 pa.array(places, pa.list_(pa.int32())), pa.array(often, longs), pa.array(n_rare, pa.int64())],
                ["id", "k1", "k2", "name", "n", "bits", "rare", "places", "often", "n_rare"])
    return run


def _sets(width: int, of):
    """Arrow batches (name, text) -> lists that ``of`` takes from the text's sorted shingles, where they are the set of that name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lists = [], []
            for wanted, grams in zip(batch.column(0).to_pylist(), shingles.of_texts(batch.column(1), width)):
                if len(grams) and shingles.name_of(grams) == wanted:
                    names.append(wanted)
                    lists.append(of(grams))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), *(pa.array(x, pa.list_(pa.from_numpy_dtype(x[0].dtype) if x else pa.int64()))
                                                for x in (zip(*lists) if lists else ((), ())))], ["name", "x", "y"])
    return run


def _halves(t: Fraction):
    """The prefixes in ascending and in descending order of the hash, by 32 bits."""
    def of(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = _prefix_size(len(grams), t)
        top = (grams >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return top[:p], top[-p:]
    return of


def _may_link(n1: Column, n2: Column, at1: Column, at2: Column, t: Fraction) -> Column:
    """Sizes that can reach ``t``, and few enough shingles before a first common one."""
    num, den = t.numerator, t.denominator
    return ((den * F.least(n1, n2) >= num * F.greatest(n1, n2))
            & ((at1 + at2) * (num + den) <= (n1 + n2) * (den - num)))


def _buckets(described: DataFrame) -> DataFrame:
    """Prefix shingles that several names share: ``token, name, at, n``."""
    one = described.where(F.col("n") > 0)
    rare = one.select("name", "n", F.inline(F.arrays_zip(F.col("places").alias("at"), F.col("rare").alias("token"))))
    whole = Window.partitionBy("token")
    # in the texts of a rare shingle, as many at most as its count
    shared = (
        rare.withColumns({"_a": F.min("name").over(whole), "_b": F.max("name").over(whole)})
        .where(F.col("_a") != F.col("_b")).select("token", "name", F.col("at").cast("long").alias("at"), "n")
    ).dropDuplicates(["token", "name"])
    often = cut_lineage(
        one.where(F.size("often") > 0)
        .select("name", "n", "n_rare", F.posexplode("often").alias("at", "token"))
        .select("token", "name", (F.col("n_rare") + F.col("at")).alias("at"), "n").distinct())
    several = often.groupBy("token").agg(F.min("name").alias("_a"), F.max("name").alias("_b")) \
        .where(F.col("_a") != F.col("_b")).select("token")
    return cut_lineage(shared.unionByName(often.join(several, "token", "left_semi")))


def components(links: DataFrame) -> DataFrame:
    """``name, label``: for each name in ``links`` (``a, b``) the least name it is connected with.

    Every round takes the least label among the neighbours, then the label of the
    label, so a chain is halved each time.
    """
    edges = cut_lineage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = cut_lineage(edges.groupBy(F.col("a").alias("name")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        told = edges.join(labels.withColumnRenamed("name", "b"), "b") \
            .groupBy(F.col("a").alias("name")).agg(F.min("label").alias("near"))
        nearer = cut_lineage(labels.join(told, "name", "left").select(
            "name", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = nearer.select(F.col("name").alias("label"), F.col("label").alias("far"))
        after = cut_lineage(nearer.join(jump, "label", "left").select(
            "name", "old", F.least("label", "far").alias("label")))
        labels = after.select("name", "label")
        if after.where(F.col("label") != F.col("old")).isEmpty():
            return labels


def _is_row(doc_id: str | Column, of: DataFrame, k1: str = "_k1", k2: str = "_k2") -> Column:
    """The row of that id and text key. An id alone may be null or stand for several texts."""
    own = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return own.eqNullSafe(of["id"]) & (F.col(k1) == of["k1"]) & (F.col(k2) == of["k2"])


def _like_bits(x: str, y: str, n1: Column, n2: Column, t: Fraction) -> Column:
    """Whether parity bits differ in few enough places: sets differ in as many shingles at least."""
    differ = sum((F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(1, 8)),
                 F.bit_count(F.get(x, F.lit(0)).bitwiseXOR(F.get(y, F.lit(0)))))
    return differ * (t.numerator + t.denominator) <= (n1 + n2) * (t.denominator - t.numerator)


def _one_per_name(described: DataFrame) -> DataFrame:
    """``name, id, k1, k2, again, n, bits``: the least id and text of each set, and whether several rows have both. Copies are counted
    by row and text first, so that a set of many copies is no hot key."""
    bits = described.where(F.col("n") > 0).groupBy("name", "id", "k1", "k2", "n").agg(
        F.count("*").alias("rows"), F.first("bits").alias("bits"))
    return cut_lineage(
        bits.groupBy("name", "n").agg(F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2", "rows")).alias("f"), F.first("bits").alias("bits"))
        .select("name", "f.id", "f.k1", "f.k2", (F.col("f.rows") > 1).alias("again"), "n", "bits"))


def _fetched(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, doc_id: str, text: str, width: int, of, kind: str) -> DataFrame:
    """``name, x, y`` for the names in the pairs: what ``of`` takes from their shingles."""
    wanted = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    ids = cut_lineage(firsts.drop("n", "bits").join(wanted, "name", "left_semi"))
    many = not ids.where("again").isEmpty()
    if ids.count() <= MOST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(doc_id).alias("_id"), text_of(text).alias("_t"), *keyed_by_text(docs, text))

    def taken(ids):
        return rows.join(ids, _is_row("_id", ids)).select("name", "_t").mapInArrow(
            _sets(width, of), f"name long, x array<{kind}>, y array<{kind}>")

    # lists are large: only where rows repeat are they dealt out to make them single
    sets = taken(ids.where("NOT again"))
    if many:
        sets = sets.unionByName(taken(ids.where("again")).dropDuplicates(["name"]))
    return cut_lineage(sets)


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, doc_id: str, text: str,
              width: int, t: Fraction) -> DataFrame:
    """The pairs ``a, b`` of the first order that pass the parity bits, then the other two orders on their prefixes alone, and
    reach the similarity. Full sets are fetched for what is left after that."""
    def side(table, name, *columns):
        return table.select(F.col("name").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    alike = cut_lineage(
        pairs.join(side(firsts, "a", "n", "bits"), "a").join(side(firsts, "b", "n", "bits"), "b")
        .where(_like_bits("a_bits", "b_bits", F.col("a_n"), F.col("b_n"), t)).select("a", "b"))
    ends = _fetched(alike, docs, firsts, doc_id, text, width, _halves(t), "int")
    near = cut_lineage(
        alike.join(side(ends, "a", "x", "y"), "a").join(side(ends, "b", "x", "y"), "b")
        .where(F.arrays_overlap("a_x", "b_x") & F.arrays_overlap("a_y", "b_y")).select("a", "b"))
    discard(ends)
    sets = _fetched(near, docs, firsts, doc_id, text, width, lambda grams: (np.sort(grams.view(np.int64)), grams[:0].view(np.int64)), "bigint")
    both = near.join(side(sets, "a", "x"), "a").join(side(sets, "b", "x"), "b")
    num, den = t.numerator, t.denominator
    common = F.size(F.array_intersect("a_x", "b_x")).cast("long")
    links = cut_lineage(
        both.where(common * (num + den) >= num * (F.size("a_x") + F.size("b_x")).cast("long")).select("a", "b"))
    for used in (alike, near, sets):
        discard(used)
    return links


def links_and_names(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                    similarity: str = "0.75") -> tuple[DataFrame, DataFrame]:
    """``described`` texts (``id, k1, k2, name, n``; two longs name the text itself) and the ``links`` (``a, b``) that hold the components together."""
    t = Fraction(similarity)
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(frequent_shingles(docs, text, width))
    kind = dict(docs.select(F.col(doc_id).alias("id")).dtypes)["id"]
    described = cut_lineage(
        docs.select(F.col(doc_id).alias("id"), text_of(text).alias("t"), *keyed_by_text(docs, text))
        .mapInArrow(_described(width, t, order), f"id {kind}, k1 long, k2 long, name long, n long, bits array<long>, rare array<long>, "
                                                 "places array<int>, often array<long>, n_rare long"))
    buckets = _buckets(described)
    centres = cut_lineage(
        buckets.groupBy("token").agg(F.min(F.struct("at", "name", "n")).alias("c"))
        .select("token", F.col("c.at").alias("c_at"), F.col("c.name").alias("c"), F.col("c.n").alias("c_n")))
    to_centre = (
        buckets.join(centres, "token").where(F.col("name") != F.col("c"))
        .where(_may_link(F.col("n"), F.col("c_n"), F.col("at"), F.col("c_at"), t))
        .select(F.least("name", "c").alias("a"), F.greatest("name", "c").alias("b")).distinct()
    )
    firsts = _one_per_name(described)
    first = _verified(to_centre, docs, firsts, doc_id, text, width, t)
    labels = components(first)
    labelled = cut_lineage(
        buckets.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name")))
    mixed = cut_lineage(
        labelled.groupBy("token").agg(F.min("label").alias("main"), F.max("label").alias("_b"))
        .where(F.col("main") != F.col("_b")).select("token", "main"))
    open_ = cut_lineage(labelled.join(mixed, "token").join(firsts.select("name", "bits"), "name"))
    x = open_.where(F.col("label") != F.col("main")).select(
        "token", *[F.col(c).alias(f"x_{c}") for c in ("name", "at", "n", "label", "bits")])
    y = open_.select("token", *[F.col(c).alias(f"y_{c}") for c in ("name", "at", "n", "label", "bits", "main")])
    rest = x.join(y, (x["token"] == y["token"]) & (F.col("x_label") != F.col("y_label"))
                  & ((F.col("y_label") == F.col("y_main")) | (F.col("x_name") < F.col("y_name")))
                  & _may_link(F.col("x_n"), F.col("y_n"), F.col("x_at"), F.col("y_at"), t)
                  & _like_bits("x_bits", "y_bits", F.col("x_n"), F.col("y_n"), t))
    rest = rest.select(F.least("x_name", "y_name").alias("a"), F.greatest("x_name", "y_name").alias("b")).distinct()
    second = _verified(rest.join(first, ["a", "b"], "left_anti"), docs, firsts, doc_id, text, width, t)
    links = cut_lineage(first.unionByName(second))
    names = cut_lineage(described.select("id", "k1", "k2", "name", "n"))
    for used in (described, buckets, centres, labelled, mixed, open_, firsts):
        discard(used)
    return names, links


def _labelled(docs: DataFrame, doc_id: str, text: str, width: int, similarity: str) -> tuple[DataFrame, DataFrame]:
    """The described texts, and those with words (``id, k1, k2, name, n``) under their component's ``label``."""
    described, links = links_and_names(docs, doc_id, text, width, similarity)
    labels = components(links)
    return described, cut_lineage(
        described.where(F.col("n") > 0).join(labels, "name", "left")
        .select("id", "k1", "k2", "name", "n", F.coalesce("label", "name").alias("label")))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
            similarity: str = "0.75") -> DataFrame:
    """One row per document: its id, ``n_shingles`` and ``component_id``."""
    described, full = _labelled(docs, doc_id, text, width, similarity)
    least = cut_lineage(full.groupBy("label").agg(F.min("id").alias("component_id")))
    none = described.where(F.col("n") == 0).select("id", "n", F.col("id").alias("component_id"))
    return full.join(least, "label").select("id", "n", "component_id").unionByName(none).select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                similarity: str = "0.75") -> DataFrame:
    """One row of each component: the first by id (null last), name and text; texts without words all stay. The
    columns of ``docs``."""
    _, full = _labelled(docs, doc_id, text, width, similarity)
    # rows of one id and text are copies; of them any one stays
    kept = cut_lineage(
        full.groupBy("label", "id", "name", "k1", "k2").agg(F.count("*").alias("rows"))
        .groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "name", "k1", "k2", "rows")).alias("f"))
        .select("f.id", "f.k1", "f.k2", (F.col("f.rows") > 1).alias("again")))
    t = text_of(text)
    empty = F.length(F.translate(t, " \t\n\x0b\x0c\r", "")) == 0
    key = keyed_by_text(docs, text)
    k1, k2 = private(docs.columns, "_k1", "_k2")
    rows = docs.where(~empty).withColumns({k1: key[0], k2: key[1]})

    def those(of):
        return rows.join(of, _is_row(rows[doc_id], of, k1, k2), "left_semi")

    firsts = those(kept.where("NOT again"))
    if not kept.where("again").isEmpty():
        firsts = firsts.unionByName(those(kept.where("again")).dropDuplicates([doc_id, k1, k2]))
    return firsts.drop(k1, k2).unionByName(docs.where(empty)).select(*docs.columns)
