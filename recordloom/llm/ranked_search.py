"""Ranked lexical search, reversed: the items stay, the documents stream past.

The terms of all items form an inverted index (term -> items with repeats), which is broadcast.
Documents are read twice and never shuffled: once for the number of documents and terms and the
document frequencies of the indexed terms, once for the scores. In the second pass a task looks up each
document's term counts in the index, adds up the scores of the items it meets, and keeps the ``k`` best documents
of every item in a bounded heap. The heaps of all tasks, ``k`` entries at most each, are merged in two rounds.

The index is bounded: item rows are dealt into blocks by their hash so that a block holds ``MOST_POSTINGS`` (item, term)
pairs on average at most; each block is streamed on its own, with equal results. Any number of items works,
at the price of a pass over the documents for each block.

Scores are 64-bit integers: with ``N`` documents that have a term, ``L`` terms with repeats, ``df`` documents with the
term, ``tf`` occurrences of it and ``n`` terms in the document, a term weighs
``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``, and the score adds
``w * ((10^9 * tf) div (1000 * tf + 12 * m))`` with ``m = 75 + (25 * n * N) div L`` for each of the item's terms, repeats included.

A term is a longest run of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. Both texts are
read whole.

Edge cases: a null or empty text has no terms; a document without terms counts in none of the sums; an item without terms
or without a document above 0 gives no row; repeated document rows are documents of their own; equal scores go by ascending
id, null last; item rows that repeat an id are one item per distinct text, each ranked on its own; empty tables give an empty result. Only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from recordloom.llm.common import text_of
from recordloom.session import cut_lineage

#: (item, term) pairs in one broadcast index; some 100 bytes each.
MOST_POSTINGS = 500_000
#: Heaps of this many tasks meet in the first round of the merge.
FAN_IN = 512
#: Additions that are held at once.
FLUSH = 1 << 20

#: Bytes that are no part of a term become blanks, A-Z become a-z; all bytes of characters beyond ASCII are part of one.
_AS_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_AS_TERMS).split() if text else []


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items (number, text) -> their terms and how often each occurs."""
    for batch in batches:
        items, terms, times = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = Counter(terms_of(text))
            items += [item] * len(found)
            terms += found.keys()
            times += found.values()
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(terms, pa.binary()), pa.array(times, pa.int64())],
            ["item", "term", "times"])


def _frequencies(known):
    """Documents -> one row per indexed term met in the task with its documents, and a row without term for all
    documents with terms and the number of their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        met = np.zeros(len(numbers), np.int64)
        documents = length = 0
        for batch in batches:
            for text in batch.column(0):
                words = terms_of(text.as_py())
                documents += bool(words)
                length += len(words)
                met[[numbers[w] for w in set(words) if w in numbers]] += 1
        some = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *some.tolist()], pa.int64()), pa.array([documents, *met[some].tolist()], pa.int64()),
             pa.array([length] + [0] * len(some), pa.int64())], ["term", "documents", "length"])
    return run


class _Index:
    """Postings of a block: for each term its number, its weight and the items that hold it."""

    def __init__(self, numbers: dict, weights: np.ndarray, starts: np.ndarray, items: np.ndarray, times: np.ndarray,
                 names: list, documents: int, length: int):
        self.numbers, self.weights, self.starts, self.items, self.times = numbers, weights, starts, items, times
        self.names, self.documents, self.length = names, documents, length

    def matches(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The indexed terms among the words and what each adds for one occurrence in an item."""
        numbers = self.numbers
        held = np.array([numbers[w] for w in words if w in numbers], np.int64)
        terms, tf = np.unique(held, return_counts=True)
        m = 75 + 25 * len(words) * self.documents // self.length
        return terms, self.weights[terms] * (10 ** 9 * tf // (1000 * tf + 12 * m))


def _ranked(shared, k: int):
    """Documents (id, text) -> the heap of each item that met one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        sizes = np.diff(index.starts)
        n_items = len(index.names)
        heaps = [[] for _ in range(n_items)]
        # what the worst of a full heap has; a lower score cannot enter
        bars = np.ones(n_items, np.int64)
        kind = None

        def flush(held):
            """Score the held documents (id, terms, additions) against all items and offer them to the heaps."""
            rows = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
            terms = np.concatenate([h[1] for h in held])
            adds = np.concatenate([h[2] for h in held])
            n = sizes[terms]
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(index.starts[terms], n)
            scores = np.zeros((len(held), n_items), np.int64)
            np.add.at(scores, (np.repeat(rows, n), index.items[at]), np.repeat(adds, n) * index.times[at])
            row, item = np.nonzero(scores >= bars)
            offers = {}
            for r, i, s in zip(row.tolist(), item.tolist(), scores[row, item].tolist()):
                name = held[r][0]
                offers.setdefault(i, []).append((-s, name is None, 0 if name is None else name))
            for i, offered in offers.items():
                heaps[i] = heapq.nsmallest(k, heaps[i] + offered)
                if len(heaps[i]) == k:
                    bars[i] = -heaps[i][-1][0]

        held, waiting = [], 0
        most = max(1, FLUSH // max(1, n_items))
        for batch in batches:
            kind = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                terms, adds = index.matches(words)
                if len(terms):
                    held.append((name, terms, adds))
                    waiting += int(sizes[terms].sum())
                if waiting >= FLUSH or len(held) >= most:
                    flush(held)
                    held, waiting = [], 0
        if held:
            flush(held)
        if kind is None:
            return
        full = [i for i in range(n_items) if heaps[i]]
        entry = pa.struct([("loss", pa.int64()), ("nameless", pa.bool_()), ("doc", kind)])
        yield pa.RecordBatch.from_arrays(
            [pa.array([index.names[i] for i in full], pa.int64()),
             pa.array([TaskContext.get().partitionId() % FAN_IN] * len(full), pa.int32()),
             pa.array([[{"loss": a, "nameless": b, "doc": None if b else c} for a, b, c in heaps[i]] for i in full],
                      pa.list_(entry))], ["item", "part", "heap"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", most_postings: int = MOST_POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("t"))
    id_type = dict(rows.dtypes)["id"]
    # a stored number per distinct (id, text), which stays the same when a task is run again
    asked = cut_lineage(
        items.select(F.col(item_id).alias("id"), text_of(item_text).alias("t")).distinct()
        .select(F.monotonically_increasing_id().alias("item"), "id", "t"))
    postings = cut_lineage(
        asked.select("item", "t").mapInArrow(_item_terms, "item long, term binary, times long"))
    blocks = -(-postings.count() // most_postings)
    found = None
    for b in range(blocks):
        block = postings.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        heaps = _searched(rows, block.toPandas(), k, id_type)
        found = heaps if found is None else found.unionByName(heaps)
    ranked = f"item long, heap array<struct<loss:bigint,nameless:boolean,doc:{id_type}>>"
    if found is None:
        found = spark.createDataFrame([], ranked)
    best = found.select("item", F.posexplode("heap").alias("at", "x"))
    return asked.join(best, "item").select(
        F.col("id").alias(item_id), (F.col("at") + 1).cast("int").alias("rank"),
        F.col("x.doc").alias(doc_id), (-F.col("x.loss")).alias("score"))


def _searched(rows: DataFrame, postings, k: int, id_type: str) -> DataFrame:
    """``item, heap`` for the items of one bounded block of postings."""
    context = rows.sparkSession.sparkContext
    terms, number = np.unique(postings["term"].to_numpy(dtype=object), return_inverse=True)
    numbers = {bytes(t): i for i, t in enumerate(terms)}
    counts = cut_lineage(
        rows.select("t").mapInArrow(_frequencies(context.broadcast(numbers)), "term long, documents long, length long")
        .groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("length").alias("length"))).toPandas()
    whole = counts["term"].isna()
    documents, length = int(counts["documents"][whole].sum()), int(counts["length"][whole].sum())
    met = np.zeros(len(terms), np.int64)
    met[counts["term"][~whole].to_numpy(np.int64)] = counts["documents"][~whole].to_numpy(np.int64)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in met.tolist()], np.int64)
    names, item = np.unique(postings["item"].to_numpy(np.int64), return_inverse=True)
    order = np.argsort(number, kind="stable")
    index = _Index(numbers, weights, np.searchsorted(number[order], np.arange(len(terms) + 1)), item[order],
                   postings["times"].to_numpy(np.int64)[order], names.tolist(), documents, length)
    heap = f"array<struct<loss:bigint,nameless:boolean,doc:{id_type}>>"
    heaps = rows.mapInArrow(_ranked(context.broadcast(index), k), f"item long, part int, heap {heap}")
    for keys in (("item", "part"), ("item",)):
        heaps = heaps.groupBy(*keys).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("heap"))), 1, k).alias("heap"))
    return heaps
