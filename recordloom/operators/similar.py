"""Nearest neighbours and clusters over text columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (BucketedRandomProjectionLSH, HashingTF, IDF, Normalizer,
                                RegexTokenizer)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from ..functions.vectors import l2_distance, vector_literal
from .shape import asc, desc, ranked, top_k_per_key


# --- embedding ----------------------------------------------------------------

class TextEmbedder:
    """Word-hash vectors weighted by rarity; needs nothing but Spark."""

    def __init__(self, dim: int = 384):
        self.dim = dim
        self.model = None

    def fit(self, df: DataFrame, text: str) -> TextEmbedder:
        words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+")
        counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=self.dim)
        weights = IDF(inputCol="_counts", outputCol="_weights")
        unit = Normalizer(inputCol="_weights", outputCol="_vector", p=2.0)
        self.model = Pipeline(stages=[words, counts, weights, unit]).fit(
            df.select(F.coalesce(F.col(text), F.lit("")).alias("_text")))
        return self

    def transform(self, df: DataFrame, ident: str, text: str) -> DataFrame:
        """``(id, embedding)`` of all rows whose text is not null."""
        rows = df.where(F.col(text).isNotNull()).select(
            F.col(ident).cast("string").alias("id"), F.col(text).alias("_text"))
        return self.model.transform(rows).select(
            "id", vector_to_array("_vector", "float32").alias("embedding"))


def embed_column(df: DataFrame, ident: str, text: str,
                 load: Callable[[], Callable[[list[str]], np.ndarray]],
                 limit: int | None = None) -> DataFrame:
    """``(id, embedding)`` by a model of the caller's own.

    ``load`` returns a function from texts to a matrix and runs once per task.
    """
    rows = df.where(F.col(text).isNotNull()).select(
        F.col(ident).cast("string").alias("id"), F.col(text).alias("text"))
    if limit is not None:
        rows = rows.orderBy("id").limit(limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            vectors = np.asarray(model(batch["text"].tolist()), dtype="float32")
            yield pd.DataFrame({"id": batch["id"], "embedding": list(vectors)})

    return rows.mapInPandas(run, "id string, embedding array<float>")


# --- exact neighbours ---------------------------------------------------------

def knn_by_vector(base: DataFrame, query, k: int, *, ident: str = "id",
                  vector: str = "embedding", texts: DataFrame | None = None,
                  text_id: str = "id", text: str = "text") -> DataFrame:
    """The k rows closest to a query vector.

    The vector is a constant of the plan. One scan keeps k rows per task, and
    texts are joined to the k rows only.
    """
    near = ranked(
        base.select(ident, l2_distance(vector, vector_literal(query)).alias("distance")),
        asc("distance", ident), k)
    if texts is None:
        return near
    return near.join(texts.select(F.col(text_id).alias(ident), text), ident).orderBy(
        *asc("distance", ident))


def knn_by_id(base: DataFrame, query_id, k: int, *, ident: str = "id", vector: str = "embedding",
              exclude_self: bool = False, **texts) -> DataFrame:
    """Neighbours of a stored row; an unknown id is an error."""
    stored = base.where(F.col(ident) == query_id).select(vector).first()
    if stored is None:
        raise KeyError(f"no row with {ident}={query_id}")
    pool = base.where(F.col(ident) != query_id) if exclude_self else base
    return knn_by_vector(pool, stored[0], k, ident=ident, vector=vector, **texts)


def knn_by_text(base: DataFrame, embedder: TextEmbedder, query: str, k: int, **kw) -> DataFrame:
    """Neighbours of a free text, embedded like the stored rows."""
    one = base.sparkSession.createDataFrame([("query", query)], "id string, text string")
    vector = embedder.transform(one, "id", "text").first()["embedding"]
    return knn_by_vector(base, vector, k, **kw)


#: A block of the grid grows up to this size before a row is copied to more than ``COPIES`` blocks; sizes count 8 bytes
#: a number.
BLOCK_BYTES, LARGEST_BLOCK, COPIES = 8 << 20, 32 << 20, 8
#: Queries and rows of one tile of the distance matrix.
TILE_QUERIES, TILE_ROWS = 512, 1024


def knn_batch(queries: DataFrame, base: DataFrame, k: int, *, ident: str = "id",
              vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k nearest base rows of every query row, exactly.

    Queries and base are cut into blocks that meet in a grid; every cell gives only its k nearest per query.
    A block takes ``block_bytes``, or more (up to ``LARGEST_BLOCK``) where a row would otherwise be
    copied to more than ``COPIES`` blocks. Nothing passes the driver but the two sizes.
    """
    kind = dict(base.dtypes)[ident]
    out_schema = f"query_id {kind}, neighbor_id {kind}, distance double"
    near = _grid(queries, base, k, ident, vector, out_schema, block_bytes)
    return top_k_per_key(near, "query_id", asc("distance", "neighbor_id"), k, "rank")


def _nearest_by_value():
    """``nearest(rows, k, tile)`` gives a function from queries to query numbers, row numbers and exact distances of
    the k nearest rows per query, equal distances by row number. Nested so that it travels to the workers by value."""
    def nearest(x, k, tile):
        # of equal rows only the first k can be among the k nearest
        _, value = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
        order = np.argsort(value.ravel(), kind="stable")
        runs = value.ravel()[order]
        kept = np.sort(order[np.arange(len(x)) - np.searchsorted(runs, runs) < k])
        x = x[kept]
        # the fast form is in short floats around the centre; c bounds its rounding relative to the two
        # squared lengths, and exact distances decide later
        centre, c = x.mean(0, dtype="float64"), (x.shape[1] + 32) * 2.0 ** -23
        scale = np.abs(x - centre).max(initial=0.0) or 1.0
        short = ((x - centre) / scale).astype("float32")
        x2 = (short.astype("float64") ** 2).sum(1)
        low2 = ((1 - c) * x2).astype("float32")

        def exact(q, cols, rows):
            dist = np.empty(len(cols))
            for at in range(0, len(cols), 1 << 16):
                diff = x[rows[at:at + (1 << 16)]] - q[cols[at:at + (1 << 16)]]
                dist[at:at + (1 << 16)] = np.sqrt((diff * diff).sum(1))
            return dist

        def ask(q, reach=np.inf):
            # reach: the distance beyond which a query needs no rows
            near = (q - centre) / scale
            # far queries would leave the range of short floats: their lengths come down to those of the rows
            far = np.maximum(np.abs(near).max(1, initial=0.0), 1.0)[:, None]
            short_q = (near / far).astype("float32")
            q2 = (short_q.astype("float64") ** 2).sum(1)[:, None]
            twice = -2 * short_q
            tiles = {n: np.empty((len(q), n), "float32") for n in {min(tile, len(x)), len(x) % tile or tile}}
            reach = np.broadcast_to(reach, len(q))
            bound = reach[:, None] ** 2
            best = (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))
            waiting, n_waiting, seen, settled = [], 0, 0, 0
            while seen < len(x):
                part = slice(seen, seen + tile)
                # the least that (row - query)^2 - query^2 can be, over the query's length if that is large
                low = np.matmul(twice, short[part].T, out=tiles[len(x2[part])])
                low += low2[part] / far.astype("float32") if far.max() > 1 else low2[part]
                fits = bound / scale ** 2 / far - (1 - c) * far * q2 + 2 * c * far * q2
                if not seen and low.shape[1] > k:
                    fits = np.minimum(fits, np.partition(low, k - 1, axis=1)[:, k - 1:k]
                                      + 2 * c * (x2[part].max() / far + far * q2))
                cols, rows = np.divmod(np.flatnonzero(low <= (fits + 1e-30).astype("float32")), low.shape[1])
                waiting.append((cols, rows + seen))
                n_waiting += len(cols)
                seen += tile
                # the bound is drawn in each time the rows have doubled, or when much is waiting
                if seen >= 2 * settled or n_waiting > 1 << 18 or seen >= len(x):
                    cols, rows = (np.concatenate(w) for w in zip(*waiting))
                    cols, rows, dist = (np.concatenate(w) for w in zip(best, (cols, rows, exact(q, cols, rows))))
                    order = np.lexsort((rows, dist, cols))
                    nth = np.arange(len(order)) - np.searchsorted(cols[order], cols[order])
                    order, nth = order[nth < k], nth[nth < k]
                    best = cols[order], rows[order], dist[order]
                    last = order[nth == k - 1]
                    bound[cols[last], 0] = np.minimum(bound[cols[last], 0], dist[last] ** 2)
                    waiting, n_waiting, settled = [], 0, seen
            cols, rows, dist = best
            inside = dist <= reach[cols] * (1 + 1e-9)
            return cols[inside], kept[rows[inside]], dist[inside]

        return ask

    return nearest


def block_count(size: int, block_bytes: int) -> int:
    """The number of blocks that ``size`` bytes are cut into."""
    return int(max(1, -(-size // LARGEST_BLOCK), min(-(-size // block_bytes), COPIES)))


def _grid(queries, base, k, ident, vector, out_schema, block_bytes):
    def blocks(df):
        return block_count(df.agg(F.sum(8 * F.size(vector))).first()[0] or 0, block_bytes)

    n_base, n_query = blocks(base), blocks(queries)

    def block(c, n):
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    rows = base.select(F.col(ident).alias("i"), F.col(vector).alias("v"),
                       block(ident, n_base).alias("b"), every(n_query).alias("q"))
    asked = queries.select(F.col(ident).alias("i"), F.col(vector).alias("v"),
                           block(ident, n_query).alias("q"), every(n_base).alias("b"))
    return meet(rows, asked, ["b", "q"], k, out_schema)


def meet(rows: DataFrame, asked: DataFrame, keys: list[str], k: int, out_schema: str) -> DataFrame:
    """The k nearest rows of every query within each block, equal distances by id.

    Both sides have ``i``, ``v`` and the block's keys. The queries may have ``r``, beyond which they need no rows. If
    the rows have ``at``, the number of their list, the queries have the numbers ``lists`` of those they are compared
    with, and each list after the first is searched within the k-th distance so far. Memory: the two sides of a
    block and one tile of their distances."""
    nearest, tile_queries, tile_rows = _nearest_by_value(), TILE_QUERIES, TILE_ROWS

    def vectors(column):
        column = column.combine_chunks()
        if len(np.unique(np.diff(column.offsets.to_numpy()))) != 1:
            raise ValueError("vectors must be of one length")
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return x if x.dtype.kind == "f" else x.astype("float64")

    def by_value(values):
        # every value with the numbers of the places that hold it
        order = np.argsort(values, kind="stable")
        found, starts = np.unique(values[order], return_index=True)
        return zip(found.tolist(), np.split(order, starts[1:]))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "neighbor_id", "distance"]
        if not left.num_rows or not right.num_rows:
            none = pa.array([], "float64")
            return pa.Table.from_arrays([right["i"].slice(0, 0), left["i"].slice(0, 0), none], names)
        listed = "at" in left.column_names
        left = left.sort_by("i")
        ids, x = left["i"], vectors(left["v"])
        asks = {at: (rows, nearest(x[rows], k, tile_rows))
                for at, rows in by_value(left["at"].to_numpy() if listed else np.zeros(len(x), "int32"))}
        del left, x
        if listed:
            # queries that begin with the same list share their tiles
            lists = right["lists"].combine_chunks()
            ends = lists.value_lengths().to_numpy().cumsum()
            first = lists.flatten().to_numpy()[np.concatenate([[0], ends[:-1]])]
            right = right.take(pa.array(np.argsort(first, kind="stable")))
        parts = []
        for start in range(0, right.num_rows, tile_queries):
            some = right.slice(start, tile_queries).combine_chunks()
            q = vectors(some["v"]).astype("float64")
            reach = some["r"].to_numpy().copy() if "r" in some.column_names else np.full(len(q), np.inf)
            if listed:
                lists = some["lists"].combine_chunks()
                who = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
                wanted = [(at, who[n]) for at, n in by_value(lists.flatten().to_numpy()) if at in asks]
            else:
                wanted = [(0, np.arange(len(q)))]
            best, waiting, n_waiting = (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)), [], 0
            for last, (at, who) in enumerate(wanted, 1 - len(wanted)):
                rows, ask = asks[at]
                c, r, dist = ask(q[who], reach[who])
                waiting.append((who[c], rows[r], dist))
                n_waiting += len(c)
                if n_waiting >= len(q) * k or not last:
                    cols, found, dist = (np.concatenate(w) for w in zip(best, *waiting))
                    order = np.lexsort((found, dist, cols))
                    nth = np.arange(len(order)) - np.searchsorted(cols[order], cols[order])
                    order, nth = order[nth < k], nth[nth < k]
                    best, waiting, n_waiting = (cols[order], found[order], dist[order]), [], 0
                    full = order[nth == k - 1]
                    reach[cols[full]] = np.minimum(reach[cols[full]], dist[full])
            parts.append(pa.Table.from_arrays(
                [some["i"].take(pa.array(best[0])), ids.take(pa.array(best[1])), pa.array(best[2])], names))
        return pa.concat_tables(parts)

    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(block, out_schema)


# --- approximate neighbours and clusters -----------------------------------------

def _features(base: DataFrame, vector: str) -> DataFrame:
    return base.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))


def approx_knn(base: DataFrame, query, k: int, *, ident: str = "id", vector: str = "embedding",
               bucket_length: float = 1.0, tables: int = 8, seed: int = 42) -> DataFrame:
    """Neighbours by random projections: fewer rows compared, some may be missed, never fewer than k
    found. Buckets are doubled until they hold enough rows; where the query lies apart from all of them, the
    search is exact."""
    data = _features(base.where(F.col(vector).isNotNull()), vector)
    wanted = min(k, data.count())
    for _ in range(12):
        lsh = BucketedRandomProjectionLSH(
            inputCol="_features", outputCol="_hashes", bucketLength=bucket_length,
            numHashTables=tables, seed=seed)
        near = cut_lineage(lsh.fit(data).approxNearestNeighbors(
            data, Vectors.dense([float(v) for v in query]), k, distCol="distance").select(ident, "distance"))
        if near.count() >= wanted:
            return near
        bucket_length *= 2
    return knn_by_vector(base, query, k, ident=ident, vector=vector)


def cluster_text(base: DataFrame, k: int, *, ident: str = "id", vector: str = "embedding",
                 seed: int = 42, max_iter: int = 20) -> DataFrame:
    """``(id, cluster)`` of embedded rows."""
    data = _features(base, vector)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features",
                   predictionCol="cluster").fit(data.select("_features"))
    return model.transform(data).select(ident, "cluster")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count("*").alias("n")).orderBy(
        *desc("n"), *asc("cluster"))
