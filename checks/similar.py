"""Nearest neighbours and clusters."""

from pyspark.sql import functions as F

from recordloom.operators import cells, similar
from recordloom.session import cut_lineage

from .registry import query, rounded

DISTANCE = "list_distance(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"


def _base(t):
    return t.raw("embeddings").withColumnRenamed("vec_id", "id")


@query("knn_l2", f"""
WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, round({DISTANCE.format('embedding', 'qv')}, 6) AS distance
FROM embeddings, q ORDER BY {DISTANCE.format('embedding', 'qv')}, vec_id LIMIT 20""", prelude=False)
def knn_l2(t):
    return rounded(similar.knn_by_id(_base(t), 0, 20), 6)


@query("knn_with_text", f"""
WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 1)
SELECT vec_id AS id, round({DISTANCE.format('embedding', 'qv')}, 6) AS distance, text
FROM embeddings JOIN documents ON vec_id = doc_id, q WHERE vec_id <> 1
ORDER BY {DISTANCE.format('embedding', 'qv')}, vec_id LIMIT 20""", prelude=False)
def knn_with_text(t):
    docs = t.raw("documents")
    base = _base(t).join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    return rounded(similar.knn_by_id(base, 1, 20, exclude_self=True, texts=docs,
                                     text_id="doc_id"), 6)


BATCH_SQL = f"""
SELECT query_id, neighbor_id, round(d, 6) AS distance, CAST(rn AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id,
         {DISTANCE.format('b.embedding', 'q.embedding')} AS d,
         row_number() OVER (PARTITION BY q.vec_id
           ORDER BY {DISTANCE.format('b.embedding', 'q.embedding')}, b.vec_id) AS rn
  FROM embeddings q, embeddings b) WHERE rn <= 10"""


@query("knn_batch", BATCH_SQL, prelude=False)
def knn_batch(t):
    return rounded(similar.knn_batch(_base(t), _base(t), 10), 6)


@query("knn_grid", BATCH_SQL, prelude=False)
def knn_grid(t):
    return rounded(similar.knn_batch(_base(t), _base(t), 10, block_bytes=20_000), 6)


@query("knn_lsh")
def knn_lsh(t):
    base = _base(t)
    query_vector = base.where("id = 0").first()["embedding"]
    return rounded(similar.approx_knn(base, query_vector, 20), 6)


def _embedded(t):
    docs = t.raw("documents")
    return similar.TextEmbedder(dim=384).fit(docs, "text"), docs


@query("embed_offline")
def embed_offline(t):
    model, docs = _embedded(t)
    return model.transform(docs, "doc_id", "text").select(
        "id", F.size("embedding").alias("dim"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm2"))


@query("knn_by_text")
def knn_by_text(t):
    model, docs = _embedded(t)
    base = model.transform(docs, "doc_id", "text")
    return rounded(similar.knn_by_text(
        base, model, "license terms for this software", 10,
        texts=docs.withColumn("doc_id", F.col("doc_id").cast("string")), text_id="doc_id"), 6)


@query("cluster_text")
def cluster_text(t):
    return similar.cluster_sizes(similar.cluster_text(_base(t), 8))


def _cells(t, **options):
    base = _base(t)
    return base, cells.build(base, cells=16, rings=4, **options)


@query("knn_cells", BATCH_SQL, prelude=False)
def knn_cells(t):
    base, index = _cells(t)
    return rounded(cells.search(index, base, 10).neighbours, 6)


@query("knn_cells_recall")
def knn_cells_recall(t):
    """Recall against ``knn_batch`` and the share of pairs compared, per number of probed cells (0: all that the
    bound asks for)."""
    base, index = _cells(t)
    exact = cut_lineage(similar.knn_batch(base, base, 10))
    pairs = base.agg(F.count("*").alias("n")).select((F.col("n") * F.col("n")).alias("n")).scalar()
    out = None
    for probes in (4, 12, None):
        found = cells.search(index, base, 10, probes=probes)
        row = cells.recall(found.neighbours, exact).select(
            F.lit(probes or 0).alias("probes"), "expected", "found", "recall",
            (found.visits.agg(F.sum("rows").alias("rows")).scalar() / pairs).alias("compared"))
        out = row if out is None else out.unionByName(row)
    return out
