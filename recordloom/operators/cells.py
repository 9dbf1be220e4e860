"""Inverted-file neighbours: rows stored in cells around trained centres, searched cell by cell.

``build`` trains the centres on a bounded sample, puts every row into the cell of its nearest
centre and cuts each cell into rings of distance from that centre. ``search`` looks at the nearest
cells first. The triangle inequality gives the least distance that a row of a ring can
have from the query, so that rings which cannot hold one of the k nearest are never read: with
``probes=None`` the answer is that of ``similar.knn_batch``. With ``probes=n`` only the n nearest cells are
looked at, which is faster and may miss rows.

Centres and the table of rings are the only things on the driver and in tasks: ``cells`` vectors and
``cells * rings`` short rows, whatever the table's size. A ring of many rows (one cell may hold most of
them) is stored in parts of ``PART_ROWS``.

Rows and queries meet in blocks. Neighbouring parts share a block of bounded bytes, and the queries that
need any of its rings come to it once, in chunks of bounded bytes, each with the numbers of the rings it needs.
So a query travels once per block, not once per ring, a row once per chunk of queries, and a block
gives k rows per query at most.

Null vectors are left out; an empty table has no cells and gives no neighbours; rows with fewer than k
others get all of them; ties go to the least id. Vectors must be of one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage, discard, stage_path
from .shape import asc, top_k_per_key
from .similar import BLOCK_BYTES, block_count, meet

PART_ROWS = 16_384
#: Rows that centres are trained on, chosen by the hash of their id.
SAMPLE_ROWS = 200_000


@dataclass
class CellIndex:
    """A stored index: its lists, their centres, and per ring its rows and distances from the centre."""
    rows: DataFrame
    centres: np.ndarray
    rings: pd.DataFrame


class Found(NamedTuple):
    """``query_id, neighbor_id, distance, rank``, and how many rings and rows each query was compared with."""
    neighbours: DataFrame
    visits: DataFrame


def _distances_by_value():
    """``distances(rows, centres)``; nested so that it travels to the workers by value."""
    def distances(x, centres):
        # row by row of centres: memory stays at one strip of rows
        return np.stack([np.sqrt(((x - c) ** 2).sum(1)) for c in centres], axis=1)

    return distances


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """The rows ``i, v`` with their nearest centre and the distance from it."""
    distances = _distances_by_value()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                d = distances(np.stack(batch["v"].to_numpy()).astype("float64"), centres)
                cell = d.argmin(1)
                yield batch.assign(cell=cell.astype("int32"), dist=d[np.arange(len(d)), cell])

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"i {kinds['i']}, v {kinds['v']}, cell int, dist double")


def train(rows: DataFrame, cells: int, rounds: int = 8, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centres of ``rows`` (``i, v``): the rows with the least id hashes, moved to the means of their cells."""
    n = rows.count()
    order = F.xxhash64(F.col("i").cast("string"))
    if n > sample_rows:
        # hashes are uniform: the share of them below the bound is the share of rows
        rows = rows.where(order < F.lit(int(-2 ** 63 + 2 ** 64 * (sample_rows / n))))
    rows = cut_lineage(rows)
    first = rows.orderBy(order, "i").limit(cells).collect()
    centres = np.unique(np.array([r["v"] for r in first], dtype="float64"), axis=0)
    if not len(centres):
        return np.zeros((0, 0))

    def sums(batches):
        for batch in batches:
            x = np.stack(batch["v"].to_numpy()).astype("float64")
            for cell, at in batch.groupby("cell").indices.items():
                yield pd.DataFrame({"cell": [cell], "n": [len(at)], "s": [x[at].sum(0)]})

    def means(part: pd.DataFrame) -> pd.DataFrame:
        s = np.stack(part["s"].to_numpy()).sum(0) / part["n"].sum()
        return pd.DataFrame({"cell": [part["cell"].iloc[0]], "s": [s]})

    for _ in range(rounds):
        moved = (_placed(rows, centres).mapInPandas(sums, "cell int, n long, s array<double>")
                 .groupBy("cell").applyInPandas(means, "cell int, s array<double>").collect())
        centres = centres.copy()
        for cell, mean in moved:
            centres[cell] = mean
    discard(rows)
    return centres


def build(base: DataFrame, path: str | None = None, *, cells: int = 1024, rings: int = 8, rounds: int = 8,
          ident: str = "id", vector: str = "embedding") -> CellIndex:
    """Train, place and store; ``path`` is a new folder (one below the shared folder if not given)."""
    spark = base.sparkSession
    path = (path or stage_path(spark, "cells")).rstrip("/")
    rows = base.where(F.col(vector).isNotNull()).select(F.col(ident).alias("i"), F.col(vector).alias("v"))
    centres = train(rows, cells, rounds)
    placed = cut_lineage(_placed(rows, centres).withColumn("_n", F.monotonically_increasing_id()))
    edges = placed.groupBy(F.col("cell").alias("_cell")).agg(F.percentile_approx(
        "dist", F.array(*[F.lit(j / rings) for j in range(1, rings)]) if rings > 1 else F.array(F.lit(1.0)),
        F.lit(1000)).alias("_edges"))
    ring = F.size(F.filter("_edges", lambda e: F.col("dist") > e)).cast("int")
    ringed = cut_lineage(placed.join(edges, placed["cell"] == edges["_cell"])
                         .select("cell", ring.alias("ring"), "dist", "_n", "i", "v"))
    discard(placed)
    table = ringed.groupBy("cell", "ring").agg(
        F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")) \
        .withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
    table.coalesce(1).write.parquet(f"{path}/rings")
    parts = spark.read.parquet(f"{path}/rings").select("cell", "ring", "parts")
    (ringed.join(parts, ["cell", "ring"])
     .select("cell", "ring", F.pmod("_n", "parts").cast("int").alias("part"), "i", "v")
     .repartition("cell", "ring", "part")
     .write.partitionBy("cell").parquet(f"{path}/rows"))
    discard(ringed)
    spark.createDataFrame([(j, [float(x) for x in c]) for j, c in enumerate(centres)],
                          "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> CellIndex:
    """A stored index."""
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    rings = spark.read.parquet(f"{path}/rings").orderBy("cell", "ring").toPandas()
    schema = None if len(centres) else "cell int, ring int, part int, i string, v array<float>"
    rows = spark.createDataFrame([], schema) if schema else spark.read.parquet(f"{path}/rows")
    return CellIndex(rows, np.array([c["centre"] for c in centres], dtype="float64"), rings)


def _blocks(index: CellIndex) -> pd.DataFrame:
    """The parts of all rings (``cell, ring, part``, ``at``: the ring's number) and the ``block`` each lies in."""
    rings = index.rings
    at = np.repeat(np.arange(len(rings)), rings["parts"])
    n, row = int(rings["n"].sum()), 8 * index.centres.shape[1]
    most = -(-n // block_count(n * row, BLOCK_BYTES))
    blocks, held = [], 0
    for size in np.ceil(rings["n"] / rings["parts"]).to_numpy()[at]:
        full = held and held + size > most
        blocks.append(blocks[-1] + 1 if full else blocks[-1] if blocks else 0)
        held = size if full else held + size
    parts = rings.iloc[at][["cell", "ring"]].reset_index(drop=True)
    return parts.assign(part=parts.groupby(["cell", "ring"]).cumcount(), at=at, block=blocks).astype("int32")


def _asked(index: CellIndex, queries: DataFrame, k: int, probes: int | None, bounded: bool) -> DataFrame:
    """Each query (``i, v`` and, if ``bounded``, its k-th distance ``r`` so far) with the number of ``rings`` it has to
    be compared with, their ``rows``, and in ``at`` the blocks these lie in with the numbers of their rings.

    First the nearest cells, until they hold k rows and are ``probes`` many; with a bound, the rings
    outside of those that can hold a nearer row.
    """
    centres, table = index.centres, index.rings
    cell, ring = table["cell"].to_numpy(), table["ring"].to_numpy()
    low, high, n = table["low"].to_numpy(), table["high"].to_numpy(), table["n"].to_numpy()
    held = np.bincount(cell, weights=n, minlength=len(centres))
    places = _blocks(index)[["block", "at"]].drop_duplicates().sort_values(["block", "at"])
    place_block, place_at = places["block"].to_numpy(), places["at"].to_numpy()
    distances = _distances_by_value()
    wanted = probes or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                some = batch.slice(start, 1024)
                v = some.column("v").flatten().to_numpy(zero_copy_only=False).astype("float64")
                d = distances(v.reshape(some.num_rows, -1), centres)
                order = np.argsort(d, axis=1, kind="stable")
                before = np.cumsum(held[order], axis=1) - held[order]
                near = np.zeros(d.shape, dtype=bool)
                np.put_along_axis(near, order, (before < k) | (np.arange(d.shape[1]) < wanted), axis=1)
                take = near[:, cell]
                if bounded:
                    gap = np.maximum(np.maximum(d[:, cell] - high, low - d[:, cell]), 0)
                    r = some.column("r").to_numpy()[:, None]
                    take = ~take & (gap <= r + 1e-9 * (1 + r))
                # one row per query with its blocks and rings: vectors are copied only when rows meet
                query, place = np.nonzero(take[:, place_at])
                block = place_block[place]
                first = np.flatnonzero((np.diff(query, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(query)).astype("int32")),
                                                 pa.array(place_at[place]))
                ends = np.bincount(query[first], minlength=some.num_rows).cumsum()
                at = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype("int32")),
                    pa.StructArray.from_arrays([pa.array(block[first]), lists], ["block", "lists"]))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(take.sum(1)), pa.array(take @ n), at],
                                                 [*some.schema.names, "rings", "rows", "at"])

    kinds = ", ".join(f"{c} {kind}" for c, kind in queries.dtypes)
    return queries.mapInArrow(run, f"{kinds}, rings long, rows long, at array<struct<block: int, lists: array<int>>>")


def _compared(index: CellIndex, asked: DataFrame, k: int) -> DataFrame:
    spark, blocks = asked.sparkSession, _blocks(index)
    # as many rows as there are blocks
    counted = dict(asked.select(F.explode("at.block").alias("b")).groupBy("b").count().collect())
    row = 8 * index.centres.shape[1]
    chunks = [block_count(counted[b] * row, BLOCK_BYTES) if b in counted else 0
              for b in range(blocks["block"].max() + 1)]
    places = cut_lineage(spark.createDataFrame(
        blocks.assign(_chunks=np.array(chunks)[blocks["block"]]),
        "cell int, ring int, part int, at int, block int, _chunks int").where("_chunks > 0").coalesce(1))
    left = index.rows.join(places, ["cell", "ring", "part"]).select(
        "i", "v", "at", "block", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"))
    right = asked.select("i", *[c for c in ("v", "r") if c in asked.columns], F.inline("at")).withColumn(
        "chunk", F.pmod(F.xxhash64("i"), F.get(F.lit(chunks), "block")).cast("int"))
    schema = f"query_id {dict(asked.dtypes)['i']}, neighbor_id {dict(index.rows.dtypes)['i']}, distance double"
    near = meet(left, right, ["block", "chunk"], k, schema)
    return top_k_per_key(near, "query_id", asc("distance", "neighbor_id"), k, "rank")


def search(index: CellIndex, queries: DataFrame, k: int, *, probes: int | None = None, ident: str = "id",
           vector: str = "embedding") -> Found:
    """The k nearest indexed rows of every query; all of them with ``probes=None``, else those of the nearest
    ``probes`` cells (more where these hold fewer than k rows)."""
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(ident).alias("i"), F.col(vector).alias("v"))
    if not len(index.centres):
        kind = dict(asked.dtypes)["i"]
        spark = queries.sparkSession
        return Found(spark.createDataFrame([], f"query_id {kind}, neighbor_id {kind}, distance double, rank int"),
                     spark.createDataFrame([], f"query_id {kind}, rings long, rows long"))
    first = cut_lineage(_asked(index, asked, k, probes, bounded=False))
    near = _compared(index, first, k)
    visited = first.select("i", "rings", "rows")
    if probes is None:
        near = cut_lineage(near)
        reach = near.groupBy(F.col("query_id").alias("i")).agg(
            F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("r"))
        second = cut_lineage(_asked(index, asked.join(reach, "i"), k, probes, bounded=True))
        more = _compared(index, second, k)
        near = top_k_per_key(near.drop("rank").unionByName(more.drop("rank")), "query_id",
                             asc("distance", "neighbor_id"), k, "rank")
        visited = visited.unionByName(second.select("i", "rings", "rows"))
    visits = visited.groupBy(F.col("i").alias("query_id")).agg(
        F.sum("rings").alias("rings"), F.sum("rows").alias("rows"))
    return Found(near, visits)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the exact neighbours, how many of them were found, and their share."""
    keys = ["query_id", "neighbor_id"]
    hit = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("_hit")), keys, "left")
    return hit.agg(F.count("*").alias("expected"), F.count("_hit").alias("found"),
                   (F.count("_hit") / F.count("*")).alias("recall"))
