"""Inverted-file neighbours against the search of all pairs."""

import numpy as np
import pytest

from recordloom.operators import cells, similar

SCHEMA = "id int, embedding array<float>"


def vectors(spark, rng, n, groups=6, dim=8, spread=0.1):
    heads = rng.normal(size=(groups, dim))
    x = heads[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA)


def rows(df):
    return sorted((r.query_id, r["rank"], r.neighbor_id, round(r.distance, 6)) for r in df.collect())


@pytest.mark.parametrize("k, n_cells, n_rings", [(1, 1, 1), (5, 8, 3), (40, 20, 4), (500, 8, 2)])
def test_bounded_search_is_exact(spark, k, n_cells, n_rings):
    rng = np.random.default_rng(k)
    base, asked = vectors(spark, rng, 300), vectors(spark, rng, 40)
    index = cells.build(base, cells=n_cells, rings=n_rings, rounds=3)
    assert rows(cells.search(index, asked, k).neighbours) == rows(similar.knn_batch(asked, base, k))


def test_rings_are_left_out_and_recall_grows(spark):
    rng = np.random.default_rng(7)
    base = vectors(spark, rng, 600, groups=12, spread=0.02)
    index = cells.build(base, cells=24, rings=4)
    exact = similar.knn_batch(base, base, 10)
    found = cells.search(index, base, 10)
    assert rows(found.neighbours) == rows(exact)
    visits = found.visits.agg({"rows": "sum", "query_id": "count"}).first()
    assert visits["count(query_id)"] == 600 and visits["sum(rows)"] < 0.5 * 600 * 600
    shares = [cells.recall(cells.search(index, base, 10, probes=p).neighbours, exact).first()["recall"]
              for p in (1, 4)]
    assert shares[0] <= shares[1] and shares[1] >= 0.9


def test_copies_parts_and_null_vectors(spark, monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 16)
    data = [(i, [1.0, 2.0]) for i in range(80)] + [(100 + i, [float(i), 0.0]) for i in range(20)] + [(999, None)]
    base = spark.createDataFrame(data, SCHEMA)
    known = base.where("embedding IS NOT NULL")
    index = cells.build(base, cells=6, rings=3)
    assert index.rings["parts"].max() >= 5 and index.rings["n"].sum() == 100
    assert rows(cells.search(index, base, 7).neighbours) == rows(similar.knn_batch(known, known, 7))


def test_stored_index_and_empty_table(spark, tmp_path):
    base = vectors(spark, np.random.default_rng(1), 60)
    built = cells.build(base, str(tmp_path / "index"), cells=5)
    again = cells.open_index(spark, str(tmp_path / "index"))
    assert rows(cells.search(again, base, 3).neighbours) == rows(cells.search(built, base, 3).neighbours)
    none = cells.build(base.limit(0), cells=5)
    found = cells.search(none, base, 3)
    assert found.neighbours.count() == found.visits.count() == 0


@pytest.mark.parametrize("kind", ["plain", "copies", "shifted", "outlier", "far", "tiny", "same"])
def test_tiles_give_the_nearest_rows(kind):
    rng = np.random.default_rng(3)
    x, q, k = rng.normal(size=(700, 6)), rng.normal(size=(30, 6)), 5
    if kind == "copies":
        x = x[rng.integers(40, size=700)]
    x = {"shifted": x + 1e5, "outlier": np.vstack([x, np.full((1, 6), 1e9)]), "tiny": x * 1e-24,
         "same": np.ones((700, 6))}.get(kind, x)
    q = {"shifted": q + 1e5, "far": q * 1e12, "tiny": q * 1e-24}.get(kind, q)
    cols, rows_, dist = similar._nearest_by_value()(x, k, 64)(q)
    want = np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1))
    order = np.array([np.lexsort((np.arange(len(x)), d))[:k] for d in want])
    got = rows_[np.lexsort((rows_, dist, cols))].reshape(len(q), k)
    assert len(cols) == len(q) * k  # a cell gives k rows per query, however many are equally near
    np.testing.assert_allclose(np.take_along_axis(want, got, 1), np.take_along_axis(want, order, 1), rtol=1e-12)
    if kind in ("plain", "copies", "outlier", "same"):
        assert (got == order).all()


def test_small_blocks_do_not_multiply_the_rows(spark):
    base = vectors(spark, np.random.default_rng(2), 400)
    near = similar._grid(base, base, 3, "id", "embedding", "query_id int, neighbor_id int, distance double", 640)
    # 400 rows of 64 bytes would make 40 blocks a side, and 40 copies of every row
    assert near.count() <= similar.COPIES * 400 * 3
    assert rows(similar.knn_batch(base, base, 3, block_bytes=640)) == rows(similar.knn_batch(base, base, 3))


@pytest.mark.parametrize("probes", [8, None])
def test_a_query_travels_once_per_block(spark, monkeypatch, probes):
    sizes, meet = [], cells.meet

    def counted(rows_, asked, *args):
        near = meet(rows_, asked, *args)
        sizes.append((rows_.count(), asked.count(), near.count()))
        return near

    monkeypatch.setattr(cells, "meet", counted)
    monkeypatch.setattr(cells, "PART_ROWS", 16)
    monkeypatch.setattr(cells, "BLOCK_BYTES", 10_000, raising=False)
    base = vectors(spark, np.random.default_rng(4), 400, spread=2.0)
    index = cells.build(base, cells=8, rings=4)
    found = cells.search(index, base, 10, probes=probes)
    assert rows(found.neighbours) == rows(similar.knn_batch(base, base, 10))
    # 400 rows of 64 bytes make 3 blocks or 4, and as many chunks of queries; a cell each for 32 rings made 32
    assert all(max(n) <= 400 * 4 * size for n, size in zip(zip(*sizes), (1, 1, 10)))


def test_no_queries_and_vectors_of_two_lengths(spark):
    base = vectors(spark, np.random.default_rng(1), 60)
    index = cells.build(base, cells=5)
    found = cells.search(index, base.limit(0), 3)
    assert found.neighbours.count() == found.visits.count() == 0
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0])], SCHEMA)
    with pytest.raises(Exception, match="one length"):
        similar.knn_batch(odd, odd, 1).collect()
