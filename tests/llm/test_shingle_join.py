import random

import pytest

from recordloom.llm import shingle_join, shingles


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[root(k)] = min(ids.get(root(k), i), i)
    return sorted(((i, len(sets[k]), ids.get(root(k))) for k, (i, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"e{rnd.randrange(10**6)}"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_all_pairs(spark, seed):
    rnd = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage = prose(40)
    texts = [prose(rnd.randrange(1, 150)) for _ in range(60)]
    texts += [prose(60) + passage + prose(30) for _ in range(40)]
    texts += [passage + prose(rnd.randrange(8, 14)) for _ in range(40)]  # mostly passage, similarity around the limit
    for n in (12, 40, 120):
        base = prose(n)
        texts += [edited(rnd, base, rnd.randrange(0, 1 + n // 20)) for _ in range(25)]
    chain = prose(80)
    for _ in range(15):  # each next one like the last
        texts.append(chain)
        chain = edited(rnd, chain, 2)
    texts += [base] * 10
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    rows += [(None, "a b c"), (1000, "A  b\tC"), (1001, "a b"), (1002, ""), (1003, None), (1003, None), (1004, " \n"),
             (1005, "é ß É"), (1006, "É ß É"), rows[0], rows[0]]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_shingles int, name string")
    assert got(shingle_join.classes(docs)) == brute(rows)
    kept = shingle_join.one_of_each(docs)
    firsts = {c for _, n, c in brute(rows) if n}
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.where("length(trim(coalesce(text, ''))) > 1").collect()]
    assert sorted(map(str, ids)) == sorted(map(str, firsts))


def test_order_table_changes_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = got(shingle_join.classes(docs))
    monkeypatch.setattr(shingle_join, "ORDER_SIZE", 10)
    monkeypatch.setattr(shingle_join, "MOST_IDS", 0)
    monkeypatch.setattr(shingles, "CHUNK", 1000)
    assert got(shingle_join.classes(docs)) == want
    assert want == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shingle_join.classes(docs).count() == 0 and shingle_join.one_of_each(docs).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101)], "a long, b long")
    found = {r["name"]: r["label"] for r in shingle_join.components(links).collect()}
    assert all(found[k] == 0 for k in range(61)) and found[101] == 100


def test_one_of_each_with_null_and_repeated_ids(spark):
    prose = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    unlinked = [(None, prose(k)) for k in range(20)] + [(7, prose(100)), (7, prose(101)), (7, prose(102))]
    copies = [(None, prose(0)), (None, prose(1).upper()), (7, prose(101)), (8, prose(102) + " end"), (3, prose(103)), (7, prose(103) + " end")]
    docs = spark.createDataFrame(unlinked + copies, "doc_id long, text string")
    got = [(r.doc_id, r.text.lower().removesuffix(" end")) for r in shingle_join.one_of_each(docs.repartition(5)).collect()]
    assert sorted(got, key=str) == sorted([*unlinked, (3, prose(103))], key=str)
