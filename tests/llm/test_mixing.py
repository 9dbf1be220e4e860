import hashlib

import pytest

from recordloom.llm import mixing

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0


def brute_targets(sizes):
    """The rule as told: share by weight, stop at the limit, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[k % 3] for k, s in enumerate(order)}
    whole, target, fixed = SHARE * sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in fixed]
        rest = whole - sum(MOST * sizes[s] for s in fixed)
        for s in free:
            target[s] = rest * weight[s] / sum(weight[x] for x in free)
        over = [s for s in free if target[s] >= MOST * sizes[s]]
        for s in over:
            target[s] = MOST * sizes[s]
        if not over:
            return target
        fixed |= set(over)
        if len(fixed) == len(order):
            return target


def brute(rows):
    size = lambda t: len((t or "").encode().split())
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = brute_targets(sizes)
    out = []
    for s in sizes:
        budget = int(target[s] + 0.5)
        epochs, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        key = lambda i, t: int(md5(f"mix{'' if i is None else i}:{md5(t or '')}")[:15], 16)
        mine = sorted(((key(i, t), i is None, i or 0, size(t)) for i, x, t in rows if x == s))
        at = 0
        for _, none, i, n in mine:
            out.append((None if none else i, n, sizes[s], round(target[s], 6), epochs * n + max(0, min(n, rest - at))))
            at += n
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


def rows():
    words = lambda n: " ".join(["w"] * n)
    out = [(k, "a", words(1 + k % 7)) for k in range(300)]
    out += [(1000 + k, "b", words(3)) for k in range(20)] + [(2000 + k, "é", words(k)) for k in range(9)]
    out += [(3000 + k, None, words(2)) for k in range(10)] + [(4000, "zero", None), (4001, "zero", ""), (4002, "Z", words(5000))]
    return out + [(5, "a", words(4)), (5, "a", words(4)), (5, "a", words(9)), (None, "a", words(3)), (None, "b", "x")]


@pytest.mark.parametrize("parts", [1, 7])
def test_equal_to_brute_force(spark, parts):
    docs = spark.createDataFrame([(i, s, t, 1) for i, s, t in rows()],
                                 "doc_id long, source string, text string, taken int").repartition(parts)
    assert got(mixing.mix(docs)) == brute(rows())


def test_fewer_ranges_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), "doc_id long, source string, text string")
    taken = mixing.mix(docs)
    by_source = {}
    for r in taken.collect():
        assert 0 <= r.taken <= 2 * r.size
        t = by_source.setdefault(r.source, [r.target, 0])
        t[1] += r.taken
    assert all(abs(a - b) <= 0.5 for a, b in by_source.values())


def test_mixed_rows(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, source string, text string")
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    times = {}
    for r in mixed.collect():
        times[r.doc_id, r.text] = times.get((r.doc_id, r.text), 0) + 1
    for r in mixing.mix(docs).where("size > 0 and doc_id > 5").collect():
        assert times.get((r.doc_id, r.text), 0) == -(-r.taken // r.size)


def test_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(empty).count() == 0
    one = spark.createDataFrame([(1, "s", "a b c")], "doc_id long, source string, text string")
    assert got(mixing.mix(one)) == brute([(1, "s", "a b c")])
    none = spark.createDataFrame([(1, "s", None)], "doc_id long, source string, text string")
    assert got(mixing.mix(none)) == [(1, 0, 0, 0.0, 0)]


def test_equal_sources_share_all_words(spark):
    sizes = spark.createDataFrame([(x, 100) for x in "abcdef"], "_source string, source_size long")
    found = {r["_source"]: r["target"] for r in mixing.targets(sizes, WEIGHTS, SHARE, MOST).collect()}
    assert sum(found.values()) == pytest.approx(900) and found == pytest.approx(brute_targets({x: 100 for x in "abcdef"}))
