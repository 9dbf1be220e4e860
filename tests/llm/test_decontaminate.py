import itertools
import random
import re

from recordloom.llm import decontaminate as D


def test_masks_catch_every_allowed_substitution():
    for width in range(D.LEAST_WORDS, D.WINDOW + 1):
        for wrong in itertools.combinations(range(width), D.allowed(width)):
            assert any(all(o + p not in wrong for p, bit in enumerate(m) if bit == "1")
                       for m in D.MASKS for o in range(width - len(m) + 1))


def words(t):
    spaced = re.sub(r"([\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff])", r" \1 ", (t or "").lower())
    return [w for w in re.split(r"[\W_]+", spaced) if w]


def brute(docs, items, least=1):
    out = set()
    for i, t in docs:
        w = words(t)
        for j, b in items:
            v = words(b)
            if len(v) < least:
                continue
            best = None
            width = min(13, len(v))
            for shift in range(-len(v) + 1, len(w)):
                same = [0 <= shift + k < len(w) and w[shift + k] == v[k] for k in range(len(v))]
                top = max(sum(same[k:k + width]) for k in range(len(v) - width + 1))
                if top >= width - (2 if width >= 13 else 1 if width >= 8 else 0):
                    best = max(best or (0,), (top, sum(same), -shift))
            if best:
                out.add((i, j, len(v), best[1], best[0], -best[2]))
    return out


def test_equal_to_brute_force(spark):
    rnd = random.Random(5)
    prose = lambda n: [f"w{rnd.randrange(60)}" for _ in range(n)]
    items = [(k, " ".join(prose(n))) for k, n in enumerate((8, 9, 12, 13, 14, 30, 60, 5))]
    items += [(20, items[3][1]), (21, None), (22, ""), (23, "The Same, item! with: eight words in it")]
    docs = [(0, None), (1, ""), (2, " ".join(prose(300)))]
    for k, (_, t) in enumerate(items[:7]):
        w = t.split()
        for wrong in range(4):
            v = list(w)
            for p in rnd.sample(range(len(v)), min(wrong, len(v))):
                v[p] = "other"
            docs.append((100 + 10 * k + wrong, " ".join(prose(20) + v + prose(15))))
        docs.append((200 + k, " ".join(prose(5) + w[len(w) // 2:] + prose(9))))
    docs += [(300, "x the same item WITH eight words in it y"), (300, "x the same item WITH eight words in it y"), (None, items[4][1])]
    docs.append((301, " ".join(prose(30_000) + items[5][1].split())))
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_window int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in D.contaminated(d, b).collect()}
    assert {x for x in got if x[0] != 301} == brute([x for x in docs if x[0] != 301], items)
    assert (301, 5) in {x[:2] for x in got}
    flagged = {x[0] for x in got}
    kept = D.clean(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in flagged)


def test_same_result_without_broadcast(spark, monkeypatch):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    b = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(map(str, D.contaminated(d, b).collect()))
    monkeypatch.setattr(D, "MOST_SEEDS", 0)
    assert sorted(map(str, D.contaminated(d, b).collect())) == want and want


def test_empty_sides(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert D.contaminated(d.where("false"), b).count() == 0
    assert D.contaminated(d, b.where("false")).count() == 0
    assert D.clean(d, b.where("false")).count() == 1


def test_short_items_and_scripts_without_blanks(spark):
    items = [(1, "What is a monoid?"), (2, "Yes"), (3, "one two three four five six"), (4, "a b a"),
             (5, "one two three four five six seven"), (6, "日本の首都はどこですか"), (7, "光合成"), (8, "?!"),
             (9, "ประเทศไทยมีกี่จังหวัด"), (10, "yes")]
    docs = [(1, "so, what IS a monoid"), (2, "what is the monoid"), (3, "yes"), (4, "yesterday"), (5, "a b a b a"),
            (6, "zero one two three four five six seven eight"), (7, "one two three four FIVE six"), (8, None), (9, ""),
            (10, "質問：日本の首都はどこですか？"), (11, "日本の首部はどこですか"), (12, "光合成とは"), (13, "合成光"),
            (14, "ถาม ประเทศไทยมีกี่จังหวัด ตอบ"), (15, "yes yes " * 2000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in D.contaminated(d, b).collect()} == brute(docs, items)
    assert {tuple(r) for r in D.contaminated(d, b, least_words=4).collect()} == brute(docs, items, 4)
    assert [r.doc_id for r in D.clean(d, b, least_words=8).collect() if r.doc_id in (10, 14)] == []


def test_text_that_repeats_a_passage(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    text = " ".join([passage] * 400 + ["end"])
    d = spark.createDataFrame([(1, text), (2, text), (3, "x " + passage)], "doc_id long, text string")
    b = spark.createDataFrame([(1, passage), (2, " ".join(["p3"] * 30))], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_matched, r.start) for r in D.contaminated(d, b).collect()}
    assert got == {(1, 1, 20, 0), (2, 1, 20, 0), (3, 1, 20, 1)}
