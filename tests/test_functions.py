"""Column functions and the name scorer."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recordloom.functions import coerce, fuzzy, names, text, vectors


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn("c").alias("r")).first()[0]


@pytest.mark.parametrize("raw,want", [
    ("123.00", 123.0), ("$1,200", 1200.0), ("$ 5", 5.0), ("", None), (" ", None), (None, None),
    ("abc", None), ("-3.5", -3.5), ("1e3", 1000.0), ("1.0d", None), ("nan", None)])
def test_to_double(spark, raw, want):
    assert one(spark, raw, coerce.to_double) == want


@pytest.mark.parametrize("raw,want", [
    ("12", 12), (" 12\n", 12), ("1.0", None), ("1,000", None), ("", None), (None, None),
    ("99999999999", None), ("+7", 7)])
def test_to_int(spark, raw, want):
    assert one(spark, raw, coerce.to_int) == want


@pytest.mark.parametrize("raw,want", [
    ("40012-123", 40012), ("abc", None), (None, None), ("7", 7), ("", None)])
def test_leading_int(spark, raw, want):
    assert one(spark, raw, coerce.leading_int) == want


def test_small_coercions(spark):
    assert one(spark, "\t a b \n", coerce.strip_null) == "a b"
    assert one(spark, "  ", coerce.strip_null) is None
    assert one(spark, None, coerce.tri_bool) is None
    assert one(spark, "false", coerce.tri_bool) is False
    assert one(spark, "true", coerce.tri_bool) is True
    df = spark.createDataFrame([("", "0", "b")], "a string, z string, b string")
    assert df.select(coerce.first_non_empty("a", "z", "b")).first()[0] == "0"
    assert df.select(coerce.first_non_empty("a", "z", "b", skip_zero=True)).first()[0] == "b"
    assert str(one(spark, "2024-02-03", coerce.parsed_date)) == "2024-02-03"
    assert one(spark, "no date", coerce.parsed_date) is None


@pytest.mark.parametrize("raw,want", [
    ("Acme, Inc.", "ACME"), ("  Smith & Co (Holdings) L.P ", "SMITH L P"),
    ("LLC", None), (None, None), ("Incline Group", "INCLINE"), ("École Co", "ÉCOLE"),
    ("ÉCO Partners", "ÉCO")])
def test_normalize_name(spark, raw, want):
    assert one(spark, raw, names.normalize_name) == want


def test_simple_key_both_ways(spark):
    # the compatible form blanks lower-case letters before upper-casing
    assert one(spark, "Akin Gump LLP", lambda c: names.name_key_simple(c, compat=True)) \
        == "A    G    LLP"
    assert one(spark, "Akin Gump LLP", names.name_key_simple) == "AKIN GUMP LLP"
    assert one(spark, "A/b: c  d-e", names.slugify) == "Ab c d-e"


def test_keywords(spark):
    assert one(spark, "Safara trip", lambda c: text.any_keyword(c, ("fara", "x"))) is True
    assert one(spark, "Safara trip", lambda c: text.any_keyword(c, ("fara", "x"), word=True)) is False
    assert one(spark, "FARA filing", lambda c: text.any_keyword(c, ("fara",), word=True)) is True
    assert one(spark, None, lambda c: text.any_keyword(c, ("a",))) is False
    labels = (("finance", ("finance",)), ("health", ("health",)))
    assert one(spark, "Health and Finance", lambda c: text.first_label(c, labels)) == "finance"
    assert one(spark, "none", lambda c: text.first_label(c, labels)) is None


def test_bill_ids(spark):
    raw = "See H.R. 5376, HR1 and S. 2587; also H.J.Res. 7, SJRES 12, but not HRX9 or AS 5."
    found = one(spark, raw, lambda c: F.transform(text.find_all(c, text.BILL_PATTERN), text.bill_key))
    assert found == ["HR5376", "HR1", "S2587", "HJRES7", "SJRES12"]


def test_l2(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(vectors.l2_distance("a", "b")).first()[0] == 5.0


def test_token_set_scores(spark):
    pairs = [("MICHAEL RYAN", "RYAN", 100.0), ("MICHAEL RYAN", "MICHAEL YAKI", 83.3333),
             ("ABC", "ABC", 100.0), ("ABC", "XYZ", 0.0), ("B A", "A B", 100.0),
             ("MICROSOFT", "MICROSOFTS", 94.7368)]
    df = spark.createDataFrame(pairs, "l string, r string, want double")
    got = df.withColumn("s", fuzzy.token_set_scorer()("l", "r")).collect()
    for r in got:
        assert r.s == pytest.approx(r.want, abs=1e-3), r


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def plain_token_set(left, right):
    a, b = set((left or "").split()), set((right or "").split())
    if not a or not b:
        return 0.0
    shared, x, y = (" ".join(sorted(w)) for w in (a & b, a - b, b - a))
    if shared and not (x and y):
        return 100.0
    likeness = lambda p, q: 200.0 * longest_common(p, q) / (len(p) + len(q))
    whole = [f"{shared} {rest}".strip() for rest in (x, y)]
    return max([likeness(*whole)] + [likeness(shared, w) for w in whole if shared])


@pytest.mark.parametrize("most_cells", [1 << 21, 300])
def test_token_set_scores_of_whole_batches(most_cells):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ABCDE\u00e9\u4e2d\U0001f600") for _ in range(rng.choice([1, 2, 5, 9, 40, 90])))
    pairs = [(None, "A"), ("A", None), (None, None), ("", ""), ("A", "A"), (" ", "A"), ("A A", "A")]
    for _ in range(400):
        left = [word() for _ in range(rng.randrange(6))]
        right = [word() for _ in range(rng.randrange(6))] if rng.random() < 0.4 else [
            *rng.sample(left, len(left)), *rng.choice([[], ["X"], ["ABC", "D"]])]
        pairs.append((" ".join(left), " ".join(right)))
        pairs.append((" ".join(left), " ".join(right) + rng.choice(["Y", "AB", ""])))
    score = fuzzy.token_set_scorer(most_cells).func
    got = score(pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs]))
    for pair, value in zip(pairs, got):
        assert value == pytest.approx(plain_token_set(*pair), abs=1e-9), pair
    assert list(score(pd.Series([], dtype=object), pd.Series([], dtype=object))) == []
    assert list(score(pd.Series([None]), pd.Series([""]))) == [0.0]
