"""Toxicity scores: gradient-boosted trees over dense features of the whole text, calibrated by isotonic regression.

1. **Labels** count only where ``crc32(id as text) mod 5`` is not 0; the remaining rows are held out. Copies of a text are
   one training text, toxic if half of its labels or more say so. ``MOST_ROWS`` texts at most, taken by hash, are learnt from.
2. **Lexicon**: for each word (and each ``STEM`` letters that longer words begin with) the log-odds of toxic against other
   training texts, by the number of texts that hold it, with its standard error. What is significant
   becomes the lexicon, ``LEXICON`` terms at most; only the ``CANDIDATES`` words with the most toxic texts are looked at. Both are
   bounds of the model, and of what is broadcast.
3. **Features**, ``FEATURES`` numbers per text: lexicon densities, how near the hits are to the second person, capitals, punctuation, and
   hits that show only once look-alike signs, stretched letters and spaced letters are undone. For a training
   text the lexicon is learnt without the text's own fold, so that the trees see hits as rare as they are in new texts.
4. **Trees** (Spark ML) are fitted on three folds, the isotonic regression of their margin on the fourth.
   The scores of all rows then come from the lexicon of all training texts.

Id, language, source and labels are inputs of no score. Texts are read whole, in one pass and without a shuffle; what is shuffled is
keys and labels, the chosen training texts, once, and counts.

Edge cases: a null or empty text has features of its own (all 0) and a score; repeated rows get equal scores; a null id is in no fold and
held out (as it has no label); without labels of both kinds the score is the share of toxic ones, 0 without any; an empty table gives an
empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from recordloom.llm.common import keyed_by_text, text_of
from recordloom.session import cut_lineage

FOLDS = 5
#: Training texts, at most: what lexicon, trees and calibration are learnt from.
MOST_ROWS = 40_000
#: Words that are looked at for the lexicon, and terms in it, at most.
CANDIDATES, LEXICON = 200_000, 20_000
#: A term of the lexicon is in so many toxic texts, is so much likelier in them (natural logarithm), by so many standard errors.
LEAST_TEXTS, LEAST_ODDS, LEAST_Z = 3, 1.0, 2.4
#: A term whose log-odds are this high is a strong one.
STRONG = 2.5
STEM = 5
#: Single letters in a row that are read as a word.
SPELT = 4
#: Words between a hit and the second person that count as near.
NEAR = 5
TREES, DEPTH = 20, 4
#: Words that a task remembers or counts before it starts anew.
FLUSH = 200_000

# Words of address in English, German, French and Spanish.
SECOND_PERSON = frozenset("""
you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer eure tu te toi ton ta tes vous votre vos
tú ti tus usted ustedes vosotros vuestro vuestra
""".split())
# Signs that stand for letters.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
_AROUND = " \t\r\n.,;:!?\"'`´()[]{}<>|/\\*%&#$+=~^_-…“”„‘’«»¡¿"
_STRETCHED = re.compile(r"(.)\1{2,}")
_SIGN = re.compile(r"[^\W\d_][^\w\s'’-]+[^\W\d_]|[^\W\d_][0-9]|[0-9@$][^\W\d_]")

FEATURES = ("words", "strong_density", "strong", "kinds", "weight_density", "best", "stem_density", "stems", "best_stem",
            "near_second", "second_density", "capitals", "shouted", "exclaimed", "punctuation", "signs", "hidden_density", "stretched")


def plain(token: str) -> str:
    """The word inside a token."""
    return token.strip(_AROUND).lower()


def undone(token: str) -> list[str]:
    """What a token may hide: look-alike signs, signs between letters and stretched letters undone."""
    letters = "".join(c for c in token.strip(".,;:?\"'()[]").translate(LOOK_ALIKE).lower() if c.isalpha())
    return [form for form in (letters, _STRETCHED.sub(r"\1", letters), _STRETCHED.sub(r"\1\1", letters)) if form]


def terms_of(text: str) -> set[str]:
    """What the lexicon may hold of a text: its words, and the beginnings of longer ones with a hyphen."""
    words = {plain(t) for t in set(text.split())}
    words.discard("")
    return words | {w[:STEM] + "-" for w in words if len(w) > STEM + 1}


class Reader:
    """Features of texts under one lexicon (term -> log-odds)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self._start()

    def _start(self):
        reader = self

        class Known(dict):
            def __missing__(self, token):
                self[token] = code = reader._add(token)
                return code

        self.codes = Known()
        #: what is known of a token -> its number, and the same by columns
        self.made: dict[tuple, int] = {}
        self.columns: list[np.ndarray] | None = None
        self.kinds: dict[str, int] = {}

    def _add(self, token: str) -> int:
        """The number of what is to be known of a token; most tokens share a few numbers."""
        plainly = token.isalpha() and token.islower()
        word = token if plainly else plain(token)
        found, hidden = self.lexicon.get(word), False
        stretched = bool(_STRETCHED.search(word))
        if found is None and not (plainly and not stretched):
            for form in undone(token):
                if form != word and form in self.lexicon:
                    word, found, hidden = form, self.lexicon[form], True
                    break
        stem = self.lexicon.get(word[:STEM] + "-", 0.0) if len(word) > STEM + 1 else 0.0
        kind = self.kinds.setdefault(word, len(self.kinds)) if found is not None else -1
        about = (found or 0.0, kind, hidden, stem, word in SECOND_PERSON, not plainly and len(word) > 1 and token.isupper(),
                 not plainly and bool(_SIGN.search(token)), stretched, len(token) == 1 and token.isalpha())
        number = self.made.get(about)
        if number is None:
            number = self.made[about] = len(self.made)
            self.columns = None
        return number

    def features(self, text: str) -> list[float]:
        tokens = text.split()
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        if len(self.codes) > FLUSH:
            self._start()
        codes = np.fromiter(map(self.codes.__getitem__, tokens), np.int64, n)
        if self.columns is None:
            self.columns = [np.array(x) for x in zip(*self.made)]
        weight, kind, hidden, stem, second, shouted, sign, stretched, letter = (x[codes] for x in self.columns)
        # words written letter by letter come on top
        joined = [w for w in (self.lexicon.get(s, 0.0) for s in self._spelt(tokens, letter)) if w]
        hits = np.flatnonzero(weight >= STRONG)
        people = np.flatnonzero(second)
        near = 0
        if len(hits) and len(people):
            at = np.searchsorted(people, hits)
            before = hits - people[np.maximum(at - 1, 0)]
            after = people[np.minimum(at, len(people) - 1)] - hits
            near = int(((np.abs(before) <= NEAR) | (np.abs(after) <= NEAR)).sum())
        n_strong = len(hits) + sum(w >= STRONG for w in joined)
        n_stems = int(np.count_nonzero(stem))
        data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        upper, lower = int(data[65:91].sum()), int(data[97:123].sum())
        signs = int(data[33:48].sum() + data[58:65].sum() + data[91:97].sum() + data[123:127].sum())
        return [
            math.log1p(n), n_strong / n, math.log1p(n_strong), math.log1p(len(set(kind[hits].tolist())) + len(joined)),
            (float(weight.sum()) + sum(joined)) / n, max([float(weight.max()), *joined]),
            n_stems / n, math.log1p(n_stems), float(stem.max()),
            near / max(1, n_strong), len(people) / n, upper / max(1, upper + lower), int(np.count_nonzero(shouted)) / n,
            int(data[33] + data[63]) / n, signs / n, int(np.count_nonzero(sign)) / n,
            (int(np.count_nonzero(hidden)) + len(joined)) / n, int(np.count_nonzero(stretched)) / n]

    @staticmethod
    def _spelt(tokens: list[str], letter: np.ndarray) -> list[str]:
        """What runs of ``SPELT`` single letters or more spell."""
        if int(np.count_nonzero(letter)) < SPELT:
            return []
        edges = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
        return ["".join(tokens[a:b]).lower() for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= SPELT]


def _counted(known):
    """Training texts (text, fold) -> terms and folds with the number of texts, added up within the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = known and known.value, Counter()

        def flush():
            rows = list(counts.items())
            return pa.RecordBatch.from_arrays(
                [pa.array([t for (t, _), _ in rows], pa.string()), pa.array([f for (_, f), _ in rows], pa.int32()),
                 pa.array([n for _, n in rows], pa.int64())], ["term", "fold", "texts"])

        for batch in batches:
            for text, fold in zip(batch.column(0), batch.column(1).to_pylist()):
                terms = terms_of(text.as_py())
                counts.update((t, fold) for t in (terms if wanted is None else terms & wanted))
                if len(counts) > FLUSH:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()
    return run


def _described(shared, carried: int):
    """Batches of carried columns, the fold to leave out and the text -> the carried columns and the features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[int, Reader] = {}
        for batch in batches:
            rows = []
            for fold, text in zip(batch.column(carried).to_pylist(), batch.column(carried + 1)):
                if fold not in readers:
                    readers[fold] = Reader(shared.value[fold])
                rows.append(readers[fold].features(text.as_py()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:carried], pa.array(rows, pa.list_(pa.float64()))],
                [*batch.schema.names[:carried], "_features"])
    return run


def _fold(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS))


def training_texts(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most_rows: int) -> DataFrame:
    """``t, toxic, fold``: the distinct texts with labels that may be learnt from, ``most_rows`` at most by hash; folds 1 to 4.

    Texts are chosen by their keys; the chosen keys are few enough to be broadcast, and only chosen texts move.
    """
    marks = labels.where(F.col(label).isNotNull() & (_fold(doc_id) != 0)) \
        .groupBy(F.col(doc_id).alias("id")).agg(F.avg(label).alias("toxic"))
    rows = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("t"), *keyed_by_text(docs, text))
    texts = cut_lineage(
        rows.select("id", "_k1", "_k2").join(marks, "id").groupBy("_k1", "_k2")
        .agg(F.min("id").alias("id"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
        .withColumn("fold", _fold("id").cast("int")))
    one_in = max(1, -(-texts.count() // most_rows))
    chosen = texts.where(F.pmod(F.xxhash64("_k1", "_k2"), F.lit(one_in)) == 0)
    return cut_lineage(rows.join(F.broadcast(chosen), ["id", "_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select("t", "toxic", "fold"))


def lexicons(texts: DataFrame) -> list[dict[str, float]]:
    """The lexicon of all training texts, and for folds 1 to 4 the one without that fold."""
    spark = texts.sparkSession
    sizes = {(r.toxic, r.fold): r.n for r in texts.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    toxic = texts.where("toxic = 1").select("t", "fold").mapInArrow(_counted(None), "term string, fold int, texts long")

    def per_fold(counts):
        return counts.groupBy("term").agg(*[
            F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("texts"))), F.lit(0)).alias(f"f{f}") for f in range(1, FOLDS)])

    every = F.col("f1") + F.col("f2") + F.col("f3") + F.col("f4")
    candidates = per_fold(toxic).where(every >= LEAST_TEXTS).orderBy(F.desc(every), "term").limit(CANDIDATES).toPandas()
    wanted = spark.sparkContext.broadcast(frozenset(candidates["term"]))
    clean = texts.where("toxic = 0").select("t", "fold").mapInArrow(_counted(wanted), "term string, fold int, texts long")
    # at most one row for each candidate
    both = candidates.merge(per_fold(clean).toPandas(), on="term", how="left", suffixes=("", "_clean")).fillna(0)
    found = []
    for left_out in range(FOLDS):
        folds = [f for f in range(1, FOLDS) if f != left_out]
        a = both[[f"f{f}" for f in folds]].sum(axis=1).to_numpy(float)
        b = both[[f"f{f}_clean" for f in folds]].sum(axis=1).to_numpy(float)
        n_a, n_b = (sum(sizes.get((k, f), 0) for f in folds) for k in (1, 0))
        odds = np.log((a + .5) / (n_a - a + .5)) - np.log((b + .5) / (n_b - b + .5))
        z = odds / np.sqrt(1 / (a + .5) + 1 / (b + .5))
        good = np.flatnonzero((a >= LEAST_TEXTS) & (odds >= LEAST_ODDS) & (z >= LEAST_Z))
        good = good[np.lexsort((both["term"].to_numpy(str)[good], -z[good]))][:LEXICON]
        found.append(dict(zip(both["term"].to_numpy(object)[good], odds[good].tolist())))
    return found


class Model:
    """A fitted scorer: lexicon, trees and calibration, or a fixed share where there was nothing to tell apart."""

    def __init__(self, share: float, lexicon: dict[str, float] | None = None, trees=None, calibration=None):
        self.share, self.lexicon, self.trees, self.calibration = share, lexicon, trees, calibration

    def margins(self, described: DataFrame) -> DataFrame:
        """With ``_margin``, the trees' verdict before calibration."""
        judged = self.trees.transform(described.withColumn("_vector", array_to_vector("_features")))
        return judged.withColumn("_margin", vector_to_array("rawPrediction")[1])

    def score(self, docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
        """The named columns and ``score``."""
        kept = {c: f"_c{k}" for k, c in enumerate(columns)}
        rows = docs.select(*[F.col(c).alias(k) for c, k in kept.items()], F.lit(0).alias("_fold"), text_of(text).alias("_t"))
        back = [F.col(k).alias(c) for c, k in kept.items()]
        if self.trees is None:
            return rows.select(*back, F.lit(float(self.share)).alias("score"))
        types = dict(rows.dtypes)
        shared = docs.sparkSession.sparkContext.broadcast([self.lexicon])
        described = rows.mapInArrow(_described(shared, len(kept)), ", ".join(
            [f"{k} {types[k]}" for k in kept.values()] + ["_features array<double>"]))
        scored = self.calibration.transform(self.margins(described))
        return scored.select(*back, F.least(F.greatest("_score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          most_rows: int = MOST_ROWS) -> Model:
    """Learn from the labels outside fold 0."""
    texts = training_texts(docs, labels, doc_id, text, label, most_rows)
    n, toxic = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        return Model(toxic / n if n else 0.0)
    found = lexicons(texts)
    shared = docs.sparkSession.sparkContext.broadcast(found)
    # a text's own fold is left out of the lexicon it is read with
    described = cut_lineage(
        texts.select(F.col("toxic").cast("double").alias("toxic"), F.col("fold"), F.col("fold").alias("_fold"), "t")
        .mapInArrow(_described(shared, 2), "toxic double, fold int, _features array<double>"))
    # fewer texts than a fold needs for both labels are fitted and calibrated on alike
    fitted, held = described.where(f"fold < {FOLDS - 1}"), described.where(f"fold = {FOLDS - 1}")
    if any(x.select("toxic").distinct().count() < 2 for x in (fitted, held)):
        fitted = held = described
        if described.select("toxic").distinct().count() < 2:
            return Model(toxic / n)
    trees = GBTClassifier(featuresCol="_vector", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2,
                          seed=1, cacheNodeIds=True).fit(fitted.withColumn("_vector", array_to_vector("_features")))
    model = Model(toxic / n, found[0], trees)
    model.calibration = IsotonicRegression(featuresCol="_margin", labelCol="toxic", predictionCol="_score").fit(
        model.margins(held).select("toxic", "_margin"))
    return model


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          most_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    model = train(docs, labels, doc_id, text, label, most_rows)
    return model.score(docs, [doc_id], text).select(
        doc_id, F.coalesce(_fold(doc_id) == 0, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
