"""Licence scan: parts of a text against licence templates by the Dice coefficient of word bigrams.

A text is compared in parts: every line, every run of lines of which most bigrams occur in some template (a
licence that covers several lines), the whole text, and windows of a template's number of words around its
anchors, wherever in a line they stand. Part and template are normalised to lower-case words;
their likeness is ``2 |A and B| / (|A| + |B|)`` over the bigrams, counted with repetition.

Two multisets can only reach the threshold ``t`` if the smaller one is at least ``t / (2 - t)`` times the
larger, so a part meets just the templates in its size range, found by bisection. Parts of sizes that no
template has near, nearly all, are not compared.

Anchors of a template are its rarest-looking bigrams (of the longest words), so many that no window which
reaches the threshold lacks all of them: it misses ``1 - t / (2 - t)`` of the template at most. An anchor fixes the window's
start; equal starts are compared once. Of overlapping windows the most similar one counts, whatever its licence.

Documents are independent: one pass, no shuffle, memory in proportion to one text. Templates are a fixed
parameter and travel with the function.

Edge cases: a null or empty text has no licence; of equal likeness the licence first by name counts; repeated
rows give equal rows; an empty table gives an empty result; input columns named like a result column are
replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from recordloom.llm.licence_texts import TEMPLATES

THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
FOUND = "array<struct<licence:string,dice:double,start:int,end:int>>"


def bigrams(text: str) -> Counter:
    """Word bigrams of a text with their counts; a single word stands alone."""
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:])) if len(words) > 1 else Counter(words)


def dice(a: Counter, b: Counter) -> float:
    """Likeness of two multisets."""
    sizes = a.total() + b.total()
    return 2 * (a & b).total() / sizes if sizes else 0.0


class Templates:
    """Templates by size, with the bigrams of all of them."""

    def __init__(self, texts: Sequence[tuple[str, str]], threshold: float):
        made = sorted(((bigrams(text), name) for name, text in texts), key=lambda x: (x[0].total(), x[1]))
        self.bigrams = [b for b, _ in made]
        self.names = [n for _, n in made]
        self.sizes = [b.total() for b in self.bigrams]
        self.known = frozenset().union(*self.bigrams) if made else frozenset()
        self.threshold = threshold
        self.ratio = threshold / (2 - threshold)
        self.anchors: dict = {}
        texts_of = sorted(((bigrams(text), name, text) for name, text in texts), key=lambda x: (x[0].total(), x[1]))
        for k, (b, _, text) in enumerate(texts_of):
            places: dict = {}
            words = _WORD.findall(text.lower())
            for i, pair in enumerate(zip(words, words[1:])):
                places.setdefault(pair, []).append(i)
            need = b.total() - self.ratio * b.total()
            # the longest words first; more bigrams than a match can miss
            for pair in sorted(places, key=lambda p: (-min(map(len, p)), -sum(map(len, p)), p)):
                if need < -1e-9:
                    break
                need -= b[pair]
                self.anchors.setdefault(pair, []).extend((k, i) for i in places[pair])

    def near(self, size: int) -> range:
        """The templates whose size allows the threshold."""
        return range(bisect_left(self.sizes, size * self.ratio - 1e-9), bisect_right(self.sizes, size / self.ratio + 1e-9))

    def best(self, part: Counter) -> tuple[str, float] | None:
        """The most similar template's licence, if it reaches the threshold."""
        found = [(-dice(part, self.bigrams[k]), self.names[k]) for k in self.near(part.total())] if part else []
        if not found or -min(found)[0] < self.threshold:
            return None
        return min(found)[1], -min(found)[0]


def _parts(text: str, templates: Templates) -> Iterator[tuple[int, int, Counter]]:
    """Lines, runs of licence-like lines, and the whole text: start, end and bigrams."""
    at, run, n_lines = 0, [], 0

    def joined():
        whole = text[run[0][0]:run[-1][1]]
        return run[0][0], run[-1][1], bigrams(whole)

    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        if not line.strip():
            continue
        n_lines += 1
        part = bigrams(line)
        yield start, start + len(line), part
        alike = sum(n for b, n in part.items() if b in templates.known)
        if part and 2 * alike >= part.total():
            run.append((start, start + len(line)))
        else:
            if len(run) > 1:
                yield joined()
            run = []
    if len(run) > 1:
        yield joined()
    if n_lines > 1 and not (len(run) == n_lines):
        yield 0, len(text), bigrams(text)


def _windows(text: str, whole: Counter, templates: Templates) -> list[tuple[float, int, int, str]]:
    """``-dice, start, end, licence`` of the windows around anchors that match, overlapping ones left out."""
    present = {a for a in templates.anchors if a in whole}
    if not present:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [text[s:e].lower() for s, e in spans]
    pairs = list(zip(words, words[1:]))
    starts = {(k, p - i) for p, pair in enumerate(pairs) if pair in present for k, i in templates.anchors[pair]}
    found = []
    for k, start in starts:
        first, last = max(0, start), min(len(pairs), start + templates.sizes[k])
        if last > first:
            likeness = dice(Counter(pairs[first:last]), templates.bigrams[k])
            if likeness >= templates.threshold:
                found.append((-likeness, spans[first][0], spans[last][1], templates.names[k]))
    taken: list[tuple[int, int]] = []
    best = []
    for x in sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1], x[3])):
        # those taken do not overlap, so only the neighbours in order can
        at = bisect_left(taken, (x[1], x[2]))
        if not any(s < x[2] and x[1] < e for s, e in taken[max(0, at - 1):at + 1]):
            taken.insert(at, (x[1], x[2]))
            best.append(x)
    return best


def scan(text: str, templates: Templates) -> list[tuple[str, float, int, int]]:
    """``licence, dice, start, end`` of the parts that match, in text order; of overlapping parts with the
    same licence the most similar one."""
    found, part = [], Counter()
    for start, end, part in _parts(text, templates):
        if best := templates.best(part):
            found.append((-best[1], start, end, best[0]))
    # the last part has the bigrams of the whole text; a window inside a part that is as similar adds nothing
    found += [x for x in _windows(text, part, templates)
              if not any(minus <= x[0] and s < x[2] and x[1] < e for minus, s, e, _ in found)]
    kept: dict[str, list[tuple[int, int, float]]] = {}
    for minus, start, end, name in sorted(found):
        others = kept.setdefault(name, [])
        if not any(s < end and start < e for s, e, _ in others):
            others.append((start, end, -minus))
    return sorted(((name, likeness, start, end) for name, spans in kept.items() for start, end, likeness in spans),
                  key=lambda x: (x[2], x[3], x[0]))


def find(docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES,
         threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """The documents with ``found`` (licence, dice, start, end of each match, in code points).

    ``columns``: the input columns to carry (all).
    """
    made = Templates(list(templates), threshold)

    @F.pandas_udf(FOUND)
    def scanned(texts: pd.Series) -> pd.Series:
        names = ("licence", "dice", "start", "end")
        return pd.Series([[dict(zip(names, x)) for x in scan(t, made)] for t in texts])

    carried = [c for c in (docs.columns if columns is None else columns) if c != "found"]
    return docs.select(*carried, scanned(F.coalesce(F.col(text), F.lit(""))).alias("found"))
