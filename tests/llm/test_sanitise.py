import hashlib
import math
import re
from collections import Counter

import pytest

from recordloom.llm import sanitise

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def ok(kind, match):
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def brute_base(text):
    found = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            if ok(kind, m.group()):
                found.append((m.start(), k, m.end()))
    return sorted(found)


def written(spans, names):
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def brute_terms(rows, disclose, support):
    """{text: spans of disclosing terms}, by the formulas over all documents."""
    rows = [t or "" for t in rows]
    copies, n = Counter(rows), len(rows)
    words = {t: set(re.findall(r"[^\W_]{3,}", t.lower())) for t in copies}
    named, masked = {}, {}
    for t in copies:
        chars, ents = list(t), set()
        for s, k, e in brute_base(t):
            raw = t[s:e]
            ents.add((k, raw.lower() if k < 2 else re.sub(r"[^0-9]", "", raw)))
            chars[s:e] = " " * (e - s)
        if ents:
            named[t], masked[t] = ents, "".join(chars)
    inside = {t: set(re.findall(r"[^\W_]{3,}", masked[t].lower())) for t in named}
    out = {}
    for t in named:
        gone, every = set(), set()
        for c in named[t]:
            with_c = [x for x in named if c in named[x]]
            n_c = sum(copies[x] for x in with_c)
            for w in inside[t]:
                both = [x for x in with_c if w in inside[x]]
                if len(both) < support or n_c == n:
                    continue
                n_both = sum(copies[x] for x in both)
                alone = max(n_both, sum(m for x, m in copies.items() if w in words[x]))
                if math.log(n * n_both / (n_c * alone)) >= disclose * math.log(n / n_c) - 1e-12:
                    every.add(w)
                    if n_both >= alone:
                        gone.add(w)
        if every:
            out[t] = [(m.start(), 4 if m.group().lower() in gone else 5, m.end())
                      for m in re.finditer(r"[^\W_]+", masked[t]) if m.group().lower() in every]
    return out


ROWS = [
    (1, "write to anna.b@mail.example.com or 10.0.0.255 now"),
    (2, "card 4785380592391139 and 4785-3805-9239-1139, bad 4785380592391138"),
    (3, "call +1 (743) 555-3824 éü 😀 x@y.z_w@q.r 1.2.3.4.5 256.1.1.1"),
    (4, None), (5, ""), (6, "a" * 60000 + " " + "1" * 30000 + "@" + ".1" * 200),
    (7, "no data here"), (7, "no data here"),
    (8, "0" * 14 + " 00 0 " + "+1234567890 +12 345"),
    (9, "agent zephyr kestrel met bob@x.org at noon"),
    (10, "zephyr wrote bob@x.org about kestrel rain"),
    (11, "again Zephyr kestrel BOB@x.org rain"),
    (11, "again Zephyr kestrel BOB@x.org rain"), (9, "agent zephyr kestrel met bob@x.org at noon"),
    (12, "rain in town and more rain"), (13, "kestrel alone here"), (14, "nothing"), (15, "plain words"),
    (16, "text sixteen"), (17, "text seventeen"), (18, "text eighteen"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, spans string")


def test_equal_to_brute_force(spark, docs):
    got = sanitise.find(docs, disclose=0.6, support=3).collect()
    terms = brute_terms([t for _, t in ROWS], 0.6, 3)
    assert any(terms.values())
    names = KINDS + ["term", "broad"]
    want = []
    for i, t in ROWS:
        base = brute_base(t)
        both = sorted(base + terms.get(t or "", []))
        want.append((i, *(sum(k == j for _, k, _ in base) for j in range(4)),
                     hashlib.sha256(written(base, names).encode()).hexdigest(), written(both, names)))
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in got) == sorted(want)


def test_text_is_cleaned(docs):
    got = {r.doc_id: r.text for r in sanitise.sanitise(docs, disclose=0.6).collect()}
    assert got[1] == "write to [EMAIL] or [IP] now"
    assert got[4] is None and got[7] == "no data here"
    assert "zephyr" not in got[9].lower() and "[EMAIL]" in got[9]


def test_empty_table(spark, docs):
    assert sanitise.find(docs.where("false")).count() == 0


def test_given_documents(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    rows = spark.read.parquet(path).select("doc_id", "text").collect()
    got = {r.doc_id: r for r in sanitise.find(spark.read.parquet(path), columns=["doc_id"]).collect()}
    terms = brute_terms([r.text for r in rows], 0.9, 3)
    names = KINDS + ["term", "broad"]
    for r in rows:
        base = brute_base(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(written(base, names).encode()).hexdigest()
        assert got[r.doc_id].spans == written(sorted(base + terms.get(r.text or "", [])), names)


def test_same_result_without_broadcast(docs, monkeypatch):
    want = sorted(r.spans for r in sanitise.find(docs, disclose=0.6, support=3).collect())
    monkeypatch.setattr(sanitise, "MOST_TERMS", 0)
    assert sorted(r.spans for r in sanitise.find(docs, disclose=0.6, support=3).collect()) == want


def test_rare_entities_and_terms_in_other_texts(spark):
    rows = [(k, "mail ann@x.org of wombat") for k in range(5)] + [(k, f"filler words {k} mail of") for k in range(10, 60)]
    rows += [(60, "quokka has bob@x.org first"), (61, "write bob@x.org or quokka"), (62, "a Quokka elsewhere, cat@x.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in sanitise.sanitise(docs, disclose=0.8, support=2, by="documents", everywhere=True).collect()}
    assert all(got[k] == "mail [EMAIL] of " for k in range(5))
    assert got[60] == "[WORD] has [EMAIL] first" and got[61] == "write [EMAIL] or [WORD]"
    assert got[62] == "a [WORD] elsewhere, [EMAIL]" and got[10] == "filler words 10 mail of"
