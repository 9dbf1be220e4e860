import re
from collections import Counter, defaultdict

from recordloom.llm import line_quality

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_base(text):
    t = text or ""
    words = [w for w in SPACE.split(t) if w]
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    covered = {p for k, w in enumerate(windows) if often[w] > 1 for p in range(k, k + 8)}
    lines = [x for x in t.split("\n") if SPACE.sub("", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def brute_kept(rows, max_docs, share):
    """{(host, text): (removed words, kept)}; lines by the module's hash only to break ties."""
    import hashlib
    texts = {(h, t or "") for h, t in rows}
    norm = lambda t: [x for x in (re.sub(r"[\x20\x09\x0B-\x0D]+", " ", y).strip(" ") for y in t.lower().split("\n")) if x]
    lines = {k: Counter(norm(k[1])) for k in texts}
    docs = Counter((k[0], x) for k, c in lines.items() for x in c)
    with_ = defaultdict(set)
    for k, c in lines.items():
        wide = sorted((x for x in c if docs[k[0], x] > max_docs),
                      key=lambda x: (-docs[k[0], x], int(hashlib.md5(x.encode()).hexdigest()[:15], 16)))
        for j, x in enumerate(wide):
            other = wide[1 if j == 0 else 0] if len(wide) > 1 else None
            with_[k[0], x].add(("line", other) if other else ("text", k[1]))
    out = {}
    for k, c in lines.items():
        n = sum(len(x.split(" ")) * m for x, m in c.items() if len(with_[k[0], x]) > max_docs)
        words, *_, failed = brute_base(k[1])
        out[k] = (n, not failed and (n == 0 or (words - n >= 20 and words - n >= share * words)))
    return out


def rows():
    prose = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    out = [(k, "h1", f"Accept   all COOKIES now\n{prose(k, 25)}") for k in range(6)]
    out += [(10 + k, "h1", f"accept all cookies now\nshort text {k} " + prose(99, 14)) for k in range(3)]
    out += [(20 + k, "h1", "\n".join(prose(f"c{j}", 9) for j in range(5)) + f"\nedited {k}") for k in range(9)]  # near copies
    out += [(40, "h2", "Accept all cookies now\n" + prose(7, 30)), (41, None, None), (42, None, ""), (43, "h2", " \n\t ")]
    out += [(44, "h1", prose(44, 9) + " " + prose(44, 9) + " tail " + prose(45, 9)), (45, "h2", "é😀 " * 30 + "#$|<>")]
    out += [(46, "h1", "same line\nsame line\n" * 12), (47, "h1", prose(47, 25)), (47, "h1", prose(47, 25))]
    out += [(48, None, "word " * 60000)]
    return out


def test_equal_to_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(i, h, t, "clash", 5) for i, h, t in data],
                                 "doc_id long, source string, text string, kept string, n_words int")
    got = line_quality.judge(docs, max_docs=3).collect()
    verdict = brute_kept([(h, t) for _, h, t in data], 3, 0.5)
    want = sorted((i, *brute_base(t), *verdict[h, t or ""]) for i, h, t in data)
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                   r.n_removed_words, r.kept) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[k].kept and by_id[k].n_removed_words == 4 for k in range(6))
    assert not by_id[10].kept or by_id[10].n_removed_words  # boilerplate is most of it
    assert all(by_id[20 + k].kept for k in range(9))  # near copies stay, for de-duplication


def test_clean_removes_lines(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in line_quality.clean(docs, max_docs=3).collect()}
    assert got[0].startswith("w0x0") and got[40].startswith("Accept")
    assert 41 not in got and got[20].endswith("edited 0")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert line_quality.judge(docs).count() == 0 and line_quality.clean(docs).count() == 0


def test_lines_that_stand_together_in_unrelated_documents(spark):
    prose = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    notice = "some notice stands here\nand goes on"
    rows = [(k, "h", prose(k, 40) + "\n" + notice) for k in range(100)]
    long = "\n".join(prose(f"f{j}", 10) for j in range(3))  # more than half of its pages, which are unrelated
    rows += [(200 + k, "h", prose(200 + k, 20) + "\n" + long) for k in range(50)]
    base = [prose(f"b{j}", 20).split() for j in range(8)]  # near copies with a word changed in three of eight lines
    for k in range(60):
        lines = [list(x) for x in base]
        for j in range(3):
            lines[(k + 3 * j) % 8][k % 20] = f"e{k}x{j}"
        rows.append((300 + k, "h", "\n".join(map(" ".join, lines))))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in line_quality.judge(docs, columns=["doc_id"]).collect()}
    assert all(got[k].n_removed_words == 7 and got[k].kept for k in range(100))
    assert all(got[200 + k].n_removed_words == 30 and not got[200 + k].kept for k in range(50))
    assert all(got[300 + k].n_removed_words == 0 and got[300 + k].kept for k in range(60))
    assert {r.text for r in line_quality.clean(docs).where("doc_id < 100").collect()} == {prose(k, 40) for k in range(100)}
