import datetime as dt
import random

from recordloom.llm import url_lists

DAY = dt.date(2024, 1, 1)


def brute(captures, entries):
    """Replay the log for each capture."""
    out = []
    for k, url, at in captures:
        active = {}
        if url and at and "://" in url:
            rest = url.strip().split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host = rest[:cut].rpartition("@")[2].partition(":")[0].lower().rstrip(".")
            path = rest[cut:].split("?")[0].split("#")[0] or "/"
            if host:
                for kind, value, dated, action in sorted(
                        (e for e in entries if None not in e and e[3] in ("add", "remove")), key=lambda e: (e[2], e[3])):
                    value = value.lower()
                    hit = {"host": host == value, "domain": host == value or host.endswith("." + value),
                           "prefix": (host + path).startswith(value) and (value.endswith("/") or host + path == value)}[kind]
                    if hit and dated <= at:
                        if action == "add":
                            active[kind, value] = dated
                        else:
                            active.pop((kind, value), None)
        order = sorted(active, key=lambda x: ({"prefix": 3, "host": 2, "domain": 1}[x[0]], len(x[1]), x[1]))
        top = order[-1] if order else None
        out.append((k, bool(top), ":".join(top) if top else None, active[top] if top else None, len(active)))
    return sorted(out, key=str)


def test_equal_to_replay(spark):
    rnd = random.Random(3)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "xa.com"]
    day = lambda: DAY + dt.timedelta(days=rnd.randrange(400))
    entries = [(kind, value, day(), rnd.choice(["add", "add", "remove"])) for _ in range(120)
               for kind, value in [rnd.choice([("host", rnd.choice(hosts)), ("domain", rnd.choice(hosts)),
                                               ("prefix", rnd.choice(hosts) + rnd.choice(["/", "/p/", "/p/q", "/p/q/"]))])]]
    entries += entries[:5] + [("host", None, DAY, "add"), ("host", "b.org", None, "add"), ("host", "B.ORG", DAY, "add"),
                              ("host", "b.org", DAY, "remove"), ("domain", "a.com", DAY, None)]
    urls = [f"{s}://{u}{h}{p}{q}" for s in ("http", "HTTPS") for u in ("", "me@") for h in hosts + ["Y.X.A.com.", "b.org:80"]
            for p in ("", "/", "/p", "/p/q", "/p/q/r.html", "/P/q") for q in ("", "?x=/p/", "#f")]
    captures = [(k, rnd.choice(urls), day()) for k in range(500)]
    captures += [(900, None, DAY), (901, "http://a.com/", None), (902, "nonsense", DAY), (903, "", DAY), (904, "http:///x", DAY)]
    captures += [captures[0], captures[0], (None, captures[1][1], captures[1][2])]
    c = spark.createDataFrame([(k, u, t, "x") for k, u, t in captures], "page_id long, url string, fetched_on date, rule string")
    e = spark.createDataFrame(entries, "kind string, value string, dated date, action string")
    got = sorted(((r.page_id, r.blocked, r.rule, r.listed_from, r.n_active) for r in url_lists.judge(c, e).collect()), key=str)
    want = brute(captures, entries)
    assert got == want and any(x[4] > 1 for x in got)
    assert {r.blocked for r in url_lists.judge(c, e.where("false")).collect()} == {False}
    assert url_lists.judge(c.where("false"), e).count() == 0


def test_paths_of_prefixes_keep_their_case(spark):
    e = spark.createDataFrame([("prefix", "A.com/Ads/", DAY, "add"), ("host", "B.ORG", DAY, "add")],
                              "kind string, value string, dated date, action string")
    c = spark.createDataFrame([(1, "https://a.com/Ads/x", DAY), (2, "https://a.com/ads/x", DAY), (3, "http://b.org/", DAY)],
                              "page_id long, url string, fetched_on date")
    assert {r.page_id: r.rule for r in url_lists.judge(c, e).collect()} == {1: "prefix:a.com/Ads/", 2: None, 3: "host:b.org"}
