"""URL rules against brute force; reputation against its definition in plain Python."""

from collections import defaultdict

import pytest
from lamella.llm import queries, url_filter
from pyspark.sql import functions as F

RULES = queries.URL_RULES
URLS = [
    "http://A.Example.com/en/7?x#y", "https://example.com/en/8", "http://b.example.net/de/81", "http://net/de/", "ftp://x.org/es/a/b", "http://x.org/ES/", "http://com", "no scheme", None,
    "http://example.community/en/1", "HTTP://notexample.com/en/75", "https://example.com?q=://other.net/de/", "a://b://c/d", "http://x.co.uk/en/", "http:///en/", "http://h\n.com/en/\n", "https://example.com/en/7",
    "https://example.com/en/7",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[n:]
    m = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), tail[:m]


def rule_of(host, path):
    fits = [(h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "z", "w") for i, u in enumerate(URLS)], "page_id long, url string, rule string, mean string")
    got = url_filter.judge(pages, RULES, spark.createDataFrame([("http://q.net/", None)], "url string, bad boolean")).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path = split(URLS[r["page_id"]])
        rule, action = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, action or "allow")
    none = url_filter.judge(pages.limit(0), RULES, spark.createDataFrame([], "url string, bad boolean"))
    assert none.count() == 0


def fit(rows):
    """rows: (n, bad, above)."""
    some = [(n, b, m) for n, b, m in rows if n >= 2]
    size = sum(m * (1 - m) * (n - 1) for n, _, m in some)
    rho = (sum(n * (b / n - m) ** 2 for n, b, m in some) - sum(m * (1 - m) for _, _, m in some)) / size if size else -1
    return max(1.0, min(1000.0, 1 / rho - 1)) if rho > 0 else 1000.0


def test_reputation(spark):
    seen = []
    for i in range(12):
        seen += [(f"http://h{i}.d{i % 4}.{'com' if i % 2 else 'co.uk'}/p", j % (i + 2) == 0) for j in range(3 * i + 1)]
    seen += [("http://spam.bad.com/x", True)] * 60 + [("http://good.fine.org/", False)] * 40
    host = defaultdict(lambda: [0, 0])
    for u, b in seen:
        host[split(u)[0]][0] += 1
        host[split(u)[0]][1] += b
    name = lambda h, k: ".".join(h.split(".")[-(k + h.endswith(".co.uk")) :])
    mean = (sum(b for _, b in seen) + 0.5) / (len(seen) + 1)
    above = dict.fromkeys({name(h, 1) for h in host}, mean)
    post = {}
    for k in (1, 2, None):
        counts = defaultdict(lambda: [0, 0])
        for h, (n, b) in host.items():
            key = h if k is None else name(h, k)
            counts[key][0] += n
            counts[key][1] += b
        if k == 2:
            above = {x: post[name(x, 1)][0] for x in counts}
        elif k is None:
            above = {x: post[name(x, 2)][0] for x in counts}
        prior = fit([(n, b, above[x]) for x, (n, b) in counts.items()])
        post |= {x: ((b + prior * above[x]) / (n + prior), n + prior) for x, (n, b) in counts.items()}
    urls = [u for u, _ in seen] + ["http://new.d1.com/", "http://new.new.com/", "http://a.b.xyz/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, [], spark.createDataFrame(seen, "url string, bad boolean")).collect()
    for r in got:
        h = split(urls[r["page_id"]])[0]
        m, s = next((post[x] for x in (h, name(h, 2), name(h, 1)) if x in post), (mean, len(seen) + 1.0))
        assert r["bad_rate"] == pytest.approx(m)
        bound = m - 1.645 * (m * (1 - m) / (s + 1)) ** 0.5
        assert r["bad_bound"] == pytest.approx(bound) and r["verdict"] == ("block" if bound > 0.5 else "allow")
    verdicts = {r["host"]: r["verdict"] for r in got}
    assert verdicts["spam.bad.com"] == "block" and verdicts["good.fine.org"] == "allow"


def test_suffixes_are_an_input(spark):
    hosts = ["a.b.example", "x.b.example", "b.example", "x.y.deep.b.example", "deep.b.example", "c.com", "com", ""]
    known = ["b.example", "deep.b.example"]
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = url_filter.domain_of(F.col("host"), known)
    got = [tuple(r) for r in rows.coalesce(1).select("host", domain, suffix).collect()]
    assert got == [
        ("a.b.example", "a.b.example", "b.example"), ("x.b.example", "x.b.example", "b.example"), ("b.example", "b.example", "b.example"), ("x.y.deep.b.example", "y.deep.b.example", "deep.b.example"),
        ("deep.b.example", "deep.b.example", "deep.b.example"), ("c.com", "c.com", "com"), ("com", "com", "com"), ("", "", ""),
    ]


def test_the_plan_is_short(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    out = url_filter.judge(pages, RULES, spark.createDataFrame([("http://a.com/", True)], "url string, bad boolean"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") < 40
