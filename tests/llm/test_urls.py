"""Op 4 against plain Python and DuckDB."""

import re

import pytest

from tessera.llm import urls
from tessera.llm.queries import ORACLE, QUERIES

from .oracle import same


def brute(u):
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    host = re.match(r"[^/?#]*", rest)[0]
    after = rest[len(host) :]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = re.match(r"[^?#]*", after)[0]
    fits = [(len(h + p), h + p, v) for h, p, v in urls.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    w = host + after
    label = any(re.match(rf"(?:[^/]*\.)?{x}(?![0-9A-Za-z])", w, re.S) for x in ("spam-farm", "cheap-pills", "casino"))
    bad = label or re.search(r"/(login|cart)(?![0-9A-Za-z])", w) or "?sessionid=" in w or re.search(r"[^0-9A-Za-z]adserver(?![0-9A-Za-z])", w)
    return host, path, None, "block" if bad else "allow"


URLS = [
    None, "", "no scheme/x", "http://", "http://ORG", "http://org/", "http://org?x", "http://a.org/x", "http://aorg/", "http://a.org:80/", "http://EXAMPLE.org/es/1", "http://example.org/es",
    "http://b.example.org/en/1999#x", "http://example.org/EN/1", "http://x.com/fr/", "http://com/de/", "http://x.com/de", "http://u@x.com/de/?a=://b.org/", "ftp://a://b.org/c", "http://É.org/ü\nq",
    "http://spam-farm.example.net/", "http://a.spam-farm", "http://spam-farms.net/", "http://x.net/a/login", "http://x.net/logins", "http://x.net/?sessionid=3", "http://x.net/p?u=adserver", "http://x.net/casino.html", "http://casino.net/" + "y" * 50000,
]


def test_edges(spark):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS + URLS[:9])] + [(None, "http://a.org/", "z")], "page_id long, url string, host string")
    got = sorted((repr(r.page_id), r.host, r.path, r.rule, r.verdict) for r in urls.judged(df).collect())
    assert got == sorted((repr(i), *brute(u)) for i, u in [*enumerate(URLS + URLS[:9]), (None, "http://a.org/")])
    assert urls.judged(df.limit(0)).collect() == []
    assert {r.verdict for r in urls.judged(df, host_rules=[], patterns=[]).collect()} == {"allow"}


@pytest.mark.parametrize("host_rules, patterns", [(urls.HOST_RULES, urls.PATTERNS), (urls.HOST_RULES, []), ([], urls.PATTERNS)])
def test_rules_as_a_table_give_the_same(spark, host_rules, patterns):
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS + URLS[:9])] + [(None, "http://a.org/", "z")], "page_id long, url string, `a.b` string")
    rows = lambda most: sorted(map(repr, urls.judged(df, host_rules=host_rules, patterns=patterns, most_bytes=most).collect()))
    assert rows(0) == rows(urls.MOST_BYTES)
    assert urls.judged(df.limit(0), most_bytes=0).collect() == []


def test_more_rules_than_the_plan_takes(spark):
    """80,000 rules, 5 MB: two in three hosts have one, and the longer path wins."""
    rules = [(f"host{i}.example.org", p, v) for i in range(40_000) for p, v in (("/", "block"), (f"/open{i}/", "allow"))]
    patterns = [("/login^", "block")]
    assert sum(len(x["regex"]) + sum(map(len, x["tokens"])) for x in (urls.host_rule(*r) for r in rules)) > urls.MOST_BYTES
    pages = [f"http://sub.host{i}.example.org/{p}" for i in range(0, 60_000, 1000) for p in (f"open{i}/x", f"open{i + 1}/x", "login")]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judged(df, host_rules=rules, patterns=patterns).collect()}
    for k, u in enumerate(pages):
        host, path = u[len("http://sub.") :].split("/", 1)
        i = int(host[4:].split(".")[0])
        if i < 40_000:
            p, v = (f"/open{i}/", "allow") if path == f"open{i}/x" else ("/", "block")
            assert got[k] == (host + p, v)
        else:
            assert got[k] == (None, "block" if path == "login" else "allow")


def test_rules_need_a_token():
    with pytest.raises(ValueError):
        urls.pattern_rule("*a*", "block")


def test_query(spark):
    same(spark, "/root/testdata/sf0.01", QUERIES["op4_url_filter"], ORACLE["op4_url_filter"])
