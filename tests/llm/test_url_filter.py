"""Addresses, rules and reputations of urls against plain Python."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import url_filter as U
from millrace.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://A.Example.COM", "https://www.example.com/en/1?x=/net/", "http://example.com/en/", "http://sub.example.com/en", "http://notexample.com/en/a", "https://x.net/es/1#a",
    "https://x.net?q=/es/", "http://x.net#/es/", "http://net/fr/", "ftp://u:p@h.co.uk:8080/a?b://c/d", "a://b://c/d", "http://10.0.0.1/en/", "http://ÄB.Org/É?ü", "http://org.", "http://a\nb.org/x\ny?z", "http://xcom/", "http://com/",
]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def plain_rule(host, path, rules):
    fit = [(len(r), k, r) for k, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])]
    return max(fit)[1:] if fit else (None, None)


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", 1, 2, "v") for i, u in enumerate(urls)], "page_id long, url string, host string, n int, bad int, verdict string")


def counts(spark, rows):
    return spark.createDataFrame(rows, "host string, n long, bad long")


def test_addresses_and_rules(spark):
    got = U.url_filter(pages(spark, URLS * 2), counts(spark, []), URL_RULES).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path = plain(URLS[r.page_id % len(URLS)])
        kind, rule = plain_rule(host, path, URL_RULES)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, kind or "allow")


def test_parents(spark):
    got = {h: (d, s) for h, d, s in spark.createDataFrame([(h,) for h in ("a.b.example.com", "example.com", "com", "", "x.y.co.uk", "y.co.uk", "co.uk", "10.0.0.1", "u:p@w.example.org:80", "example.org.")], "h string").select("h", *U.parents(F.col("h"))).collect()}
    assert got == {
        "a.b.example.com": ("example.com", "com"), "example.com": ("example.com", "com"), "com": ("com", "com"), "": ("", ""), "x.y.co.uk": ("y.co.uk", "co.uk"), "y.co.uk": ("y.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
        "10.0.0.1": ("10.0.0.1", ""), "u:p@w.example.org:80": ("example.org", "org"), "example.org.": ("example.org", "org"),
    }


@pytest.mark.parametrize("a,b", [(1, 1), (0.3, 0.6), (2, 40), (700, 690), (2e5, 3e5)])
def test_beta_tail(a, b):
    """Against the midpoint rule, after a substitution that takes the ends' poles away."""
    u = (np.arange(2_000_000) + 0.5) / 2_000_000
    x = u**4 / (u**4 + (1 - u) ** 4)
    w = a * np.log(x) + b * np.log1p(-x) + np.log(4 / u + 4 / (1 - u))  # density times dx/du, up to a factor
    w = np.exp(w - w.max())
    for at in (0.2, 0.5, 0.51):
        assert U.beta_above(np.array([a]), np.array([b]), at)[0] == pytest.approx(w[x > at].sum() / w.sum(), abs=2e-5)
    assert U.log_gamma(np.array([a]))[0] == pytest.approx(math.lgamma(a), rel=1e-10, abs=1e-10)


def strength(kids):
    """kids: (x, n, parent's x, parent's n)."""
    kids = [k for k in kids if k[1] > 0]
    over = room = 0.0
    for px, pn in {k[2:] for k in kids}:
        own = [k for k in kids if k[2:] == (px, pn)]
        p = px / pn
        over += sum(n * (x / n - p) ** 2 for x, n, *_ in own) - p * (1 - p) * (len(own) - 1)
        room += p * (1 - p) * (pn - sum(n * n for _, n, *_ in own) / pn - (len(own) - 1))
    return U.PRIOR if room <= 0 else U.MOST if over <= 0 else min(U.MOST, max(U.LEAST, room / over - 1))


def test_reputations(spark):
    """Bad hosts with evidence are blocked, alike ones without much are not, and unknown ones take their domain's rate."""
    rng = np.random.default_rng(3)
    rows = [(f"h{i}.{'farm' if i % 5 == 0 else f'good{i % 7}'}.{'net' if i % 2 else 'com'}", int(n), int(rng.binomial(n, 0.9 if i % 5 == 0 else 0.1))) for i, n in enumerate(rng.integers(1, 60, 200))]
    rows += [("new.farm.com", 0, 0), ("one.lonely.org", 1, 1), ("new.good1.com", None, None), *rows[:20]]
    got = {r.host: r for r in U.reputations(counts(spark, rows)).collect()}
    h = {}
    for host, n, x in rows:
        h[host] = (h.get(host, (0, 0))[0] + (n or 0), h.get(host, (0, 0))[1] + (x or 0))
    up = lambda t, cut: {k: (sum(n for a, (n, _) in t.items() if cut(a) == k), sum(x for a, (_, x) in t.items() if cut(a) == k)) for k in {cut(a) for a in t}}
    dom, suf = lambda a: ".".join(a.split(".")[-2:]), lambda a: a.split(".")[-1]
    d = up(h, dom)
    s = up(d, suf)
    gn, gx = map(sum, zip(*s.values(), strict=True))
    top = strength([(x, n, gx, gn) for n, x in s.values()])
    middle = strength([(x, n, s[suf(k)][1], s[suf(k)][0]) for k, (n, x) in d.items()])
    low = strength([(x, n, d[dom(k)][1], d[dom(k)][0]) for k, (n, x) in h.items()])
    assert set(got) == set(h)
    for k, (n, x) in h.items():
        (dn, dx), (sn, sx) = d[dom(k)], s[suf(k)]
        ps = (sx - dx + top * (gx + 0.5) / (gn + 1)) / (sn - dn + top)
        pd = (dx - x + middle * ps) / (dn - n + middle)
        assert got[k].rate == pytest.approx((low * pd + x) / (low + n), rel=1e-9)
    farm = [r for k, r in got.items() if ".farm." in k and h[k][0] > 10]
    assert farm and all(r.verdict == "block" for r in farm)
    assert all(r.verdict == "allow" for k, r in got.items() if ".good" in k) and got["one.lonely.org"].verdict == "allow"
    assert got["new.farm.com"].rate > 0.7 > 0.4 > got["new.good1.com"].rate


def test_without_broadcast_and_empty(spark, monkeypatch):
    urls = ["http://a.x.net/q"] * 50 + ["http://b.x.net/q", None]
    out = counts(spark, [("a.x.net", 40, 40), ("b.x.net", 40, 38), ("c.y.org", 90, 0), ("d.z.org", 70, 1), (None, 5, 5)])
    want = sorted(map(str, U.url_filter(pages(spark, urls), out, [("allow", "b.x.net/")]).collect()))
    monkeypatch.setattr(U.C, "BROADCAST_ROWS", 0)
    assert sorted(map(str, U.url_filter(pages(spark, urls), out, [("allow", "b.x.net/")]).collect())) == want
    assert sum("verdict='block'" in r and "rule=None" in r for r in want) == 50
    assert U.url_filter(pages(spark, urls).limit(0), out, URL_RULES).count() == 0


def test_page_outcomes(spark):
    p = pages(spark, ["http://a.com/en/1", "http://a.com/en/1", "http://A.com/en/2", "http://b.com/en/3", "http://b.com/x", None, "http://b.com/en/99999999999999999999"])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, None, 1), (4, 0, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = U.page_outcomes(p, labels, F.regexp_extract(U.address(F.col("url"))[1], r"/([0-9]+)$", 1)).collect()
    assert sorted(map(tuple, got)) == [("a.com", 3, 2), ("b.com", 1, 1)]
