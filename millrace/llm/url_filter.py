"""URL filter: rules where there are any, and else the reputation of the host, shrunk from its registered domain and suffix by empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import common as C

#: Public suffixes of more than one label that are told apart unless others are given.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.br", "org.br", "gov.br", "com.au", "com.ar", "com.mx", "co.jp", "co.in", "co.nz", "co.za")
#: Prior counts of a level whose children cannot tell them, and the bounds within which they are estimated.
PRIOR, LEAST, MOST = 10.0, 1.0, 10_000.0


def address(url: Column) -> tuple[Column, Column]:
    """Host and path: from after the first '://' up to '/', '?', '#' or the end, A to Z lower-cased, and from there up to '?', '#' or the end; empty where
    the url is null or has no '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def parents(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host, without user and port. The suffix is the last label, or the last two where they are one of `suffixes`; the
    domain has one label more. A host of one label is its own domain and suffix; an IPv4 address is its own domain and has no suffix."""
    name = F.rtrim(F.regexp_replace(host, r"^.*@|:\d*$", ""), F.lit("."))
    two, one = F.substring_index(name, ".", -2), F.substring_index(name, ".", -1)
    long = two.isin(list(suffixes)) if suffixes else F.lit(False)
    number = name.rlike(r"^\d+(\.\d+){3}$")
    return F.when(number, name).when(long, F.substring_index(name, ".", -3)).otherwise(two), F.when(number, "").when(long, two).otherwise(one)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (verdict, 'host/path-prefix') that fits, and its verdict; null where none does. A rule fits its host and all subdomains, if the path
    starts with its own. Of equally long rules a block goes first, then the alphabet decides."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", [-ord(c) for c in r[1]])):  # the best is asked first
        name, slash, prefix = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + prefix))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma of positive numbers: Stirling's series from 10 on, smaller arguments raised there by the recurrence."""
    x, less = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(10):
        small = x < 10
        less[small] += np.log(x[small])
        x[small] += 1
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - less


def beta_above(a: np.ndarray, b: np.ndarray, at: float) -> np.ndarray:
    """The probability that a Beta(a, b) number is above `at`, 0 < at < 1, by the continued fraction of the incomplete beta function."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    turned = at > (a + 1) / (a + b + 2)  # there the fraction of the other tail converges faster
    p, q, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - at, at)
    scale = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(x) + q * np.log1p(-x)) / p
    tiny = 1e-300
    whole = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    d = 1 / whole(1 - (p + q) * x / (p + 1))
    c, value, m = np.ones_like(p), d.copy(), 0
    while len(p):
        m += 1
        before = value
        even = m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))
        for term in (even, odd):
            d, c = 1 / whole(1 + term * d), whole(1 + term / c)
            value = value * d * c
        if np.all(np.abs(value - before) <= 1e-14 * np.abs(value)):
            break
    below = np.clip(scale * value, 0, 1)
    return np.where(turned, below, 1 - below)


def _strength(children: DataFrame, x: str, n: str, px: str, pn: str, parent: list[str]) -> float:
    """Prior counts with which children agree with their parents' rates, by moments: how much more the children's rates spread around their parent's than
    draws from that alone would. One row a parent is left after partial aggregation, one row reaches the driver."""
    p = F.try_divide(px, pn)
    g = children.where(F.col(n) > 0).groupBy(*parent, px, pn).agg(F.count("*").alias("k"), F.sum(F.try_divide(F.col(x) * F.col(x), F.col(n))).alias("s"), F.sum(F.col(n).cast("double") * F.col(n)).alias("q"))
    v, free = p * (1 - p), F.col("k") - 1
    r = g.agg(F.sum(F.col("s") - F.col(px) * p - v * free).alias("over"), F.sum(v * (F.col(pn) - F.try_divide("q", pn) - free)).alias("room")).first()
    if not r.room or r.room <= 0:
        return PRIOR
    return MOST if r.over <= 0 else min(MOST, max(LEAST, r.room / r.over - 1))


def _judged(threshold: float, confidence: float):
    """block or allow of each host, by whether enough of its posterior lies above the threshold."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                a, o = (b.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))
                above = beta_above(a, o, threshold)
                yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(a / (a + o)), pa.array(above), pa.array(np.where(above >= confidence, "block", "allow"))], ["host", "rate", "p_bad", "verdict"])

    return C.lean(run)


def reputations(counts: DataFrame, threshold: float = 0.5, confidence: float = 0.95, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, rate, p_bad, verdict) for a table (host, n, bad) of how many labelled pages hosts have and how many of them are bad; n may be 0.

    A host's bad rate has a beta prior around the rate of its registered domain, that one around its suffix's, and that around the rate of all; each level's
    prior counts come from how much its children differ, and each mean leaves out what the child itself contributes. A host is blocked if its posterior says
    with the given confidence that more than `threshold` of its pages are bad: the bound, not the mean, decides, so little evidence blocks nothing.
    """
    h = counts.groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
    domain, suffix = parents(F.col("host"), suffixes)
    h = C.written(h.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    d = C.written(h.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("x").alias("dx")), "domains")
    s = C.written(d.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dx").alias("sx")), "suffixes")
    whole = s.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("n"), F.coalesce(F.sum("sx"), F.lit(0)).alias("x")).first()
    few = lambda t: F.broadcast(t) if t.count() <= C.BROADCAST_ROWS else t
    ds = d.join(few(s), "suffix")
    hd = h.join(few(ds), ["domain", "suffix"])
    rate = (whole.x + 0.5) / (whole.n + 1)
    top = _strength(s.withColumns({"gn": F.lit(whole.n), "gx": F.lit(whole.x)}), "sx", "sn", "gx", "gn", [])
    middle = _strength(ds, "dx", "dn", "sx", "sn", ["suffix"])
    low = _strength(hd, "x", "n", "dx", "dn", ["domain", "suffix"])
    of_suffix = (F.col("sx") - F.col("dx") + top * rate) / (F.col("sn") - F.col("dn") + top)
    of_domain = (F.col("dx") - F.col("x") + middle * of_suffix) / (F.col("dn") - F.col("n") + middle)
    ab = hd.select("host", (low * of_domain + F.col("x")).alias("a"), (low * (1 - of_domain) + F.col("n") - F.col("x")).alias("b"))
    return ab.mapInArrow(_judged(threshold, confidence), "host string, rate double, p_bad double, verdict string")


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), threshold: float = 0.5, confidence: float = 0.95, suffixes: Sequence[str] = SUFFIXES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, rate, p_bad) of every page: the longest fitting rule's verdict, and where no rule fits that of `reputations`.

    outcomes: (host, n, bad), labelled pages summed up by host in as many rows as one likes; hosts without any take the reputation of their domain or suffix.
    Only host names are counted and joined; the pages are read twice, their id and url only, and never shuffled while the hosts are few. With more hosts
    Spark joins them by a shuffle in which it can split a common host.

    Defined results: a null url, or one without '://', has an empty host and path, which is a host like any other; null ids and repeated rows keep their rows;
    null counts are 0; further columns are not read; empty tables give an empty result, and without outcomes nothing but rules blocks.
    """
    host, path = address(F.col(url_col).cast("string"))
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    seen = p.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    given = outcomes.where("host is not null").select("host", F.col("n").cast("long").alias("n"), F.col("bad").cast("long").alias("bad"))
    table = C.written(reputations(seen.unionByName(given), threshold, confidence, suffixes), "reputations").withColumnsRenamed({"host": "_host", "verdict": "_verdict"})
    judged = p.join(F.broadcast(table) if table.count() <= C.BROADCAST_ROWS else table, F.col("host") == F.col("_host"), "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "_verdict").alias("verdict"), "rate", "p_bad")


def page_outcomes(pages: DataFrame, labels: DataFrame, document: Column, url_col: str = "url") -> DataFrame:
    """(host, n, bad): labelled pages by host, where `document` is the id of the document that a page shows, as text. A page is bad if its document is of low quality or
    toxic; several labels of one document count as one, bad if one of them is. Pages are summed up by host and document before they meet the labels."""
    host, _ = address(F.col(url_col).cast("string"))
    shown = pages.select(host.alias("host"), document.try_cast("long").alias("_doc")).where("_doc is not null").groupBy("host", "_doc").agg(F.count("*").alias("_n"))
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("_bad")
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("_doc")).agg(bad)
    return shown.join(known, "_doc").groupBy("host").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_bad")).alias("bad"))
