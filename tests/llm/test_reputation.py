from __future__ import annotations

import re

import pytest

from aislewise.llm import reputation
from tests.compare import SMALL, difference

URLS = [
    None, "", "no scheme", "http://Example.NET/en/x?y#z", "http://a.example.net/en", "http://example.net/de/", "https://example.com/de/a", "https://xexample.com/de/a", "ftp://b.org/fr/", "ftp://b.org/FR/",
    "http://h.net?/x", "http://h.net#x", "http://", "a://b://c/d", "http://ÄB.net/", "http://user@host.org/fr/\n/x", "x\ny://q.org/fr/1", "http://net/", "http://net", "http://org/fr/?", "://x/y",
]


def host_and_path(url):
    after = (url or "").split("://", 1)
    if len(after) < 2:
        return "", ""
    host = re.match(r"[^/?#]*", after[1]).group()
    path = re.match(r"[^?#]*", after[1][len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = [(len(h + p), h + p, k) for k, h, p in reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, "allow")


def test_equals_sql(spark):
    assert difference(reputation.query(spark, SMALL), reputation.SQL, SMALL) is None


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in reputation.judge_urls(pages, none).collect()}
    for i, url in enumerate(URLS):
        host, path = host_and_path(url)
        assert out[i] == (host, path, *ruled(host, path)), url


def brute_force(hosts, others=()):
    """Posterior (mean, lower bound) by host; hosts: {host: (n, bad)}; others: hosts without labels."""
    def group(names, name_of):
        out = {}
        for h in names:
            n, b = out.get(name_of(h), (0, 0))
            out[name_of(h)] = n + names[h][0], b + names[h][1]
        return out

    def prior(level):
        n, b, g = sum(x for x, _ in level.values()), sum(x for _, x in level.values()), len(level)
        mean = b / n
        noise, between, k = mean * (1 - mean), sum(x * x / m for m, x in level.values()) / n - mean * mean, n / g
        rho = max(0, (between / noise * k - 1) / max(k - 1, 1e-9)) if noise > 0 else 0
        return mean, min(1000, max(1, 1 / rho - 1)) if rho > 0 else 1000

    domain = lambda h: ".".join(h.split(".")[-3 if ".".join(h.split(".")[-2:]) in reputation.SUFFIXES else -2 :])
    suffix = lambda h: ".".join(domain(h).split(".")[1:]) or h
    domains = group(hosts, domain)
    suffixes = group(domains, suffix)
    (_, hk), (_, dk), (smean, sk) = prior(hosts), prior(domains), prior(suffixes)
    sp = {s: (b + sk * smean) / (n + sk) for s, (n, b) in suffixes.items()}
    dp = {d: (b + dk * sp[suffix(d)]) / (n + dk) for d, (n, b) in domains.items()}
    out = {}
    for h, (n, bad) in {**hosts, **dict.fromkeys(others, (0, 0))}.items():
        if domain(h) not in dp:
            dp[domain(h)] = sp.get(suffix(domain(h)), smean)
        a, b = bad + hk * dp[domain(h)], n - bad + hk * (1 - dp[domain(h)])
        out[h] = a / (a + b), max(0, a / (a + b) - reputation.Z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5)
    return out


def test_posterior_equals_brute_force_and_bad_hosts_go(spark):
    counts = {"www.bad.com": (400, 396), "shop.bad.com": (3, 3), "a.fine.com": (300, 3), "b.fine.com": (2, 1), "x.co.uk": (50, 2), "y.x.co.uk": (5, 4), "z.dev": (1, 1), "good.dev": (900, 9)}
    pages, outcomes = [], []
    for host, (n, bad) in counts.items():
        for i in range(n):
            outcomes.append((len(pages), int(i < bad)))
            pages.append((len(pages), f"http://{host}/{i}"))
    new = ["new.bad.com", "unknown.com", "other.co.uk", "a.fine.com.de", "x.museum"]
    pages += [(9_000, "http://www.bad.com/new"), *[(9_001 + i, f"http://{h}/") for i, h in enumerate(new)], (9_002, "http://unknown.com/")]
    schema = "page_id long, url string"
    out = reputation.judge_urls(spark.createDataFrame(pages, schema), spark.createDataFrame([*outcomes, outcomes[0], (None, 1), (77_777, 1)], "page_id long, bad int")).collect()
    assert len(out) == len(pages)
    want = brute_force(counts, new)
    for r in out:
        assert (r.bad_rate, r.bad_rate_lower) == pytest.approx(want[r.host])
        assert r.verdict == ("block" if want[r.host][1] > reputation.MAX_BAD else "allow")
    verdicts = {r.host: r.verdict for r in out}
    assert verdicts["www.bad.com"] == "block" and verdicts["a.fine.com"] == "allow" and verdicts["z.dev"] == "allow"


def test_a_new_host_has_its_domains_reputation(spark):
    """200 bad pages under one host of a domain block a host of the domain that nothing is known of."""
    pages = [(i, f"http://a.bad.com/{i}") for i in range(200)] + [(1000 + i, f"http://h{i % 20}.good{i % 20}.com/{i}") for i in range(400)]
    outcomes = [(i, int(i < 200)) for i, _ in pages]
    pages += [(5000, "http://new.bad.com/"), (5001, "http://new.good3.com/"), (5002, "http://nobody.com/"), (5003, "bad.com, no scheme"), (5004, None)]
    out = {r.page_id: r for r in reputation.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
    assert [out[i].verdict for i in (5000, 5001, 5002, 5003, 5004)] == ["block", "allow", "allow", "allow", "allow"]
    assert out[5003].bad_rate is None is out[5004].bad_rate and out[5000].bad_rate > 0.9


def test_suffixes_are_a_parameter(spark):
    pages = spark.createDataFrame([(1, "http://a.x.gov.zz/"), (2, "http://b.x.gov.zz/"), (3, "http://c.y.gov.zz/")], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, 1), (3, 0)], "page_id long, bad int")
    rates = {r.page_id: r.bad_rate for r in reputation.judge_urls(pages, outcomes, suffixes=("gov.zz",)).collect()}
    assert rates[2] > rates[3]


def test_empty_tables_null_ids_and_other_columns(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    assert reputation.judge_urls(empty, none).count() == 0
    odd = spark.createDataFrame([(None, "http://net/", "q"), (1, None, "q")], "page_id long, url string, host string")
    assert {(r.page_id, r.host, r.verdict) for r in reputation.judge_urls(odd, none).collect()} == {(None, "net", "block"), (1, "", "allow")}
