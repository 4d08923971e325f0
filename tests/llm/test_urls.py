from __future__ import annotations

import pytest

from lumentide.llm.urls import Reputation, domain_of, host_reputation, judge_urls, suffix_of

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
PAGES, OUTCOMES = "page_id long, url string, html string, host string", "page_id long, bad int"


def test_hosts_paths_and_rules(spark):
    urls = [
        ("http://A.Example.NET/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://example.net/english", "example.net", "/english", "net/", "block"),
        ("https://example.net", "example.net", "", None, "allow"), ("ftp://www.example.com/de/x?u=http://a.org/fr/", "www.example.com", "/de/x", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("x://org/fr/#a", "org", "/fr/", "org/fr/", "allow"),
        ("no scheme.net/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://?q=1://b.net/", "", "", None, "allow"), ("http://É.Net:80/#/", "É.net:80", "/", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, u[0], "h", "clash") for k, u in enumerate(urls)], PAGES)
    got = judge_urls(pages, spark.createDataFrame([], OUTCOMES), RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [u[1:] for u in urls]
    assert judge_urls(pages.limit(0), spark.createDataFrame([], OUTCOMES), RULES).count() == 0


def test_shrinkage(spark):
    rows, outcomes, k = [], [], 0
    for host, n, bad in (("a.bad.com", 40, 38), ("b.bad.com", 3, 3), ("a.good.com", 40, 1), ("b.good.com", 2, 2), ("solo.org", 1, 1)):
        for i in range(n):
            rows.append((k, f"http://{host}/{i}", "h", "c"))
            outcomes.append((k, int(i < bad)))
            k += 1
    rows += [(k, "http://new.com/", "h", "c"), (k + 1, "http://a.bad.com/none", "h", "c")]
    outcomes.append((k + 1, None))
    pages, found = spark.createDataFrame(rows, PAGES), spark.createDataFrame(outcomes, OUTCOMES)
    from lumentide.llm.urls import host_of

    rep = {r["host"]: r for r in host_reputation(pages.select("page_id", host_of(pages["url"]).alias("host")), found).collect()}
    assert rep["a.bad.com"]["n"] == 40 and rep["b.bad.com"]["mean"] > rep["b.good.com"]["mean"]
    assert all(0 < r["bound"] < r["mean"] < 1 for r in rep.values())
    # a host's mean lies between its own share and its domain's mean, which other hosts pull
    assert 38 / 40 > rep["a.bad.com"]["mean"] > rep["b.good.com"]["mean"] and 1 / 40 < rep["a.good.com"]["mean"] < rep["b.good.com"]["mean"]
    verdict = {r["host"]: r["verdict"] for r in judge_urls(pages, found, (), Reputation()).collect()}
    assert verdict["a.bad.com"] == "block" and verdict["a.good.com"] == "allow" and verdict["solo.org"] == "allow" and verdict["new.com"] == "allow"


def test_host_without_outcomes_has_its_domains_reputation(spark):
    rows = [(i, f"http://a.bad.com/{i}", "h", "c") for i in range(100)] + [(100 + i, f"http://a.good.com/{i}", "h", "c") for i in range(100)]
    found = spark.createDataFrame([(i, int(i < 100)) for i in range(200)], OUTCOMES)
    rows += [(900, "http://m.bad.com/", "h", "c"), (901, "http://m.good.com/", "h", "c"), (902, "http://m.new.com/", "h", "c"), (903, "http://x.org/", "h", "c")]
    got = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(rows, PAGES), found).where("page_id >= 900").collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {900: "block", 901: "allow", 902: "allow", 903: "allow"}
    assert got[900]["bound"] > 0.5 > got[902]["bound"] > got[901]["bound"]


def test_means_by_hand(spark):
    """Two levels without any spread: every mean is shrunk with the strength of the least correlation."""
    rows = [(i, f"http://h{i % 2}.d.com/", "h", "c") for i in range(8)]
    found = [(i, int(i < 4)) for i in range(8)]
    from lumentide.llm.urls import host_of

    pages = spark.createDataFrame(rows, PAGES)
    rep = host_reputation(pages.select("page_id", host_of(pages["url"]).alias("host")), spark.createDataFrame(found, OUTCOMES)).collect()
    assert [r["mean"] for r in rep] == pytest.approx([0.5, 0.5])


def test_three_levels_by_hand(spark):
    """Outcomes (n, k): a.x.com (10, 10), b.x.com (10, 0), c.y.org (20, 20). By hand: suffixes differ much, so their rho is the most, 0.2, and m = 4; domains don't differ from their suffixes, so m = 999; hosts do, so m = 4."""
    hosts, rows, found = (("a.x.com", 10, 10), ("b.x.com", 10, 0), ("c.y.org", 20, 20)), [], []
    for host, n, k in hosts:
        for i in range(n):
            rows.append((len(rows), host))
            found.append((len(found), int(i < k), "clash"))
    rep = {r["host"]: r["mean"] for r in host_reputation(spark.createDataFrame(rows, "page_id long, host string"), spark.createDataFrame(found, "page_id long, bad int, host string")).collect()}
    root = 31 / 42
    com, org = (10 + 4 * root) / 24, (20 + 4 * root) / 24
    x, y = (10 + 999 * com) / 1019, (20 + 999 * org) / 1019
    assert rep == pytest.approx({"a.x.com": (10 + 4 * x) / 14, "b.x.com": 4 * x / 14, "c.y.org": (20 + 4 * y) / 24})


def test_suffixes_and_domains(spark):
    cases = [("a.b.co.uk", "co.uk", "b.co.uk"), ("b.co.uk", "co.uk", "b.co.uk"), ("co.uk", "co.uk", "co.uk"), ("a.com", "com", "a.com"), ("x.a.com", "com", "a.com"), ("co", "co", "co"), ("a.co", "co", "a.co"), ("x.com.br", "com.br", "x.com.br"), ("", "", ""), ("x.y.de", "de", "y.de")]
    df = spark.createDataFrame([(c[0],) for c in cases], "host string")
    got = {r["host"]: (r["s"], r["d"]) for r in df.select("host", suffix_of(df["host"]).alias("s"), domain_of(df["host"]).alias("d")).collect()}
    assert got == {h: (s, d) for h, s, d in cases}


def test_repeated_rows_labels_and_clashes(spark):
    """Two pages rows of one id are judged each; repeated outcomes count each; extra columns of both tables clash with ours."""
    pages = spark.createDataFrame([(1, "http://a.com/", 0, "x"), (1, "http://a.com/", 0, "x"), (None, "http://a.com/", 0, "x")], "page_id long, url string, n long, bound string")
    found = spark.createDataFrame([(1, 1, "h", 1), (1, 0, "h", 1), (None, 1, "h", 1)], "page_id long, bad int, host string, k long")
    assert [(r["page_id"], r["host"], r["verdict"]) for r in judge_urls(pages, found).orderBy("page_id").collect()] == [(None, "a.com", "allow"), (1, "a.com", "allow"), (1, "a.com", "allow")]
    rep = host_reputation(pages.selectExpr("page_id", "'a.com' AS host"), found).collect()
    assert [(r["n"], r["k"]) for r in rep] == [(4, 2)]


def test_hot_host_and_domain(spark):
    """Most pages of one host: the same verdicts as without them for the others."""
    rows = [(i, "http://hot.big.com/") for i in range(3000)] + [(5000 + i, f"http://h{i}.big.com/") for i in range(200)] + [(9000 + i, f"http://x.d{i}.org/") for i in range(100)]
    found = [(i, i % 2) for i in range(3000)] + [(5000 + i, 1) for i in range(50)]
    got = {r["host"]: r["verdict"] for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(found, OUTCOMES)).collect()}
    assert len(got) == 301 and got["hot.big.com"] == "allow"
