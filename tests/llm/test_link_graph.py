import duckdb
import numpy as np
import pytest

from morsel.llm import link_graph

SCHEMA = "page_id long, url string, html string, host string, trust int"


def page(i, url, *links):
    return (i, url, "".join(f'<p><A class="x" href="{x}">t</A>' for x in links), "clash", 7)


PAGES = [
    page(0, "https://a.example.org/1", "https://b.com/x", "http://c.com", "/own", "https://a.example.org/2"),
    page(1, "http://b.com/y?q=1", "//c.com:80/z", "https://user@C.COM/"),
    page(2, "http://spam.com", "http://casino-win.net/1", "http://casino-win.net/2", "http://b.com"),
    page(3, "http://farm.com", "http://spam.com/"),
    page(4, "http://www.casino-win.net/"),
    page(5, "http://m.b.com/"),
    page(6, None), page(7, "no host", "http://b.com"), (8, "http://c.com", None, None, None), (9, "http://c.com", "", None, None),
    page(10, "http://www.casino-win.net/"),
]


def brute(links, hosts, seeds):
    """The limit of the walk, by solving for it."""
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for a, b, w in links:
        m[at[a], at[b]] += w
    m = m / np.maximum(m.sum(1, keepdims=True), 1)
    s = np.array([h in seeds for h in hosts]) / len(seeds)
    r = (1 - link_graph.DAMPING) * np.linalg.solve(np.eye(len(hosts)) - link_graph.DAMPING * m.T, s)
    return dict(zip(hosts, r / r.sum()))


def test_against_dense_walks(spark):
    got = {r["host"]: r for r in link_graph.judge_hosts(spark.createDataFrame(PAGES, SCHEMA)).collect()}
    links = [("a.example.org", "b.com", 1), ("a.example.org", "c.com", 1), ("b.com", "c.com", 2), ("spam.com", "casino-win.net", 2), ("spam.com", "b.com", 1), ("farm.com", "spam.com", 1)]
    for a, b in (("www.casino-win.net", "casino-win.net"), ("m.b.com", "b.com")):
        links += [(a, b, 1), (b, a, 1)]
    hosts = sorted({x for a, b, _ in links for x in (a, b)})
    assert sorted(got) == hosts
    trust = brute(links, hosts, {"a.example.org"})
    distrust = brute([(b, a, w) for a, b, w in links], hosts, {"casino-win.net", "www.casino-win.net"})
    for h in hosts:
        assert got[h]["trust"] == pytest.approx(trust[h], abs=1e-8) and got[h]["distrust"] == pytest.approx(distrust[h], abs=1e-8)
    assert {h for h in hosts if not got[h]["keep"]} == {"casino-win.net", "www.casino-win.net", "spam.com", "farm.com"}


def test_pages_and_sql(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    got = sorted(map(tuple, link_graph.judge_pages(df).collect()))
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    want = sorted(con.sql(link_graph.oracle_sql()).fetchall())
    assert [g[:3] + g[5:] for g in got] == [w[:3] + w[5:] for w in want]
    for g, w in zip(got, want):
        assert (g[3] is None) == (w[3] is None) and (g[3] is None or g[3:5] == pytest.approx(w[3:5], abs=2e-9))
    assert len(got) == len(PAGES) and [g[5] for g in got[6:10]] == [True] * 4


def test_no_seeds_and_no_rows(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    assert all(r["keep"] and r["trust"] == 0 and r["distrust"] == 0 for r in link_graph.judge_hosts(df, "^$", "^$").collect())
    assert link_graph.judge_pages(df.limit(0)).count() == 0


def test_long_chains_and_seed_tables(spark):
    """A chain of 20 hosts that leads to a blocked one is held to account to its end, as the converged walk says."""
    name = lambda i: f"h{i}.test"
    pages = [page(i, f"http://{name(i)}/", f"http://{name(i + 1)}/") for i in range(20)] + [page(100 + i, f"http://other{i}.test/", f"http://other{i + 1}.test/") for i in range(300)]
    seeds = spark.createDataFrame([("H20.test", True), ("other0.test", False), ("other0.test", None), ("absent.test", True)], "host string, blocked boolean")
    got = {r["host"]: r for r in link_graph.judge_hosts(spark.createDataFrame(pages, SCHEMA), seeds=seeds).collect()}
    hosts = sorted(got)
    want = brute([(name(i + 1), name(i), 1) for i in range(20)] + [(f"other{i + 1}.test", f"other{i}.test", 1) for i in range(300)], hosts, {"h20.test"})
    assert len(hosts) == 322 and all(got[h]["distrust"] == pytest.approx(want[h], abs=1e-8) for h in hosts)
    assert not any(got[name(i)]["keep"] for i in range(1, 21)) and all(got[f"other{i}.test"]["keep"] for i in range(301))


def test_very_long_page(spark):
    html = "<p>x</p>" * 300000 + '<a href="http://b.com">b</a>'
    df = spark.createDataFrame([(1, "http://a.edu", html)], "page_id long, url string, html string")
    got = {r["host"]: r["trust"] for r in link_graph.judge_hosts(df).collect()}
    assert got["a.edu"] > got["b.com"] > 0
