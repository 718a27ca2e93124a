import numpy as np
import pytest

from docloom.llm import url_trust

SCHEMA = "page_id long, url string, html string, host string, rule string"


def test_hosts_paths_and_rules(table):
    urls = ["http://A.Example.com/en/825?x#y", "https://m.x.example.com/en/7/z", "x://notexample.com/en/1", "ftp://net/de/8", "https://example.net/de/8", "http://a.org?/es/", "http://a.org/es/1", "no scheme/en/", None, "http://", "HTTP://B.NET/de/#f", "a://b://c/d"]
    rows = [(i, u, None, "clash", "clash") for i, u in enumerate(urls)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_trust.judge_urls(table(rows, SCHEMA, "pages")).collect()}
    assert got == {
        0: ("a.example.com", "/en/825", "com/en/", "block"), 1: ("m.x.example.com", "/en/7/z", "example.com/en/7", "allow"), 2: ("notexample.com", "/en/1", "com/en/", "block"),
        3: ("net", "/de/8", "net/de/", "allow"), 4: ("example.net", "/de/8", "example.net/de/8", "block"), 5: ("a.org", "", None, "block"), 6: ("a.org", "/es/1", "org/es/", "block"),
        7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("b.net", "/de/", "net/de/", "allow"), 11: ("b:", "//c/d", None, "allow"),
    }


def rank(hosts, edges, start, damping=0.85):
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for (s, d), w in edges.items():
        m[at[d], at[s]] += w
    out = m.sum(axis=0)
    m = np.divide(m, out, out=np.zeros_like(m), where=out > 0)
    v = np.array([start.get(h, 0.0) for h in hosts])
    v = v / v.sum()
    r = np.linalg.solve(np.eye(len(v)) - damping * m, v)  # all mass that doesn't go along links goes to the seeds
    r = r / r.sum()
    return dict(zip(hosts, r, strict=True))


def test_propagation_matches_a_dense_solution(table):
    link = lambda *hosts: "".join(f'<a HREF="http://{h}/x">y</a>' for h in hosts)
    rows = [
        (1, "http://good.net/de/1", link("friend.info", "friend.info", "other.info")), (2, "http://bad.org/es/1", link("bad.org")), (3, "http://farm.info/1", link("bad.org", "bad.org", "other.info")),
        (4, "http://friend.info/1", link("other.info", "good.net")), (5, "http://other.info/1", link("neutral.info")), (6, "http://neutral.info/", None), (7, "http://ring.info/", link("farm.info")),
    ]
    got = {r.host: r for r in url_trust.judge_urls(table([(*r, "", "") for r in rows], SCHEMA, "pages")).collect()}
    edges = {("good.net", "friend.info"): 2, ("good.net", "other.info"): 1, ("farm.info", "bad.org"): 2, ("farm.info", "other.info"): 1, ("friend.info", "other.info"): 1, ("friend.info", "good.net"): 1, ("other.info", "neutral.info"): 1, ("ring.info", "farm.info"): 1}
    hosts = sorted({h for e in edges for h in e})
    trust = rank(hosts, edges, {"good.net": 1})
    distrust = rank(hosts, {(d, s): w for (s, d), w in edges.items()}, {"bad.org": 1})
    for h in hosts:
        assert got[h].trust == pytest.approx(trust[h], abs=1e-4) and got[h].distrust == pytest.approx(distrust[h], abs=1e-4)
    assert {h: got[h].verdict for h in hosts} == {"good.net": "allow", "friend.info": "allow", "other.info": "allow", "neutral.info": "allow", "farm.info": "block", "bad.org": "block", "ring.info": "block"}


def neighbourhood(k):
    """Blocked and linking hosts of which no link leaves; a page of /x fits no rule."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">y</a>' for h in hosts)
    return [
        (f"http://bad{k}.org/es/1", None), (f"http://bad{k}.org/x", None), (f"http://farm{k}.info/x", link(f"bad{k}.org")), (f"http://good{k}.net/de/1", link(f"mixed{k}.info")),
        (f"http://mixed{k}.info/x", link(f"bad{k}.org")), (f"http://far{k}.info/x", link(f"farm{k}.info")), (f"http://calm{k}.info/x", None),
    ]


def test_verdicts_of_a_neighbourhood_do_not_change_with_the_corpus(table, spark):
    verdicts = lambda pages: {(r.host, r.path): r.verdict for r in url_trust.judge_urls(pages, tol=1e-2).where("host RLIKE '^[a-z]+0[.]'").collect()}
    rows = [(i, u, h, "", "") for i, (u, h) in enumerate(neighbourhood(0))]
    alone = verdicts(table(rows, SCHEMA, "small"))
    assert {p for p, v in alone.items() if v == "block"} == {("bad0.org", "/es/1"), ("bad0.org", "/x"), ("farm0.info", "/x"), ("far0.info", "/x")}
    others = [(len(rows) + i, u, h, "", "") for i, (u, h) in enumerate(row for k in range(1, 40) for row in neighbourhood(k))]
    blocked = [(10**6 + i, f"http://many{i % 300}x.org/es/{i}", None, "", "") for i in range(30_000)]
    assert verdicts(table(rows + others + blocked, SCHEMA, "large")) == alone


def test_masses_are_those_of_the_settled_walk(spark):
    ring = [(f"h{i}", f"h{(i + 1) % 7}", 1.0) for i in range(7)] + [("h0", "h3", 3.0)]
    hosts = spark.createDataFrame([(f"h{i}", 2.0 * (i == 1)) for i in range(7)], "host string, seed double")
    got = {r.host: r.mass for r in url_trust.personalised_rank(hosts, spark.createDataFrame(ring, "src string, dst string, weight double"), "seed", tol=1e-6).collect()}
    m = np.zeros((7, 7))
    for s, d, w in ring:
        m[int(d[1:]), int(s[1:])] += w
    want = np.linalg.solve(np.eye(7) - 0.85 * m / m.sum(axis=0), 2.0 * (np.arange(7) == 1))
    assert [got[f"h{i}"] for i in range(7)] == pytest.approx(want, abs=1e-5)


def test_empty_table(table):
    assert url_trust.judge_urls(table([], SCHEMA, "pages", 1)).count() == 0


def test_scores_meet_pages_alike_in_either_way(table, monkeypatch):
    rows = [(i, u, h, "", "") for i, (u, h) in enumerate(row for k in range(3) for row in neighbourhood(k))] + [(None, None, None, "", ""), (7, "http://bad0.org/x", None, "", "")]
    pages = table(rows, SCHEMA, "pages")
    judged = lambda: sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in url_trust.judge_urls(pages).collect())
    want = judged()
    monkeypatch.setattr(url_trust, "MOST_BROADCAST", 0)
    assert judged() == want and len(want) == len(rows)
