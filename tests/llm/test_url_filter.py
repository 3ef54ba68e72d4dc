"""Rules, redirect classes, and the query against its SQL on pages that link to each other."""

import random
from urllib.parse import urljoin

import duckdb
import pytest

from matgraph.llm import url_filter
from matgraph.llm._base import scratch
from matgraph.llm.queries import ORACLE, QUERIES, RULES

SCHEMA = "page_id long, url string, html string, host string, rule string"

PAGES = [
    (1, "http://a.example.com/en/1", '<link rel="canonical" href="https://x.example.net/fr/1">'),  # alias of a blocked one
    (2, "http://b.example.com/en/2", "<META HTTP-EQUIV=refresh CONTENT=\"0; URL='http://a.example.com/en/1'\">"),  # and its alias
    (3, "https://c.example.net/en/3", '<link href="https://x.example.net/fr/1" rel="next canonical">'),  # allowed by a rule: the class is not blocked
    (4, "http://d.example.com/de/4", '<link rel=canonical href=/en/4>'),
    (5, "http://d.example.com/en/4#x", None),  # linked to by 4, which is blocked
    (6, "http://D.Example.com/en/4?q=1", '<link rel=canonical href="?q=2&amp;r=1">'),
    (7, "http://d.example.com/en/4?q=2&r=1", '<meta http-equiv="refresh" content="5;url=//e.example.org/de/7">'),
    (8, "HTTP://E.EXAMPLE.ORG/de/7", '<!-- <link rel="canonical" href="http://z.net/"> --><script>"<link rel=canonical href=http://z.net/ >"</script>'),
    (9, "http://f.example.com/a/b", '<link rel="canonical" href="c?x"><link rel="canonical" href="#top"><link rel="canonical" href="mailto:x"><link rel=canonical href="">'),
    (10, "http://f.example.com/a/c?x", '<link rel="icon canonicals" href="http://z.net/">'),
    (11, "http://f.example.com", '<link rel=canonical href="de/">'),
    (12, "http://f.example.com/de/", ""),
    (13, "http://g.example.com/x", "<link rel='canonical' href='http://uncrawled.net/page'>"),  # its target is in no row
    (14, None, '<link rel="canonical" href="http://z.net/">'),
    (15, "no address", '<link rel="canonical" href="http://z.net/">'),
    (16, "", None),
    (17, "http://net", None),
    (18, "http://net/", None),
    (19, "http://xnet/", None),
    (20, "http://org/fr/", None),
    (21, "ftp://a.org/fr/?u=://b", None),
    (None, "http://b.example.com/en/2#frag", None),
    (23, "http://b.example.com/en/2", "x" * 3_000_000 + '<link rel="canonical" href="http://z.example.com/ok">' + "y"),
    (23, "http://b.example.com/en/2", None),
    (24, "http://h.example.com/é? ", '<link rel="canonical" href="http://i.net/é">'),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame([(*r, "own", "own") for r in PAGES], SCHEMA).repartition(3).write.parquet(f"{path}/pages.parquet")
    return path


def verdicts(rows):
    return [(r["page_id"], r["rule"], r["verdict"], r["aliased"]) for r in rows]


def test_query_equals_sql_on_linked_pages(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = con.execute(ORACLE["op12_url_filter"])
    columns = [d[0] for d in want.description]
    got = QUERIES["op12_url_filter"](spark, folder)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
    found = {i: (rule, verdict, aliased) for i, rule, verdict, aliased in verdicts(got.collect()) if i not in (None, 23)}
    # The class of 1, 2 and 3 is blocked by its target and allowed by 3: allow goes first.
    assert found[1] == found[2] == (None, "allow", False) and found[3] == ("example.net/en/", "allow", False)
    assert found[4] == ("example.com/de/", "block", False) and found[5] == (None, "block", True)
    assert found[6] == found[7] == found[8] == (None, "allow", False)
    assert found[11] == (None, "block", True) and found[12] == ("example.com/de/", "block", False)
    assert found[13] == (None, "block", True) and found[14] == found[15] == found[16] == (None, "allow", False)
    assert found[17] == (None, "allow", False) and found[18] == ("net/", "block", False) and found[19] == (None, "allow", False)
    assert found[20] == ("org/fr/", "allow", False) and found[21] == ("org/fr/", "allow", False) and found[24] == (None, "block", True)


def test_many_rules_decide_like_few(spark):
    rng = random.Random(3)
    hosts = ["a", "b.a", "c.b.a", "net", "x.net", "a.x.net", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts for p in paths if rng.random() < 0.6] + [("A", "/", "block"), ("a", "/", "allow")]
    urls = [(h, p) for h in [*hosts, "q.c.b.a", "ba"] for p in [*paths, "/en/xy", "/fr"]] * 2
    frame = spark.createDataFrame(urls, "host string, path string")
    own: dict = {}
    for h, p, v in rules:
        own[h.lower(), p] = min(v, own.get((h.lower(), p), v))

    def best(host, path):
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in own.items() if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2:] if fits else (None, None)

    want = sorted((h, p, *map(str, best(h, p))) for h, p in urls)
    for few in (1000, 3):
        got = url_filter.ruled(frame, url_filter.rules_of(spark, rules), few).collect()
        assert sorted((r["host"], r["path"], str(r["rule"]), str(r["ruled"])) for r in got) == want


def test_classes_against_brute_force(spark):
    """Long chains, rings and stars of redirects, and pages of links, against plain search."""
    rng = random.Random(5)
    name = lambda i: f"http://{rng_hosts[i]}/{'de' if i % 29 == 0 else 'en'}/{i}"
    rng_hosts = [rng.choice(["a.example.com", "b.org", "c.example.net" if i % 41 == 0 else "d.com"]) for i in range(1200)]
    edges = [(i, i + 1) for i in range(0, 150)] + [(200, k) for k in range(201, 400)] + [(rng.randrange(400, 1200), rng.randrange(400, 1200)) for _ in range(500)]
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    pages = spark.createDataFrame([(i, name(i), f'<link rel="canonical" href="{name(b)}">' if (b := next((y for x, y in edges if x == i), None)) is not None else "") for i in range(1200)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([(name(a), name(b)) for a, b in edges] + [(None, "x")], "a string, b string")
    with scratch():
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, url_filter.rules_of(spark, RULES), redirects).collect()}
    verdict_of = {h + p: v for h, p, v in RULES}
    for i in range(1200):
        seen, todo = {i}, [i]
        while todo:
            for k in near.get(todo.pop(), ()):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        ruled = {verdict_of[got[k][0]] for k in seen if got[k][0]}
        want = verdict_of[got[i][0]] if got[i][0] else "block" if ruled == {"block"} else "allow"
        assert got[i][1] == want


def test_references_resolve_as_the_library_does(spark):
    base = ["http://a.b/c/d?e", "http://a.b", "https://a.b/", "http://a.b/c/"]
    refs = ["x", "/x", "//h/x", "?y", "http://o.p/q", "x/y?z", "g;x=1"]
    rows = [(k, u, f'<link rel="canonical" href="{r}">') for k, (u, r) in enumerate((u, r) for u in base for r in refs)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["a"], r["b"]) for r in url_filter.links_of(pages).collect()}
    want = {(u, urljoin(u, r)) for u in base for r in refs}
    assert got == {(a, b) for a, b in want if a != b}


def test_empty_table(spark):
    pages = spark.createDataFrame([], SCHEMA)
    assert url_filter.judge(pages, url_filter.rules_of(spark, RULES)).collect() == []
    assert [r["verdict"] for r in url_filter.judge(spark.createDataFrame([(1, "http://a/b", None, "h", "r")], SCHEMA), url_filter.rules_of(spark, [])).collect()] == ["allow"]
