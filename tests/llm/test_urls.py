import random

import pytest

from pyspark.sql import functions as F

from trailweave.llm.urls import OP4_SQL, RULES, absolute, judge

SCHEMA = "page_id long, url string, html string, host int, best string"


def page(i, url, html=""):
    return (i, url, html, i, "z")


ROWS = [
    page(1, "https://A.Example.org/es/x"),
    page(2, "http://x.example.org/en/1?q", '<link rel="canonical" href="https://a.com/fr/z">'),
    page(3, "http://net1.net/a", "<META HTTP-EQUIV='refresh' content='0; url=http://net2.net/b'>"),
    page(4, "http://net2.net/b#part", "<link href=https://b.com/de/1 rel=canonical>"),
    page(5, "http://net3.net/", '<link rel="canonical" href="http://net2.net/b">'),
    page(6, "http://other.net/", '<link rel="canonical" href="http://one.net/"><link rel=canonical href="http://b.com/de/9">'),
    page(7, "http://one.net/", '<link rel="canonical" href="https://www.org/x">'),
    page(8, None, None),
    page(9, "no scheme"),
    page(10, "https://example.org"),
    page(11, "ftp://notexample.org/es/"),
    page(12, "http://lone.net/?a=1#b", '<link rel="stylesheet" href="http://b.com/de/1">'),
    page(12, "http://lone.net/?a=1#b", '<link rel="canonical" href="/de/1">'),
]


def test_rules_and_aliases(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.by) for r in judge(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block", "rule")
    assert got[2] == ("x.example.org", "/en/1", "example.org/en/1", "block", "rule")
    assert [got[i][3:] for i in (3, 4, 5)] == [("block", "alias")] * 3
    assert [got[i][3:] for i in (6, 7)] == [("allow", "alias")] * 2  # the allow goes before the block
    assert got[8] == ("", "", None, "allow", "default") and got[9][:2] == ("", "")
    assert got[10] == ("example.org", "", None, "allow", "default")
    assert got[11][2:4] == ("org/", "allow")
    assert got[12] == ("lone.net", "/", None, "allow", "default")


def test_sql_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.execute("create table pages(page_id bigint, url varchar, html varchar)")
    db.executemany("insert into pages values (?, ?, ?)", [r[:3] for r in ROWS])
    want = sorted(map(str, db.sql(f"select page_id, host, path, rule, verdict, \"by\" from ({OP4_SQL})").fetchall()))
    assert sorted(str(tuple(r)) for r in judge(spark.createDataFrame(ROWS, SCHEMA)).collect()) == want


def link_rich(n):
    """Pages with links of many kinds, absolute, relative or without any, hidden or not."""
    rng = random.Random(n)
    hosts = ["b.com", "www.a.com", "x.example.org", "example.org", "n.net", "M.net", "o.net", "p.q.net", "org.net"]
    paths = ["/de/1", "/fr/2", "/es/x", "/en/1?a=1&b=2", "/", "", "/deep/er", "/go?u=http://b.com/de/1"]
    address = lambda: rng.choice(["http", "https", "HTTP"]) + "://" + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "", "#f"])
    coded = lambda u: u.replace("&", rng.choice(["&amp;", "&#38;", "&#x26;", "&"])).replace("/", rng.choice(["/", "/", "&#47;", "&sol;"]))
    kinds = [
        lambda u: f'<link rel="canonical" href="{u}">', lambda u: f"<LINK href='{u}' rel=Canonical />", lambda u: f"<meta http-equiv=refresh content='0; URL={u}'>", lambda u: f'<meta content="3;url={u}" http-equiv="Refresh">',
        lambda u: f'<!-- <link rel="canonical" href="{u}"> -->', lambda u: f'<script>var x = \'<link rel="canonical" href="{u}">\'</script>', lambda u: f'<link rel="stylesheet" href="{u}">', lambda u: f'<link rel="canonical" data-href="{u}">', lambda u: "<p>none</p>",
        lambda u: f'<title><link rel="canonical" href="{u}"></title>', lambda u: f'<!-- open <link rel="canonical" href="{u}">',
    ]
    relative = ["/de/1", "//b.com/de/1", "//h3.net/1", "1", "./2", "../1", "../../0", "x/../1", "..", ".", "?a=1&b=2", "#f", "?", "/./0/", "mailto:a@b.com", "/go?u=//b.com/de/1", "deep/er/../../fr/2"]
    rows = []
    for i in range(n):
        url = rng.choice([None, "", "no scheme", *[address() if rng.random() < 0.5 else f"http://h{rng.randrange(n)}.net/{rng.randrange(3)}" for _ in range(9)]])
        target = lambda: coded(address()) if rng.random() < 0.3 else coded(rng.choice(relative)) if rng.random() < 0.4 else f"http://h{rng.randrange(n)}.net/{rng.randrange(3)}"
        rows.append(page(i, url, rng.choice(["", "<html>"]) + "".join(rng.choice(kinds)(target()) for _ in range(rng.randrange(3)))))
    return rows


def test_sql_agrees_on_pages_full_of_links(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = link_rich(400)
    db = duckdb.connect()
    db.execute("create table pages(page_id bigint, url varchar, html varchar)")
    db.executemany("insert into pages values (?, ?, ?)", [r[:3] for r in rows])
    want = sorted(map(str, db.sql(f"select page_id, host, path, rule, verdict, \"by\" from ({OP4_SQL})").fetchall()))
    got = judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    assert sum(r.by == "alias" for r in got) > 20


def test_a_table_of_rules_gives_what_the_list_gives(spark):
    rng = random.Random(1)
    rules = [*RULES, *[(rng.choice(["allow", "block"]), rng.choice(["net", "n.net", "h1.net", "q.net", "com", "p.q.net"]), rng.choice(["/", "", "/d", "/de", "/de/1", "/1", "/deep"])) for _ in range(30)]]
    table = spark.createDataFrame([*rules, ("block", "many.net", None)] + [("block", f"site{i}.net", f"/{i}") for i in range(3000)], "action string, host string, path string")
    pages = spark.createDataFrame(link_rich(300), SCHEMA)
    of = lambda rows: sorted(str(tuple(r)) for r in rows.collect())
    assert of(judge(pages, table)) == of(judge(pages, rules))


def test_comments_scripts_and_coded_targets(spark):
    rows = [
        page(1, "http://u.net/a", "<link rel=canonical href='/go?u=http://b.com/de/1'>"), page(2, "http://v.net/a", "<!-- <link rel=canonical href='http://b.com/de/1'> -->"),
        page(3, "http://w.net/a", "<link rel=canonical href='http:&#47;&#47;b.com/de/1&amp;x'>"), page(4, "http://x.net/a", "<script>'<link rel=canonical href=http://b.com/de/1>'</script>"),
    ]
    assert {r.page_id: r.verdict for r in judge(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: "allow", 2: "allow", 3: "block", 4: "allow"}


def test_redirect_table_long_chain_and_empty(spark):
    chain = spark.createDataFrame([(f"http://h{i}.net/", f"http://h{i + 1}.net/") for i in range(60)] + [(None, "x"), ("http://h60.net/", "http://b.com/de/")], "source string, target string")
    pages = spark.createDataFrame([page(i, f"http://h{i}.net/") for i in (0, 30, 60)] + [page(99, "http://free.net/")], SCHEMA)
    assert {r.page_id: r.verdict for r in judge(pages, links=chain).collect()} == {0: "block", 30: "block", 60: "block", 99: "allow"}
    assert judge(spark.createDataFrame([], SCHEMA)).collect() == []


def test_relative_targets(spark):
    from urllib.parse import urljoin

    refresh = "<meta http-equiv=refresh content='0;url=%s'>"
    pages = [page(1, "http://n.net/a", refresh % "//b.com/de/1"), page(2, "http://q.com/x/y", "<link rel=canonical href='/de/1'>"), page(3, "http://r.com/de/y", ""), page(4, "http://r.com/x/y", "<link rel=canonical href='../de/y'>")]
    got = {r.page_id: (r.verdict, r.by) for r in judge(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "rule"), 4: ("block", "alias")}
    bases = ["http://a.net/x/y?q=1", "https://a.net/x/", "http://a.net/x/y/z"]
    pairs = [(b, t) for b in bases for t in ("//b.com/d", "/d/e", "d.html", "./d", "../d", "../../d", "../../../d", "d/../e/", "?p=2", "http://c.org/z", "..", ".", "/a/./b/../c?u=//v")]
    rows = spark.createDataFrame(pairs, "base string, to string").select("base", "to", absolute(F.col("to"), F.col("base")).alias("at")).collect()
    assert [(r.base, r.to, r["at"]) for r in rows] == [(b, t, urljoin(b, t)) for b, t in pairs]
