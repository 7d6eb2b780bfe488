from plumbline.llm import urls

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def judged(spark, rows, listed, rules=RULES, **more):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(rows)], "page_id long, url string, hits string, words string")
    bad = spark.createDataFrame([(u,) for u in listed], "url string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, bad, rules, **more).collect()}


def test_rules_and_list(spark):
    rows = [None, "", "no scheme", "HTTP://WWW.Example.ORG/es/1?x", "http://a.example.org/en/12#t", "http://a.example.org/en/2", "ftp://x.com/de/", "http://com/fr/1", "http://xcom/fr/1", "http://Bad.net/x//y/?q", "http://bad.net/x/y", "http://sub.worse.net:80/any", "http://worse.net.evil.net/", "a://b://c/d", "http://É.net", "http://x\n.net/p"]
    got = judged(spark, rows, ["http://bad.net/x/y/", "https://www.worse.net", None, "junk", "http://bad.net/x/y"])
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[4] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[5][2:] == ("org/", "allow") and got[6][2:] == ("com/de/", "block") and got[7][2:] == ("com/fr/", "allow")
    assert got[8][2:] == (None, "allow")
    assert got[9][2:] == got[10][2:] == got[11][2:] == (None, "block")
    assert got[12][3] == "allow" and got[13][:2] == ("b:", "//c/d") and got[14][0] == "É.net" and got[15][0] == "x\n.net"
    assert set(judged(spark, rows, []).values()) >= {("bad.net", "/x//y/", None, "allow")}
    assert judged(spark, [], ["http://bad.net/"]) == {}


def test_filter_lets_through_all_listed_and_join_removes_the_rest(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS_PER_URL", 1)  # a crowded filter: many false positives
    listed = [f"http://host{i}.net/p{i}" for i in range(0, 400, 2)]
    rows = [f"http://host{i}.net/p{i}" for i in range(400)] * 2
    got = judged(spark, rows, listed)
    assert len(got) == 800 and all((v[3] == "block") == (i % 400 % 2 == 0) for i, v in got.items())
    monkeypatch.setattr(urls, "MOST_FILTER_BYTES", 1)  # too long a list for a filter
    assert judged(spark, rows, listed) == got


def test_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://bad.net/"), (1, "http://bad.net/"), (None, "http://ok.net/")], "page_id long, url string")
    bad = spark.createDataFrame([("http://bad.net/",)], "url string")
    rows = urls.filter_urls(pages, bad, ()).collect()
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in rows) == [(0, "allow"), (1, "block"), (1, "block")]
