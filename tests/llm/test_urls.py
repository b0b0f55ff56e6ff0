from trackloom.llm import urls


def brute(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    path = rest[len(host) :].partition("?")[0].partition("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    found = urls.features(host, path)
    score = urls.BIAS + sum(urls.WEIGHTS[k] for k in found) // max(1, len(found))
    rule = max(fits)[1:] if fits else None
    return host, path, rule and rule[0], rule[1] if rule else ("block" if score > 0 else "allow"), score


CASES = [
    "http://www.Example.com/en/1?x=/y#z", "https://a.example.com/en/", "http://com/x", "http://b.net/es/1", "http://b.net/fr", "ftp://x.org?q=://y", "no scheme", "", None, "://", "http://", "http://EXAMPLE.COM/en/x/", "http://aexample.com/en/1",
    "http://x.com", "http://x.com#/en/", "x://y://z/en/", "http://é.org/ü🙂/x", "http://h.org/" + "long/" * 4000, "http://casino-win.org/bonus", "HTTP://NET/ES/", "http://net/es/",
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(CASES)] + [(0, CASES[0], "x")], "page_id long, url string, host string")
    got = urls.judge(df).collect()
    assert len(got) == len(CASES) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict, r.score) == brute(CASES[r.id]), CASES[r.id]
    assert urls.judge(df.limit(0)).count() == 0


def test_the_table_is_learned():
    table = urls.labelled()
    assert sum((brute("http://" + u)[4] > 0) == bool(y) for u, y in table) >= 0.97 * len(table)


def test_whole_table(spark, sf):
    pages = {r.page_id: r.url for r in urls.documents(spark, sf, "pages").collect()}
    for r in urls.op8(spark, sf).collect():
        assert (r.host, r.path, r.rule, r.verdict, r.score) == brute(pages[r.page_id])


def test_the_path_tells():
    """On a host that says nothing the path decides, and the table isn't made of the judged pages' names."""
    for host in ("www.quiet-lane.org", "someplace.net"):
        for path in ("/casino-bonus/viagra", "/free-bets/poker", "/adult/xxx-cams", "/cheap-pills/order"):
            assert brute(f"http://{host}{path}")[3] == "block", (host, path)
        for path in ("/books/history", "/gardening/roses", "/science/physics", "/school/timetable"):
            assert brute(f"http://{host}{path}")[3] == "allow", (host, path)


def test_the_table_is_not_the_judged_pages(spark, sf):
    hosts = {brute(r.url)[0] for r in urls.documents(spark, sf, "pages").collect()}
    assert not {x for h in hosts for x in h.split(".")} & {*urls.ALLOW, *urls.BLOCK}


def test_nothing_known_is_allowed():
    assert [brute(u)[3] for u in (None, "", "http://", "no scheme")] == ["allow"] * 4
