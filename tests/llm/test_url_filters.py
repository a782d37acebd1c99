import re


from tessitura.llm import url_filters as U


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"[^/?#]*", rest)
        host = m.group().translate({c: c + 32 for c in range(65, 91)})
        path = re.match(r"[^?#]*", rest[m.end() :]).group()
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[3], best[4] if best else default


URLS = ["http://a.example.com/en/1", "https://www.EXAMPLE.com/en/x?y#z", "http://example.com", "http://example.com/", "http://x.net/es/", "http://net/fr/1", "http://y.net/es", "nothing", None, "", "ftp://?q", "http://com/", "http://notexample.com/en/", "http://a.b.c.d.e.f.com/a/b/c/d/e/f/", "http://example.com:80/en/", "x://" + "a/" * 3000]


def test_contract_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df, U.rule_table(spark, U.RULES)).collect()}
    assert got == {(i, *brute(u, U.RULES)) for i, u in enumerate(URLS)}


def test_rules_without_slash_ties_and_none(spark):
    rules = [("com", "/e", "block"), ("com", "/en", "allow"), ("com", "/en", "block"), ("a.com", "", "allow"), ("com", "/en/d", "allow")]
    urls = ["http://a.com/en/d", "http://b.com/enx", "http://b.com/e", "http://a.com/x", "http://b.com"]
    df = spark.createDataFrame([(i, u, "q") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(df, U.rule_table(spark, rules)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert {r["verdict"] for r in U.judge(df, U.rule_table(spark, []), "block").collect()} == {"block"}
    assert U.judge(df.limit(0), U.rule_table(spark, rules)).count() == 0
