"""Rules against brute force, with nested and unusual rules and urls."""

import random

from barloom.llm import url_rules


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"]
    host, tail = (rest[: ends[0]], rest[ends[0] :]) if ends else (rest, "")
    for mark in "?#":
        tail = tail.split(mark, 1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), tail


def brute(url, rules):
    host, path = split(url)
    fits = [
        (len(h + p), len(h), h + p, verdict) for h, p, verdict in rules
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return (host, path, best[2] if best else None, best[3] if best else "allow")


def test_matches_brute_force(spark):
    rng = random.Random(1)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "c.b.a.com", "net", "org", "a.net", "com.a", "community"]
    paths = ["/", "/e", "/en", "/en/", "/en/x", "/enx", "", "/fr/a/b"]
    picked = rng.sample([(h, p) for h in hosts for p in paths], 30)
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in picked]
    urls = [
        f"http{rng.choice(['', 's'])}://{rng.choice(['', 'w.', 'B.'])}{rng.choice(hosts)}{rng.choice(paths)}"
        f"{rng.choice(['', '?q=/en/', '#/fr/', 'z', '/z//'])}" for _ in range(500)
    ]
    urls += [None, "", "no scheme", "://", "x://", "x:///en/", "http://A.COM", "http://a.com.", "http://É.com/", "a://b://c.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    ruled = spark.createDataFrame(rules + [(None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    rows = url_rules.judge_urls(pages, ruled).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert len(rows) == len(urls)


def test_a_common_url_and_clashing_columns(spark):
    rows = [(1, "http://a.com/en/", "h", "p", "r", "v")] * 200 + [(None, None, None, None, None, None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, verdict string")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    out = url_rules.judge_urls(pages, rules, default="none").collect()
    assert [r.verdict for r in out].count("block") == 200 and len(out) == 202
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    unruled = url_rules.judge_urls(pages, rules.limit(0), default="none").collect()
    assert {(r.rule, r.verdict) for r in unruled} == {(None, "none")}


def test_a_host_of_many_labels(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 50_000 + "com/x")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block"), ("a.com", "/y", "allow")], "host string, path string, verdict string")
    assert url_rules.judge_urls(pages, rules).select("rule").first().rule == "com/"
