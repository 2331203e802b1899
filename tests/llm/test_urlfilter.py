import random

from sylva.llm import urlfilter


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER))
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def check(spark, urls, rules):
    frame = spark.createDataFrame([(k, u, "clash", "x") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = urlfilter.judge(frame, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    rules = [r for r in rules if None not in r]
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted((k, h, p, r or "", v) for k, u in enumerate(urls) for h, p, r, v in [brute(u, rules)])


def test_random_rules(spark):
    rng = random.Random(2)
    label = lambda: rng.choice(["a", "b", "com", "x-y", "Ex"])
    host = lambda n: ".".join(label() for _ in range(rng.randrange(1, n)))
    path = lambda: rng.choice(["", "/", "/a", "/a/b", "/ab", "/a/b/c"])
    rules = [(host(4).lower(), path(), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = [f"{rng.choice(['http', ''])}://{host(6)}{path()}{rng.choice(['', '?q=/a', '#f', '/d?x#y'])}" for _ in range(600)]
    check(spark, urls, rules + [(None, "/", "block"), ("a", "/", "allow"), ("a", "/", "block")])


def test_odd_urls(spark):
    long = "http://" + "a." * 3000 + "com/" + "p" * 100_000
    check(spark, [None, "", "nothing", "http://", "http:///x", "HTTP://A.COM", "http://a.com?x=http://b.com/", "://com", "http://xcom/", "http://com./", long, "http://a.com/", "http://a.com/"], [("com", "", "block"), ("a.com", "/", "allow")])


def test_hot_host_and_empty_tables(spark):
    check(spark, ["http://hot.com/a"] * 3000 + [f"http://h{k}.com/" for k in range(50)], [("com", "/", "block"), ("hot.com", "/a", "allow")])
    check(spark, ["http://a.com/"], [(None, None, None)])
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.judge(empty, spark.createDataFrame([("a", "/", "block")], "host string, path string, verdict string")).collect() == []
