import random

from simloom.llm import url_filter as u


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def brute(url, rules):
    host, path = parts(url)
    best = (-1, -1, None, "allow")
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best, (len(h) + len(p), len(h), h + p, verdict))
    return host, path, best[2], best[3]


def urls():
    rng = random.Random(4)
    labels = ["a", "b", "com", "net", "example", "www", "É", ""]
    out = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/EN/", "x://com", "x://com?a=/", "x://a.com#f/", "a://b://c/d", "ftp://user:pw@com:80/x", "x://com\n/a\x00b"]
    for _ in range(400):
        host = ".".join(rng.choice(labels) for _ in range(rng.randint(1, 5)))
        out.append("http://" + host + "".join(rng.choice(["/", "/en/", "a", "?q", "#f", "/es/x"]) for _ in range(rng.randint(0, 4))))
    return out


RULES = [*u.RULES, ("block", "b.example.com", ""), ("allow", "b.example.com", "/"), ("block", "b.a", "/en"), ("allow", "com", "/en/a"), ("block", "a", "/en/es/x"), ("allow", "b.a", "/es/x")]


def test_equals_brute_force_in_any_blocks(spark):
    pages = spark.createDataFrame([(i, x, 0) for i, x in enumerate(urls())] + [(None, "x://com/", 0), (3, "x://com/", 0)], "page_id long, url string, host int")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    want = sorted([(i, *brute(x, RULES)) for i, x in [*enumerate(urls()), (None, "x://com/"), (3, "x://com/")]], key=str)
    for block in (1, 4, 100):
        got = u.judge(pages, rules, block_rules=block).collect()
        assert sorted(map(tuple, got), key=str) == want


def test_empty_tables_and_default(spark):
    pages = spark.createDataFrame([(1, "x://org/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    assert u.judge(pages, rules.limit(0), default="block").collect()[0].verdict == "block"
    assert u.judge(pages.limit(0), rules).count() == 0


def test_very_long_urls(spark):
    rows = ["x://" + "a." * 200_000 + "example.com/en/" + "p" * 300_000, "x://com/" + "q" * 1_000_000, "h" * 500_000, "x://" + "b" * 400_000]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = [tuple(x) for x in u.judge(pages, rules).collect()]
    assert sorted(got) == sorted((i, *brute(x, RULES)) for i, x in enumerate(rows))
