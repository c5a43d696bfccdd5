from peakpool.llm import urlfilter as U

URLS = [
    "https://a.example.net/en/1?x#y", "http://EXAMPLE.net/fr/2", "https://net", "https://net/", "x://example.com/de/", "x://example.com/de", "http://wexample.com/de/x", "http://b.org/fr/a#/x",
    "http://org/fr/", "nourl", "", None, "http://", "http:///en/", "https://x..net/a", "http://example.net:80/en/", "http://user@example.net/en/", "http://example.net?/en/", "a://b.net/x://c.org/fr/", "http://exÄmple.net/\n",
]


def plain(url, rules=U.RULES):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_equals_the_plain_rules(spark):
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)] + [(1, URLS[1], "r"), (None, URLS[0], "r")], "page_id long, url string, rule string")
    got = U.judge(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(URLS[r.page_id or 0])
    assert U.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in U.judge(df, rules=()).collect()} == {"allow"}


def test_cascade_is_exact_for_its_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = keys[::10]
    c = U.Cascade(universe, listed)
    assert len(c.levels) > 1
    got = {r.key for r in universe.where(c.holds(universe.key)).collect()}
    assert got == set(listed)
