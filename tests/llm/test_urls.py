import random

from possum.llm import urls
from possum.llm.queries import URL_RULES

CASES = {
    None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/en/": ("", "", None, "allow"),
    "http://a.com": ("a.com", "", None, "allow"), "http://a.com/": ("a.com", "/", "com/", "allow"),
    "http://WWW.Example.com/en/x?q": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
    "http://m.example.com/en": ("m.example.com", "/en", "com/", "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "x://a.net/es/#f/es/": ("a.net", "/es/", "net/es/", "block"), "x://net/fr/": ("net", "/fr/", "net/fr/", "block"),
    "x://a.net/de/": ("a.net", "/de/", None, "allow"), "://?": ("", "", None, "allow"), "a://b://c.com/": ("b:", "//c.com/", None, "allow"),
}


def test_cases(spark):
    rows = [(i, u, "x") for i, u in enumerate(CASES)] + [(None, "x://a.net/es/", "y"), (1, "", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, URL_RULES).collect()}
    want = {(i, *CASES[u]) for i, u in enumerate(CASES)} | {(None, *CASES["x://a.net/es/#f/es/"]), (1, *CASES[""])}
    assert got == want
    assert urls.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_trie_against_all_rules():
    r = random.Random(4)
    hosts = [".".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(60)]
    paths = ["/" + "/".join(r.choice(["x", "xy", "y", ""]) for _ in range(r.randint(0, 3))) for _ in range(60)]
    rules = list({(h, p): (r.choice(["allow", "block"]), h, p) for h, p in zip(hosts, paths, strict=True)}.values())
    trie = urls.UrlTrie(rules)
    for _ in range(3000):
        host, path = r.choice(hosts) if r.random() < 0.5 else "z." + r.choice(hosts), r.choice(paths) + r.choice(["", "x", "/q"])
        fits = [(h.count("."), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert trie.match(host, path) == (max(fits)[2:] if fits else None)


def test_block_wins_the_same_place():
    assert urls.UrlTrie([("block", "a", "/"), ("allow", "a", "/")]).match("a", "/") == ("a/", "block")
