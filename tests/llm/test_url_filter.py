import random
import re

from loomframe.llm.queries import SITE_RULES
from loomframe.llm.url_filter import STOCK_GLOBS, ShiftAnd, filter_urls, rules_of


def as_regex(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i] == "*":
            deep = glob[i : i + 2] == "**"
            out, i = out + (".*" if deep else "[^/]*"), i + 1 + deep
        else:
            out, i = out + ("[^/]" if glob[i] == "?" else re.escape(glob[i])), i + 1
    return re.compile(out, re.DOTALL)


def test_automaton_equals_regular_expressions():
    rng = random.Random(5)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", ".c"]) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    urls = ["".join(rng.choice("ab/.c") for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["", "a" * 5000]
    hit = ShiftAnd(globs).run([u.encode() for u in urls])
    for g, glob in enumerate(globs):
        rx = as_regex(glob)
        assert [bool(rx.fullmatch(u)) for u in urls] == hit[:, g].tolist(), glob


def test_rules(spark):
    urls = {
        "https://Example.COM/en/1": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/x?y#z": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "http://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
        "http://x.net/q/a.com/": ("x.net", "/q/a.com/", None, "allow"),
        "http://x.com": ("x.com", "", None, "allow"),
        "http://x.com#/a": ("x.com", "", None, "allow"),
        "http://casino-win.example.org/": ("casino-win.example.org", "/", None, "block"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://ü.net/fr/é": ("ü.net", "/fr/é", "net/fr/", "block"),
        "http://x.net/" + "p" * 100_000: ("x.net", "/" + "p" * 100_000, None, "allow"),
    }
    rows = [(i, u, "r", "v") for i, u in enumerate(urls)] + [(99, None, None, None), (None, "http://x.com/", None, None)]
    got = {r["page_id"]: r for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string"), SITE_RULES).collect()}
    for i, want in enumerate(urls.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == want
    assert (got[99]["host"], got[99]["path"], got[99]["rule"], got[99]["verdict"]) == ("", "", None, "allow")
    assert got[None]["rule"] == "com/"
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), SITE_RULES).collect() == []


def test_rules_from_a_table_and_the_stock_list(spark):
    table = spark.createDataFrame([("*.org/**/old/**", "block"), ("*.org/**", "allow"), (None, "block"), ("*.de/?", None), ("*.de/?", None)], "glob string, verdict string")
    rules = rules_of(table)
    assert [(r.glob, r.verdict) for r in rules] == [("*.de/?", "block"), ("*.org/**", "allow"), ("*.org/**/old/**", "block")]
    want = {
        "http://a.de/x": ("block", "allow"), "http://a.de/xy": ("allow", "allow"), "http://poker-4u.net/a": ("allow", "block"), "http://shop.net/cart/7": ("allow", "block"),
        "http://shop.net/a/b/search": ("allow", "block"), "http://news.net/a/photo.jpg": ("allow", "block"), "http://cdn.news.net/x": ("allow", "block"), "http://news.net/cartoons/research": ("allow", "allow"), "http://a.org/old/": ("allow", "allow"),
    }
    frame = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = [{r["page_id"]: r["verdict"] for r in filter_urls(frame, (), g).collect()} for g in (rules, STOCK_GLOBS)]
    for i, (own, stock) in enumerate(want.values()):
        assert (got[0][i], got[1][i]) == (own, stock), list(want)[i]
