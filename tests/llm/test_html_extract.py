import random

from pyspark.sql import functions as F

from loomframe.llm.html_extract import Template, _bodies, _code, classes_of, extract, main_text, templates, tokenise

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">a</a><li>b</ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><div id="cookie-notice">ok?</div>
{0}<aside>more</aside><form><p>Name <input name=x></p></form><div class="comments"><p>First!</p></div><footer>&copy; x</footer></body></html>"""


def test_article():
    body = "<article><h1>Head&nbsp;line</h1><p><b>One\n  two<br><p>Tom &amp; <i>Je</i>rry &#233; &lt;b&gt;</p><div class='promo box'>no</div><ul><li>x<li>y</ul>tail</article>"
    want = "Head line\nOne two\nTom & Jerry é <b>\nx\ny\ntail"
    assert main_text(PAGE.format(body)) == want
    assert main_text(PAGE.format(body).replace("article", "div")) == want


def test_broken_markup():
    assert main_text("") == ""
    assert main_text("a < b <p") == "a < b <p"
    assert main_text("<p class='x>open</p>").endswith("open")
    assert main_text("<article><p>a</div></span><p>b") == "a\nb"
    assert main_text("<script>x") == ""
    assert tokenise("<p>" * 3000 + "z").blocks[-1].text == "z"
    assert main_text('<p a="' * 2000) != ""


def test_template_of_a_host(spark):
    page = "<body><div><span>Fixed line of the site</span></div><div><p>Text of page {0}</p><p>and {0} more</p></div><div>Always here</div></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i), "c", "d") for i in range(20)]
    rows += [(100 + i, f"http://few.org/{i}", page.format(i), "c", "d") for i in range(3)]
    rows += [(200, None, None, None, None), (201, "http://h.org/none", "", None, None), (3, "http://h.org/3", page.format(3), "c", "d"), (202, "http://h.org/long", page.format("x " * 300_000), "", "")]
    got = {r["page_id"]: r for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string")).collect()}
    assert got[3].asDict() == {"page_id": 3, "url": "http://h.org/3", "host": "d", "text": "Text of page 3\nand 3 more", "n_chars": 25}
    assert got[101]["text"] == "Fixed line of the site\nText of page 1\nand 1 more\nAlways here"
    assert got[200]["text"] == got[201]["text"] == "" and got[202]["n_chars"] > 500_000
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_copies_of_an_article_are_no_template(spark):
    """Hosts of copies: all of one article, nearly all of one, and near copies whose surroundings differ."""
    page = "<body><div><span>Fixed line</span></div>{0}<footer>page {1}</footer></body>"
    article = "<article><h1>Head</h1><p>One text</p><p>and more</p></article>"
    other = "<article><h1>Head {0}</h1><p>Text {0}</p></article>"
    rows = [(i, f"http://one.org/{i}", page.format(article, i)) for i in range(40)]
    rows += [(100 + i, f"http://most.org/{i}", page.format(article if i < 95 else other.format(i), i)) for i in range(100)]
    rows += [(300 + i, f"http://div.org/{i}", page.format(article.replace("article", "div"), "")) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "Head\nOne text\nand more" for i in [*range(40), *range(100, 195)])
    assert all(got[100 + i] == f"Head {i}\nText {i}" for i in range(95, 100))
    assert all("Head\nOne text\nand more" in got[300 + i] for i in range(40))
    kept = tokenise(page.format(article, 1))
    everything = Template(frozenset(_code(b.text, kept.codes[b.element]) for b in kept.blocks), frozenset(), None)
    assert main_text(page.format(article, 1), everything) == "Head\nOne text\nand more"


PLAIN = "<body><div><ul>{links}</ul></div><div>{ad}</div><div><h1>{head}</h1>{body}</div><div>&copy; the site, {ad}</div></body>"


def plain_pages(rng, hosts=3, pages=15):
    """Pages whose surroundings sit in div elements without a name, and the text of each."""
    words = lambda n: " ".join(rng.choice("stone river cold light under walking".split()) + rng.choice(["", "s", "er"]) for _ in range(n))
    rows, want = [], {}
    for i in range(hosts * pages):
        parts = [words(rng.randint(3, 60)) for _ in range(rng.randint(2, 6))]
        page = PLAIN.format(links="".join(f"<li><a href=x>{words(1)}</a></li>" for _ in range(4)), ad=words(6), head=f"Head {i}", body="".join(f"<p>{x}</p>" for x in parts))
        rows.append((i, f"https://h{i % hosts}.org/{i}", page))
        want[i] = "\n".join([f"Head {i}", *parts])
    return rows, want


def test_the_template_finds_the_text_where_no_name_tells(spark):
    rows, want = plain_pages(random.Random(3))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract(frame).collect()} == want
    twice = {}
    for r in extract(frame.unionAll(frame)).collect():  # repeated rows change no template
        twice.setdefault(r["page_id"], []).append(r["text"])
    assert twice == {k: [v, v] for k, v in want.items()}


def test_classes_against_brute_force(spark):
    """Vectors gathered whole, in plain Python, give the same classes as their fingerprints."""
    rng = random.Random(9)
    rows, _ = plain_pages(rng, hosts=2, pages=20)
    rows += [(100 + i, "https://h0.org/x", f"<body><div><i>{rng.choice('ab')}</i><b>{rng.choice('cd')}</b></div><p>own {i}</p></body>") for i in range(12)]
    rows += rows[:7]
    bodies: dict[str, dict[str, set]] = {}
    for _, url, source in rows:
        page = tokenise(source)
        found = {*page.codes[1:], *(_code(b.text, page.codes[b.element]) for b in page.blocks)}
        bodies.setdefault(url.split("/")[2], {})["\n".join(b.text for b in page.blocks)] = found
    want = set()
    for host, pages in bodies.items():
        vectors: dict[tuple, list] = {}
        for token in set().union(*pages.values()):
            vectors.setdefault(tuple(token in found for found in pages.values()), []).append(token)
        want |= {(host, tuple(sorted(tokens))) for v, tokens in vectors.items() if len(tokens) > 1 and sum(v) >= 0.5 * len(v) and sum(v) >= 5}
    frame = spark.createDataFrame([(u.split("/")[2], h) for _, u, h in rows], "host string, html string")
    got: dict[tuple, list] = {}
    for r in classes_of(_bodies(frame), 0.5, 5).collect():
        got.setdefault((r["host"], r["class"]), []).append(r["token"])
    assert {(host, tuple(sorted(tokens))) for (host, _), tokens in got.items()} == want


def test_tokens_in_changing_order_leave_their_class(spark):
    """Two labelled parts that swap their places share a vector and are left out; the rest of the template stays."""
    one, two = "<section id=a>left of it</section>", "<section id=b>right of it</section>"
    rows = [("h", f"<body><div><b>Fixed</b></div>{one + two if i % 2 else two + one}<p>own {i} and more of it</p></body>") for i in range(10)]
    found = templates(spark.createDataFrame(rows, "host string, html string"), 0.9, 8).first()
    page = tokenise(rows[0][1])
    texts = {_code(b.text, page.codes[b.element]): b.text for b in page.blocks}
    assert {texts[c] for c in found["constants"] if c in texts} == {"Fixed"}
    steady = [("h", r[1].replace(two + one, one + two)) for r in rows]
    found = templates(spark.createDataFrame(steady, "host string, html string"), 0.9, 8).first()
    assert {texts[c] for c in found["constants"] if c in texts} == {"Fixed", "left of it", "right of it"}


def test_columns_of_any_name_stay(spark):
    rows, want = plain_pages(random.Random(4), hosts=1)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    names = ["_host", "host", "_of", "_salt", "_template", "_html", "main"]
    frame = frame.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    got = extract(frame)
    assert got.columns == ["page_id", "url", *names, "text", "n_chars"]
    assert all(r["text"] == want[r["page_id"]] and [r[n] for n in names] == list(range(7)) for r in got.collect())


def test_the_template_decides_before_tags(spark):
    """What varies inside <article> but outside the host's main element goes; a page without that element falls back to its tags."""
    words = lambda i, k: " ".join(f"w{i}x{k}y{j}" for j in range(30))
    page = lambda i: f"<html><body><div><a href='/'>Home</a></div><article><div class='z'><h1>Title {i}</h1><p>{words(i, 1)}</p><p>{words(i, 2)}</p></div><div class='q'><p>Seen {i * 7} times</p></div></article></body></html>"
    rows = [(i, "http://h.example/p", page(i)) for i in range(20)] + [(99, "http://h.example/other", "<html><body><article><p>another kind of page</p></article></body></html>")]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == f"Title 3\n{words(3, 1)}\n{words(3, 2)}" and got[99] == "another kind of page"
    alone = main_text(page(3))
    assert alone.endswith("Seen 21 times")


def test_heavy_templates_are_merged_and_the_texts_stay(spark, monkeypatch):
    """Many hosts, one of which holds a third of the pages: with templates too heavy to broadcast the texts are the same."""
    from loomframe.llm import common

    few, hot = plain_pages(random.Random(5), hosts=12, pages=10), plain_pages(random.Random(6), hosts=1, pages=60)
    rows = few[0] + [(1000 + i, u.replace("h0.org", "hot.org"), h) for i, u, h in hot[0]]
    texts = few[1] | {1000 + i: x for i, x in hot[1].items()}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract(df).collect()} == texts
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 3)
    got = extract(df)
    assert "BroadcastHashJoin LeftOuter" not in got._jdf.queryExecution().executedPlan().toString()
    found = got.collect()
    assert {r["page_id"]: r["text"] for r in found} == texts and len(found) == len(rows)
