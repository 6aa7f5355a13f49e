from html.parser import HTMLParser

from pyspark.sql import functions as F

from kithline.functions.text import ARTICLE_SELECTORS, article_text

VOID = {"br", "img", "hr", "meta", "link", "input"}


class Tree(HTMLParser):
    """A plain tree of elements: [name, attributes, children]."""

    def __init__(self, html):
        super().__init__()
        self.root = ["root", {}, []]
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "p" and any(e[0] == "p" for e in self.open):
            self.handle_endtag("p")
        e = [tag, dict(attrs), []]
        self.open[-1][2].append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_endtag(self, tag):
        if any(e[0] == tag for e in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(e[0] in ("script", "style") for e in self.open):
            self.open[-1][2].append(data)


def walk(e):
    yield e
    for c in e[2]:
        if isinstance(c, list):
            yield from walk(c)


def strings(e):
    for c in e[2]:
        if isinstance(c, list):
            yield from strings(c)
        elif c.strip():
            yield c.strip()


def expected(html):
    tree, content = Tree(html or "").root, ""
    for kind, value in ARTICLE_SELECTORS:
        test = {"tag": lambda e: e[0] == value, "role": lambda e: e[1].get("role") == value, "class": lambda e: value in (e[1].get("class") or "").split()}[kind]
        if (e := next((x for x in walk(tree) if test(x)), None)) is not None:
            content = " ".join(strings(e))
            if len(content) > 200:
                break
    if len(content) < 200:
        content = " ".join("".join(strings(e)) for e in walk(tree) if e[0] == "p")
    return content


LONG = "word " * 50
PAGES = [
    f"<body><nav>menu</nav><article><h1>T</h1><article>inner {LONG}</article> after</article><footer>f</footer></body>",
    f"<div id='x' role=\"main\"><div>{LONG}<div>deep</div></div>tail</div> out",
    f"<div class='a post-content b'><p>{LONG}</p><div class='c'>more</div></div><p>never</p>",
    f"<div class='post-contents'>{LONG}</div><p>only this</p><p> and <b>this</b></p>",
    f"<article>short</article><div class='story-body'>{LONG} body</div>",
    f"<article>{LONG}</article><div class='story-body'>{LONG} body</div>",
    "<article>short</article><p>one</p><p>two &amp; three &lt;b&gt;</p>",
    f"<article data-x='a > b' class=entry-content>{LONG}<script>var a = '</article>';</script><!-- </article> -->end</article>x",
    f"<ARTICLE>{LONG}<br/>line</ARTICLE>", f"<article>{LONG} never closed", "<article>" + "y" * 200 + "</article><p>p</p>", "<article>" + "y" * 199 + "</article><p>p</p>",
    "a < b and <p>x < y</p>", "", None, "no tags", "<p>a<p>b</p>", f"<articles>{LONG}</articles><p>z</p>",
]


def test_against_a_parser(spark):
    rows = spark.createDataFrame(list(enumerate(PAGES)), "i int, html string").withColumn("text", article_text(F.col("html"))).collect()
    for r in rows:
        assert r.text == expected(r.html), (r.i, r.html)
