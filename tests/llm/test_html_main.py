"""Main text against texts written beside their pages, and against another parser over generated pages."""

from __future__ import annotations

import random
from html import escape
from html.parser import HTMLParser

import pytest

from threadloom.llm import html_main, queries

BOILER = [
    '<nav><ul><li><a href="/x">Home</a><li><a href="/y">More</a></ul></nav>', "<header><div>Site name</div></header>", "<aside><p>Other things</p></aside>", "<form><input name=q><label>Search</label></form>",
    '<div class="ad">Buy this</div>', '<div id="cookie-banner"><p>We use cookies</p><button>Fine</button></div>', "<script>var t='</p><article>no</article>';</script>", "<style>p{color:red}</style>",
    '<section class="comments"><h2>Comments</h2><article><p>first!</p></article></section>', '<ol class="commentlist"><li class="comment">me too</ol>', '<div class="newsletter signup">Letter</div>',
    "<!-- <p>not shown</p> -->", '<div role="navigation">Go</div>', '<div style="display: none">secret</div>', '<p class="notice">Notice</p>', "<footer><p>&copy; site</p></footer>", '<div class="sidebar-left"><p>Left</p></div>',
]

CASES = [
    (None, ""),
    ("", ""),
    ("no markup  at\n all &amp; more", "no markup at all & more"),
    ("<article><h1>A &amp; B</h1><p>one <b>two</b>three<br>four</p><p>&lt;five&gt; &#233;&eacute;&nbsp;x</article>", "A & B\none twothree four\n<five> éé x"),
    ("<body><nav>menu</nav><article><p>a<p>b<div class='ad'>ad</div><aside>side</aside>c</article><footer>f</footer>", "a\nb\nc"),
    ("<body><div class=nav>m</div><div class=content><p>text one</p><p>text two and more words</p></div><div class=footer>f</div>", "text one\ntext two and more words"),
    ("<main><header><h1>Title</h1><div>By me</div></header><p>body</p></main><p>outside</p>", "Title\nbody"),
    ("<article><p>said</p></article><section id=comments><article><p>reply</p></article></section>", "said"),
    ("<section class=comments><article><p>reply</p></article></section><p>said</p>", "said"),
    ("<div class=sidebar>never closed<article><p>text</p></article>", "text"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    ("<article><h2 id=share-prices>Share prices</h2><section id=notice-periods><p>Long.</p></section></article>", "Share prices\nLong."),
    ("<title>t</title><p>x<script>y", "x"),
    ("<p title='a>b'>q</p><a href=\"?id=5&class=ad\">r</a>", "q\nr"),
    ("<article></article><p>only outside</p>", "only outside"),
    ("<body class='ad'><div class='no-sidebar'><p>kept</p></div></body>", "kept"),
    ("<p>a < b and c > d &am &ampx</p>", "a < b and c > d &am &x"),
    ("<div>" * 3000 + "deep" + "</div>" * 2000, "deep"),
    ("<article>" + "<p>word &amp; word</p>" * 30_000 + "</article>", "\n".join(["word & word"] * 30_000)),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_pages(case):
    source, text = CASES[case]
    assert html_main.parsed(source).text() == text


class _Plain(HTMLParser):
    """Blocks of well-formed pages whose article alone holds paragraphs and headings with class ``x``."""

    def __init__(self):
        super().__init__()
        self.blocks, self.own = [], False

    def handle_starttag(self, tag, attrs):
        if ("class", "x") in attrs:
            self.own = True
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "li"):
            self.own = False

    def handle_data(self, data):
        if self.own:
            self.blocks[-1] += data


def _page(rng, site=()):
    words = ["alpha", "b&c", "<x>", "ñandú", "two  words", "it's", '"q"'] + [f"w{rng.randint(0, 10**6)}" for _ in range(9)]
    prose = [f"<{t} class=x>{' '.join(f'<i>{escape(w)}</i>' if rng.random() < 0.2 else escape(w) for w in rng.choices(words, k=rng.randint(1, 30)))}</{t}>\n" for t in ["h1"] + ["p"] * rng.randint(1, 12)]
    for extra in rng.sample(BOILER, 4):
        if "<article>" not in extra or rng.random() < 0.5:
            prose.insert(rng.randint(0, len(prose)), extra)
    around = rng.sample(BOILER, 6)
    body = "".join(prose)
    article = f"<article>{body}</article>" if rng.random() < 0.7 else f"<main>{body}</main>" if rng.random() < 0.5 else f"<div class=content>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{''.join(around[:3])}{''.join(site)}{article}{''.join(around[3:])}</body></html>"


def _plain(source):
    reader = _Plain()
    reader.feed(source)
    return "\n".join(t for t in (" ".join(b.split()) for b in reader.blocks) if t)


def test_query_against_another_parser(spark, tmp_path):
    rng = random.Random(6)
    site = ["<div><p>Terms of <a href=/t>use</a></p></div>", "<table><tr><td>Weather</td></tr></table>"]
    pages = [(i, f"https://a.example/{i}", _page(rng, site[: 1 + i % 2])) for i in range(60)]
    pages += [(100 + i, f"http://Few.example:80/{i}", _page(rng)) for i in range(3)] + [(200, None, _page(rng)), (200, None, None), (None, "", "<p>x</p>"), (201, "http://b.example/", "")]
    spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id long, url string, html string, host string, __host int").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op11_html_text(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(i, u, "x" if i is None else _plain(h or "")) for i, u, h in pages]
    assert sorted(map(str, got.collect())) == sorted(f"Row(page_id={i!r}, url={u!r}, text={t!r}, n_chars={len(t)})" for i, u, t in want)


def test_templates_are_told_from_copies(spark):
    """A site's unnamed box goes; an article held a hundred times over, near copies and a passage many articles share stay."""
    rng = random.Random(7)
    fresh = lambda n: " ".join(f"w{rng.randint(0, 10**7)}" for _ in range(n))
    box, story, passage = "<div class=hint><span>Get our app</span></div>", [fresh(60) for _ in range(5)], fresh(55)
    pages, wanted = [], {}

    def add(blocks, inner, where):
        i = len(pages)
        article = "".join(f"<p>{b}</p>" for b in blocks)
        pages.append((i, f"https://{where}/{i}", f"<body><article>{article}{inner}</article><p>{fresh(3)}</p>"))
        wanted[i] = "\n".join(blocks)

    for _ in range(100):
        add(story, box, "one.example")
        near = list(story)
        near[rng.randrange(5)] += " " + fresh(1)
        add(near, box, "one.example")
    for _ in range(40):
        add([fresh(30), passage], box, "one.example")
    for _ in range(10):
        pages.append((len(pages), f"https://two.example/{len(pages)}", f"<div><p>{passage}</p></div><div>{''.join(f'<p>{b}</p>' for b in story)}</div>"))
        wanted[len(pages) - 1] = "\n".join([passage, *story])
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in html_main.extract(table).collect()}
    assert got == wanted


def test_joined_where_lists_are_many(spark, monkeypatch):
    rng = random.Random(8)
    pages = [(i, f"https://h{i % 3}.example/{i}", f"<div><p>Footer {i % 3}</p></div>" + "".join(f"<p>{rng.random()}</p>" for _ in range(5))) for i in range(60)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    few = sorted(map(tuple, html_main.extract(table).collect()))
    monkeypatch.setattr(html_main, "BROADCAST", 0)
    many = sorted(map(tuple, html_main.extract(table).collect()))
    assert few == many and all("Footer" not in r[2] and r[2].count("\n") == 4 for r in few)
    assert html_main.extract(table.where("false")).count() == 0
