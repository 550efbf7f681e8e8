"""Pages where neither an article element nor an honest class says where the text is."""

import pytest

from mnemoframe.llm import html_extract
from mnemoframe.llm.html_extract import main_text

PARAS = [f"Paragraph {i} has quite a number of words, so that it is dense text and not a list of links at all." for i in range(5)]
BODY = "".join(f"<p>{x}</p>" for x in PARAS)
WANT = "\n".join(PARAS)
MENU = "<div>" + "".join(f'<a href="/{i}">Topic {i}</a> ' for i in range(12)) + "</div>"
COMMENTS = "".join(f"<div><b>user{i}</b> <a href=u>reply</a> <a href=v>like</a> <span>so true</span></div>" for i in range(6))

PAGES = {
    "misleading id": f"<body>{MENU}<div id=discussion>{BODY}</div><div>{COMMENTS}</div></body>",
    "menu without nav": f"<body>{MENU}<div><div>{BODY}</div></div><div><a href=x>x</a> | <a href=y>y</a></div></body>",
    "comments without a class": f"<body><div>{BODY}</div><div>{COMMENTS}</div></body>",
    "advert named so": f"<body><div class='ad'>Buy now, this is really cheap today.</div><div>{BODY}</div></body>",
    "whole page in a form": f"<form action=x><input name=v><div>{MENU}</div><div>{BODY}</div><button>Send</button></form>",
    "apostrophe in an unquoted value": f"<body><p><a href=it's>{PARAS[0]}</a></p>" + "".join(f"<p>{x}</p>" for x in PARAS[1:]) + "</body>",
    "named comments in the article": f"<article>{BODY}<div class='comment-list'>" + "<p>I think that this is a fine text and I say so at some length.</p>" * 2 + "</div></article>",
    "advert in the article": f"<article>{''.join(f'<p>{x}</p>' for x in PARAS[:2])}<div class=ad><a href=b>Buy</a> <b>now</b></div>{''.join(f'<p>{x}</p>' for x in PARAS[2:])}</article>",
    "search form beside": f"<body><div>{BODY}</div><form><label>Find</label><input> <p>Type a word</p></form></body>",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages(name):
    assert main_text(PAGES[name]) == WANT


@pytest.mark.parametrize("named", ["section id=discussion", "div id=related-work", "section class='notice-period'", "div class=share", "div class=rail", "div class=reply", "section id='search-methods'"])
def test_sections_of_an_article_stay(named):
    tag = named.split()[0]
    page = f"<body><nav><a href=1>Home</a></nav><article><h1>Head</h1>{BODY}<{named}><h2>More</h2><p>{PARAS[0]}</p></{tag}></article></body>"
    assert main_text(page) == f"Head\n{WANT}\nMore\n{PARAS[0]}"


def test_references_and_headings_with_ids_stay():
    refs = "".join(f"<li><a href={i}>A reference of some length, number {i}</a></li>" for i in range(3))
    got = main_text(f"<article><h2 id='related-work'>Related</h2>{BODY}<ul>{refs}</ul></article>")
    assert got == "\n".join(["Related", WANT, *(f"A reference of some length, number {i}" for i in range(3))])


def test_the_densest_of_several_articles():
    cards = "".join(f"<article><h3><a href={i}>Teaser {i}</a></h3><p>Short.</p></article>" for i in range(9))
    assert main_text(f"<body>{cards}<article><h1>Head</h1>{BODY}</article>{cards}</body>") == f"Head\n{WANT}"


def test_densities_decide(monkeypatch):
    """With equal densities for all nodes, most of the pages above give another text."""
    real = html_extract._measure

    def flat(body):
        nodes = real(body)
        for n in nodes:
            n.density = 1.0
        for n in nodes:
            n.total = float(sum(not isinstance(x, str) and not x.gone for x in n.items))
        return nodes

    monkeypatch.setattr(html_extract, "_measure", flat)
    assert sum(main_text(p) != WANT for p in PAGES.values()) >= len(PAGES) // 2


def test_ties_and_clashing_columns(spark):
    assert main_text(f"<div>{BODY}</div><div>{BODY}</div>") in (WANT, f"{WANT}\n{WANT}")
    rows = [(1, "<p>a", "old"), (1, "<p>a", "old"), (None, None, None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted(((r.page_id, r.text) for r in got), key=str) == [(1, "a"), (1, "a"), (None, "")]


def test_given_pages(spark):
    """An article between menu, advert and footer: all of it and nothing else, by a plain reading of the known layout."""
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:h1|p)>", inner)
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
        assert main_text(r.html) == "\n".join(x for x in plain if x), r.page_id


def test_nothing_in_an_article_goes_by_its_name_or_for_its_links():
    links = "".join(f"<li><a href={i}>Reference {i}</a></li>" for i in range(4))
    listed = "\n".join(f"Reference {i}" for i in range(4))
    assert main_text(f"<article><h1 class='banner'>Title</h1>{BODY}</article>") == f"Title\n{WANT}"
    assert main_text(f"<article>{BODY}<p>Press <button>OK</button> now</p><p>See <label>Fig</label> caption</p></article>") == f"{WANT}\nPress OK now\nSee Fig caption"
    assert main_text(f"<body><div>{BODY}<ul>{links}</ul></div></body>") == f"{WANT}\n{listed}"
    assert main_text(f"<article>{BODY}<div><button>Share</button></div><div><label>Name</label></div></article>") == WANT


@pytest.mark.parametrize("box", ["div class='advert-box'", "div class=ad-unit", "section class=notice", "div id=newsletter", "p class=sponsored-by"])
def test_adverts_and_notices_go_however_dense(box):
    text = "Buy now! This is a long text without any link, which a density alone would take for a paragraph of the article itself."
    assert main_text(f"<article>{BODY}<{box}>{text}</{box.split()[0]}></article>") == WANT


def test_time_is_in_proportion_to_length():
    import time

    began = time.time()
    for page in ("<div>" * 20_000 + "</section>" * 20_000, "<b>" * 10_000 + "<header>" * 10_000, "<b><div>" + "<i>" * 20_000 + "</b>" * 20_000, "<p><span>" * 10_000 + "<li>" * 10_000, "<div><button>" * 10_000):
        html_extract.parse(page)
    assert time.time() - began < 10


def test_equals_a_tree_walk():
    """Pages drawn at random: the article's text as the standard parser and a recursive walk give it."""
    import random
    from html import escape
    from html.parser import HTMLParser

    class Walk(HTMLParser):
        skip = {"script", "style", "nav", "aside", "footer", "form"}
        block = {"p", "h1", "h2", "ul", "li", "div", "blockquote", "article", *skip}

        def __init__(self):
            super().__init__()
            self.depth, self.skipped, self.blocks = 0, 0, [""]

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.depth += 1
            if tag in self.skip or dict(attrs).get("class") in ("ad", "notice"):
                self.skipped += 1
            elif self.skipped and tag not in ("br", "input"):
                self.skipped += 1
            if tag in self.block:
                self.blocks.append("")
            if tag == "br":
                self.handle_data(" ")

        def handle_endtag(self, tag):
            if self.skipped:
                self.skipped -= 1
            if tag == "article":
                self.depth -= 1
            if tag in self.block:
                self.blocks.append("")

        def handle_data(self, data):
            if self.depth and not self.skipped:
                self.blocks[-1] += data

    rng = random.Random(11)
    word = lambda: rng.choice(["alpha", "béta", "x < y", "R&D", "日本", "don't", "omega.", "\n line", "a" * 12])
    words = lambda n: escape(" ".join(word() for _ in range(n)), quote=False)

    def inline(n):
        out = words(n)
        for _ in range(rng.randrange(3)):
            out += rng.choice([f" <b>{words(2)}</b> ", f" <a href='/x?a=1&amp;b=2'>{words(1)}</a> ", "<br>", f"<em>{words(1)}</em>,", "<!-- no <p> here -->", f" <span class='has-menu'>{words(1)}</span> "]) + words(3)
        return out

    def piece():
        return rng.choice([
            lambda: f"<p>{inline(25)}</p>", lambda: f"<h2 id='related-{rng.randrange(9)}'>{words(3)}</h2>", lambda: "<ul>" + "".join(f"<li>{inline(8)}</li>" for _ in range(3)) + "</ul>",
            lambda: f"<blockquote><p>{inline(20)}</p></blockquote>", lambda: f"<div><p>{inline(30)}</p></div>", lambda: f"<script>if (a<b) {{ '{'<p>'}' }}</script>", lambda: f"<aside><p>{words(9)}</p></aside>",
            lambda: f"<div class='ad'>{words(4)}</div>", lambda: f"<div class='notice'>{words(4)}</div>",
        ])()

    for _ in range(300):
        body = "".join(piece() for _ in range(rng.randrange(3, 12))) + "".join(f"<p>{inline(30)}</p>" for _ in range(4))
        page = f"<!doctype html><html lang=en><head><title>T</title></head><body><nav><ul><li><a href=1>Home</a></li></ul></nav><div class='sidebar'><a href=2>x</a></div><article><h1>{words(3)}</h1>{body}</article><footer>f</footer></body></html>"
        walk = Walk()
        walk.feed(page)
        assert main_text(page) == "\n".join(b for x in walk.blocks if (b := " ".join(x.split())))
