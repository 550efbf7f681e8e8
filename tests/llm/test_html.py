from mnemoframe.llm.html_extract import extract, main_text


def test_article_without_furniture():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=1>Home</a></li></ul></nav>"
        "<div class='ad'>Buy now, really.</div><article><h1>Head</h1><p>First   para &amp; more.<p>Second <b>bold</b> one.</article>"
        "<aside>Other news</aside><div id='cookie-notice'>We use cookies</div><div class='comment-list'><p>Nice text!</p></div><footer>foot</footer></body></html>"
    )
    assert main_text(page) == "Head\nFirst para & more.\nSecond bold one."


def test_density_without_article():
    links = "".join(f"<li><a href={i}>Topic {i}</a></li>" for i in range(8))
    body = "".join(f"<p>Paragraph {i} has quite a number of words, so that it is dense text and not a list of links.</p>" for i in range(4))
    got = main_text(f"<body><div><ul>{links}</ul></div><div><div>{body}</div></div><div><a href=x>x</a> | <a href=y>y</a></div></body>")
    assert got.split("\n") == [f"Paragraph {i} has quite a number of words, so that it is dense text and not a list of links." for i in range(4)]


def test_soup_and_edges():
    assert main_text(None) == main_text("") == main_text("   ") == main_text("<div></div>") == ""
    assert main_text("plain &lt;b&gt; text") == "plain <b> text"
    assert main_text('<p>a<script>var t="</p>";</script>b<!-- no > --> c</p><p') == "ab c"
    assert main_text("<article><p>one<br>two&nbsp;three</p></article>") == "one two three"
    assert main_text("<p>some words" + "<div>" * 5000 + "deep down") == "some words\ndeep down"


def test_rows(spark):
    rows = [(1, "<p>a</p>", "t"), (2, None, "t"), (3, "", "t"), (1, "<p>a</p>", "t")]
    got = extract(spark.createDataFrame(rows, "page_id long, html string, url string"), out="text")
    assert sorted((r.page_id, r.text) for r in got.collect()) == [(1, "a"), (1, "a"), (2, ""), (3, "")]
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
