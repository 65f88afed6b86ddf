import random
import re

import pytest

from loamwork.llm import html_content
from loamwork.llm.html_content import extract, extract_pages, op6_html_content

LEAD = "The council met on Tuesday, and its members talked for three hours about the bridge."
MORE = "It was built in 1911; since then, engineers say, it has carried more than it was made for."
LAST = "A vote is due in May. Until then, the bridge stays open to cars, though not to lorries."
ITEMS = ["Repairs would take two years.", "A new bridge would take five.", "Nobody knows the costs."]
LINKS = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sport", "Weather", "Contact"))
STORY = f"<p>{LEAD}</p><p>{MORE}</p><p>{LAST}</p>"
TEXT = f"The old bridge\n{LEAD}\n{MORE}\n{LAST}"
REMARK = "<p>I think that the council is wrong about this, as it always has been, and I have lived here for forty years.</p>"

PAGES = {
    "sidebar and comments by id": f"""<html><body><div id="page"><div id="header"><h2>Daily Post</h2><p>News of the town since 1890, every day.</p></div><div id="menu"><ul>{LINKS}</ul></div>
<div id="sidebar"><h3>About</h3><p>We are a small paper with a long history, and we like letters.</p></div>
<div id="content"><h1>The old bridge</h1>{STORY}<div class="share">Share this: <a href="#">mail</a></div><div id="comments"><h3>2 comments</h3>{REMARK}{REMARK}</div></div>
<div id="footer"><p>Copyright 2020, all rights reserved, Daily Post Ltd.</p></div></div></body></html>""",
    "article with header, form and aside": f"""<body><header><a href="/">Post</a></header><main><article><header><h1>The old bridge</h1></header>{STORY}
<aside><p>Read also: the old mill, its wheel, and what became of the miller.</p></aside><form><p>Sign up for our newsletter, it is free.</p><input><button>Go</button></form>
<section class="comments"><h2>Comments</h2>{REMARK}</section></article></main><footer>Imprint</footer></body>""",
    "cookie notice and adverts": f"""<body><div class="cookie-banner" role="alert"><p>We use cookies, for many reasons, and you can say no to some of them, if you like.</p></div><nav>{LINKS}</nav>
<div class="ad-slot">Buy two, get one free, only today, only here!</div><div class="post"><h1>The old bridge</h1><p>{LEAD}</p><div class="advertisement"><p>Shoes, hats and coats, all for less.</p></div><p>{MORE}</p><p>{LAST}</p></div></body>""",
    "no class names": f"""<body><div><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a></div><div><h1>The old bridge</h1><div>{LEAD}</div><div>{MORE}</div><div>{LAST}</div></div><div><a href="/i">Imprint</a> <a href="/p">Privacy</a></div></body>""",
    "threaded comments": f"""<body><div class="entry-content"><h1>The old bridge</h1>{STORY}</div><ol class="commentlist"><li class="comment">{REMARK}</li><li class="comment">{REMARK}</li></ol><div id="respond"><h3>Leave a Reply</h3></div></body>""",
    "unclosed tags": f"""<body><ul>{LINKS}</ul><article><h1>The old bridge</h1><p><b>{LEAD}<br><p>{MORE}<p>{LAST}</article><footer>&copy; Post</footer></body>""",
    "script and style inside": f"""<body><article><h1>The old bridge</h1><p>{LEAD}</p><script>var s = "</p><p>no</p>"; if (a < b) track();</script><style>p {{ color: red }}</style><p>{MORE}</p><!-- <p>hidden</p> --><noscript><p>Turn on scripts.</p></noscript><p>{LAST}</p></article></body>""",
    "white space and references": f"""<body><main><h1>The\n  old&nbsp;bridge</h1><p>\t{LEAD.replace("and", "&#97;nd")}\n</p><p>{MORE.replace(";", "&#59;")}</p><div>{LAST.replace(" ", "  ")}</div></main></body>""",
    "table layout": f"""<body><table><tr><td><a href="/">Home</a><br><a href="/n">News</a></td><td><h1>The old bridge</h1>{STORY}</td></tr></table></body>""",
    "hidden parts": f"""<body><article><h1>The old bridge</h1><div hidden><p>{REMARK}</p></div><p>{LEAD}</p><p style="display: none">Nobody sees this, nor should they, for it is not there.</p><p>{MORE}</p><p aria-hidden="true">x</p><p>{LAST}</p></article></body>""",
}


@pytest.mark.parametrize("kind", list(PAGES))
def test_templates(kind):
    assert extract(PAGES[kind]) == TEXT


def test_all_kinds_of_blocks_stay():
    page = f"""<body><nav>{LINKS}</nav><article><h1>The old bridge</h1><p>{LEAD}</p><h2>What it costs</h2><ul>{"".join(f"<li>{x}</li>" for x in ITEMS)}</ul><blockquote><p>{MORE}</p></blockquote>
<table><tr><th>Year</th><th>Cost</th></tr><tr><td>1911</td><td>12</td></tr></table><figure><img src="x"><figcaption>The bridge in 1911.</figcaption></figure><pre>a  b</pre><dl><dt>Span</dt><dd>90 m</dd></dl><p>{LAST}</p></article></body>"""
    assert extract(page).split("\n") == ["The old bridge", LEAD, "What it costs", *ITEMS, MORE, "Year", "Cost", "1911", "12", "The bridge in 1911.", "a b", "Span", "90 m", LAST]


@pytest.mark.parametrize("page", [None, "", " ", "<", "<html><head><title>x</title></head><body></body></html>", "<script>x", "<!--", "<a", "<p", "</p></div>"])
def test_nothing(page):
    assert extract(page) in ("", "<")


def test_plain_text_and_markup_characters():
    assert extract("just text") == "just text"
    assert extract(f"<p>{LEAD} 3 < 4 &lt;b&gt; &amp;amp; &unknown;</p>") == f"{LEAD} 3 < 4 <b> &amp; &unknown;"


def test_lists_of_links():
    sources = "".join(f'<li><a href="/{i}">The long title of a source that the story cites, part {i}</a></li>' for i in range(4))
    assert extract(f"<article><h1>T</h1>{STORY}<h2>Sources</h2><ul>{sources}</ul></article>").count("The long title") == 4
    assert "Sport" not in extract(f"<article><h1>T</h1><ul>{LINKS}</ul>{STORY}</article>")


def test_data_tables_stay_with_their_text():
    rows = "".join(f"<tr><td>{MORE}</td><td>{i}</td></tr>" for i in range(40))
    got = extract(f"<body><div><h1>T</h1><p>{LEAD}</p><table>{rows}</table><p>{LAST}</p></div></body>").split("\n")
    assert got[:2] == ["T", LEAD] and got[-1] == LAST and got.count(MORE) == 40


def test_very_deep_and_very_long():
    assert extract("<article>" + "<b><div>" * 20_000 + f"<p>{LEAD}</p>" + "</div></b>" * 20_000 + f"<p>{LAST}</p></article>") == f"{LEAD}\n{LAST}"
    assert extract("<div>" * 3000 + LEAD) == LEAD
    assert extract(f"<article><h1>T</h1>{STORY * 3000}</article>").count("\n") == 9000


def test_driver_pages(spark):
    folder = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        lines = [" ".join(re.sub(r"<[^>]*>", " ", x).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        for a, b in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
            lines = [x.replace(a, b) for x in lines]
        want[r.page_id] = "\n".join(filter(None, lines))
    got = op6_html_content(spark, folder).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (1, "u", "<p>x</p>"), (None, "u", "<p>x</p>"), (1, "u", "<p>x</p>")], "page_id long, url string, html string").withColumnRenamed("url", "TEXT_url")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in extract_pages(rows, ["page_id", "TEXT_url"]).collect()) == [("1", "", 0), ("1", "x", 1), ("1", "x", 1), ("None", "x", 1)]
    assert extract_pages(rows.limit(0), ["page_id"]).count() == 0


LONG = "This is a paragraph of the article, with commas, and a full stop at its end; it goes on for a while."


def test_a_page_in_one_form():
    page = f'<body><form id="aspnetForm"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><div class="share">Share this</div></form></body>'
    assert extract(page) == f"Title\n{LONG}\n{LONG}"
    aside = f"<body><div><p>{LONG}</p><p>{LONG}</p></div><form><p>Write to us, please.</p></form></body>"
    assert extract(aside) == f"{LONG}\n{LONG}"


def test_link_lists_between_paragraphs_stay():
    links = "<ul>" + "".join(f'<li><a href="/{t}">{t}</a></li>' for t in ("Paris", "Rome", "Oslo", "Bern")) + "</ul>"
    page = f"<body><article><p>{LONG}</p>{links}<p>{LONG}</p></article></body>"
    assert extract(page) == f"{LONG}\nParis\nRome\nOslo\nBern\n{LONG}"
    assert extract(f"<body><article>{links}<p>{LONG}</p><p>{LONG}</p></article></body>") == f"{LONG}\n{LONG}"


def test_words_in_classes_and_ids_do_not_drop_content():
    part = f"<p>{LONG}</p>"
    wrap = f'<body><p>Top of the page</p><div class="content-sidebar-wrap"><article>{part * 3}</article><div class="sidebar"><p>Elsewhere, more.</p></div></div></body>'
    assert extract(wrap) == "\n".join([LONG] * 3)
    paper = f'<body><article>{part}<section id="discussion">{part}</section><div class="notice">{part}</div><div class="newsletter">{part}</div>{part}</article><div id="discussion">{part}</div></body>'
    assert extract(paper) == "\n".join([LONG] * 4)


def test_an_articles_own_parts_stay():
    part = f"<p>{LONG}</p>"
    for own in ('<section class="related-work">', '<div id="discussion">', '<div class="notice-of-death">', '<section id="menu-of-the-day">', '<div class="response">'):
        end = own.split()[0].replace("<", "</") + ">"
        assert extract(f"<body><nav>{LINKS}</nav><article><h1>T</h1>{part * 2}{own}<h2>More</h2>{part}{end}</article></body>") == "\n".join(["T", LONG, LONG, "More", LONG]), own
        assert extract(f"<body><div><h1>T</h1>{part * 2}{own}<h2>More</h2>{part}{end}{part}</div></body>") == "\n".join(["T", LONG, LONG, "More", LONG, LONG]), own


def test_an_advert_without_a_name_beside_the_story():
    menu = '<div><a href="/">Home</a> <a href="/n">News</a></div>'
    for offer in ("<div>Buy two, get one free, only today!</div>", "<div><p>Shoes for less.</p><p>Hats for nothing.</p></div>", "<table><tr><td>Sale</td></tr></table>"):
        assert extract(f"<body>{menu}<div><h1>The old bridge</h1>{STORY}</div>{offer}{menu}</body>") == TEXT
        assert extract(f"<body>{menu}<h1>The old bridge</h1><div>{STORY}</div>{offer}{menu}</body>") == TEXT
        assert extract(f"<body>{offer}{menu}<h1>The old bridge</h1>{STORY}{menu}</body>") == TEXT


def test_remarks_alone_are_no_article():
    assert extract(f'<body><div class="comments"><h2>2 comments</h2>{REMARK * 2}</div></body>') == ""
    assert extract(f'<body><ol class="commentlist"><li class="comment">{REMARK}</li></ol></body>') == ""
    remarks = f'<div id="discussion"><div class="item">{REMARK}</div><div class="item">{REMARK}</div></div>'
    assert extract(f"<body><div><h1>The old bridge</h1>{STORY}{remarks}<p>{LONG}</p></div></body>") == f"{TEXT}\n{LONG}"


def test_the_ratios_decide(monkeypatch, spark):
    """Without names and articles, pages come out otherwise when all ratios are alike."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    bare = [re.sub(r"</?article>", "", r.html).replace(' class="ad"', "").replace("nav>", "div>").replace("footer>", "div>") for r in rows]
    with_ratios = [extract(p) for p in bare]
    monkeypatch.setattr(html_content, "_ratios", lambda blocks, linked=True: [1.0] * len(blocks))
    assert sum(extract(p) != t for p, t in zip(bare, with_ratios, strict=True)) > 0.9 * len(bare)


def sentence(rng):
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(8, 30))]
    words[rng.randrange(len(words) - 1)] += ","
    return " ".join(words).capitalize() + "."


@pytest.mark.parametrize("seed", range(60))
def test_pages_put_together_at_random(seed):
    """Articles of all kinds of parts within random wrappers and beside random parts that are not theirs."""
    rng = random.Random(seed)
    lines, parts = [], []

    def part(tag, text):
        lines.append(text)
        return f"<{tag}>{text.replace('.', '<b>.</b>') if rng.random() < 0.3 else text}</{tag}>"

    parts.append(part("h1", "A title of some words"))
    for _ in range(rng.randint(3, 9)):
        kind = rng.choice(["p", "p", "p", "h2", "ul", "quote", "table", "figure"])
        if kind in ("p", "h2"):
            parts.append(part("p", " ".join(sentence(rng) for _ in range(rng.randint(1, 4)))) if kind == "p" else part("h2", "A heading") + part("p", sentence(rng)))
        elif kind == "ul":
            parts.append("<ul>" + "".join(part("li", sentence(rng)) for _ in range(3)) + "</ul>")
        elif kind == "quote":
            parts.append("<blockquote>" + part("p", sentence(rng)) + "</blockquote>")
        elif kind == "table":
            parts.append("<table>" + "".join("<tr>" + part("td", f"Row {k}") + part("td", str(k)) + "</tr>" for k in range(3)) + "</table>")
        else:
            parts.append("<figure><img src=x>" + part("figcaption", sentence(rng)) + "</figure>")
    parts.append(part("p", " ".join(sentence(rng) for _ in range(3))))
    inside = ["", '<div class="share-buttons">Share: <a href=#>mail</a></div>', '<aside><p>Read this too.</p></aside>', '<div class="ad">Buy it now!</div>', "<script>x('<p>')</script>"]
    story = "".join(x + rng.choice(inside) for x in parts)
    tags = rng.choice(["article", "main", 'div class="content"', "div", 'div id="story"', "section"])
    story = f"<{tags}>{story}</{tags.split()[0]}>"
    for _ in range(rng.randint(0, 3)):
        story = f"<div>{story}</div>"
    before = ["<nav><ul>" + LINKS + "</ul></nav>", '<div class="cookie-notice"><p>We use cookies, as all do.</p></div>', '<header><a href="/">Site</a></header>', '<div id="menu"><ul>' + LINKS + "</ul></div>"]
    after = ["<footer>Imprint, and so on.</footer>", f'<div class="comments">{REMARK}{REMARK}</div>', '<div class="sidebar"><h3>About</h3><p>We write, and you read.</p></div>', "<form><p>Sign up.</p><input></form>", f'<section id="comments"><ol><li>{REMARK}</li></ol></section>', '<div class="related-posts"><ul>' + LINKS + "</ul></div>"]
    page = "<html><head><title>t</title></head><body>" + "".join(rng.sample(before, rng.randint(0, 3))) + story + "".join(rng.sample(after, rng.randint(0, 4))) + "</body></html>"
    assert extract(page).split("\n") == lines


def test_kept_columns_that_clash(spark):
    rows = spark.createDataFrame([(1, "<p>x</p>", "old", 9)], "page_id long, html string, Text string, n_chars int")
    assert [tuple(r) for r in extract_pages(rows, ["page_id", "Text", "n_chars", "html"]).collect()] == [(1, "<p>x</p>", "x", 1)]
