"""HTML extraction: templates by counting, against brute force; names and forms that are an article's own."""

import random
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from plumbline.llm import html


def text(h, template=()):
    return html.main_text(h, set(template))


@pytest.mark.parametrize("name", ["chapter-header", "market-share", "social-security", "login", "share", "widget-theory", "header-files", "comment-free-zone"])
def test_an_article_s_own_running_text_stays(name):
    body = "People who sign in twice a day see the same page again and again."
    assert text(f'<article><p>Before.</p><div class="{name}"><h2>Title</h2><p>{body}</p></div></article>') == f"Before.\n\nTitle\n\n{body}"


@pytest.mark.parametrize("name", ["ad", "ad-slot-1", "notice", "cookie-consent", "post-comments", "user-comments", "newsletter", "share-buttons", "social-links", "sidebar", "site-nav", "related-posts", "breadcrumbs", "sponsored", "login"])
def test_what_names_itself_as_no_part_goes(name):
    assert text(f'<article><p>Story.</p><div class="{name}"><a href="/">One</a> <a href="/2">two</a></div><p>End.</p></article>') == "Story.\n\nEnd."


def test_forms_and_stray_ends():
    assert text('<form action="/page.aspx"><div><h1>Title</h1><p>All of this page stands in one form, as some servers write it.</p><input name="q"><select><option>x</option></select></div></form>') == "Title\n\nAll of this page stands in one form, as some servers write it."
    assert text("<article><p>Story that is long enough to be most of it.</p><form><p>Search</p><input></form></article>") == "Story that is long enough to be most of it."
    assert text("<form><article><p>In this story much is told.</p></article></form><p>out of it, less</p>") == "In this story much is told."
    assert text("<form><article><p>In.</p></article></form><p>out of it, at greater length than in it, for the test's sake</p>") == "In.\n\nout of it, at greater length than in it, for the test's sake"
    assert text("one</p>two") == "one\n\ntwo" and text("<article>one</p>two<p>three</article>") == "one\n\ntwo\n\nthree"
    assert text("<article>a &<b>amp;</b> b &lt;c&gt;</article>") == "a &amp; b <c>"


class Tree(HTMLParser):
    """Subtrees of well-formed markup as nested tuples, by the standard library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.stack, self.all = [("root", [])], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.stack.append((tag, []))

    def handle_endtag(self, tag):
        name, children = self.stack.pop()
        if children:
            node = (name, tuple(children))
            self.all.append(node)
            self.stack[-1][1].append(node)

    def handle_data(self, data):
        if data.strip():
            self.stack[-1][1].append(" ".join(data.split()))


def corpus():
    """Pages of two hosts without an article element: only what recurs tells template and story apart."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    menus = [f"<div><span>{word()}</span><span>{word()}</span></div>" for _ in range(3)]
    rows = []
    for i in range(60):
        host = "a.net" if i % 3 else "b.net"
        own = "".join(f"<p>{' '.join(word() for _ in range(8))}</p>" for _ in range(3))
        rows.append((i, f"http://{host}/{i}", f"<div>{menus[i % 2] if host == 'a.net' else menus[2]}<section>{own}</section><div><p>Made by {host}</p></div></div>", own))
    return rows


def test_templates_against_brute_force(spark):
    rows = corpus() + [(100 + i, "http://a.net/again", corpus()[1][2], "") for i in range(9)]  # one page, repeated
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    seen = defaultdict(set)
    for _, url, page, _ in rows:
        for node in Tree(page).all:
            seen[url.split("/")[2], node].add(page)
    want = sorted((host, len(on)) for (host, _), on in seen.items() if len(on) >= 5)
    inline = sorted((host, len(on)) for (host, node), on in seen.items() if len(on) >= 5)
    got = html.site_templates(pages).collect()
    assert sorted((r["host"], r["pages"]) for r in got) == want == inline and len(got) > 10


def test_the_method_and_not_the_names_removes_templates(spark):
    rows = corpus()
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    want = {i: "\n\n".join(own[3:-4].split("</p><p>")) for i, _, _, own in rows}
    assert got == want
    alone = {i: text(page) for i, _, page, _ in rows}  # names and tags alone leave menus and lines in
    assert all(alone[i] != want[i] for i in want)
    few = {r["page_id"]: r["text"] for r in html.extract(pages.where("page_id < 4")).collect()}
    assert few == {i: alone[i] for i in range(4)}  # too few pages: nothing recurs


def test_teasers_that_recur_go_and_the_article_stays(spark):
    teaser = "<article><h2>Most read</h2><p>A story of last week.</p></article>"
    rows = [(i, f"http://a.net/{i}", f"<article><p>Story {i}.</p><div>Print this page</div></article>{teaser}") for i in range(8)]
    rows += [(10 + i, f"http://c.net/{i}", f"<div>x{i}</div><article><p>The same story under many addresses.</p></article>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}." for i in range(8)} | {10 + i: "The same story under many addresses." for i in range(8)}


def test_hot_host_and_odd_rows(spark):
    rows = [(i, "http://hot.net/", f"<div><div>Menu of all</div><p>Own {i} &eacute;</p></div>") for i in range(400)]
    rows += [(1000, None, None), (1001, "no host", "<p>x</p>"), (1002, "http://hot.net/", ""), (1003, "http://hot.net/", "<p>" + "long " * 200_000 + "</p>"), (1001, "no host", "<p>x</p>")]
    got = html.extract(spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, row int, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars", "n_deleted"]
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in got.collect()}
    assert got.count() == len(rows) and all(found[i] == (f"Own {i} é", len(f"Own {i} é")) for i in range(400))
    assert found[1000] == found[1002] == ("", 0) and found[1001] == ("x", 1) and found[1003][1] == 999_999


BODY = "The first paragraph tells at some length what happened in the town last night."


def test_the_main_part_is_chosen_by_its_running_text():
    assert text(f"<p>{BODY}</p><p>{BODY}</p><article class='card'><h3>More</h3><p>Read this too.</p></article>") == f"{BODY}\n\n{BODY}\n\nMore\n\nRead this too."
    assert text(f"<nav>Menu</nav><main><p>{BODY}</p><p>{BODY}</p><article><p>A teaser.</p></article></main><footer>End</footer>") == f"{BODY}\n\n{BODY}\n\nA teaser."
    assert text(f"<main><p>Intro.</p><article><p>{BODY}</p></article></main><p>Short line.</p>") == BODY
    assert text(f"<p>{BODY}</p><div role='MAIN'><p>{BODY} {BODY} {BODY}</p></div>") == f"{BODY} {BODY} {BODY}"
    assert text("<article><p>x</p></article>") == "x" and text("") == "" and text("<nav>only</nav>") == ""


@pytest.mark.parametrize("block", ['<p class="alert">{}</p>', '<div class="story-comment">{}</div>', '<li class="menu-item">{}</li>', '<div class="menu"><p>{}</p></div>', '<p id="notice">{}</p>', '<p>{}</p>'])
def test_running_text_of_an_article_stays_whatever_its_name(block):
    said = "The volcano alert was raised to its third level on Monday, said the judge."
    assert text(f"<article><p>{BODY}</p>{block.format(said)}</article>") == f"{BODY}\n\n{said}"


@pytest.mark.parametrize("block", ['<div class="notice">{}</div>', '<div class="comments"><p>{}</p></div>', '<div class="ad">{}</div>', '<div class="user-comment">{}</div>', '<h2 id="comments">12 comments</h2><div><p>{}</p></div><p>{}</p>', '<h3 class="comments-title">Say something</h3><p>{}</p>', '<aside>{}</aside>'])
def test_notices_adverts_and_readers_comments_go(block):
    said = "I have read all of this and think that somebody should do something about it."
    assert text(f"<article><h1>Title</h1><p>{BODY}</p>{block.replace('{}', said)}</article>") == f"Title\n\n{BODY}"
    if "<h" in block:  # what comes after the next heading of its rank is the article's again
        assert text(f"<article><p>{BODY}</p>{block.replace('{}', said)}<h2>Sources</h2><p>{BODY}</p></article>") == f"{BODY}\n\nSources\n\n{BODY}"


def test_formulas_and_deep_pages():
    assert text(f"<article><p>{BODY} So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>") == f"{BODY} So x=2 holds."
    for deep in (290, 600, 4000):
        page = "<div>" * deep + f"<nav><ul><li>Menu</li></ul></nav><p>{BODY}</p><div class='sidebar'>Side</div>" + "</div>" * deep
        assert text(page) == BODY
    assert BODY in text("<div>" * 20_000 + f"<p>{BODY}</p>")


def test_templates_are_deleted_before_the_main_part_is_chosen(spark, monkeypatch):
    """A notice longer than the story, on every page of the site and named by nothing."""
    notice = f"<div><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p></div>"
    rows = [(i, f"http://a.net/{i}", f"<div><span>Home</span></div>{notice}<article><p>Story {i} is told in seven words here.</p></article>") for i in range(12)]
    rows += [(50 + i, f"http://b.net/{i}", f"<div><span>Home</span></div><p>Alone {i}.</p>") for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = {i: (f"Story {i} is told in seven words here.", 2) for i in range(12)} | {50 + i: (f"Home\n\nAlone {i}.", 0) for i in range(4)}
    got = {r["page_id"]: (r["text"], r["n_deleted"]) for r in html.extract(pages).collect()}
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(got[i][1] > 0 for i in range(12)) and all(got[50 + i][1] == 0 for i in range(4))
    assert text(rows[0][2]).startswith("Home")  # without the count the notice is the main part
    monkeypatch.setattr(html, "MOST_TEMPLATES", 0)  # too many to be broadcast
    assert {r["page_id"]: (r["text"], r["n_deleted"]) for r in html.extract(pages).collect()} == got
