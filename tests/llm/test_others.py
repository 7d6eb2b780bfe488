import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import html, langid, mixing, quality, queries, topk
from tests.conftest import SMALL
from tests.oracle import same


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name], SMALL)


# quality


def test_quality_against_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op4_quality_classifier(spark, "/root/testdata/sf0.01")
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    kept = [r["is_good"] for r in rows if r["quality"] == 1]
    dropped = [not r["is_good"] for r in rows if r["quality"] == 0]
    assert sum(kept) / len(kept) > 0.98 and sum(dropped) / len(dropped) > 0.95


def test_quality_edges(spark):
    model = quality.learn(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert all(a > 0.5 for a in model["accuracy"]) and 0.5 < model["prior"] < 1
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "A plain sentence stands here.", 0), (5, "spam " * 60_000, 0), (4, "A plain sentence stands here.", 0)], "doc_id long, text string, score int")
    rows = quality.score(df, model, ["doc_id", "text"]).collect()
    assert len(rows) == 6 and {r["doc_id"]: r["is_good"] for r in rows} == {1: False, 2: False, 3: False, 4: True, 5: False}
    with pytest.raises(ValueError, match="names"):
        quality.score(df, model, ["score"])
    assert quality.score(df, model, ["score"], names=("a", "b", "c")).columns == ["score", "a", "b", "c"]
    empty = quality.learn(df.where("false"))
    assert quality.score(df.where("false"), empty, ["doc_id"]).count() == 0 and quality.score(df, empty, ["doc_id"]).count() == 6


def test_label_model_recovers_accuracies():
    draw = np.random.default_rng(1)
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.7, 0.9, 0.95])
    good = draw.random(20000) < 0.8
    votes = np.where(draw.random((20000, 8)) < right, 1, -1) * np.where(good, 1, -1)[:, None] * (draw.random((20000, 8)) < 0.7)
    patterns, counts = np.unique(quality.pattern_of(votes), return_counts=True)
    posterior, accuracy, prior = quality.fit(patterns, counts.astype(float))
    assert accuracy == pytest.approx(right, abs=0.03) and prior == pytest.approx(0.8, abs=0.02)


# HTML


def text(h, template=()):
    return html.main_text(h, set(template))


def test_html_shapes():
    assert text("") == "" and text("plain &amp; simple") == "plain & simple"
    page = '<html><head><title>no</title></head><body><nav>menu</nav><div class="ad banner">buy</div><article><h1>T &lt;1&gt;</h1><p><b>a</b>b<br>c\n d<p>e<!-- x --><script>var t="</p>";</script>f</p><div class="newsletter">join</div><ul><li>one<li>two</ul><form>q</form><pre>x  y</pre></article><section id="comments"><article>reader</article></section><footer>end</footer>'
    assert text(page) == "T <1>\n\nab c d\n\nef\n\none\n\ntwo\n\nx y"
    assert text("<main><p>in<aside>out</aside></main><p>after") == "in"
    assert text("<p>1 < 2 &am & &#x41;&nbsp;B<p cla") == "1 < 2 &am & A B"
    assert text("<article><header><h1>Head</h1></header>body</article>") == "Head\n\nbody"
    assert text('<div class="page with-sidebar"><article><div class="post-header"><h1>H</h1></div>b<div class="commentlist">c</div><div class="site-header">s</div></article></div>') == "H\n\nb"
    assert text('<div id="content"><p>kept</p></div><div class="right side-bar">s</div><div id="ad-slot-1">a</div><div class="cookiebar">c</div>') == "kept"
    assert text("<table><tr><td>a<td>b<tr><th>c</table>") == "a b\n\nc"
    assert text('<p>a<a href="/cut off') == "a" and text('<p title="x>y</p>b') == "y\n\nb"
    assert text("<p>it's<b title='q>r'>s</b></") == "it'ss"
    for deep in ("<div>", "<article>", "<b>", "<ul><li>"):
        assert text(deep * 3000 + "deep") == "deep" and len(html.candidates(html.parse(deep * 3000 + "deep"))) <= 300
    assert text("<div>" * 600 + "a" + "</div>" * 600 + "b") == "a\n\nb"
    assert text("<article hidden>x</article><article>y</article>") == "y" and text("<style>p{}</style><script>never closed") == ""


def test_templates_are_found_per_host(spark):
    rows = [(i, f"http://a.net/{i}", f"<div><div><span>Welcome to A</span></div><p>Story number {i}.</p></div>") for i in range(12)]
    rows += [(100 + i, f"http://b.net/{i}", f"<article><p>Shared opening.</p><p>Own {i}</p><div>Read more here</div></article>") for i in range(12)]
    rows += [(200, None, None), (201, "http://c.net/", ""), (202, "http://c.net/", "<p>Welcome to A</p>"), (0, "http://a.net/0", rows[0][2])]
    got = html.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, template string")).collect()
    found = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert found[3] == "Story number 3." and found[103] == "Shared opening.\n\nOwn 3"
    assert found[200] == found[201] == "" and found[202] == "Welcome to A"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_templates_are_counted_over_whole_pages(spark):
    rows = [(i, f"http://a.net/{i}", f"<nav><ul><li>Home</li></ul></nav><article><p>Own {i} <b>Note</b> so.</p><ul><li>Print</li><li>Send</li></ul><ul><li>Salt</li><li>{i}</li></ul><table><tr><td>Call us</td></tr></table><span>Follow us</span></article><div>Made by A</div>") for i in range(8)]
    rows += [(8, "http://a.net/8", "<div>Made by A</div><p>Story of <b>Note</b>.</p><ul><li>Home</li></ul>"), (9, "http://b.net/9", "<div>Made by A</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert found == {i: f"Own {i} Note so.\n\nSalt\n\n{i}" for i in range(8)} | {8: "Story of Note.", 9: "Made by A"}


def test_a_larger_host_does_not_lift_the_bar(spark):
    page = "<div><div>{}</div><p>Story number {}.</p></div>"
    rows = [(i, "http://a.net/", page.format("Avis du site" if i < 5 else f"Part {i}", i)) for i in range(100)]
    rows += [(100 + i, "http://a.net/", page.format("Once", "one")) for i in range(9)]  # one page, repeated
    found = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "Story number 3." and found[7] == "Part 7\n\nStory number 7."
    assert all(found[100 + i] == "Once\n\nStory number one." for i in range(9))


# mixing


def test_targets():
    t = mixing.targets([("b", 10), ("a", 100), (None, 1000)], (3, 1, 2), 1.5, 2.0)
    assert t["a"] == 200 and t["b"] == 20 and t[None] == pytest.approx(1665 - 220)
    assert sum(mixing.targets([("a", 5), ("b", 5)], (3, 1), 9.0, 2.0).values()) == 20
    assert mixing.targets([], (3, 1, 2), 1.5, 2.0) == {}


def test_fill_meets_any_budget_that_lengths_allow():
    draw = random.Random(4)
    for _ in range(60):
        n = draw.randint(1, 7)
        lengths = np.array(sorted(draw.sample(range(1, 60), n)))
        counts = np.array([draw.randint(1, 4) for _ in range(n)])
        budget = draw.randint(0, int((lengths * counts).sum()) + 5)
        take = mixing.fill(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and (lengths * take).sum() <= budget
        base = counts * budget // max(1, (lengths * counts).sum())
        if budget < (lengths * counts).sum():
            reach = {0}
            for x, c in zip(lengths.tolist(), (counts - base).tolist()):
                reach = {r + x * k for r in reach for k in range(c + 1)}
            left = budget - int((lengths * base).sum())
            assert (lengths * take).sum() - (lengths * base).sum() == max(r for r in reach if r <= left)
    take = mixing.fill(np.array([7, 50_000_000]), np.array([100, 9]), 125_000_011)
    assert 125_000_011 - (np.array([7, 50_000_000]) * take).sum() < 50_000_000


def test_mix(spark):
    rows = [(i, "w " * (i % 13 + 1), f"s{i % 4}" if i % 9 else None) for i in range(400)] + [(1, "w w", "s1"), (1, "w w", "s1"), (900, None, "s0"), (901, " \n", None), (None, "a b c", "s2")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, part int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    total = {}
    for r in got:
        t = total.setdefault((r["source_size"], r["target"]), [0, 0])
        t[0] += r["size"]
        t[1] += r["taken"]
    for (size, target), (found, taken) in total.items():
        assert size == found and abs(taken - target) <= 1 and target <= 2 * size
    assert sum(t for _, t in total) == pytest.approx(1.5 * sum(s for s, _ in total))
    assert mixing.mix(df.where("false")).count() == 0
    assert mixing.mix(df.where("text is null")).first()["taken"] == 0


# search


def brute_top(rows, queries_of, k):
    v = [(i, key, [math.floor(256 * x) for x in e]) for i, (key, e) in enumerate(rows) if key is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, key, q in v:
        if queries_of(key):
            near = sorted((-sum(a * b for a, b in zip(q, x)), other, j) for j, other, x in v if j != i)[:k]
            out += [(key, n + 1, other, -s) for n, (s, other, _) in enumerate(near)]
    return sorted(out)


def test_search(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    draw = random.Random(6)
    rows = [(i, [draw.choice([0.0, draw.uniform(-1, 1)]) for _ in range(8)]) for i in range(150)]
    rows += [(150, rows[0][1]), (151, rows[0][1]), (50, rows[3][1]), (200, [1e12] * 8), (201, [1e12, -1e12]), (300, None), (301, [None, 1.0]), (302, [float("nan")]), (303, [float("inf")]), (350, []), (None, [1.0])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, score string")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in brute_top(rows, lambda k: k % 50 == 0, 5)]
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 131072)]
    assert topk.top_k(few.where("false"), F.col("vec_id") == 0).count() == 0


# language


def test_language_accuracy_and_edges(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = queries.op10_language_id(spark, path).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"] and r["lang"]]
    assert sum(out) / len(out) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)
    known = langid.profiles(docs)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !? 34", "x"), (4, "漢字 😀", "x"), (5, "the " * 50_000, "x"), (5, "the " * 50_000, "x")], "doc_id long, text string, lang string")
    got = langid.identify(odd, known, odd.columns).collect()
    assert [(r["lang_pred"], r["score"]) for r in got[:3]] == [("und", 0.0)] * 3 and got[4]["lang_pred"] == "en" and got[4] == got[5]
    assert langid.profiles(odd.where("text is null")) == {} and {r["lang_pred"] for r in langid.identify(odd, {}, ["doc_id"]).collect()} == {"und"}


def test_grams_against_plain_counting():
    for t in ("Ab, ab é!", "x", "a1b", "", "..", "😀a漢"):
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        want = sum(len(w) for w in words) + sum(len(w) + 1 for w in words) + sum(len(w) for w in words)
        assert len(langid.grams(t)) == want


def test_scores_beyond_64_bits_rank_by_their_whole_value(spark):
    rows = [(0, [3e37, 0.0]), (1, [1.0, 5.0]), (2, [1e17, 5.0]), (3, [2e37, 1.0]), (4, [-1e30, 0.0]), (5, [-2e37, 0.0]), (6, [2e37, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, F.col("vec_id") == 0, k=6).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [3, 6, 2, 1, 4, 5]  # 3 and 6 tie, the smaller id first
    assert [r["score"] for r in got[:3]] == [2**63 - 1] * 3 and [r["score"] for r in got[-2:]] == [-(2**63)] * 2
    wide = spark.createDataFrame([(0, [1e308]), (1, [1e308]), (2, [1.0]), (3, [-1e308])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(wide, F.col("vec_id") == 0, k=6).orderBy("rank").collect()] == [1, 2, 3]


def test_sortable_bytes_follow_the_numbers():
    numbers = sorted({0, 1, -1, 127, 128, 255, 256, -127, -128, -255, -256, -257, 2**63, -(2**63), 2**300, -(2**300), 2**300 - 1, 10**40, -(10**40)})
    assert sorted(numbers, key=topk.sortable) == numbers


def test_ten_thousand_languages(spark):
    """Postings by gram: the broadcast grows with the profiles, not with grams times languages."""
    draw = np.random.default_rng(7)
    known = {f"l{i:05}": np.unique(draw.integers(ord("a"), ord("z") + 1, 90)).tolist()[::-1] + (draw.integers(2, 1 << 40, 60) << 21 | 98).tolist() for i in range(10_000)}
    union, starts, spoken, rank = langid.postings([known[n] for n in sorted(known)])
    assert sum(x.nbytes for x in (union, starts, spoken, rank)) < 40 << 20 and starts[-1] == sum(map(len, known.values()))
    texts = ["a quick brown fox", "zebra", "eee ttt", "lazy dogs sleep", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, known, ["doc_id"]).collect()}
    for i, t in enumerate(texts[:4]):
        own = langid.ranked(t, langid.PROFILE).tolist()
        far = {n: sum(abs(p.index(g) - k) if g in p else langid.PROFILE for k, g in enumerate(own)) for n, p in known.items()}
        best = min(sorted(far), key=far.__getitem__)
        assert got[i] == (best, 1 - far[best] / (len(own) * langid.PROFILE))
    assert got[4] == got[5] == ("und", 0.0)
