import random
import time
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from coralint.llm import wrapper
from coralint.llm.wrapper import align, extract, parse

NAV = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"


def page(k, body=None, extra=""):
    body = body or f"<h1>Title {k}</h1><p>First of {k}<br>text &amp; more<p>Second <b>bold{k}</b>ly said</p>"
    return (
        f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style></head><body>{NAV}<div class='cookie-notice'>We use cookies</div>"
        f"<article>{body}</article>{extra}<aside>Side {k}</aside><form><p>Mail {k}</form><div id=comments><p>Nice {k}</p></div>"
        f"<footer>&copy; {k}</footer><script>var x='</p><p>no';</script></body></html>"
    )


def text_of(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, node string")
    out = extract(df)
    assert out.columns == ["page_id", "url", "text"]
    return {r.page_id: r.text for r in out.collect()}


def test_article_without_the_rest(spark):
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(3)]
    assert text_of(spark, rows) == {k: f"Title {k}\n\nFirst of {k} text & more\n\nSecond bold{k}ly said" for k in range(3)}


def test_constant_slots_are_template_but_copies_are_no_evidence(spark):
    plain = "<html><head><title>T{k}</title></head><body><div class=top>Welcome to the site</div><div class=text><p>Story {k} here</p><p>All rights reserved</p></div></body></html>"
    rows = [(k, "http://a.example/x", plain.replace("{k}", str(k))) for k in range(8)]
    rows += [(100 + k, "http://b.example/x", plain.replace("{k}", "same")) for k in range(8)]
    got = text_of(spark, rows)
    assert all(got[k] == f"Story {k} here" for k in range(8))
    assert all(got[100 + k] == "Welcome to the site\n\nStory same here\n\nAll rights reserved" for k in range(8))


def test_templates_of_a_host_with_and_without_article(spark):
    new = "<html><head><title>T{k}</title></head><body><article><p>Story {k} here</p></article></body></html>"
    old = "<html><head><title>T{k}</title></head><body><div class=post><p>Old story {k} here</p></div></body></html>"
    rows = [(k, "http://h.example/x", (new if k < 7 else old).replace("{k}", str(k))) for k in range(10)]
    assert text_of(spark, rows) == {k: f"Story {k} here" if k < 7 else f"Old story {k} here" for k in range(10)}


def test_constant_text_is_counted_on_the_pages_of_its_slot(spark):
    new = "<html><head><title>T{k}</title></head><body><article><p>Story {k} here</p><div class=legal>All rights reserved</div></article></body></html>"
    old = "<html><head><title>T{k}</title></head><body><div class=post><p>Old {k} here</p></div><div class=slogan>Best of all</div></body></html>"
    rows = [(k, "http://h.example/x", (new if k < 12 else old).replace("{k}", str(k))) for k in range(20)]
    one = "<html><head><title>Site</title></head><body><div class=text><p>Story {k} here</p><div class=legal>All rights reserved</div></div></body></html>"
    rows += [(100 + k, "http://one.example/x", one.replace("{k}", str(k))) for k in range(8)]
    want = {k: f"Story {k} here" if k < 12 else f"Old {k} here" for k in range(20)}
    assert text_of(spark, rows) == want | {100 + k: f"Story {k} here" for k in range(8)}


def test_lists_of_links_inside_the_article_stay(spark):
    body = "<p>Story {k}</p><ul><li><a href=/r>Reference {k} with a long title</a><li>Plain {k}</ul><p class=links><a href=/s>Source {k}</a></p>"
    rows = [(k, "http://h.example/x", page(k, body.replace("{k}", str(k)))) for k in range(6)]
    got = text_of(spark, rows)
    assert all(got[k] == f"Story {k}\n\nReference {k} with a long title\n\nPlain {k}\n\nSource {k}" for k in range(6))


def test_a_wrapper_is_as_large_as_its_tree(spark, monkeypatch):
    rows, stored = {}, wrapper.stored

    def watched(df, name):
        rows[name] = stored(df, name)
        return rows[name]

    monkeypatch.setattr(wrapper, "stored", watched)
    names = [a + b for a in "abcdefgh" for b in "abcdefgh"]
    html = "<html><head><title>T{n}</title></head><body><div class=gen-{n}><p>Story {n} here</p></div></body></html>"
    got = text_of(spark, [(k, "http://h.example/x", html.replace("{n}", n)) for k, n in enumerate(names)])
    assert got == {k: f"Story {n} here" for k, n in enumerate(names)}
    assert rows["page-wrappers"].agg(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] < 500


STORY = "<h1>Title {k}</h1><p>Story {k} has many words to tell</p><ul><li>Point {k}</ul>"
SIDE = "<div class=sidebar><p>Seen {k} times</p></div><nav><p>Menu {k}</p></nav><div id=comments><article><p>Nice {k}</p></article></div>"


@pytest.mark.parametrize(
    "body",
    [
        f"<div class='layout has-sidebar'><article>{STORY}</article>{SIDE}</div>",
        f"<div class=widget-area><main>{STORY}</main>{SIDE}</div>",
        f"<form action=/x><article>{STORY}</article>{SIDE}</form>",
        f"<form action=/x><div class=no-sidebar><div class=text>{STORY}</div>{SIDE}</div></form>",
        f"<div class=search-results><div class=text>{STORY}</div>{SIDE}</div>",
        f"<div class=elementor-widget>{STORY}</div>{SIDE.replace('class=sidebar', 'class=banner><div class=ad').replace('</p></div>', '</p></div></div>', 1)}",
        f"<article><div class='elementor-widget wide'>{STORY}</div></article>{SIDE}",
    ],
)
def test_words_round_the_text_do_not_drop_it(spark, body):
    html = f"<html><head><title>T{{k}}</title></head><body>{body}</body></html>"
    got = text_of(spark, [(k, "http://h.example/x", html.replace("{k}", str(k))) for k in range(6)])
    assert got == {k: f"Title {k}\n\nStory {k} has many words to tell\n\nPoint {k}" for k in range(6)}


@pytest.mark.parametrize("html", [None, "", "   ", "<html><body></body></html>", "<!-- only", "<script>x", "<nav><a>menu</a></nav>"])
def test_pages_without_text(spark, html):
    assert text_of(spark, [(1, None, html)]) == {1: ""}


def test_broken_and_large_pages(spark):
    rows = [
        (1, "http://x.example/1", "plain &lt;text&gt; < 5 &nbsp; end"),
        (2, "http://y.example/2", "<p>a<p>b<td>c</div></p><li>d"),
        (3, "http://z.example/3", "<div>" * 3000 + "deep" + "</div>" * 3000),
        (4, "http://w.example/4", "<article>" + "<p>word word</p>" * 20_000),
        (4, "http://w.example/4", "<article>" + "<p>word word</p>" * 20_000),
    ]
    got = text_of(spark, rows)
    assert got[1] == "plain <text> < 5 end"
    assert got[2] == "a\n\nb\n\nc\n\nd"
    assert got[3] == "deep"
    assert got[4].count("word word") == 20_000


def test_tree_matching_prefers_equal_classes():
    reference = parse("<body><div class=a><p>x</p></div><div class=b><p>y</p></div></body>").nodes
    tree = parse("<body><div class=new>n</div><div class=b><p>y</p></div></body>").nodes
    matched = align(tree, reference)
    assert matched[[k for _, k in tree].index("div.b")] == [k for _, k in reference].index("div.b")
    assert align(reference, reference) == list(range(len(reference)))


def test_empty_table(spark):
    assert text_of(spark, []) == {}


def _random_tree(rng, n, kinds):
    nodes, seen = [], set()
    for _ in range(n):
        node = (rng.randrange(-1, len(nodes)) if nodes else -1, rng.choice(kinds))
        if node not in seen:
            seen.add(node)
            nodes.append(node)
    return nodes


def _heaviest(a, b):
    """Simple tree matching by its recursive definition."""
    kids = lambda t, x: [i for i, (p, _) in enumerate(t) if p == x]

    @lru_cache(None)
    def weight(x, y):
        mine, theirs = kids(a, x), kids(b, y)

        @lru_cache(None)
        def best(i, j):
            if i == len(mine) or j == len(theirs):
                return 0.0
            out = max(best(i + 1, j), best(i, j + 1))
            p, q = a[mine[i]][1], b[theirs[j]][1]
            if p.partition(".")[0] == q.partition(".")[0]:
                out = max(out, (2.0 if p == q else 0.5) + weight(mine[i], theirs[j]) + best(i + 1, j + 1))
            return out

        return best(0, 0)

    return weight(-1, -1)


@pytest.mark.parametrize("seed", range(40))
def test_alignment_is_a_heaviest_matching(seed):
    rng = random.Random(seed)
    kinds = ["div", "div.a", "div.b", "p", "p.x", "ul", "li"]
    a, b = _random_tree(rng, rng.randrange(1, 25), kinds), _random_tree(rng, rng.randrange(1, 25), kinds)
    out = align(a, b)
    got = sum(2.0 if a[i][1] == b[j][1] else 0.5 for i, j in enumerate(out) if j >= 0)
    assert got == _heaviest(a, b)
    for i, j in enumerate(out):  # parents of matched nodes are matched, tags agree, order is kept
        if j >= 0:
            up, there = a[i][0], b[j][0]
            assert (out[up] if up >= 0 else -1) == there
            assert a[i][1].partition(".")[0] == b[j][1].partition(".")[0]
            assert all(out[h] < j for h in range(i) if a[h][0] == up and out[h] >= 0)


def test_long_child_lists_keep_equal_kinds_and_order():
    a = [(-1, "body"), *((0, f"p.k{i}") for i in range(900))]
    b = [(-1, "body"), *((0, f"p.k{i}") for i in range(0, 1800, 2)), *((0, f"p.z{i}") for i in range(50))]
    out = align(a, b)
    assert all(b[out[i]][1] == a[i][1] for i in range(1, 901) if (i - 1) % 2 == 0)
    matched = [j for j in out if j >= 0]
    assert matched == sorted(set(matched))


@pytest.mark.parametrize("html", [
    "<a " * 300_000, "<a '" * 200_000, "<a \"'" * 200_000 + ">", "<a x " * 100_000 + "\" >", "</a " * 200_000, "<a" * 300_000 + " ' >",
    "<div>" * 5_000 + "deep", "</i>" * 200_000, "<b>" * 5_000 + "</i>" * 100_000, "<!--" * 200_000, "a < b " * 200_000,
])
def test_hostile_pages_take_linear_time(html):
    start = time.time()
    page = parse(html)
    sizes = sum(map(len, wrapper._paths(page.nodes)))
    assert time.time() - start < 5 and sizes < 1 << 20


def test_many_unlike_siblings_take_little_time():
    tree, other = ([(-1, "body"), *((0, f"p.{c}{i}") for i in range(2_000))] for c in "ab")
    start = time.time()
    out = align(tree, other)
    assert time.time() - start < 5 and sum(j >= 0 for j in out) == 2_001


def test_unclosed_tags_are_text_and_quotes_hide_ends():
    assert [b[1] for b in parse('<p title="a>b">one</p><p>two <b').blocks] == ["one", "two <b"]
    assert [b[1] for b in parse("<p>1 <2 and <x 'y").blocks] == ["1 <2 and <x 'y"]
