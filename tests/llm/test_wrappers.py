from __future__ import annotations

import html
import random
import re

import duckdb

from tidemark.llm import wrappers
from tidemark.llm.queries import op7


def test_query_on_given_pages(spark, sf):
    got = {r["page_id"]: r for r in op7(spark, sf).collect()}
    for i, source in duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*)</article>", source, re.DOTALL).group(1)
        text = re.sub(r"</?b>", "", re.sub(r"</?(p|br|h1)>", " ", article))
        want = " ".join(html.unescape(text).split())
        assert (got[i]["text"], got[i]["n_chars"]) == (want, len(want))


def page(k: int, body: str) -> str:
    return (
        f"<html><head><title>t{k}</title></head><body><div class=top>Welcome to the site</div>{body}<div class='side-bar sidebar'>s{k}</div>"
        f"<form>f{k}<input></form><ul class=menu><li>a{k}<li>b</ul><div id=comments><p>c{k}</div><div>Copyright site</div>"
        f"<script>if(a<b) x='</div>'</script><!-- <p>no --></body>"
    )


def test_constant_nodes_are_template(spark):
    rows = [(k, f"http://Host/{k}", page(k, f"<div class=x>Text {k} is<br>here, <i>mo</i>re &lt;b&gt; &amp c</div><p>Second {k}")) for k in range(8)]
    rows += [(20, "http://other/1", "plain <p>one<p>two</p> three"), (21, None, None), (22, "odd", ""), (20, "http://other/1", "plain <p>one<p>two</p> three")]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert all(texts[k] == f"Text {k} is here, more <b> & c Second {k}" for k in range(8))
    assert texts[20] == "plain one two three" and texts[21] == texts[22] == ""


def test_copies_of_an_article_keep_their_text(spark):
    body = "<article><header>h</header><h1>Head</h1><p>All the same<aside>no</aside><div class='ad'>no</div></p><p>Text</article>"
    rows = [(k, "https://h.example/x", page(k, body)) for k in range(5)]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Head All the same Text"}


def test_tree_matching_keeps_order():
    a = (["r", "a", "b", "c", "b"], [[1, 2, 3, 4], [], [], [], []])
    b = (["r", "b", "a", "b"], [[1, 2, 3], [], [], []])
    found = wrappers.simple_tree_matching(a, b)
    assert found[0] == 0 and len(found) == 3
    pairs = sorted((x, y) for x, y in found.items() if x)
    assert pairs == sorted(pairs, key=lambda p: p[1]) and all(a[0][x] == b[0][y] for x, y in pairs)


def test_long_lists_are_matched_like_short_ones(monkeypatch):
    def flat(labels):
        return ["r", *labels], [list(range(1, len(labels) + 1)), *[[] for _ in labels]]

    rng = random.Random(1)
    for _ in range(60):
        sides = []
        for _ in range(2):
            labels, children = flat(rng.choices("abc", k=rng.randrange(1, 30)))
            for i in range(1, len(labels)):
                for _ in range(rng.randrange(3)):
                    children[i].append(len(labels))
                    labels.append(rng.choice("xy"))
                    children.append([])
            sides.append((labels, children))
        want = len(wrappers.simple_tree_matching(*sides))
        with monkeypatch.context() as small:
            small.setattr(wrappers, "CELLS", 0)
            small.setattr(wrappers, "HALVED", 4, raising=False)
            found = wrappers.simple_tree_matching(*sides)
        assert len(found) == want
        tops = sorted((x, y) for x, y in found.items() if x in sides[0][1][0])
        assert tops == sorted(tops, key=lambda p: p[1]) and all(sides[0][0][x] == sides[1][0][y] for x, y in found.items())
    page, pattern = ["late", *["h2", "p"] * 700], [*["h2", "p"] * 700, "late"]
    found = wrappers.simple_tree_matching(flat(page), flat(pattern))
    assert len(found) == 1401


def test_broken_markup():
    for source in ("<", "<<p>a", "<p", "</p>", "<!--", "<script>", "a<b", "<p><div></p></div>" * 50, "<div>" * 3000 + "x", "<p class=\"a", "&#0;&#x110000;&bogus;"):
        wrappers.Page(source)
    assert [b[1] for b in wrappers.Page("<ul><li>a<li>b</ul><table><tr><td>c<td>d").blocks] == ["a", "b", "c", "d"]
    assert [b[1] for b in wrappers.Page("x < y <textarea>no</textarea>z").blocks] == ["x < y z"]


def test_empty_table(spark):
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string, text int, host int")).collect() == []
