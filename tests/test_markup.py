"""Blocks of pages: nesting, unclosed tags, growth in a page's length."""
import time

from helpers import rows

from tillstar.functions import markup
from tillstar.operators import extract, listings


def pages(spark, *html):
    return spark.createDataFrame([(i, "https://s.example.com/a/", h) for i, h in enumerate(html)],
                                 "page_id long, url string, html string")


def links(spark, html):
    return [r[0] for r in rows(extract.page_links(pages(spark, html)), "page_url")]


def test_blocks_close_at_their_own_tag():
    page = "<div class='a'>1<DIV>2</div>3</Div>4</div><ul><div>5<p></ul>6"
    got = [(b.name, b.classes, page[b.start:b.end]) for b in markup.fold(page, ("div", "ul")).blocks]
    assert got == [("div", "a", "1<DIV>2</div>3"), ("div", "", "2"), ("ul", "", "<div>5<p>"), ("div", "", "5<p></ul>6")]
    assert markup.fold("", ("div",)) == ([], [])
    assert markup.fold("a < b <div", ("div",)).blocks == []
    assert [t for _, t in markup.fold("x<b>y</b>z <", ("div",)).texts] == ["x", "y", "z <"]


def test_two_hundred_deep():
    page = "<div>" * 200 + "<div class=pagination><a href='?p=2'>2</a></div>Next" + "</div>" * 200
    folded = markup.fold(page, ("div", "ul", "nav"))
    assert len(folded.blocks) == 201
    assert sorted(b.end - b.start for b in folded.blocks)[0] == len("<a href='?p=2'>2</a>")
    b = markup.innermost(folded, __import__("re").compile("Next"))
    assert page[b.start:b.end].endswith("Next")
    assert all(page[x.end:x.end + 6] == "</div>" for x in folded.blocks)


def test_pages_four_times_as_long_cost_as_much_more():
    def cost(n):
        page = "<div class='col-1'><ul><li>Ref: P-1 5 DZD</ul></div>" * n + "<div" * n
        best = 9e9
        for _ in range(5):
            t = time.perf_counter()
            got = list(markup.marked(markup.fold(page, ("div", "ul", "nav")), listings.CONTAINERS, listings.NEEDED))
            best = min(best, time.perf_counter() - t)
            assert len(got) == n
        return best
    assert cost(20_000) <= 8 * cost(5_000)


def test_pagination_marks(spark):
    a = "<a href='?p=2'>2</a>"
    assert links(spark, f"<div class='my-pagination'>{a}</div>") == ["https://s.example.com/a/?p=2"]
    # a list only by the class itself
    assert links(spark, f"<ul class='my-pagination'>{a}</ul>") == []
    assert links(spark, f"<ul class='x pagination'>{a}</ul>") == ["https://s.example.com/a/?p=2"]
    assert links(spark, f"<ul class='pagination'><a href='?p=3'>3</a></ul><div class='pagination'>{a}</div>") == \
        ["https://s.example.com/a/?p=2"]
    # by its label: the innermost block around it, whole texts only
    assert links(spark, f"<nav><div><a href='?p=9'>9</a></div>{a}<b>Next</b></nav>") == \
        ["https://s.example.com/a/?p=2", "https://s.example.com/a/?p=9"]
    assert links(spark, f"<nav><div>{a}Previous</div><a href='?p=9'>9</a></nav>") == ["https://s.example.com/a/?p=2"]
    assert links(spark, f"{a}Next") == links(spark, "") == links(spark, None) == []
    assert links(spark, f"<!-- <div class='pagination'> --><p>{a}</p>") == []


def test_containers_hold_their_own_content(spark):
    inner = "<a href='/1'>One</a><p>Ref: P-1</p><p>5 DZD</p>"
    got = rows(listings.containers(pages(
        spark, f"<div><div class='x col-2'>{inner}</div><div class='col-3'>a<div>b</div></div></div>",
        f"<div class='card'>{inner}</div><div class='cards'>z</div>", f"<div class='my-product'>{inner}",
        f"<section><div>x<div>{inner}</div></div><div>Ref: only</div></section>", None, "")), "page_id", "place", "block")
    assert got == [(0, 0, inner), (0, 1, "a<div>b</div>"), (1, 0, inner), (2, 0, inner),
                   (3, 0, f"x<div>{inner}</div>"), (3, 1, inner)]


def test_navigation_links(spark):
    got = rows(extract.navigation_links(pages(
        spark, "<NAV><ul><a href='/a'>x</a><a href=\"/a\">y</a><a href='b'>z</a></ul></NAV><a href='/c'>no</a>", "<nav></nav>")))
    assert got == [(0, 3, 2)]
