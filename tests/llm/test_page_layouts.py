"""Pages of varied layouts, labelled by hand: what their article says, block by block."""

import pytest

from seatpool.llm import html_text

A = "The council met on Monday and agreed to rebuild the old bridge before the winter comes."
B = "Work begins in June, said the mayor, and traffic will be led over the northern road until then."
C = "Residents had asked for a cycle lane, which the new plans contain on both sides of the river."
N = "We use cookies to make this site work for you and to count its visitors; see our policy for more."
P3 = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sports</a></li></ul>'

PAGES = {
    "article": (f"<nav>{MENU}</nav><article><h1>Bridge</h1>{P3}</article><footer>© 2020 Paper</footer>", ["Bridge", A, B, C]),
    "overflow hidden": (f'<body><div class="overflow-hidden">{P3}</div></body>', [A, B, C]),
    "body classes": (f'<body class="has-sidebar overflow-hidden"><div>{P3}</div></body>', [A, B, C]),
    "row has sidebar": (f'<div class="row has-sidebar"><div>{P3}</div><div class="sidebar"><p>{N}</p></div></div>', [A, B, C]),
    "layout with sidebar": (f'<div class="layout with-sidebar">{P3}</div>', [A, B, C]),
    "layout-with-sidebar": (f'<div class="layout-with-sidebar">{P3}</div>', [A, B, C]),
    "comments open": (f'<div class="post comments-open">{P3}</div>', [A, B, C]),
    "no sidebar": (f'<div id="no-sidebar" class="col">{P3}</div>', [A, B, C]),
    "hidden as a value": (f'<div data-x="hidden">{P3}</div>', [A, B, C]),
    "aria hidden false": (f'<div aria-hidden="false">{P3}</div>', [A, B, C]),
    "hidden": (f"<div>{P3}</div><div hidden><p>{N}</p></div>", [A, B, C]),
    "hidden until found": (f'<div hidden="until-found">{P3}</div>', [A, B, C]),
    "not shown": (f'<div>{P3}</div><div style="color:red; display : none"><p>{N}</p></div>', [A, B, C]),
    "aria hidden": (f'<div>{P3}</div><div aria-hidden="true"><p>{N}</p></div>', [A, B, C]),
    "button": (f"<article><p>{A}<button>Share this</button></p><p>{B}</p></article>", [A, B]),
    "label": (f"<article><p>{A}</p><label>Mail</label><p>{B}</p></article>", [A, B]),
    "open button": (f"<article><p>{A}</p><button>Share<p>{B}</p></article>", [A, B]),
    "asides between": (
        "<div><p>It rained.</p><aside>Read more</aside><p>We stayed.</p><aside>Read more</aside><p>They left.</p>"
        "<aside>Read more</aside><p>It was late.</p></div>",
        ["It rained.", "We stayed.", "They left.", "It was late."],
    ),
    "wrapper named sidebar": (f'<div class="sidebar-wrapper"><div>{P3}</div><div class="sidebar"><p>{N}</p></div></div>', [A, B, C]),
    "sidebar wrapper": (f'<div>{P3}</div><div class="sidebar-wrapper"><p>{N}</p></div>', [A, B, C]),
    "long notice, short article": (f'<div class="cookie-notice"><p>{N}</p><p>{N}</p></div><article><p>{A}</p></article>', [A]),
    "notice longer than the article": (f'<div class="ad">{N}</div><article><h1>It rained.</h1><p>We stayed.</p></article>', ["It rained.", "We stayed."]),
    "page in a form": (f'<form id="aspnetForm"><div><h1>Bridge</h1>{P3}</div></form>', ["Bridge", A, B, C]),
    "form beside": (f"<div>{P3}</div><form><p>{N}</p><input><button>Go</button></form>", [A, B, C]),
    "comments longer than the post": (
        f'<div class="post">{P3}</div><div id="comments"><p>{A} I doubt it.</p><p>{B} Good.</p><p>{C} At last.</p><p>{A} {B} {C}</p></div>', [A, B, C],
    ),
    "comments as articles": (
        f'<article>{P3}</article><section id="comments"><article class="comment"><p>{A} I doubt it.</p></article></section>', [A, B, C],
    ),
    "comment article alone": (f'<main>{P3}</main><article class="comment"><p>{A} I doubt it.</p></article>', [A, B, C]),
    "camel case": (f'<div class="mainColumn">{P3}</div><div class="siteSidebar"><p>{N}</p></div>', [A, B, C]),
    "underscores": (f'<div>{P3}</div><div class="site_sidebar"><p>{N}</p></div>', [A, B, C]),
    "role": (f'<div role="main">{P3}</div><div role="complementary"><p>{N}</p></div>', [A, B, C]),
    "table layout": (f"<table><tr><td>{MENU}</td><td>{P3}</td></tr></table>", [A, B, C]),
    "advert inside": (f'<article><p>{A}</p><div class="ad"><p>{N}</p></div><p>{B}</p></article>', [A, B]),
    "unquoted": (f"<div class=has-sidebar>{P3}</div><div class=sidebar><p>{N}</p></div>", [A, B, C]),
    "header of an article": (f"<header><p>{N}</p></header><article><header><h1>Bridge</h1></header>{P3}</article>", ["Bridge", A, B, C]),
    "related teasers": (f'<article>{P3}</article><article class="teaser"><p>{N}</p></article>', [A, B, C]),
    "no text": (f"<nav>{MENU}</nav>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_layout(name):
    page, expected = PAGES[name]
    assert html_text.main_text(page).split("\n\n") == (expected or [""])


def test_layouts_do_not_change_with_what_is_around():
    for name, (page, expected) in PAGES.items():
        around = f'<!doctype html><html><head><title>T</title></head><body class="page">{page}<footer><p>{N}</p></footer></body></html>'
        assert html_text.main_text(around).split("\n\n") == (expected or [""]), name


def test_deep_pages_are_read_whole():
    deep = "<div>" * 50_000 + f"<p>{A}</p>" + "</div>" * 50_000 + f"<p>{B}</p>"
    assert html_text.main_text(deep) == f"{A}\n\n{B}"
