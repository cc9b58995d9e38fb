"""Tags in the middle of an article that must not swallow what stands behind them, and the tree that keeps blocks."""

import re

import pyarrow.parquet as pq
import pytest

from pairsignals.llm import html_text

LONG = "Many people came to see the old mill turn again after it had stood still for more than forty years."


def text(middle):
    return html_text.main_text(f"<body><article><p>{LONG}</p>{middle}<p>{LONG} {LONG}</p></article></body>".encode())


@pytest.mark.parametrize("middle", [
    '<svg class="i"/>', "<svg/>", "<SVG class='i' />", '<math display="block"/>', '<svg aria-label="a > b"/>',
    "<video-js id=a></video-js>", "<button-group></button-group>", "<select-all>", "<audio:x>",
    '<svg class="i"><path d="M0 0"/><text>label</text></svg>', '<svg data-x="a/>b"><text>label</text></svg>',
    "<video id=a>no video</video>", "<button\n>Press</button>", "<script src=a/>x()</script>",
    '<iframe src="/a/"/>none</iframe>', "<svg/><svg>label</svg>",
])
def test_text_behind_the_tag_is_kept(middle):
    assert text(middle) == f"{LONG}\n{LONG} {LONG}"


@pytest.mark.parametrize("middle", ["<button-group>Press</button-group>", "<svg/>Press", "<video-js id=a>Press</video-js>"])
def test_text_in_custom_elements_is_text(middle):
    found = html_text.blocks(f"<p>{LONG}</p><p>{middle} here</p><p>{LONG}</p>")
    assert [b[0] for b in found] == [LONG, "Press here", LONG]


@pytest.mark.parametrize("page", ["<script", "<svg", "<svg/", "<svg a='", '<script a="x>y', "<math a='/>"])
def test_cut_tags_reach_to_the_end(page):
    assert html_text.blocks(f"<p>{LONG}</p>{page}")[0][0] == LONG


def in_splits(tree) -> set[str]:
    return {html_text.FEATURES[n[0]] for n in tree.nodes if n[0] >= 0}


def test_link_density_and_neighbours_decide():
    for tree in (html_text.tree(), html_text.tree(("hinted",))):
        assert {"links", "words", "links before", "links behind"} <= in_splits(tree)
    assert "words behind" in in_splits(html_text.tree())
    assert "hinted" not in in_splits(html_text.tree(("hinted",)))


def test_labelled_blocks_are_learnt():
    wrong = 0
    for page in html_text.LABELLED:
        found = html_text.blocks(page)
        want = [m == "1" for m in re.findall(r"data-main=(\d)", page)]
        wrong += sum(html_text.tree().predict(html_text.features(found)) != want)
    assert wrong == 0


@pytest.mark.parametrize("without", [(), ("hinted",)])
def test_held_out_pages_by_their_blocks_alone(without):
    """Pages of the given table whose article element is a plain one, with and without names of classes."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    for strip in ("", r' class="[^"]*"'):
        right = 0
        for page in pages:
            plain = re.sub(r"(</?)article>", r"\1div>", re.sub(strip, "", page) if strip else page)
            right += html_text.main_text(plain.encode(), without) == html_text.main_text(page.encode())
        assert right >= 0.98 * len(pages)


@pytest.mark.parametrize("middle", ['<ul><li><a href=/1>One</a><li><a href=/2>Two words</a></ul>', "<p>See:<p><a href=/1>x</a>",
                                    "<h2>Sources</h2><p><a href=/1>The map</a><p>Yes."])
def test_links_inside_an_article_stay(middle):
    found = html_text.blocks(f"<article><p>{LONG}{middle}<p>{LONG}</article>")
    assert text(middle) == "\n".join([LONG, *(b[0] for b in found[1:-1]), f"{LONG} {LONG}"])


@pytest.mark.parametrize("middle", ["<nav><a href=/1>One</a></nav>", "<aside><p>See <a href=/1>this</a></aside>",
                                    "<form><p>Your name</form>", "<div class=related><a href=/1>One</a></div>",
                                    f"<div class=comments><p>{LONG}</p></div>"])
def test_what_is_beside_goes_also_inside_an_article(middle):
    assert text(middle) == f"{LONG}\n{LONG} {LONG}"


@pytest.mark.parametrize("page", ["<article><h1>Title</h1><ul><li><a href=/1>One</a></ul></article>",
                                  "<nav><a href=/>Home</a></nav><article><p>So</p><p><a href=/1>One</a></article><nav><a>x</a></nav>"])
def test_short_articles_of_links(page):
    assert html_text.main_text(page.encode()) in ("Title\nOne", "So\nOne")
