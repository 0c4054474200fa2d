"""Pages are read and judged whole."""

import time

import numpy as np
import pytest

from lightfold.llm import html


def texts(page):
    return [t for _, t, _ in html.blocks(page)]


@pytest.mark.parametrize("tag", ["<svg class='i' viewBox='0 0 1 1' />", "<math/>", '<svg a="b"/>'])
def test_closed_foreign_tags_skip_nothing(tag):
    assert texts(f"<p>one</p>{tag}<p>two</p><svg><text>drawn</text></svg><p>three</p>") == ["one", "two", "drawn", "three"]
    assert texts(f"{tag}<p>to the end</p>") == ["to the end"]


def test_all_words_of_a_block_count():
    start = "same words " * 40
    a, b = (html.features([((), start + w, 0.0)])[0, html.PATH : html.PATH + html.WORDS] for w in ("subscribe newsletter " * 30, "granite valley " * 30))
    assert not np.allclose(a, b)


def test_all_class_words_count():
    (path, _, _), = html.blocks("<div class='d-flex flex-column p-3 mb-4 comments'>text</div>")
    assert "comments" in path[0].split()


def test_tags_of_many_attributes_are_tags():
    page = "<div " + " ".join(f'data-{i}="a > b"' for i in range(2000)) + ">text</div>"
    assert texts(page) == ["text"]


@pytest.mark.parametrize("part", ['<a "', "<a '\"", "<a<a", "<a <b ", "</a<b", '<a "x" ', "<!<a '"])
def test_broken_tags_take_linear_time(part):
    began = time.time()
    html.blocks(part * 60_000 + '"')
    assert time.time() - began < 8


@pytest.mark.parametrize("part", ["<div>x", "<b> </b>", "</i>", "<b>x", "<head>", "<svg>", "<b><p></p>", "<div>x</i>", "<li><b>"])
def test_deep_pages_take_linear_time(part):
    began = time.time()
    found = html.blocks(part * 20_000)
    assert html.features(found).shape[0] == len(found)
    assert time.time() - began < 8


def test_open_tags_are_closed_as_by_a_plain_scan():
    """The places of open tags against a scan of the whole stack, on random markup."""
    names = ["div", "p", "b", "li", "ul", "td", "tr", "table", "a", "i"]

    def plain(parts):
        stack, out = [], []
        for part in parts:
            if part == "x":
                out.append(tuple(t for t in stack if t in html.BLOCK or t == "a"))
                continue
            name = part.strip("</>")
            if part[1] == "/":
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i] == name:
                        del stack[i:]
                        break
                continue
            shut, stop = html.CLOSES.get(name, ((), ()))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i] in stop:
                    break
                if stack[i] in shut:
                    del stack[i:]
                    break
            stack.append(name)
        return out

    rng = np.random.default_rng(3)
    for _ in range(500):
        parts = []
        for _ in range(40):
            name = names[rng.integers(len(names))]
            parts += [f"</{name}>" if rng.random() < 0.4 else f"<{name}>", "x"]
        opened, got = html._Open(), []
        for part in parts:
            name = part.strip("</>")
            if part == "x":
                got.append(tuple(opened.paths[-1]))
            elif part[1] == "/":
                if opened.within(name):
                    opened.cut(opened.top((name,)))
            else:
                shut, stop = html.CLOSES.get(name, ((), ()))
                if opened.top(shut) > opened.top(stop):
                    opened.cut(opened.top(shut))
                opened.push(name, name)
        assert got == plain(parts)


def test_text_inside_other_elements_is_kept():
    page = "<article><p>a <noscript>n</noscript> b <math><mi>x</mi></math> <object>o</object></p></article>"
    assert texts(page) == ["a n b x o"]
    assert texts("<p>one</p><svg><p>two</p>") == ["one", "two"]
