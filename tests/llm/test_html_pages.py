"""Page shapes of the main-text operator, and its second pass against a plain version."""

import random
import time

from protloom.llm import html

LONG = "This is the text of the article that we have written for you, and it has more than a few words in it so that it is long enough to be decided. "
RU = "Это длинный текст статьи на русском языке, в котором много слов и мало ссылок, чтобы его можно было узнать по длине. "
ZH = "这是一篇很长的文章正文内容用来说明即使没有空格也能够被识别出来的中文页面并且没有任何链接存在于其中因此应当保留全部的文字内容而不是把它们丢掉。"


def page(body):
    return f"<html><head><title>t</title></head><body><nav><a href=/>Home</a> <a href=/x>News</a></nav>{body}<footer>All rights reserved</footer></body></html>"


def test_teaser_cards_are_not_the_text():
    main = "".join(f"<p>{k} {LONG * 3}</p>" for k in range(4))
    cards = "".join(f"<article><h3><a href=/{k}>Card {k}</a></h3><p>{LONG[:60]}</p></article>" for k in range(4))
    got = html.main_text(page(f"<div class=content>{main}</div><div class=cards>{cards}</div>"))
    assert got.split("\n") == [f"{k} {LONG * 3}".strip() for k in range(4)]


def test_an_article_stays_the_region_beside_short_or_single_blocks():
    got = html.main_text(page(f"<article><h1>Title</h1><p>Short but the article, as it is.</p></article><div>{LONG * 3}</div>"))
    assert got == "Title\nShort but the article, as it is."


def test_languages_that_are_not_listed():
    for text in (RU * 2, ZH * 2):
        paragraphs = [f"{k}. {text}".strip() for k in range(3)]
        got = html.main_text(page("<div>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div><div><a href=/>ссылка</a></div>"))
        assert got.split("\n") == paragraphs


def test_sibling_widgets_hold_the_text():
    parts = [f"{k} {LONG * 2}".strip() for k in range(3)]
    for mark in ("elementor-widget", "widget", "promo box"):
        got = html.main_text(page("".join(f'<div class="{mark}"><p>{p}</p></div>' for p in parts)))
        assert got.split("\n") == parts


def test_elements_within_a_line():
    body = f"<p>{LONG}so <math><mi>a</mi><mo>=</mo><mi>b</mi><annotation>a=b</annotation></math> holds, <svg><title>x</title></svg>and press <button>Save</button> to go on.</p>"
    got = html.main_text(page(f"<article>{body}<p>{LONG}</p></article>"))
    assert got.split("\n") == [f"{LONG}so a=b holds, and press to go on.", LONG.strip()]


def test_links_within_an_article():
    links = "<p><a href=/1>First report of the year</a></p><p><a href=/2>Second report of the year</a></p>"
    got = html.main_text(page(f"<article><p>{LONG}</p>{links}<p>{LONG}</p></article>"))
    assert got.split("\n") == [LONG.strip(), "First report of the year", "Second report of the year", LONG.strip()]
    listed = "<ul>" + "".join(f"<li><a href=/{k}>Further page {k}</a></li>" for k in range(2)) + "</ul>"
    assert "Further" not in html.main_text(page(f"<article><p>{LONG}</p>{listed}<p>{LONG}</p></article>"))


def test_title_in_a_banner():
    got = html.main_text(page(f"<article><div class=banner><h1>The title</h1><p>Buy now</p></div><p>{LONG}</p></article>"))
    assert got.split("\n") == ["The title", LONG.strip()]


def test_open_elements_take_linear_time():
    for tag in ("form", "div class=sidebar", "nav", "button"):
        began = time.time()
        html.main_text(page("".join(f"<{tag}><p>{k} {LONG}</p>" for k in range(4000))))
        assert time.time() - began < 5


def plain(rows, short=70, long=140, stop=0.12):
    """Labels of blocks (text, links, inside, off, heading, item): each ambiguous one looks for its neighbours by itself."""
    words = lambda t: html._WORD.findall(t.lower())
    share = lambda t: sum(w in html.STOP_WORDS for w in words(t)) / max(1, len(words(t)))
    region = any(r[2] and not r[3] for r in rows)
    linked = [bool(r[2]) and not r[3] and r[1] >= 0.9 * len(r[0]) for r in rows]

    def first(i):
        text, links, inside, off, heading, item = rows[i]
        if off or region and not inside:
            return "bad"
        if links > 0.5 * len(text):
            lo = hi = i
            while lo > 0 and linked[lo - 1]:
                lo -= 1
            while hi + 1 < len(rows) and linked[hi + 1]:
                hi += 1
            n = hi - lo + 1 if linked[i] else 0
            return "bad" if not inside or n >= 3 or n == 2 and rows[lo][5] and rows[hi][5] else ""
        return "" if heading or len(text) < (short if inside else long) or share(text) < stop else "good"

    one = [first(i) for i in range(len(rows))]
    kept = [i for i, r in enumerate(rows) if not r[3] and (r[2] or not region)]
    out = list(one)
    for i in kept:
        if not one[i]:
            text, links, inside, off, heading, item = rows[i]
            prev = next((one[j] for j in reversed(kept) if j < i and one[j]), None)
            next_ = next((one[j] for j in kept if j > i and one[j]), None)
            if prev and next_ and prev != next_:
                out[i] = next_ if heading else "good" if inside else "bad"
            else:
                out[i] = prev or next_ or ("good" if inside else "bad")
            if inside and not links:
                out[i] = "good"
    return out


def test_passes_against_a_plain_version():
    rng = random.Random(11)
    for _ in range(400):
        rows, whole = [], rng.choice([0, 1])
        for _ in range(rng.randrange(1, 14)):
            text = rng.choice([LONG, LONG * 2, LONG[:50], LONG[:90], "Heading", "xq zq vq " * 20])
            rows.append((text, rng.choice([0, 0, 0, len(text), int(len(text) * 0.6)]), whole and rng.choice([1, 1, 1, 0]), rng.random() < 0.1, rng.random() < 0.15, rng.random() < 0.3))
        found = [html.Block(*r) for r in rows]
        beside = [len(b.text) for b in found if not b.inside and not b.off]
        if sum(beside) > sum(len(b.text) for b in found if b.inside and not b.off and not b.heading and not b.links):
            continue  # the region is given up: not what this version is about
        html.classify(found)
        prose = [b for b in found if not b.off and not b.heading and not b.links and len(b.text) >= 140]
        if prose and all("xq" in b.text for b in prose):
            continue  # no listed language
        assert [b.label for b in found] == plain(rows)
