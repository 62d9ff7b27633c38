"""The main text of pages of many kinds."""

from __future__ import annotations

import random
import time

import pytest

from tradewind.llm.main_text import blocks_of, classify, inherited, main_text

TEXTS = {
    "ru": "Это длинный абзац статьи о том, как город готовится к зиме и что для этого сделано. Дороги "
    "чистят каждый день, а люди ждут снега и праздника. ",
    "it": "Questa mattina il sindaco della città ha presentato il nuovo progetto per le scuole. Gli "
    "studenti potranno seguire lezioni anche nel pomeriggio, mentre gli insegnanti avranno più tempo. ",
    "zh": "今天上午市长介绍了新的学校计划。学生们下午也可以上课，老师们会有更多时间准备。城市的道路每天都在清理，"
    "人们等待着节日的到来。",
    "en": "This is the first paragraph of the article, and it tells what all of us have to know of it. ",
}
NOTICE = "We use cookies to make the site work for you and to see how it is used by all of us."
PAGES = {
    "plain": "<body><div>{}</div></body>",
    "article": "<body><nav><a>one</a></nav><article>{}</article></body>",
    "menus": "<body><ul><li><a href=x>Home page</a></li><li><a>News of the day</a></li></ul>"
    "<div>{}</div><div><a href=y>imprint and other links</a></div></body>",
}


@pytest.mark.parametrize("page", PAGES)
@pytest.mark.parametrize("lang", TEXTS)
@pytest.mark.parametrize("times", [1, 2, 5])
def test_articles_of_any_language_beside_an_english_notice(lang, page, times):
    text = (TEXTS[lang] * times).strip()
    html = PAGES[page].format(f"<p>{text}</p><p>{NOTICE}</p><p>{text}</p>")
    found = main_text(html).split("\n")
    assert found.count(text) == 2
    assert "Home page" not in found and "one" not in found


def test_a_notice_named_as_one_goes_beside_a_foreign_article():
    text = TEXTS["ru"] * 2
    html = f'<div><p>{text}</p><div class="cookie-notice"><p>{TEXTS["ru"]}</p></div><p>{text}</p></div>'
    assert main_text(html) == f"{text.strip()}\n{text.strip()}"


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p>The cat sat <svg><text>ICON</text></svg>on the mat.</p>", "The cat sat on the mat."),
        ("<p>The cat <svg class=i/>sat.</p>", "The cat sat."),
        ("<p>The cat <object data=x><p>no</p> no</object> sat.</p><p>Next.</p>", "The cat sat.\nNext."),
        ("<div><p>A <object><div>no</div></object> of it</div>", "A of it"),
        ("<p>A <video src=x>no <a href=y>video</a></video>b</p>", "A b"),
        ("<p hidden>no</p><p>Yes.</p>", "Yes."),
        ("<p hidden>no<p>Yes.", "Yes."),
        ("<ul><li hidden>no<li>yes</ul>", "yes"),
        ("<ul><li hidden>no<ul><li>no</li></ul>no</li><li>yes</ul>", "yes"),
        ("<p>A <span hidden>no<span>no</span>no</span>b</p>", "A b"),
        ('<p>A <b style="color: red; display: none">no</b>b</p>', "A b"),
        ('<p>A <b class="not hidden here">b</b></p>', "A b"),
        ("<p>A <span hidden>no</p><p>b</p>", "A\nb"),
        ("<p>A <input hidden>b</p>", "A b"),
        ("<h2 hidden>no</h2><p>yes</p>", "yes"),
        ("<p>A <svg><path></p><p>b</p>", "A\nb"),
        ("<div><p>A <span hidden>no</div><p>b</p>", "A\nb"),
    ],
)
def test_what_is_not_shown_is_not_read(html, expected):
    assert main_text(f"<article>{html}</article>") == expected


@pytest.mark.parametrize("figures", ["12.5 | 13.7 | 1,204 | 88 % | 7,001", "x = [f(i) for i in range(10)]; y = sorted(x)" * 2])
def test_figures_and_code_between_paragraphs_stay(figures):
    text = TEXTS["en"] * 3
    html = f"<div><p>{text}</p><p>{figures}</p><p>{text}</p></div>"
    assert main_text(html).split("\n")[1] == figures


def test_nesting_costs_no_more_than_its_tags():
    def seconds(n):
        html = "".join(f'<div class="widget"><p>paragraph {i} of the text</p>' for i in range(n))
        began = time.perf_counter()
        assert len(blocks_of(html)) == n
        main_text(html)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(40_000) < 40 * max(0.02, seconds(2_000))
    began = time.perf_counter()
    main_text("<div>" * 30_000 + "</section>" * 30_000 + "<article>" * 30_000 + "<p>x</p>" + "<body>" * 30_000)
    assert time.perf_counter() - began < 20


def plain_inherited(labels, headings):
    """Both neighbours looked for from each block anew."""
    out = []
    for k, label in enumerate(labels):
        if label in ("good", "long", "bad"):
            out.append(label != "bad")
            continue
        left = next((x != "bad" for x in labels[:k][::-1] if x in ("good", "long", "bad")), None)
        right = next((x != "bad" for x in labels[k + 1 :] if x in ("good", "long", "bad")), None)
        known = [x for x in (left, right) if x is not None]
        if not known:
            out.append(True)
        elif all(known) or not any(known):
            out.append(known[0])
        else:
            out.append(label == "near" or (headings[k] and right is True))
    return out


def test_second_pass_against_a_plain_one():
    rng = random.Random(9)
    for _ in range(3000):
        labels = rng.choices(["good", "long", "near", "short", "plain", "bad"], k=rng.randint(0, 12))
        headings = [rng.random() < 0.2 for _ in labels]
        assert inherited(labels, headings) == plain_inherited(labels, headings)


def test_any_markup_is_read():
    """Random tags, closed or not: no error, and each block's text is some of the page's."""
    rng = random.Random(6)
    tags = "div article p h2 li ul nav header table td span form body head svg object video b".split()
    marks = ["", "", "", " hidden", ' style="display:none"', " class=comments", ' id="footer"', "/"]
    for _ in range(3000):
        html = ""
        for _ in range(rng.randint(0, 40)):
            what = rng.random()
            tag = rng.choice(tags)
            html += f"<{tag}{rng.choice(marks)}>" if what < 0.45 else f"</{tag}>" if what < 0.75 else rng.choice(list(TEXTS.values()))
        blocks = blocks_of(html)
        classify(blocks)
        assert all(b.good is not None and b.text for b in blocks)
