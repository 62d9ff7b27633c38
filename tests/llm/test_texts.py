"""Token counts, pieces, main text, licenses, secrets and archives."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from tests.llm.tables import by_id, documents, messy
from tradewind.llm import pieces, token_counts, warc
from tradewind.llm.license_scan import BASE, license_scan, words_of
from tradewind.llm.main_text import extract, main_text
from tradewind.llm.secret_scan import secret_scan, segments

PARTS = [
    *"aeinst .,;'\n\t12éß中", "  ", "日本", "😀", "\x00", "the", "ing", " " * 5, "▁", "<|endoftext|>", "<s>",
    "<0x41>", "'s", "'re", "'ll", "'v", "\r\n", "\xa0", "ж", "한", "²", "...",
]


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def counter():
    from tokenizers import Tokenizer

    path = token_counts.default_path()
    library = Tokenizer.from_file(path)
    runs = token_counts.character_classes(library)
    return token_counts.Counter(path, runs, ["<|endoftext|>"]), library


@pytest.mark.parametrize("chunk", [3, 64, 2048])
def test_token_counts_are_the_library_s(counter, chunk, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", chunk)
    made, library = counter
    texts = random_texts(chunk, 1500) + ["a" * 5000, " " * 3000, "'" * 999, "\n" * 99 + "x", "the" * 2000]
    wanted = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert made.counts(texts).tolist() == wanted


def test_token_counts_messy(spark, counter):
    found = token_counts.token_counts(messy(spark, "n_tokens", "over_limit"))
    assert found.count() == 17
    rows = found.where("doc_id = 8").first()
    assert rows["n_tokens"] == len(counter[1].encode(rows["text"], add_special_tokens=False).ids)
    assert [tuple(r) for r in found.where("doc_id in (3, 4)").select("n_bytes", "n_tokens", "over_limit").collect()] == [(0, 0, False)] * 2
    assert found.where("doc_id = 6").first()["over_limit"]
    assert token_counts.token_counts(messy(spark).limit(0)).count() == 0


def test_pieces_are_the_library_s():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    model = pieces.load(pieces.default_path())
    for text in [*random_texts(9, 3000), "a" * 3000, " " * 500, "the" * 700, "ab中" * 300]:
        ids = library.encode(text)
        assert model.encode(text) == ids, text
        assert model.decode(ids) == library.decode(ids), text


def test_pieces_stream_in_a_window():
    model = pieces.load(pieces.default_path())
    word = "internationalization" * 400
    given = list(model.stream("▁" + word))
    assert len(given) > 100 and max(map(len, given)) < 40
    assert [i for some in given for i in some] == model.encode(word)


def test_pieces_messy(spark):
    found = pieces.encode(messy(spark, "ids", "n_ids"))
    assert found.count() == 17
    assert found.where("not lossless").count() == 0
    assert [tuple(r) for r in found.where("doc_id in (3, 4)").select("ids", "n_ids").collect()] == [([], 0)] * 2
    back = pieces.decode(found.withColumnRenamed("text", "own"))
    assert back.where("text != coalesce(own, '')").count() == 0
    assert pieces.encode(messy(spark).limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/x">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use the cookies of the site for all that is in it.</p></div><!-- <p>no</p> -->
<main><article><header><h1>The  title</h1></header><p>First &lt;b&gt; and caf&eacute;,
 with <a href='y>z'>a link</a> in it.<br>Next</p><div class="ad">Buy the best of all now</div><p>Short.
<ul><li>one<li>two</ul><aside><p>Related to the story of the day</p></aside><form><label>Mail</label></form>
<p>Last &amp</p></article></main><section id="comments"><article><p>I think that this is the best of all.</p>
</article></section><div class="sidebar"><p>More of the same for you to read on this day.</p></div>
<footer>&copy; all</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE).split("\n") == [
        "The title", "First <b> and café, with a link in it. Next", "Short.", "one", "two", "Last &",
    ]


def test_main_text_without_an_article():
    long = "It was in the time of the old kings that this was the way of the land, and it is not so with us. " * 3
    page = (
        f"<div id=top><a href=1>A</a> <a href=2>B</a></div><h2>A heading</h2><p>{long}</p><p>Small.</p>"
        f"<p>{long}</p><div class=footer><p>{long}</p></div><p><a href=3>{long}</a></p>"
    )
    assert main_text(page) == "\n".join(["A heading", long.strip(), "Small.", long.strip()])


TOLD = "It was in the time of the old kings that this was the way of the land, and it is not so with us. " * 3
LAYOUTS = [
    f"<div class='elementor-widget-container'><h2>A title</h2><p>{TOLD}</p><p>Small.</p><p>{TOLD}</p></div>",
    f"<div class='content with-sidebar'><h2>A title</h2><p>{TOLD}</p><p>Small.</p><p>{TOLD}</p></div>",
    f"<div class='site-content has-search'><h2>A title</h2><p>{TOLD}</p><p>Small.</p><p>{TOLD}</p></div>",
    f"<article><div class='widget'><h2>A title</h2></div><div class='widget'><p>{TOLD}</p></div>"
    f"<div class='widget'><p>Small.</p></div><div class='widget'><p>{TOLD}</p></div><div class='ad'>Buy now</div></article>",
    f"<article class='post comments-open'><h2>A title</h2><p>{TOLD}</p><p>Small.</p><p>{TOLD}</p></article>",
    f"<div id='post-with-comments'><article><h2>A title</h2><p>{TOLD}</p><p>Small.</p><p>{TOLD}</p></article></div>",
    f"<div class='post comments'><main><h2>A title</h2><p>{TOLD}</p><p>Small.</p><p>{TOLD}</p></main>"
    f"<div id='comments'><article><p>{TOLD}</p></article></div></div>",
    f"<div class='reviews'><h2>A title</h2><p>{TOLD}</p><p>Small.</p><p>{TOLD}</p></div><div class='footer'><p>All of it.</p></div>",
]


@pytest.mark.parametrize("page", LAYOUTS)
def test_main_text_in_layout_classes(page):
    assert main_text(page) == "\n".join(["A title", TOLD.strip(), "Small.", TOLD.strip()])


LINKS = "".join(f"<p><a href={i}>Another story of the day, and of the night that is to come, number {i}</a></p>" for i in range(3))
LONG = TOLD.strip()
PRIORS = [
    (f"<div class='body'><h2>A title</h2><p>{TOLD}</p><p>{TOLD}</p></div><article><a href=1>A story</a><p>Teaser.</p></article><footer>x</footer>",
     f"A title\n{LONG}\n{LONG}"),
    (f"<div><p>{TOLD}</p><p>{TOLD}</p></div><div class='related'><article><p>{TOLD[:120]}</p></article></div>",
     f"{LONG}\n{LONG}\n{TOLD[:120].strip()}"),
    (f"<article><h1><a href=0>A title</a></h1><p>{TOLD}</p>{LINKS}<p>Small.</p><p>{TOLD}</p></article><p>{TOLD}</p>",
     f"A title\n{LONG}\nSmall.\n{LONG}"),
    (f"<div class='ad'>Buy all of the best that is on the shelves of the shop by the sea, now</div><article><p>{'wort | ' * 90}</p></article>",
     ("wort | " * 90).strip()),
    (f"<article><p>Short.</p><p>Also short.</p></article><div><p>{TOLD}</p></div>", f"Short.\nAlso short.\n{LONG}"),
]


@pytest.mark.parametrize("page, wanted", PRIORS)
def test_main_text_outside_and_inside_an_article(page, wanted):
    assert main_text(page) == wanted


def test_main_text_of_the_test_pages(spark):
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in extract(pages).collect():
        own = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [re.sub("<[^>]*>", " ", x) for x in re.split("</?(?:p|h1)>", own)]
        wanted = "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)
        assert r["text"] == wanted and r["n_chars"] == len(wanted)


def test_main_text_messy(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>a < b"), (2, "u", "<p>a < b"), (3, "u", "<div>" * 50_000 + "x"),
            (4, "u", "<nav>only a menu"), (5, "u", "<a href='" + "<b " * 5000), (6, "u", "<!-- open" + "x" * 99)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, n_chars int")
    found = extract(pages)
    texts = [(r["page_id"], r["text"], r["n_chars"]) for r in found.collect()]
    assert texts[:5] == [(1, "", 0), (None, "", 0), (2, "a < b", 5), (2, "a < b", 5), (3, "x", 1)]
    assert texts[5] == (4, "", 0) and texts[7] == (6, "", 0)
    assert extract(pages.limit(0)).count() == 0


def plain_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, x) for x, p in BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in found]
    labels = ",".join(sorted({x for _, x in found}))
    return len(words), len(found), min(places, default=None), max(places, default=None), labels


def test_licenses(spark):
    rng = random.Random(11)
    pool = [p for _, p in BASE] + ["under", "the", "license", "cc", "BY-NC", "mit", "é", "Apache", "x\n"]
    texts = [" ".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(200)] + [None, ""]
    found = by_id(license_scan(documents(spark, list(enumerate(texts)))), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")
    for i, text in enumerate(texts):
        assert found[i][:5] == plain_base(text)
        assert set(found[i][4].split(",")) - {""} <= set(found[i][5].split(","))


def test_license_notices(spark):
    gpl = "x y. This work is licensed under the GNU General Public License, version 3. z"
    reworded = "This work has been licensed under GNU General Public License, version 3"
    other = "General Public works of the license of 3 versions in the GNU herd, public and general"
    rows = [(1, gpl), (2, reworded), (3, other), (4, "Licensed under CC BY-SA 4.0."), (5, None)]
    found = by_id(license_scan(documents(spark, rows)), "labels", "score")
    assert found[1] == ("gpl-3", 1.0) and found[2][0] == "gpl-3" and 0.5 <= found[2][1] < 1
    assert found[3] == ("", 0.0) and found[4][0] == "cc-by-sa" and found[5] == ("", 0.0)
    messed = license_scan(messy(spark, "labels", "score"))
    assert messed.count() == 17 and license_scan(messy(spark).limit(0)).count() == 0
    assert words_of("A-b é") == [b"a", b"b", "é".encode()]


def test_secrets(spark):
    key = "AKIA" + "Z" * 16
    text = f"é {key} PassWord = 'abc12' token: \"x_y.z-1\" api-key=1 {'0a' * 12} api_key='{'f' * 24}'"
    row = secret_scan(documents(spark, [(1, text), (2, None), (3, "")])).collect()
    at = text.index
    wanted = [(at(key), "access", at(key) + 20), (at("token"), "assign", at("x_y") + 7),
              (at("0a0a"), "hex", at("0a0a") + 24), (at("api_key"), "assign", at("fff") + 24),
              (at("fff"), "hex", at("fff") + 24)]
    joined = ",".join(f"{k}:{a}:{b}" for a, k, b in wanted)
    assert tuple(row[0][c] for c in ("n_assign", "n_access", "n_hex")) == (2, 1, 2)
    assert row[0]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert row[0]["spans"] == joined
    assert {r["base_sha256"] for r in row[1:]} == {hashlib.sha256(b"").hexdigest()}
    messed = secret_scan(messy(spark, "spans", "n_hex"))
    assert messed.count() == 17 and messed.where("spans != ''").count() == 0
    assert secret_scan(messy(spark).limit(0)).count() == 0


def test_costly_values_in_context(spark):
    rows = [
        (1, "the passphrase is tR9#kQ2v!xZ7mW and nothing else"),
        (2, "the password is Password2023 for now"),
        (3, "the password thenandtheother came to be"),
        (4, "Authorization: Bearer Zk81Qm02LxT7 was sent"),
        (5, "secret was 1111111111111111"),
    ]
    found = by_id(secret_scan(documents(spark, rows)), "spans")
    assert found[1] == ("guess:18:32",) and found[4] == ("guess:22:34",)
    assert found[2] == found[3] == found[5] == ("",)


def test_costly_values_of_any_characters(spark):
    values = ["qWxRtYzPkLmNbVcDhJ", "9381-5526-0471-8842", "kvzq-wjxh-bnmt-qpld"]
    contexts = ["bearer ", "pin secret is ", "passphrase: "]
    rows = [(i, c + v) for i, (c, v) in enumerate(zip(contexts, values, strict=True))]
    rows += [(10, "the passphrase constantinople"), (11, "secret 2023-2024")]
    found = by_id(secret_scan(documents(spark, rows)), "spans")
    for i, (c, v) in enumerate(zip(contexts, values, strict=True)):
        assert found[i] == (f"guess:{len(c)}:{len(c) + len(v)}",)
    assert found[10] == found[11] == ("",)


def test_values_after_several_context_words(spark):
    cases = [
        ("auth credentials: ", "8fjK2pQz91xLmV"),
        ("token passphrase: ", "Xk9-aa81Lpq2z"),
        ("Authorization: Basic ", "dXNlcjpwYXNzd29yZDEy"),
        ("Authorization: Bearer ", "Zk81Qm02LxT7"),
        ("auth client_key: ", "Xk9-aa81Lpq2z"),
        ("auth passphrase=", "Xk9-aa81Lpq2z"),
        ("pwd secret key:", "Xk9-aa81Lpq2z"),
        ("password is: ", "Xk9-aa81Lpq2z"),
        ("the passphrase: ", "my-token-9f8a7b6c5d4e"),
        ("the pwd hash ", ""),
        ("the authority ", ""),
    ]
    rows = [(i, f"{c}{v or 'Xk9-aa81Lpq2z'} and more") for i, (c, v) in enumerate(cases)]
    found = by_id(secret_scan(documents(spark, rows)), "spans")
    for i, (c, v) in enumerate(cases):
        assert found[i] == (f"guess:{len(c)}:{len(c) + len(v)}" if v else "",), c


def test_guess_cost():
    assert segments("")[0] == 0
    assert [k for k, _, _ in segments("password2023")[1]] == ["word", "date"]
    assert [k for k, _, _ in segments("qwertyuiop")[1]] == ["walk"]
    assert [k for k, _, _ in segments("zzzzzzzz")[1]] == ["repeat"]
    assert segments("p@ssw0rd")[0] < 4 < segments("xkvq8t2z")[0]
    assert segments("x9" * 20_000)[0] > 1000


def test_archive_roundtrip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 3)
    big = "<p>é" + "x" * 1200
    rows = [(i, f"http://h{i % 3}.example.com/p{i}", f"{big}{i % 4}") for i in range(20)]
    rows += [(30, None, None), (31, "http://[bad", ""), (None, "u", "n"), (32, "u\r\nv w", "small"), (33, "u", "small")]
    rows += [rows[5], rows[0]]
    rows += [(40 + i, "http://one.example.com/", f"y{i}") for i in range(12)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, record_type int")
    made = warc.archive(spark, pages)
    assert made.directory.count() >= 1
    found = warc.read_pages(made, pages).collect()
    latest = {}
    for p, _, h in rows:
        if h and len(h.encode()) >= 1000:
            latest[h] = max(latest.get(h, p), p)
    wanted = []
    for p, u, h in rows:
        data, first = (h or "").encode(), latest.get(h)
        revisit = first is not None and first != p
        wanted.append((p, u, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response",
                       first if revisit else None, None if revisit else h or ""))
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == sorted(wanted, key=str)
    some = pages.where("page_id in (3, 41)")
    assert sorted(r["page_id"] for r in warc.read_pages(made, some).collect()) == [3, 41]
    none = warc.archive(spark, pages.limit(0))
    assert warc.read_pages(none, pages).count() == 0


def test_capture_key():
    assert warc.capture_key("https://User@WWW.b.example:80/x?y#z", 1).startswith("example,b,www)/x?y ")
    assert warc.capture_key("http://b.example", 5) < warc.capture_key("http://a.b.example", 5)
    assert warc.capture_key(None, None) == ")/ -"
