"""License notices and secrets in the wording that real files have."""

from __future__ import annotations

import random
import string
import time
from itertools import combinations

import pytest

from tests.llm.tables import by_id, documents
from tradewind.llm.license_scan import IDENTIFIERS, LicenseIndex, license_scan
from tradewind.llm.secret_scan import (
    Guesser,
    _size,
    _SEGMENT,
    default_vocabularies,
    guess_spans,
    ranked_words,
)

# Licenses

GNU = """This {work} is free software: you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU {name} for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions.
2. Redistributions in binary form must reproduce the above copyright notice.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""
NEITHER = """3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission."""
HEADERS = {
    "gpl-2": GNU.format(work="program", name="General Public License", version="2"),
    "gpl-3": GNU.format(work="program", name="General Public License", version="3"),
    "lgpl-2.1": GNU.format(work="library", name="Lesser General Public License", version="2.1"),
    "lgpl-3": GNU.format(work="library", name="Lesser General Public License", version="3"),
    "agpl-3": GNU.format(work="program", name="Affero General Public License", version="3"),
    "mit": """MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy.""",
    "bsd-2": BSD.format(""),
    "bsd-3": BSD.format(NEITHER),
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty.
2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.""",
}
NEGATIVE = [
    "We moved away from the GNU General Public License version 3 last year.",
    "The general public is under the impression that a license is granted to redistribute in any form.",
    "She was released under the bridge and the version 2 of her story was distributed by the public.",
    "Compare the Affero General Public License with the Lesser General Public License.",
    "SPDX names licenses by an identifier.",
]


@pytest.fixture(scope="module")
def index():
    return LicenseIndex({}, 1000)


def labels(index, text):
    return {n.label for n in index.scan(text)[2]}


@pytest.mark.parametrize("label", HEADERS)
def test_standard_notices_have_their_label_alone(index, label):
    assert labels(index, HEADERS[label]) == {label}
    before, after = "word " * 50, " and more of it" * 30
    assert labels(index, before + HEADERS[label] + after) == {label}


def test_identifier_lines(index):
    for label, words in IDENTIFIERS.items():
        assert labels(index, f"// SPDX-License-Identifier: {words.replace(' ', '-').upper()}\nint x;") == {label}


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
        ("released under CC BY 4.0", "cc-by"),
        ("distributed under the Boost Software License, Version 1.0.", "bsl-1"),
        ("available under the terms of the MIT license", "mit"),
        ("GNU General Public License v3.0", "gpl-3"),
        ("licensed under the GNU Lesser General Public License, version 2.1", "lgpl-2.1"),
        ("published under the GPLv2", "gpl-2"),
    ],
)
def test_statements(index, text, label):
    assert labels(index, text) == {label}


@pytest.mark.parametrize("text", NEGATIVE)
def test_mentions_are_no_notices(index, text):
    assert labels(index, text) == set()


def test_words_in_another_order_weigh_less(index):
    text = HEADERS["mit"].split()
    key = "permission is hereby granted free of charge to any person obtaining a copy"
    (whole,) = index.scan(" ".join(text))[2]
    turned = f"restriction without software the in deal to files documentation associated {key}"
    found = index.scan(turned)[2]
    assert all(n.share < whole.share for n in found) and whole.share > 0.9


def test_each_files_notices_are_found_among_many(spark):
    """Against plain search of each key phrase, over texts mixed of all notices."""
    rng = random.Random(4)
    parts = [*HEADERS.values(), *NEGATIVE, "plain words of a text " * 5]
    rows = [(i, "\n".join(rng.choices(parts, k=rng.randint(0, 6)))) for i in range(80)]
    found = by_id(license_scan(documents(spark, rows)), "labels")
    for i, text in rows:
        wanted = {label for label, notice in HEADERS.items() if notice in text}
        if "bsd-3" in wanted:
            wanted.discard("bsd-2")
        assert set(found[i][0].split(",")) - {""} == wanted


# Secrets


@pytest.fixture(scope="module")
def guesser():
    return Guesser(ranked_words(default_vocabularies()))


ORDINARY = [
    "password strength-requirements", "bearer authentication/authorization", "token 3,141,592,653",
    "secret Franco-British", "auth high-quality", "password https://example.com/reset/page",
    "secrets Jean-Jacques", "Secret Service/Agency", "the password straightforwardness",
    "secret: authentication", "token: https://example.com/some/long/article-title-of-it",
    "passphrase: internationalization", "token is state-of-the-art", "password: user@example.com",
    "secret = december-2023", "the credentials (username/password) of",
]


@pytest.mark.parametrize("text", ORDINARY)
def test_ordinary_words_are_no_secrets(guesser, text):
    assert guess_spans(text, [], guesser) == []


ALPHABETS = {
    "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase,
    "letters": string.ascii_letters,
    "digits": string.digits,
    "base62": string.ascii_letters + string.digits,
    "signs": string.ascii_letters + string.digits + "!#$%&*+-_?@^~",
}


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_random_values_are_secrets(guesser, alphabet):
    rng = random.Random(1)
    for _ in range(30):
        value = "".join(rng.choices(ALPHABETS[alphabet], k=rng.randint(16, 32)))
        found = guess_spans(f"the passphrase is {value} of it", [], guesser)
        assert [f[:3] for f in found] == [(18, "guess", 18 + len(value))], value


def test_values_keep_their_last_sign(guesser):
    for text, value in [
        ("password: Xy9#kQ2v! and", "Xy9#kQ2v!"),
        ("(password: Xy9#kQ2v)", "Xy9#kQ2v"),
        ("the password is Xy9#kQ2v.", "Xy9#kQ2v"),
        ('password "Xy9#kQ2v."', "Xy9#kQ2v."),
        ("password is (Xy9#kQ2v)", "(Xy9#kQ2v)"),
    ]:
        (found,) = guess_spans(text, [], guesser)
        assert text[found[0] : found[2]] == value


def all_ways(guesser, value):
    """The cheapest of all segmentations, each worked out on its own."""
    kinds = {}
    for end, found in enumerate(guesser.ending(value), 1):
        for cost, start, _ in found:
            kinds[start, end] = min(cost, kinds.get((start, end), cost))
    best = float("inf")
    for k in range(len(value)):
        for cuts in combinations(range(1, len(value)), k):
            places = [0, *cuts, len(value)]
            total = 0.0
            for a, b in zip(places, places[1:], strict=False):
                tried = _SEGMENT + sum(map(_size, value[a:b]))
                total += min(tried, kinds.get((a, b), tried))
            best = min(best, total)
    return best


def test_least_cost_against_all_segmentations(guesser):
    rng = random.Random(8)
    pieces = ["pass", "word", "2023", "qwe", "aaa", "x", "7", "-", "K", "é", "the", "p4ss", "123", "."]
    values = ["".join(rng.choices(pieces, k=5))[:10] for _ in range(60)]
    for value in values:
        cost, parts = guesser.segments(value)
        assert cost == pytest.approx(all_ways(guesser, value)), value
        assert [p[1] for p in parts] == [0, *[p[2] for p in parts[:-1]]] and parts[-1][2] == len(value)


@pytest.mark.parametrize("value", ["a", "ab", "x9Kq", "password", "qwertyuiop", "2023-01-01", "a/", "zz9"])
def test_very_long_values(guesser, value):
    value = value * (10_000_000 // len(value))
    began = time.perf_counter()
    found = guess_spans(f"password: {value} end", [], guesser)
    assert time.perf_counter() - began < 20
    assert len(found) == (value[:2] != "aa") and all(f[3] <= 60 for f in found)


# Tokens and pieces


def test_one_very_long_word_keeps_to_the_memory(monkeypatch):
    """The transducer starts anew within a word, from the state that it has reached."""
    from tokenizers import Tokenizer

    from tradewind.llm import token_counts

    rng = random.Random(2)
    word = "".join(rng.choices(string.ascii_letters, k=60_000))
    path = token_counts.default_path()
    wanted = len(Tokenizer.from_file(path).encode(word, add_special_tokens=False).ids)
    monkeypatch.setattr(token_counts, "REMEMBERED", 2_000)
    monkeypatch.setattr(token_counts, "STRETCH", 512)
    merger = token_counts.Merger(path)
    assert merger.count(word.encode()) == wanted
    assert len(merger._moves) <= 4_000 + 512 and len(merger._states) <= 4_000 + 514
    assert merger.count(b"hello") == merger.count(b"hello") == 1


def test_decode_of_messy_tables(spark):
    from tradewind.llm import pieces

    schema = "doc_id long, ids array<int>, text int, n_ids int"
    ids = pieces.load(pieces.default_path()).encode("a bé \U0001f600")
    rows = [(1, ids, 0, 0), (1, ids, 0, 0), (None, None, 0, 0), (2, [], 0, 0), (3, [None, *ids, None], 0, 0)]
    table = spark.createDataFrame(rows, schema)
    found = pieces.decode(table)
    assert found.columns == ["doc_id", "ids", "n_ids", "text"]
    assert sorted((str(r.doc_id), r.text) for r in found.collect()) == [
        ("1", "a bé \U0001f600"), ("1", "a bé \U0001f600"), ("2", ""), ("3", "a bé \U0001f600"), ("None", ""),
    ]
    assert pieces.decode(table.limit(0)).collect() == []


def test_stretches_of_all_lengths_have_the_librarys_ids(monkeypatch):
    """Short stretches, long ones, characters without a piece, and the sign for a space."""
    import sentencepiece

    from tradewind.llm import pieces

    path = pieces.default_path()
    model = pieces.Model(path)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(12)
    signs = ["a", "the", "ing", " ", "  ", "é", "▁", "\U0001f600", "中", "\n", "zq", "1", "ก", "x" * 30]
    for _ in range(400):
        text = "".join(rng.choices(signs, k=rng.randint(0, 40)))
        packed, lossless = model.checked(text)
        ids = model.encode(text)
        assert ids == library.encode(text) and len(packed) == 4 * len(ids)
        assert lossless == (model.decode(ids) == text)


def test_a_long_text_full_of_license_words():
    """Words that every notice has are not looked up for notices whose rarer words are missing."""
    spread = {w: n for n, w in enumerate("boost gnu zlib mit general public version under the of license".split(), 1)}
    index = LicenseIndex(spread, 1000)
    text = "the license of the public under the version 2 of this license " * 100_000
    began = time.perf_counter()
    assert labels(index, text + HEADERS["gpl-2"] + text) == {"gpl-2"}
    assert time.perf_counter() - began < 20
