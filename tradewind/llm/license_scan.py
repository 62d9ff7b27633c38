"""License notices found by a positional index of their rarest words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.llm.batches import slices, with_columns

# A-Z become lower case; ASCII characters that are neither letters nor digits separate words.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    """The text's words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lowered, in UTF-8."""
    return text.encode().translate(_WORDS).split()


@dataclass(frozen=True)
class Template:
    """A license's label, a notice that states it, and the phrase the notice can't do without.

    ``unless`` is the label of a license whose notice holds this one: beside it, this one says
    nothing of its own.
    """

    label: str
    notice: str
    key: str
    unless: str = ""


#: Phrases each of whose places counts, with their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: How the licenses are called, version included, by label.
NAMES = {
    "mit": ("mit license", "mit x11 license", "expat license", "terms of the mit license"),
    "apache-2": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"),
    "gpl-2": ("general public license version 2", "general public license v2", "gpl version 2", "gpl v2", "gplv2", "gpl 2 0"),
    "gpl-3": ("general public license version 3", "general public license v3", "gpl version 3", "gpl v3", "gplv3", "gpl 3 0"),
    "lgpl-2.1": ("lesser general public license version 2 1", "lesser general public license v2 1", "lgpl version 2 1", "lgpl v2 1", "lgplv2 1", "lgpl 2 1"),
    "lgpl-3": ("lesser general public license version 3", "lesser general public license v3", "lgpl version 3", "lgpl v3", "lgplv3", "lgpl 3 0"),
    "agpl-3": ("affero general public license version 3", "affero general public license v3", "agpl version 3", "agpl v3", "agplv3", "agpl 3 0"),
    "bsd-2": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "two clause bsd license"),
    "bsd-3": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "three clause bsd license"),
    "mpl-2": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "isc": ("isc license",),
    "zlib": ("zlib license", "zlib libpng license"),
    "unlicense": ("unlicense",),
    "epl-2": ("eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license 2 0", "epl 2 0"),
    "bsl-1": ("boost software license version 1 0", "boost software license 1 0"),
    "cc0-1": ("cc0 1 0", "creative commons zero 1 0"),
    "cc-by": ("cc by 4 0", "cc by 3 0", "creative commons attribution 4 0", "creative commons attribution 3 0"),
    "cc-by-sa": ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"),
    "cc-by-nc": ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"),
    "cc-by-nd": ("cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs"),
    "wtfpl": ("do what the fuck you want to public license", "wtfpl"),
}
#: The identifiers of the SPDX list, as words, by label.
IDENTIFIERS = {
    "mit": "mit", "apache-2": "apache 2 0", "gpl-2": "gpl 2 0", "gpl-3": "gpl 3 0", "lgpl-2.1": "lgpl 2 1",
    "lgpl-3": "lgpl 3 0", "agpl-3": "agpl 3 0", "bsd-2": "bsd 2 clause", "bsd-3": "bsd 3 clause",
    "mpl-2": "mpl 2 0", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense", "epl-2": "epl 2 0",
    "bsl-1": "bsl 1 0", "cc0-1": "cc0 1 0", "cc-by": "cc by 4 0", "cc-by-sa": "cc by sa 4 0",
    "cc-by-nc": "cc by nc 4 0", "cc-by-nd": "cc by nd 4 0", "wtfpl": "wtfpl",
}
#: How a work says what it is licensed under.
STATEMENTS = ("licensed under", "released under", "distributed under", "available under", "published under",
              "covered by", "under the terms of", "dedicated to the public domain under")
_GNU_KINDS = {"gpl": "", "lgpl": "lesser", "agpl": "affero"}
_OF_GNU = ("gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "agpl-3")


def _gnu_header(name: str, version: str) -> tuple[str, str]:
    key = (
        f"gnu {name} as published by the free software foundation either version {version} of the license"
    )
    return f"it under the terms of the {key} or at your option any later version", key


#: Sentences of public license notices.
NOTICES = (
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software "
        "and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy",
    ),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the "
        "license at http www apache org licenses license 2 0",
        "www apache org licenses license 2 0",
    ),
    Template("gpl-2", *_gnu_header("general public license", "2")),
    Template("gpl-3", *_gnu_header("general public license", "3")),
    Template("lgpl-2.1", *_gnu_header("lesser general public license", "2 1")),
    Template("lgpl-3", *_gnu_header("lesser general public license", "3")),
    Template("agpl-3", *_gnu_header("affero general public license", "3")),
    Template(
        "bsd-3",
        "may be used to endorse or promote products derived from this software without specific prior "
        "written permission",
        "may be used to endorse or promote products derived from this software",
    ),
    Template(
        "bsd-2",
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
        "redistribution and use in source and binary forms with or without modification are permitted",
        unless="bsd-3",
    ),
    Template(
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "subject to the terms of the mozilla public license v 2 0",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without "
        "fee is hereby granted",
        "permission to use copy modify and or distribute this software for any purpose",
    ),
    Template(
        "zlib",
        "altered source versions must be plainly marked as such and must not be misrepresented as being "
        "the original software",
        "altered source versions must be plainly marked as such",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        "free and unencumbered software released into the public domain",
    ),
    Template(
        "bsl-1",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of "
        "the software and accompanying documentation covered by this license",
        "free of charge to any person or organization obtaining a copy",
    ),
)


def _stated() -> Iterator[Template]:
    """Statements of every license by each of its names, and its identifier line."""
    for label, names in NAMES.items():
        for name in names:
            own = [name, f"gnu {name}"] if label in _OF_GNU else [name]
            for called in own:
                for said in STATEMENTS:
                    for article in ("the ", "a ", ""):
                        key = f"{said} {article}{called}"
                        yield Template(label, f"this work is {said} the {called}", key)
    for label, words in IDENTIFIERS.items():
        key = f"spdx license identifier {words}"
        yield Template(label, key, key)
        if label in _OF_GNU:  # its title, as "GNU General Public License v3.0"
            kind, _, version = words.partition(" ")
            title = f"gnu {_GNU_KINDS[kind]} general public license v{version}".replace("  ", " ")
            yield Template(label, title, title)


TEMPLATES = (*NOTICES, *_stated())

#: Words of a key phrase, the rarest first, that are looked up.
ANCHORS = 3
#: Words by which a notice may begin earlier or end later than its template does.
DRIFT = 4
#: Share of a notice, by rarity, that must stand there for its label.
LEAST_SHARE = 0.5


def _places(words: list[bytes], phrase: list[bytes], starts: Iterable[int]) -> list[int]:
    n = len(phrase)
    return [s for s in starts if s >= 0 and words[s : s + n] == phrase]


def _in_order(notice: list[bytes], near: list[bytes], rarity: dict[bytes, float]) -> float:
    """The most that words of ``notice`` can weigh which stand in ``near`` in the same order."""
    best = [0.0] * (len(near) + 1)
    for word in notice:
        before = 0.0
        for k, other in enumerate(near, 1):
            above = best[k]
            best[k] = max(above, best[k - 1], before + rarity[word] if word == other else 0.0)
            before = above
    return best[-1]


@dataclass(frozen=True)
class Notice:
    """A notice that was found: where its key phrase stands, and its share by rarity."""

    start: int
    end: int
    label: str
    share: float
    unless: str = ""


class LicenseIndex:
    """Postings ``word -> (phrase or notice, place)`` for the rarest words of each."""

    def __init__(self, spread: dict[str, int], n_docs: int, templates: tuple[Template, ...] = TEMPLATES):
        """``spread``: in how many of the ``n_docs`` documents each license word is found."""

        def rarity(word: bytes) -> float:
            return log((n_docs + 1) / (spread.get(word.decode(), 0) + 0.5))

        self.base = [(label, words_of(phrase)) for label, phrase in BASE]
        self.templates = [(t, words_of(t.notice), words_of(t.key)) for t in templates]
        self.rarity = {w: max(1e-9, rarity(w)) for _, *own in self.templates for ws in own for w in ws}
        self.base_at: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, phrase) in enumerate(self.base):
            rarest = max(range(len(phrase)), key=lambda i: (rarity(phrase[i]), i))
            self.base_at.setdefault(phrase[rarest], []).append((k, rarest))
        #: For each word: the notices that are looked up by it, as which of their words (the rarest
        #: is 0), and where it stands in their key phrases.
        self.notice_at: dict[bytes, list[tuple[int, int, list[int]]]] = {}
        self.n_anchors: list[int] = []
        gate = set(self.base_at)
        for k, (_, _, key) in enumerate(self.templates):
            # The key phrase can't be missing, so its rarest words find every notice.
            ranked = sorted(set(key), key=lambda w: (-self.rarity[w], w))[:ANCHORS]
            self.n_anchors.append(len(ranked))
            gate.add(ranked[0])
            for n, word in enumerate(ranked):
                places = [i for i, w in enumerate(key) if w == word]
                self.notice_at.setdefault(word, []).append((k, n, places))
        #: A text without any of these holds no phrase and no notice.
        self.gate = frozenset(gate)

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[Notice]]:
        """The number of words, the base phrases' places, and the notices."""
        words = words_of(text)
        if self.gate.isdisjoint(words):
            return len(words), [], []
        at: dict[bytes, list[int]] = {}
        for i, word in enumerate(words):
            if word in self.notice_at or word in self.base_at:
                at.setdefault(word, []).append(i)
        base: list[tuple[int, str]] = []
        for word, found in self.base_at.items():
            for k, offset in found:
                label, phrase = self.base[k]
                base += [(s, label) for s in _places(words, phrase, (i - offset for i in at.get(word, ())))]
        return len(words), sorted(base), self._told(self._verified(words, self._candidates(at)))

    def _candidates(self, at: dict[bytes, list[int]]) -> Iterator[tuple[int, set[int]]]:
        """Templates and where their key phrases may begin: the text's license words, the rarest
        first, are looked up, and their postings intersected by relative position."""
        own = sorted((w for w in at if w in self.notice_at), key=lambda w: (-self.rarity[w], w))
        starts: dict[int, set[int]] = {}
        seen: Counter[int] = Counter()
        for word in own:
            here = set(at[word])
            for k, n, offsets in self.notice_at[word]:
                if n == 0:
                    starts[k] = {i - o for i in here for o in offsets}
                elif starts.get(k):  # rarer words of the notice have left few places
                    starts[k] = {s for s in starts[k] if any(s + o in here for o in offsets)}
                seen[k] += 1
        for k, found in starts.items():
            if found and seen[k] == self.n_anchors[k]:
                yield k, found

    def _verified(self, words: list[bytes], candidates: Iterable[tuple[int, set[int]]]) -> list[Notice]:
        found = []
        for k, starts in candidates:
            template, notice, key = self.templates[k]
            # Statements put another article into the key phrase than the notice has.
            within = (_places(notice, key, range(len(notice))) or [max(0, len(notice) - len(key))])[0]
            whole = sum(self.rarity[w] for w in notice)
            for start in _places(words, key, starts):
                low = max(0, start - within - DRIFT)
                high = start + max(len(notice) - within, len(key)) + DRIFT
                share = _in_order(notice, words[low:high], self.rarity) / whole
                if share >= LEAST_SHARE:
                    share = min(1.0, round(share, 12))
                    found.append(Notice(start, start + len(key), template.label, share, template.unless))
        return found

    def _told(self, found: list[Notice]) -> list[Notice]:
        """The notices without those that stand within another's key phrase, that say the same at
        the same place, or that another license's notice holds."""
        labels = {n.label for n in found}
        found.sort(key=lambda n: (n.start, -n.end, -n.share, n.label))
        out: list[Notice] = []
        reach = 0
        for n in found:
            if n.unless not in labels and n.end > reach:
                out.append(n)
                reach = n.end
        return out


def word_spread(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> DataFrame:
    """``word, n``: in how many documents each word of the phrases and notices is found."""
    texts = [x for t in templates for x in (t.notice, t.key)] + [p for _, p in BASE]
    known = frozenset(w for x in texts for w in words_of(x))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(known, 0)
        for batch in batches:
            for _, some in slices(batch, text):
                for value in some:
                    for word in known.intersection(words_of(value)):
                        counts[word] += 1
        seen = {w.decode(): n for w, n in counts.items() if n}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
            names=["word", "n"],
        )

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns below, which replace columns of those names.

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the places where a
    base phrase's words stand; ``labels``, those and the notices' labels; ``notices``, the notices'
    places, labels and shares; ``score``, the largest share of a notice by rarity, 0 without one.
    Labels are distinct, in order, joined by commas.

    How rare a word is comes from all documents, in a first pass whose result has as many rows as
    the templates have words. A null or empty text has no words, no labels and null places.
    Repeated rows count each and get equal results; an empty table gives an empty one.
    """
    n_docs = docs.count()
    spread = {r["word"]: r["n"] for r in word_spread(docs, text=text).collect()}

    def compute():
        index = LicenseIndex(spread, n_docs)

        def work(texts: list[str], _: pa.RecordBatch) -> list[list]:
            out: list[list] = [[] for _ in _COLUMNS]
            for value in texts:
                n, base, notices = index.scan(value)
                own = {label for _, label in base}
                own_notices = {n.label for n in notices}
                row = (
                    n,
                    len(base),
                    base[0][0] if base else None,
                    base[-1][0] if base else None,
                    ",".join(sorted(own)),
                    ",".join(sorted(own | own_notices)),
                    max((n.share for n in notices), default=0.0),
                    [{"word": n.start, "label": n.label, "share": n.share} for n in notices],
                )
                for column, value_ in zip(out, row, strict=True):
                    column.append(value_)
            return out

        return work

    return with_columns(docs, _COLUMNS, compute, text)


_NOTICE = T.StructType(
    [
        T.StructField("word", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("share", T.DoubleType()),
    ]
)
_COLUMNS = {
    "n_words": T.LongType(),
    "n_base": T.LongType(),
    "first_word": T.LongType(),
    "last_word": T.LongType(),
    "base_labels": T.StringType(),
    "labels": T.StringType(),
    "score": T.DoubleType(),
    "notices": T.ArrayType(_NOTICE),
}
