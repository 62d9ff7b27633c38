"""Secrets in text: fixed patterns, and values in credential contexts that are costly to guess."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from math import log10

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tradewind.llm.batches import with_columns

# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "guess")
LEAST = {"assign": 6, "access": 20, "hex": 24}

_LETTER = "a-z\\u00c0-\\u024f"
_WORD = (
    r"(?>(?:(?:api|access|auth|private|secret|client|encryption)[ _-]?(?:key|secret|token)s?"
    r"|pass(?:word|wd|phrase|code)?s?|pwd|secrets?|tokens?|credentials?|bearer|auth(?:orization)?)"
    rf"(?![{_LETTER}]))"
)
#: Where a credential's value may follow, beyond the base pattern's words and signs. The value is
#: only looked at, so that the context words in it are found as well.
CONTEXT = re.compile(
    rf"(?<![{_LETTER}]){_WORD}"
    r"""["'`]?+[ \t]{0,4}+(?P<told>(?:is|was)\b[ \t]{0,4}+)?+(?P<sign>:=|=>|==|[:=])?+[ \t]{0,4}+"""
    r"""(?:(?:basic|bearer|digest|hoba|mutual|negotiate|ntlm|oauth|vapid|hawk|hmac|apikey)[ \t]{1,4}+)?+"""
    r"""(?P<quote>["'`])?+(?=(?P<value>[^\s"'`<>]{8,}))""",
    re.I | re.A,
)
#: A value that is a context word itself, or begins with one and its sign: the true value follows.
_LABEL = re.compile(rf"{_WORD}(?:[:=]|[.,;!?)}}\]]*\Z)", re.I | re.A)
_CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "credential", "bearer", "auth", "key")
_BASE_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Decimal digits of the guesses from which a value counts as a secret.
LEAST_COST = 10.0
#: The same for a value of nothing but words, separators, dates, numbers and addresses.
LEAST_WORDY = 16.0
#: Digits per character from which what is written like a word, but is in no list, isn't one.
UNWORDLIKE = 1.12
#: A value is costed up to so many digits; what is left of it can't make it any cheaper.
MOST_COST = 60.0

#: Common words of passwords, the likeliest first.
WORDS = (
    "password the admin love you welcome monkey dragon master login and letmein shadow sunshine "
    "princess football baseball iloveyou superman hello freedom whatever trust secret test user "
    "root guest pass key token change me default summer winter spring autumn january february march "
    "april may june july august september october november december monday friday sunday london "
    "paris berlin madrid america house computer internet server database access public private "
    "system service account example sample demo temp data code open word blue green black white "
    "red star king queen angel baby happy lucky magic power super hunter ranger tiger eagle lion "
    "horse battery staple correct my is not for with this that your value string your_password "
    "placeholder none null true false here insert enter new old next random required string "
    "changeme username email phone number address name first last"
).split()
#: Letters of a word, at least, and of what a word is looked up by, at most.
_SHORTEST, _LONGEST = 3, 24
_PLAIN = str.maketrans("013457@$", "oleastas")
# Keys that lie side by side, and the alphabet, in either direction.
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qaz", "wsx", "edc", "rfv", "tgb")
_BESIDE = {a + b for row in _ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:], strict=False)}
_ORDERED = "abcdefghijklmnopqrstuvwxyz"
_BESIDE |= {a + b for x in (_ORDERED, _ORDERED[::-1]) for a, b in zip(x, x[1:], strict=False)}
_DATE = re.compile(
    r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d"
    r"|(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])[-/.]?(?:19|20)\d\d"
)
_YEAR = re.compile(r"(?:19|20)\d\d")
_NUMBER = re.compile(r"(?<!\d)\d{1,3}(?:,\d{3})+(?:\.\d+)?(?!\d)")
_URL = re.compile(
    r"(?:(?:https?|ftp)://|www\.)(?:[a-z][a-z-]{0,62}\.){1,5}[a-z]{2,12}(?:/[a-z][a-z-]{0,62}){0,12}/?",
    re.I | re.A,
)
_EMAIL = re.compile(r"[a-z][a-z.]{0,40}@(?:[a-z][a-z-]{0,62}\.){1,3}[a-z]{2,12}", re.I | re.A)
#: Spans of set kinds, and what each costs.
_KNOWN = (
    (_DATE, log10(365 * 120), "date"),
    (_YEAR, log10(120), "date"),
    (_NUMBER, 6.0, "number"),
    (_URL, 4.0, "url"),
    (_EMAIL, 6.0, "email"),
)
_SEPARATORS = "-_./:,+&"
_WORDY = {"word", "separator", "date", "number", "url", "email"}
#: Written like words: letters, capitals at the start of a word or throughout, between separators.
_WORDLIKE = re.compile(r"[^\W\d_]?(?:[^\W\d_])*(?:[-/._][^\W\d_]+)*")
_RUN = re.compile(r"(.)\1{39,}", re.S)
#: What another segment costs.
_SEGMENT = log10(2)


def _size(c: str) -> float:
    return log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def default_vocabularies() -> tuple[str, ...]:
    return tuple(map(public_tokenizers.path, ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")))


@lru_cache(maxsize=4)
def ranked_words(vocabularies: tuple[str, ...]) -> dict[str, int]:
    """Words and their ranks: those of passwords, then the whole words of tokenizers' vocabularies,
    which list frequent ones first. Files hold a base64 piece and its rank a line."""
    ranks = {w: k + 1 for k, w in reversed(list(enumerate(WORDS)))}
    for path in vocabularies:
        own = 0
        with open(path, "rb") as lines:
            for line in lines:
                piece = base64.b64decode(line.split()[0])
                if not piece.startswith(b" "):
                    continue
                word = piece[1:].decode(errors="replace").lower()
                if word.isalpha() and _SHORTEST <= len(word) <= _LONGEST:
                    own += 1
                    ranks[word] = min(ranks.get(word, len(WORDS) + own), len(WORDS) + own)
    return ranks


class Guesser:
    """Least costs of guessing values, in decimal digits.

    A value is cut into segments: words (by rank, with capitals and digits for letters), single
    separators, dates and years, numbers in groups of three, addresses, runs of one character,
    walks over neighbouring keys or letters, and stretches tried character by character. Dynamic
    programming over places finds the cheapest way, whether or not it ends in such a stretch.
    """

    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks

    def ending(self, value: str) -> Iterator[list[tuple[float, int, str]]]:
        """For each place from 1 on, ``(cost, start, kind)`` of the segments that end there, without
        those tried character by character."""
        low = value.lower()
        low = low if len(low) == len(value) else value
        plain = low.translate(_PLAIN)
        known: dict[int, list[tuple[float, int, str]]] = {}
        for pattern, cost, kind in _KNOWN:
            for m in pattern.finditer(value):
                known.setdefault(m.end(), []).append((cost + _SEGMENT, m.start(), kind))
        run = walk = letters = 0
        get = self.ranks.get
        for i in range(1, len(value) + 1):
            c = value[i - 1]
            found = known.get(i, [])
            run = run + 1 if i > 1 and value[i - 2] == c else 1
            walk = walk + 1 if i > 1 and low[i - 2 : i] in _BESIDE else 1
            letters = letters + 1 if c.isalpha() or plain[i - 1].isalpha() else 0
            if run >= 3:
                found.append((_size(c) + log10(run) + _SEGMENT, i - run, "repeat"))
            if walk >= 3:
                found.append((log10(47) + (walk - 1) * log10(2) + _SEGMENT, i - walk, "walk"))
            if c in _SEPARATORS:
                found.append((log10(len(_SEPARATORS)), i - 1, "separator"))
            for start in range(i - min(letters, _LONGEST), i - _SHORTEST + 1):
                rank, extra = get(low[start:i]), 0.0
                if rank is None:
                    rank, extra = get(plain[start:i]), log10(4)
                if rank:
                    own = value[start:i]
                    extra += 0 if own.islower() else log10(2) if own[0].isupper() else log10(4)
                    found.append((log10(rank + 1) + extra + _SEGMENT, start, "word"))
            yield found

    def segments(
        self, value: str, most: float = float("inf")
    ) -> tuple[float, list[tuple[str, int, int]] | None]:
        """The least cost of ``value`` and the segments that give it.

        Once no way of going on costs less than ``most``, that is the cost, without segments.
        """
        best: list[tuple[float, int, str]] = [(0.0, 0, "")]
        # The cheapest way that ends character by character, and where that stretch begins.
        tried, begin = float("inf"), 0
        behind = max(_LONGEST, 64)
        for i, found in enumerate(self.ending(value), 1):
            if best[-1][0] + _SEGMENT < tried:
                tried, begin = best[-1][0] + _SEGMENT, i - 1
            tried += _size(value[i - 1])
            options = [(best[start][0] + cost, start, kind) for cost, start, kind in found]
            best.append(min([(tried, begin, "brute"), *options]))
            if i % behind == 0 and min(b[0] for b in best[-behind:]) >= most:
                return most, None
        out, i = [], len(value)
        while i:
            _, start, kind = best[i]
            out.append((kind, start, i))
            i = start
        return best[-1][0], out[::-1]

    def judged(self, value: str, told: bool) -> float | None:
        """The cost of a value that counts as a secret, at most ``MOST_COST``; else None.

        Few guesses make none. More are asked for where the value is all words, and of what only
        looks like words, that they cost as much as random letters do, and that the context ends in
        a sign or a verb (``told``).
        """
        whole = value
        value = _RUN.sub(lambda m: m[1] * 40, value)
        cost, parts = self.segments(value, MOST_COST)
        if cost < LEAST_COST:
            return None
        if parts is not None and {kind for kind, _, _ in parts} <= _WORDY:
            return cost if cost >= LEAST_WORDY else None
        if _is_wordlike(whole) and not (told and cost >= min(MOST_COST, UNWORDLIKE * len(value))):
            return None
        return cost


def _is_wordlike(value: str) -> bool:
    if not _WORDLIKE.fullmatch(value):
        return False
    words = re.split(r"[-/._]", value)
    return all(w[1:] == w[1:].lower() or w.isupper() for w in words)


def segments(value: str) -> tuple[float, list[tuple[str, int, int]]]:
    """The least cost of guessing ``value``, in decimal digits, and the segments that give it."""
    return Guesser(ranked_words(default_vocabularies())).segments(value)


def _as_hex_runs() -> bytes:
    return bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))


_HEX_RUNS = _as_hex_runs()


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` of the base patterns, in order of start, then kind."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in _BASE_WORDS):
        found += [
            (m.start(), 0, m.end())
            for m in ASSIGN.finditer(text)
            if len(m.group(2)) >= LEAST["assign"]
        ]
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= LEAST["access"]
        ]
    if b"h" * LEAST["hex"] in text.encode().translate(_HEX_RUNS):
        found += [
            (m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]
        ]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


class _Taken:
    """Spans, asked for what overlaps them."""

    def __init__(self, spans: list[tuple[int, str, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start


def _stripped(value: str) -> str:
    """``value`` without the marks of the sentence around it."""
    while value:
        last = value[-1]
        pair = {")": "(", "]": "[", "}": "{"}.get(last)
        if last not in ".,;:" and not (pair and value.count(pair) < value.count(last)):
            break
        value = value[:-1]
    return value


def guess_spans(
    text: str, taken: list[tuple[int, str, int]], guesser: Guesser | None = None
) -> list[tuple[int, str, int, float]]:
    """``(start, kind, end, cost)`` of values in credential contexts that :meth:`Guesser.judged`
    takes for secrets and that lie outside ``taken``.

    Every value is costed, once. A value in quotes ends at the quote, another before the marks of
    its sentence. Values do not overlap: the first one found stays.
    """
    lowered = text.lower()
    if not any(w in lowered for w in _CONTEXT_WORDS):
        return []
    guesser = guesser or Guesser(ranked_words(default_vocabularies()))
    before = _Taken(taken)
    found = []
    last = 0
    for m in CONTEXT.finditer(text):
        start = m.start("value")
        if start < last or _LABEL.match(text, start, m.end("value")):
            continue
        value = m["value"] if m["quote"] else _stripped(m["value"])
        end = start + len(value)
        if len(value) < 8 or before.overlaps(start, end):
            continue
        cost = guesser.judged(value, bool(m["told"] or m["sign"]))
        if cost is not None:
            found.append((start, "guess", end, cost))
            last = end
    return found


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


_SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("cost", T.DoubleType()),
    ]
)
_COLUMNS = {
    "n_assign": T.LongType(),
    "n_access": T.LongType(),
    "n_hex": T.LongType(),
    "base_sha256": T.StringType(),
    "spans": T.StringType(),
    "secrets": T.ArrayType(_SPAN),
}


def secret_scan(
    docs: DataFrame, text: str = "text", vocabularies: tuple[str, ...] | None = None
) -> DataFrame:
    """``docs`` with the columns below, which replace columns of those names.

    ``n_assign``, ``n_access``, ``n_hex``: spans of the base patterns; ``base_sha256`` of these spans
    as ``kind:start:end``, in order, joined by commas; ``spans``, all spans so written; ``secrets``,
    the same as structs with the guess cost of ``guess`` spans, ``MOST_COST`` at most. Offsets are code points, ends
    exclusive. A null or empty text has no spans. Repeated rows get equal results, an empty table
    gives an empty one, and a text of any length is scanned whole. Nothing is shuffled.

    ``vocabularies`` are files that every machine has; their words are those of :func:`ranked_words`.
    """
    vocabularies = vocabularies or default_vocabularies()

    def compute():
        guesser = Guesser(ranked_words(vocabularies))

        def work(texts: list[str], _: pa.RecordBatch) -> list[list]:
            out: list[list] = [[] for _ in _COLUMNS]
            for value in texts:
                base = base_spans(value)
                guessed = guess_spans(value, base, guesser)
                costs = {start: cost for start, _, _, cost in guessed}
                every = sorted(
                    base + [g[:3] for g in guessed], key=lambda x: (x[0], KINDS.index(x[1]))
                )
                kinds = [k for _, k, _ in base]
                structs = [
                    {"kind": k, "start": s, "end": e, "cost": costs[s] if k == "guess" else None}
                    for s, k, e in every
                ]
                row = (
                    *(kinds.count(k) for k in KINDS[:3]),
                    sha256(_joined(base).encode()).hexdigest(),
                    _joined(every),
                    structs,
                )
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            return out

        return work

    return with_columns(docs, _COLUMNS, compute, text)
