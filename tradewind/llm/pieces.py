"""SentencePiece BPE encoding by a streaming Viterbi pass, and decoding."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tradewind.llm.batches import with_columns

SPACE = "▁"
#: Words whose ids a task remembers; when so many are held, it starts anew.
REMEMBERED = 400_000
#: Longer stretches without a space are encoded piece by piece, not remembered.
LONG = 64
#: Stretches that no piece reaches across: a piece has space marks only at its start.
_STRETCH = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


class _Words(dict):
    """The ids of stretches as bytes (32-bit integers), encoded as they are asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        #: Stretches whose ids don't decode to them; all others are proven to.
        self.changed: set[str] = set()

    def __missing__(self, word: str) -> bytes:
        ids = self.model.within(word) if len(word) <= self.model.window else None
        if ids is None:
            ids = tuple(chain.from_iterable(self.model.stream(word)))
            if b"".join(map(self.model.bytes_of, ids)) != word.encode():
                self.changed.add(word)
        packed = array("i", ids).tobytes()
        if len(word) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = packed
        return packed


class Model:
    """The pieces of a model file, read with the library that owns the format."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) for i in range(n)]
        byte = [lib.is_byte(i) for i in range(n)]
        self.byte_ids = [-1] * 256
        self.ids: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if byte[i]:
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not special[i] and not lib.is_unused(i):
                self.ids[piece] = i
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids) if i >= 0}
        self.special = {i for i in range(n) if special[i]}
        self.unknown = lib.unk_id()
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.window = max(map(len, self.ids))
        #: Finds all pieces in a text by where they end, the longest first.
        self._ends = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self._ends.add_word(piece, (len(piece), i))
        self._ends.make_automaton()
        inner = [p for p in self.ids if SPACE in p.lstrip(SPACE) or "\n" in p]
        if inner or any(i < 0 for i in self.byte_ids):
            raise ValueError("pieces across spaces, and models without byte pieces, are not served")
        self._halves: dict[str, tuple[str, str] | None] = {}
        self._sizes = [*map(len, self.pieces), 1]  # the last is that of a character without a piece
        self._meet: dict[int, bool] = {}
        self._words = _Words(self)
        self._bytes = [self._piece_bytes(i) for i in range(n)]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge joins when a piece is encoded; None if the encoding
        of its characters does not end in the one piece."""
        if piece not in self._halves:
            parts, last = [*piece], None
            while len(parts) > 1:
                ranked = [
                    (self.rank[x + y], i)
                    for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False))
                    if x + y in self.rank
                ]
                if not ranked:
                    break
                at = min(ranked)[1]
                last = (parts[at], parts[at + 1])
                parts[at : at + 2] = ["".join(last)]
            self._halves[piece] = last if len(parts) == 1 else None
        return self._halves[piece]

    def meets(self, left: int, right: int) -> bool:
        """Whether no merge joins two pieces where they meet; after -1, whether ``right`` comes
        about as one piece. A text's encoding is the one segmentation whose neighbours all do.
        """
        if len(self._meet) >= 4 * REMEMBERED:
            self._meet.clear()
        known = self._apart(self.pieces[left] if left >= 0 else "", self.pieces[right])
        self._meet[left << 32 | right] = known
        return known

    def _apart(self, left: str, right: str) -> bool:
        """Walks back through the merges on both sides of the place, the latest first. A merge
        across it happens if it ranks before the one undone last; of equals the left goes first.
        """
        rank = self.rank
        if len(right) > 1 and self.halves(right) is None:
            return False
        if not left:
            return True
        undone = (float("inf"), 0)
        while True:
            across = rank.get(left + right)
            if across is not None and (across, 1) < undone:
                return False
            a = rank[left] if len(left) > 1 else -1.0
            b = rank[right] if len(right) > 1 else -1.0
            if a < 0 and b < 0:
                return True
            if a > b:
                undone = (a, 1)
                left = self.halves(left)[1]
            else:
                undone = (b, 2)
                right = self.halves(right)[0]

    def stream(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids of a stretch of text, given out as soon as they are certain.

        One backpointer per boundary: the last piece of the encoding up to there, which is the one
        that passes ``meets`` with the piece before it. Only boundaries within one piece's length
        are kept. Where the paths back from all of them have one boundary in common, what lies
        before it can't change any more and is given out.
        """
        last: dict[int, int] = {0: -1}  # boundary: its piece, -1 for none
        committed, at, n, window = 0, 0, len(text), self.window
        due, found = window, True
        meet, left_of = self._meet.get, last.get
        for end, (size, right) in chain(self._ends.iter(text), [(n, (0, -1))]):
            j = end + 1
            if j != at:  # no more pieces end at the boundaries before
                if not found or j != at + 1 or at >= due:
                    for b in range(at, j):
                        if b not in last and b - 1 in last and text[b - 1] not in self.ids:
                            last[b] = -1  # a character without a piece never merges
                        if b >= due:
                            due = b + window
                            near = [x for x in last if b - window < x <= b]
                            met = self._common(near, last, committed)
                            if met > committed:
                                yield self._between(text, committed, met, last)
                                committed = met
                                last = {x: y for x, y in last.items() if x >= committed}
                                left_of = last.get
                at, found = j, False
            elif found:
                continue
            left = left_of(j - size)
            if left is not None:
                apart = meet(left << 32 | right)
                if self.meets(left, right) if apart is None else apart:
                    last[j] = right
                    found = True
        yield self._between(text, committed, n, last)

    def within(self, text: str) -> tuple[int, ...] | None:
        """The ids of a stretch no longer than the window, as :meth:`stream` gives them: nothing can
        be certain before its end. They are pieces found in it, so they decode to it; None if some
        character is in no piece."""
        n = len(text)
        last: list[int | None] = [None] * (n + 1)
        last[0] = -1
        meet = self._meet.get
        for end, (size, right) in self._ends.iter(text):
            if last[end + 1] is None and (left := last[end + 1 - size]) is not None:
                apart = meet(left << 32 | right)
                if self.meets(left, right) if apart is None else apart:
                    last[end + 1] = right
        out: list[int] = []
        while n > 0:
            if (piece := last[n]) is None:
                return None
            out.append(piece)
            n -= self._sizes[piece]
        return tuple(reversed(out))

    def _common(self, boundaries: list[int], last: dict[int, int], committed: int) -> int:
        paths = set(boundaries)
        while len(paths) > 1:
            b = max(paths)
            paths.remove(b)
            paths.add(max(b - self._sizes[last[b]], committed))
        return paths.pop() if paths else committed

    def _between(self, text: str, start: int, end: int, last: dict[int, int]) -> tuple[int, ...]:
        out: list[int] = []
        while end > start:
            piece = last[end]
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.byte_ids[b] for b in reversed(text[end - 1 : end].encode()))
            end -= self._sizes[piece]
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        """The ids that the library gives, without begin and end."""
        return np.frombuffer(self.checked(text)[0], np.int32).tolist()

    def checked(self, text: str) -> tuple[bytes, bool]:
        """The ids of ``text`` as 32-bit integers, and whether they decode to it.

        A stretch's ids are decoded when it is first encoded, so the text's need not be again: those
        of proven stretches give the text back, but for the sign that stands for a space.
        """
        if not text:
            return b"", True
        stretches = _STRETCH.findall(SPACE + text.replace(" ", SPACE))
        packed = b"".join(map(self._words.__getitem__, stretches))
        if self._words.changed or int.from_bytes(packed[:4], sys.byteorder) in self.byte_of:
            return packed, self.decode(np.frombuffer(packed, np.int32).tolist()) == text
        return packed, SPACE not in text

    def bytes_of(self, i: int) -> bytes:
        return self._bytes[i]

    def _piece_bytes(self, i: int) -> bytes:
        if i == self.unknown:
            return " ⁇ ".encode()
        if i in self.byte_of:
            return bytes([self.byte_of[i]])
        return b"" if i in self.special else self.pieces[i].encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces as UTF-8, the space that encoding puts first taken off."""
        data = b"".join(map(self._bytes.__getitem__, ids))
        text = data.decode(errors="replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") and ids[0] not in self.byte_of else text


@cache
def load(path: str) -> Model:
    return Model(path)


def default_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``n_ids`` and ``lossless``, which replace columns of
    those names.

    ``ids`` are what the model's library gives for the whole text, without begin and end;
    ``lossless`` tells whether they decode to the text again (U+2581 becomes a space, so a text
    that holds it does not). A null or empty text has no ids and is lossless as an empty one.
    Repeated rows each get their ids; an empty table gives an empty one. ``path`` is a file that
    every machine has. Rows are worked on alone, so nothing is shuffled.
    """
    path = path or default_path()

    def compute():
        model = load(path)

        def work(texts: list[str], _: pa.RecordBatch) -> list:
            offsets, flat, same = [0], [], []
            for value in texts:
                packed, lossless = model.checked(value)
                same.append(lossless)
                flat.append(packed)
                offsets.append(offsets[-1] + len(packed) // 4)
            values = pa.array(np.frombuffer(b"".join(flat), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            return [lists, np.diff(offsets).tolist(), same]

        return work

    columns = {"ids": T.ArrayType(T.IntegerType()), "n_ids": T.LongType(), "lossless": T.BooleanType()}
    return with_columns(docs, columns, compute, text)


def decode(docs: DataFrame, path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` decoded from ``ids`` (in place of a column of that name).

    Null or empty ids decode to an empty text, and null ids within a list are left out.
    """
    path = path or default_path()
    fields = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField(text, T.StringType())])
    names = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids))
            texts = [model.decode([i for i in x.as_py() or () if i is not None]) for x in column]
            own = [batch.column(batch.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.string())], names=[*names, text])

    return docs.mapInArrow(run, schema)
