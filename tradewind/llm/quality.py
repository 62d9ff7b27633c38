"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.batches import unused

#: What separates words: the ASCII white space characters.
SPACE = "[\\x20\\x09-\\x0D]"
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Common words of English, French, German and Spanish, in lower case.
STOP_WORDS = (
    "the of and to in that is was for it with as on be at by this are from or an "
    "le la les de des du et un une est en que qui dans pour sur pas avec ce il "
    "der die das und ist von zu den mit sich auf für nicht ein eine dem im es auch "
    "el los las y que en un una por con del se no para su al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """Keeps a text whose ``share`` per hundred of ``of`` lies from ``low`` to ``high``.

    Both are names of measures; with ``of`` None, the measure itself lies in the range. Whole
    numbers are compared, so that no result hangs on rounding.
    """

    name: str
    share: str
    of: str | None
    low: int | None
    high: int | None

    def holds(self, measures: dict[str, Column]) -> Column:
        value = measures[self.share] * (100 if self.of else 1)
        unit = measures[self.of] if self.of else F.lit(1)
        held = F.lit(True)
        if self.low is not None:
            held = held & (value >= unit * self.low)
        if self.high is not None:
            held = held & (value <= unit * self.high)
        return held


#: Limits that a text must keep whatever the other rules say.
BASE_RULES = (
    Rule("long enough", "n_words", None, 50, None),
    Rule("few repeated phrases", "n_repeat_words", "n_words", None, 50),
)
RULES = BASE_RULES + (
    Rule("word length", "word_chars", "n_words", 200, 1500),
    Rule("few symbols", "n_symbols", "n_words", None, 25),
    Rule("function words", "n_stop_words", "n_words", 2, None),
    Rule("few repeated lines", "n_dup_lines", "n_lines", None, 50),
)


def _hashes(words: Column) -> Column:
    """The hash of every window of three words, in order."""
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) > 2, windows).otherwise(F.array().cast("array<bigint>"))


def _sorted_if_repeated(hashes: Column) -> Column:
    """The hashes in order, or none where all differ."""
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(some, F.sort_array(hashes)).otherwise(F.array().cast("array<bigint>"))


def _repeated(ordered: Column) -> Column:
    """Hashes found twice or more, each once."""
    again = F.filter(ordered, lambda h, k: (k > 0) & (h == F.get(ordered, k - 1)))
    return F.array_distinct(again)


#: Up to so many repeated hashes are looked up one by one; more are found by sorting the windows,
#: which takes no more than n log n steps on a text of any length. Both find the same.
SEARCHED = 16


def _sorted_if_many(hashes: Column, repeated: Column) -> Column:
    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    return F.when(F.size(repeated) > SEARCHED, F.sort_array(placed)).otherwise(none)


def _places(hashes: Column, repeated: Column, placed: Column) -> Column:
    """Where windows stand whose hash is repeated, in order."""

    def same(x: Column, k: Column) -> Column:
        return F.coalesce(x["h"] == F.get(placed, k)["h"], F.lit(False))

    beside = F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1))
    by_sort = F.sort_array(F.transform(beside, lambda x: x["i"]))
    by_search = F.filter(
        F.sequence(F.lit(0), F.size(hashes) - 1),
        lambda i: F.array_contains(repeated, F.get(hashes, i)),
    )
    none = F.array().cast("array<int>")
    few = F.size(repeated) <= SEARCHED
    return F.when(F.size(repeated) == 0, none).when(few, by_search).otherwise(by_sort)


def _covered(places: Column) -> Column:
    """Words in windows at these places, each word once."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        places,
        start,
        lambda a, i: F.struct(
            (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n"), (i + 3).alias("end")
        ),
        lambda a: a["n"],
    )


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, wherever the optimizer moves the result."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_stop_words",
    "n_lines",
)


def _measures(text: Column) -> Column:
    """All measures of a text, as a struct in one expression."""
    both = [w for s in STOP_WORDS for w in {s, s.capitalize()}]
    split = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    symbols = F.regexp_replace(text, f"[^{SYMBOLS}]+", "")
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))

    def repeated_words(words: Column) -> Column:
        def found(hashes: Column) -> Column:
            return _let(
                _let(_sorted_if_repeated(hashes), _repeated),
                lambda repeated: _let(
                    _sorted_if_many(hashes, repeated),
                    lambda placed: _covered(_places(hashes, repeated, placed)),
                ),
            )

        return _let(_hashes(words), found)

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(both))).cast("long").alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    n_symbols = F.length(symbols).cast("long")
    return _let(
        F.struct(_let(split, of_words).alias("w"), _let(worded, of_lines).alias("l"), n_symbols.alias("s")),
        lambda m: F.struct(
            *[m["w"][x].alias(x) for x in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")],
            *[m["l"][x].alias(x) for x in ("n_dup_lines", "n_lines")],
            m["s"].alias("n_symbols"),
        ),
    )


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept`` (columns of those names go).

    All expressions are Spark's own; there is no shuffle, and no row meets another. A null or
    empty text has no words and is rejected by the length rule; repeated rows get equal results;
    an empty table gives an empty one; a very long text is one row's work, sorted within the row.
    """
    made = (*MEASURES, "base_failed", "kept")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    m = unused(docs, "_m")
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return (
        docs.select(*own, _measures(value).alias(m))
        .select(*own, f"{m}.*", F.col(m))
        .withColumns(
            {
                "base_failed": ~_all_hold(BASE_RULES, F.col(m)),
                "kept": _all_hold(BASE_RULES + rules, F.col(m)),
            }
        )
        .drop(m)
    )


def _all_hold(rules: tuple[Rule, ...], measures: Column) -> Column:
    held = F.lit(True)
    for rule in rules:
        held = held & rule.holds({m: measures[m] for m in MEASURES})
    return held


def is_kept(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether the base rules and ``rules`` keep a text, as one expression."""
    measured = _measures(F.coalesce(text, F.lit("")))
    return _let(measured, lambda m: _all_hold(BASE_RULES + rules, m))
