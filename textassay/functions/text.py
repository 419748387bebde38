"""Cleaning, tokenising and n-gram functions.

Character classes are spelled with ``\\p{..}`` because Java's ``\\w`` and ``\\s``
are ASCII only. ``[\\p{L}\\p{N}_]`` is a word character and ``SPACE`` holds every
character that Unicode-aware whitespace splitting breaks on.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textassay.functions.stopwords import CLEANING, ENGLISH

SPACE = r"\s\p{Z}\x0b\x1c-\x1f\x85"
TAG_PATTERN = r"<[^\n]*?>"
PUNCT_PATTERN = rf"[^\p{{L}}\p{{N}}_{SPACE}'-]"
SPLIT_PATTERN = rf"[{SPACE}]+"
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
CAPS_PATTERN = r"^[A-Z]{2,}$"
SYMBOL_PATTERN = r"[!?#@$%&*]"

# The characters a sequence tokenizer turns into blanks.
SEQUENCE_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'


def strip_tags(c: Column) -> Column:
    """Remove ``<...>``; a tag never spans a newline and leaves no blank behind."""
    return F.regexp_replace(c, TAG_PATTERN, "")


def strip_punctuation(c: Column) -> Column:
    """Remove everything but word characters, white space, ``'`` and ``-``."""
    return F.regexp_replace(c, PUNCT_PATTERN, "")


def lower_strip(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def words(c: Column) -> Column:
    """Split on white space, without empty strings."""
    return F.filter(F.split(c, SPLIT_PATTERN), lambda w: w != "")


def squeeze_spaces(c: Column) -> Column:
    return F.array_join(words(c), " ")


def drop_words(tokens: Column, stop_words: Sequence[str] = CLEANING) -> Column:
    """Remove stop words, keeping order and repeats."""
    return F.filter(tokens, lambda w: ~w.isin(list(stop_words)))


def clean_words(c: Column, stop_words: Sequence[str] = CLEANING) -> Column:
    """Tags, punctuation, case, white space, stop words: the cleaned word array."""
    bare = strip_punctuation(strip_tags(F.coalesce(c, F.lit(""))))
    return drop_words(words(F.lower(bare)), stop_words)


def clean_text(c: Column, stop_words: Sequence[str] = CLEANING) -> Column:
    return F.array_join(clean_words(c, stop_words), " ")


def terms(c: Column, stop_words: Sequence[str] = ENGLISH) -> Column:
    """Lower-cased words of two or more word characters, stop words removed."""
    found = F.regexp_extract_all(F.lower(c), F.lit(TERM_PATTERN), 0)
    return drop_words(found, stop_words)


def ngrams(tokens: Column, low: int = 1, high: int = 3) -> Column:
    """All word n-grams of ``low`` to ``high`` words, joined by one blank."""

    def of_size(words_: Column, n: int) -> Column:
        if n == 1:
            return words_
        starts = F.slice(words_, 1, F.greatest(F.size(words_) - (n - 1), F.lit(0)))
        return F.transform(
            starts,
            lambda first, i: F.concat_ws(
                " ", first, *[F.get(words_, i + k) for k in range(1, n)]
            ),
        )

    # The one-element transform binds ``tokens`` to a variable: it is evaluated
    # once per row, not once per position.
    bound = F.transform(
        F.array(tokens), lambda w: F.concat(*[of_size(w, n) for n in range(low, high + 1)])
    )
    return bound[0]


def count_repeats(items: Column) -> Column:
    """Array of ``(term, tf)``: the distinct items of an array and how often each occurs.

    Sorts the array and measures its runs, so that counting inside one document
    needs no shuffle.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(
                ordered,
                lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i),
            ),
            lambda i: i.isNotNull(),
        )
        counted = F.transform(
            F.array(starts),
            lambda at: F.transform(
                at,
                lambda i, k: F.struct(
                    F.get(ordered, i).alias("term"),
                    (F.coalesce(F.get(at, k + 1), F.size(ordered)) - i).alias("tf"),
                ),
            ),
        )
        return counted[0]

    return F.transform(F.array(F.sort_array(items)), runs)[0]


def sequence_words(c: Column) -> Column:
    """Lower, blank out the filter characters, split on blanks."""
    blanked = F.translate(F.lower(c), SEQUENCE_FILTERS, " " * len(SEQUENCE_FILTERS))
    return F.filter(F.split(blanked, " "), lambda w: w != "")


def pad_sequence(seq: Column, maxlen: int) -> Column:
    """Cut or zero-fill at the end to exactly ``maxlen`` entries."""
    return F.slice(F.concat(seq, F.array_repeat(F.lit(0), maxlen)), 1, maxlen)


def caps_count(c: Column) -> Column:
    """Number of all-caps words longer than one character."""
    return F.size(F.filter(words(c), lambda w: w.rlike(CAPS_PATTERN)))


def word_list_count(c: Column, word_list: Sequence[str]) -> Column:
    """Number of words that are in the caller's list (case ignored)."""
    return F.size(F.filter(words(F.lower(c)), lambda w: w.isin(list(word_list))))


def symbol_count(c: Column, pattern: str = SYMBOL_PATTERN) -> Column:
    return F.regexp_count(c, F.lit(pattern))


# --- repair -------------------------------------------------------------------

# Curly quotes to straight ones, ligatures to letters.
CURLY_SINGLE, CURLY_DOUBLE = "\u2018\u2019\u201a\u201b\u02bc", "\u201c\u201d\u201e\u201f"
LIGATURES = {
    "\ufb00": "ff",
    "\ufb01": "fi",
    "\ufb02": "fl",
    "\ufb03": "ffi",
    "\ufb04": "ffl",
    "\ufb05": "\u017ft",
    "\ufb06": "st",
}
LINE_BREAKS = r"\r\n|[\r\u2028\u2029\x85]"
CONTROLS = r"[\x00-\x08\x0b\x0e-\x1f\x7f\u206a-\u206f\ufeff\ufff9-\ufffb]"
ENTITY = r"&#?[0-9A-Za-z]{1,24};"


UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)  # bytes cp1252 leaves undefined


def _repair_rare() -> Callable[[Column], Column]:
    """Arrow function for what the JVM has no expression for.

    Built inside a function so that it travels to the workers by value and they
    need no copy of this package.
    """

    # cp1252 characters back to the byte they stand for; Latin-1 ones already match
    undefined = UNDEFINED
    one_byte = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in undefined}

    def undo_mojibake(line: str) -> str:
        # re-read as UTF-8 the bytes of text decoded with a one-byte table
        while not line.isascii():
            try:
                better = line.translate(one_byte).encode("latin-1").decode("utf-8")
            except UnicodeError:
                break
            line = better
        return line

    entity = re.compile(ENTITY)

    def repair(text: str | None) -> str | None:
        if text is None:
            return None
        if "<" not in text:
            text = entity.sub(lambda m: html.unescape(m.group()), text)
        lines = [undo_mojibake(line) for line in text.split("\n")]
        return unicodedata.normalize("NFC", "\n".join(lines))

    @F.pandas_udf("string")
    def repair_batch(s: pd.Series) -> pd.Series:
        return s.map(repair)

    return repair_batch


ROUNDS = 4  # times that a text was read with the wrong table


def _undo_mojibake(line: Column) -> Column:
    """Text that was decoded with a one-byte table (Latin-1 or cp1252) read again as UTF-8, while it can be.

    A line is left alone unless all its characters stand for bytes and those bytes are valid UTF-8.
    """
    letters = {bytes([b]).decode("cp1252"): chr(b) for b in range(0x80, 0xA0) if b not in UNDEFINED}

    def once(text: Column, _: Column) -> Column:
        as_bytes = F.translate(text, "".join(letters), "".join(letters.values()))
        again = F.try_validate_utf8(F.encode(as_bytes, "ISO-8859-1").cast("string"))
        broken = text.rlike(r"[^\x00-\x7f]") & as_bytes.rlike(r"^[\x00-\xff]*$")
        return F.when(broken, F.coalesce(again, text)).otherwise(text)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), line, once)


@lru_cache(maxsize=1)
def _not_composed() -> str:
    """Class of the characters that composition (NFC) may change: marks, parts of syllables, and unstable ones.

    None is below U+0300. The class is a long chain of ranges, so it is looked at behind that one range only.
    """
    unstable = [n for n in range(0xA0, 0x110000) if unicodedata.normalize("NFC", chr(n)) != chr(n)]
    spans: list[list[int]] = []
    for n in unstable:
        if spans and n == spans[-1][1] + 1:
            spans[-1][1] = n
        else:
            spans.append([n, n])
    listed = "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in spans)
    return rf"(?=[\x{{300}}-\x{{10ffff}}])[\p{{M}}\x{{1160}}-\x{{11ff}}{listed}]"


def repair_text(c: Column) -> Column:
    """Undo mojibake, entities, curly quotes, ligatures, controls; compose (NFC).

    Mojibake is undone in the JVM, line by line. Only rows with an entity, or with a character that composition
    may change, are sent to the Python worker (the others travel as nulls).
    """
    entities = c.rlike(ENTITY) & ~c.contains("<")
    plain = F.when(
        c.rlike(r"[^\x00-\x7f]") & ~entities,
        F.array_join(F.transform(F.split(c, "\n", -1), _undo_mojibake), "\n"),
    ).otherwise(c)
    out = F.coalesce(_repair_rare()(F.when(entities | plain.rlike(_not_composed()), plain)), plain)
    out = F.regexp_replace(out, LINE_BREAKS, "\n")
    out = F.regexp_replace(out, CONTROLS, "")
    out = F.translate(
        out,
        CURLY_SINGLE + CURLY_DOUBLE,
        "'" * len(CURLY_SINGLE) + '"' * len(CURLY_DOUBLE),
    )
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return out
