"""BPE by a backtracking encoder, and decoding by an offset table."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textassay.llm.components import slices
from textassay.llm.packing import byte_letters

CACHED_UNITS = 200_000  # units whose ids a Python worker remembers
CACHED_PAIRS = 400_000


class KnownWords(dict):
    """Ids of single words, filled as they are asked for."""

    def __init__(self, bpe: BacktrackingBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        octets = word.encode()
        ids = self.bpe.word(octets[:-1].decode("latin-1") + self.bpe.last[octets[-1]])
        found = np.array(ids, "<i4").tobytes()
        if len(word) < 64:
            self[word] = found
        return found


class BacktrackingBpe(dict):
    """A byte-level BPE vocabulary with word ends, read from a tokenizers file.

    A word is a string of symbols, one for each byte, the last one with the word
    end. From each place the encoder takes the longest token that an Aho-Corasick
    automaton found there, and goes back to shorter tokens, or to the token
    before, when two neighbours are not compatible: when merging in rank
    order would have joined or split them differently. A place that led nowhere is
    not tried again, so the work is linear in the word.
    """

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = spec["normalizer"]["normalizers"]
        if model["end_of_word_suffix"] is None or [s["type"] for s in steps] != [
            "NFC", "Replace", "Lowercase",
        ]:
            raise ValueError("a vocabulary with word ends, NFC and lower case is expected")
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special) or r"(?!)")
        pattern = next(
            s["pattern"]["Regex"] for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"
        )
        self.words = regex.compile(pattern)
        letters = byte_letters()
        self.last = {b: chr(512 + b) for b in range(256)}
        symbols = {c: chr(b) for c, b in letters.items()}

        # spelling of every token that merges can make, and the two parts it is made of
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        spelling: dict[int, str] = {}
        for letter, symbol in symbols.items():
            for token, text in ((letter, symbol), (letter + suffix, self.last[ord(symbol)])):
                i = vocab[token]
                spelling[i], self.parts[i], self.rank[i] = text, (i, i), -1
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right] = made
            if made not in self.rank:
                spelling[made], self.parts[made], self.rank[made] = (
                    spelling[left] + spelling[right], (left, right), rank,
                )
        self.spelling = spelling
        by_text = {text: i for i, text in spelling.items()}
        self.shorter = {
            i: next((by_text[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in by_text), -1)
            for i, text in spelling.items()
        }
        self.size = {i: len(text) for i, text in spelling.items()}
        self.automaton = ahocorasick.Automaton()
        for i, text in spelling.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known = KnownWords(self)

        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.texts = OffsetTable([names.get(i, "") for i in range(max(names) + 1)])

    def fits(self, left: int, right: int) -> bool:
        """Whether merging in rank order keeps ``left`` and ``right`` as neighbours.

        Undoes the later merge of the two again and again. If at some time the
        parts at the border have a merge of their own which comes before all that
        has been undone, it would have been made instead.
        """
        known = self.compatible.get((left, right))
        if known is not None:
            return known
        a, b = left, right
        before = len(self.rank) + 1  # a border merge counts only below this rank
        answer = True
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and self.rank[joined] < before:
                answer = False
                break
            rank_a, rank_b = self.rank[a], self.rank[b]
            if rank_a < 0 and rank_b < 0:
                break
            if rank_a > rank_b or (rank_a == rank_b and a == b and rank_b < 0):
                a, before = self.parts[a][1], rank_a
            else:
                # of equal ranks the left one is merged first, so a border merge of that rank counts
                b, before = self.parts[b][0], rank_b + 1
        if len(self.compatible) > CACHED_PAIRS:
            self.compatible.clear()
        self.compatible[left, right] = answer
        return answer

    def word(self, symbols: str) -> list[int]:
        """Ids of one word, given as symbols."""
        longest: dict[int, int] = {}
        for end, token in self.automaton.iter(symbols):
            longest[end + 1 - self.size[token]] = token  # a longer one ends later
        stop, place, token = len(symbols), 0, longest[0]
        out: list[int] = []
        dead: set[int] = set()
        while place < stop:
            while token >= 0:
                end = place + self.size[token]
                if end not in dead and (not out or self.fits(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                place = end
                token = longest.get(place, -1)
            else:
                dead.add(place)
                back = out.pop()
                place -= self.size[back]
                token = self.shorter[back]
        return out

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case by the character, without a final form
                text = "".join(c.lower() for c in text)
        return b"".join(map(self.known.__getitem__, self.words.findall(text.lower())))

    def __missing__(self, unit: str) -> bytes:
        if any(s in unit for s in self.special):
            found = b"".join(
                np.array(self.special[s], "<i4").tobytes() if s in self.special else self.plain(s)
                for s in self.specials.split(unit)
                if s
            )
        else:
            found = self.plain(unit)
        if len(unit) < 64:
            self[unit] = found
        return found

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text; words never reach over a space."""
        if len(self) > CACHED_UNITS:
            self.clear()
        if len(self.known) > CACHED_UNITS:
            self.known.clear()
        return b"".join(map(self.__getitem__, text.split(" ")))


class OffsetTable:
    """All token texts one after the other, and where each begins."""

    def __init__(self, texts: list[str]):
        octets = [t.encode() + b" " for t in texts]
        self.data = np.frombuffer(b"".join(octets), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(o) for o in octets])])

    def join(self, ids: np.ndarray) -> bytes:
        """Token texts joined by a space."""
        if not len(ids):
            return b""
        starts = self.starts[ids]
        sizes = self.starts[ids + 1] - starts
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)
        return self.data[at[:-1]].tobytes()


@lru_cache(maxsize=2)
def load_bpe(path: str) -> BacktrackingBpe:
    return BacktrackingBpe(path)


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>)`` for each row; null and empty texts have no ids.

    Special tokens written in a text are special ids, as in the tokenizers library.
    Repeated rows are repeated, an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(tokenizer)
        for batch in slices(batches):
            found = [bpe.ids(value.as_py() or "") for value in batch.column(1)]
            sizes = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
            values = np.frombuffer(b"".join(found), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in column ``name``.

    The vocabulary has no decoder of its own: token texts are joined by a space,
    special tokens among them. No ids, or null, give an empty text. A column ``name``
    that is there already is replaced.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    rest = encoded.drop(name)
    place = rest.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load_bpe(tokenizer).texts
        for batch in slices(batches):
            lists = batch.column(place)
            texts = [table.join(np.asarray(row.values)) if row.is_valid else b"" for row in lists]
            column = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, column], names=[*batch.schema.names, name]
            )

    schema = StructType([*rest.schema.fields, StructField(name, StringType())])
    return rest.mapInArrow(run, schema)
