"""Language identification by cross-parsing with suffix automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textassay.llm.components import slices

SAMPLE_BYTES = 48_000  # labelled text per language that the automata are built from
DOC_CHARS = 2_000  # of one labelled document, from a place that its key decides, so that none fills the sample
LANE = 512  # symbols that one lane parses; a longer text takes several lanes
UNKNOWN = "und"
_SPACE = 32


def _codes() -> np.ndarray:
    """Byte to symbol: lower-case letters and bytes of longer characters; all else is a space."""
    table = np.full(256, _SPACE, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_CODES = _codes()


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(symbols, row starts)``: letters in lower case, each other run one space."""
    lower = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_binary())
    sizes = pc.fill_null(pc.binary_length(lower), 0).to_numpy(zero_copy_only=False)
    data = np.frombuffer(b"".join(x.as_py() for x in lower), np.uint8)
    codes = _CODES[data]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    space = codes == _SPACE
    keep = ~space
    keep[1:] |= ~space[:-1]
    first = starts[:-1][sizes > 0]
    keep[first] = ~space[first]  # no space at the start of a text
    kept = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], kept[starts]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``text``."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in edges[at]:
            edges[at][symbol] = new
            at = link[at]
        if at >= 0:
            target = edges[at][symbol]
            if length[target] == length[at] + 1:
                link[new] = target
            else:
                twin = len(edges)
                edges.append(dict(edges[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and edges[at].get(symbol) == target:
                    edges[at][symbol] = twin
                    at = link[at]
                link[target] = link[new] = twin
        last = new
    return edges


class CrossParser:
    """Counts the phrases of texts against each language's sample.

    A phrase is the longest match of the text ahead in the sample; a symbol that the
    sample lacks is a phrase of its own. The automata are completed: where a match
    can not go on, the step leads to where the next phrase's first symbol leads,
    and costs a phrase. Many lanes of text then take one step at a time together.
    """

    def __init__(self, samples: tuple[tuple[str, bytes], ...]):
        self.langs = [lang for lang, _ in samples]
        self.weight = np.array([np.log2(max(2, len(text))) for _, text in samples])
        used = sorted({b for _, text in samples for b in text})
        self.symbol = np.full(256, len(used), np.int32)  # the last one: in no sample
        self.symbol[used] = np.arange(len(used))
        self.width = len(used) + 2  # and one that ends a lane: it stays and costs nothing
        self.tables = [self._complete(suffix_automaton(text)) for _, text in samples]

    def _complete(self, edges: list[dict[int, int]]) -> np.ndarray:
        """``4 * (next state * width) + phrases`` for each state and symbol."""
        known = np.full((len(edges), self.width), -1, np.int32)
        rows, columns, targets = [], [], []
        for state, out in enumerate(edges):
            rows += [state] * len(out)
            columns += out.keys()
            targets += out.values()
        known[rows, self.symbol[columns]] = targets
        root = known[0].copy()
        start = np.where(root >= 0, root, 0)
        cost = np.where(root >= 0, 1, 2)  # ends a phrase; a symbol unseen is one more
        known *= 4 * self.width
        table = np.where(known >= 0, known, (4 * self.width * start + cost).astype(np.int32))
        table[0] = np.where(root >= 0, 4 * self.width * root, 1)
        table[:, -1] = 4 * self.width * np.arange(len(edges))
        return table.ravel()

    def phrases(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Phrase counts, one row per text and one column per language."""
        sizes = np.diff(starts)
        lanes = -(-sizes // LANE)
        owner = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = starts[owner] + nth * LANE
        length = np.minimum(LANE, starts[owner + 1] - begin)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        out = np.zeros((len(sizes), len(self.langs)))
        if not len(owner):
            return out
        mapped = self.symbol[codes]
        active = np.searchsorted(-length, -np.arange(length[0]), side="left")
        for column, table in enumerate(self.tables):
            state = np.zeros(len(owner), np.int32)
            count = np.zeros(len(owner), np.int32)
            for step, n in enumerate(active.tolist()):
                found = table[state[:n] + mapped[begin[:n] + step]]
                count[:n] += found & 3
                state[:n] = found >> 2
            out[:, column] = np.bincount(owner, count + (state > 0), len(sizes))
        return out


_held: dict[tuple, CrossParser] = {}


def _parser(samples: tuple[tuple[str, bytes], ...]) -> CrossParser:
    """The parser of these samples; a worker holds one, and lets go of it before it makes another."""
    if samples not in _held:
        _held.clear()
        _held[samples] = CrossParser(samples)
    return _held[samples]


def sample_languages(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    sample_bytes: int = SAMPLE_BYTES,
) -> tuple[tuple[str, bytes], ...]:
    """For each label the symbols of a bounded sample of its texts.

    Rows are drawn by the hash of the key, at a rate that gives each language
    about twice ``sample_bytes``; the driver cuts them there. Of a longer text ``DOC_CHARS`` characters are drawn
    that begin at any place, chosen by another hash of the key; equal pieces count once. Rows
    without a text or a label, and labels without any letter in their texts, do not count. Repeated rows
    are drawn together and count once. An empty table gives no samples.
    """
    name = F.col(key).cast("string")
    places = F.greatest(F.char_length(text) - (DOC_CHARS - 1), F.lit(1))
    begin = F.pmod(F.xxhash64(name, F.lit("place")), places).cast("int") + 1
    part = F.substr(F.col(text), begin, F.lit(DOC_CHARS))
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), part.alias("part"), F.xxhash64(name).alias("h")
    )
    totals = rows.groupBy("lang").agg(F.sum(F.octet_length("part")).alias("octets")).collect()
    rate: Column = F.lit(0.0)
    for row in totals:
        share = min(1.0, (2 * sample_bytes + 4 * DOC_CHARS) / max(1, row["octets"]))
        rate = F.when(F.col("lang") == row["lang"], F.lit(share)).otherwise(rate)
    drawn = rows.where(F.pmod("h", F.lit(1 << 20)) < rate * (1 << 20)).collect()
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in drawn:
        texts.setdefault(row["lang"], []).append((row["h"], row["part"]))
    out = []
    for name in sorted(texts):
        pieces = dict.fromkeys(t for _, t in sorted(texts[name]))
        codes, _ = symbols(pa.array(list(pieces)))
        if np.any(codes != _SPACE):
            out.append((name, codes[:sample_bytes].tobytes()))
    return tuple(out)


def identify(
    docs: DataFrame,
    samples: tuple[tuple[str, bytes], ...],
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``phrase_bits``.

    A text's phrases, times the bits it takes to point into a language's sample, over its length
    are ``phrase_bits``; the language with the fewest wins, the first by name if several do.
    ``score`` is one less the winner's share of the second language's bits: 0 for a
    tie, near 1 where the winner parses the text far better. A text that is
    null or has no letter, and any text when nothing was learned, is ``und`` with score 0.
    Only ``text`` is looked at. Columns of these names that are there already are
    replaced. Long texts are parsed whole, in lanes of ``LANE`` symbols.
    """
    added = ["lang_pred", "score", "phrase_bits"]
    rest = docs.drop(*added)
    place = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples)
        for batch in slices(batches, 512):
            texts = batch.column(place)
            codes, starts = symbols(texts)
            bits = parser.phrases(codes, starts) * parser.weight
            bits /= np.maximum(1, np.diff(starts))[:, None]
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)
            usable = np.asarray(letters) & (len(parser.langs) > 0)
            best = bits.argmin(axis=1) if parser.langs else np.zeros(len(bits), int)
            ranked = np.sort(bits, axis=1)
            least = ranked[:, 0] if parser.langs else np.zeros(len(bits))
            second = ranked[:, 1] if len(parser.langs) > 1 else least * 2
            score = np.where(usable & (second > 0), 1 - least / np.where(second > 0, second, 1), 0.0)
            names = [parser.langs[i] if ok else UNKNOWN for i, ok in zip(best, usable)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names), pa.array(score), pa.array(least)],
                names=[*batch.schema.names, *added],
            )

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    kinds = [StringType(), DoubleType(), DoubleType()]
    schema = StructType([*rest.schema.fields, *map(StructField, added, kinds)])
    return rest.mapInArrow(run, schema)
