"""Spelling variants: FM-index search schemes over a delimited vocabulary, read from both ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textassay.functions.text import count_repeats
from textassay.operators.joins import hot_keys, lookup_join
from textassay.session import materialise, sized

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_WORDS = 16_384  # words of one index
SLICE_CELLS = 1 << 20  # letters of the words searched at once


def runs(text: Column) -> Column:
    """Maximal runs of letters of a whole text, A to Z in lower case; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(RUN), 0)


def damaged(key: Column, run: Column, one_in: int = 199) -> Column:
    """``run``, without one code point where ``one_in`` divides the checksum of key and run."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (h % F.char_length(run)).cast("int")
    shorter = F.concat(F.substr(run, F.lit(1), place), F.substr(run, place + 2))
    return F.when(h % one_in == 0, shorter).otherwise(run)


def vocabulary(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 6, min_count: int = 5
) -> DataFrame:
    """``(word, n)``: words of at least ``min_chars`` code points and how often they occur, from ``min_count`` on.

    Runs are counted inside their document first, then in each task, before anything is shuffled. Rows with a
    null text have no words, a null key stands as nothing in the checksum; rows that repeat a
    key count each. Further columns are ignored.
    """
    # the outer inline keeps Catalyst from finding the runs twice
    each = docs.select(F.col(key).alias("_key"), F.inline_outer(count_repeats(runs(F.col(text)))))
    each = each.where(F.char_length("term") >= min_chars)
    counted = each.select(damaged(F.col("_key"), F.col("term")).alias("word"), "tf")
    counted = counted.where(F.char_length("word") >= min_chars).groupBy("word")
    return counted.agg(F.sum("tf").cast("long").alias("n")).where(F.col("n") >= min_count)


class Index:
    """FM-index of words, each closed by a delimiter, that reads words from their first letter on.

    The text is every word backwards; its suffixes that begin inside a word at the same letters
    are one interval of suffix ranks, which the next letter narrows. Equal suffixes go by the order
    of their words. ``_ranks`` holds the letters before the suffixes as ``letter * size + rank``: one search
    in it is both the letter's rank and the start of its suffixes.
    """

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, symbols: int) -> None:
        """``letters`` are the words' letters one after the other, numbered from 1, 0 being the delimiter."""
        self.words, self.symbols = len(lengths), symbols
        size = self.size = len(letters) + self.words
        word = np.repeat(np.arange(self.words), lengths + 1)
        begin = np.cumsum(lengths + 1) - (lengths + 1)
        place = np.arange(size) - begin[word]
        closes = place == lengths[word]
        text = np.zeros(size, np.int64)
        source = (np.cumsum(lengths) - lengths)[word] + lengths[word] - 1 - place  # backwards
        text[~closes] = letters[source[~closes]]
        order = _suffix_order(text, lengths[word] - place)
        self.before = np.where(place[order] == 0, 0, text[order - 1])
        by_letter = np.argsort(self.before, kind="stable")
        self._ranks = self.before[by_letter] * size + by_letter
        self._whole = by_letter[: self.words]  # suffixes that are whole words, and the words
        self._word = word[order[self._whole]]

    def narrow(self, low: np.ndarray, high: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one more letter."""
        at = letter * self.size
        return np.searchsorted(self._ranks, at + low), np.searchsorted(self._ranks, at + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(interval, letter)`` of every letter that goes on from each of some disjoint intervals."""
        sizes = high - low
        own = np.repeat(np.arange(len(low)), sizes)
        ranks = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[own]
        found = np.unique(own * self.symbols + self.before[ranks])
        own, letter = found // self.symbols, found % self.symbols
        return own[letter > 0], letter[letter > 0]

    def whole_words(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The word that ends in each interval, or -1."""
        at = np.searchsorted(self._whole, low)
        ends = at < np.searchsorted(self._whole, high)
        return np.where(ends, self._word[np.minimum(at, self.words - 1)], -1)


def _suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes up to the delimiter, by doubling. ``left`` letters come before it."""
    rank, step, longest = text.copy(), 1, int(left.max(initial=0)) + 1
    while step < longest:
        then = np.full(len(text), -1, np.int64)
        reach = np.flatnonzero(left >= step)
        then[reach] = rank[reach + step]
        pair = rank * (len(text) + text.max(initial=0) + 2) + then + 1
        _, rank = np.unique(pair, return_inverse=True)
        rank = rank.astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable")


def search(index: Index, queries: np.ndarray, lengths: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(query, word)`` of all words that share a query's first ``exact`` letters and are one edit away.

    ``queries`` are rows of letters, filled up behind their ``lengths``. The first part is matched letter by
    letter. From each place behind it one error is allowed: another letter, one more letter, or one
    less; the rest, up to the delimiter, is exact again. An edit inside equal letters is made at
    the last of them only, so a word is found once.
    """
    size_of, number = lengths, np.arange(len(lengths))
    low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), index.words, np.int64)
    width = queries.shape[1]
    padded = np.concatenate([queries, np.zeros((len(lengths), 2), queries.dtype)], axis=1)  # 0 is no letter
    waiting: list[tuple[np.ndarray, ...]] = []
    for j in range(width + 1):
        go = np.flatnonzero((lengths >= j) & (exact <= j))
        if len(go):
            q, lo, hi, here = number[go], low[go], high[go], padded[number[go], j]
            starts, first, which = np.unique(lo, return_index=True, return_inverse=True)
            own, letter = index.branches(starts, hi[first])
            to_low, to_high = index.narrow(starts[own], hi[first][own], letter)
            begin = np.searchsorted(own, np.arange(len(starts) + 1))
            many = (begin[1:] - begin[:-1])[which]
            of = np.repeat(np.arange(len(q)), many)
            at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + begin[which][of]
            other = letter[at] != here[of]
            of, at = of[other], at[other]
            waiting.append((q[of], np.full(len(of), j), to_low[at], to_high[at]))  # one more letter
            more = size_of[q[of]] > j
            waiting.append((q[of][more], np.full(more.sum(), j + 1), to_low[at][more], to_high[at][more]))
            less = (size_of[q] > j) & (here != padded[q, j + 1])
            waiting.append((q[less], np.full(less.sum(), j + 1), lo[less], hi[less]))
        if j == width:
            break
        on = lengths > j
        number, low, high = number[on], low[on], high[on]
        lengths, exact = lengths[on], exact[on]
        low, high = index.narrow(low, high, padded[number, j])
        alive = high > low
        number, low, high = number[alive], low[alive], high[alive]
        lengths, exact = lengths[alive], exact[alive]
    return _finish(index, padded, waiting)


def _finish(index: Index, padded: np.ndarray, waiting: list) -> tuple[np.ndarray, np.ndarray]:
    """Match what is left of the queries exactly, up to the delimiter."""
    if not waiting:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, j, low, high = (np.concatenate(parts) for parts in zip(*waiting))
    found = []
    while len(q):
        letter = padded[q, j]
        done = letter == 0
        if done.any():
            word = index.whole_words(low[done], high[done])
            found.append((q[done][word >= 0], word[word >= 0]))
        q, j, low, high, letter = q[~done], j[~done], low[~done], high[~done], letter[~done]
        low, high = index.narrow(low, high, letter)
        alive = high > low
        q, j, low, high = q[alive], j[alive] + 1, low[alive], high[alive]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return flat, np.fromiter(map(len, words), np.int64, len(words))


FOUND = "word string, n bigint, n_near bigint, best_n bigint, best string"


def _search_shard(table: pa.Table) -> pa.Table:
    """For each searched word of one shard its number of near words there and the best of them."""
    back = bool(table.column("back")[0].as_py())
    kept = table.filter(table.column("indexed"))
    asked = table.filter(table.column("asked"))
    words, sought = kept.column("word").to_pylist(), asked.column("word").to_pylist()
    n = np.asarray(kept.column("n"), dtype=np.int64)
    turned = lambda rows: [w[::-1] for w in rows] if back else rows
    (flat, lengths), (wanted, sizes) = _letters(turned(words)), _letters(turned(sought))
    alphabet = np.unique(np.concatenate([flat, wanted]))
    numbered = lambda letters: np.searchsorted(alphabet, letters) + 1
    near, best = np.zeros(len(sought), np.int64), np.full(len(sought), -1, np.int64)
    if words:
        index = Index(numbered(flat), lengths, len(alphabet) + 1)
        wanted, begin = numbered(wanted), np.cumsum(sizes) - sizes
        halves = np.where(back, sizes - sizes // 2, sizes // 2)
        by_size = np.argsort(sizes, kind="stable")
        alphabetic = np.argsort(np.array([w.encode("utf-32-be") for w in words], object), kind="stable")
        place = np.empty(len(words), np.int64)
        place[alphabetic] = np.arange(len(words))
        for part in _slices(by_size, sizes):
            width = int(sizes[part].max())
            inside = np.arange(width) < sizes[part][:, None]
            rows = np.zeros(inside.shape, np.int64)
            at = begin[part][:, None] + np.arange(width)
            rows[inside] = wanted[at[inside]]
            q, found = search(index, rows, sizes[part], halves[part])
            q = part[q]
            if back:  # a word that shares the first half as well is found from the front
                new = [not words[w].startswith(sought[i][: len(sought[i]) // 2]) for i, w in zip(q, found)]
                q, found = q[np.array(new, bool)], found[np.array(new, bool)]
            near += np.bincount(q, minlength=len(sought))
            order = np.lexsort((place[found], -n[found], q))
            first = np.unique(q[order], return_index=True)
            best[first[0]] = found[order][first[1]]
    has = best >= 0
    return pa.table(
        {
            "word": asked.column("word"),
            "n": asked.column("n"),
            "n_near": pa.array(near),
            "best_n": pa.array([int(n[b]) if h else None for b, h in zip(best, has)], pa.int64()),
            "best": pa.array([words[b] if h else None for b, h in zip(best, has)], pa.string()),
        }
    )


def _slices(order: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of ``order``, which is by size, whose padded rows stay within ``SLICE_CELLS`` letters."""
    start = 0
    while start < len(order):
        end = min(len(order), start + 4096)
        while end > start + 1 and (end - start) * sizes[order[end - 1]] > SLICE_CELLS:
            end = start + (end - start) // 2
        yield order[start:end]
        start = end


def near_words(words: DataFrame, min_chars: int = 6, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(word, n, n_near, best_n, best)`` for each row of the stored ``words (word, n)``, distinct words of ``min_chars`` on.

    Near words differ by exactly one inserted, deleted or replaced code point: they share either their first
    half or their last one. So each word goes to the shard of its first and of its last
    ``min_chars // 2`` letters; a shard indexes its words and searches them. Letters shared by more than
    ``shard_words`` words are dealt over several indexes, each of which is searched for all of them in parts.
    ``best`` is the near word of largest ``n``, the first in code-point order among equals.
    """
    ends = min_chars // 2
    total = words.count()
    sides = words.select(
        "word", "n",
        F.explode(F.array(
            F.struct(F.lit(False).alias("back"), F.substring("word", 1, ends).alias("end")),
            F.struct(F.lit(True).alias("back"), F.reverse(F.substring("word", -ends, ends)).alias("end")),
        )).alias("side"),
    ).select("word", "n", "side.back", F.concat(F.when(F.col("side.back"), "<").otherwise(">"), "side.end").alias("end"))
    counts = materialise(sides.groupBy("end").agg(F.count("*").alias("w")), "word_ends")
    hot = hot_keys(counts, "end", "w", limit=shard_words)
    if hot is None:
        sides = sides.withColumn("_salts", F.lit(1))
    else:
        sides = sides.join(sized(hot), "end", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    shards = max(1, -(-2 * total // shard_words))
    single = F.concat(
        F.when(F.col("back"), "<").otherwise(">"), F.pmod(F.xxhash64("end"), F.lit(shards)).cast("string")
    )
    own = F.pmod(F.xxhash64("word", F.lit(11)), F.col("_salts")).cast("int")
    part = lambda held, sought, indexed, asked: F.struct(
        held.alias("held"), sought.alias("sought"), indexed.alias("indexed"), asked.alias("asked")
    )
    every = F.sequence(F.lit(0), F.col("_salts") - 1)
    rows = sides.withColumn("shard", F.when(F.col("_salts") > 1, F.col("end")).otherwise(single)).withColumn("own", own)
    rows = rows.select(
        "word", "n", "back", "shard",
        F.explode(F.concat(
            F.transform(every, lambda t: part(F.col("own"), t, F.lit(True), t == F.col("own"))),
            F.transform(F.filter(every, lambda t: t != F.col("own")),
                        lambda t: part(t, F.col("own"), F.lit(False), F.lit(True))),
        )).alias("p"),
    ).select("word", "n", "back", "shard", "p.*")
    found = rows.groupBy("shard", "held", "sought").applyInArrow(_search_shard, FOUND)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), "best"))).alias("best")
    return found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.best").alias("best")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for stored ``(word, form)``: the end of the chain of forms.

    Each round doubles the steps taken, and every step multiplies the number of occurrences.
    """
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        table = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = lookup_join(now, table, "root", "word", "left")
        again = materialise(joined.select("word", F.coalesce("_next", "root").alias("root"), "_next"), "roots")
        if again.where("_next IS NOT NULL").isEmpty():
            return again.select("word", "root")
        now = again.drop("_next")


def spelling_variants(words: DataFrame, min_chars: int = 6, factor: int = 5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for a vocabulary ``(word, n)``.

    ``form`` is the near word of largest ``n`` if that is at least ``factor`` times the word's own (ties: the
    smallest in code-point order), else null; ``root`` follows forms to the last and is the word itself where
    there is none. Words that are null or shorter than ``min_chars`` take no part. An empty vocabulary gives no
    rows; rows that repeat a word are added up.
    """
    whole = words.where(F.char_length("word") >= min_chars).groupBy("word")
    stored = materialise(whole.agg(F.sum("n").cast("long").alias("n")), "vocabulary")
    found = near_words(stored, min_chars, shard_words)
    enough = F.col("best_n") >= factor * F.col("n")
    found = found.select(
        "word", F.when(enough, F.col("best")).alias("form"), "n", "n_near",
        F.when(enough, F.col("best_n")).alias("form_n"),
    )
    found = materialise(found, "word_forms")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
