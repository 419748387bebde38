"""Order MinHash document fingerprints, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textassay.operators.ordered import ordered_index
from textassay.session import materialise

SKETCHES = 32
PICKED = 2  # k-mers of one sketch; their order is what makes the sketch sensitive to moves
WORDS = 3  # words of one k-mer

_UNSPACED = r"฀-๿぀-ヿ㐀-䶿一-鿿"
#: A token: one character of a script without spaces, or up to 64 others.
TOKEN = rf"[{_UNSPACED}]|[^\s{_UNSPACED}]{{1,64}}"
_UNEVEN = rf"[{_UNSPACED}]|\S{{65}}"  # only such texts need that pattern; others are split at white space
EXPECTED = 12  # ring members looked at first after each sketch's turn
_PLACE_BITS = 31  # of a packed long; the hash has the 33 bits above
_PLACE = (1 << _PLACE_BITS) - 1
_STEP = (1 << 33) // SKETCHES


def _packed(hashed: Column, place: Column) -> Column:
    """The upper bits of a hash with a place below, so that sorting sorts by hash."""
    return hashed.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.cast("long"))


def add_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the Order MinHash fingerprint of column ``text`` as ``name``.

    The k-mers of a text are runs of ``WORDS`` tokens (a shorter text is one k-mer). Each
    is numbered among its equals, and (k-mer, number) is hashed onto a ring. A sketch
    looks at the ring from a turn of its own: that is a permutation of the k-mers, and the
    sketch takes the ``PICKED`` least, puts them into text order and hashes the tuple.
    A fingerprint is the sketches in order, each as eight hexadecimal digits.

    Null, empty and blank texts give an empty fingerprint. The arrays are linear in the text.
    """
    drop = [f"_omh_{i}" for i in range(9)]
    tokens, kmers, runs, ring, near, marked, ahead, sorted_, full = drop
    full_text = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    words = (
        F.when(full_text == "", F.array().cast("array<string>"))
        .when(full_text.rlike(_UNEVEN), F.regexp_extract_all(full_text, F.lit(TOKEN), F.lit(0)))
        .otherwise(F.split(full_text, r"\s+"))
    )
    out = docs.withColumn(tokens, words)
    count = F.greatest(F.size(tokens) - (WORDS - 1), F.least(F.size(tokens), F.lit(1)))
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    # equal k-mers side by side, in text order
    out = out.withColumn(
        kmers,
        F.sort_array(
            F.transform(
                places,
                lambda p: _packed(
                    F.xxhash64(*[F.get(F.col(tokens), p - 1 + j) for j in range(WORDS)]), p
                ),
            )
        ),
    )
    # where a run of equal k-mers begins
    out = out.withColumn(
        runs,
        F.filter(
            places,
            lambda p: (p == 1)
            | (
                F.shiftright(F.get(F.col(kmers), p - 1), _PLACE_BITS)
                != F.shiftright(F.get(F.col(kmers), p - 2), _PLACE_BITS)
            ),
        ),
    )
    # (k-mer, number) on the ring: first members of all runs, then the rest of the longer runs
    def on_ring(packed: Column, number: Column) -> Column:
        return _packed(
            F.xxhash64(F.shiftright(packed, _PLACE_BITS), number), packed.bitwiseAND(F.lit(_PLACE))
        )

    firsts = F.transform(F.col(runs), lambda p: on_ring(F.get(F.col(kmers), p - 1), F.lit(0)))

    def begin(q: Column) -> Column:
        return F.get(F.col(runs), q - 1)

    def stop(q: Column) -> Column:
        return F.coalesce(F.get(F.col(runs), q), count + 1)

    longer = F.filter(F.sequence(F.lit(1), F.size(runs)), lambda q: stop(q) - begin(q) > 1)
    others = F.flatten(
        F.transform(
            longer,
            lambda q: F.transform(
                F.sequence(F.lit(1), stop(q) - begin(q) - 1),
                lambda i: on_ring(F.get(F.col(kmers), begin(q) + i - 1), i),
            ),
        )
    )
    out = out.withColumn(ring, F.when(F.size(runs) == count, firsts).otherwise(F.concat(firsts, others)))
    # Of a long text only members shortly after a turn are sorted, unless a turn has too few of them.
    sector = _STEP << _PLACE_BITS
    share = F.lit(float(SKETCHES * EXPECTED)) / F.greatest(F.size(ring), F.lit(1))
    reach = F.when(share >= 1, F.lit(sector)).otherwise(F.floor(share * float(sector)))
    close = F.filter(F.col(ring), lambda v: v.bitwiseAND(F.lit(sector - 1)) < F.col(ahead))
    out = out.withColumn(ahead, reach.cast("long"))
    out = out.withColumn(near, F.sort_array(F.when(F.col(ahead) < sector, close).otherwise(F.col(ring))))
    turns = [(_STEP * j - (1 << 32)) << _PLACE_BITS for j in range(SKETCHES)]
    marks = F.array(*[F.lit(t) for t in turns])
    # how many members lie before each turn: a mark for each turn is sorted in
    def with_places(rows: DataFrame, again: Column | None) -> DataFrame:
        sorted_in, old = F.sort_array(F.concat(F.col(near), marks)), F.col(marked)
        rows = rows.withColumn(sorted_, sorted_in if again is None else F.when(again, sorted_in))
        found = F.array(
            *[F.array_position(F.col(sorted_), F.lit(t)).cast("int") - 1 - j for j, t in enumerate(turns)]
        )
        return rows.withColumn(marked, found if again is None else F.when(again, found).otherwise(old))

    out = with_places(out, None)
    after = F.concat(F.slice(F.col(marked), 2, SKETCHES), F.array(F.size(near)))
    enough = F.forall(F.zip_with(after, F.col(marked), lambda b, a: b - a), lambda d: d >= PICKED)
    out = out.withColumn(full, (F.col(ahead) < sector) & ~enough)
    out = out.withColumn(near, F.when(F.col(full), F.sort_array(ring)).otherwise(F.col(near)))
    out = with_places(out, F.col(full))
    total = F.greatest(F.size(near), F.lit(1))

    def sketch(before: Column) -> Column:
        found = F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.lit(PICKED - 1)),
                lambda i: F.struct(
                    F.get(F.col(near), F.pmod(before + i, total)).bitwiseAND(F.lit(_PLACE)).alias("place"),
                    F.shiftright(F.get(F.col(near), F.pmod(before + i, total)), _PLACE_BITS).alias("kmer"),
                ),
            )
        )
        tuple_hash = F.xxhash64(F.transform(found, lambda f: f["kmer"]))
        return F.lpad(F.lower(F.hex(tuple_hash.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")

    sketches = F.array_join(F.transform(F.col(marked), sketch), "")
    return out.withColumn(name, F.when(F.size(ring) > 0, sketches).otherwise(F.lit(""))).drop(*drop)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal sketches; two empty fingerprints are alike, one is like no other."""
    places = F.sequence(F.lit(0), F.lit(SKETCHES - 1))
    equal = F.filter(places, lambda j: a.substr(8 * j + 1, F.lit(8)) == b.substr(8 * j + 1, F.lit(8)))
    return (
        F.when(F.length(a) + F.length(b) == 0, 1.0)
        .when((F.length(a) == 0) | (F.length(b) == 0), 0.0)
        .otherwise(F.size(equal) / F.lit(float(SKETCHES)))
    )


def fingerprint(
    docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "fingerprint"
) -> DataFrame:
    """``(key, name)`` for each row. Only ``key`` and ``text`` are read."""
    return add_fingerprint(docs.select(key, F.col(text).alias("_text")), "_text", name).drop("_text")


_ID = ["_null", "_k", "_h"]  # a row's key, and its text where rows share a key


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of ``docs`` (``key``, ``text``) beside the next one by falling key.

    Adds ``_head``, the part of the next text that replaces the last third of
    this one, and the columns that identify this row and (``_next_*``) the next. After the last row comes
    the first; a single row is its own next. Rows with a null key come last and
    rows with equal keys are taken by their text; rows that repeat key and text share a
    place. Null texts are empty.

    Places come from a range sort of identities alone. Of the texts each travels once, and
    only the needed part of a next text a second time.
    """
    rows = docs.select(
        F.coalesce(F.col(text), F.lit("")).alias(text),
        F.col(key).isNull().alias("_null"),
        F.coalesce(F.col(key), F.lit(0)).alias("_k"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_h"),
    )
    ids = materialise(
        rows.groupBy(*_ID).agg(F.max(F.char_length(text)).alias("n"), F.count("*").alias("rows")), "ids"
    )
    order = [F.col("_null"), F.col("_k").desc(), F.col("_h")]
    placed = materialise(ordered_index(ids, order, "place"), "places")
    counts = placed.agg(F.count("*").alias("n"), F.max("rows").alias("most")).first()
    total = max(1, counts["n"])
    before = placed.select(
        F.pmod(F.col("place") + 1, F.lit(total)).alias("place"),
        *[F.col(c).alias(f"_prev{c}") for c in _ID],
        F.floor(F.col("n") / 3).cast("int").alias("_need"),
    )
    needs = materialise(placed.select(*_ID, "place").join(before, "place").drop("place"), "needs")
    heads = rows.join(needs, _ID).select(
        *[F.col(f"_prev{c}").alias(c) for c in _ID],
        *[F.col(c).alias(f"_next{c}") for c in _ID],
        F.col(text).substr(F.lit(1), F.col("_need")).alias("_head"),
    )
    if (counts["most"] or 0) > 1:
        heads = heads.dropDuplicates(_ID)
    # both joins read the same exchange of the rows, so it has the same columns in both
    return rows.join(heads, _ID).withColumn(key, F.when(~F.col("_null"), F.col("_k")))


def edit_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How alike each text's fingerprint is to its edited text's.

    ``(key, n_chars, edited, fingerprint, edited_fingerprint, near_edited)`` and the row's
    identity; store them and see :func:`beside_next`. The edited
    text has its last ``floor(n_chars / 3)`` characters replaced by as many first characters of
    the next text by falling key, or all of them if it has fewer, see :func:`with_next`.
    """
    n = F.char_length(text)
    rows = with_next(docs, key, text).withColumn("n_chars", n.cast("long"))
    keep = (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col(text).substr(F.lit(1), keep), "_head")).drop("_head")
    rows = add_fingerprint(rows, text, "fingerprint").drop(text)
    rows = add_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))


def beside_next(found: DataFrame) -> DataFrame:
    """Adds ``near_next`` to stored rows of :func:`edit_likeness`."""
    nexts = found.select(
        *[F.col(c).alias(f"_next{c}") for c in _ID], F.col("fingerprint").alias("_next_print")
    ).dropDuplicates([f"_next{c}" for c in _ID])
    joined = found.join(nexts, [f"_next{c}" for c in _ID])
    near = likeness(F.col("fingerprint"), F.col("_next_print")).alias("near_next")
    own = [c for c in found.columns if not c.startswith("_")]
    return joined.select(*own, near)
