"""Chat formatting by prefix-target expansion, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textassay.session import materialise, sized

#: The template. Neither ``#`` nor ``<`` is left in an escaped text.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Each character that could start a control string, and the code that stands for it.
CODES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
ROLE_CODES = [*CODES, (":", "\\c")]
TRAINED = "assistant"
LONG = 1_000  # turns that are gathered in one row at most
SLICE = 64  # turns of a slice of a longer conversation


def escape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in codes:  # the backslash first
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    """The inverse of :func:`escape`: a backslash always begins a code, so codes can not be misread."""
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def expand(
    turns: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per training example.

    ``(key, example, n_turns, formatted, loss_start, loss_chars)``: each assistant turn
    becomes an example of its own, all turns before it being the context, and only its
    reply, without the marks around it, is trainable. ``loss_start`` and ``loss_chars`` are code
    points of ``formatted``. A conversation that does not end with an assistant turn gives one
    more row, with nothing trainable, so that every turn is in the output.

    Turns are sorted by number (null first), then by role and text, which settles ties;
    repeated rows are turns of their own. Null roles and texts are empty, and an
    empty reply is an example with an empty loss. Rows with a null key are one
    conversation. An empty table gives no examples; columns of other names are not read.

    A conversation of up to ``LONG`` turns is gathered in one row. A longer one never is: its turns are numbered over
    ranges and gathered in slices of ``SLICE`` turns, and each slice makes its own examples behind the text of the
    slices before it, in a task of its own. The examples are the same.
    """
    each = turns.select(
        F.col(key).alias("_key"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    long = each.groupBy("_key").agg(F.count("*").alias("n_turns")).where(F.col("n_turns") > LONG)
    long = materialise(long.withColumnRenamed("_key", "_long"), "long_conversations")
    if long.isEmpty():
        return _examples(_whole(each), key)
    same = F.col("_key").eqNullSafe(F.col("_long"))
    short = each.join(sized(long), same, "left_anti")
    sliced = _slices(each.join(sized(long), same).drop("_long"))
    return _examples(_whole(short), key).unionByName(_examples(sliced, key))


def _formatted(turns: Column) -> Column:
    return F.transform(
        turns,
        lambda t: F.concat(
            F.lit(OPEN), escape(t["role"], ROLE_CODES), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE)
        ),
    )


def _whole(each: DataFrame) -> DataFrame:
    """Conversations as one slice each, with nothing before it."""
    gathered = each.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))
    return gathered.select(
        "_key", F.size("_turns").alias("n_turns"), F.lit(0).alias("_first"), F.lit("").alias("_head"), "_turns"
    )


def _numbered(each: DataFrame) -> DataFrame:
    """``each`` with the place ``_at`` of every turn in its conversation, from 0, whatever the length of one.

    Ranges are cut by the beginning of a text, which sorts as the text does, so that no whole text is sampled.
    """
    ranged = each.repartitionByRange("_key", "turn", "role", F.substring("text", 1, 32))
    ranged = ranged.sortWithinPartitions("_key", "turn", "role", "text")
    stored = materialise(ranged.withColumn("_row", F.monotonically_increasing_id()), "numbered_turns")
    stored = stored.withColumn("_part", F.shiftright("_row", 33))
    parts = stored.groupBy("_key", "_part").agg(F.min("_row").alias("_start"), F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col("_key").alias("_of"), F.col("_part").alias("_in"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_start")).alias("_offset"),
    )
    offsets = sized(materialise(offsets, "turn_offsets"))
    here = F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in"))
    return stored.join(offsets, here).select(*each.columns, (F.col("_row") + F.col("_offset")).alias("_at"))


def _slices(each: DataFrame) -> DataFrame:
    """Slices of the conversations in ``each (_key, turn, role, text, n_turns)`` behind the text before them."""
    part = F.floor(F.col("_at") / F.lit(SLICE)).cast("int")
    slices = _numbered(each).groupBy("_key", "n_turns", part.alias("_slice")).agg(
        F.sort_array(F.collect_list(F.struct("_at", "turn", "role", "text"))).alias("_turns")
    )
    slices = materialise(slices, "turn_slices")
    last = F.floor((F.col("n_turns") - 1) / F.lit(SLICE)).cast("int")
    texts = slices.where(F.col("_slice") < last).select(
        F.col("_key").alias("_of"), "_slice", F.array_join(_formatted(F.col("_turns")), "").alias("_text"),
        F.explode(F.sequence(F.col("_slice") + 1, last)).alias("_to"),
    )
    heads = texts.groupBy("_of", "_to").agg(F.sort_array(F.collect_list(F.struct("_slice", "_text"))).alias("_texts"))
    heads = heads.select("_of", "_to", F.array_join("_texts._text", "").alias("_head")).hint("merge")
    behind = F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_to"))
    turns = F.transform("_turns", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text")))
    return slices.join(heads, behind, "left").select(
        "_key", F.col("n_turns").cast("int").alias("n_turns"), (F.col("_slice") * SLICE).alias("_first"),
        F.coalesce("_head", F.lit("")).alias("_head"), turns.alias("_turns"),
    )


def _examples(slices: DataFrame, key: str) -> DataFrame:
    numbers = F.sequence(F.lit(1), F.size("_turns"))
    is_trained = F.col("_turns")[F.col("_at") - 1]["role"] == TRAINED
    example = F.col("_first") + F.col("_at")
    rows = (
        slices.withColumn("_parts", _formatted(F.col("_turns")))
        .select("_key", "n_turns", "_first", "_head", "_turns", "_parts", F.explode(numbers).alias("_at"))
        .where(is_trained | (example == F.col("n_turns")))
        .withColumn("_reply", F.when(is_trained, F.char_length(escape(F.col("_turns")[F.col("_at") - 1]["text"]))))
        .withColumn("formatted", F.concat("_head", F.array_join(F.slice("_parts", F.lit(1), F.col("_at")), "")))
    )
    return rows.select(
        F.col("_key").alias(key),
        example.cast("long").alias("example"),
        F.col("n_turns").cast("long").alias("n_turns"),
        "formatted",
        (F.char_length("formatted") - len(CLOSE) - F.coalesce("_reply", F.lit(0))).cast("long").alias("loss_start"),
        F.coalesce("_reply", F.lit(0)).cast("long").alias("loss_chars"),
    )


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """What is under the loss mask of an example, unescaped."""
    return unescape(formatted.substr((start + 1).cast("int"), chars.cast("int")))


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted conversation or prefix."""
    parts = F.split(formatted, r"\Q" + CLOSE + r"\E", -1)
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def read(part: Column) -> Column:
        body = F.substring(part, len(OPEN) + 1, 2**31 - 1)
        role = F.substring_index(body, MIDDLE, 1)
        rest = body.substr(F.char_length(role) + len(MIDDLE) + 1, F.char_length(body))
        return F.struct(unescape(role, ROLE_CODES).alias("role"), unescape(rest).alias("text"))

    return F.transform(whole, read)
