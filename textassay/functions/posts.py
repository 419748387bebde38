"""JSON posts in, JSON reports out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Read as text first: a value of the wrong type then rejects one record instead
# of silently turning into null.
WIRE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("misinfo_state", T.StringType()),
        T.StructField("date", T.StringType()),
    ]
)

# State codes on the wire.
STATES = {0: "FAKE", 1: "TRUE", 2: "NOT_CHECKED"}

# 32 hexadecimal digits; the reader ignores a URN prefix, braces and hyphens
UUID_PATTERN = r"^[0-9a-fA-F]{32}$"
UUID_DRESSING = r"urn:|uuid:|^[{}]+|[{}]+$|-"


def parse_post(value: Column) -> Column:
    return F.from_json(value, WIRE_SCHEMA)


def bare_uuid(c: Column) -> Column:
    return F.regexp_replace(c, UUID_DRESSING, "")


def is_uuid(c: Column) -> Column:
    return bare_uuid(c).rlike(UUID_PATTERN)


def canonical_uuid(c: Column) -> Column:
    """Lower case with the hyphens in their places."""
    bare = F.lower(bare_uuid(c))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(bare, at, n) for at, n in cuts])


def parse_date(c: Column) -> Column:
    """ISO-8601 to timestamp; null where the text is not one."""
    return F.try_to_timestamp(c)


def state_code(c: Column) -> Column:
    """Wire text to a known code; null where it is none."""
    code = c.try_cast("int")
    return F.when(code.isin(list(STATES)), code)


def state_name(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, name in STATES.items():
        out = F.when(code == value, F.lit(name)).otherwise(out)
    return out


def state_of_name(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for value, known in STATES.items():
        out = F.when(name == known, F.lit(value)).otherwise(out)
    return out


def state_of_prediction(prediction: Column) -> Column:
    """Class 1 (misinformation) is reported as FAKE, class 0 as TRUE."""
    return F.when(prediction == 1, F.lit(0)).otherwise(F.lit(1))


def report_json(post_id: Column, code: Column) -> Column:
    return F.to_json(F.struct(post_id.alias("post_id"), code.alias("misinfo_state")))
