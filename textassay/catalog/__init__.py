"""Named queries over the driver's tables, with their ANSI SQL equivalents.

Each entry is one operator of the library applied to whole tables. An entry
without SQL is either a fitted model or something SQL has no words for.
"""

from __future__ import annotations

from textassay.catalog.base import ORACLES, QUERIES
from textassay.catalog import evaluation, features, linear, models, properties, sequences, sources, splits, streams, text  # noqa: F401,E402

__all__ = ["ORACLES", "QUERIES"]
