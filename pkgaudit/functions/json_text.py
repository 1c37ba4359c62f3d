"""JSON inside text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value.

    The parser stops after the first value. As the first of two array entries the text must end
    where that value does.
    """
    pair = F.concat(F.lit("["), text, F.lit(",0]"))
    return F.try_parse_json(text).isNotNull() & F.coalesce(F.json_array_length(pair) == 2, F.lit(False))


def extract_json(text: Column) -> Column:
    """The widest bracketed part that is JSON, else the widest braced part; null if neither is."""

    def parsed(pattern: str) -> Column:
        part = F.regexp_extract(text, pattern, 0)
        return F.when((part != "") & is_json(part), part)

    return F.coalesce(parsed(r"(?s)\[.*\]"), parsed(r"(?s)\{.*\}"))
