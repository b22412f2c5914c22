"""Expressions over texts that hold more than one thing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A number that no text is expected to have behind an object and a comma.
_BEHIND = 7_046_029_254_386_353_087


def _places(text: Column, mark: str) -> Column:
    """Where a character stands in a text, from 1."""
    parts = F.split(text, f"[{mark}]", -1)
    lengths = F.transform(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), lambda p: F.length(p) + 1)
    return F.aggregate(lengths, F.array().cast("array<int>"), lambda seen, n: F.concat(seen, F.array(F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(0)) + n)), lambda seen: seen)


def last_json_object(text: Column) -> Column:
    """The JSON object in a text that ends last and, of those that end there, is the longest; null if there is none.

    Each closing brace, from the last one back, is held against each opening brace that can begin an object, from the
    first one on, until what lies between them is a JSON object. Braces inside strings and broken objects thus do no harm.
    """
    starts = F.filter(_places(text, "{"), lambda s: F.substr(text, s).rlike('^[{][ \\t\\r\\n]*["}]'))
    ends = F.reverse(_places(text, "}"))

    def between(s: Column, e: Column) -> Column:
        part = F.substr(text, s, e - s + 1)
        # parsing stops where the first value ends, so a number behind the object tells whether that was its last brace
        whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), part, F.lit(f",{_BEHIND}]"))), "$[1]", "bigint") == _BEHIND
        return F.when((s < e) & F.coalesce(whole, F.lit(False)), part)

    def ending(e: Column) -> Column:
        return F.aggregate(starts, F.lit(None).cast("string"), lambda found, s: F.coalesce(found, between(s, e)))

    return F.aggregate(ends, F.lit(None).cast("string"), lambda found, e: F.coalesce(found, ending(e)))
