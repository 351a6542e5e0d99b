"""Small repairs and readings of texts and values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Typographic characters and their plain forms; others beyond ASCII become "?".
PLAIN = {"–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", "×": "x", "°": " deg", " ": " ", "½": "1/2", "¼": "1/4", "¾": "3/4"}
#: A call that leaked into a text, its arguments, a fenced object, leftover bars.
CALL = r'(?is)<invoke\s+name="([^"]+)"\s*>(.*?)</invoke>'
ARGUMENT = r'(?is)<parameter\s+name="([^"]+)"\s*>(.*?)</parameter>'
FENCED = r"(?s)```(?:json)?\s*\{.*?\}\s*```"
BARS = r"<[|｜][^>]*[|｜]>"


def ascii_folded(text: Column) -> Column:
    out = text
    for ch, plain in PLAIN.items():
        out = F.replace(out, F.lit(ch), F.lit(plain))
    return F.regexp_replace(out, r"[^\x00-\x7F]", "?")


def is_letter_label(label: Column) -> Column:
    """Lettered grid lines begin with a letter; others are numbered."""
    return F.trim(label).rlike(r"^\p{L}")


def without_calls(text: Column) -> Column:
    """A text without tool calls, fenced objects and marker bars that leaked into it."""
    out = F.coalesce(text, F.lit(""))
    for p in (CALL, BARS, FENCED):
        out = F.regexp_replace(out, p, "")
    return F.trim(out)


def leaked_calls(text: Column) -> Column:
    """(name, arguments) of the calls in a text, in order."""
    bodies = F.regexp_extract_all(text, F.lit(CALL), F.lit(0))
    names = lambda b: F.regexp_extract_all(b, F.lit(ARGUMENT), F.lit(1))
    values = lambda b: F.regexp_extract_all(b, F.lit(ARGUMENT), F.lit(2))
    trimmed = lambda a: F.transform(a, lambda x: F.trim(x))
    return F.transform(bodies, lambda b: F.struct(F.trim(F.regexp_extract(b, CALL, 1)).alias("name"), F.map_from_arrays(trimmed(names(b)), trimmed(values(b))).alias("arguments")))


def point_of(value: Column) -> Column:
    """An array of two numbers as x and y; null for any other length."""
    return F.when(F.size(value) == 2, F.struct(value[0].alias("x"), value[1].alias("y")))


def first_object(text: Column, schema: str) -> Column:
    """The first "{...}" of a text read as JSON of the schema; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*?\})", 1), F.lit("")), schema)
