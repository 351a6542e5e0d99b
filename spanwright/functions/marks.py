"""Marks, type tokens, ids and titles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mark patterns of each category, and the words that name a category.
MARK_PATTERNS = {
    "holdown": r"^(?:H|HD|HDU|HTT|TD)-?\d{1,2}$",
    "shear_wall": r"^SW-?\d{1,2}$",
    "post": r"^P-?\d{1,2}$",
    "steel_column": r"^C-?\d{1,2}$",
    "wall_type": r"^\d{1,2}$",
}
CATEGORY_WORDS = {
    "holdown": r"(?i)hold[- ]?(?:down|own)s?|tie[- ]?downs?|\bhd\b",
    "shear_wall": r"(?i)shear[- ]?walls?",
    "post": r"(?i)\bposts?\b",
    "steel_column": r"(?i)\bsteel columns?\b|\bcolumns?\b",
    "wall_type": r"(?i)\bwall types?\b|\bwalls?\b",
}
#: Product families of hold-downs, and the words by which a rule leaves marks out.
VARIANT = r"(?i)(HTT|HD[UB]?|BHH|SDWB)\s*_?(\d+)([A-Z]?)"
EXCLUDE = r"(?i)\b(?:ignore|exclude|skip|drop|omit)\b|\b(?:don'?t|do not)\s+(?:extract|include|use|count)\b"
TOKEN = r"[A-Za-z]{1,4}[- ]?\d{1,3}"
ALIAS = rf"(?i)[\"']?({TOKEN})[\"']?\s+(?:means|is the same as|maps? to|equals|=|is)\s+[\"']?({TOKEN})[\"']?"
IS_CATEGORY = rf"(?i)[\"']?({TOKEN})[\"']?(?:\s+marks?)?\s+(?:is|are|denotes?|represents?)\s+(?:a |an |the )?([a-z][a-z -]+)"
#: Suffixes of type names that say nothing of the type, and family words of bodies.
SUFFIXES = ("WITHANCHOR", "WITHBOLT1", "WITHBOLT2", "WITHBOLT", "BOLT1", "BOLT2", "ANCHOR")
EVIDENCE_WORDS = r"anchor|offset|bolt|plate|screw"
BENCHMARK = r"^BM[-_ ]?\d$"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def cleaned(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]", "")


def variant_key(text: Column) -> Column:
    """Family, number and suffix of a product name; HDU and HDB count as HD."""
    family = F.upper(found(text, VARIANT, 1))
    kept = F.when(family.isin("HTT", "BHH", "SDWB"), family).otherwise("HD")
    return F.when(family.isNotNull(), F.concat(kept, found(text, VARIANT, 2).cast("int").cast("string"), F.upper(F.regexp_extract(text, VARIANT, 3))))


def point_mark(mark: Column) -> Column:
    """The family mark of an instance mark: P-01 is P-1, C2-01-02 is C-2."""
    m = F.upper(F.trim(F.coalesce(mark, F.lit(""))))
    letters, number = found(m, r"^([A-Z]+)-?0*(\d+)", 1), found(m, r"^([A-Z]+)-?0*(\d+)", 2)
    l2, n2 = found(m, r"^([A-Z]+)(\d+)", 1), found(m, r"^([A-Z]+)(\d+)", 2)
    joined = lambda a, b: F.concat_ws("-", a, b.cast("int").cast("string"))
    return F.when(letters.isNotNull() & m.contains("-"), joined(letters, number)).when(l2.isNotNull(), joined(l2, n2)).otherwise(m)


def wall_token(name: Column) -> Column:
    n = found(name, r"(?i)\bSW[- ]?(\d{1,2})\b").cast("int")
    return F.when(n.isNotNull(), F.concat(F.lit("SW-"), n.cast("string")))


def core_token(text: Column, vocabulary: list[str]) -> Column:
    """The first token, in order of the vocabulary, that the cleaned name, or the name without
    a leading S, without suffixes, or without both, starts with; else that it contains."""
    c = cleaned(text)
    bare = c
    for s in SUFFIXES:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    tail = lambda x: F.when(x.startswith("S"), F.substring(x, 2, 1000))
    starts = lambda x, t: x.startswith(t) | x.startswith(f"S{t}")
    tries = [F.when(starts(x, t), t) for x in (c, tail(c), bare, tail(bare)) for t in vocabulary]
    tries += [F.when(c.contains(t), t) for t in vocabulary]
    return F.coalesce(*tries, F.lit(""))


def normalized_type(text: Column, vocabulary: dict[str, str]) -> Column:
    """cleaned, core_token, structural_token, bolt_variant, mapped_mark, confidence, known."""
    c, core = cleaned(text), core_token(text, list(vocabulary))
    known = core != ""
    structural = F.when(known & c.startswith(F.concat(F.lit("S"), core)), F.concat(F.lit("S"), core)).otherwise("")
    marks = F.create_map(*[F.lit(x) for p in vocabulary.items() for x in p])
    sure = F.when(~known & (c == ""), 0.0).when(~known, 0.15).when((structural == "") & (core != c), 0.9).otherwise(0.95)
    return F.struct(
        c.alias("cleaned"), core.alias("core_token"), structural.alias("structural_token"), F.coalesce(F.concat(F.lit("BOLT"), found(c, "BOLT([12])")), F.lit("")).alias("bolt_variant"),
        F.try_element_at(marks, core).alias("mapped_mark"), sure.alias("confidence"), known.alias("known"),
    )


def normalized_mark(mark: Column, vocabulary: dict[str, str], pattern: str = r"^[A-Z]+-?\d{1,2}$") -> Column:
    c = cleaned(mark)
    by_mark = F.create_map(*[F.lit(x) for core, m in vocabulary.items() for x in (m, core)])
    core = F.when(c.rlike(pattern), F.try_element_at(by_mark, c))
    known = core.isNotNull()
    return F.struct(c.alias("cleaned"), F.coalesce(core, F.lit("")).alias("core_token"), F.when(known, c).alias("mapped_mark"), F.when(known, 0.98).when(c != "", 0.15).otherwise(0.0).alias("confidence"), known.alias("known"))


def element_number(unique_id: Column) -> Column:
    """The number in a unique id: its last part, exclusive-or the last eight hex digits of the
    part before."""
    parts = F.split(F.trim(unique_id), "-")
    hexa = lambda x: F.conv(x, 16, 10).cast("long")
    return hexa(F.try_element_at(parts, F.lit(-1))).bitwiseXOR(hexa(F.right(F.try_element_at(parts, F.lit(-2)), F.lit(8))))


def titles_match(a: Column, b: Column) -> Column:
    """True if either title holds the other; null if one is unknown."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != ""), y.contains(x) | x.contains(y))


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^.*[\\/]", ""), r"(?<=.)\.[^.]*$", "")


def redacted(line: Column) -> Column:
    return F.regexp_replace(line, r"(?i)((?:api_key|token|key)=)[^&\s\"'\\]+", "$1REDACTED")


def cell_text(text: Column) -> Column:
    """Single spaces, and fractions of an inch whose bar was lost."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r'\b(\d) (\d{1,2}")', "$1/$2"))


def slug(name: Column) -> Column:
    """Lower-case letters and digits of any script, other runs as one hyphen, 48 characters at
    most; "project" if nothing is left."""
    short = F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), 1, 48)
    return F.when(short == "", "project").otherwise(short)


def first_of(text: Column, patterns: dict[str, str], leave_out: tuple[str, ...] = ()) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed([x for x in patterns.items() if x[0] not in leave_out]):
        out = F.when(text.rlike(p), name).otherwise(out)
    return out


def parsed_rule(message: Column) -> Column:
    """kind, category, token, maps_to of a rule told in words; a note if nothing fits."""
    name = lambda x: F.replace(F.upper(x), F.lit(" "), F.lit("-"))
    words = lambda t: first_of(t, CATEGORY_WORDS)
    by_mark = lambda t: first_of(t, MARK_PATTERNS, ("wall_type",))
    rule = lambda kind, category, token, to: F.struct(F.lit(kind).alias("kind"), category.alias("category"), token.alias("token"), to.alias("maps_to"))
    none = F.lit(None).cast("string")
    token = name(found(message, f"({TOKEN})"))
    out_category = F.coalesce(words(message), by_mark(token))
    a, b = name(found(message, ALIAS, 1)), name(found(message, ALIAS, 2))
    alias_category = F.coalesce(words(message), by_mark(b))
    c, c_category = name(found(message, IS_CATEGORY, 1)), words(found(message, IS_CATEGORY, 2))
    return (
        F.when(message.rlike(EXCLUDE) & token.isNotNull() & out_category.isNotNull(), rule("exclude", out_category, token, none))
        .when(a.isNotNull() & alias_category.isNotNull(), rule("mark_alias", alias_category, a, b))
        .when(c.isNotNull() & c_category.isNotNull(), rule("mark_alias", c_category, c, c))
        .otherwise(rule("note", none, none, none))
    )
