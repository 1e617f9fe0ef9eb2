"""Predicates over the text, style and name of a region (FLT10-FLT13, SC8, SC9, SC15, SC19, SC25, SC29).

Patterns are our own spelling of the survey's semantics cards. Null texts give null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOW_TYPES = ("paragraph", "list_item")
LABEL_TYPES = ("figure_caption", "diagram_label")
#: Words that begin the caption of a table or figure, in the two languages.
CAPTION_WORDS = ("Table", "Figure", "Bảng", "Hình")
#: Hints in font names; a sans hint outweighs a serif hint.
SANS_HINTS = ("sans", "arial", "helvetica", "gothic", "verdana", "calibri", "roboto")
SERIF_HINTS = ("serif", "times", "roman", "georgia", "garamond", "song", "ming")
BOLD_HINTS = ("bold", "black", "heavy", "semibold", "demi")
#: Words of a postal address that name a street or district.
STREET_WORDS = ("Road", "Rd", "Street", "Avenue", "Lane", "District", "DST", "Province")


def soft_end(c: Column) -> Column:
    """SC19: the text does not end a sentence, with or without a closing quote or bracket."""
    return ~F.rtrim(c).rlike(r"[.:;!?…。]['\"’”)\]]?$")


def heading_like(c: Column) -> Column:
    """SC19: begins with a section number: numbers joined by points, then a point or blank, then text."""
    return c.rlike(r"^\s*[0-9]+([.][0-9]+)*[.\s]\s*\S")


def contents_line(c: Column) -> Column:
    """FLT10: has the dots of a table of contents."""
    return F.contains(c, F.lit("...."))


def caption(c: Column) -> Column:
    return c.rlike(rf"^\s*({'|'.join(CAPTION_WORDS)})\s+[0-9]")


def label_value(c: Column) -> Column:
    """FLT10: a short label, a colon and a blank, which always open an item."""
    return c.rlike(r"^\s*\p{L}[\p{L}0-9_ ]{0,14}[:：]\s")


def serif_font(name: Column) -> Column:
    """FLT12: by name; unknown names are sans."""
    low = F.lower(name)
    return F.when(low.rlike("|".join(SANS_HINTS)), False).otherwise(F.coalesce(low.rlike("|".join(SERIF_HINTS)), F.lit(False)))


def bold_font(name: Column, flags: Column) -> Column:
    """FLT13: by name, else by bit 16 of the flags."""
    return F.when(F.lower(name).rlike("|".join(BOLD_HINTS)), True).otherwise(flags.bitwiseAND(16) != 0)


def style(name: Column, flags: Column) -> Column:
    """RG4: bold, italic, serif and mono of a span."""
    return F.struct(bold_font(name, flags).alias("bold"), (flags.bitwiseAND(2) != 0).alias("italic"), serif_font(name).alias("serif"), (flags.bitwiseAND(8) != 0).alias("mono"))


def unwrapped(tokens: Column) -> Column:
    """SC8: line breaks go from masked values."""
    return F.transform_values(tokens, lambda k, v: F.replace(v, F.lit("\n"), F.lit("")))


def digit_touches_token(masked: Column) -> Column:
    """SC9: a letter and a digit stand right before a masked token, with at most a blank between."""
    return masked.rlike(r"[A-Za-z][0-9]\s?⟦[A-Z]+_[0-9]+⟧")


def address_tokens(source: Column) -> Column:
    """SC15: words and numbers of postal addresses, in order, then the cities that follow them; each once."""
    street = "|".join(STREET_WORDS)
    spans = F.regexp_extract_all(source, F.lit(rf"(?<!\w)No[.]?\s?[0-9][^,\n]*|(?<!\w)[A-Z][A-Za-z]+\s+(?:{street})(?!\w)"), F.lit(0))
    tokens = F.flatten(F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit("[A-Za-z]{2,}|[0-9]+"), F.lit(0))))
    cities = F.regexp_extract_all(source, F.lit(rf"(?:{street})(?!\w)[,，]\s*(?:[0-9]+\s+)?([A-Z][A-Za-z]+)"), F.lit(1))
    return F.when(F.size(tokens) > 0, F.array_distinct(F.concat(tokens, cities))).otherwise(F.array().cast("array<string>"))


def address_drift(source: Column, target: Column) -> Column:
    """SC15: address tokens that the target lacks, between characters other than ASCII letters."""
    bare = F.concat(F.lit(" "), F.regexp_replace(target, "[^A-Za-z0-9]+", " "), F.lit(" "))
    # tokens of digits may touch digits but not letters, so runs of letters and of digits are parted
    parts = F.split(F.regexp_replace(F.regexp_replace(bare, "([A-Za-z])([0-9])", "$1 $2"), "([0-9])([A-Za-z])", "$1 $2"), " +")
    return F.array_except(address_tokens(source), parts)


def segments(runs: Column) -> Column:
    """SC25: the texts of runs joined, cut at line breaks, empty parts dropped."""
    return F.filter(F.split(F.array_join(F.transform(runs, lambda r: r["text"]), ""), "\n"), lambda s: F.trim(s) != "")


def tokens(c: Column) -> Column:
    """SC25: words between single blanks, empty ones dropped."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def config_digest(entries: Column) -> Column:
    """SC29: SHA-256 of a map as JSON with its keys in order."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries)))), 256)


def job_id(stem: Column, content: Column, at: Column) -> Column:
    """SC3: slug, eight hex digits of the content's digest, and the time in UTC (SC27)."""
    from .text import slug

    return F.concat_ws("__", slug(stem), F.substring(F.sha2(content, 256), 1, 8), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))


def longest_first(terms: Sequence[str]) -> str:
    """ST5: an alternation that tries longer terms before their beginnings."""
    quoted = ["".join(f"\\{c}" if c in r"\.[]{}()*+?^$|" else c for c in t) for t in sorted(set(terms), key=lambda t: (-len(t), t))]
    return "|".join(quoted)


def without_terms(c: Column, terms: Sequence[str]) -> Column:
    """SC10: the text without keep terms, in either case, between characters other than ASCII letters."""
    return F.regexp_replace(c, rf"(?iu)(?<![A-Za-z])(?:{longest_first(terms)})(?![A-Za-z])", " ") if terms else c
