"""Text functions as column expressions: folding, keys, bags and the drift rules between a source and its target.

Word lists are parameters with small defaults of our own. Blanks are Unicode-wide; null texts give null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .reading import longest_first, without_terms

STOP_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "for", "with", "on", "that", "this", "by", "are", "was", "from"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "en", "dans", "que", "qui", "pour", "avec", "est"),
}
NEGATIONS = ("not", "never", "no", "without", "cannot")
TARGET_NEGATIONS = ("pas", "jamais", "non", "sans", "nicht", "kein", "ohne")
SYMBOLS = ("<", ">", "≤", "≥", "±")
FULLWIDTH = ("＜＞", "<>")
SUPERSCRIPTS = ("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")


def fold_blanks(c: Column) -> Column:
    """Runs of blanks become one space, ends are trimmed (SC18)."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def no_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def digits_masked(c: Column, most: int = 60) -> Column:
    """Digit runs as ``#``, cut to ``most`` code points: the key of running headers (AG9)."""
    return F.substring(F.regexp_replace(F.trim(c), "[0-9]+", "#"), 1, most)


def slug(c: Column, most: int = 60, default: str = "doc") -> Column:
    """SC2: lower case, other characters than [a-z0-9_-] as one underscore, stripped, cut, never empty."""
    out = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_-]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.substring(F.btrim(out, F.lit("_")), 1, most), F.lit("")), F.lit(default))


def source_key(c: Column) -> Column:
    """SC5: a file name without long digit runs, a single ``-q`` mark, copy marks and other than letters and digits."""
    out = F.regexp_replace(F.lower(c), r"[0-9]{4,}", "")
    out = F.regexp_replace(out, r"-q(?![a-z0-9])", "")
    return F.regexp_replace(F.regexp_replace(out, r"\([0-9]+\)", ""), r"[^a-z0-9]+", "")


def words(c: Column, least: int = 2) -> Column:
    """Lower-case runs of ASCII and Latin-1 letters."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[a-zà-öø-ÿ]{{{least},}}"), F.lit(0))


def hits(tokens: Column, vocabulary: Sequence[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(*vocabulary)))


def readable_ratio(c: Column, least: int = 200) -> Column:
    """AG13: the larger stop-word share of the languages; null with fewer than ``least`` words (no evidence)."""
    t = words(c)
    best = F.greatest(*[hits(t, v) for v in STOP_WORDS.values()])
    return F.when(F.size(t) >= least, best.cast("double") / F.size(t))


def digit_runs(c: Column) -> Column:
    return F.regexp_extract_all(F.translate(c, *SUPERSCRIPTS), F.lit("[0-9]+"), F.lit(0))


def count_of(c: Column, symbol: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(symbol), F.lit("")))


def symbol_drift(source: Column, target: Column) -> Column:
    """SC12: how many comparison signs the two bags differ by."""
    s, t = F.translate(source, *FULLWIDTH), F.translate(target, *FULLWIDTH)
    total = F.lit(0)
    for symbol in SYMBOLS:
        total = total + F.abs(count_of(s, symbol) - count_of(t, symbol))
    return total


def any_word(c: Column, vocabulary: Sequence[str]) -> Column:
    return F.lower(c).rlike(r"(^|[^\p{L}])(" + "|".join(vocabulary) + r")([^\p{L}]|$)")


def negation_drop(source: Column, target: Column) -> Column:
    """SC13: a negated source whose target has no negation."""
    return any_word(source, NEGATIONS) & ~any_word(target, TARGET_NEGATIONS)


def carried_words(source: Column, target: Column) -> Column:
    """SC14: target words, with repeats, that are lower-case words of the source."""
    lower = F.array_distinct(F.regexp_extract_all(source, F.lit("[A-Za-z]{3,}"), F.lit(0)))
    lower = F.filter(lower, lambda w: w == F.lower(w))
    return F.size(F.filter(F.regexp_extract_all(target, F.lit("[A-Za-z]{3,}"), F.lit(0)), lambda w: F.array_contains(lower, F.lower(w))))


#: Letters with a Vietnamese mark, lower and upper case, as ranges of code points.
MARKED_LETTERS = "[À-ÃÈ-ÊÌÍÒ-ÕÙÚÝà-ãè-êìíò-õùúýĂăĐđĨĩŨũƠơƯưẠ-ỹ]"


def marked_words(c: Column) -> Column:
    """SC14: how many words between blanks have a letter with a Vietnamese mark."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w.rlike(MARKED_LETTERS)))


def carry_through(source: Column, target: Column) -> Column:
    """SC14: three carried words or more, and over twice as many as marked words, half a word at least."""
    carried = carried_words(source, target)
    return (carried >= 3) & (carried > 2 * F.greatest(marked_words(target).cast("double"), F.lit(0.5)))


def letter_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}{3,}"))


def authenticity(source: Column, target: Column, keep: Sequence[str] = (), target_language: str = "") -> Column:
    """SC10: identical, truncated, lang_suspect or null (no verdict); under four words without keep terms there is no evidence.

    Only for the target language ``vi`` a target of 20 letters and more is suspect with under 5 % of them marked.
    """
    strip = lambda c: without_terms(F.regexp_replace(c, r"https?://\S+|\S+@\S+", " "), keep)
    letters = F.regexp_count(target, F.lit(r"\p{L}"))
    suspect = F.lit(target_language == "vi") & (letters >= 20) & (F.regexp_count(target, F.lit(MARKED_LETTERS)) < 0.05 * letters)
    s, t = letter_words(strip(source)), letter_words(strip(target))
    share = t.cast("double") / s
    return (
        F.when(s < 4, F.lit(None).cast("string"))
        .when(F.lower(fold_blanks(source)) == F.lower(fold_blanks(target)), "identical")
        .when((s >= 6) & (share < 0.45), "truncated")
        .when((s >= 12) & (share < 0.60), "truncated")
        .when(suspect, "lang_suspect")
    )


ARTIFACTS = (("reasoning", r"</?think(ing)?>"), ("fence", "```"), ("lead_in", r"(?i)^\s*(here is|sure,|certainly)"))


def artifact(source: Column, target: Column) -> Column:
    """SC16: the first kind of left-over that the target has and the source has not."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(ARTIFACTS):
        out = F.when(target.rlike(pattern) & ~source.rlike(pattern), kind).otherwise(out)
    return out


def punctuation(c: Column, table: Sequence[tuple[str, str]] = (("…", "..."), ("“", '"'), ("”", '"'), ("–", "-"))) -> Column:
    """SC17: replacements in turn, then double spaces collapsed; ``punctuation(c) != c`` says whether it changed."""
    for a, b in table:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, "  +", " ")


@F.pandas_udf(StringType())
def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SC1: Unicode NFC, which Spark lacks."""
    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


#: Units of measure, and bodies whose names begin a standard's number.
UNITS = ("mm", "cm", "m", "km", "g", "kg", "V", "kV", "A", "mA", "Ah", "mAh", "W", "kW", "Wh", "kWh", "Hz", "kHz", "MB", "GB", "%", "°C", "°F")
BODIES = ("ISO", "IEC", "EN", "DIN", "UL", "ANSI", "IEEE", "FCC", "CE", "UN")


def _any_of(values: Sequence[str]) -> str:
    return "(?:" + "|".join(sorted(values, key=lambda v: (-len(v), v))) + ")"


#: Kinds of masked tokens in the order in which they are sought; brand names come after addresses, as they are a parameter.
MASKS = (
    ("URL", r"(?:[a-z]+://|www[.])[^\s⟦⟧]+"),
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("STD", rf"(?<![\w⟦]){_any_of(BODIES)}[\s-]?[0-9](?:[\w.-]*\w)?(?!\w)"),
    ("MEAS", rf"(?<![\w⟦_.,])[0-9](?:[0-9.,]*[0-9])?\s?{_any_of(UNITS)}(?!\w)"),
    ("MODEL", r"(?<![\w⟦_])(?:[A-Z]{1,4}[0-9][0-9A-Za-z]*(?:[/-][0-9A-Za-z]+)*|Ø\s?[0-9]+)(?!\w)"),
)


def mask(c: Column, keep: Sequence[str] = ()) -> Column:
    """SC6, natively: struct(masked, map) with tokens ⟦KIND_n⟧, numbered per kind in order of appearance.

    Each kind is sought in the text that the kinds before have masked, between the masks. The text is cut at marks
    around the matches, and a fold numbers them. Marks in the text itself are put aside first. ``keep`` are brand names, sought in
    their own case, the longest first, between other than ASCII letters and digits.
    """
    brand = ((("BRAND", rf"(?<![A-Za-z0-9])(?:{longest_first(keep)})(?![A-Za-z0-9])"),) if keep else ())
    text = F.translate(c, "\x01", "�")
    entries = F.array().cast("array<struct<key:string,value:string>>")
    for kind, pattern in (*MASKS[:2], *brand, *MASKS[2:]):
        parts = F.split(F.regexp_replace(text, f"({pattern})", "\x01$1\x01"), "\x01", -1)
        marked = F.transform(parts, lambda p, i: F.struct(p.alias("p"), ((i % 2) == 1).alias("hit"), ((i + 1) / 2).cast("int").alias("n")))
        entries = F.concat(entries, F.transform(F.filter(marked, lambda e: e["hit"]), _entry(kind)))
        text = F.array_join(F.transform(marked, _shown(kind)), "")
    return F.struct(text.alias("masked"), F.map_from_entries(entries).alias("tokens"))


def _entry(kind: str):
    return lambda e: F.struct(F.concat(F.lit(f"{kind}_"), e["n"].cast("string")).alias("key"), e["p"].alias("value"))


def _shown(kind: str):
    return lambda e: F.when(e["hit"], F.concat(F.lit(f"⟦{kind}_"), e["n"].cast("string"), F.lit("⟧"))).otherwise(e["p"])


def restore(masked: Column, tokens: Column) -> Column:
    """SC7: every known token back in its place, literally; unknown ones stay. The text is cut at its tokens once."""
    parts = F.split(F.regexp_replace(masked, "⟦([A-Z]+_[0-9]+)⟧", "\x01$1\x01"), "\x01", -1)
    known = lambda p: F.coalesce(F.try_element_at(tokens, p), F.concat(F.lit("⟦"), p, F.lit("⟧")))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, known(p)).otherwise(p)), "")


def coverage(target: Column, window: Column, page: Column, kept: Column) -> Column:
    """GT3: where a target text is found: 'window', then 'page' (or so without any blanks), then for kept texts
    'reordered', if the page has each of its characters as often, else 'missing'."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    times = lambda s, c: F.length(s) - F.length(F.replace(s, c))
    bag = lambda x: F.forall(F.array_distinct(F.split(x["t"], "")), lambda c: times(x["t"], c) <= times(x["p"], c))
    # an array of one, so that blanks are taken out once and not for every character
    both = F.array(F.struct(bare(target).alias("t"), bare(page).alias("p")))
    rest = F.transform(both, lambda x: F.when(F.contains(x["p"], x["t"]), "page").when(kept & bag(x), "reordered").otherwise("missing"))
    return F.when(F.contains(window, target), "window").when(F.contains(page, target), "page").otherwise(F.element_at(rest, 1))
