"""Columns over texts: folding, surfaces, tokens, keys, predicates and small parsers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that folding takes away, and what it turns into a blank.
_BRACKETS, _BLANKS = "()[]{}<>（）［］｛｝＜＞【】《》「」", "\t\n\x0b\f\r　"


def folded(c: Column, keep_spaces: bool = False) -> Column:
    """Full-width forms to ASCII, lower case, without brackets and (unless kept) white space."""
    wide = "".join(w for w in map(chr, range(0xFF01, 0xFF5F)) if w not in _BRACKETS)
    plain = "".join(chr(ord(w) - 0xFEE0) for w in wide)
    # one reading of the text: what has no counterpart is taken away
    if not keep_spaces:
        return F.translate(F.lower(c), wide + _BRACKETS + _BLANKS + " ", plain)
    flat = F.translate(F.lower(c), wide + _BLANKS + _BRACKETS, plain + " " * len(_BLANKS))
    return F.trim(F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, "  +", " ")).otherwise(flat))


def variants(c: Column) -> Column:
    """The name and its pieces between brackets and separators, each once, without blanks."""
    pieces = F.split(c, r"[()（）/、,;|]+")
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(c), pieces), lambda x: F.trim(x)), lambda x: x != ""))


def occurs(surface: Column, question: Column) -> Column:
    """Whether a surface stands in a question: as a whole word if it is Latin, anywhere else."""
    latin = surface.rlike("^[\\x00-\\x7F]+$")
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(question), "[^a-z0-9]+", " "), F.lit(" "))
    word = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(surface), "[^a-z0-9]+", " ")), F.lit(" "))
    return F.when(latin, F.contains(padded, word)).otherwise(F.contains(question, surface))


def prefix_key(c: Column, size: int = 3) -> Column:
    return F.substring(folded(c), 1, size)


def grams(c: Column, size: int) -> Column:
    """All distinct runs of ``size`` characters."""
    n = F.length(c)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def latin_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9-]+"), F.lit(0))


def is_latin(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9][A-Za-z0-9 ._/-]*$")


def is_junk(c: Column) -> Column:
    """Names that say nothing: one character, numbers alone, or no letter at all."""
    return (F.length(F.trim(c)) < 2) | c.rlike("^[0-9.%-]+$") | ~c.rlike(r"\p{L}")


def domains(c: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Domains of which a keyword stands in the text, in their order."""
    low = F.lower(c)
    return F.array_compact(F.array(*(F.when(F.array_contains(F.array(*(F.contains(low, F.lit(k)) for k in words)), True), F.lit(d)) for d, words in keywords.items())))


def intent(c: Column, triggers: Mapping[str, Sequence[str]], default: str = "other") -> Column:
    """The first intent of which a trigger stands in the text."""
    low, out = F.lower(c), F.lit(default)
    for name, words in reversed(list(triggers.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def first_match(c: Column, patterns: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that matches."""
    out = F.lit(default)
    for label, pattern in reversed(patterns):
        out = F.when(c.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def line_kind(c: Column) -> Column:
    """page_number, caption, reference, thanks, affiliation or body."""
    rules = (
        ("page_number", r"(?i)^\s*(page\s*)?[0-9]{1,4}(\s*(/|of)\s*[0-9]{1,4})?\s*$"),
        ("caption", r"(?i)^\s*(fig(ure)?|table)\.?\s*[0-9]+"),
        ("reference", r"^\s*\[[0-9]+\]\s|(?i)\bdoi\s*:"),
        ("thanks", r"(?i)^\s*(acknowledge?ments?|funding)\b"),
        ("affiliation", r"(?i)\b(university|institute|department|laboratory)\b.*,"),
    )
    return first_match(c, rules, "body")


def day_in(c: Column, year: Column | None = None) -> Column:
    """yyyy-mm-dd of the first ``YYYY.M.D`` (or with - and /) in a text, else of ``M月D`` in a given year; days are not checked."""
    part = lambda p, i: F.regexp_extract(c, p, i)
    full, short = r"([0-9]{4})[.\-/]([0-9]{1,2})[.\-/]([0-9]{1,2})", r"([0-9]{1,2})月([0-9]{1,2})"
    made = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    out = F.when(c.rlike(full), made(part(full, 1), part(full, 2), part(full, 3)))
    return out if year is None else F.coalesce(out, F.when(c.rlike(short), made(year.cast("string"), part(short, 1), part(short, 2))))


def safe_name(c: Column, most: int = 80) -> Column:
    """A file name of letters, digits, dots, dashes and underscores; ``file`` if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(clean == "", "file").otherwise(F.substring(clean, 1, most))


def object_in(c: Column) -> Column:
    """The JSON object of a text: the whole, or what stands from its first to its last brace."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(c, "$").isNotNull() & F.trim(c).startswith("{"), c).when(F.get_json_object(inner, "$").isNotNull(), inner)


def markers(c: Column) -> Column:
    """Numbers of citations like [3], each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))))
