"""Scalar text functions as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sequences that UTF-8 read as Latin-1 gives for German letters, and the no-break space.
MOJIBAKE = (("Ã¤", "ä"), ("Ã¶", "ö"), ("Ã¼", "ü"), ("Ã„", "Ä"), ("Ã–", "Ö"), ("Ãœ", "Ü"), ("ÃŸ", "ß"), (" ", " "))
#: Marks that become ASCII, and the quotation marks that do so only on demand.
DASHES, LOW_QUOTE = "–—", "„"
CURLY = "“”‘’"
#: Forms of a reference to a section, the first form that occurs counts wherever it stands.
SECTION_FORMS = (r"§\s*\d+[a-z]?(?:\s+Abs\.\s*\d+)?", r"Art(?:ikel)?\.\s*\d+[a-z]?", r"Abs(?:atz)?\.\s*\d+")
NUMBER_FORMS = (r"§\s*\d+[a-z]?", r"Art\.\s*\d+[a-z]?", r"Abs\.\s*\d+", r"Artikel\s+\d+")
#: The sixth character of a CELEX number and the kind of act.
CELEX_KINDS = (("R", "regulation"), ("L", "directive"), ("D", "decision"))


def strip(text: Column) -> Column:
    """Without white space at both ends (not only spaces)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def repair(text: Column) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), MOJIBAKE, text)


def plain_marks(text: Column, curly: bool = False) -> Column:
    """Dashes and the low quotation mark in ASCII; with ``curly`` the other typographic quotation marks as well."""
    source, target = DASHES + LOW_QUOTE, '--"'
    if curly:
        source, target = source + CURLY, target + "\"\"''"
    return F.translate(text, source, target)


def squeeze(text: Column) -> Column:
    """One space for many, at most one empty line, no white space at the end of a line."""
    text = F.regexp_replace(text, " +", " ")
    text = F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n")
    return F.regexp_replace(text, r"[ \t\r\f\x0B]+(?=\n|$)", "")


def normalise(text: Column, curly: bool = False) -> Column:
    """Repair, then marks, then white space; null gives the empty text."""
    return strip(squeeze(plain_marks(repair(F.coalesce(text, F.lit(""))), curly)))


def first_match(text: Column, forms: tuple[str, ...], ignore_case: bool) -> Column:
    flag = "(?i)" if ignore_case else ""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, flag + form, 0), F.lit("")) for form in forms))


def section_reference(text: Column) -> Column:
    return first_match(text, SECTION_FORMS, True)


def section_number(text: Column) -> Column:
    return first_match(text, NUMBER_FORMS, False)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def object_key(source: Column, external: Column, digest: Column, extension: str) -> Column:
    return F.concat_ws("/", source, external, F.concat(digest, F.lit("." + extension)))


def upload_key(document: Column, digest: Column) -> Column:
    return F.concat_ws("/", F.lit("uploads"), document, F.concat(digest, F.lit(".pdf")))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.char_length(text) / 4).cast("long")


def key_prefix(key: Column) -> Column:
    return F.substring(key, 1, 8)


def snippet(text: Column, n: int = 300) -> Column:
    return F.substring(text, 1, n)


def shortened(text: Column, n: int, tail: str) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit(tail))).otherwise(text)


def highlight(text: Column, words: list[str], mark: str = "mark") -> Column:
    """Each of the words, whatever its case, between tags; the words are taken literally, empty ones mark nothing."""
    pattern = "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words if w)
    return F.regexp_replace(text, f"(?iu)({pattern})", f"<{mark}>$1</{mark}>") if pattern else text


def like_literal(word: str) -> str:
    """A LIKE pattern for texts that hold the word; its wildcards count as themselves."""
    return "%" + word.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.ilike(like_literal(w)) for w in words))


def same_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def celex_kind(celex: Column) -> Column:
    letter, out = F.substring(celex, 6, 1), F
    for key, kind in CELEX_KINDS:
        out = out.when(letter == key, kind)
    return out.otherwise("unknown")


def abbreviation(title: Column) -> Column:
    return F.regexp_extract(title, r"\(([A-Za-zÄÖÜäöüß0-9]+)\)", 1)


def title_kind(title: Column) -> Column:
    return F.when(F.lower(title).contains("verordnung"), "regulation").otherwise("law")


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def resolve(base: Column, href: Column) -> Column:
    """An absolute address as it is; others behind the origin of the base."""
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href).otherwise(F.concat(origin(base), F.when(href.startswith("/"), href).otherwise(F.concat(F.lit("/"), href))))


def last_segment(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)/?$", 1)


def url_id(url: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.replace(last_segment(url), F.lit("."), F.lit("_")))


def path_id(url: Column) -> Column:
    """The whole path with / and . as _; over 200 characters a short digest of it."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1), r"[/.]", "_")
    return F.when(F.char_length(path) > 200, F.substring(F.md5(path), 1, 12)).otherwise(path)


def link_id(link: Column) -> Column:
    """``/bgb/xml.zip`` to ``bgb``."""
    return last_segment(F.regexp_replace(link, r"/?xml\.zip$", ""))


def case_title(title: Column, court: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(court, F.lit(" - "), number))


def safe_date(text: Column) -> Column:
    return F.try_to_timestamp(text).cast("date")


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of the lower-case text with two spaces before and one behind."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: padded.substr(i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def sniff(head: Column) -> Column:
    """The format of a document by its first characters."""
    head = F.substring(head, 1, 64)
    return F.when(head.startswith("<?xml") | head.startswith("<gesetz"), "xml").when(head.startswith("%PDF"), "pdf").otherwise("html")


def percent(score: Column) -> Column:
    return F.format_string("%.0f%%", score * 100)


def titled_markdown(title: Column, content: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) == "", content).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), content))
