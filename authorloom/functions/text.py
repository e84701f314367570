"""String normalisers and keys as Column expressions. Null counts as empty throughout."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that normalised titles leave out.
TITLE_STOP = ["a", "an", "the", "of", "in", "on", "at", "to", "for", "with", "by", "from"]
#: Letters, digits and underscore of any script, and white space of any kind; combining marks are not words' parts.
_NOT_WORD = r"(?U)[^\p{L}\p{N}_\s]"
_SPACE = r"(?U)\s+"


def text(c: Column | str) -> Column:
    if isinstance(c, str):
        c = F.col(c) if c else F.lit("")
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """White-space runs to one blank, none outside."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def either(*columns: Column | str) -> Column:
    """The first that is not null or empty; else empty."""
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in columns], F.lit(""))


def normalize_name(c, case_sensitive: bool = False) -> Column:
    """Lower case, ASCII punctuation deleted, blanks squeezed."""
    lowered = text(c) if case_sensitive else F.lower(text(c))
    return squeeze(F.translate(lowered, string.punctuation, ""))


def normalize_string(c) -> Column:
    """Lower case, blanks squeezed; punctuation stays."""
    return squeeze(F.lower(text(c)))


def normalize_affiliation(c) -> Column:
    """Lower case, usual abbreviations, no punctuation."""
    out = F.lower(text(c))
    for word, short in (("university", "univ"), ("institute", "inst"), ("department", "dept")):
        out = F.regexp_replace(out, rf"\b{word}\b", short)
    return squeeze(F.regexp_replace(out, _NOT_WORD, ""))


def clean_orcid(c) -> Column:
    out = text(c)
    for prefix in ("https://orcid.org/", "http://orcid.org/"):
        out = F.replace(out, F.lit(prefix), F.lit(""))
    return F.trim(out)


def normalize_doi(c) -> Column:
    """Resolver prefixes off; case stays."""
    out = text(c)
    for prefix in ("https://doi.org/", "http://dx.doi.org/"):
        out = F.replace(out, F.lit(prefix), F.lit(""))
    return F.trim(out)


def normalize_title(c) -> Column:
    """Lower case, no punctuation, no stop words."""
    words = F.split(squeeze(F.regexp_replace(F.lower(text(c)), _NOT_WORD, "")), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(TITLE_STOP)), " ")


def normalize_plain(c) -> Column:
    """Lower case, no punctuation, blanks squeezed (heuristic baseline)."""
    return squeeze(F.regexp_replace(F.lower(text(c)), _NOT_WORD, ""))


def tokens(c) -> Column:
    """White-space separated words; none of a blank string."""
    return F.filter(F.split(F.trim(F.regexp_replace(text(c), _SPACE, " ")), " "), lambda w: w != "")


def surname(c) -> Column:
    """Last word, as written."""
    return F.coalesce(F.try_element_at(tokens(c), F.lit(-1)), F.lit(""))


def surname_initial(c) -> Column:
    """``last_f`` in lower case; a single word alone."""
    w = tokens(c)
    last, first = F.lower(F.try_element_at(w, F.lit(-1))), F.lower(F.left(F.try_element_at(w, F.lit(1)), F.lit(1)))
    return F.when(F.size(w) == 0, F.lit("")).when(F.size(w) == 1, last).otherwise(F.concat(last, F.lit("_"), first))


def _joined(last: Column, rest: Column) -> Column:
    return F.when(rest == "", last).otherwise(F.concat(last, F.lit("_"), rest))


def fini_key(raw, last="", first="") -> Column:
    """Surname and first initial."""
    raw, last, first = normalize_string(raw), text(last), text(first)
    comma, w = F.split(raw, ","), F.split(raw, " ")
    parsed = _joined(normalize_string(last), F.left(normalize_string(first), F.lit(1)))
    by_comma = _joined(F.trim(comma[0]), F.left(F.trim(F.coalesce(F.try_element_at(comma, F.lit(2)), F.lit(""))), F.lit(1)))
    by_order = F.when(F.size(w) == 1, w[0]).otherwise(_joined(F.element_at(w, -1), F.left(w[0], F.lit(1))))
    return F.when((last != "") & (first != ""), parsed).when(raw == "", F.lit("")).when(F.contains(raw, F.lit(",")), by_comma).otherwise(by_order)


def _initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda p: F.left(p, F.lit(1))), "")


def aini_key(raw, last="", first="") -> Column:
    """Surname and all initials; hyphens part given names where they are parsed or follow a comma."""
    raw, last, first = normalize_string(raw), text(last), text(first)
    comma, w = F.split(raw, ","), F.split(raw, " ")
    spaced = lambda c: F.replace(c, F.lit("-"), F.lit(" "))
    parsed = _joined(normalize_string(last), _initials(tokens(spaced(normalize_string(first)))))
    by_comma = _joined(F.trim(comma[0]), _initials(tokens(spaced(F.coalesce(F.try_element_at(comma, F.lit(2)), F.lit(""))))))
    by_order = F.when(F.size(w) == 1, w[0]).otherwise(_joined(F.element_at(w, -1), _initials(F.slice(w, F.lit(1), F.size(w) - 1))))
    return F.when(last != "", parsed).when(raw == "", F.lit("")).when(F.contains(raw, F.lit(",")), by_comma).otherwise(by_order)


def heuristic_key(raw, last="", first="") -> Column:
    """Surname and first initial as the affiliation-gated baseline has it."""
    w = tokens(raw)
    own_last, own_first = F.lower(F.trim(text(last))), F.lower(F.trim(text(first)))
    from_raw = (own_last == "") & (F.size(w) > 0)
    surname_ = F.when(from_raw, F.lower(F.try_element_at(w, F.lit(-1)))).otherwise(own_last)
    given = F.when(from_raw, F.when(F.size(w) > 1, F.lower(F.try_element_at(w, F.lit(1)))).otherwise("")).otherwise(own_first)
    return F.btrim(F.concat(surname_, F.lit("_"), F.left(given, F.lit(1))), F.lit("_"))


def affiliation_tokens(c) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_plain(c), " "), lambda t: F.length(t) > 2))


def block_string(c) -> Column:
    """Lower case, blanks to underscores, 30 characters."""
    return F.substring(F.replace(F.lower(text(c)), F.lit(" "), F.lit("_")), 1, 30)


def full_name(given, family) -> Column:
    """``given family``, either, or ``Unknown Author``."""
    joined = F.trim(F.concat_ws(" ", F.nullif(F.trim(text(given)), F.lit("")), F.nullif(F.trim(text(family)), F.lit(""))))
    return either(joined, F.lit("Unknown Author"))


def percent(c: Column, places: int = 1) -> Column:
    return F.format_number(c * 100, places)


def mention_id(doi: Column, index: Column, name: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", doi, index.cast("string"), name)), 1, 12)


def salted_hash(c, salt: str, size: int = 16) -> Column:
    return F.substring(F.sha2(F.concat(text(c), F.lit("||" + salt)), 256), 1, size)


def script(c) -> Column:
    """latin, cyrillic or cjk if over 0.7 of such letters; mixed, other or empty."""
    c = text(c)
    counts = [F.length(F.regexp_replace(c, rf"[^{letters}]", "")) for letters in ("A-Za-zK", "А-Яа-я", "一-鿿")]
    total = counts[0] + counts[1] + counts[2]
    out = F.when(c == "", "empty").when(total == 0, "other")
    for n, name in zip(counts, ("latin", "cyrillic", "cjk"), strict=True):
        out = out.when(n / total > 0.7, name)
    return out.otherwise("mixed")


def redacted_name(c, salt: str) -> Column:
    """Hash and shape of a name."""
    return F.struct(salted_hash(c, salt).alias("hash"), F.size(tokens(c)).alias("tokens"), F.length(text(c)).alias("length"), script(c).alias("script"), F.rlike(text(c), F.lit(r"(?<![\p{L}\p{N}_])[A-Z]\.$")).alias("has_initial"))
