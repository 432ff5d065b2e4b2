"""Text columns: trimming, tokens, identifiers and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode, which Java's \s alone does not cover.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: Column) -> Column:
    """Text without Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column) -> Column:
    """Runs of a-z0-9 of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def canonical_key(name: Column) -> Column:
    """Lower-case letters and digits of a name: equal for all its spellings by case, blanks and hyphens."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def entity_id(project: Column, name: Column) -> Column:
    return F.substring(F.md5(F.concat(project, F.lit(":"), canonical_key(name))), 1, 12)


def chunk_id(doc_id: Column, idx: Column) -> Column:
    return F.md5(F.concat(doc_id, F.lit(":"), idx))


def note_doc_id(source: Column, text: Column) -> Column:
    """Identifier of a note: a hash of its source and first 256 characters."""
    return F.substring(F.sha2(F.concat(source, F.lit(":"), F.substring(text, 1, 256)), 256), 1, 16)


def path_doc_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def fingerprint(text: Column) -> Column:
    """First 16 hex digits of a text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


#: Terms of a question (fixed patterns with their groups): CamelCase words, capitalised words, back-tick spans.
TERM_PATTERNS = (
    (r"(?U)\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", 0),
    (r"(?U)\b[A-Z][a-zA-Z]+\b", 0),
    (r"`([^`]+)`", 1),
)


def query_terms(query: Column) -> Column:
    """Distinct terms of a query in order: CamelCase words, capitalised words, back-tick spans."""
    parts = [F.regexp_extract_all(query, F.lit(p), F.lit(g)) for p, g in TERM_PATTERNS]
    return F.array_distinct(F.concat(*parts))
