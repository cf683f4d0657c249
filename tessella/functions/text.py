"""Text expressions: counts, tokens, sentences, byte-wise edit distance, entity patterns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a fixed string; an empty needle has none."""
    if not needle:
        return F.lit(0)
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def overlapping(text: Column, needle: str) -> Column:
    """Occurrences of a fixed string, overlapping ones too; an empty needle has none."""
    return F.regexp_count(text, F.lit(f"(?={re.escape(needle)})")).cast("int") if needle else F.lit(0)


def white_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_extract_all(text, F.lit(r"([^ \t\n\r\f\x0B]+)"), F.lit(1))


def alnum_words(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def trimmed(word: Column) -> Column:
    """A word without ASCII punctuation at its ends."""
    return F.regexp_replace(word, r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "")


def sentences(text: Column) -> Column:
    """Sentences with their terminator, trimmed; those of at most one character are dropped."""
    cut = F.regexp_extract_all(text, F.lit(r"([^.!?]*[.!?]|[^.!?]+$)"), F.lit(1))
    return F.filter(F.transform(cut, lambda s: F.regexp_replace(s, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")), lambda s: F.octet_length(s) > 1)


def byte_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over UTF-8 bytes."""
    return F.levenshtein(*(F.decode(F.encode(x, "UTF-8"), "ISO-8859-1") for x in (a, b)))


def collapse(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def any_of(text: Column, needles: list[str]) -> Column:
    """Whether a text holds any of these strings."""
    return reduce(lambda a, b: a | b, (text.contains(n) for n in needles))


#: Fixed patterns and confidences of the entity kinds, in the order in which they claim a match.
ENTITIES = [
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0.95),
    ("URL", r"https?://[^\s,;)]+", 0.95),
    ("DATE", r"\d{4}-\d{2}-\d{2}", 0.80),
    ("PHONE", r"\+?[\d\- \(\)]{7,20}", 0.85),
    ("DATE", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},?\s*\d{4}\b", 0.80),
    ("TIME", r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?\b", 0.80),
    ("MONEY", r"\$\s?\d+(?:,\d{3})*(?:\.\d{1,2})?", 0.85),
    ("PERCENT", r"\b\d+(?:\.\d+)?\s*%", 0.85),
    ("PERSON", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}", 0.60),
]

#: Fixed keyword weights of the text categories; ties go to the category that comes first.
CATEGORIES = {
    "technical": {"code": 3.0, "function": 2.5, "api": 2.5, "implementation": 2.0, "algorithm": 2.5, "system": 1.5, "architecture": 2.0, "database": 2.0, "server": 1.5, "deploy": 1.5, "config": 1.5, "library": 2.0, "dependency": 1.5, "interface": 2.0, "protocol": 2.0},
    "business": {"revenue": 3.0, "profit": 2.5, "market": 2.0, "customer": 2.0, "growth": 2.0, "strategy": 2.0, "investment": 2.0, "enterprise": 1.5, "valuation": 2.5, "acquisition": 2.5},
    "science": {"research": 3.0, "study": 2.0, "experiment": 2.5, "analysis": 2.0, "hypothesis": 2.5, "theory": 2.0, "publication": 2.0, "laboratory": 2.0, "clinical": 2.5, "observation": 1.5},
    "security": {"vulnerability": 3.0, "exploit": 3.0, "attack": 2.5, "threat": 2.5, "malware": 3.0, "encryption": 2.0, "authentication": 2.0, "firewall": 2.0, "breach": 3.0, "penetration": 2.5, "cve": 3.0, "zero-day": 3.0},
}
CATEGORY_THRESHOLD = 0.3

#: Fixed phrases of the English-Spanish table, replaced in this order.
PHRASES = {"hello": "hola", "error": "error", "warning": "advertencia", "success": "éxito", "file": "archivo", "directory": "directorio", "system": "sistema", "network": "red", "database": "base de datos", "server": "servidor"}


def entity_counts(text: Column) -> dict[str, Column]:
    """Matches of each entity kind's patterns."""
    found: dict[str, Column] = {}
    for kind, pattern, _ in ENTITIES:
        n = F.size(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
        found[kind] = found[kind] + n if kind in found else n
    return found


def category_scores(text: Column, categories: dict[str, dict[str, float]] | None = None) -> dict[str, Column]:
    """Weighted keyword counts by words of a text in lower case, for each category."""
    words = F.greatest(F.size(white_words(text)), F.lit(1))
    return {name: reduce(lambda a, b: a + b, (occurrences(text, k) * w for k, w in keywords.items())) / words for name, keywords in (categories or CATEGORIES).items()}


def classified(df: DataFrame, text: str, threshold: float = CATEGORY_THRESHOLD, categories: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Adds category and confidence: the best category at or above the threshold, or unknown with 0.

    Scores and their maximum are columns of their own on the way, so that no
    count is computed twice.
    """
    scores = category_scores(F.col("_low"), categories)
    names = list(scores)
    out = df.withColumn("_low", F.lower(text)).withColumns({f"_score_{n}": s for n, s in scores.items()})
    out = out.withColumn("confidence", F.greatest(*(F.col(f"_score_{n}") for n in names)) if len(names) > 1 else F.col(f"_score_{names[0]}"))
    label = F.lit("unknown")
    for n in reversed(names):
        label = F.when(F.col(f"_score_{n}") == F.col("confidence"), n).otherwise(label)
    known = F.col("confidence") >= threshold
    out = out.withColumns({"category": F.when(known, label).otherwise("unknown"), "confidence": F.when(known, F.col("confidence")).otherwise(0.0)})
    return out.drop("_low", *(f"_score_{n}" for n in names))


def translate(text: Column, phrases: dict[str, str] | None = None) -> Column:
    """struct(text, confidence): fixed phrases replaced in order; the share of words that phrases were found for."""
    out, hits = text, F.lit(0)
    for phrase, other in (phrases or PHRASES).items():
        hits = hits + out.contains(phrase).cast("int")
        out = F.replace(out, F.lit(phrase), F.lit(other))
    return F.struct(out.alias("text"), (hits / F.greatest(F.size(white_words(text)), F.lit(1))).alias("confidence"))


def positions(text: Column, needle: str) -> Column:
    """Where a fixed string occurs, overlapping occurrences too, as byte offsets from 0."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, len(needle)) == needle)
    return F.transform(at, lambda i: F.octet_length(F.substring(text, F.lit(1), i - 1)))
