"""PII regular expressions and the match predicate."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The eight PII patterns, verbatim, in the reference's order.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "url": r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "date": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{1,2}-\d{1,2}\b",
    "name": r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
}
# A type is reported for a column when more than this percentage of values match.
PII_THRESHOLD_PCT = 5.0
# The profile scans the first this-many non-missing values of each text column.
PII_SAMPLE_SIZE = 100
# Types that make a column high-risk.
HIGH_RISK_TYPES = ("ssn", "credit_card")
# Recommendation texts, in the order they are listed.
PII_REC_DETECTED = "PII data detected in your dataset"
PII_REC_HIGH_RISK = "High-risk PII detected in columns: "
PII_REC_ANONYMIZE = "Consider anonymizing or removing these columns"
PII_REC_COMPLIANCE = "Review data privacy compliance requirements"
# ---------------------------------------------------------------------------

PII_TYPES = list(PII_PATTERNS)

# Literals every match of a pattern must contain (read off the patterns): a
# cheap ``instr`` test skips the regex on values that cannot match.
REQUIRED_LITERALS = {
    "email": ["@"],
    "url": ["http"],
    "ssn": ["-"],
    "ip_address": ["."],
    "date": ["/", "-"],
}


def java_pattern(pii_type: str) -> str:
    # Python's \d, \s and \b are Unicode-aware; (?U) makes Java's the same.
    return "(?U)" + PII_PATTERNS[pii_type]


def pii_match(col, pii_type: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    match = c.rlike(java_pattern(pii_type))
    needs = REQUIRED_LITERALS.get(pii_type)
    if not needs:
        return match
    possible = functools.reduce(operator.or_, [F.instr(c, lit) > 0 for lit in needs])
    return F.when(possible, match).otherwise(F.when(c.isNotNull(), F.lit(False)))
