"""Secret redaction as an ordered chain of regular-expression replacements.

Later rules see the replacements of earlier ones.  All classes are Unicode-aware
(``(?U)``), and everything stays inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (pattern, replacement) in the order of application.
RULES = (
    (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "[redacted:private-key]"),
    (r"(?U)\b[Bb]earer\s+[A-Za-z0-9._~+/-]+=*", "[redacted:bearer]"),
    (r"(?U)\bsk-[A-Za-z0-9_-]{16,}", "[redacted:secret-key]"),
    (r"(?U)\bA(?:KIA|SIA)[0-9A-Z]{16}\b", "[redacted:aws-key]"),
    (r"(?U)\bgh[pousr]_[A-Za-z0-9]{36,}", "[redacted:github-token]"),
    (r"(?U)\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "[redacted:jwt]"),
    (
        r"(?iU)\b(password|passwd|pwd|token|api_?key|secret|auth)\b[\"']?\s*[:=]\s*"
        r"(?:\"(?!\[redacted:)[^\"\n]{8,}\"|'(?!\[redacted:)[^'\n]{8,}'|(?!\[redacted:)[^\s\"'&\[\]]{8,})",
        "$1=[redacted:credential]",
    ),
    (r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}(?![0-9A-Fa-f])", "[redacted:token]"),
    # a run of base64 characters counts only with a digit in it
    (r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/=])", "[redacted:token]"),
)


#: What a text has that a rule matches: one of these as it stands, ...
_MARKS = ("-----BEGIN", "earer", "sk-", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "eyJ")
#: ... one of these in lower case and an assignment (the two letters fold to s and k), ...
_NAMES = ("password", "passwd", "pwd", "token", "apikey", "api_key", "secret", "auth", "\u017f", "\u212a")
#: ... or a run of twenty such characters.
_RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20}"


def may_match(text: Column) -> Column:
    """Whether a rule may match: substring looks, and one pass for long runs; most texts end here."""
    any_of = lambda body, marks: reduce(Column.__or__, [F.contains(body, F.lit(m)) for m in marks])
    assigned = F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))
    return any_of(text, _MARKS) | (assigned & any_of(F.lower(text), _NAMES)) | text.rlike(_RUN)


def redact(text: Column) -> Column:
    """``text`` with secrets replaced; null stays null."""
    safe = text
    for pattern, replacement in RULES:
        safe = F.regexp_replace(safe, pattern, replacement)
    return F.when(may_match(text), safe).otherwise(text)


def redaction_count(text: Column) -> Column:
    """How many replacements redact() makes, counted on the evolving text."""
    total, safe = F.lit(0), text
    for pattern, replacement in RULES:
        total = total + F.regexp_count(safe, F.lit(pattern))
        safe = F.regexp_replace(safe, pattern, replacement)
    return F.when(text.isNull() | may_match(text), total).otherwise(0)
