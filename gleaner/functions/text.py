"""Text, hash, date and number helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\u001f"


def squeeze(text: Column) -> Column:
    """White space (Unicode) collapsed to single spaces, ends stripped."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def claim_norm(text: Column) -> Column:
    return squeeze(F.lower(text))


def claim_hash(text: Column) -> Column:
    return F.sha2(claim_norm(text), 256)


def event_id(session: Column, redacted: Column) -> Column:
    """Identity of a statement: session, unit separator, squeezed redacted text."""
    return F.sha2(F.concat(F.coalesce(session, F.lit("")), F.lit(UNIT), squeeze(redacted)), 256)


def project_slug(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 12)


def claim_tokens(text: Column) -> Column:
    """ASCII words of two characters or more, lower-cased, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) >= 2)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard ratio of two token arrays as sets; 0.0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


#: Inline markup in the order of removal.
MARKUP = (
    (r"<!--.*?-->", ""),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\*{2,}(.+?)\*{2,}|__(.+?)__", "$1$2"),
    (r"\*(.+?)\*|_(.+?)_", "$1$2"),
    (r"``(.*?)``|`(.*?)`", "$1$2"),
    (r" {2,}", " "),
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_markup(text: Column) -> Column:
    for pattern, replacement in MARKUP:
        text = F.regexp_replace(text, pattern, replacement)
    return strip(text)


#: Fixed value: a list marker and what follows it.
LIST_ITEM = r"(?U)^(\s*)([-*+]|\d+[.)])(\s+)(.*)$"


def claim_text(raw: Column) -> Column:
    """A memory line without its list marker and inline markup."""
    body = F.when(raw.rlike(LIST_ITEM), F.regexp_extract(raw, LIST_ITEM, 4)).otherwise(strip(raw))
    return strip_markup(body)


def clip(text: Column, width: int) -> Column:
    """At most ``width`` characters, the last an ellipsis if any are cut."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, width - 1)), F.lit("…")))


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n|\r|\n", " ")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def fact_confidence(durable: Column) -> Column:
    return clamp01(2 * F.abs(durable - 0.5))


LEVELS = ("trivial", "useful", "important", "critical")
CATEGORIES = ("preference", "tooling", "architecture", "pitfall", "convention", "none")


def significance_word(x: Column) -> Column:
    """The level's word; halves round to even."""
    level = F.greatest(F.lit(0), F.least(F.lit(3), F.bround(x, 0).cast("int")))
    return F.element_at(F.array(*map(F.lit, LEVELS)), level + 1)


STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def parse_stamp(text: Column) -> Column:
    return F.to_timestamp(text, STAMP)


def days_between(now: Column, then: Column) -> Column:
    """Whole days elapsed, not calendar days."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400)


def is_stale(now: Column, then: Column, days: int = 30) -> Column:
    return days_between(now, then) > days


def vintage(ts: Column) -> Column:
    return F.date_format(ts, "MMM d")


def token_estimate(chars: Column) -> Column:
    return F.ceil(chars / 4).cast("bigint")


def plural(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + one), F.when(n == 1, "").otherwise("s"))
