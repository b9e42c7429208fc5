"""Text helpers as Columns: trimming, decoding, escaping, small display formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietlog import fixed_values as fv

# U: Unicode aware classes, boundaries and case folding. d: only \n ends a line for "." and "$".
REGEX_FLAGS = "(?Ud)"


def pattern(body: str, flags: str = REGEX_FLAGS) -> str:
    """A regex literal with the flags every pattern of this library runs under."""
    return flags + body


def strip(c: Column) -> Column:
    """Remove white space on both ends, Unicode aware."""
    return F.regexp_replace(c, pattern(f"^{fv.SPACE}+|{fv.SPACE}+\\z"), "")


def rstrip(c: Column) -> Column:
    """Remove trailing white space, Unicode aware."""
    return F.regexp_replace(c, pattern(f"{fv.SPACE}+\\z"), "")


def is_blank(c: Column) -> Column:
    """Whether nothing but white space is left; cheaper than comparing a stripped copy."""
    return ~c.rlike(pattern(r"[^\s\x1c-\x1f]"))


def drop_bad_bytes(c: Column) -> Column:
    """String with undecodable bytes left out (a genuine U+FFFD goes too when there are any)."""
    cleaned = F.replace(F.make_valid_utf8(c), F.lit(fv.REPLACEMENT_CHAR), F.lit(""))
    return F.when(F.is_valid_utf8(c), c).otherwise(cleaned)


def decode_bounded(content: Column, limit: int | None = None) -> Column:
    """A binary column as text, bad bytes as U+FFFD; only its first ``limit`` bytes if one is given."""
    head = content if limit is None else F.substring(content, 1, limit)
    return F.make_valid_utf8(head.cast("string"))


def html_escape(c: Column, quotes: bool = True) -> Column:
    """Escape ``& < >`` and, unless ``quotes`` is off, both quote characters."""
    entities = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    if quotes:
        entities += [('"', "&quot;"), ("'", "&#x27;")]
    for char, entity in entities:
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def base_name(path: Column) -> Column:
    """Last part of a slash separated path."""
    return F.element_at(F.split(path, "/"), -1)


def safe_name(name: Column) -> Column:
    """A test name that can stand in a file name."""
    return F.translate(name, "/.", "__")


def report_name(name: Column) -> Column:
    return F.concat(F.lit("report_"), safe_name(name), F.lit(".html"))


def test_log_name(name: Column) -> Column:
    return F.concat(F.lit("gtest_log_"), safe_name(name), F.lit(".txt"))


def display_time(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` from an ISO text or a timestamp."""
    return F.replace(F.substring(ts.cast("string"), 1, 19), F.lit("T"), F.lit(" "))
