"""Rule findings of log lines and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlog import fixed_values as fv
from quietlog.functions import features as ft
from quietlog.rules import Components, Rules

FINDING_COLUMNS = ["category", "file", "line", "plugin", "reason", "log"]


def with_level(lines: DataFrame, profile: str = "cli") -> DataFrame:
    """Adds ``dated`` (the line opens with a timestamp) and, for dated lines, ``level``.

    Numbering must have happened before. ``_lower`` and ``_ascii`` are for the checks to
    share. Undated lines are marked, not filtered: a filter would be pushed below
    whatever the line text comes from, and work it out twice.
    """
    log, dated = F.col("log"), F.col("dated")
    return lines.withColumn("dated", ft.has_timestamp(log, profile)).select(
        "*", F.when(dated, ft.detect_level(log, profile)).alias("level"),
        F.when(dated, F.lower(log)).alias("_lower"), ft.is_ascii(log).alias("_ascii"),
    )


def with_flags(lines: DataFrame, rules: Rules, profile: str = "cli") -> DataFrame:
    """Every line with its level and three booleans, all false for an undated line."""
    level, lower = F.col("level"), F.col("_lower")
    checks = {
        fv.NOISY: ft.is_noisy(level, rules),
        fv.SENSITIVE: ft.is_sensitive(F.col("log"), rules, lower, F.col("_ascii")),
        fv.SEVERITY: ft.violates_severity(lower, level, rules),
    }
    flags = [(F.col("dated") & check).alias(c) for c, check in checks.items()]
    return with_level(lines, profile).select(*lines.columns, "level", *flags)


def emit_findings(
    lines: DataFrame, rules: Rules, profile: str = "cli", redaction: str = "off",
    components: Components | None = None,
) -> DataFrame:
    """One row per (line, category) that applies; one narrow pass over the lines.

    The checks run once per line in a projection of their own below the generator (inside
    it they are twice as slow), and the component is worked out for findings only.
    """
    flagged = with_flags(lines.select("file", "line", "log"), rules, profile)
    hits = F.array(*[F.when(F.col(c), F.lit(c)) for c in fv.CATEGORIES])
    exploded = flagged.select("file", "line", "log", "level", F.explode(hits).alias("category"))
    found = ft.with_component(exploded.filter(F.col("category").isNotNull()), components=components)
    why = ft.reason(F.col("category"), F.col("level"), F.col("plugin"), rules, profile)
    shown = ft.redact(F.col("log"), rules, redaction).alias("log")
    return found.select("category", "file", "line", "plugin", why.alias("reason"), shown)


def with_ignored(findings: DataFrame, rules: Rules) -> DataFrame:
    """Adds ``ignored_by``: the first ignore pattern of the rules found in the finding's line, or null."""
    return findings.withColumn("ignored_by", ft.ignored_by(F.col("log"), rules.ignore_patterns))


def without_ignored(findings: DataFrame, rules: Rules) -> DataFrame:
    """Findings in lines that no ignore pattern of the rules matches; one narrow filter."""
    return findings.filter(ft.ignored_by(F.col("log"), rules.ignore_patterns).isNull())


def count_ignored(findings: DataFrame, rules: Rules) -> DataFrame:
    """``(category, ignored_by, n)``: findings that the ignore patterns suppress, counted map-side."""
    marked = with_ignored(findings, rules).filter(F.col("ignored_by").isNotNull())
    return marked.groupBy("category", "ignored_by").agg(F.count(F.lit(1)).alias("n"))


def category(findings: DataFrame, name: str) -> DataFrame:
    """The list of one category."""
    return findings.filter(F.col("category") == name).select("file", "line", "plugin", "reason", "log")


def _count_columns() -> list:
    n = [F.count_if(F.col("category") == c).alias(f"{c}_count") for c in fv.CATEGORIES]
    return [*n, F.count(F.col("category")).alias("total_issues")]


def summarize(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Counts per file; a file of ``files`` without findings gets zeros."""
    counts = findings.groupBy("file").agg(*_count_columns())
    counted = [F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns if c != "file"]
    return files.select("file").join(counts, "file", "left").select("file", *counted)


def summarize_lines(
    lines: DataFrame, rules: Rules, profile: str = "cli", keys: list[str] | None = None
) -> DataFrame:
    """The same counts straight from the lines: one scan, no join, map-side counting."""
    keys = keys or ["file"]
    flagged = with_flags(lines, rules, profile)
    sums = [F.count_if(F.col(c)).alias(f"{c}_count") for c in fv.CATEGORIES]
    total = sum((F.col(f"{c}_count") for c in fv.CATEGORIES), F.lit(0)).cast("bigint")
    return flagged.groupBy(*keys).agg(*sums).withColumn("total_issues", total)
