"""Test listings, test results and their log quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlog import fixed_values as fv
from quietlog.functions.text import strip
from quietlog.operators.ordering import forward_fill

COUNTS = [f"{c}_count" for c in fv.CATEGORIES]


def fill_suite(lines: DataFrame) -> DataFrame:
    """Adds to ``(listing, line, text)`` the suite each line stands under.

    A line that ends with a dot opens a suite, indented or not.
    """
    entry = strip(F.col("text"))
    opens = F.when(entry.endswith("."), F.substring(entry, F.lit(1), F.length(entry) - 1))
    marked = lines.withColumn("_opens", opens)
    return forward_fill(marked, "_opens", [F.col("line")], ["listing"], name="suite")


def parse_test_listing(lines: DataFrame) -> DataFrame:
    """``(listing, line, suite, test, full_name)`` of the cases in test listings."""
    cases = fill_suite(lines).filter(
        F.col("_opens").isNull() & F.col("text").startswith("  ") & (F.col("suite") != "")
    )
    test = strip(F.col("text"))
    return cases.filter(test != "").select(
        "listing", "line", "suite", test.alias("test"), F.concat_ws(".", "suite", test).alias("full_name")
    )


def test_status(return_code: Column, outcome: Column | None = None) -> Column:
    """``PASSED``, ``FAILED``, ``TIMEOUT`` or ``ERROR: …``.

    ``outcome`` is null for a finished run, ``timeout``, or the text of the error.
    """
    finished = F.when(return_code == 0, "PASSED").otherwise("FAILED")
    if outcome is None:
        return finished
    return (
        F.when(outcome == "timeout", "TIMEOUT")
        .when(outcome.isNotNull(), F.concat(F.lit("ERROR: "), outcome))
        .otherwise(finished)
    )


def stopped_code(return_code: Column, outcome: Column) -> Column:
    """A run that did not finish has return code -1."""
    return F.when(outcome.isNotNull(), -1).otherwise(return_code)


def join_test_findings(tests: DataFrame, counts: DataFrame) -> DataFrame:
    """Tests with the counts of their log, total and issue band.

    ``counts`` has one row per log that has lines. A test with no log or an empty one
    keeps nulls, which is not the same as a log without issues.
    """
    joined = tests.join(
        counts.select(F.col("file").alias("log_file"), *COUNTS), "log_file", "left"
    )
    total = sum((F.col(c) for c in COUNTS), F.lit(0)).cast("bigint")
    return joined.withColumn("total_issues", total).withColumn("band", issue_band(F.col("total_issues")))


def issue_band(total: Column) -> Column:
    return (
        F.when(total > fv.HIGH_ISSUES_ABOVE, "high")
        .when(total > fv.MEDIUM_ISSUES_ABOVE, "medium")
        .when(total.isNotNull(), "low")
    )


def status_counts(tests: DataFrame) -> DataFrame:
    """``(total, passed, failed, errors)``; whatever is neither passed nor failed is an error."""
    status = F.col("status")
    passed, failed = F.count_if(status == "PASSED"), F.count_if(status == "FAILED")
    total = F.count(F.lit(1))
    return tests.agg(
        total.alias("total"),
        passed.alias("passed"),
        failed.alias("failed"),
        (total - passed - failed).alias("errors"),
    )


def issue_totals(results: DataFrame) -> DataFrame:
    """Sums per category and overall; tests without log data add nothing."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    return results.agg(*sums).withColumn(
        "total_issues", sum((F.col(c) for c in COUNTS), F.lit(0)).cast("bigint")
    )
