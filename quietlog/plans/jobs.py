"""The jobs a user runs: analyse logs, find repeats, summarise test runs, keep a history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog.functions.features import redact
from quietlog.functions.text import base_name, report_name
from quietlog.operators import component_rules as comp
from quietlog.operators import duplicates as dup
from quietlog.operators import findings as fnd
from quietlog.operators import history as hist
from quietlog.operators import testruns as tr
from quietlog.rules import Components, Rules, component_rules_table, declared_rules
from quietlog.session import as_lookup, cut
from quietlog.sinks import reports as rep
from quietlog.sources import archives, lines as src


def analyze(
    lines: DataFrame, rules: Rules | None = None, profile: str = "cli", redaction: str = "off",
    components: Components | None = None, ignore: bool = False,
) -> DataFrame:
    """Findings ``(category, file, line, plugin, reason, log)`` of log lines.

    ``ignore`` leaves out findings in lines that an ignore pattern of the rules matches.
    """
    rules = rules or Rules()
    # lines are shown as they are while patterns are searched, redacted afterwards
    found = fnd.emit_findings(lines, rules, profile, "off" if ignore else redaction, components)
    if not ignore:
        return found
    return fnd.without_ignored(found, rules).withColumn("log", redact(F.col("log"), rules, redaction))


def analyze_components(
    lines: DataFrame, rules: Rules | None = None, profile: str = "cli", components: Components | None = None
) -> DataFrame:
    """Findings of the rules per component: states, events, operations, readings out of bounds
    and operations that come too often."""
    rules = rules or declared_rules()
    table = component_rules_table(lines.sparkSession, rules)
    return (
        comp.mention_findings(lines, table, profile, components)
        .unionByName(comp.threshold_findings(lines, table, profile, components).drop("value"))
        .unionByName(comp.frequency_findings(lines, table, profile, components).drop("at_micros", "n", "within"))
    )


def analyze_files(
    spark: SparkSession, path: str, report_path: str | None = None,
    rules: Rules | None = None, profile: str = "cli", redaction: str = "off",
    components: Components | None = None,
) -> DataFrame:
    """Findings of the log files under a path; writes one HTML report per file if asked to.

    A report's folder is named by the file and a hash of its path.
    """
    findings = analyze(src.read_log_lines(spark, path), rules, profile, redaction, components)
    if report_path:
        findings = cut(findings, "findings")  # the checks run once, counts and report read the table
        report = rep.findings_report(findings, fnd.summarize(findings, src.file_names(spark, path)), profile)
        rep.write_report(_named_by_file(report), report_path, ["section", "part", "line"], by="report")
    return findings


def _named_by_file(report: DataFrame) -> DataFrame:
    """Equal names in different folders stay apart."""
    name = F.concat(base_name(F.col("file")), F.lit("-"), F.substring(F.sha2("file", 256), 1, 8))
    return report.withColumn("report", name)


def find_repeats(
    entries: DataFrame, stats: DataFrame | None = None, report_path: str | None = None
) -> DataFrame:
    """Ranked global duplicate groups; writes the HTML report if asked to."""
    if report_path:
        # groups, examples and counts all need the keys: write them once
        entries = cut(dup.with_key(entries), "keyed")
    groups = dup.find_duplicates(entries)
    if report_path:
        groups = cut(groups, "groups")
        if stats is None:
            stats = entries.select(F.lit("ok").alias("status")).groupBy("status").agg(F.count("*").alias("n"))
        report = rep.duplicates_report(
            dup.first_examples(entries, groups), dup.duplicate_overview(entries, groups), stats
        )
        rep.write_duplicates_report(report, report_path)
    return dup.order_groups(groups)


def _archives_below(spark: SparkSession, paths: str | list[str]) -> bool:
    listed = spark.read.format("binaryFile").option("pathGlobFilter", archives.ARCHIVE_GLOB).load(paths)
    return not listed.select("path").isEmpty()


def find_repeats_in(spark: SparkSession, path: str, report_path: str | None = None) -> DataFrame:
    """Global duplicates of a (rotated set of) log file(s), a folder, or archives.

    Plain files are read in splits, files with the name of an archive by the archive
    reader; all of them whole. The lines of archives count behind those of plain files.
    """
    paths = src.rotated_paths(spark, path)
    entries = src.read_entries(spark, path)
    stats = src.read_line_stats(spark, paths) if report_path else None
    if _archives_below(spark, paths):
        entries = dup.concat_entries(entries, archives.read_archive_entries(spark, paths, glob=archives.ARCHIVE_GLOB))
        if report_path:
            both = stats.unionByName(archives.read_archive_stats(spark, paths, glob=archives.ARCHIVE_GLOB))
            stats = both.groupBy("status").agg(F.sum("n").alias("n"))
    return find_repeats(entries, stats, report_path)


def find_filewise_repeats(entries: DataFrame, report_path: str | None = None) -> DataFrame:
    """Ranked duplicates per rotation family; writes the HTML report if asked to."""
    groups = dup.find_filewise_duplicates(entries)
    if report_path:
        groups = cut(groups, "groups")
        rep.write_filewise_report(rep.filewise_report(groups), report_path)
    return dup.order_filewise(groups)


def find_filewise_repeats_in(spark: SparkSession, path: str, report_path: str | None = None) -> DataFrame:
    """Duplicates per family of a (rotated set of) log file(s), a folder, or archives, read whole."""
    paths = src.rotated_paths(spark, path)
    entries = src.read_family_entries(spark, path)
    if _archives_below(spark, paths):
        entries = dup.concat_entries(entries, archives.read_filewise_entries(spark, paths, archives.ARCHIVE_GLOB))
    return find_filewise_repeats(entries, report_path)


def summarize_test_runs(
    tests: DataFrame, lines: DataFrame, rules: Rules | None = None, report_path: str | None = None
) -> DataFrame:
    """Tests with the issue counts of their logs.

    ``tests`` is ``(test_name, return_code, status, log_file)``, the logs lie in ``lines``.
    With a path, writes the consolidated report to ``summary`` and one report per test
    that has log lines to ``tests``.
    """
    rules = rules or Rules()
    if report_path:
        findings = cut(analyze(lines, rules), "findings")  # the checks run once, counts and reports read the table
        counts = cut(fnd.summarize(findings, lines.select("file").distinct()), "counts")
    else:
        counts = fnd.summarize_lines(lines, rules)
    results = tr.join_test_findings(tests, counts)
    if report_path:
        report = rep.consolidated_report(results, tr.status_counts(tests), tr.issue_totals(results), "test_name")
        rep.write_report(report, f"{report_path}/summary", ["part", "test_name"])
        named = tests.select(F.col("log_file").alias("file"), report_name(F.col("test_name")).alias("report"), "test_name")
        # a log with any share of all lines stays spread over its tasks
        single = rep.findings_report(findings, counts).join(as_lookup(cut(named, "reports")), "file")
        # tests whose safe names are equal come one after another
        rep.write_report(single, f"{report_path}/tests", ["test_name", "section", "part", "line"], by="report")
    return results


def record_analysis(
    findings: DataFrame, summaries: DataFrame, history_path: str,
    run_id: str | None = None, at: datetime | None = None,
) -> None:
    """Append one history record per file and all its findings, of any number."""
    hist.append_history(summaries, history_path, run_id, at, findings)


def report_from_history(spark: SparkSession, history_path: str, run_id: str, report_path: str, profile: str = "web") -> None:
    """Write the report of a stored analysis anew."""
    summary = hist.get_analysis(hist.read_history(spark, history_path), run_id).withColumnRenamed("filename", "file")
    findings = hist.stored_findings(spark, history_path, run_id)
    report = rep.findings_report(findings, summary, profile)
    rep.write_report(_named_by_file(report), report_path, ["section", "part", "line"], by="report")
