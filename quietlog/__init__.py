"""Log quality analytics on Spark: rule findings and repeated messages of log lines."""

from quietlog.operators.duplicates import (
    concat_entries, duplicate_overview, find_duplicates, find_filewise_duplicates, first_examples,
    order_filewise, order_groups,
)
from quietlog.operators.component_rules import frequency_findings, mention_findings, threshold_findings
from quietlog.operators.findings import (
    category, count_ignored, emit_findings, summarize, summarize_lines, with_ignored, without_ignored,
)
from quietlog.operators.history import (
    append_history, get_analysis, history_totals, read_history, recent_history, stored_findings,
)
from quietlog.operators.testruns import (
    issue_totals, join_test_findings, parse_test_listing, status_counts, test_status,
)
from quietlog.plans.jobs import (
    analyze, analyze_components, analyze_files, find_filewise_repeats, find_filewise_repeats_in, find_repeats,
    find_repeats_in, record_analysis, report_from_history, summarize_test_runs,
)
from quietlog.rules import (
    ComponentRule, Components, Rules, component_rules_table, declared_rules, load_components, load_rules, parse_components, rules_table, save_rules, validate_rules,
)
from quietlog.session import build_session, drop_scratch
from quietlog.sources.archives import (
    read_archive_entries, read_archive_stats, read_filewise_entries, read_members,
)
from quietlog.sources.lines import (
    read_entries, read_family_entries, read_line_stats, read_log_lines, read_rotated,
)

__all__ = [name for name in dir() if not name.startswith("_")]
