"""Registered queries, one or more per operator, and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog import fixed_values as fv
from quietlog.functions import features as ft
from quietlog.functions import text as tx
from quietlog.functions.normalize import group_key, normalize, normalize_filewise
from quietlog.operators import component_rules as comp
from quietlog.operators import duplicates as dup
from quietlog.operators import findings as fnd
from quietlog.operators import history as hist
from quietlog.operators import testruns as tr
from quietlog.operators.ordering import row_numbers
from quietlog.plans import oracle as sql
from quietlog.plans import tables as tb
from quietlog.plans.jobs import analyze, find_filewise_repeats, find_repeats_in, record_analysis, summarize_test_runs
from quietlog.rules import Rules, component_rules_table, declared_rules, load_rules, parse_rules, save_rules
from quietlog.session import cut, scratch_path
from quietlog.sinks import reports as rep
from quietlog.sources import archives as arc
from quietlog.sources import lines as src
from quietlog.streaming import duplicates_stream as streaming

Query = Callable[[SparkSession, str], DataFrame]

RULES = Rules()
DECLARED_RULES = declared_rules()
CUSTOM_RULES = parse_rules(r"""
sensitive_patterns: ['\bpid=\d+', 'user\s*:']
failure_keywords: [slow, exception]
noisy_log_levels: [WARN]
required_severity_on_failure: []
""")
COUNTS = tr.COUNTS

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLE[name] = oracle
        return query

    return add


def per_line(name: str, column: Callable[[Column], Column], out: str, expression: str) -> None:
    """A query that shows one feature of every log line."""
    register(name, f"SELECT file, line, {expression} AS {out} FROM ({sql.LINES})")(
        lambda spark, sf: tb.log_lines(spark, sf).select("file", "line", column(F.col("log")).alias(out))
    )


# ---- line features -----------------------------------------------------------------

per_line("f1_ts_gate_cli", lambda log: ft.has_timestamp(log), "dated", sql.GATE_CLI)
per_line("f2_ts_gate_web", lambda log: ft.has_timestamp(log, "web"), "dated", sql.GATE_WEB)
per_line("f3_level_cli", lambda log: ft.detect_level(log), "level", sql.LEVEL_CLI)
per_line("f4_level_web", lambda log: ft.detect_level(log, "web"), "level", sql.LEVEL_WEB)


@register("f5_component", f"SELECT file, line, {sql.COMPONENT} AS plugin FROM ({sql.LINES})")
def f5(spark, sf):
    return ft.with_component(tb.log_lines(spark, sf)).select("file", "line", "plugin")


_SOURCE_FILE = f"regexp_extract(log, {sql.q(fv.SOURCE_FILE_TAG)}, 1)"


@register(
    "r4_component_lookup",
    f"""SELECT file, line, source_file, coalesce(m.component, 'other') AS component FROM
    (SELECT file, line, {_SOURCE_FILE} AS source_file FROM ({sql.LINES})) l
    LEFT JOIN (VALUES {sql.MAPPING}) m(name, component) ON l.source_file = m.name""",
)
def r4(spark, sf):
    lines = tb.log_lines(spark, sf).withColumn(
        "source_file", F.regexp_extract("log", tx.pattern(fv.SOURCE_FILE_TAG), 1)
    )
    found = ft.lookup_component(F.col("source_file"), F.lit("other"))
    return lines.select("file", "line", "source_file", found.alias("component"))


per_line("f9_noisy", lambda log: ft.is_noisy(ft.detect_level(log), RULES), "noisy",
         f"{sql.LEVEL_CLI} IN {sql.levels(RULES.noisy_log_levels)}")
per_line("f10_sensitive", lambda log: ft.is_sensitive(log, RULES), "sensitive", sql.sensitive(RULES))
per_line("f11_failure", lambda log: ft.has_failure(F.lower(log), RULES), "failure", sql.failure(RULES))
per_line("f12_severity", lambda log: ft.violates_severity(F.lower(log), ft.detect_level(log), RULES), "violates",
         f"({sql.failure(RULES)} AND {sql.LEVEL_CLI} NOT IN {sql.levels(RULES.required_severity_on_failure)})")
per_line("f14_redact", lambda log: ft.redact(log, RULES, "on"), "shown", sql.redacted(RULES))
per_line("f14_redact_off", lambda log: ft.redact(log, RULES), "shown", "log")


@register(
    "f10_sensitive_documents",
    f"SELECT doc_id, pos, {sql.sensitive(RULES, 'message', unicode_edges=True)} AS sensitive FROM ({sql.DOCUMENTS})",
)
def f10_documents(spark, sf):
    documents = tb.table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    lines = arc.explode_lines(documents, "text", ["doc_id"])
    return lines.select("doc_id", "pos", ft.is_sensitive(F.col("message"), RULES).alias("sensitive"))


@register(
    "f10_sensitive_pages",
    f"SELECT page_id, {sql.sensitive(RULES, 'html', unicode_edges=True)} AS sensitive FROM pages",
)
def f10_pages(spark, sf):
    return tb.table(spark, sf, "pages").select("page_id", ft.is_sensitive(F.col("html"), RULES).alias("sensitive"))


# ---- findings ------------------------------------------------------------------------


def _findings(profile: str, rules: Rules = RULES) -> Query:
    return lambda spark, sf: fnd.emit_findings(tb.log_lines(spark, sf), rules, profile)


register("r1_findings_cli", sql.findings(RULES))(_findings("cli"))
register("r1_findings_web", sql.findings(RULES, "web"))(_findings("web"))
register("s8_custom_rules", sql.findings(CUSTOM_RULES).replace("level NOT IN ()", "true"))(_findings("cli", CUSTOM_RULES))

for _profile in ft.PROFILES:
    register(
        f"f13_reason_{_profile}",
        f"SELECT category, reason, count(*) AS n FROM ({sql.findings(RULES, _profile)}) GROUP BY ALL",
    )(lambda spark, sf, p=_profile: _findings(p)(spark, sf).groupBy("category", "reason").agg(F.count("*").alias("n")))


@register("r2_noisy_only", f"SELECT file, line, plugin, reason, log FROM ({sql.findings(RULES)}) WHERE category = 'noisy'")
def r2(spark, sf):
    return fnd.category(fnd.emit_findings(tb.log_lines(spark, sf), RULES), fv.NOISY)


register("a1_summary", sql.summary(RULES))(
    lambda spark, sf: fnd.summarize_lines(tb.log_lines(spark, sf), RULES)
)


@register("a1_summary_from_findings", sql.summary(RULES, "web"))
def a1_join(spark, sf):
    lines = tb.log_lines(spark, sf)
    return fnd.summarize(fnd.emit_findings(lines, RULES, "web"), lines.select("file").distinct())


@register(
    "j1_findings_by_component",
    f"SELECT plugin, category, count(*) AS n FROM ({sql.findings(RULES)}) GROUP BY plugin, category",
)
def j1(spark, sf):
    return fnd.emit_findings(tb.log_lines(spark, sf), RULES).groupBy("plugin", "category").agg(F.count("*").alias("n"))


# ---- rules per component, ignore patterns -----------------------------------------------


def _ruled(operator: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf: operator(tb.component_lines(spark, sf), component_rules_table(spark, DECLARED_RULES), "web")


register("c1_component_mentions", sql.mentions(DECLARED_RULES))(_ruled(comp.mention_findings))
register("c2_component_thresholds", sql.thresholds(DECLARED_RULES))(_ruled(comp.threshold_findings))
register("c3_component_frequencies", sql.frequencies(DECLARED_RULES))(_ruled(comp.frequency_findings))
per_line("c4_event_micros", ft.event_micros, "at_micros", f"CASE WHEN {sql._stamp(4)} <> '' THEN {sql.EVENT_MICROS} END")

_IGNORABLE = sql.findings(DECLARED_RULES, source=f"{sql.COMPONENT_EVENTS} UNION ALL {sql.APP}")


def _ignorable(spark: SparkSession, sf: str) -> DataFrame:
    return tb.component_lines(spark, sf).unionByName(tb.app_lines(spark, sf))


register("c5_without_ignored", f"SELECT * FROM ({_IGNORABLE}) WHERE {sql.ignored(DECLARED_RULES)} IS NULL")(
    lambda spark, sf: analyze(_ignorable(spark, sf), DECLARED_RULES, ignore=True))
register(
    "c5_count_ignored",
    f"SELECT category, ignored_by, count(*) AS n FROM (SELECT *, {sql.ignored(DECLARED_RULES)} AS ignored_by FROM ({_IGNORABLE})) "
    "WHERE ignored_by IS NOT NULL GROUP BY category, ignored_by",
)(lambda spark, sf: fnd.count_ignored(fnd.emit_findings(_ignorable(spark, sf), DECLARED_RULES), DECLARED_RULES))


# ---- messages ------------------------------------------------------------------------

per_line("f6_normalize", lambda log: normalize(tx.strip(log)), "key", sql.key("trim(log)"))
per_line("f7_normalize_epoch", lambda log: normalize_filewise(log), "key", sql.key("log", True))


@register("f6_normalize_documents", f"SELECT file, ord, {sql.key('message')} AS key FROM ({sql.DOCUMENT_ENTRIES})")
def f6_documents(spark, sf):
    return dup.with_key(tb.document_entries(spark, sf)).select("file", "ord", "key")


@register("f8_group_key", f"SELECT doc_id, regexp_replace({tb.ROTATED_NAME}, '\\.\\d+$', '') AS grp FROM documents")
def f8(spark, sf):
    return tb.rotated_names(spark, sf).select("doc_id", group_key(F.col("file")).alias("grp"))


register("a2_dups_fixture", sql.groups(sql.APP_ENTRIES))(
    lambda spark, sf: dup.find_duplicates(tb.app_entries(spark, sf)))
register("a2_dups_devices", sql.groups(sql.DEVICE_ENTRIES))(
    lambda spark, sf: dup.find_duplicates(tb.device_entries(spark, sf)))
register("a2_dups_documents", sql.groups(sql.DOCUMENT_ENTRIES))(
    lambda spark, sf: dup.find_duplicates(tb.document_entries(spark, sf)))
register(
    "a2_dups_conversations",
    f"SELECT key, count(*) AS cnt FROM (SELECT {sql.key('message')} AS key FROM ({sql.CONVERSATIONS})) "
    "WHERE key <> '' GROUP BY key HAVING count(*) > 1",
)(lambda spark, sf: dup.find_duplicates(tb.conversation_entries(spark, sf)).drop("first_ord"))
register("a3_dups_per_file", sql.filewise_groups(sql.APP_FILEWISE))(
    lambda spark, sf: dup.find_filewise_duplicates(tb.app_filewise(spark, sf)))
register("a3_dups_devices", sql.filewise_groups(sql.DEVICE_FILEWISE))(
    lambda spark, sf: dup.find_filewise_duplicates(tb.device_filewise(spark, sf)))
register("a3_dups_documents", sql.filewise_groups(sql.DOCUMENT_FILEWISE))(
    lambda spark, sf: dup.find_filewise_duplicates(tb.document_filewise(spark, sf)))


@register(
    "a8_overview",
    f"SELECT (SELECT count(*) FROM ({sql.APP_ENTRIES})) AS parsed, count(*) AS groups, "
    f"CAST(coalesce(sum(cnt), 0) AS BIGINT) AS rows_in_groups FROM ({sql.groups(sql.APP_ENTRIES)})",
)
def a8(spark, sf):
    entries = tb.app_entries(spark, sf)
    return dup.duplicate_overview(entries, dup.find_duplicates(entries))


@register(
    "a8_overview_per_file",
    f"SELECT (SELECT count(*) FROM ({sql.DOCUMENT_FILEWISE})) AS parsed, count(*) AS groups, "
    f"CAST(coalesce(sum(cnt), 0) AS BIGINT) AS rows_in_groups, count(DISTINCT grp) AS families "
    f"FROM ({sql.filewise_groups(sql.DOCUMENT_FILEWISE)})",
)
def a8_filewise(spark, sf):
    entries = tb.document_filewise(spark, sf)
    return dup.duplicate_overview(entries, dup.find_filewise_duplicates(entries))


def _examples(entries: Callable[[SparkSession, str], DataFrame]) -> Query:
    def run(spark, sf):
        found = cut(dup.with_key(entries(spark, sf)), "keyed")
        return dup.first_examples(found, dup.find_duplicates(found))

    return run


register("r7_first_examples", sql.examples(sql.APP_ENTRIES))(_examples(tb.app_entries))
register("r7_first_examples_documents", sql.examples(sql.DOCUMENT_ENTRIES))(_examples(tb.document_entries))


@register(
    "r8_ordered",
    f"SELECT key, cnt, first_ord, row_number() OVER (ORDER BY cnt DESC, first_ord) AS rank "
    f"FROM ({sql.groups(sql.DOCUMENT_ENTRIES)})",
)
def r8(spark, sf):
    return dup.order_groups(dup.find_duplicates(tb.document_entries(spark, sf)))


@register(
    "r9_ordered",
    f"SELECT grp, cnt, line, row_number() OVER (PARTITION BY grp ORDER BY cnt DESC, line DESC) AS rank "
    f"FROM ({sql.filewise_groups(sql.APP_FILEWISE)})",
)
def r9(spark, sf):
    return dup.order_filewise(dup.find_filewise_duplicates(tb.app_filewise(spark, sf)))


# every source begins behind the largest place in those before it
_CONCATENATED = (
    f"WITH a AS ({sql.APP_ENTRIES}), b AS ({sql.DEVICE_ENTRIES}), c AS ({sql.DOCUMENT_ENTRIES}), "
    "ends AS (SELECT (SELECT max(ord) + 1 FROM a) AS a, (SELECT max(ord) + 1 FROM b) AS b) "
    "SELECT file, ord AS ord, message FROM a UNION ALL "
    "SELECT file, ord + (SELECT a FROM ends), message FROM b UNION ALL "
    "SELECT file, ord + (SELECT a + b FROM ends), message FROM c"
)


@register("r10_concat", sql.groups(_CONCATENATED))
def r10(spark, sf):
    sources = (tb.app_entries(spark, sf), tb.device_entries(spark, sf), tb.document_entries(spark, sf))
    # the places of these tables fit into 64 bits
    return dup.find_duplicates(dup.concat_entries(*sources)).withColumn("first_ord", F.col("first_ord").cast("bigint"))


# ---- sources -------------------------------------------------------------------------

_CHUNK = 1 << 12


@register(
    "s1_text_scan",
    f"SELECT concat('chunk=', event_id // {_CHUNK}) AS chunk, "
    f"row_number() OVER (PARTITION BY event_id // {_CHUNK} ORDER BY event_id) AS line, rtrim(log) AS log FROM ({sql.DEVICE})",
)
def s1(spark, sf):
    """Lines written as text files of bounded size and read back with their numbers."""
    folder = scratch_path(spark, "text")
    lines = tb.device_lines(spark, sf).select(
        F.floor(F.col("event_id") / _CHUNK).alias("chunk"), "event_id", "log"
    )
    by_chunk = lines.repartition("chunk").sortWithinPartitions("chunk", "event_id")
    by_chunk.select("chunk", "log").write.partitionBy("chunk").text(folder)
    numbered = src.number_lines(src.physical_lines(spark, folder))
    chunk = F.element_at(F.split("path", "/"), -2)
    return numbered.select(chunk.alias("chunk"), "line", tx.rstrip(tx.drop_bad_bytes(F.col("value"))).alias("log"))


@register(
    "s2_rotation_filter",
    f"SELECT doc_id, file FROM (SELECT doc_id, {tb.ROTATED_NAME} AS file FROM documents) "
    r"WHERE regexp_matches(file, '^src3\.log(\.\d+)?$')",
)
def s2(spark, sf):
    return src.keep_rotated(tb.rotated_names(spark, sf), "src3.log").select("doc_id", "file")


@register(
    "s4_bounded_decode",
    "SELECT doc_id, md5(text) AS whole, md5(text || chr(65533)) AS damaged, md5(text) AS dropped FROM documents",
)
def s4(spark, sf):
    whole = F.encode("text", "UTF-8")
    damaged = F.concat(whole, F.unhex(F.lit("FF")))
    return tb.table(spark, sf, "documents").select(
        "doc_id",
        F.md5(tx.decode_bounded(whole)).alias("whole"),
        F.md5(tx.decode_bounded(damaged, None)).alias("damaged"),
        F.md5(tx.drop_bad_bytes(damaged.cast("string"))).alias("dropped"),
    )


@register("s5_explode_lines", f"SELECT doc_id, pos, message FROM ({sql.DOCUMENTS})")
def s5(spark, sf):
    return arc.explode_lines(tb.table(spark, sf, "documents").select("doc_id", "text"), "text", ["doc_id"])


@register(
    "s5_explode_raw_pages",
    f"SELECT page_id, pos, raw AS line FROM ({sql.nonblank(sql.text_lines('pages', 'html', 'page_id', 'url'))})",
)
def s5_raw(spark, sf):
    pages = tb.table(spark, sf, "pages").select("page_id", "html")
    return arc.explode_lines(pages, "html", ["page_id"], strip_lines=False, name="line")


@register(
    "s6_source_filter",
    rf"""SELECT doc_id, file, regexp_matches(lower(file), '\.(txt|log)$') AND size <= 16777216 AS upload,
    CASE WHEN regexp_matches(lower(file), '\.(so|pem|crt|der|bin|img)$') THEN 'skip_ext'
    WHEN size > 8388608 THEN 'big' ELSE 'ok' END AS status,
    regexp_matches(lower(file), '^.*\.(log|txt|out|sh|bak)(\.\d+)?$') AS log_name
    FROM (SELECT doc_id, {tb.ROTATED_NAME} AS file, n_chars * 4096 AS size FROM documents)""",
)
def s6(spark, sf):
    name, size = F.col("file"), F.col("size")
    return tb.rotated_names(spark, sf).select(
        "doc_id", "file",
        (arc.has_upload_extension(name) & arc.within_upload_size(size, fv.MAX_UPLOAD_BYTES)).alias("upload"),
        arc.member_status(name, size, fv.MAX_MEMBER_BYTES).alias("status"),
        arc.is_log_name(name).alias("log_name"),
    )


_BUDGET = 100_000


@register(
    "s7_budget",
    f"""SELECT archive, member_ord, n_chars, read_before FROM (SELECT source AS archive, doc_id AS member_ord, n_chars,
    CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS BIGINT) AS read_before FROM documents) WHERE read_before <= {_BUDGET}""",
)
def s7(spark, sf):
    members = tb.table(spark, sf, "documents").select(
        F.col("source").alias("archive"), F.col("doc_id").alias("member_ord"), "n_chars"
    )
    return arc.within_budget(members, _BUDGET)


@register("s9_test_listing", sql.CASES)
def s9(spark, sf):
    return tr.parse_test_listing(tb.listing_lines(spark, sf))


@register("w3_fill_suite", f"SELECT listing, line, suite FROM ({sql.SUITES})")
def w3(spark, sf):
    return tr.fill_suite(tb.listing_lines(spark, sf)).select("listing", "line", "suite")


@register(
    "w1_line_numbers",
    f"SELECT file, event_id, row_number() OVER (PARTITION BY file ORDER BY event_id) AS line FROM ({sql.APP})",
)
def w1(spark, sf):
    lines = tb.app_lines(spark, sf).select("file", "event_id")
    return row_numbers(lines, [F.col("event_id")], ["file"], name="line")


@register(
    "a4_read_stats",
    f"""SELECT CASE WHEN {sql.strip('raw')} = '' THEN 'skip' ELSE 'ok' END AS status, count(*) AS n FROM
    (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS last FROM ({sql.text_lines('documents', 'text', 'doc_id', 'source')}))
    WHERE NOT (pos = last AND raw = '') GROUP BY 1""",
)
def a4(spark, sf):
    return arc.read_stats(arc.line_status(tb.table(spark, sf, "documents").select("text"), "text"))


@register(
    "s3_archive_members",
    f"""SELECT printf('%09d', doc_id // 500) AS archive, {tb.MEMBER_NAME} AS member, CAST(octet_length(encode(text)) AS BIGINT) AS size,
    CASE WHEN doc_id % 7 = 0 THEN 'skip_ext' ELSE 'ok' END AS status, CASE WHEN doc_id % 7 <> 0 THEN md5(text) END AS content FROM documents
    UNION ALL SELECT printf('%09d', max(doc_id // 500)) || 'z', NULL, 9, 'error', NULL FROM documents""",
)
def s3(spark, sf):
    """Documents written as tar archives, one of them damaged, and read back."""
    folder = scratch_path(spark, "archives")
    tb.tar_files(spark, sf, folder)
    name = F.regexp_extract("archive", r"archive=(\w+)", 1).alias("archive")
    members = arc.read_members(spark, folder).groupBy(name, "member_ord", "member", "size", "status")
    # a member that lies across two splits comes in two pieces
    pieces = F.array_sort(F.collect_list(F.struct("piece", "content")))
    content = F.aggregate(pieces, F.lit(b"").cast("binary"), lambda whole, p: F.concat(whole, p["content"]))
    return members.agg(F.md5(content).alias("content")).drop("member_ord")


@register(
    "a4_read_stats_archive",
    f"""WITH lines AS ({sql.text_lines('documents', 'text', 'doc_id', 'source')}),
    kept AS (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS last FROM lines WHERE doc_id % 7 <> 0)
    SELECT CASE WHEN {sql.strip('raw')} = '' THEN 'skip' ELSE 'ok' END AS status, count(*) AS n FROM kept
    WHERE NOT (pos = last AND raw = '') GROUP BY 1
    UNION ALL SELECT 'skip_ext', count(*) FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'error', 1""",
)
def a4_archive(spark, sf):
    folder = scratch_path(spark, "archives")
    tb.tar_files(spark, sf, folder)
    return arc.read_archive_stats(spark, folder)


_STREAM_FILES = 16


def _text_files(spark: SparkSession, sf: str) -> str:
    """Folder with the documents as text files, a folder per source; its rows are spread over all tasks."""
    folder = scratch_path(spark, "texts")
    docs = tb.table(spark, sf, "documents").select("source", "doc_id", "text")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    by_source = docs.repartition("source", salt).sortWithinPartitions("source", "doc_id")
    by_source.select("source", "text").write.partitionBy("source").text(folder)
    return folder


@register("j2_find_repeats", f"SELECT key, cnt FROM ({sql.groups(sql.DOCUMENT_ENTRIES)})")
def j2(spark, sf):
    """The job as a user runs it, over text files."""
    return find_repeats_in(spark, _text_files(spark, sf)).select("key", "cnt")


@register("j3_find_filewise_repeats", sql.filewise_groups(
    f"SELECT grp || '.log' AS grp, ord, line FROM ({sql.DOCUMENT_FILEWISE})"))
def j3(spark, sf):
    """The job over archives whose members are rotated logs, one family per source."""
    folder = scratch_path(spark, "archives")
    tb.tar_files(spark, sf, folder, tb.ROTATED_MEMBER)
    return find_filewise_repeats(arc.read_filewise_entries(spark, folder)).select("grp", "cnt", "line")


@register("a2_dups_stream", f"SELECT key, cnt FROM ({sql.groups(sql.APP_ENTRIES)})")
def a2_stream(spark, sf):
    """Duplicates of a folder read as a stream, a few files per micro-batch."""
    folder, out, state = (scratch_path(spark, name) for name in ("stream-in", "stream-out", "stream-state"))
    tb.app_lines(spark, sf).select("log").repartition(_STREAM_FILES).write.text(folder)
    stream = streaming.stream_entries(spark, folder, files_per_batch=_STREAM_FILES // 4)
    query = streaming.write_running(stream, out, state, available_now=True)
    query.awaitTermination()
    return streaming.read_running(spark, out)


@register("j6_rules", sql.findings(CUSTOM_RULES).replace("level NOT IN ()", "true"))
def j6(spark, sf):
    """A rule set stored, loaded again and used."""
    path = scratch_path(spark, "rules")
    save_rules(spark, CUSTOM_RULES.as_dict(), path)
    return fnd.emit_findings(tb.log_lines(spark, sf), load_rules(spark, path))


# ---- test runs -------------------------------------------------------------------------


def _tests(spark: SparkSession, sf: str) -> DataFrame:
    code, outcome = F.col("return_code"), F.col("outcome")
    return tb.test_runs(spark, sf).select(
        "test_name", tr.stopped_code(code, outcome).alias("return_code"),
        tr.test_status(code, outcome).alias("status"), "log_file",
    )


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return tr.join_test_findings(_tests(spark, sf), fnd.summarize_lines(tb.test_lines(spark, sf), RULES))


@register(
    "f16_safe_name",
    f"SELECT DISTINCT {tb.TEST_NAME} || '/x' AS test_name, translate({tb.TEST_NAME} || '/x', '/.', '__') AS safe, "
    f"'report_' || translate({tb.TEST_NAME} || '/x', '/.', '__') || '.html' AS report, "
    f"'gtest_log_' || translate({tb.TEST_NAME} || '/x', '/.', '__') || '.txt' AS log_name FROM events",
)
def f16(spark, sf):
    name = F.concat("test_name", F.lit("/x"))
    return tb.test_runs(spark, sf).select(
        name.alias("test_name"), tx.safe_name(name).alias("safe"), tx.report_name(name).alias("report"),
        tx.test_log_name(name).alias("log_name"),
    )


register("f17_status", f"SELECT test_name, return_code, status FROM ({sql.TESTS})")(
    lambda spark, sf: _tests(spark, sf).drop("log_file"))
register("f18_band", f"SELECT test_name, total_issues, band FROM ({sql.results(RULES)})")(
    lambda spark, sf: _results(spark, sf).select("test_name", "total_issues", "band"))
register("r3_test_summary", sql.results(RULES))(_results)
register(
    "a5_status_counts",
    f"""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PASSED') AS passed,
    count(*) FILTER (WHERE status = 'FAILED') AS failed,
    count(*) FILTER (WHERE status NOT IN ('PASSED', 'FAILED')) AS errors FROM ({sql.TESTS})""",
)(lambda spark, sf: tr.status_counts(_tests(spark, sf)))
register(
    "a7_totals",
    "SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in [*COUNTS, "total_issues"])
    + f" FROM ({sql.results(RULES)})",
)(lambda spark, sf: tr.issue_totals(_results(spark, sf)))



@register(
    "j4_test_runs",
    f"""SELECT r.*, 1 AS summary_rows, CASE WHEN total_issues IS NULL THEN 0 ELSE total_issues END AS report_rows,
    CASE WHEN total_issues IS NULL THEN 0 ELSE 1 END AS reports FROM ({sql.results(RULES)}) r""",
)
def j4(spark, sf):
    """The job with its reports, which are read back: rows per test in the summary and in the test's own report."""
    path = scratch_path(spark, "test-runs")
    results = summarize_test_runs(_tests(spark, sf), tb.test_lines(spark, sf), RULES, path)
    row = r"^<tr class=.[a-z]+.><td>([^<]*)</td>"
    listed = spark.read.text(f"{path}/summary").select(F.regexp_extract("value", row, 1).alias("test_name"))
    listed = listed.where("test_name <> ''").groupBy("test_name").agg(F.count(F.lit(1)).cast("int").alias("summary_rows"))
    own = spark.read.text(f"{path}/tests").groupBy("report").agg(
        F.count_if(F.col("value").startswith("<tr><td>")).alias("report_rows"),
        F.count_if(F.col("value").contains("</body>")).cast("int").alias("reports"),
    )
    both = results.join(listed, "test_name").withColumn("report", tx.report_name(F.col("test_name"))).join(own, "report", "left")
    return both.drop("report").fillna(0, ["report_rows", "reports"])


_SEEN = "CASE WHEN total_issues IS NULL THEN '<td>-</td>' ELSE concat('<td>', {c}, '</td>') END"


@register(
    "k3_consolidated_rows",
    f"""SELECT test_name, concat('<tr class="', CASE status WHEN 'PASSED' THEN 'passed' WHEN 'FAILED' THEN 'failed' ELSE 'error' END,
    '"><td>', test_name, '</td><td>', status, '</td>', {", ".join(_SEEN.format(c=c) for c in COUNTS)},
    CASE WHEN total_issues IS NULL THEN '<td>-</td><td>No log data</td>' ELSE concat('<td class="issues-', band, '">', total_issues,
    '</td><td><a href="report_', translate(test_name, '/.', '__'), '.html">View Details</a></td>') END, '</tr>') AS html
    FROM ({sql.results(RULES)})""",
)
def k3(spark, sf):
    return rep.consolidated_rows(_results(spark, sf)).select("test_name", "html")


# ---- history ---------------------------------------------------------------------------


def _daily_summary(spark: SparkSession, sf: str) -> DataFrame:
    lines = tb.daily_lines(spark, sf)
    flags = fnd.with_flags(lines, RULES).groupBy("file")
    sums = [F.count_if(F.col(c)).alias(f"{c}_count") for c in fv.CATEGORIES]
    total = sum((F.col(c) for c in COUNTS), F.lit(0)).cast("bigint")
    return flags.agg(*sums, F.max("ts").alias("timestamp")).withColumn("total_issues", total)


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@register("k4_history", sql.history(RULES))
def k4(spark, sf):
    """Appended to a history table and read back."""
    path = scratch_path(spark, "history")
    hist.append_history(_daily_summary(spark, sf), path, run_id="sf")
    return _stamped(hist.read_history(spark, path))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return hist.history_rows(_daily_summary(spark, sf), run_id="sf")


register(
    "r5_recent", f"SELECT *, row_number() OVER (ORDER BY timestamp DESC, filename, run_id) AS rank FROM ({sql.recent(RULES)})"
)(lambda spark, sf: row_numbers(
    _stamped(hist.recent_history(_history(spark, sf))),
    [F.col("timestamp").desc(), F.col("filename"), F.col("run_id")]))
register(
    "a6_history_totals",
    "SELECT count(*) AS analyses, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTS)
    + f" FROM ({sql.recent(RULES)})",
)(lambda spark, sf: hist.history_totals(hist.recent_history(_history(spark, sf))))
register("f19_display_time", f"SELECT run_id, left(timestamp, 19) AS shown FROM ({sql.history(RULES)})")(
    lambda spark, sf: _history(spark, sf).select(
        "run_id", tx.display_time(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("shown")))


@register(
    "r6_lookup",
    f"""SELECT h.run_id, h.filename, h.noisy_count, h.sensitive_count, h.severity_count, h.total_issues,
    h.total_issues AS stored_total, h.noisy_count AS noisy_logs, h.sensitive_count AS sensitive_logs,
    h.severity_count AS severity_violations FROM (SELECT * FROM ({sql.recent(RULES)}) ORDER BY timestamp DESC, filename LIMIT 1) h""",
)
def r6(spark, sf):
    """The newest analysis, looked up by its id with its stored findings."""
    path = scratch_path(spark, "history")
    lines = tb.daily_lines(spark, sf)
    record_analysis(cut(fnd.emit_findings(lines, RULES), "findings"), _daily_summary(spark, sf), path, run_id="sf")
    table = hist.read_history(spark, path)
    newest = hist.recent_history(table, 1).first()["run_id"]
    names = zip(fv.CATEGORIES, ("noisy_logs", "sensitive_logs", "severity_violations"))
    stored = hist.stored_findings(spark, path, newest).groupBy("file").agg(
        F.count(F.lit(1)).alias("stored_total"), *[F.count_if(F.col("category") == c).alias(n) for c, n in names]
    )
    return hist.get_analysis(table, newest).join(stored, F.col("file") == F.col("filename")).drop("timestamp", "file")


@register("r6_stored_findings", sql.findings(RULES, source=sql.DAILY))
def r6_stored(spark, sf):
    """Findings of all stored analyses, taken out of the history again."""
    path = scratch_path(spark, "history")
    found = cut(fnd.emit_findings(tb.daily_lines(spark, sf), RULES), "findings")
    record_analysis(found, _daily_summary(spark, sf), path, run_id="sf")
    return hist.stored_findings(spark, path)


# ---- reports -----------------------------------------------------------------------------


@register(
    "f15_html_escape",
    f"SELECT page_id, {sql.escaped('html')} AS full_escape, {sql.escaped('html', False)} AS short_escape FROM pages",
)
def f15(spark, sf):
    html = F.col("html")
    return tb.table(spark, sf, "pages").select(
        "page_id", tx.html_escape(html).alias("full_escape"), tx.html_escape(html, quotes=False).alias("short_escape")
    )


_ROW = (
    "concat('<tr><td>', line, '</td><td><strong style=''color:', CASE WHEN plugin = 'Unknown' THEN '#888888' ELSE '#0066cc' END, "
    f"'''>', {sql.escaped('plugin')}, '</strong></td><td>', {sql.escaped('reason')}, '</td><td>', {sql.escaped('log')}, '</td></tr>')"
)
_SECTION = "CASE category WHEN 'noisy' THEN 1 WHEN 'sensitive' THEN 2 ELSE 3 END"


def _report(spark: SparkSession, sf: str, profile: str) -> DataFrame:
    lines = tb.log_lines(spark, sf)
    found = cut(fnd.emit_findings(lines, RULES, profile), "findings")
    return rep.findings_report(found, fnd.summarize(found, lines.select("file").distinct()), profile)


for _profile in ft.PROFILES:
    register(
        f"k1_report_rows_{_profile}",
        f"SELECT file, {_SECTION} AS section, line, {_ROW} AS html FROM ({sql.findings(RULES, _profile)})",
    )(lambda spark, sf, p=_profile: _report(spark, sf, p).filter(
        (F.col("part") == 1) & (F.col("section") > 0)).select("file", "section", "line", "html"))


@register(
    "k1_report_outline",
    "SELECT file, count(*) AS fragments, count(*) FILTER (WHERE n = 0) AS empty_sections FROM "
    "(SELECT file, unnest([1, 1, noisy_count, sensitive_count, severity_count, 1, 1, 1]) AS n FROM "
    f"({sql.summary(RULES)})) GROUP BY file",
)
def k1_outline(spark, sf):
    frame = _report(spark, sf, "cli").filter(F.col("part") != 1)
    empty = F.count_if(F.col("html").contains("No issues found")).alias("empty_sections")
    return frame.groupBy("file").agg(F.count("*").alias("fragments"), empty)


@register(
    "k2_dup_report_rows",
    f"""SELECT key, cnt, first_ord, concat('<tr><td>', cnt, '</td><td>',
    string_agg(concat('<pre>', {sql.escaped('file')}, ': ', {sql.escaped('message')}, '</pre>'), '' ORDER BY example),
    CASE WHEN more > 0 THEN concat('<b>... and ', more, ' more similar lines</b>') ELSE '' END, '</td></tr>') AS html
    FROM ({sql.examples(sql.DEVICE_ENTRIES)}) GROUP BY key, cnt, first_ord, more""",
)
def k2(spark, sf):
    return rep.duplicate_rows(_examples(tb.device_entries)(spark, sf))


@register(
    "k5_result_lines",
    f"""SELECT file AS filename, CAST(to_json(struct_pack(filename := file, category := category, line := line, log := log,
    plugin := plugin, reason := reason)) AS VARCHAR) AS json FROM ({sql.findings(RULES)})""",
)
def k5_lines(spark, sf):
    return rep.result_lines(fnd.emit_findings(tb.log_lines(spark, sf), RULES))


_ITEMS = ", ".join(
    f"""{out} := coalesce((SELECT list(struct_pack(line := line, log := log, plugin := plugin, reason := reason) ORDER BY line)
    FROM ff WHERE ff.file = s.file AND category = '{c}'), [])"""
    for c, out in zip(fv.CATEGORIES, ["noisy_logs", "sensitive_logs", "severity_violations"])
)


@register(
    "k5_result_json",
    f"""WITH ff AS MATERIALIZED ({sql.findings(RULES, source=sql.DAILY)}), s AS ({sql.summary(RULES, source=sql.DAILY)})
    SELECT file AS filename, CAST(0 AS BIGINT) AS chunk, CAST(to_json(struct_pack(filename := file, summary := struct_pack(total_issues := total_issues,
    noisy_count := noisy_count, sensitive_count := sensitive_count, severity_count := severity_count), {_ITEMS})) AS VARCHAR) AS json
    FROM s""",
)
def k5(spark, sf):
    lines = tb.daily_lines(spark, sf)
    found = cut(fnd.emit_findings(lines, RULES), "findings")
    return rep.result_json(found, fnd.summarize(found, lines.select("file").distinct()))


@register(
    "k7_filewise_rows",
    f"SELECT grp, cnt, line, concat('<tr><td>', cnt, '</td><td>', {sql.escaped('line', False)}, '</td></tr>') AS html "
    f"FROM ({sql.filewise_groups(sql.DEVICE_FILEWISE)})",
)
def k7(spark, sf):
    return rep.filewise_rows(dup.find_filewise_duplicates(tb.device_filewise(spark, sf)))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Findings per category over the application lines."""
    found = fnd.emit_findings(tb.app_lines(spark, sf), RULES)
    return found.groupBy("category").agg(F.count("*").alias("n"))


register("j1_totals", f"SELECT category, count(*) AS n FROM ({sql.findings(RULES, source=sql.APP)}) GROUP BY category")(flagship)
