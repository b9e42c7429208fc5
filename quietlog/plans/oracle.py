"""Comparison SQL for the registered queries, in DuckDB's dialect.

RE2 has no look-around and ASCII classes only, so patterns are rewritten where that
matters: a look-behind for "no word character" in front of a word character is a word
boundary, a look-ahead for white space may swallow it, and the one excluded address
prefix is tested on the extracted address.
"""

from __future__ import annotations

from quietlog import fixed_values as fv
from quietlog.plans import tables as tb
from quietlog.rules import Rules

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
WORD_EDGE_L, WORD_EDGE_R = r"(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:$|[^\p{L}\p{M}\p{N}_])"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def found(column: str, regex: str) -> str:
    return f"regexp_matches({column}, {q(regex)})"


def _events(log: str, file: str) -> str:
    return (
        f"SELECT event_id, user_id, ts, event_type, event_id + 1 AS line, {file} AS file, "
        f"{tb.render(log, tb.SQL_DATES)} AS log FROM events"
    )


APP = _events(tb.APP_LOG, tb.APP_FILE)
DEVICE = _events(tb.DEVICE_LOG, tb.DEVICE_FILE)
COMPONENT_EVENTS = _events(tb.COMPONENT_LOG, tb.DEVICE_FILE)
LINES = f"{APP} UNION ALL {DEVICE}"
DAILY = _events(tb.APP_LOG, tb.render("concat('app', user_id % 5, '-', @day@, '.log')", tb.SQL_DATES))


# ---- line features ---------------------------------------------------------------

_MONTH = rf"(?:{fv.MONTH_NAMES})\s+\d{{1,2}}\s+{fv.CLOCK}"
GATE_CLI = found("log", rf"^\s*(?:{fv.CLOCK}|{fv.DATE}\s+{fv.CLOCK}|{_MONTH})")
GATE_WEB = f"({GATE_CLI} OR {found('log', '^' + fv.ISO_ZULU)} OR {found('log', r'^\s*' + fv.COMPACT_DATE_CLOCK)})"
_WORDS = " ".join(f"WHEN {found('log', rf'\b{w}\b')} THEN '{w}'" for w in fv.LEVELS_BY_PRIORITY)
LEVEL_CLI = f"CASE {_WORDS} ELSE 'UNKNOWN' END"
_TAGS = " ".join(
    f"WHEN {found('log', t) if t.startswith(chr(92)) else f'contains(log, {q(t)})'} THEN '{level}'"
    for t, level in fv.TAGGED_LEVELS
)
LEVEL_WEB = f"CASE {_TAGS} {_WORDS} ELSE 'UNKNOWN' END"
GATE = {"cli": GATE_CLI, "web": GATE_WEB}
LEVEL = {"cli": LEVEL_CLI, "web": LEVEL_WEB}

_FILE = f"regexp_extract(log, {q(fv.SOURCE_FILE_TAG)}, 1)"
_SHORT = (
    f"regexp_replace(replace(replace({_FILE}, '.cpp', ''), '.h', ''), "
    f"{q('(?:' + '|'.join(fv.COMPONENT_SUFFIXES) + ')$')}, '')"
)
MAPPING = ", ".join(f"({q(k)}, {q(v)})" for k, v in fv.COMPONENT_OF_FILE.items())
_MAPPED = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.COMPONENT_OF_FILE.items())
_MENTIONS = " ".join(
    f"WHEN {' OR '.join(f'contains(log, {q(t)})' for t in texts)} THEN {q(c)}"
    for texts, c in fv.COMPONENT_OF_MENTION
)
COMPONENT = (
    f"CASE WHEN {found('log', fv.SOURCE_FILE_TAG)} THEN CASE {_FILE} {_MAPPED} "
    f"ELSE coalesce(nullif({_SHORT}, ''), 'Unknown') END "
    f"WHEN {found('log', fv.MODULE_TAG)} THEN regexp_extract(log, {q(fv.MODULE_TAG)}, 1) "
    f"WHEN {found('log', fv.ERROR_FILE_TAG)} THEN '' "
    f"WHEN contains(log, {q(fv.POWER_MENTION[0])}) THEN {q(fv.POWER_MENTION[1])} "
    f"WHEN {found('log', fv.PROCESS_TAG)} THEN regexp_extract(log, {q(fv.PROCESS_TAG)}, 1) "
    f"{_MENTIONS} ELSE 'Unknown' END"
)

_ADDRESS = r'(?i)"ipaddr"\s*:\s*"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})"'


def sensitive(rules: Rules, column: str = "log", unicode_edges: bool = False) -> str:
    tests = []
    for p in rules.sensitive_patterns:
        if "(?!" in p:
            tests.append(
                f"len(list_filter(regexp_extract_all({column}, {q(_ADDRESS)}, 1), "
                f"lambda a: NOT starts_with(a, '127.0.0.1'))) > 0"
            )
            continue
        if unicode_edges and p.count(r"\b") == 2 and p.endswith(r"\b"):
            p = p.replace(r"\b", WORD_EDGE_L, 1).replace(r"\b", WORD_EDGE_R, 1)
        elif unicode_edges:
            p = p.replace(r"\b", WORD_EDGE_L, 1)
        tests.append(found(column, p))
    return "(" + " OR ".join(tests) + ")"


def failure(rules: Rules) -> str:
    return "(" + " OR ".join(f"contains(lower(log), {q(k)})" for k in rules.failure_keywords) + ")"


def levels(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def flagged(rules: Rules, profile: str, source: str = LINES) -> str:
    """Lines with gate, level, component and the three flags."""
    gate = GATE[profile]
    return f"""SELECT *, level IN {levels(rules.noisy_log_levels)} AS noisy,
      {sensitive(rules)} AS sensitive,
      {failure(rules)} AND level NOT IN {levels(rules.required_severity_on_failure)} AS severity
      FROM (SELECT *, {LEVEL[profile]} AS level, {COMPONENT} AS plugin FROM ({source}) WHERE {gate})"""


def findings(rules: Rules, profile: str = "cli", source: str = LINES) -> str:
    why = q(fv.SEVERITY_REASON + ", ".join(rules.required_severity_on_failure))
    if profile == "cli":
        why = f"concat('Plugin ''', plugin, ''': ', {why})"
    part = "SELECT '{c}' AS category, file, line, plugin, {r} AS reason, log FROM f WHERE {c}"
    parts = [
        part.format(c="noisy", r=f"concat({q(fv.NOISY_REASON)}, level)"),
        part.format(c="sensitive", r=q(fv.SENSITIVE_REASON)),
        part.format(c="severity", r=why),
    ]
    return f"WITH f AS ({flagged(rules, profile, source)}) " + " UNION ALL ".join(parts)


def summary(rules: Rules, profile: str = "cli", source: str = LINES, key: str = "file") -> str:
    """Counts per file, also for files without a finding."""
    return f"""SELECT s.{key}, count(*) FILTER (WHERE noisy) AS noisy_count,
      count(*) FILTER (WHERE sensitive) AS sensitive_count, count(*) FILTER (WHERE severity) AS severity_count,
      count(*) FILTER (WHERE noisy) + count(*) FILTER (WHERE sensitive) + count(*) FILTER (WHERE severity) AS total_issues
      FROM (SELECT {key}, line, log FROM ({source})) s
      LEFT JOIN ({flagged(rules, profile, source)}) f ON s.{key} = f.{key} AND s.line = f.line AND s.log = f.log
      GROUP BY s.{key}"""


def redacted(rules: Rules) -> str:
    text = "log"
    for p in rules.sensitive_patterns:
        if "(?!" in p:
            plain = p.replace(r"(?!127\.0\.0\.1|localhost)", "")
            text = (
                f"CASE WHEN starts_with(regexp_extract({text}, {q(_ADDRESS)}, 1), '127.0.0.1') THEN {text} "
                f"ELSE regexp_replace({text}, {q(plain)}, '[REDACTED]', 'g') END"
            )
        else:
            text = f"regexp_replace({text}, {q(p)}, '[REDACTED]', 'g')"
    return text


# ---- messages ----------------------------------------------------------------------


def key(column: str, with_epoch: bool = False) -> str:
    parts = [r"\b(?:" + "|".join(fv.VOLATILE_TIMES) + ")"]
    if with_epoch:
        parts.append(fv.VOLATILE_EPOCH)
    regex = "|".join(parts + fv.VOLATILE_PARTS).replace("(?=" + fv.SPACE + ")", fv.SPACE)
    regex = "(?i)" + regex.replace(fv.SPACE, SPACE)
    stable = f"regexp_replace({column}, {q(regex)}, ' ', 'g')"
    return f"lower(trim(regexp_replace({stable}, {q(SPACE + '+')}, ' ', 'g')))"


def strip(column: str) -> str:
    return f"regexp_replace({column}, {q('^' + SPACE + '+|' + SPACE + '+$')}, '', 'g')"


def text_lines(name: str, text: str, ids: str, file: str) -> str:
    """All lines of a text column with their place, blank ones included."""
    end = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
    pieces = f"string_split_regex({text}, {q(end)})"
    return (
        f"SELECT {ids}, {file} AS file, unnest({pieces}) AS raw, "
        f"generate_subscripts({pieces}, 1) - 1 AS pos FROM {name}"
    )


def nonblank(lines: str) -> str:
    return f"SELECT *, {strip('raw')} AS message FROM ({lines}) WHERE {strip('raw')} <> ''"


DOCUMENTS = nonblank(text_lines("documents", "text", "doc_id", "source"))
DOCUMENT_ENTRIES = f"SELECT file, doc_id * 16777216 + pos AS ord, message, raw FROM ({DOCUMENTS})"
CONVERSATIONS = nonblank(text_lines("conversations", "text", "conv_id, turn", "role"))
APP_ENTRIES = f"SELECT file, event_id AS ord, trim(log) AS message FROM ({APP})"
DEVICE_ENTRIES = f"SELECT file, event_id AS ord, trim(log) AS message FROM ({DEVICE})"


def groups(entries: str) -> str:
    return (
        f"SELECT key, count(*) AS cnt, min(ord) AS first_ord FROM "
        f"(SELECT *, {key('message')} AS key FROM ({entries})) WHERE key <> '' GROUP BY key HAVING count(*) > 1"
    )


def filewise_groups(entries: str) -> str:
    """``entries`` has grp, ord and line."""
    return (
        f"SELECT grp, cnt, line FROM (SELECT grp, key, count(*) AS cnt, arg_min(line, ord) AS line FROM "
        f"(SELECT *, {key('line', True)} AS key FROM ({entries})) WHERE key <> '' "
        f"GROUP BY grp, key HAVING count(*) > 1)"
    )


APP_FILEWISE = f"SELECT file AS grp, event_id AS ord, log AS line FROM ({APP})"
DEVICE_FILEWISE = f"SELECT file AS grp, event_id AS ord, log AS line FROM ({DEVICE})"
DOCUMENT_FILEWISE = f"SELECT file AS grp, ord, raw AS line FROM ({DOCUMENT_ENTRIES})"


def examples(entries: str, k: int = fv.EXAMPLES_PER_GROUP) -> str:
    return (
        f"SELECT g.key, cnt, first_ord, example, ord, file, message, "
        f"CAST(greatest(cnt - {k}, 0) AS BIGINT) AS more FROM ({groups(entries)}) g JOIN "
        f"(SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS example FROM "
        f"(SELECT *, {key('message')} AS key FROM ({entries}))) e ON g.key = e.key WHERE example <= {k}"
    )


def escaped(column: str, quotes: bool = True) -> str:
    text = f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    if quotes:
        text = f"replace(replace({text}, '\"', '&quot;'), '''', '&#x27;')"
    return text


# ---- test runs ---------------------------------------------------------------------

TESTS = f"""SELECT test_name, CASE WHEN outcome IS NOT NULL THEN -1 ELSE code END AS return_code,
  CASE WHEN outcome = 'timeout' THEN 'TIMEOUT' WHEN outcome IS NOT NULL THEN 'ERROR: ' || outcome
  WHEN code = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, log_file FROM
  (SELECT DISTINCT {tb.TEST_NAME} AS test_name, CAST(user_id % 4 AS INT) AS code, {tb.TEST_LOG} AS log_file,
   CASE WHEN user_id % 31 = 5 THEN 'timeout' WHEN user_id % 37 = 6 THEN 'no binary' END AS outcome FROM events)"""
TEST_LINES = f"SELECT * FROM ({_events(tb.APP_LOG, tb.TEST_LOG)}) WHERE file IS NOT NULL"


def results(rules: Rules) -> str:
    return f"""SELECT t.*, c.noisy_count, c.sensitive_count, c.severity_count, c.total_issues,
      CASE WHEN total_issues > 20 THEN 'high' WHEN total_issues > 5 THEN 'medium'
      WHEN total_issues IS NOT NULL THEN 'low' END AS band
      FROM ({TESTS}) t LEFT JOIN ({summary(rules, source=TEST_LINES)}) c ON t.log_file = c.file"""


_ENTRY = strip("text")
LISTING = """SELECT concat('run', user_id % 4) AS listing, event_id AS line,
  CASE CAST(event_id % 7 AS INT) WHEN 0 THEN concat('Suite', user_id % 11, '.')
  WHEN 3 THEN '' WHEN 4 THEN concat('  Case', event_id, '  # GetParam() = ', user_id)
  WHEN 5 THEN concat('note ', user_id)
  WHEN 6 THEN CASE WHEN user_id % 5 = 0 THEN concat('Typed/', user_id, '.  # TypeParam = int') ELSE '.' END
  ELSE concat('  Case', event_id) END AS text FROM events"""
SUITES = f"""SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY listing ORDER BY line) AS suite FROM
  (SELECT *, CASE WHEN ends_with({_ENTRY}, '.') THEN left({_ENTRY}, length({_ENTRY}) - 1) END AS opens FROM ({LISTING}))"""
CASES = f"""SELECT listing, line, suite, {_ENTRY} AS test, concat(suite, '.', {_ENTRY}) AS full_name
  FROM ({SUITES}) WHERE opens IS NULL AND starts_with(text, '  ') AND suite <> '' AND {_ENTRY} <> ''"""


# ---- history -----------------------------------------------------------------------


def history(rules: Rules) -> str:
    stamp = "strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f')"
    return f"""SELECT sha256(concat('sf', '|', file, '|', {stamp})) AS run_id, {stamp} AS timestamp, file AS filename,
      noisy_count, sensitive_count, severity_count, total_issues FROM ({summary(rules, source=DAILY)})
      JOIN (SELECT file, max(ts) AS timestamp FROM ({DAILY}) GROUP BY file) USING (file)"""


def recent(rules: Rules) -> str:
    return f"SELECT * FROM ({history(rules)}) ORDER BY timestamp DESC, filename, run_id LIMIT {fv.HISTORY_ROWS_SHOWN}"


# ---- rules per component -----------------------------------------------------------

_RULED = f"SELECT *, {COMPONENT} AS plugin FROM ({COMPONENT_EVENTS}) WHERE {GATE_WEB}"


def mentions(rules: Rules) -> str:
    """Texts of a component in its lines."""
    title = {"critical_state": "Critical state: ", "warning_event": "Warning event: ", "sensitive_operation": "Sensitive operation: "}
    rows = ", ".join(f"({q(r.component)}, {q(r.kind)}, {q(title[r.kind] + r.name)}, {q(r.name)})" for r in rules.component_rules if r.kind in title)
    return (
        f"SELECT kind AS category, file, line, plugin, reason, log FROM ({_RULED}) "
        f"JOIN (VALUES {rows}) r(component, kind, reason, name) ON plugin = component AND contains(log, name)"
    )


def thresholds(rules: Rules) -> str:
    """Readings of a component in the range of a grade."""
    rows = ", ".join(
        f"({q(r.component)}, {q(r.name)}, {q(r.grade)}, {r.low!r}, {'CAST(''inf'' AS DOUBLE)' if r.high == float('inf') else repr(r.high)})"
        .replace("CAST(inf", "CAST('inf'") for r in rules.component_rules if r.kind == "threshold"
    )
    reading = r"\b([A-Za-z][A-Za-z_]*)[ \t]*(?:[=:]|is|of|at)?[ \t]*(-?\d+(?:\.\d+)?)"
    return f"""WITH read AS (SELECT *, lower(unnest(regexp_extract_all(log, {q(reading)}, 1))) AS name,
      CAST(unnest(regexp_extract_all(log, {q(reading)}, 2)) AS DOUBLE) AS value FROM ({_RULED}))
      SELECT 'threshold' AS category, file, line, plugin, concat(upper(grade[1]), lower(grade[2:]), ' threshold reached: ', r.name, ' ', value,
      ' (from ', low, ')') AS reason, log, value FROM read JOIN (SELECT component, name, grade, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high
      FROM (VALUES {rows}) v(component, name, grade, low, high)) r ON plugin = component AND read.name = r.name AND value >= low AND value < high"""


_STAMP = rf"^\s*(?:({fv.DATE})(?:\s+|T)|((?:{fv.MONTH_NAMES})\s+\d{{1,2}})\s+|(\d{{6}})-)?({fv.CLOCK})(?:\.(\d{{1,6}}))?"


def _stamp(n: int) -> str:
    return f"regexp_extract(log, {q(_STAMP)}, {n})"


EVENT_MICROS = f"""(epoch_us(CAST(CASE WHEN {_stamp(1)} <> '' THEN CAST({_stamp(1)} AS DATE)
  WHEN {_stamp(2)} <> '' THEN CAST(strptime('1972 ' || {_stamp(2)}, '%Y %b %d') AS DATE)
  WHEN {_stamp(3)} <> '' THEN CAST(strptime('20' || {_stamp(3)}, '%Y%m%d') AS DATE) ELSE DATE '1970-01-01' END AS TIMESTAMP))
  + (CAST({_stamp(4)}[1:2] AS BIGINT) * 3600 + CAST({_stamp(4)}[4:5] AS BIGINT) * 60 + CAST({_stamp(4)}[7:8] AS BIGINT)) * 1000000
  + CAST(rpad({_stamp(5)}, 6, '0') AS BIGINT))"""


def frequencies(rules: Rules) -> str:
    """Operations of a component that came again too soon, by a self join on time."""
    rows = ", ".join(f"({q(r.component)}, {q(r.name)}, {r.seconds!r})" for r in rules.component_rules if r.kind == "frequent_operation")
    return f"""WITH seen AS (SELECT file, plugin, name, CAST(seconds AS DOUBLE) AS seconds, {EVENT_MICROS} AS at_micros, line, log FROM ({_RULED})
      JOIN (VALUES {rows}) r(component, name, seconds) ON plugin = component AND contains(log, name)),
      instants AS (SELECT file, plugin, name, seconds, at_micros, count(*) AS n, min(line) AS line, arg_min(log, line) AS log FROM seen GROUP BY ALL),
      counted AS (SELECT a.*, (SELECT CAST(sum(b.n) AS BIGINT) FROM instants b WHERE b.file = a.file AND b.plugin = a.plugin AND b.name = a.name
        AND b.at_micros <= a.at_micros AND b.at_micros > a.at_micros - seconds * 1000000) AS within FROM instants a)
      SELECT 'frequent_operation' AS category, file, line, plugin, concat('Frequent operation: ', name, ' came ', within, ' times within ',
      seconds, ' s') AS reason, log, at_micros, n, within FROM counted WHERE within > 1"""


def ignored(rules: Rules, column: str = "log") -> str:
    """The first ignore pattern found in a line."""
    return "CASE " + " ".join(f"WHEN {found(column, p)} THEN {q(p)}" for p in rules.ignore_patterns) + " END"
