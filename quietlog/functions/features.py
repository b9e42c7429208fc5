"""What can be said about one log line: timestamp, level, component, rule hits.

All functions map Columns to Columns and stay inside generated code. Cheap
substring tests stand in front of regexes wherever they are implied by them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlog import fixed_values as fv
from quietlog.functions.text import REGEX_FLAGS, pattern
from quietlog.rules import Components, Rules, required_text

PROFILES = ("cli", "web")


def check_profile(profile: str) -> str:
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}, not {profile!r}")
    return profile


# ---- timestamp gate -------------------------------------------------------------

_INDENTED_SHAPES = [
    fv.CLOCK,
    f"{fv.DATE}{fv.SPACE}+{fv.CLOCK}",
    rf"(?:{fv.MONTH_NAMES}){fv.SPACE}+\d{{1,2}}{fv.SPACE}+{fv.CLOCK}",
]


def has_timestamp(log: Column, profile: str = "cli") -> Column:
    """Whether the line opens with an accepted timestamp (nothing is required behind it)."""
    shapes = list(_INDENTED_SHAPES)
    if check_profile(profile) == "web":
        shapes.append(fv.COMPACT_DATE_CLOCK)
    gate = f"^{fv.SPACE}*(?:{'|'.join(shapes)})"
    if profile == "web":
        gate = f"{gate}|^{fv.ISO_ZULU}"
    return log.rlike(pattern(gate))


_STAMP = (
    rf"^{fv.SPACE}*(?:({fv.DATE})(?:{fv.SPACE}+|T)|((?:{fv.MONTH_NAMES}){fv.SPACE}+\d{{1,2}}){fv.SPACE}+|(\d{{6}})-)?"
    rf"({fv.CLOCK})(?:\.(\d{{1,6}}))?"
)


def event_micros(log: Column, day: str = "1970-01-01", year: int = 1972) -> Column:
    """Time at the start of a line in microseconds since 1970, by its own clock; null without one.

    All shapes of :func:`has_timestamp` are read. A shape without a date gets ``day``, one without
    a year gets ``year`` (a leap year, so that every day exists); two-digit years are of this century.
    """
    def part(n: int) -> Column:
        return F.regexp_extract(log, pattern(_STAMP), n)

    date, month_day, compact, clock, fraction = (part(n) for n in range(1, 6))
    spaced = F.concat(F.lit(f"{year} "), F.regexp_replace(month_day, pattern(f"{fv.SPACE}+"), " "))
    days = (
        F.when(date != "", F.try_to_date(date, "yyyy-MM-dd"))
        .when(month_day != "", F.try_to_date(spaced, "yyyy MMM d"))
        .when(compact != "", F.try_to_date(F.concat(F.lit("20"), compact), "yyyyMMdd"))
        .otherwise(F.lit(day).cast("date"))
    )
    seconds = sum(
        (F.substring(clock, at, 2).cast("bigint") * unit for at, unit in ((1, 3600), (4, 60), (7, 1))), F.lit(0).cast("bigint")
    )
    micros = (F.unix_date(days).cast("bigint") * 86400 + seconds) * 1000000 + F.rpad(fraction, 6, "0").cast("bigint")
    return F.when(clock != "", micros)


# ---- level ----------------------------------------------------------------------


def _has_word(log: Column, word: str) -> Column:
    return log.contains(word) & log.rlike(pattern(rf"\b{word}\b"))


def detect_level(log: Column, profile: str = "cli") -> Column:
    """Severity of a line: the most severe level word; ``web`` looks at level tags first."""
    tests: list[tuple[Column, str]] = []
    if check_profile(profile) == "web":
        for text, level in fv.TAGGED_LEVELS:
            if text.startswith("\\"):
                tag = log.contains("[Info") & log.rlike(pattern(text.replace(r"\s", fv.SPACE)))
            else:
                tag = log.contains(text)
            tests.append((tag, level))
    tests += [(_has_word(log, level), level) for level in fv.LEVELS_BY_PRIORITY]
    chain = F.when(tests[0][0], tests[0][1])
    for test, level in tests[1:]:
        chain = chain.when(test, level)
    return chain.otherwise(fv.UNKNOWN_LEVEL)


# ---- component ------------------------------------------------------------------


def lookup_component(file_name: Column, default: Column, mapping: dict[str, str] | None = None) -> Column:
    """Component of a source file name, ``default`` where the table has none."""
    mapping = fv.COMPONENT_OF_FILE if mapping is None else mapping
    if not mapping:
        return default
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(table, file_name), default)


def _short_name(file_name: Column) -> Column:
    stem = F.replace(F.replace(file_name, F.lit(".cpp"), F.lit("")), F.lit(".h"), F.lit(""))
    # no suffix is the tail of another one, so list order needs no chain
    return F.regexp_replace(stem, f"(?:{'|'.join(fv.COMPONENT_SUFFIXES)})\\z", "")


def with_component(lines: DataFrame, name: str = "plugin", components: Components | None = None) -> DataFrame:
    """Adds the component of each line: source file tag, module tag, error tag, mentions.

    An error tag yields the empty string, which is a value of its own here. The tag
    and its short form are columns of their own, so their regexes run once.
    """
    components = components or Components()
    log, source_file, short = F.col("log"), F.col("_source_file"), F.col("_short")
    tag = F.regexp_extract(log, pattern(fv.SOURCE_FILE_TAG), 1)
    module = F.regexp_extract(log, pattern(fv.MODULE_TAG), 1)
    process = F.regexp_extract(log, pattern(fv.PROCESS_TAG), 1)
    power_text, power = fv.POWER_MENTION
    fallback = F.when(short != "", short).otherwise(fv.UNKNOWN_COMPONENT)
    chain = (
        F.when(source_file != "", lookup_component(source_file, fallback, components.of_file))
        .when(log.contains("[mod=") & (module != ""), module)
        .when(log.contains("[ERROR:") & log.rlike(pattern(fv.ERROR_FILE_TAG)), F.lit(""))
        .when(log.contains(power_text), F.lit(power))
        .when(log.contains("WPE[") & (process != ""), process)
    )
    for texts, component in components.of_mention:
        chain = chain.when(reduce(or_, [log.contains(t) for t in texts]), F.lit(component))
    tagged = lines.withColumn("_source_file", F.when(log.contains("["), tag).otherwise(""))
    shortened = tagged.withColumn("_short", _short_name(source_file))
    component = chain.otherwise(fv.UNKNOWN_COMPONENT).alias(name)
    return shortened.select(*lines.columns, component)


# ---- rule predicates --------------------------------------------------------------


def _any(tests: list[Column]) -> Column:
    return reduce(or_, tests) if tests else F.lit(False)


def is_noisy(level: Column, rules: Rules) -> Column:
    return level.isin(rules.noisy_log_levels) if rules.noisy_log_levels else F.lit(False)


def is_ascii(log: Column) -> Column:
    return F.octet_length(log) == F.char_length(log)


def is_sensitive(
    log: Column, rules: Rules, lower_log: Column | None = None, ascii_only: Column | None = None
) -> Column:
    """Whether any pattern is found. Separate tests: one big alternation is slower.

    Given the lower-cased line and whether it is plain ASCII, as columns, a pattern is
    searched only in lines with the text it cannot do without. Other lines are always
    searched where case is ignored, as a few letters fold to ASCII ones.
    """
    tests = []
    for p in rules.sensitive_patterns:
        test = log.rlike(REGEX_FLAGS + p)
        needed = required_text(p)
        if needed and not needed[1]:
            test = log.contains(needed[0]) & test
        elif needed and lower_log is not None and ascii_only is not None:
            test = (~ascii_only | lower_log.contains(needed[0])) & test
        tests.append(test)
    return _any(tests)


def ignored_by(log: Column, patterns: list[str]) -> Column:
    """The first of the patterns that is found in the line, null if none is."""
    chain = F.lit(None).cast("string")
    for p in reversed(patterns):
        needed = required_text(p)
        test = log.rlike(REGEX_FLAGS + p)
        if needed and not needed[1]:
            test = log.contains(needed[0]) & test
        chain = F.when(test, F.lit(p)).otherwise(chain)
    return chain


def has_failure(lower_log: Column, rules: Rules) -> Column:
    """Whether a failure keyword occurs; takes the line already lower-cased."""
    return _any([lower_log.contains(k) for k in rules.failure_keywords])


def violates_severity(lower_log: Column, level: Column, rules: Rules) -> Column:
    """A failure that is not logged at one of the required levels."""
    required = rules.required_severity_on_failure
    wrong_level = ~level.isin(required) if required else F.lit(True)
    return wrong_level & has_failure(lower_log, rules)


def reason(category: Column, level: Column, plugin: Column, rules: Rules, profile: str = "cli") -> Column:
    """Text that explains a finding."""
    severity = F.lit(fv.SEVERITY_REASON + ", ".join(rules.required_severity_on_failure))
    if check_profile(profile) == "cli":
        severity = F.concat(F.lit("Plugin '"), plugin, F.lit("': "), severity)
    return (
        F.when(category == fv.NOISY, F.concat(F.lit(fv.NOISY_REASON), level))
        .when(category == fv.SENSITIVE, F.lit(fv.SENSITIVE_REASON))
        .when(category == fv.SEVERITY, severity)
    )


def redact(log: Column, rules: Rules, mode: str = "off") -> Column:
    """``off`` leaves the line as it is; ``on`` replaces every sensitive match, in rule order."""
    if mode not in ("off", "on"):
        raise ValueError("mode must be 'off' or 'on'")
    if mode == "on":
        for p in rules.sensitive_patterns:
            log = F.regexp_replace(log, REGEX_FLAGS + p, fv.REDACTED)
    return log
